"""Mixing sources to target weights by Poisson replication.

Every document of a source is repeated k times, k drawn from a Poisson
distribution whose mean is the source's target repetition rate. The draw inverts
the distribution function at a number hashed from seed and document, so a task
that runs again gives the same rows. A rate above PART is drawn as a sum of
independent parts, which keeps exp(-rate) in range. Copies are then dealt and
sorted by a hash of their own: a random order of the whole corpus, in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.workspace import Workspace

PART = 256.0
#: Sources up to which their table of rates (some KB each) is sent to every executor.
FEW = 1000


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float, total: int | None) -> DataFrame:
    """(source, rate): target rows over rows there are. Without weights a source weighs rows ** alpha."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.lit(None)
        counts = counts.withColumn("w", F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0)) if weights else F.lit(0.0))
    whole = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    target = F.col("all_n") if total is None else F.lit(total)
    return counts.crossJoin(F.broadcast(whole)).select("source", F.coalesce(F.try_divide(target * F.col("w"), F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate"))


def _repeated(spark: SparkSession, docs: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None, alpha: float, total: int | None, seed: int) -> DataFrame:
    """docs, whose columns have names of our own, with its rows repeated; further columns `copy_no` and `shuffle_key`."""
    ws = Workspace(spark, "mixing")
    names = docs.columns
    table = rates(docs, source_col, weights, alpha, total)
    table = table.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    cdf = """aggregate(sequence(1, cast(ceil(mean + 12 * sqrt(mean)) + 20 as int)), named_struct('p', exp(-mean), 'c', array(exp(-mean))),
                       (s, k) -> named_struct('p', s.p * mean / k, 'c', array_append(s.c, element_at(s.c, -1) + s.p * mean / k)), s -> s.c)"""
    table = table.select(F.col("source").alias("mix_source"), F.col("parts").alias("mix_parts"), F.expr(cdf).alias("mix_cdf"))
    if table.select("mix_source").limit(FEW + 1).count() <= FEW:
        table = F.broadcast(table)
    docs = docs.select(*names, F.col(id_col).cast("string").alias("mix_id"))
    whole = F.concat(F.lit("row-"), F.md5(F.to_json(F.struct(*(F.col(c) for c in names)), {"ignoreNullFields": "false"})))
    again = ws.save(docs.where("mix_id IS NOT NULL").groupBy("mix_id").agg(F.count("*").alias("n")).where("n > 1").select("mix_id", F.lit(True).alias("mix_again")), "again")
    if again.limit(1).count():
        docs = docs.join(again, "mix_id", "left").withColumn("mix_id", F.when(F.col("mix_again"), whole).otherwise(F.col("mix_id")))
    docs = docs.withColumn("mix_id", F.coalesce("mix_id", whole))
    drawn = docs.join(table, F.col(source_col).cast("string").eqNullSafe(F.col("mix_source")))

    def times(part):
        u = uniform(F.lit(seed), F.col("mix_id"), part)
        return F.size(F.filter("mix_cdf", lambda c: c <= u))

    many = F.aggregate(F.sequence(F.lit(0), F.col("mix_parts") - 1), F.lit(0), lambda s, part: s + times(part))
    copies = drawn.withColumn("mix_k", many).where("mix_k > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("mix_k"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), "mix_id", F.col("copy_no").cast("string"))))
    return keyed.select(*names, "copy_no", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 0, numbered: bool = True
) -> DataFrame:
    """docs with rows repeated to the target weights, in random order; further columns `copy_no` and `shuffle_key`.

    weights: share of each source (others get none); null sources count as one
    source of their own under alpha. total: expected rows of the result, by
    default as many as docs has. A row without id, or whose id another row has too, is
    drawn and placed by a hash of all its columns, so only rows that are equal in all
    of them share a draw. Null and empty texts are rows like others. Columns of docs may
    have any names; one that has one of the two new names is replaced. Without
    `numbered` the new columns are left out and docs keeps all its own.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(reversed(docs.columns), reversed(own)))
    out = _repeated(spark, docs.toDF(*own), place[id_col], place[source_col], weights, alpha, total, seed)
    new = ("copy_no", "shuffle_key") if numbered else ()
    return out.select(*(F.col(c).alias(name) for c, name in zip(own, docs.columns) if name not in new), *new)
