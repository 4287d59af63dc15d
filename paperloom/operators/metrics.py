"""Histograms, counters and gauges, and their text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the buckets.
JOB_SECONDS = (1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600)
STAGE_SECONDS = (0.1, 0.5, 1, 5, 15, 60, 300, 900)
ROUTED_RATIO = (0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)
VERBATIM = (0.9, 0.95, 0.98, 0.99, 0.995, 1.0)


def histogram(values: DataFrame, value: str, bounds, *labels: str) -> DataFrame:
    """(labels, le, n): how many values are at most each bound; le is infinite for all of them."""
    bounds = [*map(float, bounds), float("inf")]
    sums = values.where(F.col(value).isNotNull()).groupBy(*labels).agg(*(F.count_if(F.col(value) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)))
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds))))
    return sums.select(*labels, pairs.alias("x")).select(*labels, "x.le", "x.n")


def counters(events: DataFrame, label: str, value: str | None = None) -> DataFrame:
    return events.groupBy(label).agg((F.sum(value) if value else F.count("*")).alias("total"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queue_depth"))


def exposition(metric: str, samples: DataFrame, label: str, value: str, name: str | None = None) -> DataFrame:
    """One line of text for each sample; name is what the label is called there."""
    return samples.select(F.format_string(f'{metric}{{{name or label}="%s"}} %s', F.col(label).cast("string"), F.col(value).cast("string")).alias("line"))


def escaped(value) -> str:
    """A label's value as it stands between quotes."""
    return str(value).replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')


def bound(le: float) -> str:
    return "+Inf" if le == float("inf") else repr(float(le))


def lines(metric: str, help_text: str, series: list[tuple[dict, list[tuple[float, int]], float, int]]) -> list[str]:
    """Text lines of a histogram: its meaning and type, then for each (labels, buckets, sum, count) its buckets, sum and count."""
    out = [f"# HELP {metric} {help_text}", f"# TYPE {metric} histogram"]
    for labels, buckets, total, n in series:
        own = "".join(f'{k}="{escaped(v)}",' for k, v in labels.items())
        out += [f'{metric}_bucket{{{own}le="{bound(b)}"}} {k}' for b, k in buckets]
        plain = f"{{{own[:-1]}}}" if own else ""
        out += [f"{metric}_sum{plain} {total}", f"{metric}_count{plain} {n}"]
    return out


def histogram_text(values: DataFrame, metric: str, value: str, bounds, label: str, help_text: str) -> DataFrame:
    """(label value, place, line): the lines of a histogram for each value of a label, with HELP and TYPE before all of them (label null)."""
    bounds = [*map(float, bounds), float("inf")]
    held = values.where(F.col(value).isNotNull()).withColumn("_l", F.coalesce(F.col(label).cast("string"), F.lit("")))
    sums = held.groupBy("_l").agg(*(F.count_if(F.col(value) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)), F.sum(F.col(value).cast("decimal(18,6)")).alias("sum"), F.count("*").alias("n"))
    own = F.concat(F.lit(f'{label}="'), F.replace(F.replace(F.replace("_l", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    made = [F.concat(F.lit(f"{metric}_bucket{{"), own, F.lit(f',le="{bound(b)}"}} '), F.col(f"b{i}").cast("string")) for i, b in enumerate(bounds)]
    made += [F.concat(F.lit(f"{metric}_{kind}{{"), own, F.lit("} "), F.col(c).cast("string")) for kind, c in (("sum", "sum"), ("count", "n"))]
    each = sums.select(F.col("_l").alias("label"), F.posexplode(F.array(*made)).alias("place", "line"))
    head = values.sparkSession.createDataFrame([(None, 0, f"# HELP {metric} {help_text}"), (None, 1, f"# TYPE {metric} histogram")], "label string, place int, line string")
    return head.unionByName(each)
