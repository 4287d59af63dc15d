"""Identifiers and numbers of cells against what the document's own pages say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import html_grid as hg
from paperloom.functions import text as tx
from paperloom.settings import DEFAULTS, Settings
from paperloom.sources.scratch import Scratch


def read(pages: DataFrame, *more: str) -> DataFrame:
    """pages(doc_id, page, text, more) as (doc_id, page, more, ids, raws, filled): their identifiers and numbers, and whether they say anything."""
    return pages.select("doc_id", "page", *more, tx.identifiers("text").alias("ids"), tx.check_numbers("text").alias("raws"), tx.spoken("text").alias("filled"))


def _read(pages: DataFrame) -> DataFrame:
    return pages if "raws" in pages.columns else read(pages)


def vocabulary(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocab_identifier(doc_id, token), vocab_number(doc_id, signature, canonical)) of pages(doc_id, page, text), or of what read makes of them.

    A signature is a number's digits, 3 or more; canonical is its spelling where the document has only one.
    """
    pages = _read(pages)
    tokens = pages.select("doc_id", F.explode("ids").alias("token")).distinct()
    spelled = pages.select("doc_id", F.explode(F.transform("raws", tx.cell_number)).alias("raw")).select("doc_id", F.explode(F.array(tx.number_digits("raw"))).alias("signature"), "raw").where("length(signature) >= 3")
    numbers = spelled.groupBy("doc_id", "signature").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return tokens, numbers.select("doc_id", "signature", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("canonical"))


#: Edits up to which near identifiers are found by what is left of both after as many deletions.
INDEXED = 2
#: A document's tokens meet all its known ones, up to LISTED in one list, where that is at most PAIRED comparisons for each of both.
PAIRED, LISTED = 64, 4096


def _deletions(x: Column, edits: int) -> Column:
    """All texts that x becomes by leaving out at most `edits` of its characters."""
    fewer = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    out = F.array(x)
    for _ in range(edits):
        out = tx.let(out, lambda known: F.array_distinct(F.concat(known, F.flatten(F.transform(known, fewer)))))
    return out


def _best(scored: DataFrame) -> DataFrame:
    """(doc_id, token, known, score, second): the two best of the candidates of each token, by a fold and not a sort of all."""
    at = F.struct((-F.col("score")).alias("order"), "known")
    first = scored.groupBy("doc_id", "token").agg(F.min(at).alias("a"))
    rest = scored.join(first, ["doc_id", "token"]).where(F.col("known") != F.col("a.known")).groupBy("doc_id", "token").agg(F.max("score").alias("second"))
    return first.join(rest, ["doc_id", "token"], "left").select("doc_id", "token", F.col("a.known").alias("known"), (-F.col("a.order")).alias("score"), "second")


def _listed(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """What _best gives, of tokens that meet all known ones of their document in one list."""
    lists = known.groupBy("doc_id").agg(F.collect_list("known").alias("all"))
    pairs = asked.join(lists, "doc_id").select("doc_id", "token", F.explode("all").alias("known"))
    scored = pairs.withColumn("order", F.levenshtein("token", "known") / F.greatest(F.length("token"), F.length("known")) - 1).where(-F.col("order") >= F.lit(least))
    # one shuffle by documents, then everything where it is
    top = scored.groupBy("doc_id", "token").agg(F.slice(F.sort_array(F.collect_list(F.struct("order", "known"))), 1, 2).alias("top"))
    return top.select("doc_id", "token", F.col("top")[0]["known"].alias("known"), (-F.col("top")[0]["order"]).alias("score"), (-F.get("top", F.lit(1))["order"]).alias("second"))


def nearest(tokens: DataFrame, vocab: DataFrame, settings: Settings = DEFAULTS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, token, match, score, second) for each token, match null where none is near enough or two are.

    In small documents every token meets every known one: that is less than an index would hold.
    In the others an inverted index answers first: the texts that a token and a known one become by
    leaving out at most INDEXED characters meet in an equal one exactly if they are so
    near. A token is done if nothing that the index does not hold could be its match or
    a runner-up that matters. Only the others, mostly those without any near
    neighbour, are compared with the known ones of their document, length by length, and with
    a bounded distance. score is null where nothing reaches the similarity of a possible runner-up; a second
    below that is left out.
    """
    least = settings.identifier_similarity - settings.identifier_margin
    scratch = scratch or Scratch(tokens.sparkSession, "nearest")  # what is asked, found and open is read more than once
    whole = scratch.keep(tokens.select("doc_id", "token").distinct(), "asked")
    words = vocab.select("doc_id", F.col("token").alias("known")).distinct()
    sizes = whole.groupBy("doc_id").agg(F.count("*").alias("a")).join(words.groupBy("doc_id").agg(F.count("*").alias("k")), "doc_id")
    sizes = scratch.keep(sizes.select("doc_id", ((F.col("a") * F.col("k") <= PAIRED * (F.col("a") + F.col("k"))) & (F.col("k") <= LISTED)).alias("small")), "sizes")
    of = lambda df, small: df.join(sizes.where("small" if small else "NOT small").select("doc_id"), "doc_id")
    asked, known = of(whole, False), of(words, False)
    # a deletion is a row more, which Spark's sizes do not count: never broadcast these
    index = lambda df, c: df.withColumn("left", F.explode(F.transform(_deletions(F.col(c), INDEXED), lambda v: F.xxhash64(v)))).hint("merge")
    pairs = index(asked, "token").join(index(known, "known"), ["doc_id", "left"]).select("doc_id", "token", "known").distinct()
    longest = F.greatest(F.length("token"), F.length("known"))
    near = pairs.withColumn("edits", F.levenshtein("token", "known", INDEXED)).where("edits >= 0").withColumn("score", 1 - F.col("edits") / longest)
    found = scratch.keep(_best(near.where(F.col("score") >= F.lit(least))), "near")
    unseen = 1 - (INDEXED + 1) / (F.length("token") + (INDEXED + 1))  # the most that a known text beyond the index can reach
    done = (F.col("score") - unseen >= settings.identifier_margin) | (unseen < least)
    settled = found.where(done)
    open_ = asked.join(settled.select("doc_id", "token"), ["doc_id", "token"], "left_anti").where(unseen >= least)
    open_ = scratch.keep(open_, "open")
    shortest, farthest = F.ceil(F.length("token") * F.lit(least)), F.floor(F.length("token") / F.lit(least))
    by_length = open_.withColumn("n", F.explode(F.sequence(shortest.cast("int"), farthest.cast("int"))))
    every = by_length.hint("merge").join(known.withColumn("n", F.length("known")), ["doc_id", "n"])
    bound = F.floor((1 - F.lit(least)) * longest + 1e-9).cast("int")
    every = every.withColumn("edits", F.levenshtein("token", "known")).where(F.col("edits") <= bound).withColumn("score", 1 - F.col("edits") / longest)
    best = settled.unionByName(_listed(of(whole, True), of(words, True), least))
    if open_.limit(1).count():
        best = best.unionByName(_best(every.where(F.col("score") >= F.lit(least)).select("doc_id", "token", "known", "score")))
    good = (F.col("score") >= settings.identifier_similarity) & (F.col("score") - F.coalesce("second", F.lit(-1.0)) >= settings.identifier_margin)
    return whole.join(best, ["doc_id", "token"], "left").select("doc_id", "token", F.when(good, F.col("known")).alias("match"), "score", "second")


def reconcile(cells: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells with `text` reconciled, document report, confidence(doc_id, text, confidence)).

    cells(doc_id, ..., text), no key null: unknown identifiers become their nearest neighbour of
    the document or nothing, numbers take the document's only spelling. With a
    scratch, what several results hang on is written there once.
    """
    keep = scratch.keep if scratch is not None else lambda df, name: df
    keys = [c for c in cells.columns if c != "text"]
    words, numbers = (keep(df, f"vocabulary_{i}") for i, df in enumerate(vocabulary(pages)))
    spoken = words.select("doc_id").union(numbers.where("canonical IS NOT NULL").select("doc_id")).distinct().withColumn("grounded", F.lit(True))
    base = cells.join(spoken, "doc_id", "left").withColumn("ids", F.when(F.col("grounded") & F.lit(settings.ground_identifiers), tx.identifiers("text")).otherwise(F.array().cast("array<string>")))
    found = base.select(*keys, F.explode("ids").alias("token")).join(words.withColumn("kept", F.lit(True)), ["doc_id", "token"], "left")
    near = nearest(found.where("kept IS NULL").select("doc_id", "token"), words, settings, scratch)
    judged = keep(found.join(near, ["doc_id", "token"], "left"), "judged")
    change = F.when(F.col("kept").isNull(), F.struct((-F.length("token")).alias("order"), F.col("token").alias("old"), F.coalesce("match", F.lit("")).alias("new")))
    edits = judged.groupBy(*keys).agg(F.array_sort(F.collect_list(change)).alias("edits"))
    fixed = base.join(edits, keys, "left").drop("ids").withColumn("fixed", F.when(F.col("edits").isNull(), F.col("text")).otherwise(tx.replace_all("text", "edits")))

    between = F.split("fixed", tx.CELL_NUMBER, -1)
    parts = keep(fixed.select(*keys, "grounded", "fixed"), "fixed").select(*keys, "grounded", between.alias("between"), F.regexp_extract_all("fixed", F.lit(tx.CELL_NUMBER), 0).alias("raws"))
    each = parts.select(*keys, "grounded", F.posexplode("raws").alias("i", "raw")).withColumn("signature", tx.digits("raw")).join(numbers.withColumn("seen", F.lit(True)), ["doc_id", "signature"], "left")
    each = each.withColumn("normal", F.col("grounded") & F.col("canonical").isNotNull() & (F.col("canonical") != F.col("raw")))
    each = each.withColumn("loose", F.coalesce(F.col("grounded"), F.lit(False)) & ~F.coalesce("normal", F.lit(False)) & (F.length("signature") >= 3) & F.col("seen").isNull())
    said = F.when(F.col("normal"), F.col("canonical")).when(F.col("loose") & F.lit(settings.ground_numbers), F.lit("")).otherwise(F.col("raw"))
    spelled = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", said.alias("said")))), lambda s: s["said"]).alias("said"))
    rebuilt = parts.join(spelled, keys, "left")
    text = F.array_join(F.flatten(F.zip_with("between", F.coalesce("said", F.array().cast("array<string>")), lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    out = rebuilt.select(*keys, text.alias("text"))

    ids = judged.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count_if(F.col("kept").isNull() & F.col("match").isNotNull()).alias("repaired"), F.count_if(F.col("kept").isNull() & F.col("match").isNull()).alias("blanked"))
    nums = each.groupBy("doc_id").agg(F.count_if("normal").alias("normalised"), F.count_if("loose").alias("ungrounded"))
    report = cells.select("doc_id").distinct().join(ids, "doc_id", "left").join(nums, "doc_id", "left").na.fill(0)
    report = report.withColumn("grounded_rate", F.coalesce(F.try_divide(F.col("kept") + F.col("repaired"), F.col("kept") + F.col("repaired") + F.col("blanked")), F.lit(1.0)))
    confidence = judged.where("kept OR match IS NOT NULL").select("doc_id", F.coalesce("match", "token").alias("text"), F.when(F.col("kept"), 1.0).otherwise(F.round("score", 3)).alias("confidence")).distinct()
    return out, report, confidence


def reconcile_grids(grids: DataFrame, words: DataFrame, numbers: DataFrame, settings: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grids with grounded texts, document report, confidence(doc_id, text, confidence)), by the rules of reconcile.

    grids(doc_id, fragment_id, …, grid), words and numbers as vocabulary makes them. Only identifiers and numbers of three
    digits or more travel, with their fragment; what is to change comes back to the fragments, which are written anew only
    where anything changes: ids first (fragments), then numbers of what that left (numbered).
    """
    key = ["doc_id", "fragment_id"]
    spoken = words.select("doc_id").union(numbers.where("canonical IS NOT NULL").select("doc_id")).distinct()
    cells = tx.let(hg.said("grid"), lambda said: F.when(F.array_join(said, "\n").rlike(tx.IDENTIFIER), F.flatten(F.transform(said, tx.identifiers))))
    met = grids.where(F.lit(settings.ground_identifiers)).select(*key, F.explode(cells).alias("token")).join(spoken, "doc_id", "left_semi")
    found = scratch.keep(met.join(words.withColumn("kept", F.lit(True)), ["doc_id", "token"], "left"), "found")
    near = nearest(found.where("kept IS NULL").select("doc_id", "token"), words, settings, scratch)
    judged = scratch.keep(found.join(near, ["doc_id", "token"], "left"), "judged")
    scratch.drop("found", "asked", "sizes", "near", "open")
    lost = judged.where("kept IS NULL")
    if lost.limit(1).count():
        changes = lost.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct((-F.length("token")).alias("order"), F.col("token").alias("old"), F.coalesce("match", F.lit("")).alias("new")))).alias("edits"))
        own = lambda x: tx.let(tx.identifiers(x), lambda ids: tx.replace_all(x, F.filter("edits", lambda e: F.array_contains(ids, e["old"]))))
        grids = scratch.keep(_rewritten(grids, changes, lambda x: F.when(x.rlike(tx.IDENTIFIER), own(x)).otherwise(x)), "fragments")
        scratch.drop("grids")

    # told apart from their digits before they are filtered, so that digits are taken once
    raws = F.transform(tx.check_numbers(F.array_join(hg.said("grid"), "\n")), lambda x: tx.let(tx.cell_number(x), lambda raw: F.struct(raw.alias("raw"), tx.number_digits(raw).alias("signature"))))
    each = grids.select(*key, F.explode(raws).alias("x")).select(*key, "x.*").where("length(signature) >= 3").join(numbers.withColumn("seen", F.lit(True)), ["doc_id", "signature"], "left")
    odd = each.where("seen IS NULL OR canonical <> raw").join(spoken, "doc_id", "left_semi").select(*key, "raw", "canonical")
    odd = scratch.keep(odd, "odd")
    said = F.coalesce("canonical", F.lit("")) if settings.ground_numbers else F.col("canonical")
    changes = odd.withColumn("said", said).where("said IS NOT NULL")
    if changes.limit(1).count():
        changes = changes.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("raw", "said"))).alias("edits"))
        between = lambda x: F.split(x, tx.CELL_NUMBER, -1)
        other = lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(F.try_element_at("edits", b), b, F.lit("")))
        grids = scratch.keep(_rewritten(grids, changes, lambda x: F.array_join(F.flatten(F.zip_with(between(x), F.regexp_extract_all(x, F.lit(tx.CELL_NUMBER), 0), other)), "")), "numbered")
        scratch.drop("grids", "fragments")

    ids = judged.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count_if(F.col("kept").isNull() & F.col("match").isNotNull()).alias("repaired"), F.count_if(F.col("kept").isNull() & F.col("match").isNull()).alias("blanked"))
    nums = odd.groupBy("doc_id").agg(F.count("canonical").alias("normalised"), F.count_if(F.col("canonical").isNull()).alias("ungrounded"))
    report = grids.where(F.size("grid.rows") > 0).select("doc_id").distinct().join(ids, "doc_id", "left").join(nums, "doc_id", "left").na.fill(0)
    report = report.withColumn("grounded_rate", F.coalesce(F.try_divide(F.col("kept") + F.col("repaired"), F.col("kept") + F.col("repaired") + F.col("blanked")), F.lit(1.0)))
    confidence = judged.where("kept OR match IS NOT NULL").select("doc_id", F.coalesce("match", "token").alias("text"), F.when(F.col("kept"), 1.0).otherwise(F.round("score", 3)).alias("confidence")).distinct()
    report, confidence = scratch.keep(report, "report"), scratch.keep(confidence, "confidence")
    scratch.drop("judged", "odd")
    return grids, report, confidence


def _rewritten(grids: DataFrame, changes: DataFrame, use) -> DataFrame:
    """grids with use(text) for the texts of those that `edits` of changes(doc_id, fragment_id, edits) are for."""
    out = grids.join(changes, ["doc_id", "fragment_id"], "left")
    return out.withColumn("grid", F.when(F.col("edits").isNull(), F.col("grid")).otherwise(hg.rewritten("grid", use))).drop("edits")


#: Identifiers up to this length are found by postings, with so much text around a posting to verify them; longer ones in the whole text.
NEAR = 64
#: Characters of a posting's key.
GRAM = 5


def _turn(x: Column) -> Column:
    """Characters before the first change between digits and others."""
    return F.length(F.regexp_extract(x, r"^([0-9]+|[^0-9]+)", 1))


def postings(pages: DataFrame) -> DataFrame:
    """(doc_id, turn, gram, left, right): where the squeezed text of pages(doc_id, page, text) changes between digits and other identifier characters.

    A page is read on into those after it, so that what crosses a page break has its
    postings too. gram are GRAM characters that hold the change `turn` characters behind their start;
    left and right are the NEAR characters before and behind the change.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "s").rowsBetween(1, NEAR - 1)
    spoken = pages.select("doc_id", "page", tx.canon("text").alias("s")).where("s <> ''")
    ahead = F.substring(F.array_join(F.collect_list(F.substring("s", 1, NEAR)).over(order), ""), 1, NEAR - 1)
    runs = spoken.withColumn("s", F.concat("s", ahead)).select("doc_id", F.explode(F.regexp_extract_all("s", F.lit(f"[A-Z0-9-]{{{GRAM},}}"), 0)).alias("run")).where(F.col("run").rlike("[0-9]") & F.col("run").rlike("[^0-9]"))
    digit = lambda i: F.substring("run", i, F.lit(1)).between("0", "9")
    turns = runs.select("doc_id", "run", F.explode(F.filter(F.sequence(F.lit(2), F.length("run")), lambda i: digit(i) != digit(i - 1))).alias("i"))
    around = turns.select("doc_id", "run", "i", F.substring("run", F.greatest(F.col("i") - NEAR, F.lit(1)), F.least(F.col("i") - 1, F.lit(NEAR))).alias("left"), F.substring("run", F.col("i"), F.lit(NEAR)).alias("right"), F.explode(F.array(*map(F.lit, range(1, GRAM)))).alias("turn"))
    start = F.col("i") - F.col("turn")
    return around.where((start >= 1) & (start + GRAM - 1 <= F.length("run"))).select("doc_id", "turn", F.substring("run", start, F.lit(GRAM)).alias("gram"), "left", "right")


def contained(ids: DataFrame, pages: DataFrame) -> DataFrame:
    """The (doc_id, value) of ids whose value stands somewhere in the text of the document's pages without white space.

    ids are identifiers as tx.identifiers finds them: GRAM characters or more, digits and others.
    """
    code = tx.canon("value")
    keyed = ids.select("doc_id", "value", code.alias("code"), _turn(code).alias("p"))
    start = F.least(F.col("p") - 1, F.length("code") - GRAM)
    keyed = keyed.where(F.length("code") <= NEAR).withColumn("turn", F.col("p") - start).withColumn("gram", F.substring("code", start + 1, F.lit(GRAM)))
    asked = pages.join(keyed.select("doc_id").distinct(), "doc_id", "left_semi")  # nothing is sought in the others
    met = keyed.join(postings(asked), ["doc_id", "turn", "gram"])
    found = met.where(F.endswith("left", F.substring("code", F.lit(1), F.col("p"))) & F.startswith("right", F.substring("code", F.col("p") + 1, F.length("code")))).select("doc_id", "value").distinct()
    long = ids.where(F.length(code) > NEAR)
    whole = pages.join(long.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), " ").alias("source"))
    return found.unionByName(long.join(whole, "doc_id").where(F.contains(tx.canon("source"), code)).select("doc_id", "value"))


def verbatim(fragments: DataFrame, pages: DataFrame, said: DataFrame | None = None, scratch: Scratch | None = None, listed: bool = True) -> DataFrame:
    """(doc_id, checked, grounded, ungrounded_identifiers, ungrounded_numbers, score) of fragments(doc_id, text).

    Identifiers, each once, must stand in the pages' text without white space;
    numbers, each time, must equal one of the pages' numbers. A document whose pages
    say nothing is not checked: its score is 1. said: what read makes of the pages, where that is known. What stands as an
    identifier of its own on a page needs no search; with a scratch, the others are only searched for if there are any.
    Unless listed, ungrounded numbers are counted and not listed, which needs no join.
    """
    said = read(pages) if said is None else said
    kind = lambda name, x: F.struct(F.lit(name).alias("kind"), x.alias("key"))
    known = said.select("doc_id", F.explode(F.concat(F.transform("ids", lambda x: kind("i", x)), F.transform("raws", lambda x: kind("n", tx.check_canon(x))))).alias("x")).select("doc_id", "x.*")
    item = lambda name, key, x: F.struct(F.lit(name).alias("kind"), key.alias("key"), x.alias("value"))
    items = F.concat(F.transform(tx.identifiers("text"), lambda x: item("i", x, x)), F.transform(tx.check_numbers("text"), lambda x: item("n", tx.check_canon(x), x)))
    asked = fragments.select("doc_id", F.explode(items).alias("x")).select("doc_id", "x.*").where("kind = 'i' OR length(key) >= 3")
    known = known.where("kind = 'i' OR length(key) >= 3").withColumn("there", F.lit(True))
    if listed:
        # the same rows of a document meet before they are counted: identifiers count once, numbers each time
        met = asked.repartition("doc_id", "kind", "key").groupBy("doc_id", "kind", "key", "value").agg(F.count("*").alias("n")).join(known.distinct(), ["doc_id", "kind", "key"], "left")
    else:
        both = asked.select("doc_id", "kind", "key", F.lit(1).alias("times"), F.lit(False).alias("there")).unionByName(known.withColumn("times", F.lit(0)))
        met = both.groupBy("doc_id", "kind", "key").agg(F.sum("times").alias("n"), F.max("there").alias("any")).where("n > 0")
        met = met.select("doc_id", "kind", "key", F.when(F.col("kind") == "i", F.col("key")).alias("value"), "n", F.when(F.col("any"), True).alias("there"))
    n, bad = F.when(F.col("kind") == "i", F.lit(1)).otherwise(F.col("n")), F.col("there").isNull()
    again = F.flatten(F.collect_list(F.when(bad & (F.col("kind") == "n"), F.array_repeat("value", F.col("n").cast("int")))))
    checks = met.groupBy("doc_id").agg(
        F.sum(n).alias("checked"), F.coalesce(F.sum(F.when(~bad, n)), F.lit(0)).alias("grounded"),
        F.array_sort(F.collect_list(F.when(bad & (F.col("kind") == "i"), F.col("value")))).alias("ungrounded_identifiers"), F.array_sort(again).alias("ungrounded_numbers"),
    )
    checks = checks.join(said.where("filled").select("doc_id").distinct(), "doc_id", "left_semi")
    checks = checks if scratch is None else scratch.keep(checks, "checks")
    sought = checks.select("doc_id", F.explode("ungrounded_identifiers").alias("value"))
    if scratch is None or sought.limit(1).count():
        there = contained(sought, pages).groupBy("doc_id").agg(F.collect_set("value").alias("there"))
        rest = F.array_except("ungrounded_identifiers", F.coalesce("there", F.array().cast("array<string>")))
        checks = checks.join(there, "doc_id", "left").withColumn("grounded", F.col("grounded") + F.coalesce(F.size("there"), F.lit(0))).withColumn("ungrounded_identifiers", rest).drop("there")
    none = F.array().cast("array<string>")
    return fragments.select("doc_id").distinct().join(checks, "doc_id", "left").select(
        "doc_id", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("grounded", F.lit(0)).alias("grounded"), F.coalesce("ungrounded_identifiers", none).alias("ungrounded_identifiers"),
        F.coalesce("ungrounded_numbers", none).alias("ungrounded_numbers"), F.coalesce(F.try_divide("grounded", "checked"), F.lit(1.0)).alias("score"),
    )
