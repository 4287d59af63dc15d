from pyspark.sql import functions as F

from paperloom.operators import merge
from paperloom.plans import extraction
from paperloom.sources import readings

HEAD = "<tr><th>Lot</th><th>Stage</th><th>Fee</th></tr>"
VISION = "doc_id long, page int, idx int, html string"
PAGES = "doc_id long, page int, text string"


def lines(*rows):
    return "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows)


def captioned(caption, *rows):
    return f"<table><thead><tr><th colspan='3'>{caption}</th></tr>{HEAD}</thead><tbody>{lines(*rows)}</tbody></table>"


def body(first):
    return [(f"{first}{i}", "ready", f"{i}0.5{i}") for i in range(1, 5)]


def test_captions_keep_tables_apart_and_survive_a_merge(spark):
    vision = [
        (1, 1, 0, captioned("Northern yard levies", *body("N"))), (1, 2, 0, captioned("Harbour dues, winter", *body("H"))),
        (2, 1, 0, captioned("Northern yard levies", *body("N"))), (2, 2, 0, captioned("Northern yard levies", *body("M"))), (2, 3, 0, f"<table><thead>{HEAD}</thead><tbody>{lines(*body('L'))}</tbody></table>"),
    ]
    pages = spark.createDataFrame([(d, p, "x") for d, p, *_ in vision], PAGES)
    r = extraction.extract(pages, spark.createDataFrame([], readings.OCR_TABLE), spark.createDataFrame(vision, VISION))
    got = sorted((t.doc_id, t.title, t.pages, t.n_rows) for t in r.tables.collect())
    assert got == [(1, "Harbour dues, winter", [2], 4), (1, "Northern yard levies", [1], 4), (2, "Northern yard levies", [1, 2, 3], 12)]
    assert [t["header_rows"][0][0] for t in r.tables.where("doc_id = 2").collect()] == ["Northern yard levies"]


def test_the_log_of_pairs_says_why(spark):
    grids = [(1, "p0001_0", 1, captioned("Alpha", *body("a")), None), (1, "p0002_0", 2, captioned("Omega end", *body("b")), None), (1, "p0003_0", 3, captioned("x", *body("c")), "Omega end")]
    f = spark.createDataFrame(grids, "doc_id long, fragment_id string, page int, html string, title string").withColumn("grid", merge.hg.grid_of("html"))
    assert [(r.a, r.b, r.reason) for r in merge.pairs(f).orderBy("a").collect()] == [("p0001_0", "p0002_0", "caption conflict"), ("p0002_0", "p0003_0", None)]


def test_ocr_tables_count_where_vision_did_not_cover_the_page(spark):
    plain = lambda first: f"<table><thead>{HEAD}</thead><tbody>{lines(*body(first))}</tbody></table>"
    pages = spark.createDataFrame([(1, p, "word " * 9) for p in (1, 2, 3, 5)], PAGES)
    ocr = spark.createDataFrame([(1, i, plain(f"o{p}"), [p], 4, 3) for i, p in enumerate((1, 2, 3, 5))] + [(1, 9, plain("small"), [9], 2, 3)], readings.OCR_TABLE)
    vision = spark.createDataFrame([(1, 1, 0, plain("v1"))], VISION)
    failed = spark.createDataFrame([(1, 3)], "doc_id long, page int")
    r = extraction.extract(pages, ocr, vision, failed=failed)
    assert {(x.page) for x in r.plan.collect()} == {1, 2, 3, 5}
    shown = {tuple(t.merged_from): t.suppressed for t in r.tables.collect()}
    assert shown == {("p0001_0",): False, ("o0003_2",): False, ("o0009_9",): False}  # pages 2 and 5 were read: there is no table
    s = r.summary.first()
    assert (s.failed_pages, s.partial, s.pages, s.pages_routed, s.routed_ratio) == ([3], True, 4, 4, 1.0)


def test_review_flags_come_from_cells(spark):
    rows = [(str(i), "Yes" if i % 2 else "No", f"{i}.234", "12.50") for i in range(1, 8)]
    odd = [("8", "perhaps", "8.234", "12.50")]
    head = "<tr><th>n</th><th>open</th><th>dose</th><th>fee</th></tr>"
    table = lambda rows: f"<table><thead>{head}</thead><tbody>{lines(*rows)}</tbody></table>"
    many = [(str(i), "Yes", "1,5", f"{i}.50" if i < 200 else "9.9.9,9") for i in range(260)]
    vision = spark.createDataFrame([(1, 1, 0, table(rows)), (2, 1, 0, table(rows + odd)), (3, 1, 0, table(many))], VISION)
    pages = spark.createDataFrame([(d, 1, "x") for d in (1, 2, 3)], PAGES)
    r = extraction.extract(pages, spark.createDataFrame([], readings.OCR_TABLE), vision)
    flags = {x.doc_id: (x.unparsed, x.ambiguous) for x in extraction.review_flags(r).collect()}
    assert flags == {1: (False, True), 2: (True, True), 3: (True, False)}  # an ambiguous column alone is not unparsed; a boolean can be
    assert r.warnings.where("doc_id = 2 AND column = 'open'").count() == 0
    assert r.columns.where(F.col("ambiguous")).select("key").distinct().collect()[0].key == "dose"


def test_a_caption_that_the_pages_do_not_know_goes_from_the_title_too(spark):
    vision = spark.createDataFrame([(1, 1, 0, captioned("Ref QX-99871", *body("N"))), (2, 1, 0, captioned("QX-99871", *body("N"))), (3, 1, 0, captioned("QX-99871", *body("N")))], VISION)
    pages = spark.createDataFrame([(1, 1, "AAA-1111"), (2, 1, "AAA-1111"), (3, 1, "QX-99871")], PAGES)
    r = extraction.extract(pages, spark.createDataFrame([], readings.OCR_TABLE), vision)
    assert {t.doc_id: t.title for t in r.tables.collect()} == {1: "Ref", 2: None, 3: "QX-99871"}
