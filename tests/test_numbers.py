import pytest
from pyspark.sql import functions as F

from paperloom.functions import numbers as nb
from paperloom.functions import text as tx
from paperloom.operators import flatten


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def fmt(spark, values):
    rows = flatten.formats(spark.createDataFrame([(1, v) for v in values], "k int, raw string"), ["k"]).collect()
    return (rows[0].locale, rows[0].ambiguous) if rows else (None, False)


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        (["$ 865.70", "$ 1,029.05", "$ 2,026.68"], ("en", False)),
        ([f"$ {i},100.50" for i in range(1, 21)] + ["$ 1.029.05"], ("en", False)),
        (["$ 1,029.05", "$ -", "-", "N/A"], ("en", False)),
        (["1.234", "5.678", "9.012"], (None, True)),
        (["1.234,56", "9.876,54", "2.500,00"], ("eu", False)),
        (["N/A", "-", "TBC"], (None, False)),
        (["1,234.56"] + ["1.2.3.4"] * 4, (None, False)),
        (["12", "7"], ("en", False)),
    ],
)
def test_number_formats(spark, values, expected):
    assert fmt(spark, values) == expected


def test_values(spark):
    texts = ["$ 1,234.56", "6 249.75", "(5.00)", "-$5", "$ -5", "+5", "1,23", "12.", "$ 1.029.05", "50 %", "", None, "4WD", "-1,000", "5+", "0.00000000001", "9" * 30]
    got = column(spark, texts, nb.parse("x", "en").cast("double"))
    assert got == [1234.56, 6249.75, 5.0, None, -5.0, None, None, None, None, 50.0, None, None, 4.0, -1000.0, None, 1e-11, 1e30]
    assert column(spark, ["1.234,56", "1 234,5", "1'234.5"], nb.parse("x", "eu")) == [1234.56, 1234.5, None]
    assert column(spark, ["1 234,5"], nb.parse("x", "fr")) == [1234.5] and column(spark, ["1'234.5"], nb.parse("x", "ch")) == [1234.5]


def test_repair(spark):
    texts = ["$ 1.300.77", "$ 7,418,52", "$ 3,507,80", "1.234", "1,234", "1.23.456", "12345.6789.01"]
    assert column(spark, texts, nb.repair("x").cast("double")) == [1300.77, 7418.52, 3507.80, None, None, None, None]


def test_literals(spark):
    texts = ["$ 86.40", "1,234.56", "5%", "AUD 12", "Dual Cab Ute - 4WD", "3-6T", "20T Franna", "POA", "", None]
    assert column(spark, texts, nb.is_numeric_literal("x")) == [True] * 4 + [False] * 6
    assert column(spark, ["$ 86.40", "Priced in $ per tonne", "12"], nb.looks_like_money("x")) == [True, False, False]
    assert column(spark, ["US$ 5", "5 CHF", "€ 1", "plain"], nb.currency("x")) == ["AUD", "CHF", "EUR", "AUD"]


def test_text(spark):
    assert column(spark, [["Pile / Driver", "Day", "Day", ""], ["day", "day", "day_2"], ["7", None]], tx.derive_keys("x"), "array<string>") == [["pile_driver", "day", "day_2", "col_3"], ["day", "day_2", "day_2"], ["col_0", "col_1"]]
    assert column(spark, [" a  b\t\n", None], tx.norm_text("x")) == ["a b", ""]
    assert column(spark, ["XQ4400017 and 12345/AB1, HELLO/9 abc"], tx.identifiers("x")) == [["XQ4400017", "12345", "HELLO"]]
    assert column(spark, ["1,000", "93.00", "0.0", "-"], tx.canon_number("x")) == ["1000", "93", "0", "0"]
    assert column(spark, ["unit_price2x"], tx.title_label("x")) == ["Unit Price2X"]
    assert column(spark, ["\n".join(["Item 10"] * 60), "prose " * 40], tx.short_lines("x")) == [60, 0]
    assert column(spark, ["```html\n<b>\n```"], tx.strip_fence("x")) == ["\n<b>\n"]


def test_types(spark):
    def kind(values):
        df = spark.createDataFrame([(v,) for v in values], "raw string")
        return df.agg(flatten.infer_type(F.col("raw")).alias("t")).first().t

    assert [kind(v) for v in (["5%", "7 %"], ["$ 1", "$ 2", "x"], ["12.01.2024", "1/2/24"], ["Yes", "no", ""], ["1", "2"], ["a", "1"], ["", None])] == ["percent", "money", "date", "boolean", "number", "string", "empty"]
