"""Golden values of amounts, dates and text features, and random ones against plain Python."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.config import DATE_FORMATS
from quillstone.functions import amounts, dates
from quillstone.functions.text import join_phrases, split_lines, strip, text_features

AMOUNTS = {
    "RM 123,45": "123.45", "1.234,56": "1234.56", "1,234.56": "1234.56", ".5": "0.50", "1.234": "1234.00", "1,234,567": "1234567.00", "1,234,56": "1234.56",
    "10.00 20.00": "100020.00", "RM": None, "1-2": None, "": None, "-": None, "-4.5": "-4.50", "+7,1": "7.10", "$ 1 200": "1200.00", "12.": "12.00",
}
DATES = {
    "Jan 24, 2024": "2024-01-24", "2024/01/24": "2024-01-24", "01/24/24": "2024-01-24", "03/04/2024": "2024-04-03", "11/12/24": "2024-12-11", "13/01/2024": "2024-01-13", "01/13/2024": "2024-01-13",
    "31/02/2024": None, "September 3, 2024": None, "Sept 3, 2024": "2024-09-03", "1/2/68": "2068-02-01", "1/2/69": "1969-02-01", "1-2/2024": None, "24 January 2024": "2024-01-24", "May 5 2023": "2023-05-05",
    "29.02.2023": None, "29.02.2024": "2024-02-29", "1/2/0024": "2024-02-01", "1/2/024": None, "Jan. 24, 2024": None, "": None,
}


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expr(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)] if not rows or not hasattr(rows[0].y, "asDict") else [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_amounts(spark):
    assert column(spark, list(AMOUNTS), amounts.normalize_token) == list(AMOUNTS.values())


def test_amount_tokens(spark):
    found = spark.createDataFrame([(0, "Qty 7"), (1, "Total 10"), (2, "Total 7.5"), (3, "10.00 20.00")], "i int, x string").select("i", amounts.amount_tokens(F.col("x")).alias("y")).orderBy("i").collect()
    assert [len(r.y) for r in found] == [0, 1, 1, 1]


def test_dates(spark):
    assert column(spark, list(DATES), lambda c: dates.normalize_date(c)["iso"]) == list(DATES.values())


def by_strptime(value):
    cleaned = re.sub(r"\s+", " ", value.strip().rstrip(".")).replace("Sept", "Sep")
    order = list(DATE_FORMATS)
    if m := re.fullmatch(r"(\d{1,2})[-/](\d{1,2})[-/]\d{2,4}", cleaned):
        if int(m[1]) <= 12 and int(m[2]) <= 12:
            order = [f for f in order if f.startswith("%d")] + order
    for f in order:
        try:
            d = datetime.strptime(cleaned, f)
        except ValueError:
            continue
        return (d if d.year >= 100 else d.replace(year=d.year + (2000 if d.year < 70 else 1900))).strftime("%Y-%m-%d")
    return None


def test_random_dates_agree_with_strptime(spark):
    r = random.Random(3)
    made = [f"{r.randint(0, 33)}{r.choice('-/.')}{r.randint(0, 14)}{r.choice('-/.')}{r.choice(['99', '07', '2021', '1999', '321'])}" for _ in range(300)]
    made += [f"{r.choice(['Jan', 'feb', 'May', 'Octo', 'December', 'sept'])} {r.randint(0, 33)}{r.choice(['', ','])} {r.choice(['24', '2024'])}" for _ in range(100)]
    assert column(spark, made, lambda c: dates.normalize_date(c)["iso"]) == [by_strptime(x) for x in made]


def test_formats(spark):
    got = column(spark, ["2024-01-24", "03/04/2024", "13/04/2024", "May 5, 2023", "5 January 24", "x"], dates.detect_format)
    assert got == ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%b %d, %Y", "%d %B %y", None]


@pytest.mark.parametrize("text", ["", " \n ", "a\nb\n", "Total 10.00\n\n x\t", "a\r\nb\x0bc", "ä1 ß\n", "\n\n", "x\n\n\ny\n\n"])
def test_text_features(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(text_features(F.col("t")).alias("f")).first().f
    if not text.strip():
        assert set(got) == {0.0}
        return
    lines = text.splitlines()
    full = [x for x in lines if x.strip()]
    digits, letters = sum(c.isdigit() for c in text), sum(c.isalpha() for c in text)
    want = (len(text), len(full), digits / len(text), letters / len(text), (len(text) - digits - letters - text.count(" ") - text.count("\n")) / len(text), sum(map(len, full)) / len(full), (len(lines) - len(full)) / len(lines))
    assert list(got) == pytest.approx(want)


def test_strip_and_lines(spark):
    assert column(spark, ["  a b\t\n", ""], strip) == ["a b", ""]
    assert spark.createDataFrame([("a\r\nb c\n",)], "t string").select(split_lines(F.col("t")).alias("x")).first().x == ["a", "b", "c"]


def test_phrases(spark):
    rows = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],)], "p array<string>").select(join_phrases(F.col("p")).alias("x")).collect()
    assert [r.x for r in rows] == ["a", "a, and b", "a, b, and c"]
