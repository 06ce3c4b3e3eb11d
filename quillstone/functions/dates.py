"""Dates as Column expressions: reading a date in any of 24 formats, checked by arithmetic, day first where both readings fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import DATE_FORMATS, MONTHS
from quillstone.functions.text import collapse, let, strip

YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
NUMERIC = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$"
MONTH_FIRST = r"(?i)^([a-z]+) (\d{1,2})(,?) (\d{4}|\d{2})$"
DAY_FIRST = r"(?i)^(\d{1,2}) ([a-z]+) (\d{4}|\d{2})$"


def clean(c: Column) -> Column:
    return F.replace(collapse(F.regexp_replace(strip(c), r"\.+$", "")), F.lit("Sept"), F.lit("Sep"))


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(c, pattern, k)


def _year(y: Column) -> Column:
    """Two digits turn at 69; four digits below 100 turn at 70, and 0000 is none."""
    return let(F.struct(y.alias("y"), y.try_cast("int").alias("n")), lambda t: _turned(t["y"], t["n"]))


def _turned(y: Column, n: Column) -> Column:
    two = F.when(n < 69, n + 2000).otherwise(n + 1900)
    four = F.when((n > 0) & (n < 70), n + 2000).when((n >= 70) & (n < 100), n + 1900).when(n >= 100, n)
    return F.when(F.char_length(y) == 2, two).otherwise(four)


def _month(name: Column) -> Column:
    names = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, i)], *[F.lit(v) for i, m in enumerate(MONTHS, 1) if m != m[:3] for v in (m[:3], i)])
    return F.try_element_at(names, F.lower(name))


def iso(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd if that day exists, else null."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    fine = (month >= 1) & (month <= 12) & (day >= 1) & (day <= last)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(fine, F.concat(pad(year, 4), F.lit("-"), pad(month, 2), F.lit("-"), pad(day, 2)))


def _parts(x: Column) -> Column:
    """Struct of kind (Y year first, N numeric, M month's name first, D day first), separator or comma, first and second number, name, year's text."""
    num = lambda p, k: _part(x, p, k).try_cast("int")

    def of(kind: str, sep: Column, a: Column, b: Column, name: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), sep.alias("sep"), a.alias("a"), b.alias("b"), name.alias("name"), y.alias("y"))

    no, none = F.lit(None).cast("int"), F.lit(None).cast("string")
    return (
        F.when(x.rlike(YEAR_FIRST), of("Y", _part(x, YEAR_FIRST, 2), num(YEAR_FIRST, 3), num(YEAR_FIRST, 4), none, _part(x, YEAR_FIRST, 1)))
        .when(x.rlike(NUMERIC), of("N", _part(x, NUMERIC, 2), num(NUMERIC, 1), num(NUMERIC, 3), none, _part(x, NUMERIC, 4)))
        .when(x.rlike(MONTH_FIRST), of("M", _part(x, MONTH_FIRST, 3), num(MONTH_FIRST, 2), no, _part(x, MONTH_FIRST, 1), _part(x, MONTH_FIRST, 4)))
        .when(x.rlike(DAY_FIRST), of("D", F.lit(""), num(DAY_FIRST, 1), no, _part(x, DAY_FIRST, 2), _part(x, DAY_FIRST, 3)))
    )


def normalize_date(c: Column) -> Column:
    """Struct of iso (null if no format fits) and ambiguous: whether day and month could change places."""

    def read(p: Column) -> Column:
        y, a, b = _year(p["y"]), p["a"], p["b"]
        both = (p["kind"] == "N") & (p["sep"] != ".") & (a <= 12) & (b <= 12)
        day_first = (p["sep"] == ".") | both
        one = lambda m, d: let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), lambda t: iso(t["y"], t["m"], t["d"]))
        value = (
            F.when(p["kind"] == "Y", one(a, b))
            .when((p["kind"] == "N") & day_first, one(b, a))
            .when(p["kind"] == "N", F.coalesce(one(a, b), one(b, a)))
            .otherwise(one(_month(p["name"]), a))
        )
        return F.struct(value.alias("iso"), F.coalesce(both, F.lit(False)).alias("ambiguous"))

    return let(let(clean(c), _parts), read)


def normalize_or_keep(c: Column) -> Column:
    return F.coalesce(normalize_date(c)["iso"], strip(c))


def detect_format(c: Column) -> Column:
    """The first of the formats that fits, month first before day first; null if none."""

    def read(p: Column) -> Column:
        y = _year(p["y"])
        valid = lambda m, d: iso(y, m, d).isNotNull()
        named = F.struct(_month(p["name"]).alias("m"), y.alias("y"))
        return let(F.struct(p.alias("p"), F.char_length(p["y"]).alias("n"), valid(p["a"], p["b"]).alias("ab"), valid(p["b"], p["a"]).alias("ba"), let(named, lambda t: iso(t["y"], t["m"], p["a"]).isNotNull()).alias("named")), _match)

    return let(let(clean(c), _parts), read)


def _match(t: Column) -> Column:
    p, out = t["p"], F.lit(None).cast("string")
    for f in reversed(DATE_FORMATS):
        if f[1] == "Y":
            fits = (p["kind"] == "Y") & (p["sep"] == f[2]) & t["ab"]
        elif f[2] in "/-.":
            fits = (p["kind"] == "N") & (p["sep"] == f[2]) & (t["n"] == (4 if f.endswith("Y") else 2)) & t["ab" if f[1] == "m" else "ba"]
        elif f[1] == "d":
            fits = (p["kind"] == "D") & _form(p["name"], f[4]) & (t["n"] == (4 if f.endswith("Y") else 2)) & t["named"]
        else:
            fits = (p["kind"] == "M") & _form(p["name"], f[1]) & (p["sep"] == ("," if "," in f else "")) & (t["n"] == (4 if f.endswith("Y") else 2)) & t["named"]
        out = F.when(fits, f).otherwise(out)
    return out


def _form(name: Column, kind: str) -> Column:
    """May is both a short name and a full one."""
    return F.char_length(name) == 3 if kind == "b" else (F.char_length(name) > 3) | (F.lower(name) == "may")
