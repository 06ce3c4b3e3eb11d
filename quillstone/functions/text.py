"""Text functions as Column expressions: white space and line rules, and the seven text features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import TEXT_FEATURES

#: Line breaks besides \n that split a text into lines.
BREAKS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\u0085  ]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often `then` names it: what is written once stays one expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Unicode's white space, as (?U)\s has it.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def tidy(c: Column) -> Column:
    """As collapse; most texts need no change and are only looked at. For columns and bound values, since c is named three times."""
    return F.when(c.rlike(r"(?U)[\s&&[^ ]]|  "), collapse(c)).otherwise(c)


def has_any(c: Column, terms) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t))
    return found


def split_lines(c: Column) -> Column:
    """The lines of a text; a break at its end begins no further line, and an empty text has none."""
    return F.split(F.regexp_replace(F.regexp_replace(c, BREAKS, "\n"), r"\n\z", ""), "\n", -1)


def count_class(c: Column, cls: str) -> Column:
    return F.regexp_count(c, F.lit(cls)).cast("double")


def text_features(c: Column) -> Column:
    """Struct of text_length, line_count, digit_ratio, alpha_ratio, special_ratio, avg_line_length, empty_line_ratio; zeros for blank text."""

    def of(lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(r"(?U)\S"))
        n, m = F.size(lines).cast("double"), F.size(full).cast("double")
        return F.struct(m.alias("line_count"), F.aggregate(full, F.lit(0), lambda acc, x: acc + F.char_length(x)).cast("double").alias("chars"), ((n - m) / n).alias("empty"))

    total, digits, letters, plain = F.char_length(c).cast("double"), count_class(c, r"\p{Nd}"), count_class(c, r"\p{L}"), count_class(c, "[ \n]")
    counts = F.struct(total.alias("total"), digits.alias("digits"), letters.alias("letters"), plain.alias("plain"), let(split_lines(c), of).alias("l"))

    def ratios(k: Column) -> Column:
        t, one = k["total"], k["l"]
        values = (t, one["line_count"], k["digits"] / t, k["letters"] / t, (t - k["digits"] - k["letters"] - k["plain"]) / t, one["chars"] / one["line_count"], one["empty"])
        return F.struct(*[v.alias(n) for n, v in zip(TEXT_FEATURES, values, strict=True)])

    zeros = F.struct(*[F.lit(0.0).alias(n) for n in TEXT_FEATURES])
    return F.when(F.coalesce(c, F.lit("")).rlike(r"(?U)\S"), let(counts, ratios)).otherwise(zeros)


def normalized_for_match(c: Column) -> Column:
    """Lower case, only 0-9 and a-z, null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^0-9a-z]+", ""), F.lit(""))


def join_phrases(parts: Column) -> Column:
    """'a', 'a, and b' or 'a, b, and c'."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(parts, F.lit(0))).otherwise(F.concat(head, F.lit(", and "), F.element_at(parts, -1)))
