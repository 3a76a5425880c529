"""Column expressions that the operators share; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def desc(c: str | Column) -> Column:
    """Descending with nulls first: null ranks as the largest value, both ways."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens; a text without any gets its short hash."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", short_hash(c)).otherwise(s)


def slug_unicode(c: Column) -> Column:
    """The same, keeping letters and digits of any script."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def short_hash(c: Column, digits: int = 10) -> Column:
    return F.substring(F.sha1(c), 1, digits)


def strip_markdown(c: Column) -> Column:
    """Without emphasis and code marks; links become their label."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[`*_]", ""), r"\[(.*?)\]\((.*?)\)", "$1"))


def clean_text(c: Column) -> Column:
    """Markdown marks gone, white space folded."""
    return F.trim(F.regexp_replace(strip_markdown(c), r"\s+", " "))


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def preview(c: Column, limit: int = 360, mark: str = "…") -> Column:
    """The text if it fits, else its start and a mark, ``limit`` characters in all."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - len(mark))), F.lit(mark)))


def sentences(c: Column) -> Column:
    """Pieces that end after ``.``, ``!`` or ``?`` where white space follows; none is empty."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def pack(pieces: Column, limit: int = 900) -> Column:
    """Greedy packing: pieces are joined by a space while the result fits; a longer piece stays whole."""
    fits = lambda acc, s: F.when((acc["now"] != "") & (F.length(acc["now"]) + 1 + F.length(s) > limit), True).otherwise(False)
    return F.aggregate(
        pieces,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")),
        lambda acc, s: F.when(fits(acc, s), F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), s.alias("now"))).otherwise(
            F.struct(acc["done"].alias("done"), F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"))
        ),
        lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))),
    )


def split_long(c: Column, limit: int = 900) -> Column:
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(pack(sentences(c), limit))


def fiscal_year(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"(?i)(?:FY)?(20\d{2})", 1), F.lit("")).try_cast("int")


def quarter_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"(?i)Q([1-4])", 1), F.lit("")).try_cast("int")


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any of the plain substrings occurs in the (already lower) text."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def joined(c: Column, sep: str = "|") -> Column:
    """A sorted array as one string; null and empty arrays are ''."""
    return F.coalesce(F.array_join(F.array_sort(c), sep), F.lit(""))


def l2_normalised(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm2 = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm2 == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
