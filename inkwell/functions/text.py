"""Column helpers over texts: all built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = ("path", "chunk_index")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def words_array(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def present(x: Column | str, terms: Sequence[str]) -> Column:
    """The terms that occur in x, in the listed order."""
    return F.filter(words_array(terms), lambda t: F.contains(col(x), t))


def any_of(x: Column | str, terms: Sequence[str]) -> Column:
    return F.exists(words_array(terms), lambda t: F.contains(col(x), t))


def sentences(x: Column | str, delimiters: str) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(col(x), delimiters), trimmed), lambda s: s != "")


def run_tokens(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(x), F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), 1))


def occurrences(x: Column | str, term: Column | str) -> Column:
    """Non-overlapping occurrences of a term."""
    t = F.lit(term) if isinstance(term, str) else term
    return ((F.length(col(x)) - F.length(F.replace(col(x), t, F.lit("")))) / F.length(t)).cast("long")


def positions(x: Column | str, term: str) -> Column:
    """1-based places of the non-overlapping occurrences."""
    parts = F.split(col(x), re.escape(term) if not re.search(r"[^\x00-\x7f]", term) else term, -1)
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length)
    step = F.aggregate(lengths, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")), lambda a, n: F.struct((a["at"] + n + len(term)).alias("at"), F.concat(a["found"], F.array(a["at"] + n)).alias("found")))
    return F.when(F.size(parts) > 1, step["found"]).otherwise(F.array().cast("array<int>"))


def snippet(x: Column | str, term: Column, width: int = 18, marked: bool = False) -> Column:
    """width characters on either side of the first occurrence; without one, the first 60. marked: [term], whatever the case of A-Z, and ... where text is cut."""
    fold = lambda y: F.translate(y, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # noqa: E731  keeps every letter's place
    c, at = col(x), F.instr(fold(col(x)), fold(term)) if marked else F.instr(col(x), term)
    start = F.greatest(F.lit(1), at - width)
    end = F.least(F.length(c), at + F.length(term) - 1 + width)
    if not marked:
        return F.when(at == 0, F.substring(c, 1, 60)).otherwise(F.substring(c, start, end - start + 1))
    hit = F.concat(F.substring(c, start, at - start), F.lit("["), F.substring(c, at, F.length(term)), F.lit("]"), F.substring(c, at + F.length(term), end - at - F.length(term) + 1))
    return F.when(at == 0, F.substring(c, 1, 60)).otherwise(F.concat(F.when(start > 1, "...").otherwise(""), hit, F.when(end < F.length(c), "...").otherwise("")))


def near_text(x: Column | str, term: str, at: Column, width: int = 10) -> Column:
    """width characters on either side of the term at this place, without the term."""
    c = col(x)
    return F.concat(F.substring(c, F.greatest(F.lit(1), at - width), F.least(F.lit(width), at - 1)), F.substring(c, at + len(term), F.lit(width)))


def pieces(x: Column | str, run: str) -> Column:
    """2- and 3-letter pieces of the runs in x, distinct."""
    cut = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(col(x), F.lit(run), 1), lambda r: F.concat(cut(r, 2), cut(r, 3)))))


def zh_number(x: Column | str) -> Column:
    """Value of a Chinese numeral up to thousands; null with any other character."""
    digits = F.create_map(*[v for i, d in enumerate("零一二三四五六七八九") for v in (F.lit(d), F.lit(i))], F.lit("两"), F.lit(2))
    units = F.create_map(F.lit("十"), F.lit(10), F.lit("百"), F.lit(100), F.lit("千"), F.lit(1000))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))
    step = lambda a, ch: F.when(digits[ch].isNotNull(), F.struct(a["total"].alias("total"), digits[ch].cast("long").alias("now"))).otherwise(F.struct((a["total"] + F.when(a["now"] == 0, 1).otherwise(a["now"]) * units[ch]).cast("long").alias("total"), F.lit(0).cast("long").alias("now")))
    return F.when(col(x).rlike("^[零一二三四五六七八九两十百千]+$"), F.aggregate(F.split(col(x), ""), zero, step, lambda a: a["total"] + a["now"]))
