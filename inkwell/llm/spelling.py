"""12. Spelling variants: words that differ by one edit, found by asymmetric q-chunks.

Of each two words one is cut into two disjoint chunks (its halves), the other gives all its positional grams of those lengths. One
inserted, deleted or replaced letter spoils one chunk at most, so the other one stands in the other word, at its own place or one
before it: the longer word gives the chunks (of two equally long ones the lesser), so a gram lies as far left as a letter was
taken out before it. Chunk and gram meet by an equality join on (gram, place, length of the other word); what meets is verified
by its edit distance. Pairs are rows of the vocabulary, not of the corpus, and a word has about as many grams as letters.

A word's form is its most frequent near word, if that is frequent enough beside it; forms lead on to more frequent forms, so they
make trees, whose roots are found by doubling: log2 of the longest way at most, and a way is no longer than log2 of the largest
count. All steps are DataFrame functions; words are counted within a task before they are shuffled.

Rows: null and empty texts have no words. A null key counts as the empty string. Repeated rows count as often as they come. Texts
may have any length. Only the named columns are read, others may have any name. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters and occurrences of a word, at least; a form has so many times the word's occurrences at least.
LENGTH, LEAST, TIMES = 5, 3, 2
#: One run in so many loses a letter (typing errors, planted by rule).
EVERY = 97


def runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(key, run) of the maximal runs of letters of this length at least, A-Z lower-cased."""
    found = F.regexp_extract_all(docs[text], F.lit(f"({RUN}{{{length},}})"), 1)
    each = docs.select(docs[key].alias("key"), F.explode(found).alias("run"))
    return each.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))


def with_errors(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """(word): the runs; one in `every`, by the crc32 of `key:run`, lacks a letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return rows.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, *, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of words of this length that occur this often."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def chunks(words: DataFrame) -> DataFrame:
    """(gram, at, size, word, n): both halves of each word, where they stand in a word of its own length and in one that lacks a letter of the other half."""
    size, half = F.length("word"), _half(F.length("word"))
    first, last = F.substring("word", F.lit(1), half), F.substring(F.col("word"), half + 1, size)
    row = lambda gram, at, n: F.struct(gram.alias("gram"), at.alias("at"), n.alias("size"))
    every = F.array(row(first, F.lit(0), size), row(first, F.lit(0), size - 1), row(last, half, size), row(last, half - 1, size - 1))
    return words.select("word", "n", F.explode(every).alias("x")).select("x.*", "word", "n")


def grams(words: DataFrame) -> DataFrame:
    """(gram, at, size, word, n): all positional grams of each word, of the lengths that halves of a word as long or one longer have."""
    size, half = F.length("word"), _half(F.length("word"))
    of = lambda q: F.transform(F.sequence(F.lit(0), size - q), lambda i: F.struct(F.substring(F.col("word"), i + 1, q).alias("gram"), i.alias("at")))
    return words.select("word", "n", F.explode(F.concat(of(half), of(half + 1))).alias("x")).select("x.*", size.alias("size"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): all two words of (word, n) that differ by one inserted, deleted or replaced letter, once each."""
    x = chunks(words).select("gram", "at", "size", F.col("word").alias("a"), F.col("n").alias("na"))
    y = grams(words).select("gram", "at", "size", F.col("word").alias("b"), F.col("n").alias("nb"))
    met = x.join(y, ["gram", "at", "size"]).where((F.length("a") > F.length("b")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("x"))
    made = words.join(best, "word", "left")
    good = -F.col("x.m") >= F.lit(times) * F.col("n")
    return made.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("x.other")).alias("form"), F.when(good, -F.col("x.m")).alias("form_n"))


def with_roots(made: DataFrame) -> DataFrame:
    """made (word, form, ..) with root: the last word that forms lead to; the word itself if it has none."""
    up = written(made.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(up.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return made.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, *, text: str = "text", key: str = "doc_id", every: int = EVERY, length: int = LENGTH, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts."""
    words = written(vocabulary(with_errors(runs(docs, text=text, key=key, length=length), every), length=length, least=least), "vocabulary")
    made = written(forms(words, near_pairs(words), times), "forms")
    return with_roots(made).select("word", "form", "root", "n", "n_near", "form_n")
