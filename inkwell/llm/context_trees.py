"""4. LM scoring by context-tree weighting over bytes.

A text is its bytes with A-Z lower-cased, then one end symbol (byte FF, which UTF-8 never holds). Each byte is eight binary
decisions; each decision has a tree of contexts, the last 0 to `depth` bytes (FF before a text's start). In every node the
training bits a, b give the Krichevsky-Trofimov estimate Pe(a, b); nodes above the full depth weigh it against the product of
their children: Pw = (Pe + product of the children's Pw) / 2. The learned tree then predicts each bit by the mixture of the
estimates of all depths on its context's path, weighted by the tree's posterior. A text's score is the log10 of the product,
and -score / log10(2) / bytes its code length in bits per byte.

In Spark: one scan counts the (depth+1)-byte strings of all texts and the words of the training texts (merged within tasks,
summed by key). Trees whose contexts end in the same two bytes are built together, in tasks that hold those strings only;
what lies above depth 2 is at most 65,280 nodes and is built from sums over the tasks' roots. The result is a table
string -> log10 probability of its last byte. A second scan scores the texts against it, in blocks of at most `block`
entries that are broadcast one after the other, so what a worker holds is bounded however large the tables get.

Strings unseen in training are in the table too (with count 0), so held-out texts are scored exactly.

Rows: a null text is empty: it has the end token and end symbol only. A null id counts as the empty string. Repeated rows count
as often as they stand. If nothing is there to learn from, every bit has probability 1/2. Empty tables give no rows. Only the
named columns are read. Words are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Packed, Rolling, bounded_batches, letters, packed, word_bounds, written

DEPTH = 5
#: Entries in one broadcast: 16 bytes each.
BLOCK = 6_000_000
#: Entries that a counting task merges before it sends them on.
HELD = 2_000_000
STEP = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
END = 0xFF


def strings(texts: Packed, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(the depth+1 bytes that end at each symbol, as an integer; its text). The end symbol follows each text."""
    size = texts.ends - texts.starts
    n, total = texts.n, len(texts.data)
    buffer = np.full(total + depth * (n + 1), END, np.uint8)
    doc = np.repeat(np.arange(n), size)
    buffer[np.arange(total) + depth * (doc + 1)] = LOWER[texts.data]
    x = np.zeros(len(buffer) - depth, np.uint64)
    for i in range(depth + 1):
        x = (x << np.uint64(8)) | buffer[i : len(buffer) - depth + i]
    # x[j] ends at buffer position j + depth; text d's symbols end at its bytes and at the end symbol after them
    first = texts.starts + depth * np.arange(n)
    counts = size + 1
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total + n)
    return x[at], np.repeat(np.arange(n), counts)


def words_of(texts: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, its text)."""
    low = Packed(LOWER[texts.data], np.append(texts.starts, texts.ends[-1:]))
    starts, ends = word_bounds(low, IS_WORD)
    return Rolling(letters(low.data)).slices(starts, ends).view(np.int64), low.of_positions(starts)


class Sums:
    """Counts by key, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> None:
        """weights: 0 or 1 for each key; None for all 1."""
        if weights is None or weights.all():
            self.parts.append(np.unique(keys, return_counts=True))
        else:
            on = weights.astype(bool)
            self.parts += [np.unique(keys[on], return_counts=True), ((off := np.unique(keys[~on])), np.zeros(len(off), np.int64))]
        self.size += sum(len(p[0]) for p in self.parts[-2:])
        if self.size > HELD // 2:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys = np.concatenate([p[0] for p in self.parts])
            counts = np.concatenate([p[1] for p in self.parts])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.parts = [(keys[at], np.add.reduceat(counts, at))]
        self.size = sum(len(p[0]) for p in self.parts)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


def counted(docs: DataFrame, train: Column, depth: int) -> DataFrame:
    """(word boolean, key, n): training counts of words (word true), and of the byte strings of all texts."""
    schema = pa.schema([("word", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])

    def sent(word: bool, sums: Sums) -> Iterator[pa.RecordBatch]:
        keys, counts = sums.taken()
        for i in range(0, len(keys), 200_000):
            k = keys[i : i + 200_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), word)), pa.array(k), pa.array(counts[i : i + 200_000])], schema=schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = {False: Sums(), True: Sums()}
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, texts in packed(batch.column(0), STEP):
                on = learn[row : row + texts.n]
                keys, doc = strings(texts, depth)
                both[False].add(keys, on[doc])
                words, doc = words_of(texts)
                both[True].add(words[on[doc]])
            for kind, sums in both.items():
                if sums.size > HELD:
                    yield from sent(kind, sums)
        for kind, sums in both.items():
            yield from sent(kind, sums)

    rows = docs.select("text", train.alias("learn")).mapInArrow(step, "word boolean, key long, n long")
    return rows.groupBy("word", "key").agg(F.sum("n").alias("n"))


# ---- the trees --------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series above 8."""
    x = x.astype(float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - 2 * log_gamma(np.array([0.5])) - log_gamma(a + b + 1.0)


class Level:
    """The nodes of one depth: key = context << 8 | the bits of the next byte so far, with a 1 before them."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        """below: ln of the product of the children's Pw, None at full depth."""
        self.keys, self.a, self.b = keys, a, b
        pe = log_kt(a, b)
        self.pw = pe if below is None else np.logaddexp(pe, below) - np.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.exp(pe - np.log(2) - self.pw)
        self.one = (b + 0.5) / (a + b + 1.0)


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, inverse = np.unique(keys, return_inverse=True)
    return (found, *(np.bincount(inverse, v, len(found)) for v in values))


def upper_key(keys: np.ndarray, depth: int) -> np.ndarray:
    """Of the nodes one depth up, at `depth`."""
    return (keys >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | keys & np.uint64(255)


def levels(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[Level]:
    """From full depth up to top; grams: depth+1 bytes, n: their training counts."""
    ctx, byte = grams >> np.uint64(8), grams & np.uint64(255)
    keys, zeros, ones = [], [], []
    for k in range(8):
        bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
        keys.append(ctx << np.uint64(8) | np.uint64(1 << k) | byte >> np.uint64(8 - k))
        zeros.append(n * (bit == 0))
        ones.append(n * (bit == 1))
    out = [Level(*grouped(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)), None)]
    for d in range(depth - 1, top - 1, -1):
        x = out[-1]
        out.append(Level(*grouped(upper_key(x.keys, d), x.a, x.b, x.pw)))
    return out


def bits_of(grams: np.ndarray, p_one: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """log10 probability of each string's last byte, from the nodes' probability of a one."""
    ctx, byte = grams >> np.uint64(8), grams & np.uint64(255)
    total = np.zeros(len(grams))
    for k in range(8):
        bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
        at = np.searchsorted(keys, ctx << np.uint64(8) | np.uint64(1 << k) | byte >> np.uint64(8 - k))
        total += np.log10(np.where(bit == 1, p_one[at], 1 - p_one[at]))
    return total


TOP = 2


def model(grams: DataFrame, depth: int) -> DataFrame:
    """(key, score): log10 probability of the last byte of each string. grams: (key, n)."""
    spark = grams.sparkSession
    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    dealt = grams.withColumn("near", near).repartition("near").select("key", "n")

    def whole(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        parts = list(frames)
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0)
        x = pd.concat(parts)
        return x["key"].to_numpy(np.int64).view(np.uint64), x["n"].to_numpy(float)

    def roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n = whole(frames)
        if len(keys):
            x = levels(keys, n, depth, TOP)[-1]
            yield pd.DataFrame({"key": upper_key(x.keys, 1).view(np.int64), "a": x.a, "b": x.b, "below": x.pw}).groupby("key", as_index=False).sum()

    sums = dealt.mapInPandas(roots, "key long, a double, b double, below double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below"))
    # at most 256 contexts of one byte with 255 nodes each
    pdf = sums.toPandas().sort_values("key")
    one = Level(pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["below"].to_numpy())
    zero = Level(*grouped(upper_key(one.keys, 0), one.a, one.b, one.pw))
    up = np.searchsorted(zero.keys, upper_key(one.keys, 0))
    done = (zero.stop * zero.one)[up] + (1 - zero.stop)[up] * one.stop * one.one
    left = (1 - zero.stop)[up] * (1 - one.stop)
    shared = spark.sparkContext.broadcast((one.keys, done, left))

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n = whole(frames)
        if not len(keys):
            return
        above, done, left = shared.value
        for d, x in zip(range(TOP, depth + 1), reversed(levels(keys, n, depth, TOP)), strict=True):
            up = np.searchsorted(above, upper_key(x.keys, d - 1))
            done, left, above = done[up] + left[up] * x.stop * x.one, left[up] * (1 - x.stop), x.keys
        made = bits_of(keys, done, above)
        for i in range(0, len(keys), 100_000):
            yield pd.DataFrame({"key": keys[i : i + 100_000].view(np.int64), "score": made[i : i + 100_000]})

    return dealt.mapInPandas(scores, "key long, score double")


# ---- scoring ----------------------------------------------------------------------------------


def _blocks(table: DataFrame, value: str, kind, block: int) -> Iterator:
    """The table in broadcasts of sorted keys and values, at most block entries each (dealt by hash)."""
    spark = table.sparkSession
    n = max(1, -(-table.count() // block))
    for b in range(n):
        part = table if n == 1 else table.where(F.pmod(F.xxhash64("key"), F.lit(n)) == b)
        rows = part.select("key", value).toArrow()
        keys = rows.column(0).to_numpy()
        order = np.argsort(keys)
        yield spark.sparkContext.broadcast((keys[order], rows.column(1).to_numpy()[order].astype(kind)))


def looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether found), 0 where a key isn't there."""
    known, values = table
    if not len(known) or not len(keys):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    codes, some = pd.factorize(keys)
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    hit = known[at] == some
    return np.where(hit, values[at], 0)[codes], hit[codes]


def _scan(docs: DataFrame, key: str, grams, words, depth: int, ends: int, base: float) -> DataFrame:
    """Adds what one pair of blocks gives to the columns so far: score, known tokens, sum of log10(c + 1)."""
    out = T.StructType([docs.schema[key], docs.schema["text"], *(T.StructField(n, k()) for n, k in (("n_bytes", T.LongType), ("n_tokens", T.LongType), ("n_known", T.LongType), ("logs", T.DoubleType), ("score", T.DoubleType)))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in packed(batch.column(1)):
                n = texts.n
                had = [batch.column(i).slice(row, n).to_numpy() for i in (4, 5, 6)]
                score, known, logs = had[2].copy(), had[0].copy(), had[1].copy()
                words_, doc = words_of(texts)
                n_tokens = np.bincount(doc, minlength=n) + 1
                if words is not None:
                    c, hit = looked_up(words_, words.value)
                    known += np.bincount(doc, hit, n).astype(np.int64)
                    logs += np.bincount(doc, np.log10(c + 1), n)
                if grams is not None:
                    x, doc = strings(texts, depth)
                    score += np.bincount(doc, looked_up(x.view(np.int64), grams.value)[0], n)
                size = texts.ends - texts.starts
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(size, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(score, pa.float64())], names=out.names)

    return docs.mapInArrow(step, out)


def scored(docs: DataFrame, train: Column, *, key: str = "doc_id", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(key, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of each row; train: a condition on the row.

    base_score: add-one unigram model over the words and one end token per text.
    """
    from itertools import zip_longest

    bounded_batches(docs.sparkSession)
    counts = written(counted(docs, train, depth), "counts")
    grams, words = counts.where("NOT word").select("key", "n"), counts.where("word").select("key", "n")
    ends = docs.where(train).count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums.n + ends, sums.v + (ends > 0)
    base = float(np.log10(total + distinct + 1))
    table = written(model(grams, depth), "model")
    start = docs.select(key, F.col("text"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("logs"), F.lit(0.0).alias("score"))
    first = True
    for g, w in zip_longest(_blocks(table, "score", np.float64, block), _blocks(words, "n", np.float64, block)):
        if not first:  # a task holds one pair of blocks, so what one scan has summed is written before the next
            start = written(start, "scores")
        start, first = _scan(start, key, g, w, depth, ends, base), False
    held = F.coalesce(~train, F.lit(True))
    return start.select(
        key, held.alias("held_out"), "n_bytes", "n_tokens", (F.col("n_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 1)) - F.col("n_tokens") * base).alias("base_score"), "score",
    )
