"""3. Benchmark decontamination: a broadcast hash set of the test items' n-grams, scanned over all token windows.

The items' distinct windows are hashed; every block of some `block` of them is broadcast and one scan of the documents finds
them (a larger benchmark takes several scans, each adding to the hits of those before). A window is broadcast once however many
items share it. Hash hits are verified word by word before they count. Documents stream through and are not shuffled; between
two scans the hits so far are a table. Which items the found windows belong to is a join of the two: of the distinct lists of
windows that documents hold with the table of (window, item).

Rows: null texts have no words; items without words have no windows; an item shorter than a window is one window. Repeated
items and repeated documents each count as themselves. A null item_id marks hits, but is listed nowhere. Empty tables give
no hits, or no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Packed, Rolling, bounded_batches, letters, packed, word_bounds, written

#: Windows of the benchmark in one broadcast: some 100 bytes each.
BLOCK = 500_000
WINDOW = 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """The normalised words of some texts and their hashes."""

    def __init__(self, texts: Packed):
        low = Packed(LOWER[texts.data], np.append(texts.starts, texts.ends[-1:]) if texts.n else np.zeros(1, np.int64))
        self.texts, self.data = texts, low.data
        self.starts, self.ends = word_bounds(low, IS_WORD)
        self.hash = Rolling(letters(low.data)).slices(self.starts, self.ends)
        self.doc = low.of_positions(self.starts)
        self.per_doc = np.bincount(self.doc, minlength=texts.n)
        self.rolling = Rolling(self.hash)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all runs of n words inside one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return first, self.rolling.slices(first, first + n)

    def said(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n], strict=True))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n words, hash, words) of the items' distinct windows."""
    out = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("said", T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in packed(batch.column(1)):
                words, rows = Words(texts), []
                ids = batch.column(0).slice(row, texts.n).to_pylist()
                for n in {min(window, int(k)) for k in words.per_doc if k}:
                    first, hashes = words.windows(n)
                    for f, h in zip(first, hashes.view(np.int64), strict=True):
                        if min(window, words.per_doc[words.doc[f]]) == n:
                            rows.append((ids[words.doc[f]], n, int(h), words.said(f, n)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=out.names)

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(step, out).distinct()


class Block:
    """One broadcast: for each window length the sorted hashes and the words themselves."""

    def __init__(self, rows: list):
        self.said: dict[int, set[bytes]] = {}
        by_n: dict[int, set[int]] = {}
        for r in rows:
            by_n.setdefault(r.n, set()).add(r.hash)
            self.said.setdefault(r.n, set()).add(bytes(r.said))
        self.hashes = {n: np.sort(np.array(list(x), np.int64).view(np.uint64)) for n, x in by_n.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, bytes]]:
        """(first word, n, words) of verified windows."""
        for n, known in self.hashes.items():
            first, hashes = words.windows(n)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for f in first[known[at] == hashes]:
                said = words.said(int(f), n)
                if said in self.said[n]:
                    yield int(f), n, said


def _scanned(docs: DataFrame, key: str, block) -> DataFrame:
    """Adds one block's hits to (key, text, words, spans so far, windows so far)."""
    out = T.StructType([docs.schema[key], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("windows", T.ArrayType(T.BinaryType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            had_spans, had_windows = batch.column(3), batch.column(4)
            for row, texts in packed(batch.column(1)):
                words = Words(texts)
                spans = [set(x or ()) for x in had_spans.slice(row, texts.n).to_pylist()]
                windows = [set(x or ()) for x in had_windows.slice(row, texts.n).to_pylist()]
                zero = np.searchsorted(words.doc, np.arange(texts.n))
                for f, n, said in block.value.hits(words):
                    d = words.doc[f]
                    spans[d].update(range(f - zero[d], f - zero[d] + n))
                    windows[d].add(said)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, texts.n), batch.column(1).slice(row, texts.n), pa.array(words.per_doc, pa.int64()), pa.array([sorted(x) for x in spans], pa.list_(pa.int32())), pa.array([sorted(x) for x in windows], pa.list_(pa.binary()))], names=out.names)

    return docs.mapInArrow(step, out)


def _found(docs: DataFrame, windows: DataFrame, key: str, block: int) -> DataFrame:
    """(key, text, n_words, spans, windows) of each row. windows: item_windows()."""
    spark = docs.sparkSession
    bounded_batches(spark)
    distinct = windows.select("n", "hash", "said").distinct().persist()
    blocks = max(1, -(-distinct.count() // block))
    found = docs.select(key, F.col("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<binary>").alias("windows"))
    for b in range(blocks):
        shared = spark.sparkContext.broadcast(Block(distinct.where(F.pmod("hash", F.lit(blocks)) == b).collect()))
        found = _scanned(found, key, shared)
        if b < blocks - 1:  # a task holds one block, so what one scan has found is written before the next
            found = written(found, "hits")
            shared.destroy()
    distinct.unpersist()
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(key, n_words, hit_words: indexes of the words inside found windows, items: ids of the items found, both sorted) of each row."""
    windows = written(item_windows(benchmark, window), "windows")
    found = _found(docs.select(key, "text"), windows, key, block)
    found = written(found.select(key, "n_words", F.col("spans").alias("hit_words"), "windows"), "found")
    none = F.array().cast("array<string>").alias("items")
    hit = found.where(F.size("windows") > 0)
    lists = hit.select("windows").distinct()
    held = lists.select("windows", F.explode("windows").alias("said")).join(windows.where("item_id IS NOT NULL").select("said", "item_id").distinct(), "said")
    items = held.groupBy("windows").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    named = hit.join(items, "windows", "left").select(key, "n_words", "hit_words", F.coalesce("items", none).alias("items"))
    return found.where(F.size("windows") == 0).select(key, "n_words", "hit_words", none).unionByName(named)


def removed(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", window: int = WINDOW, block: int = BLOCK, drop: bool = False) -> DataFrame:
    """docs with the hit words cut out of their texts, from a run's first word to its last (or without the documents hit, if drop).

    All columns stay; a null text stays null. The rest of a text joins with one space where a run stood; words that meet there can
    stand as a window again, as in the text they were apart: that is no hit of the text, and stays.
    """
    names = docs.columns
    packed_rows = docs.select(F.struct(*[docs[c] for c in names if c != "text"]).alias("row"), "text")
    found = _found(packed_rows, written(item_windows(benchmark, window), "windows"), "row", block).withColumnRenamed("spans", "hit_words")
    if drop:
        found = found.where(F.size("hit_words") == 0)
    out = T.StructType([found.schema["row"], T.StructField("text", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, hit in enumerate(batch.column(2).to_pylist()):
                if hit:
                    texts[i] = _without(texts[i], hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=out.names)

    cut = found.select("row", "text", "hit_words").mapInArrow(step, out)
    return cut.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names])


def _without(text: str, hit: list[int]) -> str:
    raw = text.encode()
    words = Words(Packed(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64)))
    at = np.array(hit)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    cuts = [(int(words.starts[r[0]]), int(words.ends[r[-1]])) for r in runs]
    kept = reduce(lambda x, c: ([*x[0], raw[x[1] : c[0]]], c[1]), cuts, ([], 0))
    return b" ".join([*kept[0], raw[kept[1] :]]).decode("utf-8", "replace")
