"""7. Suffix-array dedup by distributed prefix doubling.

Which 400-byte strings start at more than one place? Prefix doubling names (ranks) the strings of a length at all positions,
and ranks pairs of names at growing offsets until a position's string is unique or the threshold is reached. A name here is a
64-bit hash of its string in place of its order number: only equality of names is asked for, and equal strings get equal
names without a global sort. Positions leave as soon as they are unique:

round 1, length 200   Of each 400-byte window only one 200-byte string is named, the one with the least hash (equal windows
                      choose alike), so some 1 % of the positions are sorted. A window whose chosen string is unique is unique.
round 2, offset 185   The other windows are taken sixteen at a time: the 385 bytes that sixteen neighbours share are ranked
                      by the pair of their names at offsets 0 and 185, together with the 15 bytes on either side. If the pair
                      is unique, the sixteen windows are; if pair and sides recur whole, all sixteen recur.
round 3, offset 15    What is left is ranked window by window: by the pair and the side bytes that the window covers.

Texts are compared once per distinct text: copies are found by a 128-bit hash of the whole text, and a text that stands in the
table twice repeats all its windows. Counting is by partial aggregation, joins are by hash; no group is gathered anywhere but
a text's own spans.

Rows: null texts are empty. Texts under 400 bytes have nothing to remove. Repeated rows are copies of each other. Other columns
stay. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FULL, Packed, Rolling, bounded_batches, letters, mixed, packed, written

LENGTH = 400


class Shape:
    """Lengths that follow from the threshold."""

    def __init__(self, length: int):
        self.length = length
        self.group = 16 if length >= 64 else 2
        self.name = length // 2
        self.core = length - self.group + 1  # what the windows of a group share
        self.spread = length - self.name + 1  # named strings in one window


def whole(col: str = "text"):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit("")).cast("binary")))


#: Low bits that hold a position where a string is chosen; the rest is of its name.
PLACE = np.uint64((1 << 28) - 1)


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value in each run of width values, the first of equal ones. Values count by their high 36 bits."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = (x & ~PLACE) | np.arange(len(x), dtype=np.uint64)
    blocks = np.concatenate([x, np.full(-len(x) % width, FULL)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & PLACE).astype(np.int64)


def _chosen(texts: Packed, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, for each the position of its chosen string, names of all positions): windows inside one text only."""
    names = mixed(Rolling(letters(texts.data)).windows(shape.name))
    at = least_in_windows(names, shape.spread)
    inside = np.zeros(len(at), bool)
    for a, b in zip(texts.starts, texts.ends, strict=True):
        inside[a : max(a, b - shape.length + 1)] = True
    windows = np.flatnonzero(inside)
    return windows, at[windows], names


def _names(docs: DataFrame, shape: Shape) -> DataFrame:
    """Round 1: (name, whole, at) of the chosen strings."""
    out = T.StructType([T.StructField("name", T.LongType()), T.StructField("whole", T.BinaryType()), T.StructField("at", T.IntegerType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in packed(batch.column(1)):
                _, at, names = _chosen(texts, shape)
                at = np.unique(at)
                doc = texts.of_positions(at)
                yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), batch.column(0).take(pa.array(row + doc)), pa.array(at - texts.starts[doc], pa.int32())], names=out.names)

    return docs.select("whole", "text").mapInArrow(step, out)


def _groups(docs: DataFrame, shape: Shape) -> DataFrame:
    """Round 2: (n1, n2: the pair, before, after, whole, at) of the groups that hold a window whose chosen string recurs.

    docs: whole, text, found (positions of recurring chosen strings).
    """
    out = T.StructType([*(T.StructField(n, T.LongType()) for n in ("n1", "n2")), *(T.StructField(n, T.BinaryType()) for n in ("before", "after", "whole")), T.StructField("at", T.IntegerType())])
    side, g = shape.group - 1, shape.group

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in packed(batch.column(1)):
                windows, at, names = _chosen(texts, shape)
                recurs = np.zeros(len(texts.data) + 1, bool)
                for start, found in zip(texts.starts, batch.column(2).slice(row, texts.n).to_pylist(), strict=True):
                    recurs[start + np.array(found or [], np.int64)] = True
                some = recurs[at]
                windows, at = windows[some], at[some]
                # group j of a chosen string: windows from at - g*j - (g-1) to at - g*j; they share what starts at the last
                core = np.unique(at - (at - windows) // g * g)
                doc = texts.of_positions(core)
                left = np.maximum(texts.starts[doc], core - side)
                right = np.minimum(texts.ends[doc], core + shape.core + side)
                raw = texts.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[core].view(np.int64)), pa.array(names[core + shape.core - shape.name].view(np.int64)),
                        pa.array([raw[a:b] for a, b in zip(left, core, strict=True)], pa.binary()), pa.array([raw[a:b] for a, b in zip(core + shape.core, right, strict=True)], pa.binary()),
                        batch.column(0).take(pa.array(row + doc)), pa.array(core - texts.starts[doc], pa.int32()),
                    ], names=out.names)

    return docs.select("whole", "text", "found").mapInArrow(step, out)


def spans(docs: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(whole, n copies of the text, starts: sorted starts of recurring windows or of whole runs as (from, to) pairs) of texts with such windows.

    Each pair (a, b) means: all windows that start at a, a+1, ..., b recur.
    """
    shape = Shape(length)
    texts = docs.select(whole(text).alias("whole"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    copies = texts.groupBy("whole").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")).where("n > 1")
    # a name recurs if it stands at two places of different texts, or at two of one: copies of a text share their places
    named = _names(texts, shape)
    again = named.select("name", F.xxhash64("whole", "at").alias("place")).groupBy("name").agg(F.min("place").alias("p"), F.max("place").alias("q")).where("p < q").select("name")
    again = written(again, "names")  # a table of its own, so that the join with a hot name's rows can be split
    found = named.join(again, "name").groupBy("whole").agg(F.collect_set("at").alias("found"))
    once = texts.groupBy("whole").agg(F.first("text").alias("text")).join(found, "whole")
    groups = written(_groups(once, shape), "groups")
    # groups of one pair and one pair of sides: one row, with how many there are
    kinds = groups.groupBy("n1", "n2", "before", "after").agg(F.count("*").alias("c"), F.min(F.struct("whole", "at")).alias("one"))
    pairs = kinds.groupBy("n1", "n2").agg(F.count("*").alias("kinds"))
    kinds = written(kinds.join(pairs, ["n1", "n2"]).where("c > 1 OR kinds > 1"), "kinds")
    return_all = kinds.where("c > 1").select("n1", "n2", "before", "after")
    side, g = shape.group - 1, shape.group
    n_windows = "greatest(0, least({g} - 1, length(before)) - greatest(0, {g} - 1 - length(after)) + 1)".format(g=g)
    # window i starts i bytes before the core: it needs i bytes before and side - i after
    whole_runs = groups.join(return_all, ["n1", "n2", "before", "after"]).where(f"{n_windows} > 0").select("whole", (F.col("at") - F.least(F.lit(side), F.length("before"))).alias("a"), (F.col("at") - F.greatest(F.lit(0), F.lit(side) - F.length("after"))).alias("b"))
    single = kinds.where("kinds > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side)))).where(f"i <= length(before) AND {side} - i <= length(after)")
    single = single.select("n1", "n2", "i", F.expr("substring(before, length(before) - i + 1, i)").alias("l"), F.expr(f"substring(after, 1, {side} - i)").alias("r"), "one", "c")
    keys = ["n1", "n2", "i", "l", "r"]
    twice = single.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    left_runs = single.where("c = 1").join(twice, keys).select(F.col("one.whole").alias("whole"), (F.col("one.at") - F.col("i")).alias("a"), (F.col("one.at") - F.col("i")).alias("b"))
    full_runs = copies.select("whole", F.lit(0).alias("a"), (F.col("bytes") - length).cast("int").alias("b"))
    runs = whole_runs.unionByName(left_runs).unionByName(full_runs)
    return runs.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def cut(docs: DataFrame, *, text: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """docs with kept (binary: the bytes left; as text: without characters that a cut halves), n_bytes, n_removed, n_spans in place of their text."""
    names = [c for c in docs.columns if c != text]
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text].alias("text"))
    bounded_batches(docs.sparkSession)
    found = written(spans(docs, text=text, length=length), "spans")
    joined = row.withColumn("whole", whole()).join(found, "whole", "left").select("row", "text", "runs")
    out = T.StructType([joined.schema["row"], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [_cut((t or "").encode(), r, length) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0].decode("utf-8", "ignore") if as_text else m[0] for m in made], pa.string() if as_text else pa.binary()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2, 3))], names=out.names)

    done = joined.mapInArrow(step, out)
    return done.select(*[F.col("row")[c].alias(c) for c in names if c not in ("kept", "n_bytes", "n_removed", "n_spans")], "kept", "n_bytes", "n_removed", "n_spans")


def _cut(raw: bytes, runs: list[dict] | None, length: int) -> tuple[bytes, int, int, int]:
    kept, last, start, spans_made = [], 0, -1, 0
    end = -1
    for r in runs or ():
        a, b = r["a"], r["b"] + length
        if a > end:
            if end >= 0:
                kept.append(raw[last:start])
                last, spans_made = end, spans_made + 1
            start, end = a, b
        else:
            end = max(end, b)
    if end >= 0:
        kept.append(raw[last:start])
        last, spans_made = end, spans_made + 1
    kept.append(raw[last:])
    left = b"".join(kept)
    return left, len(raw), len(raw) - len(left), spans_made


def without_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut from their texts; characters that a cut halves go too. All rows and columns stay, null texts too."""
    marked = docs.withColumn("__null", F.col("text").isNull())
    done = cut(marked, length=length, as_text=True)
    kept = F.when(~F.col("__null"), F.col("kept"))
    return done.select(*[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns])
