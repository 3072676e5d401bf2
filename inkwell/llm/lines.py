"""13. Line dedup: lines that stand in many documents stay in one of them; two Bloom filters keep all other lines from the shuffle.

1. Each document gives a 64-bit hash per distinct key (its lines, stripped and lower-cased, if long enough). They are written, and
   their number sets the filters' size.
2. Two Bloom filters, for hashes seen once and seen twice, are built in pieces of 65,536 bits. A task sends the bits of its hashes,
   two bytes each; a piece's bits meet in one place, one task after the other: a bit that is in the first filter already goes
   into the second. So no task holds a whole filter, and none sorts lines.
3. The second filter is broadcast: at most `most_bits`, whatever the corpus. Where more bits are wanted (more than
   most_bits / BITS keys), hashes are dealt into that many shares and each share has filters, and a pass over the texts, of its own.
4. Lines that the second filter may hold are suspected repeats. Only they are shuffled, as SHA-256 digests of their keys: documents
   are counted exactly, and the holder (the largest document id) is chosen.
5. Suspected lines meet their key's verdict (a common key's join can be split), and the numbers of lines to drop are gathered per
   document. A Bloom filter of these documents, broadcast if it is no larger than most_bits (else all texts are taken for
   such), parts the texts: all others stay as they are, where they are; these meet their list by a join.

A filter never misses a repeat, and a false suspicion costs a row of the shuffle but changes nothing.

Rows: null and empty texts are one empty line. Rows with one id are one document: a key that only they hold is in one document,
and all of them keep it if their id is the largest. A null id is a document, less than all others. Texts may have any length.
Only the named columns are read, others may have any name. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, mixed, packed, written

#: Characters of a key, and documents that hold it, at least.
LENGTH, LEAST = 20, 3
#: Bits of a filter for each key, and of the broadcast filter at most.
BITS, MOST_BITS = 16, 1 << 30
#: Bits of a piece: places in it take two bytes.
PIECE = 1 << 16
#: Hashes that a task sorts at a time.
HELD = 1 << 20


def keys(text: bytes, length: int = LENGTH) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key has so many characters."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACES).lower()  # of bytes: only A-Z change
        if len(key) >= length and (len(key) >= 4 * length or len(key.decode("utf-8", "replace")) >= length):
            out.append((i, key))
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    for _, texts in packed(column):
        for a, b in zip(texts.starts, texts.ends, strict=True):
            yield texts.data[a:b].tobytes()


def hashes(docs: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(n, h: n hashes of 8 bytes): of each document's distinct keys, many documents in a row."""
    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("h", T.BinaryType())])

    def rows(parts: list[set[int]]) -> pa.RecordBatch:
        h = np.fromiter((x for p in parts for x in p), np.uint64, sum(map(len, parts)))
        return pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())], names=out.names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for body in _texts(batch.column(0)):
                some = {xxhash.xxh3_64_intdigest(k) for _, k in keys(body, length)}
                parts.append(some)
                n += len(some)
                if n >= HELD // 16:
                    yield rows(parts)
                    parts, n = [], 0
        if n:
            yield rows(parts)

    return docs.select(docs[text]).mapInArrow(step, out)


def places(h: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first bit, second bit) of each hash; the bits differ."""
    x = mixed(h)
    first = (x & np.uint64(PIECE - 1)).astype(np.int64)
    step = (x >> np.uint64(16) & np.uint64(PIECE - 1)).astype(np.int64) % (PIECE - 1)
    return ((x >> np.uint64(32)) % np.uint64(pieces)).astype(np.int64), first, (first + 1 + step) % PIECE


def _share(h: np.ndarray, share: int, shares: int) -> np.ndarray:
    return h[h % np.uint64(shares) == np.uint64(share)] if shares > 1 else h


def twice_filter(table: DataFrame, pieces: int, share: int = 0, shares: int = 1, least: int = 2) -> np.ndarray:
    """The bits, PIECE * pieces of them, as bytes, of the filter of what is seen so often (1 or 2 times) at least. table: hashes()."""
    sent = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])

    def bits(h: np.ndarray) -> pa.RecordBatch:
        piece, a, b = places(h, pieces)
        at, n = np.unique(np.concatenate([piece * PIECE + a, piece * PIECE + b]), return_counts=True)
        of, first = np.unique(at // PIECE, return_index=True)
        cut = lambda mask: [x[m].tobytes() for x, m in zip(np.split((at % PIECE).astype(np.uint16), first[1:]), np.split(mask, first[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(cut(n == 1), pa.binary()), pa.array(cut(n > 1), pa.binary())], names=sent.names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for x in batch.column(0):
                h = _share(np.frombuffer(x.as_buffer(), np.uint64), share, shares)
                held.append(h)
                n += len(h)
                if n >= HELD:
                    yield bits(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield bits(np.concatenate(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by piece; one piece's two filters are held at a time."""
        now, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice if least > 1 else once).tobytes()], pa.binary())], names=["piece", "bits"])
        for batch in batches:
            for piece, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if piece != now:
                    if now is not None:
                        yield done()
                    now, once, twice = piece, np.zeros(PIECE, bool), np.zeros(PIECE, bool)
                a, b = np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(b.as_buffer(), np.uint16)
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
                once[b] = True
        if now is not None:
            yield done()

    made = table.select("h").mapInArrow(send, sent).repartition("piece").sortWithinPartitions("piece").mapInArrow(meet, "piece int, bits binary").toArrow()
    out = np.zeros((pieces, PIECE // 8), np.uint8)
    for piece, x in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
        out[piece] = np.frombuffer(x, np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; all that were added are among them."""
    piece, a, b = places(h, len(bits) * 8 // PIECE)
    found = np.ones(len(h), bool)
    for at in (a, b):
        at = piece * PIECE + at
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def suspects(docs: DataFrame, bits, share: int = 0, shares: int = 1, *, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(key, sum: of the text, digest: of the line's key, lines: their numbers) of what the filter, a broadcast, may hold."""
    out = T.StructType([docs.schema[key], T.StructField("sum", T.BinaryType()), T.StructField("digest", T.BinaryType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, sums, digests, lines = [], [], [], []
            for i, body in enumerate(_texts(batch.column(1))):
                some = keys(body, length)
                if not some:
                    continue
                h = np.fromiter((xxhash.xxh3_64_intdigest(k) for _, k in some), np.uint64, len(some))
                keep = may_hold(bits.value, h)
                if shares > 1:
                    keep &= h % np.uint64(shares) == np.uint64(share)
                mine: dict[bytes, list[int]] = {}
                for at in np.flatnonzero(keep).tolist():
                    mine.setdefault(some[at][1], []).append(some[at][0])
                if mine:
                    row += [i] * len(mine)
                    sums += [hashlib.md5(body).digest()] * len(mine)
                    digests += [hashlib.sha256(k).digest() for k in mine]
                    lines += mine.values()
            if row:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(sums, pa.binary()), pa.array(digests, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], names=out.names)

    return docs.select(docs[key], docs[text]).mapInArrow(step, out)


def confirmed(found: DataFrame, *, key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(digest, holder) of the keys that so many documents hold."""
    n = F.count_distinct(key) + F.max(F.col(key).isNull().cast("int"))
    return found.groupBy("digest").agg(n.alias("n"), F.max(key).alias("holder")).where(F.col("n") >= least).select("digest", "holder")


def to_drop(found: DataFrame, kept: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, sum, drop: line numbers) of the documents that lose lines."""
    lost = found.join(kept, "digest").where(~F.col(key).eqNullSafe(F.col("holder")))
    return lost.groupBy(key, "sum").agg(F.flatten(F.collect_set("lines")).alias("drop"))


def without_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """(key, n_lines, n_dropped, kept: the text without the lines that others hold) of each row."""
    spark = docs.sparkSession
    table = written(hashes(docs, text=text, length=length), "line-hashes")
    wanted = (table.agg(F.sum("n")).first()[0] or 0) * BITS
    shares = max(1, -(-wanted // most_bits))
    pieces = max(1, -(-wanted // shares // PIECE))
    found = None
    for share in range(shares):
        bits = spark.sparkContext.broadcast(twice_filter(table, pieces, share, shares))
        some = written(suspects(docs, bits, share, shares, text=text, key=key, length=length), "suspects")
        bits.destroy()
        found = some if found is None else found.unionByName(some)
    lost = written(to_drop(found, written(confirmed(found, key=key, least=least), "confirmed"), key=key), "lost")
    rows = docs.select(docs[key], docs[text].alias("__text"), F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))).alias("__sum"))
    clean, touched = parted(rows, lost, key, most_bits)
    both = touched.join(lost.withColumnRenamed(key, "__key"), touched[key].eqNullSafe(F.col("__key")) & (F.col("__sum") == F.col("sum")), "left").select(key, "__text", "drop")
    out = T.StructType([docs.schema[key], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops, row = batch.column(2).to_pylist(), 0
            for at, texts in packed(batch.column(1)):
                n, gone, made = [], [], []
                for i, (a, b) in enumerate(zip(texts.starts, texts.ends, strict=True)):
                    body, drop = texts.data[a:b].tobytes(), set(drops[at + i] or ())
                    lines = body.count(b"\n") + 1
                    if drop:
                        body = b"\n".join(x for j, x in enumerate(body.split(b"\n")) if j not in drop)
                    n.append(lines)
                    gone.append(len(drop))
                    made.append(body)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, texts.n), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(made, pa.binary()).view(pa.string())], names=out.names)

    made = both.mapInArrow(step, out)
    if clean is None:
        return made
    body = F.coalesce("__text", F.lit(""))
    as_is = clean.select(key, (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), body.alias("kept"))
    return as_is.unionByName(made)


def filter_of(hashes: DataFrame, most_bits: int = MOST_BITS):
    """A broadcast of the filter of a table of 64-bit hashes, its only column, or None if it would have more than most_bits."""
    n = hashes.count()
    if n * BITS > most_bits:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], names=["n", "h"])

    return hashes.sparkSession.sparkContext.broadcast(twice_filter(hashes.mapInArrow(pack, "n long, h binary"), max(1, -(-n * BITS // PIECE)), least=1))


def parted(rows: DataFrame, lost: DataFrame, key: str, most_bits: int) -> tuple[DataFrame | None, DataFrame]:
    """(rows that are surely not in lost, the others) of rows (key, __text, __sum); lost: (key, sum, ..). Without a filter of lost that may be broadcast all are others."""
    bits = filter_of(lost.select(F.xxhash64(key, "sum").alias("h")), most_bits)
    if bits is None:
        return None, rows

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, h.to_numpy(np.int64).view(np.uint64)))

    flagged = rows.withColumn("__among", among(F.xxhash64(key, "__sum")))
    return flagged.where("NOT __among").drop("__among"), flagged.where("__among").drop("__among")
