"""5. Token-ID binary output: length-delimited records with masked checksums, and an offset index beside each file.

A file part-NNNNN-A.rec (A: the number of the task's attempt) is a run of records:

    length of the payload      8 bytes, little endian
    masked crc32 of these      4 bytes
    payload                    one byte: 2 or 4, the bytes an id takes; then the ids, little endian
    masked crc32 of these      4 bytes

Its index part-NNNNN-A.idx has 24 bytes a record: key (signed), offset of the record in the file, number of ids; a shuffled
reader seeks by it. A null key is the least signed 64-bit integer. Files follow each other in ascending key order, rows of
one key together; the sizes table that write() returns has each file's ids, and so where each file's ids begin.

A task writes its file under a name of its own attempt, and the sizes table names the files of the attempts that ended well.
So a lost or repeated task breaks none, on any file system; what it leaves behind is named nowhere. Files go to the given folder, which all executors share. Null texts are empty: their record holds the end id
only. Repeated keys each have a record. An empty table gives no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import fragments

NULL_KEY = -(1 << 63)
MASK = 0xA282EAD8
#: Times the fragments that an encoder remembers otherwise: the words of many texts.
ROOM = 2.5
SIZES = "part int, file string, n_records long, n_ids long"


def masked(data: bytes) -> int:
    """crc32, rotated and shifted, so that data which itself holds checksums stays well checked."""
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes, appends end_id to each document, writes the files; returns (part, file, n_records, n_ids), one row per file."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # the bounds come from the key column alone; texts are read once and encoded before the shuffle
    bounds = np.array(rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or [], np.int64) if n > 1 else np.zeros(0, np.int64)
    coded = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("payload", T.BinaryType())])

    end = np.array([end_id], "<i4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = fragments(tokenizer, ROOM)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, h = part.column(0).to_numpy(), part.column(1).to_numpy()
                ids = [np.frombuffer(x + end, "<i4") for x in codec.encode_all([x or "" for x in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array(parts_of(keys, h, bounds), pa.int32()), part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int32()), pa.array([packed_ids(x) for x in ids], pa.binary())], names=coded.names)

    dealt = rows.mapInArrow(encode, coded).repartitionById(n, F.col("part")).sortWithinPartitions("key", "h").select("key", "n", "payload")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, out, index = task.partitionId(), None, []
        at = ids = 0
        name = f"part-{part:05d}-{task.taskAttemptId()}"
        for batch in batches:
            if out is None:
                fs, root = _folder(folder)
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.rec")
            for k, count, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                index.append((k, at, count))
                out.write(frame := framed(payload.as_py()))
                at += len(frame)
                ids += count
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{folder}/{name}", "n_records": len(index), "n_ids": ids}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64())]))

    return dealt.mapInArrow(step, SIZES)


def packed_ids(ids: np.ndarray) -> bytes:
    """A payload: ids below 2**16 take two bytes each, others four."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or 0 <= ids.min() and ids.max() < 1 << 16 else b"\x04" + ids.astype("<i4").tobytes()


def unpacked_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, {2: "<u2", 4: "<i4"}[payload[0]], offset=1).astype("<i4")


def parts_of(keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The file of each row, ascending by key. A key that fills several files (its bound recurs) is spread over them by its rows' hashes, in order."""
    low, high = np.searchsorted(bounds, keys, side="left"), np.searchsorted(bounds, keys, side="right")
    spread = (hashes.astype(np.float64) + 2.0**63) / 2.0**64 * np.maximum(high - low, 1)
    return low + np.minimum(spread.astype(np.int64), np.maximum(high - low, 1) - 1)


def read(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(doc_id, start: ids of all records before it, ids binary) of every record, from the files; a broken checksum raises.

    sizes: what write() returned, one row a file (bounded by the number of partitions).
    """
    files = sorted(sizes.collect(), key=lambda r: r.part)
    starts = np.cumsum([0, *(r.n_ids for r in files)])
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType())])
    plan = spark.createDataFrame([(r.file, int(s)) for r, s in zip(files, starts[:-1], strict=True)], schema).repartition(max(1, len(files)), "file")
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = _folder(file)
                with fs.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with fs.open_input_stream(f"{path}.rec") as f:
                    for i in range(0, len(index), 1000):
                        part = index[i : i + 1000]
                        payloads = [unpacked_ids(_record(f)).tobytes() for _ in range(len(part))]
                        first = start + np.cumsum([0, *part[:, 2]])
                        start = int(first[-1])
                        keys = pa.array([None if k == NULL_KEY else k for k in part[:, 0].tolist()], pa.int64())
                        yield pa.RecordBatch.from_arrays([keys, pa.array(first[:-1], pa.int64()), pa.array(payloads, pa.binary())], names=out.names)

    return plan.mapInArrow(step, out)


def _record(f) -> bytes:
    head = f.read(12)
    n, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("a record's length fails its checksum")
    payload = f.read(n)
    if masked(payload) != struct.unpack("<I", f.read(4))[0]:
        raise ValueError("a record's payload fails its checksum")
    return payload


def pick(folder_file: str, rows: list[int]) -> list[np.ndarray]:
    """Some records of one file by their number, through the offset index: what a shuffled reader does."""
    fs, path = _folder(folder_file)
    with fs.open_input_stream(f"{path}.idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    found = []
    with fs.open_input_file(f"{path}.rec") as f:
        for r in rows:
            f.seek(int(index[r, 1]))
            found.append(unpacked_ids(_record(f)))
    return found
