"""11. Fill-in-middle: a document's prefix, middle and suffix are put in another order, marked by sentinels, and back again.

A text is cut at ends of its lines: prefix | middle | suffix. Its bytes stand in one bytearray, into which the sentinels are put:
`<P>`prefix`<M>`middle`<S>`suffix. Either form is then one exchange of two neighbouring blocks, done in place by three reversals:
psm exchanges `<M>`middle with `<S>`suffix; spm exchanges `<P>`prefix`<M>`middle with `<S>`suffix. The inverse finds the sentinels,
makes the same exchange backwards and takes the sentinels out.

All choices follow from the sha256 of `seed:key`, so a row is cut alike in any run and on any executor; the work is one pass
without a shuffle, and a task holds one batch of texts.

Rows: a null text is empty; an empty text, and one that holds a sentinel, stays as it is (form plain, lengths null). A null key
counts as the empty string. Repeated rows give repeated rows. Only the named columns are read, others may have any name. Texts
may have any length. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed


@dataclass(frozen=True)
class Plan:
    """seed: of the choices; rate: texts in a hundred that are transformed; spm: of these in a hundred, those with the suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[bytes, bytes, bytes]:
        """The sentinels as bytes. In a text that holds none of them, each must be found where it was put and nowhere else: so none is empty, or part of another, or begins as one ends."""
        marks = [m.encode() for m in (self.prefix, self.suffix, self.middle)]
        for x in marks:
            for y in marks:
                if not x or (x is not y and x in y) or any(x[-n:] == y[:n] for n in range(1, min(len(x), len(y)))):
                    raise ValueError(f"sentinels {x!r} and {y!r} can be taken for each other")
        return marks[0], marks[1], marks[2]


def exchanged(buffer: bytearray, start: int, between: int, end: int) -> None:
    """The blocks start..between and between..end change places, in place: each is reversed, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, between), (between, end), (start, end)):
        view[a:b] = view[a:b][::-1].copy()


def choices(plan: Plan, key: str | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits."""
    h = hashlib.sha256(f"{plan.seed}:{key or ''}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def put(text: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text in the form, cut at bytes first and second."""
    p, s, m = marks
    out = bytearray(text)
    out[second:second] = s
    out[first:first] = m
    out[0:0] = p
    at = len(p) + first
    exchanged(out, 0 if form == "spm" else at, at + len(m) + second - first, len(out))
    return out


def taken(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that put() was given."""
    if form == "plain":
        return output
    p, s, m = marks
    out = bytearray(output)
    if form == "spm":
        exchanged(out, 0, out.index(p), len(out))
    else:
        exchanged(out, out.index(s), out.index(m), len(out))
    for mark in (s, m, p):
        at = out.index(mark)
        del out[at : at + len(mark)]
    return bytes(out)


def _characters(x: np.ndarray) -> int:
    return int(np.count_nonzero((x & 0xC0) != 0x80))


def _strings(values: list[bytes | bytearray]) -> pa.Array:
    return pa.array([bytes(x) for x in values], pa.binary()).view(pa.string())


MADE = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def transformed(docs: DataFrame, plan: Plan = Plan(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n: lines, form: plain, psm or spm, prefix_chars, middle_chars, output) of each row."""
    marks = plan.marks()
    out = T.StructType([docs.schema[key], *MADE])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1)
            for row, texts in packed(batch.column(2)):
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(texts.starts, texts.ends, strict=True)):
                    data = texts.data[a:b]
                    body = data.tobytes()
                    ends = np.flatnonzero(data == 10) + 1
                    if len(data) and data[-1] != 10:
                        ends = np.append(ends, len(data))
                    n = len(ends)
                    h1, h2, h3, h4 = choices(plan, names[row + i].as_py())
                    if not body or h3 % 100 >= plan.rate or any(x in body for x in marks):
                        rows.append((n, "plain", None, None, body))
                        continue
                    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    form = "spm" if h4 % 100 < plan.spm else "psm"
                    rows.append((n, form, _characters(data[:first]), _characters(data[first:second]), put(body, first, second, form, marks)))
                n, form, before, middle, made = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, texts.n), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), _strings(made)], names=out.names)

    rows = docs.select(docs[key], docs[key].cast("string").alias("__name"), docs[text].alias("__text"))
    return rows.mapInArrow(step, out)


def restored(rows: DataFrame, plan: Plan = Plan(), *, output: str = "output", form: str = "form") -> DataFrame:
    """rows of transformed(), as they are, with column restored: the text from output and form alone. A null output or form gives null."""
    marks = plan.marks()
    out = T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())])
    body, kind = rows.columns.index(output), rows.columns.index(form)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, gone = batch.column(kind).to_pylist(), batch.column(body).is_null().to_pylist()
            for row, texts in packed(batch.column(body)):
                texts_of = (texts.data[a:b].tobytes() for a, b in zip(texts.starts, texts.ends, strict=True))
                back = [None if f is None or g else taken(x, f, marks) for x, f, g in zip(texts_of, forms[row : row + texts.n], gone[row : row + texts.n], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(row, texts.n) for c in batch.columns), pa.array(back, pa.binary()).view(pa.string())], names=out.names)

    return rows.mapInArrow(step, out)


def digests(rows: DataFrame) -> DataFrame:
    """rows of restored() with hex digests in place of the texts."""
    sums = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select(*[c for c in rows.columns if c not in ("output", "restored")], *sums)
