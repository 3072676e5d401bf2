"""9. Chat formatting by token-level assembly.

Each turn is encoded by itself: reserved ids mark its start and end, role and text are encoded as ordinary text in
between, so no text can ever produce a reserved id. Control strings inside roles and texts are escaped reversibly all the
same, so the decoded conversation can be parsed: `<|` becomes `<\\|`, and each `<\\…|` gets one more backslash. The loss mask
is 1 on an assistant's text ids. Turns stay separate rows; where each begins in its conversation comes from prefix sums
over the turns' lengths, so no conversation is ever gathered in memory.

A turn in text:  <|im_start|>role\\ntext<|im_end|>\\n   (a newline or backslash in a role is written \\n or \\\\)

Rows: turns are ordered by turn, ties by role, then text; nulls first. Null role and text are empty; null conv_id is a
conversation of its own. Repeated rows are turns of their own. Only the named columns are read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import fragments
from .common import list_array

START, END = "<|im_start|>", "<|im_end|>"
#: Reserved ids: the first two that the vocabulary (ids up to 50256) leaves free.
START_ID, END_ID = 50257, 50258
LEARNED = ("assistant",)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def one_line(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line))


def turns(conversations: DataFrame, tokenizer: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, turn_no from 0, start: ids of the conversation before it, ids array<int>, mask array<tinyint>), a row per turn.

    A conversation's ids and mask are its turns' joined by turn_no. Its rows stand together, in order, in one partition.
    """
    out = T.StructType([conversations.schema["conv_id"], T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = fragments(tokenizer)
        encode = lambda x: np.frombuffer(codec.encode(x), "<i4")
        line = encode("\n")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, mask = [], []
                for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    segments = [np.array([START_ID], "<i4"), encode(one_line(role or "") + "\n"), encode(escaped(text or "")), np.array([END_ID], "<i4"), line]
                    ends = np.cumsum([len(s) for s in segments])  # the text is segment 2
                    m = np.zeros(ends[-1], np.int8)
                    m[ends[1] : ends[2]] = (role or "") in learned
                    ids.append(np.concatenate(segments))
                    mask.append(m)
                counts = np.array([len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(4), list_array(np.concatenate(ids), counts, pa.int32()), list_array(np.concatenate(mask), counts, pa.int8())], names=out.names)

    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "hash")
    return rows.mapInArrow(step, out).select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("turn_no"), (F.sum(F.size("ids").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))).alias("start"), "ids", "mask").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))


def formatted(ids: np.ndarray, codec) -> str:
    """Decoded text of some ids, with the control strings of the reserved ids."""
    at = np.flatnonzero((ids == START_ID) | (ids == END_ID))
    parts, last = [], 0
    for i in at.tolist():
        parts += [codec.decode(ids[last:i]), (START if ids[i] == START_ID else END).encode()]
        last = i + 1
    return b"".join([*parts, codec.decode(ids[last:])]).decode("utf-8", "replace")


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    found = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", text, re.S)
    return [(role_of(r), unescaped(t)) for r, t in found]


def digests(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what turns() gives.

    The rows of a conversation stream by; only the running digests are held. Each turn's text is taken from the decoded,
    formatted text; what the mask marks is decoded by itself.
    """
    out = T.StructType([rows.schema["conv_id"], *(T.StructField(n, k()) for n, k in (("n_turns", T.LongType), ("turns_sha256", T.StringType), ("loss_chars", T.LongType), ("loss_sha256", T.StringType), ("formatted_chars", T.LongType), ("n_tokens", T.LongType), ("n_loss_tokens", T.LongType)))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, done = fragments(tokenizer), None, []
        close = lambda x: (x["id"], x["n"], x["turns"].hexdigest(), x["lc"], x["loss"].hexdigest(), x["chars"], x["tokens"], x["lt"])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate((key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=out.names)
        key = pa.int64()
        for batch in batches:
            key = batch.column(0).type
            for conv, no, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if no == 0:
                    if now:
                        done.append(close(now))
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "lc": 0, "chars": 0, "tokens": 0, "lt": 0}
                x, m = ids.values.to_numpy(), mask.values.to_numpy().astype(bool)
                text = formatted(x, codec)
                for role, said in parsed(text):
                    now["turns"].update(f"{role}\n{said}\n".encode())
                    now["n"] += 1
                loss = unescaped(formatted(x[m], codec))
                now["loss"].update(loss.encode())
                now["lc"] += len(loss)
                now["chars"] += len(text)
                now["tokens"] += len(x)
                now["lt"] += int(m.sum())
            if len(done) >= 1000:
                yield flush()
                done = []
        if now:
            done.append(close(now))
        if done:
            yield flush()

    return rows.select("conv_id", "turn_no", "ids", "mask").mapInArrow(step, out)
