"""1. BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so each place in a text where such a
pair stands is a certain cut (all pairs inside tokens are noted when the vocabulary is loaded). A text is cut twice:

1. between a character that is no white space and an ASCII white-space character after it, if the two bytes that meet there
   are such a pair. There the tokenizer's own splitting pattern cuts too, whatever stands around, so fragments encode
   independently and their ids are concatenated. A fragment is encoded once in a worker and then looked up. Where the tokenizer
   puts all in lower case and drops white space, fragments are words in lower case, so there are fewer to encode.
2. inside a fragment, after the tokenizer's splitting pattern, at every such pair of bytes, also between letters. The runs of
   bytes that are left are merged side by side in numpy: in each step every run takes its merge of least rank, the leftmost of
   equal ones, until none has a merge. Fragments with characters other than ASCII and Latin-1's letters (the pattern's Unicode
   classes and the normaliser are the library's) and those with added tokens are encoded by the tokenizers library.

Memory: a worker remembers at most CACHED fragments and CACHED_BYTES of them, or so many times that as its caller asks for, then
starts anew; a batch needs its own texts. What a worker has once taken stays with it when other operators' tasks run there.

Rows: a null text counts as empty and has no ids. Repeated rows each give their row. An empty table gives an empty
result. Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

#: White space of Unicode, as the splitting patterns' \s has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACE = "\t\n\x0b\x0c\r "
#: Fragments that a worker remembers, and their bytes with their ids'.
CACHED, CACHED_BYTES = 200_000, 16 << 20
#: The splitting pattern of byte-level tokenizers, which their files leave out.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 62)
#: Rows that are coded together.
ROWS = 250


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary's merges: looked up by pairs of ids in a table with open addresses."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        split = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.width + vocab[b] for a, b in split], np.int64)
        made = np.array([vocab[a + (b.removesuffix(end) if end and a.endswith(end) else b)] for a, b in split], np.int64)
        self.mask = (1 << max(4, (4 * len(pairs)).bit_length())) - 1
        self.keys, self.at = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        for i, (key, slot) in enumerate(zip(pairs.tolist(), self._slots(pairs).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = slot + 1 & self.mask
            if self.keys[slot] == -1:
                self.keys[slot], self.at[slot] = key, i
        self.made = made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is none."""
        keys = left * self.width + right
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.at[slots], NONE)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            slots[more] = slots[more] + 1 & self.mask
            found = self.keys[slots[more]]
            hit = found == keys[more]
            out[more[hit]] = self.at[slots[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def merged(self, ids: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of runs (run: the number of each id's run, ascending) after all merges inside runs, and their runs."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), NONE)
            if len(ids) > 1:
                inside = np.flatnonzero(run[1:] == run[:-1])
                rank[inside] = self.ranks(ids[inside], ids[inside + 1])
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            size = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != NONE, size)
            if not live.all():
                done.append((ids[~live], run[~live]))
            if not live.any():
                break
            at = np.flatnonzero(live & (rank == np.repeat(least, size)))
            at = at[np.r_[True, run[at[1:]] != run[at[:-1]]]]
            ids[at] = self.made[rank[at]]
            live[at + 1] = False
            ids, run = ids[live], run[live]
        if not done:
            return ids, run
        ids, run = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(run, kind="stable")
        return ids[order], run[order]


#: Letters beyond ASCII that are letters in every version of Unicode, have no other composed form and one lower-case letter.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(rf"[\x00-\x7f{LATIN}]*").fullmatch
#: What str.split() takes for white space and the patterns don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def plain_pattern(spec: dict) -> tuple[re.Pattern, bool] | None:
    """(the splitting pattern for PLAIN texts, whether they are put in lower case) of a tokenizer file; None if it isn't known."""
    pre, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normal:
        said, low = BYTE_LEVEL, False
    elif pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
        split, level = pre["pretokenizers"]
        if not split["invert"] or split["behavior"] != "Removed" or level["use_regex"] or level["add_prefix_space"]:
            return None
        steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"]:
            return None
        said, low = split["pattern"]["Regex"], True
    else:
        return None
    for name, chars in ((r"[\p{L}]", rf"[A-Za-z{LATIN}]"), (r"[\p{N}]", "[0-9]"), (r"[^\s\p{L}\p{N}]", rf"[^\t-\r A-Za-z0-9{LATIN}]"), (r"\p{L}", rf"[A-Za-z{LATIN}]"), (r"\p{N}", "[0-9]"), (r"\S", r"[^\t-\r ]"), (r"\s", r"[\t-\r ]")):
        said = said.replace(name, chars)
    return re.compile(said), low


class Fragments:
    """A tokenizer file that encodes texts fragment by fragment. room: how many times CACHED and CACHED_BYTES it may hold."""

    def __init__(self, path: str, room: float = 1):
        self.room = room
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        end = spec["model"].get("end_of_word_suffix") or ""
        vocab = {k: v for k, v in spec["model"]["vocab"].items()}
        self.token_bytes: dict[int, bytes] = {}
        self.pairs = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(of[c] for c in (token.removesuffix(end) if end else token) if c in of)
            self.token_bytes[i] = raw
            x = np.frombuffer(raw, np.uint8)
            self.pairs[x[:-1], x[1:]] = True
        inside = self.pairs.copy()
        for x in spec["added_tokens"]:
            raw = x["content"].encode()
            self.token_bytes[x["id"]] = raw
            y = np.frombuffer(raw, np.uint8)
            self.pairs[y[:-1], y[1:]] = True
        solid = np.ones(256, bool)
        solid[list(ASCII_SPACE.encode())] = False
        #: Pairs of another byte and white space that some token holds: no cut between these.
        self.uncertain = [bytes((x, y)) for y in ASCII_SPACE.encode() for x in np.flatnonzero(self.pairs[:, y] & solid)]
        wide = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:[{wide}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+").findall
        self.known: dict[str, bytes] = {}
        self.held = 0
        letters = {b: c for c, b in of.items()}
        plain = [letters[b] for b in range(256)]
        pattern = plain_pattern(spec)
        self.split = self.low = None
        if pattern and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and all(c in vocab and c + end in vocab for c in plain):
            self.split, self.low = pattern[0].findall, pattern[1]
            self.inside, self.merges = inside, Merges(vocab, spec["model"]["merges"], end)
            self.first = np.array([vocab[c] for c in plain], np.int64)
            self.last = np.array([vocab[c + end] for c in plain], np.int64)
        self.added = [x["content"] for x in spec["added_tokens"]]
        #: Case and white space leave no trace in the ids of a PLAIN text: its fragments are its words in lower case.
        self.wordy = bool(self.split and self.low and not self.uncertain and not any(re.search(r"\s", x) for x in self.split(" a\t 1 \n!\r\n 's \x0b\x0c ")))

    def cut(self, text: str) -> list[str]:
        if self.wordy and (text.isascii() or PLAIN(text)) and not any(c in text for c in SEPARATORS):
            low = text.lower()
            if not any(x in text or x in low for x in self.added):
                return low.split()
        parts = self.pieces(text)
        raw = text.encode() if self.uncertain else b""
        if any(pair in raw for pair in self.uncertain):
            joined = parts[:1]
            for x in parts[1:]:
                if joined[-1][-1].encode()[-1:] + x[0].encode()[:1] in self.uncertain:
                    joined[-1] += x
                else:
                    joined.append(x)
            return joined
        return parts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        cuts, known = [self.cut(t) for t in texts], self.known
        if len(known) > self.room * CACHED or self.held > self.room * CACHED_BYTES:
            known.clear()
            self.held = 0
        self._learn(list(set().union(*cuts).difference(known)))
        return [b"".join(map(known.__getitem__, parts)) for parts in cuts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _learn(self, fresh: list[str]) -> None:
        """Fragments that aren't known yet become known."""
        joined = "\n".join(fresh)
        self.held += 4 * len(joined)  # an id takes four bytes and there is about one in two characters
        if self.split is None:
            own, other = [], fresh
        elif PLAIN(joined) and not any(x in joined for x in self.added):
            own, other = fresh, []
        else:
            own = [p for p in fresh if PLAIN(p) and not any(x in p for x in self.added)]
            other = list(set(fresh).difference(own))
        for p, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<i4").tobytes()
        if own:
            split = self.split
            parts = [[p] if p.isalpha() else split(p) for p in map(str.lower, own)] if self.low else [split(p) for p in own]
            flat = [x for p in parts for x in p]
            ids, counts = self.coded(flat)
            raw = ids.astype("<i4").tobytes()
            ends = np.cumsum(np.r_[0, counts])[np.cumsum([0, *map(len, parts)])] * 4
            bounds = ends.tolist()
            self.known.update(zip(own, map(raw.__getitem__, map(slice, bounds, bounds[1:])), strict=True))

    def coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each piece): PLAIN pieces of the splitting pattern, cut at every certain pair and merged."""
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        chars = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
        ends = chars[np.cumsum([len(p) for p in pieces])]
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        starts = np.zeros(len(data), bool)
        starts[0] = True
        starts[1:] = ~self.inside[data[:-1], data[1:]]
        starts[ends[:-1]] = True
        run = np.cumsum(starts) - 1
        ids, of = self.merges.merged(ids, run)
        piece = np.searchsorted(ends, np.flatnonzero(starts), side="right")[of]
        return ids, np.bincount(piece, minlength=len(pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, joined."""
        of = self.token_bytes
        return b"".join([of[i] for i in ids.tolist()])


@lru_cache(maxsize=4)
def fragments(path: str, room: float = 1) -> Fragments:
    return Fragments(path, room)


def encode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", decoded: bool = False, room: float = 1) -> DataFrame:
    """(key, ids array<int>) of each row's whole text: the ids that the tokenizer file gives, without special tokens added.

    decoded: with a third column decoded, what decode() gives for these ids, made in the same task. room: see Fragments.
    """
    out = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])

    bounded_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = fragments(tokenizer, room)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                raw = codec.encode_all([x or "" for x in part.column(1).to_pylist()])
                bounds = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in raw], out=bounds[1:])
                flat = np.frombuffer(b"".join(raw), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *[_texts(codec, flat, bounds)] * decoded], names=out.names)

    return docs.select(key, text).mapInArrow(step, out)


def _texts(codec: Fragments, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([codec.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def decode(encoded: DataFrame, tokenizer: str, *, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids): special tokens stay in, bytes that are no UTF-8 become U+FFFD. Null ids decode to the empty text."""
    out = T.StructType([encoded.schema[key], T.StructField("text", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = fragments(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), _texts(codec, ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy())], names=out.names)

    return encoded.select(key, "ids").mapInArrow(step, out)
