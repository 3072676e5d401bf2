"""Foreshadowing, attribute conflicts and repeated text. Detectors take chunks and a pack and give issue rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..components import components
from ..functions.text import any_of, occurrences, present, run_tokens, sentences, snippet
from ..messages import MESSAGES, MORE_PHRASES, issue, said
from ..packs import Pack
from ..stored import stored
from .order import numbered, segmented

EVIDENCE = "array<struct<chunk_id:string,chapter_title:string,document_path:string,snippet:string,match_count:int>>"


def at() -> Column:
    return F.struct("path", "chunk_index")


def evidence(x: Column, n: Column | None = None) -> Column:
    """One piece of evidence, behind its place so that a sort brings canonical order."""
    return F.struct("path", "chunk_index", F.struct(F.col("chunk_id"), F.col("title").alias("chapter_title"), F.col("path").alias("document_path"), x.alias("snippet"), (n if n is not None else F.lit(None)).cast("int").alias("match_count")).alias("e"))


def gathered(first: int | None = None) -> Column:
    """The group's evidence in canonical order; the first few if asked."""
    rows = F.array_sort(F.collect_list("evidence"))
    return F.transform(F.slice(rows, 1, first) if first else rows, lambda r: r["e"])


def foreshadows(chunks: DataFrame, pack: Pack) -> DataFrame:
    said = chunks.select("project_id", "path", "chunk_index", "chunk_id", F.explode(sentences("content", pack.delimiters)).alias("s")).where((F.length("s") >= 8) & any_of("s", pack.markers))
    made = said.groupBy("project_id", F.substring("s", 1, 28).alias("title")).agg(
        F.count("*").alias("mentions"), F.min(F.struct("path", "chunk_index", "chunk_id", "s")).alias("a"), F.max_by(F.struct("chunk_index", "chunk_id"), at()).alias("b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.regexp_extract_all("s", F.lit(pack.related), 1)))))).alias("related_nodes"),
    )
    score = F.abs(F.col("b.chunk_index") - F.col("a.chunk_index")) * 2 * F.col("mentions")
    return made.select("project_id", "title", "mentions", F.col("a.chunk_id").alias("first_chunk_id"), F.col("b.chunk_id").alias("latest_chunk_id"), "related_nodes", F.when(score >= 20, "high").when(score >= 10, "medium").otherwise("low").alias("risk_level"), F.substring("a.s", 1, 120).alias("evidence"))


def attribute_conflicts(chunks: DataFrame, pack: Pack, pattern: str | None = None) -> DataFrame:
    """Names to which the text gives two values or more of an attribute."""
    p = F.lit(pattern or pack.attribute)
    hits = chunks.select("project_id", "path", "chunk_index", "chunk_id", "title", F.substring("content", 1, 100).alias("snip"), F.explode(F.arrays_zip(F.regexp_extract_all("content", p, 1).alias("name"), F.regexp_extract_all("content", p, 2).alias("value"))).alias("x"))
    one = hits.groupBy("project_id", F.col("x.name").alias("name"), F.col("x.value").alias("value")).agg(F.min(F.struct("path", "chunk_index", F.struct("chunk_id", F.col("title").alias("chapter_title"), F.col("path").alias("document_path"), F.col("snip").alias("snippet"), F.lit(None).cast("int").alias("match_count")).alias("e"))).alias("first"))
    made = one.groupBy("project_id", "name").agg(F.array_sort(F.collect_list(F.struct("value", "first.e"))).alias("v")).where(F.size("v") >= 2)
    return made.select("project_id", *issue("character_attribute_conflict", title=(F.col("name"),), description=(F.col("name"),)), F.transform("v", lambda x: x["e"]).alias("evidence"))


#: Terms, or verbs, that make an issue stand in so many chunks at least.
LEAST_TERMS, LEAST_ACTIONS = 3, 4
#: Evidence of a repeated term: its first chunks.
EVIDENCE_OF_TERM = 5


def term_hits(chunks: DataFrame, terms: tuple[str, ...], piece) -> DataFrame:
    """(project_id, term, evidence) of each chunk that holds a term."""
    hits = chunks.select("project_id", "path", "chunk_index", "chunk_id", "title", "content", F.explode(present("content", terms)).alias("term"))
    return hits.select("project_id", "term", evidence(piece(F.col("content"), F.col("term"))).alias("evidence"))


def around_term(c: Column, t: Column) -> Column:
    return F.substring(c, F.greatest(F.lit(1), F.instr(c, t) - 10), F.least(F.instr(c, t) - 1, F.lit(10)) + F.length(t) + 15)


def term_issues(made: DataFrame) -> DataFrame:
    """Issues of repeated terms from (project_id, term, evidence)."""
    return made.select("project_id", *issue("repeat_expression", title=(F.col("term"),), description=(F.col("term"),)), "evidence")


def repeat_terms(chunks: DataFrame, pack: Pack, least: int = LEAST_TERMS) -> DataFrame:
    hits = term_hits(chunks, pack.watched, snippet)
    return term_issues(hits.groupBy("project_id", "term").agg(F.count("*").alias("n"), gathered(EVIDENCE_OF_TERM).alias("evidence")).where(F.col("n") >= least))


def repeated_actions(chunks: DataFrame, pack: Pack, least: int = LEAST_ACTIONS) -> DataFrame:
    made = term_hits(chunks, pack.verbs, around_term).groupBy("project_id", "term").agg(F.count("*").alias("n"), gathered().alias("evidence")).where(F.col("n") >= least)
    return made.select("project_id", *issue("action", title=(F.col("term"),), description=(F.col("term"), F.col("n"))), "evidence")


#: Phrases that a task counts at a time; first letters of phrases that one broadcast holds.
HELD, STARTS = 500_000, 100_000


def said_clean(chunks: DataFrame, delimiters: str, least: int, *more) -> DataFrame:
    """(project_id, chunk_id, said: the letters and digits of each sentence of at least so many, more columns), stored."""
    clean = F.filter(F.transform(sentences("content", delimiters), lambda s: F.regexp_replace(s, r"[^\p{IsAlphabetic}\p{N}]+", "")), lambda s: F.length(s) >= least)
    return stored(chunks.where("project_id IS NOT NULL").select("project_id", "chunk_id", clean.alias("said"), *more))


def _phrase_counts(rows: DataFrame, phrases, least: int) -> DataFrame:
    """(project_id, phrase, n_chunks) of those in so many chunks at least. phrases: of project and sentences, each phrase of the chunk once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([p for p, c in counts.items() for _ in c], pa.string()), pa.array([x for c in counts.values() for x in c], pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["project_id", "phrase", "n"])
            counts.clear()
            return made

        for batch in batches:
            for project, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(project, Counter()).update(phrases(project, said))
                if sum(map(len, counts.values())) > HELD:
                    yield sent()
        yield sent()

    return rows.select("project_id", "said").mapInArrow(step, "project_id string, phrase string, n long").groupBy("project_id", "phrase").agg(F.sum("n").alias("n_chunks")).where(F.col("n_chunks") >= least)


def top_phrases(chunks: DataFrame, least: int = 5, n: tuple[int, int] = (4, 10), top: int = 15, delimiters: str = "[。！？\n]") -> DataFrame:
    """(project_id, phrase, n_chunks, rank): the phrases of n letters that stand in most chunks of a project, longer ones first."""
    return leading_phrases(said_clean(chunks, delimiters, n[0]), least, n, top)


def leading_phrases(rows: DataFrame, least: int, n: tuple[int, int], top: int) -> DataFrame:
    """top_phrases() of said_clean().

    The shortest length is counted first, each phrase once a chunk before the shuffle. A longer phrase stands in no more chunks
    than its first letters, so only those whose first letters are in as many chunks as the top-th short phrase are counted; first
    with one more letter, then the longer ones of those that are still in as many.
    """
    lo, hi = n
    rows = _once_a_chunk(rows)
    short = stored(_phrase_counts(rows, lambda project, said: {s[i : i + lo] for s in said for i in range(len(s) - lo + 1)}, least))
    by = W.partitionBy("project_id").orderBy(F.desc("n_chunks"), "phrase")
    bar = stored(short.withColumn("i", F.row_number().over(by)).where(F.col("i") <= top).groupBy("project_id").agg(F.when(F.count("*") == top, F.min("n_chunks")).otherwise(0).alias("bar")))
    live = stored(short.join(bar, "project_id").where("n_chunks >= bar").drop("bar"))
    every = live
    for start, end in ((lo, lo + 1), (lo + 1, hi)):
        if end > start and end <= hi:
            more = stored(_longer(rows, live, start, end, least).join(bar, "project_id").where("n_chunks >= bar").drop("bar"))
            every, live = every.unionByName(more), more
    order = W.partitionBy("project_id").orderBy(F.desc("n_chunks"), F.desc(F.length("phrase")), "phrase")
    return every.select("project_id", "phrase", "n_chunks").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _longer(rows: DataFrame, live: DataFrame, start: int, end: int, least: int) -> DataFrame:
    """(project_id, phrase, n_chunks) of the phrases of start + 1 to end letters that begin with a phrase of live, of start letters."""
    out, parts = None, max(1, -(-live.count() // STARTS))
    for part in range(parts):
        starts: dict[str, set[str]] = {}
        for r in live.where(F.pmod(F.xxhash64("project_id", "phrase"), F.lit(parts)) == part).select("project_id", "phrase").toLocalIterator():
            starts.setdefault(r.project_id, set()).add(r.phrase)
        known = rows.sparkSession.sparkContext.broadcast(starts)

        def longer(project: str, said: list[str], known=known) -> set[str]:
            own, found = known.value.get(project, ()), set()
            for s in said if len(own) > FEW else ("\n".join(said),):  # what is looked for holds letters and digits alone
                if len(own) > FEW:
                    places = [i for i in range(len(s) - start) if s[i : i + start] in own]
                else:
                    places = [i for p in own for i in _places(s, p)]
                for i in places:
                    whole = s[i : i + end].partition("\n")[0]
                    found.update(whole[:k] for k in range(start + 1, len(whole) + 1))
            return found

        made = _phrase_counts(rows, longer, least)
        out = made if out is None else out.unionByName(made)
    return out


#: So many phrases are looked for one by one.
FEW = 60


def _places(s: str, x: str) -> Iterator[int]:
    i = s.find(x)
    while i >= 0:
        yield i
        i = s.find(x, i + 1)


def _once_a_chunk(rows: DataFrame) -> DataFrame:
    """said_clean() with one row for each chunk, as a repeated one counts once."""
    often = stored(rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"))
    if not often.limit(1).count():
        return rows
    again = rows.join(often, "chunk_id", "left_semi").groupBy("project_id", "chunk_id").agg(F.flatten(F.collect_list("said")).alias("said"))
    return rows.select("project_id", "chunk_id", "said").join(often, "chunk_id", "left_anti").unionByName(again)


def high_freq_phrases(chunks: DataFrame, pack: Pack, least: int = 5, n: tuple[int, int] = (4, 10), top: int = 15) -> DataFrame:
    """One issue per project: its leading phrase, how many others there are, the first five chunks that hold it."""
    rows = said_clean(chunks, pack.delimiters, n[0], "path", "chunk_index", "title", F.substring("content", 1, 100).alias("snippet"))
    best = stored(leading_phrases(rows, least, n, top).groupBy("project_id").agg(F.min_by("phrase", "rank").alias("leader"), F.max("n_chunks").alias("n"), (F.count("*") - 1).alias("others")))
    hits = rows.join(best, "project_id").where(F.exists("said", lambda s: F.contains(s, F.col("leader"))))
    first = W.partitionBy("project_id").orderBy("path", "chunk_index")
    hits = hits.select("project_id", "path", "chunk_index", "leader", "n", "others", evidence(F.col("snippet"), F.col("n")).alias("evidence")).withColumn("i", F.row_number().over(first)).where("i <= 5")
    made = hits.groupBy("project_id", "leader", "n", "others").agg(gathered().alias("evidence"))
    text = F.concat(said(MESSAGES["expression"].description, (F.col("leader"), F.col("n"))), F.when(F.col("others") > 0, said(MORE_PHRASES, (F.col("others"),))).otherwise(""))
    return made.select("project_id", *issue("expression", description=text), "evidence")


def dialogue_patterns(chunks: DataFrame, pack: Pack, least: int = 6) -> DataFrame:
    # the guide is looked for first, and then what stands before it: from each letter on, most of the text would be tried
    said_so = lambda g: re.escape(g) + pack.speech
    before = r"[\p{IsAlphabetic}\p{N}][\s\S]{0,7}"
    behind = not re.search(r"[*+{(]", pack.speech)  # has an end that can be looked back from
    led = lambda g: F.col("content").rlike(f"{said_so(g)}(?<={before}{said_so(g)})" if behind else before + said_so(g))
    found = F.filter(F.array(*[F.when(led(g), F.lit(g)) for g in pack.guides]), lambda x: x.isNotNull())
    hits = chunks.select("project_id", "path", "chunk_index", "chunk_id", "title", F.explode(found).alias("guide")).withColumn("pattern", F.concat(F.lit("某某"), "guide"))
    made = hits.select("project_id", "pattern", evidence(F.col("pattern")).alias("evidence")).groupBy("project_id", "pattern").agg(F.count("*").alias("n"), gathered(5).alias("evidence")).where(F.col("n") >= least)
    counted = F.transform("evidence", lambda e: e.withField("match_count", F.col("n").cast("int")))
    return made.select("project_id", *issue("dialogue", description=(F.col("pattern"), F.col("n")), subject=F.col("pattern")), counted.alias("evidence"), F.col("n").alias("match_count"))


def outside_quotes(x: str, quotes: tuple[str, str]) -> Column:
    """The text outside quotation; quotes that close none are as deep as minus one and hide nothing."""
    a, b = quotes
    parts = F.split(F.replace(F.replace(F.col(x), F.lit(a), F.lit("\u0001+")), F.lit(b), F.lit("\u0001-")), "\u0001", -1)
    zero = F.struct(F.lit(0).alias("deep"), F.lit("").alias("kept"), F.lit(True).alias("first"))
    depth = lambda s, p: s["deep"] + F.when(s["first"], 0).when(p.startswith("+"), 1).otherwise(-1)
    step = lambda s, p: F.struct(depth(s, p).alias("deep"), F.when(depth(s, p) > 0, s["kept"]).otherwise(F.concat(s["kept"], F.lit("\u0002"), F.when(s["first"], p).otherwise(F.substring(p, 2, 1 << 30)))).alias("kept"), F.lit(False).alias("first"))
    return F.aggregate(parts, zero, step, lambda s: s["kept"])


def psych_counts(chunks: DataFrame, pack: Pack) -> DataFrame:
    x = chunks.where(F.octet_length("content") >= 100).withColumn("plain", outside_quotes("content", pack.quotes))
    return x.withColumn("hits", sum((occurrences("plain", k) for k in pack.psych), F.lit(0).cast("long"))).withColumn("chars", F.length("content").cast("long"))


def psych_density(chunks: DataFrame, pack: Pack, least: float = 0.04) -> DataFrame:
    x = psych_counts(chunks, pack).where(F.col("hits") / F.col("chars") >= least)
    numbers = (F.col("hits") / F.col("chars") * 100.0, F.col("hits"), F.col("chars"), F.lit(f"{least * 100:g}"))
    return x.select("project_id", *issue("psych_density", description=numbers, subject=F.col("chunk_id")), F.array(evidence(F.substring("content", 1, 150), F.col("hits"))["e"]).alias("evidence"))


def paragraphs(chunks: DataFrame, pack: Pack, least_bytes: int = 20) -> DataFrame:
    """Sentences of so many bytes, with their place and distinct tokens."""
    s = chunks.select("project_id", "path", "chunk_index", "chunk_id", "title", F.posexplode(sentences("content", pack.delimiters)).alias("sentence_no", "s")).where(F.octet_length("s") >= least_bytes)
    return s.withColumn("tokens", F.array_sort(run_tokens("s"))).withColumn("set_id", F.xxhash64("project_id", "tokens")).where(F.size("tokens") > 0)


#: Prefix rows of a token, in one part of them; those of more common tokens meet as pairs of such parts.
BLOCK = 2000
#: Counters by which tokens are sorted; in one broadcast, so a fixed number.
SLOTS = 1 << 21
#: Tokens that are looked at in one pass, about; and passes at most.
TOKENS, PASSES = 4_000_000, 4
#: Ids that are broadcast at most; more are joined by a shuffle.
LISTED = 1 << 20


def paragraph_sets(chunks: DataFrame, pack: Pack) -> DataFrame:
    """(project_id, path, chunk_index, sentence_no, set_id, tokens) of the paragraphs, stored."""
    return stored(paragraphs(chunks, pack).select("project_id", "path", "chunk_index", "sentence_no", "set_id", "tokens"))


def _listed(ids: DataFrame) -> DataFrame:
    """A stored table of ids, broadcast where it is short."""
    return F.broadcast(ids) if ids.count() <= LISTED else ids


def _sets(rows: DataFrame) -> DataFrame:
    """(project_id, set_id, tokens) of paragraph_sets(), once each; only sets that repeat are shuffled. Without a project none is like another."""
    some = rows.where("project_id IS NOT NULL").select("project_id", "set_id", "tokens")
    often = _listed(stored(some.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id")))
    again = some.join(often, "set_id", "left_semi").groupBy("set_id").agg(F.first("project_id").alias("project_id"), F.first("tokens").alias("tokens"))
    return some.join(often, "set_id", "left_anti").unionByName(again)


def _token_keys(sets: DataFrame) -> DataFrame:
    """(set_id, keys: a hash of project and token for each token)."""
    return sets.select("set_id", F.transform("tokens", lambda t: F.xxhash64("project_id", t)).alias("keys"))


def _keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many of each set)."""
    lists = batch.column(1)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(20) & np.uint64(SLOTS - 1)).astype(np.int64)


def _token_counts(keyed: DataFrame) -> np.ndarray:
    """How many sets have tokens of each slot: SLOTS numbers, whatever the sets."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS, np.int64)
        for batch in batches:
            sums += np.bincount(_slot(_keys_of(batch)[0]), minlength=SLOTS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], names=["slot", "n"])

    rows = stored(keyed.mapInArrow(step, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def prefixes(batch: pa.RecordBatch, counts: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """(key, set in the batch, tokens of the set, 1-based place, count of the key's slot) of each set's rarest tokens, and 64 bits that stand for each set's tokens.

    Of n tokens, all but the ceil(t n) - 1 most common ones: two sets of similarity t share one of these.
    """
    keys, n = _keys_of(batch)
    of = np.repeat(np.arange(len(n)), n)
    count = counts[_slot(keys)]
    bits = np.zeros(len(n), np.uint64)
    np.bitwise_or.at(bits, of, np.uint64(1) << (keys >> np.uint64(50) & np.uint64(63)))
    order = np.lexsort((keys, count, of))
    place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    keep = place < (n - np.ceil(n * t - 1e-9).astype(np.int64) + 1)[of]
    at = order[keep]
    return keys[at], of[at], n[of[at]], place[keep] + 1, count[at], bits


def _common_keys(keyed: DataFrame, known, t: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, parts) of the keys with more than block prefix rows, sorted. Only those whose slot has so many tokens are counted."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _, _, _, count, _ = prefixes(batch, known.value, t)
            some, n = np.unique(keys[count > block], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    if known.value.max() <= block:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = stored(keyed.mapInArrow(step, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > block)).toArrow()
    keys, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], -(-n[order] // block)


def _dealt(keys: np.ndarray, ids: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, side) of rows of these keys and sets: a common key's sets are in parts, and each two parts meet in a group of their own, as sides 0 and 1; else the side is 2."""
    every = np.arange(len(keys))
    if not len(common[0]):
        return every, keys, np.full(len(keys), 2, np.int64)
    at = np.minimum(np.searchsorted(common[0], keys), len(common[0]) - 1)
    hot = common[0][at] == keys
    rows, groups, sides = [every[~hot]], [keys[~hot]], [np.full(int((~hot).sum()), 2, np.int64)]
    where = every[hot]
    parts = common[1][at[hot]]
    part = ((ids[where] >> np.uint64(7)) % parts.astype(np.uint64)).astype(np.int64)
    row, other = np.repeat(where, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    own = np.repeat(part, parts)
    low, high = np.minimum(own, other), np.maximum(own, other)
    rows.append(row)
    groups.append((keys[row] + np.uint64(0x9E3779B97F4A7C15) * (low * 1_000_003 + high + 1).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9))
    sides.append(np.where(own == other, 2, (own > other).astype(np.int64)))
    return np.concatenate(rows), np.concatenate(groups), np.concatenate(sides)


def _near(g: np.ndarray, m: np.ndarray, a: np.ndarray, bits: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that may be similar. Rows come sorted by group and size; m: size, place, side.

    Sizes, places and bits bound what two sets have in common: the smaller is at least t of the larger; behind this token they share
    the rest of one at most; and each bit that one alone has is a token that one alone has.
    """
    n, i, side = m
    live, d = np.arange(len(g)), 1
    while len(live):
        live = live[live + d < len(g)]
        live = live[(g[live] == g[live + d]) & (n[live] >= t * n[live + d] - 1e-9)]  # sizes ahead only grow
        x, y = live, live + d
        total = n[x] + n[y]
        most = np.minimum(i[x], i[y]) + np.minimum(n[x] - i[x], n[y] - i[y])
        most = np.minimum(most, (total - np.bitwise_count(bits[x] ^ bits[y])) // 2)
        fits = (most >= t * (total - most) - 1e-9) & (a[x] != a[y]) & ((side[x] == 2) | (side[x] != side[y]))
        if fits.any():
            yield x[fits], y[fits]
        d += 1


def candidate_pairs(keyed: DataFrame, t: float, block: int, tokens: int = TOKENS) -> DataFrame:
    """(a, b: set ids), perhaps more than once: the sets that may be similar. keyed: _token_keys().

    A prefix-filter join: sets that are similar share one of their rarest tokens (by any order of all tokens; here by counters).
    The keys are taken in a few passes, so that their rows are never all shuffled at once.
    """
    context = keyed.sparkSession.sparkContext
    counts = _token_counts(keyed)
    known = context.broadcast(counts)
    shared = context.broadcast(_common_keys(keyed, known, t, block))
    passes = int(min(PASSES, 1 + counts.sum() // tokens))
    sent = T.StructType([T.StructField("g", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("n", "i", "side")], T.StructField("a", T.LongType()), T.StructField("bits", T.LongType())])

    def send(turn: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, of, n, i, count, bits = prefixes(batch, known.value, t)
                ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                some = np.flatnonzero((keys % np.uint64(passes) == np.uint64(turn)) & (count > 1))
                keys, of, n, i = keys[some], of[some], n[some], i[some]
                row, group, side = _dealt(keys, ids[of], shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), *[pa.array(x, pa.int32()) for x in (n[row], i[row], side)], pa.array(ids[of[row]].view(np.int64)), pa.array(bits[of[row]].view(np.int64))], names=sent.names)

        return step

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of what has come; the last one may go on in the next batch."""
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            g = held.column(0).to_numpy()
            end = len(g) if batch is None else int(np.argmax(g == g[-1]))
            part, held = held.slice(0, end), held.slice(end)
            n, i, side, a, bits = (part.column(c).to_numpy() for c in range(1, 6))
            for x, y in _near(g[:end], (n.astype(np.int64), i.astype(np.int64), side), a, bits.view(np.uint64), t):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[x], a[y])), pa.array(np.maximum(a[x], a[y]))], names=["a", "b"])

    out = None
    for turn in range(passes):
        made = stored(keyed.mapInArrow(send(turn), sent).repartition("g").sortWithinPartitions("g", "n").mapInArrow(meet, "a long, b long").distinct())
        out = made if out is None else out.unionByName(made)
    return out


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def similar_pairs(chunks: DataFrame, pack: Pack, t: float = 0.6, block: int = BLOCK) -> DataFrame:
    """(project_id, a, b, common, total, ta, tb) of distinct token sets with Jaccard similarity of at least t. Tokens of more than block sets are dealt out."""
    return pairs_of(paragraph_sets(chunks, pack), t, block)


def pairs_of(rows: DataFrame, t: float = 0.6, block: int = BLOCK) -> DataFrame:
    """similar_pairs() of paragraph_sets(): candidates, held against the sets themselves; only sets of a candidate are shuffled."""
    sets = _sets(rows)
    pairs = stored(candidate_pairs(_token_keys(sets), t, block).distinct())
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    some = stored(sets.join(_listed(ids), "set_id", "left_semi"))
    full = pairs.join(some.select("project_id", F.col("set_id").alias("a"), F.col("tokens").alias("ta")), "a").join(some.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return full.withColumn("common", both).where(F.col("common") >= F.lit(t) * (F.size("ta") + F.size("tb") - F.col("common")) - 1e-9).select("project_id", "a", "b", "common", (F.size("ta") + F.size("tb") - F.col("common")).alias("total"), "ta", "tb")


GROUPS = "project_id string, component long, path string, chunk_index long, sentence_no int, group_no long"


def similar_groups(chunks: DataFrame, pack: Pack, t: float = 0.6, most: int = 5) -> DataFrame:
    """Groups in canonical order: a paragraph that is in no group begins one and takes the next similar ones that are in none, up to five; groups of two or more are issues.

    Read forwards: a paragraph joins the earliest group that has room and whose first paragraph is like it; else it begins one. A
    set of tokens never has two groups with room, so that much is all there is to remember. Paragraphs that are like their copies
    only, however many they are, are counted off. All others pass a task in order, component by component (each choice depends on
    those before it): it holds the sets and links of one component, never its paragraphs.
    """
    sets = paragraph_sets(chunks, pack)
    links = stored(pairs_of(sets, t).select("project_id", "a", "b"))
    # a set that stands in one paragraph and is like no other is in no group
    some = stored(sets.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id").union(links.select(F.explode(F.array("a", "b")))).distinct())
    rows = stored(sets.drop("tokens").join(_listed(some), "set_id", "left_semi"))
    node = lambda c: F.struct("project_id", F.col(c).alias("set_id"))
    label = components(links.select(node("a").alias("a"), node("b").alias("b"))).select("node.project_id", "node.set_id", F.col("class.set_id").alias("component"))
    alone = segmented(rows.join(label, ["project_id", "set_id"], "left_anti").withColumnRenamed("project_id", "owner").select(F.concat_ws("|", F.col("set_id").cast("string"), "owner").alias("project_id"), "path", (F.col("chunk_index") * 4_294_967_296 + F.col("sentence_no")).alias("chunk_index"), F.col("chunk_index").alias("chunk"), "sentence_no", "set_id", "owner"))
    counted = numbered(alone).withColumn("group_no", F.floor((F.col("n") - 1) / most))
    sizes = counted.groupBy("project_id", "group_no").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    counted = counted.join(sizes, ["project_id", "group_no"]).select(F.col("owner").alias("project_id"), F.col("set_id").alias("component"), "path", F.col("chunk").alias("chunk_index"), "sentence_no", F.col("group_no").cast("long").alias("group_no"))

    near = links.union(links.select("project_id", "b", "a")).join(label.withColumnRenamed("set_id", "a"), ["project_id", "a"])
    said = near.select("project_id", "component", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("chunk_index"), F.lit(None).cast("int").alias("sentence_no"), F.col("a").alias("set_id"), F.col("b").alias("other"))
    mixed = rows.join(label, ["project_id", "set_id"]).select("project_id", "component", "path", "chunk_index", "sentence_no", "set_id", F.lit(None).cast("long").alias("other"))
    dealt = said.unionByName(mixed).withColumn("first", F.col("other").isNull()).repartition("project_id", "component").sortWithinPartitions("project_id", "component", "first", "path", "chunk_index", "sentence_no")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, near, live, begun = None, {}, {}, 0  # live: of each set the group with room that one of its paragraphs began, and the room
        for batch in batches:
            c = batch.to_pydict()
            group = []
            for project, component, s, other in zip(c["project_id"], c["component"], c["set_id"], c["other"], strict=True):
                if (project, component) != now:
                    now, near, live, begun = (project, component), {}, {}, 0
                if other is not None:
                    near.setdefault(s, []).append(other)
                    group.append(None)
                    continue
                first = min((live[x][0], x) for x in (s, *near.get(s, ())) if x in live) if any(x in live for x in (s, *near.get(s, ()))) else None
                if first is None:
                    live[s] = (begun, most - 1)
                    group.append(begun)
                    begun += 1
                else:
                    no, x = first
                    group.append(no)
                    if live[x][1] == 1:
                        del live[x]
                    else:
                        live[x] = (no, live[x][1] - 1)
            keep = [i for i, g in enumerate(group) if g is not None]
            some = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(some.column(x) for x in ("project_id", "component", "path", "chunk_index", "sentence_no")), pa.array([group[i] for i in keep], pa.int64())], names=["project_id", "component", "path", "chunk_index", "sentence_no", "group_no"])

    taken = stored(dealt.mapInArrow(greedy, GROUPS))
    sizes = taken.groupBy("project_id", "component", "group_no").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    return counted.unionByName(taken.join(sizes, ["project_id", "component", "group_no"]).select(*counted.columns))


def similar_paragraphs(chunks: DataFrame, pack: Pack) -> DataFrame:
    rows = paragraphs(chunks, pack).select("project_id", "path", "chunk_index", "chunk_id", "title", "sentence_no", F.substring("s", 1, 120).alias("s"))
    hits = similar_groups(chunks, pack).join(rows, ["project_id", "path", "chunk_index", "sentence_no"])
    made = hits.select("project_id", "component", "group_no", evidence(F.col("s")).alias("evidence")).groupBy("project_id", "component", "group_no").agg(gathered().alias("evidence"))  # five at most
    first = F.concat_ws("|", F.col("evidence")[0]["chunk_id"], F.md5(F.col("evidence")[0]["snippet"]))
    return made.select("project_id", *issue("paragraph", description=(F.size("evidence"),), subject=first), "evidence")


#: The repeat engine; add a function of (chunks, pack) to extend it.
REPEATED = {"high_freq_expression": high_freq_phrases, "repeated_action": repeated_actions, "similar_paragraph": similar_paragraphs, "dialogue_pattern": lambda c, p: dialogue_patterns(c, p).drop("match_count"), "psych_density": psych_density}


def run_detectors(chunks: DataFrame, pack: Pack, detectors: dict | None = None, prefix: str = "repeated_") -> DataFrame:
    """The issues of all detectors. The chunks are stored once, and so is what each detector finds, so that its shuffles go before the next one's."""
    chunks, out = stored(chunks), None
    for made in (stored(d(chunks, pack)) for d in (detectors or REPEATED).values()):
        out = made if out is None else out.unionByName(made)
    return out.withColumn("issue_type", F.concat(F.lit(prefix), "issue_type"))
