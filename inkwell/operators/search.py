"""Search over chunks, and Markdown from its hits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import snippet
from ..stored import stored


def phrase(x: Column | str) -> Column:
    """Lower-cased letters and digits, words parted by one space, a space at either end."""
    c = F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+", " ")), F.lit(" "))


#: What a hit keeps of its chunk, where the chunk has it.
KEPT = ("project_id", "path", "chunk_index", "title", "chunk_id", "start_offset", "end_offset")
#: Queries that one automaton holds at most; more are searched in blocks.
BLOCK = 10_000


def _hits(x: DataFrame, limit: int) -> DataFrame:
    """The first hits of each query, with snippets; a task sends no more than limit of each."""
    by = W.partitionBy("query_id").orderBy("path", "chunk_index", "project_id")
    x = x.select("query_id", *[c for c in KEPT if c in x.columns], snippet("content", F.col("query"), marked=True).alias("snippet"))
    x = x.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return x.select("query_id", "rank", *[c for c in x.columns if c not in ("query_id", "rank")])


def _blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    n = max(1, -(-queries.count() // block))
    return [queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


#: Lower-cases ASCII letters alone.
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matched(chunks: DataFrame, queries: DataFrame, said: Column, wanted: Column, *, fold: bool = True, block: int = BLOCK) -> DataFrame:
    """query_id, query and chunk wherever wanted (of a query) stands in said (of a chunk); empty ones stand nowhere. fold: A-Z match a-z.

    One pass over the chunks finds all queries of a block: they form an automaton that reads each text once, however many
    queries there are.
    """
    names = [*[c for c in KEPT if c in chunks.columns], "content"]
    rows = chunks.select(*names, said.alias("__said"))
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("nos", T.ArrayType(T.IntegerType()))])
    spark, out = chunks.sparkSession, None
    table = FOLD if fold else {}
    for part in _blocks(queries, block):
        asked = part.select("query_id", "query", wanted.alias("wanted")).where("wanted != ''").collect()
        places: dict[str, list[int]] = {}
        for no, r in enumerate(asked):
            places.setdefault(r.wanted.translate(table), []).append(no)
        known = spark.sparkContext.broadcast(places)

        def step(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word, nos in known.value.items():
                automaton.add_word(word, nos)
            automaton.make_automaton()
            for batch in batches:
                texts = (t.translate(table) if t and table else t for t in batch.column(len(names)).to_pylist())
                found = [sorted({n for _, nos in automaton.iter(t) for n in nos}) if t and known.value else [] for t in texts]
                some = [i for i, x in enumerate(found) if x]
                kept = batch.take(pa.array(some, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array([found[i] for i in some], pa.list_(pa.int32()))], names=schema.names)

        numbers = spark.createDataFrame([(no, r.query_id, r.query) for no, r in enumerate(asked)], T.StructType([T.StructField("no", T.IntegerType()), queries.schema["query_id"], queries.schema["query"]]))
        made = rows.mapInArrow(step, schema).withColumn("no", F.explode("nos")).drop("nos").join(F.broadcast(numbers), "no").drop("no")
        out = made if out is None else out.unionByName(made)
    return out


def search_substring(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Literal; of letters A-Z alone the case doesn't matter; blank queries find nothing. queries: query_id, query."""
    return _hits(matched(chunks, queries.where(F.trim("query") != ""), F.col("content"), F.col("query")), limit)


def search_phrase(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Whole words in a row, in title or content; queries that find nothing are searched as substrings."""
    asked = queries.where(F.trim(phrase("query")) != "")
    found = stored(_hits(matched(chunks, asked, F.concat(phrase("content"), F.lit("\u0000"), phrase("title")), phrase("query")), limit))
    rest = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(search_substring(chunks, rest, limit))


def context_pack(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One Markdown text per query: numbered sections of its hits with their place (path, chapter, bytes), or a fixed line without any.

    source_refs: the chunks it was made from, in order. hits are at most a search's limit a query.
    """
    some = hits
    for c in ("chunk_id", "start_offset", "end_offset"):
        if c not in hits.columns:
            some = some.withColumn(c, F.lit(None).cast("string" if c == "chunk_id" else "long"))
    plain = F.regexp_replace("snippet", r"[\[\]]", "")
    place = F.when(F.col("start_offset").isNull(), "").otherwise(F.format_string(", %d-%d", "start_offset", "end_offset"))
    part = F.format_string("## %d. %s\n\n来源文件: %s (%d%s)\n\n%s\n", F.col("rank"), F.col("title"), F.col("path"), F.col("chunk_index") + 1, place, plain)
    ref = F.struct("project_id", "path", "chunk_index", "chunk_id", "start_offset", "end_offset")
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("s"), ref.alias("ref"))))
    made = some.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.array_join(F.transform("rows", lambda r: r["s"]), "\n").alias("body"), F.transform("rows", lambda r: r["ref"]).alias("source_refs"), F.size("rows").alias("n_hits"))
    head = F.concat(F.lit("# 上下文包: "), "query", F.lit("\n\n"))
    return queries.join(made, "query_id", "left").select("query_id", F.concat(head, F.coalesce("body", F.lit("没有找到相关内容。\n"))).alias("markdown"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), "source_refs")


def project_report(summary: DataFrame, cands: DataFrame, fores: DataFrame, issues: DataFrame, most: int = 1000) -> DataFrame:
    """One Markdown text per project: totals, then persons, places, items, foreshadows and issues, most of each at most."""
    rows = cands.select("project_id", F.col("node_type").alias("section"), (-F.col("occurrence_count")).alias("o"), F.concat_ws(" ", F.lit("-"), "name", F.concat(F.lit("×"), F.col("occurrence_count").cast("string"))).alias("line"))
    rows = rows.unionByName(fores.select("project_id", F.lit("foreshadow").alias("section"), (-F.col("mentions")).alias("o"), F.concat_ws(" ", F.lit("-"), "title", "risk_level").alias("line")))
    rows = rows.unionByName(issues.select("project_id", F.lit("issue").alias("section"), F.lit(0).cast("long").alias("o"), F.concat_ws(" ", F.lit("-"), "issue_type", "title").alias("line")))
    by = W.partitionBy("project_id", "section").orderBy("o", "line")
    parts = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most).groupBy("project_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n").alias("body"))
    text = parts.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda r: F.concat(F.lit("## "), r["section"], F.lit("\n\n"), r["body"])), "\n\n").alias("sections"))
    head = F.format_string("# %s\n\n%d / %d / %d\n\n", "project_id", "documents", "chunks", "words")
    return summary.join(text, "project_id", "left").select("project_id", F.concat(head, F.coalesce("sections", F.lit(""))).alias("markdown"))


def document_tree(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id", "path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "title"))).alias("chapters"))
