"""Reading manuscripts: files to documents to chapters, and keyed replacement of documents."""

from __future__ import annotations

import io
import tomllib
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trimmed
from ..packs import Pack
from ..stored import stored


def read_manuscripts(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """Files under root with a known ending: project_id, file, path (relative), content, last_modified_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").rstrip("/")
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    relative = F.when(path == base, F.element_at(F.split(path, "/"), -1)).otherwise(F.substring(path, len(base) + 2, 10_000))
    return files.where(F.lower("path").rlike(r"\.(txt|md|markdown|docx)$")).select(F.lit(project_id).alias("project_id"), F.col("path").alias("file"), relative.alias("path"), "content", F.col("modificationTime").alias("last_modified_at"))


@F.pandas_udf(T.StringType())
def gb18030(content: pd.Series) -> pd.Series:
    def one(b):
        try:
            return bytes(b).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return content.map(one)


@F.pandas_udf(T.StringType())
def docx_paragraphs(content: pd.Series) -> pd.Series:
    """Body paragraphs of a .docx, trimmed, empty ones left out, joined by an empty line; null if there is none or it is no such file."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(b):
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(bytes(b))).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        texts = ("".join(t.text or "" for t in p.iter(f"{ns}t")).strip() for p in body.iter(f"{ns}p"))
        return "\n\n".join(t for t in texts if t) or None

    return content.map(one)


def documents(files: DataFrame) -> DataFrame:
    """Decoded documents; a file that can't be read keeps its row, with error set and no text."""
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    docx = F.lower("path").endswith(".docx")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    plain = F.when(bom, F.when(valid, F.expr("substring(content, 4)").cast("string"))).when(valid, F.col("content").cast("string"))
    text = F.when(docx, docx_paragraphs("content")).otherwise(F.coalesce(plain, F.when(~bom, gb18030("content"))))
    encoding = F.when(docx, "docx").when(bom, "utf-8-bom").when(valid, "utf-8").otherwise("gb18030")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower("path").rlike(r"\.(md|markdown)$"), "markdown").when(docx, "document").otherwise("text")
    made = files.withColumn("text", text).withColumn("encoding", encoding).withColumn("kind", kind)
    made = made.withColumn("title", F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("")), F.lit("未命名文档")))
    return text_columns(made).withColumn("error", F.when(F.col("text").isNull(), F.lit("unreadable"))).drop("content").withColumn("deleted", F.lit(False))


def quarantined(files: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(documents that could be read, path and error of the others, how many were scanned and skipped), from one pass over the files.

    A bad file stops nothing. The decoded documents are stored; the counts are observed as they are written.
    """
    counts = Observation()
    made = stored(documents(files).observe(counts, F.count_if(F.col("error").isNull()).alias("scanned"), F.count_if(F.col("error").isNotNull()).alias("skipped")))
    return made.where("error IS NULL"), made.where("error IS NOT NULL").select("project_id", "path", "error"), dict(counts.get)


def text_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", F.sha2("text", 256)).withColumn("word_count", F.length(F.regexp_replace("text", r"(?U)\s+", "")).cast("long"))


def chunks(docs: DataFrame, pack: Pack, keep_preamble: bool = False, split: bool = True) -> DataFrame:
    """One row per chapter: project_id, path, chunk_index, title, content, start_offset, end_offset (bytes), chunk_id, word_count, content_hash.

    A line whose trimmed text is a heading starts a chapter. Text before the first goes, unless keep_preamble. Without
    headings the document is one chapter. split=False keeps the first chapter only.
    """
    rows = docs.select("project_id", "path", F.col("title").alias("document"), "text", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    by = W.partitionBy("project_id", "path").orderBy("line_no")
    heading = trimmed("line").rlike(pack.heading)
    lines = rows.drop("text").withColumn("chapter", F.sum(heading.cast("int")).over(by)).withColumn("at", F.sum(F.octet_length("line") + 1).over(by) - F.octet_length("line") - 1)
    lines = lines.withColumn("any", F.max("chapter").over(W.partitionBy("project_id", "path")))
    some = lines.where("any > 0" if keep_preamble else "chapter > 0")
    made = some.groupBy("project_id", "path", "chapter").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"), F.min("at").alias("start_offset"), F.min_by("line", "line_no").alias("first"), F.first("document").alias("document")
    )
    split_ones = made.select("project_id", "path", (F.col("chapter") - F.lit(0 if keep_preamble else 1)).cast("long").alias("chunk_index"), F.when(F.col("chapter") == 0, F.col("document")).otherwise(trimmed("first")).alias("title"), trimmed("raw").alias("content"), F.col("start_offset").cast("long"), (F.col("start_offset") + F.octet_length("raw")).cast("long").alias("end_offset"))
    whole = docs.where(~F.exists(F.split("text", "\n", -1), lambda x: trimmed(x).rlike(pack.heading))).select("project_id", "path", F.lit(0).cast("long").alias("chunk_index"), "title", F.col("text").alias("content"), F.lit(0).cast("long").alias("start_offset"), F.octet_length("text").cast("long").alias("end_offset"))
    out = split_ones.unionByName(whole)
    if not split:
        out = out.where("chunk_index = 0")
    out = out.withColumn("chunk_id", F.sha2(F.concat_ws("|", "project_id", "path", F.col("chunk_index").cast("string")), 256))
    return text_columns(out.withColumnRenamed("content", "text")).withColumnRenamed("text", "content")


def replaced(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project_id", "path")) -> DataFrame:
    """old with all rows of the documents in new exchanged for new's."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def load_knowledge(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of TOML files: pack_name, row_no, term, category, dynasty, rank, note. Blank periods go; of a term's entries in a period the first stays (by pack and row)."""
    rows = []
    for p in paths:
        with open(p, "rb") as f:
            entries = next((v for v in tomllib.load(f).values() if isinstance(v, list)), [])
        name = p.rsplit("/", 1)[-1].removesuffix(".toml")
        rows += [(name, i, *(str(e.get(k, "")) for k in ("term", "category", "dynasty", "rank", "note"))) for i, e in enumerate(entries)]
    made = spark.createDataFrame(rows, "pack_name string, row_no int, term string, category string, dynasty string, rank string, note string")
    first = made.where(F.trim("dynasty") != "").groupBy("dynasty", "term").agg(F.min(F.struct("pack_name", "row_no", "category", "rank", "note")).alias("x"))
    return first.select("x.pack_name", "x.row_no", "term", "x.category", "dynasty", "x.rank", "x.note")


def knowledge_summary(knowledge: DataFrame) -> DataFrame:
    return knowledge.groupBy("pack_name").agg(F.count("*").alias("entries"), F.array_join(F.array_sort(F.collect_set("dynasty")), ",").alias("dynasties"), F.min_by("category", "row_no").alias("pack_type"))
