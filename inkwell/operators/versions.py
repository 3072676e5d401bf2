"""Versions: what changed between two states of a project, what that touches, which tasks follow; tags of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["project_id", "path", "chunk_index"]


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed and modified chapters by index; unchanged ones are left out."""
    a = old.select(*KEY, F.col("title").alias("old_title"), F.col("content_hash").alias("old_hash"))
    b = new.select(*KEY, F.col("title").alias("new_title"), F.col("content_hash").alias("new_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when((F.col("old_hash") != F.col("new_hash")) | (F.col("old_title") != F.col("new_title")), "modified")
    return a.join(b, KEY, "full_outer").select(*KEY, kind.alias("kind"), "old_title", "new_title").where(F.col("kind").isNotNull())


def classify_documents(old: DataFrame, listing: DataFrame) -> DataFrame:
    """created, unchanged, modified or deleted. old, listing: project_id, path, content_hash, last_modified_at (old also deleted)."""
    a = old.where("NOT deleted").select("project_id", "path", F.col("content_hash").alias("h0"), F.col("last_modified_at").alias("t0"))
    b = listing.select("project_id", "path", F.col("content_hash").alias("h1"), F.col("last_modified_at").alias("t1"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "deleted").when(F.col("h0").isNull(), "created").when(F.coalesce(F.col("t0") == F.col("t1"), F.lit(False)) | (F.col("h0") == F.col("h1")), "unchanged").otherwise("modified")
    return a.join(b, ["project_id", "path"], "full_outer").select("project_id", "path", state.alias("state"))


def removed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of old that are gone or have another content."""
    return old.join(new.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def live_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of documents that are there and not deleted, with document_title. docs: project_id, path, title, deleted."""
    live = docs.where("NOT coalesce(deleted, false)").select("project_id", "path", F.col("title").alias("document_title"))
    return chunks.join(live, ["project_id", "path"])


def with_evidence(rows: DataFrame, chunks: DataFrame, docs: DataFrame, by: str = "first_chunk_id", width: int = 80) -> DataFrame:
    """rows (candidates, foreshadows) with path, title and snippet of the chunk that column `by` names; rows without a live chunk go.

    Only narrow columns of the chunks meet the rows.
    """
    said = live_chunks(chunks.select("project_id", "path", "chunk_id", F.col("title").alias("chapter_title"), F.substring("content", 1, width).alias("snippet")), docs)
    return rows.join(said.select(F.col("chunk_id").alias(by), F.col("path").alias("document_path"), "document_title", "chapter_title", "snippet"), by)


def scan_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per document and state change: project_id, path, event, old and new hash. Documents that stay as they are have none."""
    a = old.select("project_id", "path", F.col("content_hash").alias("old_hash"))
    b = new.select("project_id", "path", F.col("content_hash").alias("new_hash"))
    event = F.when(F.col("old_hash").isNull(), "created").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return a.join(b, ["project_id", "path"], "full_outer").select("project_id", "path", event.alias("event"), "old_hash", "new_hash").where("event IS NOT NULL")


def revision_impact(removed: DataFrame, nodes: DataFrame, fores: DataFrame, rules: DataFrame) -> DataFrame:
    """Per project: what refers to removed chunks, and a summary text."""
    ids = removed.select("chunk_id").distinct()
    refs = nodes.select("project_id", F.lit("node").alias("kind"), "name", F.col("first_chunk_id").alias("chunk_id")).unionByName(fores.select("project_id", F.lit("foreshadow").alias("kind"), F.col("title").alias("name"), F.col("first_chunk_id").alias("chunk_id"))).unionByName(rules.select("project_id", F.lit("rule").alias("kind"), "name", F.col("source_chunk_id").alias("chunk_id")))
    hit = refs.join(ids, "chunk_id", "left_semi")
    some = hit.groupBy("project_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("node", "foreshadow", "rule")], F.array_sort(F.collect_set(F.concat_ws(":", "kind", "name"))).alias("touched"))
    every = removed.select("project_id").distinct().join(some, "project_id", "left").na.fill(0, ["nodes", "foreshadows", "rules"])
    total = F.col("nodes") + F.col("foreshadows") + F.col("rules")
    return every.withColumn("summary", F.when(total == 0, "无影响").otherwise(F.format_string("%d/%d/%d", "nodes", "foreshadows", "rules")))


def impact_tasks(impact: DataFrame) -> DataFrame:
    return impact.where("summary != '无影响'").select("project_id", F.lit("revision_impact").alias("task_type"), F.col("summary").alias("title"), F.lit("medium").alias("priority"))


def auto_tasks(issues: DataFrame, fores: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks for high issues and high-risk foreshadows that have none. issues need issue_id, fores foreshadow_id; tasks: source_id."""
    a = issues.where("severity = 'high'").select("project_id", F.col("issue_id").alias("source_id"), F.concat(F.lit("[冲突] "), "title").alias("title"), F.lit("conflict").alias("task_type"), F.lit("high").alias("priority"))
    b = fores.where("risk_level = 'high'").select("project_id", F.col("foreshadow_id").alias("source_id"), F.concat(F.lit("[伏笔] "), "title").alias("title"), F.lit("foreshadow").alias("task_type"), F.lit("medium").alias("priority"))
    return a.unionByName(b).join(tasks.select("source_id").distinct(), "source_id", "left_anti")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per changed document: counts and the list of changes."""
    d = diff_chunks(old, new)
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "modified")]
    return d.groupBy("project_id", "path").agg(*counts, F.array_sort(F.collect_list(F.struct("chunk_index", "kind", "old_title", "new_title"))).alias("diff"))


def resume(listing: DataFrame, scanned: DataFrame) -> DataFrame:
    return listing.join(scanned.select("project_id", "path").distinct(), ["project_id", "path"], "left_anti")


def upsert(old: DataFrame, batch: DataFrame, key: list[str], keep: tuple[str, ...] = ("status", "created_at", "first_chunk_id"), order: str = "seq") -> DataFrame:
    """batch into old by key: the last row of a key in a batch wins (by order); the columns in keep stay as old has them."""
    last = batch.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("__n = 1").drop("__n", order)
    names = [c for c in old.columns if c not in key]
    a = old.select(*key, *[F.col(c).alias(f"a_{c}") for c in names], F.lit(True).alias("in_a"))
    b = last.select(*key, *[F.col(c).alias(f"b_{c}") for c in names], F.lit(True).alias("in_b"))
    one = lambda c: F.when(F.col("in_a") & (F.lit(c in keep) | F.col("in_b").isNull()), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    return a.join(b, key, "full_outer").select(*key, *[one(c).alias(c) for c in names])


STATUSES = ("candidate", "active", "confirmed", "false_positive", "intentional", "deferred", "discarded", "open", "resolved")


def apply_status(table: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Sets statuses by key; an unknown status raises when the row is read."""
    ok = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))))
    return table.join(updates.select(*key, ok.alias("__new")), key, "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def latest_volume(assigned: DataFrame) -> DataFrame:
    """A document's volume is the one assigned last. assigned: document_id, volume_id, seq."""
    return assigned.groupBy("document_id").agg(F.max_by("volume_id", "seq").alias("volume_id"))


def documents_by(bridge: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """Live documents of each tag; links count once."""
    return bridge.select("document_id", tag).distinct().join(docs.where("NOT deleted").select("document_id", "path"), "document_id")


SEVERITY = ("serious", "high", "medium", "low")


def ranked(col: str, order: tuple[str, ...]):
    return F.coalesce(*[F.when(F.col(col) == v, i) for i, v in enumerate(order)], F.lit(len(order)))


def list_issues(issues: DataFrame, limit: int, prefix: str = "", updated: str = "updated_at") -> DataFrame:
    return issues.where(F.col("issue_type").startswith(prefix)).orderBy(ranked("severity", SEVERITY), F.desc(updated), "issue_type", "title").limit(limit)


def list_foreshadows(fores: DataFrame, limit: int, updated: str = "updated_at") -> DataFrame:
    return fores.orderBy(F.desc(updated), "title", "project_id").limit(limit)


def list_tasks(tasks: DataFrame, limit: int, created: str = "created_at") -> DataFrame:
    return tasks.orderBy(ranked("priority", ("high", "medium")), F.desc(created), "title").limit(limit)


def newest(rows: DataFrame, limit: int, by: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(limit)
