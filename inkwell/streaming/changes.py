"""File-change streams: filter, debounce by session windows, incremental scans per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..sources.generations import Generations, Kept


def watched(events: DataFrame) -> DataFrame:
    """Events of text files; hidden files, backups and swap files go."""
    name = F.element_at(F.split("path", "/"), -1)
    return events.where(F.lower("path").rlike(r"\.(txt|md|markdown)$") & ~name.startswith(".") & ~name.startswith("~") & ~name.endswith("~") & ~name.endswith(".swp"))


def debounced(events: DataFrame, quiet: str = "800 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row per path and burst, out when nothing came for the quiet time. Works on streams and on tables."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    made = x.groupBy(F.session_window("ts", quiet).alias("w"), "project_id", "path").agg(F.count("*").alias("n_events"))
    return made.select("project_id", "path", F.col("w.start").alias("started"), F.col("w.end").alias("released"), "n_events")


#: What is known of each document after a batch.
FILES = {"files": Kept("project_id string, path string, content_hash string, last_modified_at timestamp, deleted boolean", ("project_id", "path"))}


def file_state(spark: SparkSession, folder: str) -> Generations:
    """The last known state of each document, batch by batch; a batch reads the buckets of its own paths, in log2 of the batches' number of runs at most."""
    return Generations(spark, f"{folder}/state", FILES)


def compared(state: Generations, batch: int, paths: DataFrame, there: DataFrame) -> DataFrame:
    """(project_id, path, state: created, modified, deleted or unchanged) of these paths against what was known before the batch; the same if the batch is repeated. there: the documents that are at these paths now."""
    return versions.classify_documents(state.read("files", keys=paths, before=batch), there)


def remember(state: Generations, batch: int, paths: DataFrame, there: DataFrame) -> bool:
    """Commits what is known of these paths now; False if the batch was committed before."""
    gone = paths.join(there, ["project_id", "path"], "left_anti").select("project_id", "path", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("timestamp").alias("last_modified_at"), F.lit(True).alias("deleted"))
    return state.commit(batch, files=there.select("project_id", "path", "content_hash", "last_modified_at", F.lit(False).alias("deleted")).unionByName(gone))


def scan_stream(released: DataFrame, read_documents, folder: str, checkpoint: str, then=None, **trigger):
    """Scans the documents that debounced() releases, batch by batch, against the last known state of each.

    read_documents(paths) gives project_id, path, content_hash, last_modified_at (and more) of those that are there. Each batch
    writes folder/states/batch=N (created, modified, deleted, unchanged) and commits what is known of its paths now to
    file_state(); a batch that is repeated after a failure writes the same folder again and commits once. then(states, documents,
    batch) goes on from there, to revisions, their impact and deltas.increment(), which is idempotent by batch too.
    """
    spark = released.sparkSession
    state = file_state(spark, folder)

    def scan(rows: DataFrame, batch: int) -> None:
        paths = rows.select("project_id", "path").distinct().persist()
        there = read_documents(paths).persist()
        compared(state, batch, paths, there).write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")
        remember(state, batch, paths, there)
        if then:
            then(spark.read.parquet(f"{folder}/states/batch={batch}"), there, batch)
        for x in (paths, there):
            x.unpersist()

    writer = released.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
