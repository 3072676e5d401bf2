"""Result and state tables that change together, batch by batch.

A commit writes the batch's rows of each table as a run of Parquet files, dealt by key into buckets, and then publishes one
manifest that names all runs of all tables. What is not in a manifest does not exist, so a commit that breaks off leaves no
trace, and a batch that is repeated writes the same runs again or, if it was published, nothing. Rows of one key are one row: that
of the last run, or the sum of all runs. Runs are merged as they come, small ones first, so a table has few of them whatever the
number of batches; a read names the keys that it wants and opens their buckets alone.

One batch is committed at a time (a streaming query's batches are). Files that no kept manifest names are removed at a commit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Kept:
    """A table: its columns, its key, the part of the key by which it is dealt and read (else the key), and columns that add up; rows whose sums are all 0 go. Without sums the last row of a key stays."""

    schema: str
    key: tuple[str, ...]
    by: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    buckets: int = 16

    @property
    def dealt(self) -> tuple[str, ...]:
        return self.by or self.key


def matches(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equal in these columns; null equals null."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


class Generations:
    #: Manifests that are kept, and with them what they name: a reader has so many commits' time.
    MANIFESTS = 3

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Kept]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    # ---- manifests ----

    def batches(self) -> list[int]:
        """The published batches whose manifests are kept."""
        at = self._path("manifest")
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of a batch under `before`: {"next": number of the next run, "runs": {table: [{"run", "rows"}]}}."""
        some = [b for b in self.batches() if before is None or b < before]
        if not some:
            return {"next": 0, "runs": {}}
        return self._said(some[-1])

    def _said(self, batch: int) -> dict:
        stream = self.fs.open(self._path(f"manifest/{batch:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, batch: int, manifest: dict) -> None:
        draft, final = self._path(f"manifest/.{batch:020d}.draft"), self._path(f"manifest/{batch:020d}.json")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self.fs.rename(draft, final):
            raise OSError(f"could not publish batch {batch} in {self.folder}")

    def _clean(self) -> None:
        batches = self.batches()
        for b in batches[: -self.MANIFESTS]:
            self.fs.delete(self._path(f"manifest/{b:020d}.json"), False)
        named = {(t, r["run"]) for b in batches[-self.MANIFESTS :] for t, runs in self._said(b)["runs"].items() for r in runs}
        for t in self.tables:
            at = self._path(t)
            for f in self.fs.listStatus(at) if self.fs.exists(at) else []:
                if (t, int(f.getPath().getName().removeprefix("run="))) not in named:
                    self.fs.delete(f.getPath(), True)

    # ---- rows ----

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.hash(*self.tables[name].dealt), F.lit(self.tables[name].buckets)).cast("int")

    def _stored(self, name: str, runs: list[dict], keys: DataFrame | None = None) -> DataFrame:
        """The rows of some runs, as written; of the buckets that hold the keys, if keys are given."""
        t = self.tables[name]
        schema = f"{t.schema}, run long, bucket int"
        if not runs:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/run={r['run']}" for r in runs])
        if keys is None:
            return rows
        wanted = keys.select(*t.dealt).select(self._bucket(name).alias("b")).distinct().collect()  # at most the number of buckets
        rows = rows.where(F.col("bucket").isin([r.b for r in wanted]))
        return rows.join(keys.select(*t.dealt).distinct(), matches(rows, keys, t.dealt), "left_semi")

    def _net(self, name: str, rows: DataFrame) -> DataFrame:
        t, columns = self.tables[name], self._columns(name)
        if t.sums:
            return rows.groupBy(*t.key).agg(*[F.sum(c).alias(c) for c in t.sums]).where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in t.sums])).select(*columns)
        rest = [c for c in columns if c not in t.key]
        return rows.groupBy(*t.key).agg(F.max_by(F.struct(*rest), "run").alias("x")).select(*[c if c in t.key else F.col(f"x.{c}").alias(c) for c in columns])

    def read(self, name: str, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """A table as the newest batch (under `before`) left it; of these keys alone, if given (with the columns by which it is dealt)."""
        return self._net(name, self._stored(name, self.manifest(before)["runs"].get(name, []), keys))

    def _write(self, name: str, run: int, rows: DataFrame) -> int:
        """The number of rows written. The number of a run that was never published may be used again: it is overwritten."""
        path = f"{self.folder}/{name}/run={run}"
        counted = Observation()
        made = rows.select(*self._columns(name), self._bucket(name).alias("bucket")).repartition("bucket")
        made.observe(counted, F.count("*").alias("rows")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return counted.get["rows"]

    def _columns(self, name: str) -> list[str]:
        return StructType.fromDDL(self.tables[name].schema).names

    def commit(self, batch: int, **rows: DataFrame) -> bool:
        """Adds a batch's rows to their tables, all or none; False if the batch was published before. Batches rise.

        Without sums a table's rows of one batch must differ in their keys.
        """
        if batch in self.batches():
            return False
        now = self.manifest()
        if self.batches() and batch < self.batches()[-1]:
            raise ValueError(f"batch {batch} comes after {self.batches()[-1]}")
        for name, some in rows.items():
            runs = now["runs"].setdefault(name, [])
            n = self._write(name, now["next"], some)
            if n:
                runs.append({"run": now["next"], "rows": n})
            now["next"] += 1
            # each run is over twice as large as the one behind it, so n batches leave log2 n runs at most
            last = len(runs)
            while last > 1 and runs[last - 2]["rows"] <= 2 * sum(r["rows"] for r in runs[last - 1 :]):
                last -= 1
            if last < len(runs):
                together = runs[last - 1 :]
                n = self._write(name, now["next"], self._net(name, self._stored(name, together)))
                runs[last - 1 :] = [{"run": now["next"], "rows": n}] if n else []
                now["next"] += 1
        self._publish(batch, now)
        self._clean()
        return True
