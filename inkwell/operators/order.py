"""Canonical order (path, chunk_index) of a project's chunks, without a task that holds a project.

Rows are dealt by range into segments and written, so a segment stays what it is. Whatever depends on order is then computed in
three steps: within a segment, per segment (one row each), and again within, with what the segments before it add up to. A project
may span all segments; the middle step has one row per project and segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stored import stored

PLACE = ("path", "chunk_index")


def own():
    return W.partitionBy("project_id", "segment").orderBy(*PLACE)


def before():
    """The project's segments before one: a row each."""
    return W.partitionBy("project_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)


def segmented(rows: DataFrame) -> DataFrame:
    """rows (project_id, path, chunk_index, and what is wanted of them: keep it narrow) with column segment."""
    narrow = stored(rows)  # so that finding the ranges does not read texts a second time
    return stored(narrow.repartitionByRange("project_id", *PLACE).withColumn("segment", F.spark_partition_id()))


def carried(rows: DataFrame, per_segment: Column, over: Column, empty: Column, out: str) -> DataFrame:
    """rows with column out: `over` the values (column x: per_segment of each segment) of the project's segments before, or empty."""
    sums = rows.groupBy("project_id", "segment").agg(per_segment.alias("x")).select(F.col("project_id").alias("p"), F.col("segment").alias("s"), F.coalesce(over.over(before()), empty).alias(out))
    return rows.join(sums, rows["project_id"].eqNullSafe(sums["p"]) & (rows["segment"] == sums["s"])).drop("p", "s")


def running_sum(rows: DataFrame, value: str, out: str) -> DataFrame:
    """segmented rows with column out: the sum of value up to here, this row included."""
    made = carried(rows, F.sum(value), F.sum("x"), F.lit(0), "__before")
    return made.withColumn(out, (F.col("__before") + F.sum(value).over(own().rowsBetween(W.unboundedPreceding, 0))).cast("long")).drop("__before")


def numbered(rows: DataFrame, out: str = "n") -> DataFrame:
    """segmented rows with column out: the 1-based place in the project."""
    made = carried(rows, F.count("*"), F.sum("x"), F.lit(0), "__before")
    return made.withColumn(out, (F.col("__before") + F.row_number().over(own())).cast("long")).drop("__before")


def with_previous(rows: DataFrame, value: Column, out: str = "last") -> DataFrame:
    """segmented rows with column out: value of the row before in the project, null for the first one."""
    row = F.struct(*PLACE, value.alias("v"))
    made = carried(rows, F.max(row), F.max("x"), F.lit(None), "__before")
    return made.withColumn(out, F.coalesce(F.lag(F.struct(value.alias("v"))).over(own()), F.when(F.col("__before").isNotNull(), F.struct(F.col("__before.v").alias("v"))))).withColumn(out, F.col(f"{out}.v")).drop("__before")


def last_where(rows: DataFrame, flag: str, n: str, out: str) -> DataFrame:
    """segmented, numbered rows with column out: the place of the last row up to here with the flag, 0 without one."""
    at = F.max(F.when(F.col(flag), F.col(n)))
    made = carried(rows, at, F.max("x"), F.lit(0), "__before")
    return made.withColumn(out, F.greatest(F.coalesce(at.over(own().rowsBetween(W.unboundedPreceding, 0)), F.lit(0)), "__before")).drop("__before")
