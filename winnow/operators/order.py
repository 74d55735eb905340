"""Places of rows in an order, without a window over a large group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from winnow.shared import kept


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (read from files, so that they come in the same order again) with pos, a row's place in its group by `order` from 0,
    null first, and n, the group's rows.

    Rows are dealt to tasks by ranges of group and order; a task numbers its rows, and counts by task give each range its start. Rows
    that are equal in `order` are dealt by their place in the table, so a group of any share, and any number of ties, is many tasks."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    at = spread.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), object(), -1
        for b in batches:
            nth = []
            for g in b.column(at).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                nth.append(n)
            yield b.append_column("_part", pa.array([part] * len(nth), pa.int32())).append_column("_nth", pa.array(nth, pa.int64()))

    schema = StructType([*spread.schema.fields, StructField("_part", IntegerType()), StructField("_nth", LongType())])
    dealt = kept(spread.mapInArrow(number, schema), "positions")
    counts = dealt.groupBy(F.col(group).alias("_group"), "_part").agg((F.max("_nth") + 1).alias("_count"))  # a row for each group in each range
    whole = Window.partitionBy("_group")
    starts = counts.select("_group", F.col("_part").alias("_of"), (F.sum("_count").over(whole.orderBy("_part")) - F.col("_count")).alias("_start"), F.sum("_count").over(whole).alias("n"))
    both = dealt.join(starts, dealt[group].eqNullSafe(starts["_group"]) & (dealt["_part"] == starts["_of"]))
    return both.select(*rows.columns, (F.col("_start") + F.col("_nth")).alias("pos"), "n")
