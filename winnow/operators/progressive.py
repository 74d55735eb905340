"""Quotas filled from the front of an ordered table: files are read in growing sets until every stratum has its rows.

The table's files need not be apart in the order column, only bounded: Parquet footers tell the least and the largest value of each.
Read by their least values, rows below the least value of all files not yet read are settled, whatever those hold. A stratum with
as many settled rows as its quota is full; later sets are read for the others only, and none is read once all are full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.shared import kept
from winnow.sources.arrow import open_file


def write_ordered(df: DataFrame, order: list[str], path: str, files: int) -> None:
    """A new table whose files are ranges of the order."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)


def file_bounds(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(file, rows, least, most) of a table's files from their footers; nulls where a file doesn't tell, or has rows without a value."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    kind = spark.read.parquet(path).schema[column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, least, most = [], [], []
            for p in b.column(0).to_pylist():
                with open_file(p) as f:
                    about = pq.ParquetFile(f).metadata
                at = about.schema.names.index(column)
                stats = [about.row_group(g).column(at).statistics for g in range(about.num_row_groups)]
                told = all(s is not None and s.has_min_max and s.null_count == 0 for s in stats) and bool(stats)
                rows.append(about.num_rows)
                least.append(min(s.min for s in stats) if told else None)
                most.append(max(s.max for s in stats) if told else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.int64()), pa.array(least), pa.array(most)], ["file", "rows", "least", "most"])

    return listed.mapInArrow(each, f"file string, rows long, least {kind}, most {kind}")


def take_progressively(spark: SparkSession, path: str, stratum: str, order: list[str], quota: DataFrame, where=None, start: int = 1) -> tuple[DataFrame, list[str]]:
    """The first `quota` rows of each stratum of the table at path by the columns `order` (ascending, null first; the first of them is the
    one whose bounds are used), of those rows for which `where` holds; and the files that were read for them.

    quota: (stratum, quota). The driver holds the list of files, as it does for any read. Rows that are equal in all of `order` may be
    taken in any order, as with a plain rank."""
    bounds = sorted(file_bounds(spark, path, order[0]).where("rows > 0").collect(), key=lambda r: (r["least"] is not None, r["least"], r["file"]))
    schema = spark.read.parquet(path).schema
    wanted = kept(quota.select(stratum, "quota").where("quota > 0"), "quota")
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(*[F.asc_nulls_first(c) for c in order]))
    taken, still, at, size = spark.createDataFrame([], schema), wanted, 0, start
    while at < len(bounds) and not still.isEmpty():
        some = [r["file"] for r in bounds[at : at + size]]
        at, size = at + len(some), 2 * size
        rows = spark.read.schema(schema).parquet(*some)
        rows = (rows.where(where) if where is not None else rows).join(F.broadcast(still.select(stratum)), stratum, "left_semi").select(*schema.names)
        both = taken.unionByName(rows).withColumn("_turn", turn).join(wanted, stratum).where("_turn <= quota")
        taken = kept(both.select(*schema.names), "taken")
        if at < len(bounds):
            limit = bounds[at]["least"]
            settled = taken.where(F.lit(False) if limit is None else F.coalesce(F.col(order[0]) < F.lit(limit), F.lit(True)))
            full = settled.groupBy(stratum).agg(F.count("*").alias("_n"))
            still = kept(wanted.join(full, stratum, "left").where("coalesce(_n, 0) < quota").select(stratum, "quota"), "still")
    return taken, [r["file"] for r in bounds[:at]]
