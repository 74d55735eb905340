"""Cursor-paged scans as a data source: `spark.read.format("saved_pages")`.

A scan asks for a page, is told the cursor of the next one, and goes on until a rule ends it; the cursor loop runs inside the
tasks. What it asks is a store of saved pages (nothing waits for a host), a folder that `save_pages` wrote: scans are dealt to
parts by the CRC-32 of their name, a partition of the source reads one part, and only pages that its loops reach are rows.

Options: `path`; `first`, the cursor of a first page (`*`); `pageSize`, `cap` as in `paging.followed`; `whole`: whether a scan that
did not give exactly as many items as its first page reported is an error; `scans`, a JSON list of names: parts that hold none of
them are not opened, and other scans are not walked. (Names are asked for by this option and not by pushed filters: Spark 4.1 keeps the
filters of a frame's first query with its Python reader, and later queries on the frame got that query's rows.)
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from winnow.sources.arrow import located

PAGE = "scan string, cursor string, next_cursor string, status int, items long, reported long"
ROW = f"scan string, page int, {PAGE.removeprefix('scan string, ')}, stop string"


def save_pages(pages: DataFrame, path: str, parts: int = 16) -> None:
    """Write pages (the columns of PAGE; others stay behind) as a new store."""
    of = F.pmod(F.crc32(F.col("scan").cast("string").cast("binary")), F.lit(parts)).cast("int")
    names = [c.split()[0] for c in PAGE.split(", ")]
    rows = pages.select(*[F.col(n).cast(k) for n, k in (c.split() for c in PAGE.split(", "))], F.lit(parts).alias("parts"), of.alias("part"))
    rows.repartition("part").sortWithinPartitions("part", *names[:2]).write.partitionBy("parts", "part").parquet(path)


def walk(pages: dict[str, dict], first: str, page_size: int | None, cap: int | None) -> Iterator[tuple[int, dict, str | None]]:
    """(page, what the store has, why the scan ends there) of one scan; pages: by cursor. A scan whose next page isn't
    saved has no reason to end: whoever fetches goes on there."""
    cursor, used, got = first, set(), 0
    while (found := pages.get(cursor)) is not None:
        used.add(cursor)
        page, items, onward, stop = len(used), found["items"] or 0, found["next_cursor"], None
        got += items
        if found["status"] is None or found["status"] >= 400:
            stop = "unavailable"
        elif cap is not None and got >= cap:
            stop = "cap"
        elif items == 0:
            stop = "empty"
        elif page_size is not None and items < page_size:
            stop = "last"
        elif not onward:
            stop = "no_cursor"
        elif onward in used:
            stop = "repeated_cursor"
        yield page, found, stop
        if stop:
            return
        cursor = onward


class Part(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        number = lambda k: int(options[k]) if options.get(k) else None
        self.path, self.first = options["path"].rstrip("/"), options.get("first", "*")
        self.page_size, self.cap = number("pagesize"), number("cap")
        self.whole = options.get("whole", "false").lower() == "true"
        self.scans: set[str] | None = set(json.loads(options["scans"])) if options.get("scans") else None

    def partitions(self) -> list[Part]:
        store, root = located(self.path)
        infos = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        folders = sorted(i.path for i in infos if i.type == fs.FileType.Directory and re.search(r"/parts=\d+/part=\d+$", i.path))
        if not folders and not any(i.type == fs.FileType.File for i in infos):
            raise FileNotFoundError(f"no store of pages: {self.path}")
        if self.scans is not None:
            held = lambda f, s: zlib.crc32(s.encode()) % int(re.search(r"parts=(\d+)", f)[1]) == int(f.rpartition("=")[2])
            folders = [f for f in folders if any(held(f, s) for s in self.scans)]
        return [Part(f) for f in folders] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.folder:
            return
        store, _ = located(self.path)
        columns = [c.split()[0] for c in PAGE.split(", ")]
        data = ds.dataset(partition.folder, filesystem=store, format="parquet")
        found = data.to_table(columns=columns, filter=None if self.scans is None else ds.field("scan").isin(pa.array(sorted(self.scans), pa.string())))
        scans: dict[str, dict[str, dict]] = {}
        for r in found.sort_by([("scan", "ascending")]).to_pylist():  # a part's pages
            scans.setdefault(r["scan"], {}).setdefault(r["cursor"], r)
        for name, pages in scans.items():
            got, reported = 0, None
            for page, r, stop in walk(pages, self.first, self.page_size, self.cap):
                if stop != "unavailable":
                    got += r["items"] or 0
                    reported = r["reported"] if page == 1 else reported
                yield (name, page, r["cursor"], r["next_cursor"], r["status"], r["items"], r["reported"], stop)
            if self.whole and got != reported:
                raise ValueError(f"records and total differ in {name}")


class SavedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))


def read_scans(spark: SparkSession, path: str, scans: list[str] | None = None, **options: object) -> DataFrame:
    """The pages that the scans of a store (or those named) reach, with `stop`, as `paging.followed` gives them."""
    spark.dataSource.register(SavedPages)
    reader = spark.read.format("saved_pages").option("path", path)
    for k, v in (options | {"scans": None if scans is None else json.dumps(scans)}).items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load()
