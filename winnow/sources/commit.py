"""Writing that is seen whole or not at all: several outputs together, and runs that go on where they ended.

Rows are written to a folder of their own, by a name that no other attempt has. What makes them count is one step of the
file system: a rename of the folder that holds all outputs, or the creation of a small entry file that names the folder.
Creation fails where the entry is there already, so of two attempts one counts. (On a store whose renames copy, use the
entries: `Ledger` needs no rename.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


class Store:
    """The file system of a folder, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new small file; False if there is one."""
        try:
            out = self.fs.create(self.at(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self.exists(name):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        size = self.fs.getFileStatus(self.at(name)).getLen()
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()

    def rename(self, source: str, to: str) -> None:
        if not self.fs.rename(self.at(source), self.at(to)):
            raise OSError(f"not renamed: {self.root}/{source}")

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)


def write_together(spark: SparkSession, outputs: dict[str, DataFrame], path: str) -> None:
    """Write each output as a folder of Parquet files below path. All appear at once, by one rename; where one fails, none does,
    and nothing is left. An existing path is an error."""
    parent, _, name = path.rstrip("/").rpartition("/")
    store = Store(spark, parent)
    if store.exists(name):
        raise FileExistsError(f"already exists: {path}")
    staged = f".{name}-{uuid.uuid4().hex}"
    try:
        for part, df in outputs.items():
            df.write.parquet(f"{parent}/{staged}/{part}")
        if store.exists(name):  # a rename onto a folder would go into it
            raise FileExistsError(f"already exists: {path}")
        store.rename(staged, name)
    finally:
        if store.exists(staged):
            store.delete(staged)


class Ledger:
    """Parts of a run, each committed once: `entries/<part>` names the folder below `rows/` that holds its rows.

    A run that was ended, wherever, is started anew: parts with an entry are left alone, others are made again in a folder of their
    own; rows of attempts without an entry are never read. `sweep` deletes them, for when no run is going on.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def done(self) -> set[str]:
        return set(self.store.names("entries"))

    def commit(self, part: str, rows: DataFrame) -> bool:
        """Write the rows of a part and enter it; False if it is there already, or another attempt was first."""
        if self.store.exists(f"entries/{part}"):
            return False
        folder = f"rows/{part}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        if self.store.create(f"entries/{part}", json.dumps({"folder": folder})):
            return True
        self.store.delete(folder)
        return False

    def run(self, parts: Iterable[str], make: Callable[[str], DataFrame]) -> list[str]:
        """Make and commit the parts that are not done, in turn; the names of those that this run made."""
        done = self.done()
        return [p for p in parts if p not in done and self.commit(p, make(p))]

    def each_batch(self, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch's id is its part, so a batch that a restarted stream brings again counts once."""
        return lambda df, batch: self.commit(f"batch-{batch:012d}", change(df)) and None

    def folders(self) -> list[str]:
        return [json.loads(self.store.read(f"entries/{p}"))["folder"] for p in sorted(self.done())]

    def read(self) -> DataFrame:
        """The rows of all committed parts."""
        found = [f"{self.path}/{f}" for f in self.folders()]
        if not found:
            raise FileNotFoundError(f"no part is committed in {self.path}")
        return self.spark.read.parquet(*found)

    def sweep(self) -> int:
        """Delete the folders of attempts that did not count; how many."""
        lost = set(self.store.names("rows")) - {f.removeprefix("rows/") for f in self.folders()}
        for name in lost:
            self.store.delete(f"rows/{name}")
        return len(lost)
