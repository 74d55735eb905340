"""File sources and sinks with explicit schemas, and checks of files by size and hash."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.sources.arrow import open_file


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record a line; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A file with a header; every field is a string, an empty one is "" and not null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return rows.fillna("")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """journal_id, journal_name and issns as an array; ids and names must be unique, names by case folding."""
    rows = read_csv(spark, path, ["journal_id", "journal_name", "issns"])
    twice = rows.groupBy("journal_id").count().where("count > 1").unionByName(rows.groupBy(F.lower("journal_name").alias("journal_id")).count().where("count > 1"))
    if found := twice.limit(5).collect():
        raise ValueError(f"catalog rows repeat: {[r[0] for r in found]}")
    return rows.withColumn("issns", F.filter(F.split("issns", ";"), lambda x: x != ""))


def read_atom(spark: SparkSession, path: str, with_path: bool = False) -> DataFrame:
    """Entries of Atom feeds: id, title, summary, doi, categories, and the feed's path if wanted. Feeds over a megabyte, with a document type,
    an entity or a NUL, or not in UTF-8, are refused."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
    body = F.try_validate_utf8(F.col("content").cast("string"))
    marked = raw.select("path", body.alias("body"), ((F.col("length") > 1 << 20) | body.isNull() | F.coalesce(body.rlike("(?i)<!(?:DOCTYPE|ENTITY)|\\x00"), F.lit(True))).alias("bad"))
    checked = marked.where(F.assert_true(~F.col("bad"), F.concat(F.lit("refused feed "), F.col("path"))).isNull())
    entry = "struct<id:string,title:string,summary:string,doi:string,category:array<struct<_term:string,_scheme:string>>>"
    parsed = checked.select("path", F.from_xml("body", f"entry array<{entry}>", {"ignoreNamespace": "true"}).alias("feed"))
    e = parsed.select("path", F.explode("feed.entry").alias("e"))
    return e.select(*["path"] * with_path, "e.id", "e.title", "e.summary", "e.doi", F.transform("e.category", lambda c: F.struct(c["_term"].alias("term"), c["_scheme"].alias("scheme"))).alias("categories"))


#: Bytes of a file that a task holds while it hashes it.
CHUNK = 4 << 20


def stream_hash(path: str) -> str:
    """The SHA-256 of a file of any size, read piece by piece."""
    h, piece = hashlib.sha256(), bytearray(CHUNK)
    with open_file(path) as f:
        while n := f.readinto(piece):
            h.update(memoryview(piece)[:n])
    return h.hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under the folder path, named by their path below it. The listing is Spark's, which deals files
    to tasks by size and reads none of them; a task streams its files, so that one of any size takes CHUNK bytes."""
    bare = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"
    root = re.sub(bare, "/", path if re.match(bare, path) else os.path.abspath(path)).rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = found.select("path", "length")
    # a scan leaves out empty files; the names are in its listing, which the driver holds for any scan
    names = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in found.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(listed, "path", "left_anti")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = pa.array([stream_hash(p) for p in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hashes], ["path", "bytes", "sha256"])

    rows = listed.mapInArrow(each, "path string, bytes long, sha256 string")
    rows = rows.unionByName(empty.select("path", F.lit(0).cast("long").alias("bytes"), F.lit(hashlib.sha256().hexdigest()).alias("sha256")))
    return rows.select(F.expr(f"substr(regexp_replace(path, r'{bare}', '/'), {len(root) + 1})").alias("name"), "bytes", "sha256")


def differing_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names that one side lacks or whose size or hash differs."""
    m = manifest.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    return found.join(m, "name", "full_outer").where("NOT (bytes <=> _bytes AND sha256 <=> _sha)").select("name")


def write_jsonl(df: DataFrame, path: str) -> None:
    """A new folder of JSON lines, nulls kept; an existing one is an error."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("lineSep", "\n").option("escape", '"').csv(path)


def write_json_document(value, path: str) -> None:
    """A small local document, sorted and indented, replaced in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(f.name, path)


def side_outputs(df: DataFrame, parts: dict[str, Column], path: str) -> None:
    """Write the rows of each condition to a folder of its own under path, reading df's sources once."""
    kept = df.persist()
    try:
        for name, rows in parts.items():
            kept.where(rows).write.mode("errorifexists").parquet(f"{path}/{name}")
    finally:
        kept.unpersist()


def load_vectors(spark: SparkSession, path: str, expected: dict[str, str], dim: int) -> DataFrame:
    """(paper_id, embedding) of a table that also holds the model, revision and input hash of each vector; rows of
    another make, or of another dimension, are an error."""
    v = spark.read.parquet(path)
    made = F.lit(True)
    for name, value in expected.items():
        made = made & F.col(name).eqNullSafe(value)
    ok = F.coalesce(made & (F.size("embedding") == dim), F.lit(False))
    return v.where(F.assert_true(ok, F.concat(F.lit("vector of another make: "), F.col("paper_id"))).isNull()).select("paper_id", "embedding")


def manifest_violations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, violation) of the files found (name, bytes, sha256) against a manifest of the same columns: a name that leaves its
    folder (absolute, or with a part ".."), a file that is missing, unexpected, or changed."""
    m = manifest.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"), F.lit(True).alias("_listed"))
    both = found.withColumn("_found", F.lit(True)).join(m, "name", "full_outer")
    unsafe = F.col("name").isNull() | (F.col("name") == "") | F.col("name").startswith("/") | F.col("name").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | F.array_contains(F.split("name", r"[/\\\\]"), "..")
    same = F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("sha256").eqNullSafe(F.col("_sha"))
    first = F.when(unsafe, "unsafe name").when(F.col("_found").isNull(), "missing").when(F.col("_listed").isNull(), "unexpected").when(~same, "changed")
    return both.select("name", first.alias("violation")).where("violation IS NOT NULL")


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One row, digest: the SHA-256 of a manifest's files (one row a file) by name, whatever the order of rows."""
    files = F.array_sort(F.collect_list(F.struct("name", "bytes", "sha256")))
    return manifest.agg(F.sha2(F.to_json(files), 256).alias("digest"))


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder and all below it by the file systems of the two paths; an existing target is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    of, to = a.getFileSystem(conf), b.getFileSystem(conf)
    if to.exists(b):
        raise FileExistsError(f"already exists: {target}")
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(of, a, to, b, False, False, conf):
        raise OSError(f"not copied whole: {source}")
