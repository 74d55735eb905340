"""Token counts through a digest cache.

A text's key is the SHA-256 of its content with white space collapsed (which the vocabulary drops, so
counts agree) and of the tokenizer file. Keys are joined to stored counts; only distinct misses are
encoded, and appended to the cache. Texts cross the network once, and only to meet the list of misses.

Null texts count as empty. Repeated rows share a key and are each returned. Rows whose id is null take
part too. Texts of any length are encoded whole. Empty tables give no rows; a cache path without a table is
an empty cache. A vocabulary in which white space counts is refused, as its digests would not be right.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, shared_path, small_slices, text_of
from winnow.llm.tokens import encoder, vocabulary

CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(file: str) -> str:
    return hashlib.sha256(Path(file).read_bytes()).hexdigest()


@functools.cache
def _drops_space(file: str) -> bool:
    library, one = encoder(file).library, "Ab, c 1"
    return all(library.encode(t, add_special_tokens=False).ids == library.encode(one, add_special_tokens=False).ids for t in (one.replace(" ", "\n\n"), one.replace(" ", " \t "), f"  {one}\r\n"))


def content_digest(text: Column) -> Column:
    """Of the text with runs of ASCII white space as one space, and none at the ends."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(text, r"[\t\n\r ]+", " ")).cast("binary"), 256))


def _exists(spark, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def count_tokens(docs: DataFrame, cache: str | None = None, file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, digest. cache: the path of the stored counts, kept between calls."""
    spark, file = docs.sparkSession, file or vocabulary()
    if not _drops_space(file):
        raise ValueError(f"{file}: white space counts in this vocabulary")
    version, cache = tokenizer_version(file), cache or shared_path(docs.sparkSession, "token-cache")
    rows = modest_batches(docs).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    keyed = materialize(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest")), "keyed")
    stored = spark.read.schema(CACHE).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE)
    stored = stored.where(F.col("version") == version).dropDuplicates(["digest"])
    misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(stored, "digest", "left_anti")
    # one row of each missing text; the digest is tested again, as an id may stand for several texts
    texts = rows.join(misses, F.col("doc_id").eqNullSafe(F.col("rep"))).where(content_digest(F.col("text")) == F.col("digest")).select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for whole in batches:
            for b in small_slices(whole, 1, 4 << 20):
                counts = [len(enc.encode(t)) // 4 for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    texts.mapInArrow(encode, CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).dropDuplicates(["digest"])
    counts = materialize(counts.select("digest", "n_tokens"), "counts")  # so that the join may split a digest with many rows
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", "digest")
