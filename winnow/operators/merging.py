"""Duplicate papers merged batch by batch: a kept table of keys and components that a batch contracts into.

The store holds members (papers with the root of their component) in buckets by root, and keys (kind, value, root) in buckets by key. A
batch reads the buckets of its own keys, joins its papers and the roots that they meet into components, and rewrites the buckets
of the components that it touched. Other buckets are not read, and their files stay as they are. What is current is said by one
small file for each version, made as the last step; of two batches at a time the second fails and may be given again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.components import connected_components
from winnow.operators.dedup import KEYS, identities
from winnow.shared import cut, kept
from winnow.sources.commit import Store


class MergedPapers:
    """papers: (paper_id string, title, and what else `identities` reads or the caller keeps), with the same columns in all batches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets, self.store = spark, path.rstrip("/"), buckets, Store(spark, path)

    # --- what is current -----------------------------------------------------------------------

    def state(self) -> dict:
        versions = self.store.names("versions")
        if not versions:
            return {"version": 0, "buckets": self.buckets, "members": {}, "keys": {}, "schema": None}
        return json.loads(self.store.read(f"versions/{versions[-1]}"))

    def _read(self, state: dict, table: str, schema: str, only: set[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for bucket, folder in sorted(state[table].items()) if only is None or bucket in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def members(self) -> DataFrame:
        """All papers, with keys and root, the least paper_id of their component."""
        state = self.state()
        return self._read(state, "members", state["schema"])

    def components(self) -> DataFrame:
        """(paper_id, root), as `dedup.groups` gives them for all papers at once."""
        return self.members().select("paper_id", "root").distinct()

    # --- a batch -------------------------------------------------------------------------------

    def _bucket(self, *cols: str):
        return F.pmod(F.xxhash64(*cols), F.lit(self.buckets)).cast("string").alias("bucket")

    def _write(self, rows: DataFrame, table: str, buckets: set[str], state: dict) -> dict[str, str]:
        """The folders of the table with those of these buckets replaced by the rows."""
        name = f"{table}/{state['version'] + 1:08d}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        made = {f.removeprefix("bucket="): f"{name}/{f}" for f in self.store.names(name) if f.startswith("bucket=")}
        return {b: f for b, f in state[table].items() if b not in buckets} | made

    def add(self, papers: DataFrame) -> int:
        """Merge a batch; the new version. Names of buckets and the roots that change are what reaches the driver or a broadcast join's limits."""
        state = self.state()
        if state["buckets"] != self.buckets:
            raise ValueError(f"the store has {state['buckets']} buckets")
        batch = cut(identities(papers).withColumn("keys", F.col("keys").cast(KEYS)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema) + ", root string"
        if state["schema"] not in (None, schema):
            raise ValueError("the columns differ from those of earlier batches")
        # a paper is found again by its id, too
        own = F.concat("keys", F.array(F.struct(F.lit("\0id").alias("kind"), F.col("paper_id").alias("value"))).cast(KEYS))
        by_key = cut(batch.select("paper_id", F.explode(own).alias("k")).select("paper_id", "k.kind", "k.value").withColumn("bucket", self._bucket("kind", "value")))
        asked = {r["bucket"] for r in by_key.select("bucket").distinct().collect()}  # `buckets` rows at most
        key_schema = "kind string, value string, root string"
        met = by_key.join(self._read(state, "keys", key_schema, asked), ["kind", "value"]).select("paper_id", F.col("root").alias("hub"))
        hubs = by_key.groupBy("kind", "value").agg(F.min("paper_id").alias("hub"))
        edges = by_key.join(hubs, ["kind", "value"]).select("paper_id", "hub").unionByName(met)
        parts = kept(connected_components(edges, "paper_id", "hub").select(F.col("node").alias("old"), F.col("component").alias("new")), "contracted")
        roots = kept(met.select(F.col("hub").alias("old")).distinct().join(parts, "old"), "roots")  # of the store, with what they become
        moved = roots.where("old <> new")
        # members: those of moved roots change their bucket, those that only gain papers stay where they are
        added = batch.join(parts.withColumnRenamed("old", "paper_id"), "paper_id").withColumnRenamed("new", "root").select(*batch.columns, "root")
        homes = roots.select(F.explode(F.array("old", "new")).alias("root")).unionByName(added.select("root"))
        touched = {r["bucket"] for r in homes.select(self._bucket("root")).distinct().collect()}
        change = lambda rows: rows.join(moved.withColumnRenamed("old", "root"), "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        before = self._read(state, "members", schema, touched)
        members = change(before).select(*batch.columns, "root").unionByName(added).withColumn("bucket", self._bucket("root"))
        # keys: those of the batch, and those of moved members
        left = before.join(moved.withColumnRenamed("old", "root"), "root", "left_semi").select("paper_id", F.explode(own).alias("k")).select("k.kind", "k.value")
        homes = by_key.select("bucket").unionByName(left.select(self._bucket("kind", "value")))
        keyed = {r["bucket"] for r in homes.distinct().collect()}
        new = by_key.join(parts.withColumnRenamed("old", "paper_id"), "paper_id").select("kind", "value", F.col("new").alias("root"))
        keys = change(self._read(state, "keys", key_schema, keyed)).select("kind", "value", "root").unionByName(new).distinct().withColumn("bucket", self._bucket("kind", "value"))
        done = {"version": state["version"] + 1, "buckets": self.buckets, "schema": schema, "members": self._write(members, "members", touched, state), "keys": self._write(keys, "keys", keyed, state)}
        if not self.store.create(f"versions/{done['version']:08d}", json.dumps(done)):
            raise RuntimeError("another batch was merged meanwhile: give this one again")
        return done["version"]
