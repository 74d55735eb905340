"""Merkle manifest of a table: a proof for every row, by fractal traversal of aligned blocks of leaves.

A row's leaf is the SHA-256 of its columns, each `-` if null, else its count of UTF-8 bytes, `:` and its text.
Leaves are ordered within their group; two consecutive nodes, or a last one alone, become their hash until one
remains, the group's subroot. Subroots, ordered by group (null first, by bytes), become the root alike.

Leaves get their positions from a range partitioning, blocks of 2 ** bits consecutive leaves are rows, and each
block is traversed with stacked subtrees: per level of `height` tree levels one existing subtree, on the path of
the current leaf, and one desired subtree to its right, which grows by two hashes a leaf and is ready when it is
needed. So a task holds a block's leaves and some 2 * 2 ** height nodes a level, whatever is emitted. The roots
of the blocks are leaves of the tree above, which is built by the same jobs; its paths join blocks, not rows.

A path is text: steps from leaf to root joined by commas, each `L` or `R` (the sibling's side) and the sibling's
hash, or `-` where the node is alone.

Rows that repeat an id are ordered by leaf, null ids come first; a null group is a group of its own. Rows that
are equal in all columns are leaves of their own, each with its proof. No rows, no result. Other columns of the
table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from winnow.llm.common import materialize, tidy
from winnow.operators.order import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(*values: Column) -> Column:
    """The leaf of a row with these values."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    steps = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, ","))
    side, sibling = (lambda s: F.substring(s, 1, 1)), (lambda s: F.substring(s, 2, 64))
    both = lambda h, s: F.when(side(s) == "L", F.concat(sibling(s), h)).otherwise(F.concat(h, sibling(s)))  # noqa: E731  "-" has no sibling
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(both(h, s), 256))


def siblings(path: Column) -> Column:
    """A path's sibling hashes, one after another."""
    return F.translate(path, "LR,-", "")


# --- the traversal of one block ---------------------------------------------------------------------


def _over(left: str | None, right: str | None) -> str | None:
    """The node above two; None is a node beyond the last leaf."""
    return hashlib.sha256((left + (right or "")).encode()).hexdigest() if left is not None else None


class Subtree:
    """Treehash over the leaves below the node `at` of height `top`; keeps the nodes of heights base to top - 1."""

    def __init__(self, leaves: list[str], base: int, top: int, at: int):
        self.leaves, self.base, self.top, self.at = leaves, base, top, at
        self.next, self.end = at << top, (at + 1) << top
        self.stack: list[tuple[int, str | None]] = []
        self.kept: list[list[str | None]] = [[] for _ in range(base, top)]
        self.root: str | None = None

    def step(self) -> bool:
        """One leaf or one hash more; whether there was anything to do."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            height, right = stack.pop()
            node = (height + 1, _over(stack.pop()[1], right))
        elif self.next < self.end:
            node = (0, self.leaves[self.next] if self.next < len(self.leaves) else None)
            self.next += 1
        else:
            return False
        stack.append(node)
        if node[0] == self.top:
            self.root = node[1]
        elif node[0] >= self.base:
            self.kept[node[0] - self.base].append(node[1])
        return True

    def finish(self) -> Subtree:
        while self.step():
            pass
        return self

    def sibling(self, leaf: int, height: int) -> tuple[int, str | None]:
        at = (leaf >> height) ^ 1
        return at, self.kept[height - self.base][at - (self.at << (self.top - height))]


def block_height(n: int, bits: int) -> int:
    """The height of a block's tree where its group has n nodes: less than `bits` only if the block is the whole group."""
    return min(bits, max(0, n - 1).bit_length())


def block_root(leaves: list[str], height: int) -> str | None:
    level = list(leaves)
    for _ in range(height):
        level = [_over(level[i], level[i + 1] if i + 1 < len(level) else None) for i in range(0, len(level), 2)]
    return level[0]


def traverse(leaves: list[str], height: int, subtree: int = 4) -> Iterator[str]:
    """The path of each leaf in turn within the block's tree of the given height."""
    spans = [(b, min(b + subtree, height)) for b in range(0, height, subtree)]
    exist = [Subtree(leaves, b, t, 0).finish() for b, t in spans]
    desired = [Subtree(leaves, b, t, 1) for b, t in spans[:-1]]
    for leaf in range(len(leaves)):
        steps = []
        for tree in exist:
            for h in range(tree.base, tree.top):
                at, sibling = tree.sibling(leaf, h)
                steps.append("-" if sibling is None else ("R" if at % 2 else "L") + sibling)
        yield ",".join(steps)
        for k, ready in enumerate(desired):
            if (leaf + 1) % (1 << ready.top) == 0 and leaf + 1 < len(leaves):
                exist[k], desired[k] = ready, Subtree(leaves, ready.base, ready.top, ready.at + 1)
            desired[k].step()
            desired[k].step()


# --- the tree over the table ------------------------------------------------------------------------


def _roots(blocks: DataFrame, bits: int) -> DataFrame:
    """(grp, block, n, hash): the root of each block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [block_root(b.column(3)[k].values.to_pylist(), block_height(b.column(2)[k].as_py(), bits)) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hashes, pa.string())], ["grp", "block", "n", "hash"])

    return blocks.select("grp", "block", "n", F.col("members.hash").alias("hashes")).mapInArrow(each, "grp string, block long, n long, hash string")


def _emit(blocks: DataFrame, bits: int, subtree: int) -> DataFrame:
    """(own, hash, path, *rest) of each member of blocks (n, members, above, ...): its path in the block, and then `above`."""
    own = blocks.schema["members"].dataType.elementType["own"].dataType
    rest = [f for f in blocks.schema.fields if f.name not in ("grp", "block", "n", "members", "above")]
    rows = blocks.select("n", "members", "above", *[f.name for f in rest])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                members, above = b.column(1)[k].values, b.column(2)[k].as_py()
                hashes = members.field("hash").to_pylist()
                paths = traverse(hashes, block_height(b.column(0)[k].as_py(), bits), subtree)
                for at in range(0, len(hashes), 1024):  # only so many paths at a time
                    some = members.slice(at, 1024)
                    steps = pa.array([",".join(filter(None, [next(paths), above])) for _ in range(len(some))], pa.string())
                    same = [pa.repeat(b.column(3 + i)[k], len(some)) for i in range(len(rest))]
                    yield pa.RecordBatch.from_arrays([some.field("own"), some.field("hash"), steps, *same], ["own", "hash", "path", *[f.name for f in rest]])

    schema = StructType([StructField("own", own), *StructType.fromDDL("hash string, path string").fields, *rest])
    return rows.mapInArrow(tidy(each), schema)


def _tree(nodes: DataFrame, bits: int, subtree: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes (grp, pos, n, hash, own): the blocks, each with `above`, its root's path, and the (grp, subroot) of all groups."""
    size = 1 << bits
    grouped = nodes.groupBy("grp", F.shiftright("pos", bits).alias("block"))
    members = F.sort_array(F.collect_list(F.struct("pos", "hash", "own"))).alias("members")  # 2 ** bits at most
    blocks = materialize(grouped.agg(F.first("n").alias("n"), members), "blocks")
    roots = materialize(_roots(blocks, bits), "roots")
    many = roots.where(F.col("n") > size)
    tops = roots.where(F.col("n") <= size).select("grp", F.col("hash").alias("subroot"))
    if many.isEmpty():
        return blocks.withColumn("above", F.lit("")), tops
    upper = many.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), "hash", F.struct("grp", "block").alias("own"))
    up, up_tops = _tree(upper, bits, subtree)
    above = materialize(_emit(up, bits, subtree).select("own.grp", "own.block", F.col("path").alias("above")), "above")
    return blocks.join(above, ["grp", "block"], "left").withColumn("above", F.coalesce("above", F.lit(""))), tops.unionByName(up_tops)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, bits: int = 12, subtree: int = 4) -> DataFrame:
    """Per row: id (the column `order`), the columns of carry, leaf, path (from leaf to root), subroot and root."""
    carry = carry or {}
    name = F.col(group).cast("string")
    own = F.struct(F.col(order).alias("id"), *[c.alias(k) for k, c in carry.items()])
    leaves = docs.select(F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("grp"), F.col(order).alias("id"), leaf_of(*map(F.col, fields)).alias("hash"), own.alias("own"))
    blocks, tops = _tree(positions(materialize(leaves, "leaves"), "grp", ["id", "hash"]).drop("id"), bits, subtree)
    # the groups' subroots are the leaves of one more tree, ordered by name
    tops = materialize(tops, "subroots")
    heads = tops.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("subroot").alias("hash"), F.struct(F.col("grp").alias("id")).alias("own"))
    lasts, last = _tree(positions(heads, "grp", ["id"]).drop("id"), bits, subtree)
    root = (last.first() or {"subroot": None})["subroot"]
    ways = _emit(lasts, bits, subtree).select(F.col("own.id").alias("grp"), F.col("hash").alias("subroot"), F.col("path").alias("last"))
    joined = blocks.select("grp", "block", "above").join(ways, "grp")  # a row a block: the rows of a large group are few here
    joined = joined.select("grp", "block", "subroot", F.concat_ws(",", F.nullif("above", F.lit("")), F.nullif("last", F.lit(""))).alias("above"))
    found = _emit(blocks.drop("above").join(joined, ["grp", "block"]), bits, subtree)
    return found.select("own.*", F.col("hash").alias("leaf"), "path", "subroot", F.lit(root).cast("string").alias("root"))


def tampering(docs: DataFrame) -> DataFrame:
    """Per row the manifest's proof, and what it says of a row whose n_chars was raised by 1 where 7 divides the id's CRC-32."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    values = [F.col(c) if c != "n_chars" else F.when(changed, F.col(c).cast("long") + 1).otherwise(F.col(c).cast("long")) for c in FIELDS]
    found = manifest(docs, carry={"read": F.when(changed & F.col("n_chars").isNotNull(), leaf_of(*values))})
    found = found.withColumn("folded_root", folded(F.coalesce("read", "leaf"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")), 256).alias("proof_sha256")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
