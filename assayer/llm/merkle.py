"""Merkle manifest of a dataset, in blocks of van Emde Boas layout.

The rows of a group (a language) are the leaves of a binary hash tree.  The tree
is cut into aligned subtrees of ``height`` levels, the blocks; their roots are
the leaves of the next level of blocks, and so on up to one root per group.  The
roots of the groups are then the leaves of one last tree.  A block is a row: its
nodes lie in one binary value in van Emde Boas order, the top half of the
levels first and then every bottom half, each laid out the same way.  Where a
node lies follows from its level and place alone, for building and for siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.common import arrow_batches, stage
from assayer.operators.numbering import number_rows

#: Levels of a block: 4,096 leaves and 8,191 nodes of 32 bytes at most.
HEIGHT = 12
WIDTH = 32
#: Columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@lru_cache(maxsize=64)
def addresses(height: int) -> np.ndarray:
    """Address of every node of a full tree with ``height`` levels above the leaves.

    Entry ``2**depth - 1 + place`` belongs to the node at that depth.  A tree of L
    levels is stored as its upper L // 2 levels, then the subtrees below them
    from left to right, each of them by the same rule.
    """
    levels = height + 1
    if levels == 1:
        return np.zeros(1, dtype=np.int64)
    upper = levels // 2
    top, bottom = addresses(upper - 1), addresses(levels - upper - 1)
    out = np.empty(2**levels - 1, dtype=np.int64)
    out[: len(top)] = top
    for depth in range(upper, levels):
        inside = depth - upper
        rows = bottom[2**inside - 1 : 2 ** (inside + 1) - 1]
        first = len(top) + np.arange(2**upper) * len(bottom)
        out[2**depth - 1 : 2 ** (depth + 1) - 1] = (first[:, None] + rows[None, :]).ravel()
    return out


def node_address(height: int, level: int, place: int) -> int:
    """Address of the node ``level`` levels above the leaves, ``place`` from the left."""
    return int(addresses(height)[2 ** (height - level) - 1 + place])


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def build_block(leaves: list[str], height: int) -> tuple[bytes, str]:
    """Nodes of a block in van Emde Boas order, and its root.

    Where the leaves are fewer than 2**height, the last node of a level may stand
    alone; it is hashed by itself on every level up to the root.  Places without
    a node hold zeros.
    """
    nodes = bytearray(WIDTH * (2 ** (height + 1) - 1))
    row, level = leaves, 0
    while True:
        base = 2 ** (height - level) - 1
        for at, node in zip(addresses(height)[base : base + len(row)].tolist(), row, strict=True):
            nodes[WIDTH * at : WIDTH * at + WIDTH] = bytes.fromhex(node)
        if level == height:
            return bytes(nodes), row[0]
        row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)]
        level += 1


def siblings(nodes: bytes, height: int, leaves: int, place: int) -> list[tuple[int, str]]:
    """(side, hex digest) from the leaf up: -1 left, 1 right, 0 and no text where a node stands alone."""
    out, width = [], leaves
    for level in range(height):
        other = place ^ 1
        if other < width:
            at = WIDTH * node_address(height, level, other)
            out.append((other - place, nodes[at : at + WIDTH].hex()))
        else:
            out.append((0, ""))
        place, width = place // 2, -(-width // 2)
    return out


def fold(leaf: str, path: Iterable[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for side, other in path:
        leaf = digest(other, leaf) if side < 0 else digest(leaf, other)
    return leaf


def height_of(block: int, leaves: int, height: int) -> int:
    """Levels of a block: full ones but for a group's only block, which stops at one node."""
    return height if block else min(height, (leaves - 1).bit_length())


def pack_path(path: list[tuple[int, str]]) -> bytes:
    return b"".join(bytes([side + 1]) + bytes.fromhex(text) for side, text in path)


def unpack_path(data: bytes) -> list[tuple[int, str]]:
    out, at = [], 0
    while at < len(data):
        side, width = data[at] - 1, WIDTH if data[at] != 1 else 0
        out.append((side, data[at + 1 : at + 1 + width].hex()))
        at += 1 + width
    return out


def field(column: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Python objects, one at a time: a row here is a whole block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# --- blocks -----------------------------------------------------------------------

_BLOCK = "tree string, block long, height int, leaves int, nodes binary, root string"
_BLOCK_ARROW = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("height", pa.int32()), ("leaves", pa.int32()), ("nodes", pa.binary()), ("root", pa.string())]
)
_WAY = "tree string, place long, above binary, subroot string, root string"
_WAY_ARROW = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("above", pa.binary()), ("subroot", pa.string()), ("root", pa.string())])


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """Blocks of one level: ``rows`` has tree, place and node; a block gathers 2**height rows at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            leaves = [m["node"] for m in r["members"]]
            own = height_of(r["block"], len(leaves), height)
            nodes, root = build_block(leaves, own)
            yield arrow_batches({"tree": [r["tree"]], "block": [r["block"]], "height": [own], "leaves": [len(leaves)], "nodes": [nodes], "root": [root]}, _BLOCK_ARROW)

    grouped = rows.groupBy("tree", F.shiftright("place", height).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("members"))
    return grouped.mapInArrow(run, _BLOCK)


def _tower(rows: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Staged levels of blocks, until every tree has one block."""
    levels = []
    while True:
        level = stage(_blocks(rows, height), f"{name}-{len(levels)}")
        levels.append(level)
        if not (level.agg(F.max("block")).first()[0] or 0):
            return levels
        rows = level.select("tree", F.col("block").alias("place"), F.col("root").alias("node"))


def _inner_paths(level: DataFrame) -> DataFrame:
    """tree, place, path, up: what a block adds to the way up from each of its leaves, and what lies above it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            n, first = r["leaves"], r["block"] << r["full"]
            above = [pack_path(siblings(r["nodes"], r["height"], n, p)) + r["above"] for p in range(n)]
            places = list(range(first, first + n))
            yield arrow_batches({"tree": [r["tree"]] * n, "place": places, "above": above, "subroot": [r["subroot"]] * n, "root": [r["top"]] * n}, _WAY_ARROW)

    return level.mapInArrow(run, _WAY)


class Manifest:
    """The blocks of a dataset: ``levels`` of the groups, then ``top`` over the groups' roots.

    ``leaves`` is the staged table of leaves: tree, place, node and the columns
    kept beside them.  ``root`` is the root as a one-row table, with no row when
    the dataset is empty.
    """

    def __init__(self, leaves: DataFrame, height: int = HEIGHT):
        self.leaves, self.height = leaves, height
        self.levels = _tower(leaves.select("tree", "place", "node"), height, "blocks")
        groups = self.levels[-1].select("tree", "root").withColumn("_null", F.col("tree").isNotNull())
        groups = stage(number_rows(stage(groups, "groups"), ["_null", "tree"], (), "place"), "subroots")
        self.groups = groups
        self.top = _tower(groups.select(F.lit("").alias("tree"), "place", F.col("root").alias("node")), height, "top")

    @property
    def root(self) -> DataFrame:
        return self.top[-1].select("root")

    def write(self, path: str) -> None:
        """All blocks as one Parquet table, with the level they belong to."""
        kinds = [("group", i, b) for i, b in enumerate(self.levels)] + [("top", i, b) for i, b in enumerate(self.top)]
        for kind, i, blocks in kinds:
            blocks.select(F.lit(kind).alias("kind"), F.lit(i).alias("level"), "*").write.mode("append").parquet(path)

    def _above(self, levels: list[DataFrame], start: DataFrame) -> DataFrame:
        """Ways up from the blocks of the lowest level, beginning with those of the highest."""
        above = start
        for level in reversed(levels[1:]):
            above = stage(_inner_paths(self._with(level, above)), "ways")
        return above

    def _with(self, level: DataFrame, above: DataFrame) -> DataFrame:
        """Blocks of a level, each with the way up from it."""
        right = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "above", "subroot", F.col("root").alias("top"))
        joined = level.join(right, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_place")))
        return joined.drop("_tree", "_place").withColumn("full", F.lit(self.height))

    def blocks_with_paths(self) -> DataFrame:
        """The lowest blocks with the way from each block's root to the root of all, its group's root and that root."""
        root = self.top[-1].select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("place"), F.lit(b"").alias("above"), "root").withColumn("subroot", F.lit(None).cast("string"))
        of_groups = _inner_paths(self._with(self.top[0], self._above(self.top, root))).select("place", "above", F.col("root").alias("top"))
        groups = self.groups.join(of_groups, "place").select("tree", F.lit(0).cast("long").alias("place"), "above", F.col("root").alias("subroot"), F.col("top").alias("root"))
        return self._with(self.levels[0], self._above(self.levels, stage(groups, "ways")))


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
)


def document_leaves(docs: DataFrame, group: str = "lang", key: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """Staged leaves of documents: tree, place, node, doc_id and ``claim``.

    ``node`` is the hash of the row's fields and ``claim`` the one that a holder
    of the row would compute: another where ``tampered`` is true, as n_chars
    counts one more there, unless it is null.  A tree orders its leaves by the
    key (null first); rows of one key by their hash, so that equal rows may stand
    for each other.
    """
    columns = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + F.lit(1) if c == "n_chars" else F.col(c) for c in FIELDS]
    claim = leaf_of(columns) if tampered is None else F.when(tampered, leaf_of(changed)).otherwise(leaf_of(columns))
    rows = docs.select(F.col(group).cast("string").alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf_of(columns).alias("node"), claim.alias("claim"))
    return stage(number_rows(stage(rows, "leaves"), ["doc_id", "node"], ["tree"], "place"), "numbered")


def verify_documents(manifest: Manifest) -> DataFrame:
    """A row per document: its leaf, its group's root, the root of all, its proof and the check of it.

    ``proof_sha256`` hashes the siblings from the leaf to the root of all, and
    ``folded_root`` is what the claimed leaf and those siblings give; ``verified``
    says whether that is the root.  A block is one row with 2**height documents
    at most, whatever the size of its group.

    Null fields are part of the leaf; a null group is a tree of its own; a null
    key comes first; repeated rows are leaves of their own; an empty dataset
    gives no rows; further columns are not part of the leaf.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            above, out = unpack_path(r["above"]), []
            tail = "".join(text for _, text in above)
            for place, member in enumerate(r["members"]):
                own = siblings(r["nodes"], r["height"], r["leaves"], place)
                folded = fold(fold(member["claim"], own), above)
                proof = digest("".join(text for _, text in own), tail)
                out.append((member["doc_id"], member["node"], r["subroot"], r["top"], proof, folded, folded == r["top"]))
            yield arrow_batches(dict(zip(_PROOF_ARROW.names, zip(*out, strict=True), strict=True)), _PROOF_ARROW)

    member = F.struct("place", "doc_id", "node", "claim")
    rows = manifest.leaves.groupBy(F.col("tree").alias("_t"), F.shiftright("place", manifest.height).alias("_b")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    joined = manifest.blocks_with_paths().join(rows, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b")))
    return joined.select("height", "leaves", "nodes", "above", "subroot", "top", "members").mapInArrow(run, _PROOF)
