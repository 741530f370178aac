"""N-gram Jaccard join: groups of documents whose word shingles overlap.

Documents with equal sets become one node.  A node goes to a tile for each of
the shingles in its prefix, which two linked sets must share, and for its size
band.  Candidates of a tile are first bounded by bitmap signatures: bits that
one side has and the other lacks each stand for a shingle that is not shared.
Only then are the sorted arrays intersected.

Scale.  Prefixes hold rare shingles first, after hashed counts of the corpus of
fixed size, so a common passage makes a large tile only among texts that consist
of it; shingles that stand out skip the count that looks for partners, so no
count meets a hot key.  In a first round every node of a tile meets the tile's leader alone,
which joins large groups of near copies in linear work.  In the second round all
pairs of a tile that are not yet connected are compared, in blocks of bounded
size.  No link between two components can be missed, and a link inside one
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.common import pieces, stage

#: Hashed counters of shingles, when one stands out, and bits of the filter of documents.
COUNTER_BITS, STANDS_OUT, FILTER_BITS = 21, 6.0, 1 << 23
#: Nodes of one block of a tile.
BLOCK = 512
#: Shingles of a kind that a prefix needs at most, see ``prefix``.
ENOUGH = 40
TOKEN_MASK = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """64-bit hashes of the runs of ``width`` words of each text, in order.

    Words are what white space (space, tab to carriage return) separates, with
    A-Z in lower case.  A shorter text is one run; without words there is none.
    """
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    flat = np.empty(int(ends[-1]), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    factors = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def runs(own: np.ndarray, k: int) -> np.ndarray:
        total = np.full(max(0, len(own) - k + 1), k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                total += own[i : len(own) - k + 1 + i] * factors[i]
        return _mix(total)

    every = runs(hashes, width)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(every[a : b - width + 1] if b - a >= width else runs(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def distinct(runs: np.ndarray) -> np.ndarray:
    """The values of a set, ascending."""
    values = np.sort(runs)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def bitmap(values: np.ndarray) -> bytes:
    """Bit ``value mod width`` per value; width: the power of two from twice the count, 64 or more."""
    width = max(64, 1 << int(2 * len(values) - 1).bit_length()) if len(values) else 64
    bits = np.zeros(width, np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def overlap_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """No two sets of these sizes and bitmaps share more than this.

    The wider bitmap is folded to the width of the other.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


def needed_overlap(size_a: Column, size_b: Column, percent: int) -> Column:
    """Least intersection with ``100 * intersection >= percent * union``."""
    return F.ceil((size_a + size_b) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("long")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def prefix(values: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rare, common) shingles that a set puts into tiles, both by hash.

    All shingles are ordered, rare before common, each kind by hash; two linked
    sets share one of the first ``prefix_length``.  If 75 % of a kind is in both
    sets, the first ``ENOUGH`` of that kind, in the random order of hashes, hold
    a shared one but for a chance of 0.25 ** 40, or 1e-24 a link.  Linked sets
    share that much of one kind at least.  Hence a set without common shingles
    needs ``ENOUGH`` rare ones, and a set whose rare shingles all belong to the
    prefix needs ``ENOUGH`` common ones; in between, all of the prefix counts.
    """
    length = prefix_length(len(values), percent)
    often = level > 0
    if not often.any():
        return values[: min(length, _enough(percent))], values[:0]
    rare = values[~often][:length]
    return rare, values[often][: min(length - len(rare), _enough(percent))]


def _enough(percent: int) -> int:
    """Draws in a row that miss a share of ``percent`` with the chance stated in ``prefix``."""
    return ENOUGH if percent >= 75 else int(np.ceil(ENOUGH * np.log(0.25) / np.log1p(-percent / 100)))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.withColumn("text_hash", F.xxhash64("text"))


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def shingle_levels(rows: DataFrame, width: int) -> np.ndarray:
    """How common the shingles of each hash counter are, in powers of two; 0 for most.

    All shingles of all texts are counted.  A task per core keeps an array of
    counters and sends it once, so what is shuffled depends on the cores and not
    on the texts.  Counters ``STANDS_OUT`` standard deviations above the mean
    get a level; the driver holds a byte per counter.  Levels only order the
    shingles of a prefix: any order finds all links.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in pieces(batches):
            for runs in shingles(batch.column(1).to_pylist(), width):
                np.add.at(counts, _counter(runs), 1)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 200_000):
            part = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["counter", "n"])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    counted = rows.coalesce(max(1, cores)).mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counted = stage(counted, "counters")
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / (1 << COUNTER_BITS)
    over = F.col("n") - F.lit(mean)
    limit = STANDS_OUT * mean**0.5 + 3
    got = counted.where(over > limit).select("counter", F.floor(F.log2(over)).cast("int").alias("level")).toPandas()
    levels = np.zeros(1 << COUNTER_BITS, np.uint8)
    levels[got["counter"].to_numpy(int)] = np.maximum(1, got["level"].to_numpy(int))
    return levels


_NODE = "doc_id long, text_hash long, n int, k1 long, k2 long, mixed boolean, rare array<long>, common array<long>, bits binary"
_NODE_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("mixed", pa.bool_()), ("rare", pa.list_(pa.int64())), ("common", pa.list_(pa.int64())), ("bits", pa.binary())]
)


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return int(values.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(_mix(values + np.uint64(1))).astype(np.int64)) if len(values) else 0


def signatures(rows: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per row: size, key, bitmap and prefix of its set, 48 bits a shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[] for _ in range(7)]
            for runs in shingles(batch.column(1).to_pylist(), width):
                values = distinct(runs)
                n = len(values)
                level = levels[_counter(values)]
                rare, common = ((v & TOKEN_MASK).astype(np.int64) for v in prefix(values, level, percent))
                for column, value in zip(out, (n, *set_key(values), bool(level.any()), rare, common, bitmap(values)), strict=True):
                    column.append(value)
            arrays = [pa.array(c, f.type) for c, f in zip(out, list(_NODE_ARROW)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], schema=_NODE_ARROW)

    return rows.mapInArrow(run, _NODE)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit per hash of the long column ``id``, ``FILTER_BITS`` of them whatever the input."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("v"))
    got = words.toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["w"].to_numpy(int)] = got["v"].to_numpy(np.int64).astype(np.uint32)
    return out


def whole_sets(rows: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """Key and sorted shingles of the rows that pass the filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            slot = batch.column(2).to_numpy(zero_copy_only=False)
            keep = (wanted[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
            batch = batch.filter(pa.array(keep))
            sets = [distinct(r) for r in shingles(batch.column(1).to_pylist(), width)]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["k1", "k2", "values"],
            )

    slots = rows.select("doc_id", "text").withColumn("slot", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(FILTER_BITS)))
    return slots.mapInArrow(run, "k1 long, k2 long, values array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) connect each node with.

    Every round takes the smallest label around a node and then the label of
    that label, so the rounds grow with the logarithm of a group's width.  Each
    round is written to the shared folder, which cuts the lineage.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", "root", F.least("root", "m").alias("low"))
        of = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        new = stage(near.join(of, "low").select("node", F.least("low", "next").alias("new"), "root"), "labels")
        if not new.where(F.col("new") != F.col("root")).limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", F.col("new").alias("root"))


def _band(n: Column, percent: int) -> Column:
    """Size band; two sets that can link lie in one or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link: bitmap bound first, then intersection.

    Whole sets are made again from the texts, and only for the nodes of pairs
    that the bound leaves.
    """

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, need = (batch.column(i).to_pylist() for i in range(5))
            keep = [overlap_bound(*row[:4]) >= row[4] for row in zip(a, b, n_a, n_b, need, strict=True)]
            yield batch.select(list(range(4, 13))).filter(pa.array(keep, pa.bool_()))

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(3), batch.column(4)
            keep = [
                len(np.intersect1d(np.asarray(x[i].values), np.asarray(y[i].values), assume_unique=True)) >= need
                for i, need in enumerate(batch.column(2).to_pylist())
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "k1", "k2", "id", "bits")])
    sized = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("need", needed_overlap(F.col("n_a"), F.col("n_b"), percent))
    kept = ["need", "a", "b", "k1_a", "k2_a", "k1_b", "k2_b", "id_a", "id_b"]
    near = stage(
        sized.where(F.least("n_a", "n_b") >= F.col("need")).select("bits_a", "bits_b", "n_a", "n_b", *kept).mapInArrow(bounded, ", ".join(f"{c} long" for c in kept)),
        "near",
    )
    wanted = id_filter(near.select(F.explode(F.array("id_a", "id_b")).alias("id")))
    sets = stage(whole_sets(rows, width, wanted), "sets")
    values = lambda s: sets.select(F.col("k1").alias(f"k1_{s}"), F.col("k2").alias(f"k2_{s}"), F.col("values").alias(f"values_{s}"))
    full = near.select(*kept[:7]).join(values("a"), ["k1_a", "k2_a"]).join(values("b"), ["k1_b", "k2_b"])
    return full.select("a", "b", "need", "values_a", "values_b").mapInArrow(shared, "a long, b long").distinct()


def _leader_pairs(tiles: DataFrame) -> DataFrame:
    """Each node of a tile with the tile's leader.

    The leader has the fewest rare shingles before the tile's: of near copies
    it is the one with the fewest edits, to which most others link.
    """
    lead = tiles.groupBy("token", "band").agg(F.min(F.struct("pos", F.xxhash64("node").alias("h"), "node")).alias("lead"))
    return (
        tiles.join(lead, ["token", "band"])
        .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        .where("a != b")
        .distinct()
    )


def _open_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """All pairs of a tile and its neighbour band that can link and are not connected yet.

    If the tile's shingle is the first that two sets share, they share no more
    than either has from its place on; that and the sizes leave few pairs.  ``at``
    counts the shingles of its kind before it, of which none is shared: by
    ``prefix`` fewer than ``ENOUGH`` on both sides together.  That does not hold
    for rare shingles of two sets that both have common ones (``mixed``).

    A tile with m nodes is dealt into m / ``BLOCK`` chunks by a hash, and each
    pair of chunks is a block of its own, so no task gathers a tile.
    """
    wide = tiles.withColumn("low", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    held = (
        wide.groupBy("token", "low")
        .agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("band").alias("b0"))
        .where("r0 != r1 and b0 = low")
        .select("token", "low", F.ceil(F.col("m") / BLOCK).cast("int").alias("chunks"))
    )
    rows = wide.join(held, ["token", "low"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    left = rows.select("token", "low", F.col("chunk").alias("i"), F.explode(every).alias("j"), *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "at", "mixed", "band", "root")]).where("i <= j")
    right = rows.select("token", "low", F.explode(every).alias("i"), F.col("chunk").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "at", "mixed", "band", "root")]).where("i <= j")
    need = needed_overlap(F.col("n_a"), F.col("n_b"), percent)
    match = (F.col("root_a") != F.col("root_b")) & (F.least("band_a", "band_b") == F.col("low"))
    match = match & ((F.col("mixed_a") & F.col("mixed_b")) | (F.col("at_a") + F.col("at_b") < _enough(percent)))
    match = match & (F.col("n_a") - F.col("pos_a") >= need) & (F.col("n_b") - F.col("pos_b") >= need)
    ordered = (F.col("i") < F.col("j")) | (F.col("node_a") < F.col("node_b"))
    pairs = left.join(right, ["token", "low", "i", "j"]).where(match & ordered)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def ngram_groups(docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    Two documents link when ``100 * |A and B| >= percent * |A or B|`` for their
    sets of distinct runs of ``width`` words; ``component_id`` is the smallest
    doc_id that links connect a document with.  A text of fewer words is one
    run.  Null and empty texts and those without words have 0 shingles and are
    alone, with their own id.  Repeated rows stay, each with its group; ids
    that several texts share are handled as texts; null ids take part, but do
    not name a group unless it has no other.  No rows give no rows; further
    columns are not carried.
    """
    return _groups(docs, width, percent, key, text).select("doc_id", "n_shingles", "component_id")


def _groups(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """As ``ngram_groups``, with the hash of the text as ``text_hash``."""
    rows = _rows(docs, key, text)
    levels = shingle_levels(rows, width)
    found = stage(signatures(rows, width, percent, levels).withColumn("node", F.monotonically_increasing_id()), "signatures")
    same = found.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("node").alias("rep"), F.min("doc_id").alias("low_id"))
    member = stage(found.select("node", "doc_id", "text_hash", "n", "k1", "k2").join(same, ["k1", "k2", "n"], "left"), "members")
    reps = member.where("node = rep")

    each = Window.partitionBy("token")
    rare = found.select("node", "mixed", F.posexplode("rare").alias("pos", "token")).withColumn("m", F.count("*").over(each))
    rare = rare.where("m > 1").select("node", "token", "pos", F.col("pos").alias("at"), "mixed")
    common = found.select("node", F.size("rare").alias("before"), F.posexplode("common").alias("at", "token")).select("node", "token", (F.col("before") + F.col("at")).alias("pos"), "at", F.lit(False).alias("mixed"))
    shared = rare.union(common).join(member.select("node", "rep", "n"), "node").select("token", F.col("rep").alias("node"), "n", "pos", "at", "mixed").distinct()
    tiles = stage(shared.withColumn("band", _band(F.col("n"), percent)), "tiles")

    nodes = found.join(reps.select("node"), "node", "left_semi")
    nodes = stage(nodes.select("node", "n", "k1", "k2", "bits", F.coalesce("doc_id", F.lit(0)).alias("id")), "nodes")
    first = stage(_links(_leader_pairs(tiles), nodes, rows, width, percent), "links")
    roots = components(first)
    rooted = tiles.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    second = stage(_links(_open_pairs(rooted, percent), nodes, rows, width, percent), "links")
    groups = components(first.union(second)).select(F.col("node").alias("rep"), "root")

    joined = member.join(groups, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # Written, so that the join below is one that Spark can split at a large group.
    lowest = stage(joined.where("root is not null").groupBy("root").agg(F.min("low_id").alias("component_id")), "lowest")
    return joined.join(lowest, "root", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document per group: that with the smallest id.

    Of rows that repeat an id and its text one stays; texts without words and
    rows with a null id are groups by the same rules as in ``ngram_groups``.
    """
    groups = _groups(docs, width, percent, key, text).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__rows"))
    same = F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__hash"))
    found = docs.join(kept, same)
    once, more = found.where("__rows = 1"), found.where("__rows > 1").dropDuplicates([key, text])
    return once.union(more).select(*[F.col(f"`{c}`") for c in docs.columns])
