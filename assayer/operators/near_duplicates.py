"""Near-duplicate pairs of a table of sets, without comparing all pairs.

Equal sets become one class, so a group of copies is one row however large it
is.  Classes meet by their rarest bits: two sets above the threshold share one
of the first few bits of each when all bits are ordered rare before common.
Sizes and the places of the shared bits bound what two sets can have in common,
and only pairs within those bounds are compared in full.  Only those first bits
are shuffled; how common a bit is comes from hashed counters of fixed size.

Where a few distinct bits make up all sets, as with the signs of a vector, every
set meets nearly every other by some of them.  Such sets are compared as bitmaps,
a block of two chunks in a task, with nothing kept but the pairs found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import check_metric, score_from_counts
from ..session import stage

#: Hashed counters of bits, and the standard deviations above their mean from which one holds common bits.
COUNTER_BITS, STANDS_OUT = 20, 6.0
#: Places of the filter of classes that are compared in full.
FILTER_BITS = 1 << 23
#: First shared bits that a class takes along to a meeting.
KNOWN = 4
#: Distinct bits up to which sets are compared as bitmaps, if their meetings cost more; comparisons of 64 bits that one meeting costs.
DENSE_BITS, MEETING = 1024, 16
#: Rows of a chunk at most, and of the strips and columns of it that are compared at once.
CHUNK, STRIP, WIDTH = 1 << 17, 32, 1 << 13
#: Bits of all sets of a chunk, about, where whole sets are compared.
CHUNK_BITS = 1 << 23
#: Classes of one neighbourhood that go to a chunk together.
TOGETHER = 1000

#: Guards least overlaps against rounding up past a whole number.
_SLACK = 1e-9


def least_share(metric: str, threshold: float) -> float:
    """Share of either set's own bits that a pair at the threshold has in common."""
    return {"tanimoto": threshold, "dice": threshold / (2 - threshold), "cosine": threshold**2}[check_metric(metric)]


def _least_common(metric: str, threshold: float, a: Column, b: Column) -> Column:
    """Bits that two sets of sizes ``a`` and ``b`` share at least when they reach the threshold."""
    name = check_metric(metric)
    if name == "tanimoto":
        least = threshold / (1 + threshold) * (a + b)
    elif name == "dice":
        least = threshold / 2 * (a + b)
    else:
        least = threshold * F.sqrt((a * b).cast("double"))
    return F.ceil(least - _SLACK)


@dataclass
class NearDuplicates:
    """Classes of equal sets and the links between them.

    ``members``: key, class_id (the smallest key with the same set).
    ``pairs``: left_id < right_id, left_size, right_size (rows of the classes), common, similarity.
    Rows of one class are copies of each other and come in no pair.
    """

    members: DataFrame
    pairs: DataFrame
    key: str

    @cached_property
    def classes(self) -> DataFrame:
        """class_id, class_size, links: rows that a row of the class is linked with, copies included."""
        sizes = self.members.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"), F.max("empty").alias("_empty"))
        ends = self.pairs.select(F.col("left_id").alias("class_id"), F.col("right_size").alias("other")).unionAll(self.pairs.select("right_id", "left_size"))
        linked = ends.groupBy("class_id").agg(F.sum("other").alias("_linked"))
        copies = F.when(F.col("_empty"), 0).otherwise(F.col("class_size") - 1)
        return sizes.join(linked, "class_id", "left").select("class_id", "class_size", (copies + F.coalesce("_linked", F.lit(0))).alias("links"))

    @property
    def rows(self) -> DataFrame:
        """key, class_id, class_size, links for every row."""
        return self.members.select(self.key, "class_id").join(self.classes, "class_id").select(self.key, "class_id", "class_size", "links")


def near_duplicates(df: DataFrame, key: str, bits: str, metric: str = "tanimoto", threshold: float = 0.75) -> NearDuplicates:
    """All links between rows whose sets reach the threshold.  Exact.

    ``bits`` is an array without repeats and ``key`` is unique and not null.
    A null or empty set is linked with nothing and is a class of its own, equal
    sets or not.  The sets are written once; hot bits are no more than any other
    bit in the joins on them, as they stand last in every set's order and only a
    set made of common bits reaches them.  Bits meet by their 64-bit hashes,
    which differ for different integers.
    """
    if not 0 < threshold <= 1:
        raise ValueError("near_duplicates needs a threshold above 0 and up to 1")
    share = least_share(metric, threshold)
    sets = df.select(F.col(key).alias("_key"), F.sort_array(F.coalesce(F.col(bits), F.array().cast(df.schema[bits].dataType))).alias("_bits"))
    empty = F.size("_bits") == 0
    digest = F.when(~empty, F.unhex(F.sha2(F.array_join(F.col("_bits").cast("array<string>"), ","), 256)))
    sets = stage(sets.select("_key", digest.alias("_digest"), "_bits"), "sets")
    counters = _counters(sets)
    first = _first_bits(_levels(counters), share)
    held = sets.where(F.col("_digest").isNotNull())
    sized = held.withColumn("size", F.size("_bits"))
    classes = stage(sized.groupBy("_digest").agg(F.min("_key").alias("id"), F.count(F.lit(1)).alias("rows"), F.any_value("size").alias("size")), "classes")
    firsts = sized.withColumn("first", first(F.transform("_bits", lambda x: F.xxhash64(x)))).groupBy("_digest").agg(
        F.min("_key").alias("id"), F.any_value("size").alias("size"), F.any_value("first").alias("first")
    )
    named = sets.select("_key", "_digest").join(classes.select("_digest", "id"), "_digest", "left")
    members = stage(named.select(F.col("_key").alias(key), F.coalesce("id", "_key").alias("class_id"), F.col("_digest").isNull().alias("empty")), "members")
    shared = stage(_shared_firsts(firsts), "prefixes")
    universe = _small_universe(held, counters)
    if universe is not None and _bitmaps_are_cheaper(shared, classes, len(universe)):
        counted = _all_pairs(held, classes, universe, metric, threshold, share)
    else:
        counted = _intersections(held, classes, stage(_candidates(shared, metric, threshold, share), "candidates"))
    score = score_from_counts(F.col("common"), F.col("_n"), F.col("_m"), metric)
    pairs = counted.withColumn("similarity", score).filter(F.col("similarity") >= threshold).drop("_n", "_m")
    return NearDuplicates(members, stage(pairs, "links"), key)


def _slot(bit: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(bit), 64 - COUNTER_BITS).cast("int")


def _counters(sets: DataFrame) -> DataFrame:
    """slot, n: bits of all sets per hash counter, added up by a task per core before they are shuffled."""
    tokens = sets.coalesce(max(1, sets.sparkSession.sparkContext.defaultParallelism)).select(F.explode("_bits").alias("bit"))
    return stage(tokens.groupBy(_slot(F.col("bit")).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "counters")


def _levels(counters: DataFrame) -> np.ndarray:
    """How common the bits of each counter are, in powers of two; 0 for most.

    Levels only order the bits of a set: any order finds all links.
    """
    mean = (counters.agg(F.sum("n")).first()[0] or 0) / (1 << COUNTER_BITS)
    over = F.col("n") - F.lit(mean)
    got = counters.where(over > STANDS_OUT * mean**0.5 + 3).select("slot", F.floor(F.log2(over)).cast("int").alias("level")).toPandas()
    levels = np.zeros(1 << COUNTER_BITS, np.uint64)
    levels[got["slot"].to_numpy(int)] = np.maximum(1, got["level"].to_numpy(int))
    return levels.astype(np.uint8)


def _first_bits(levels: np.ndarray, share: float) -> Callable[[Column], Column]:
    """Of the hashes of a set's bits those that a partner must share one of: by level, then by hash."""

    @F.arrow_udf("array<bigint>")
    def first(hashes: pa.Array) -> pa.Array:
        ends, values = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(np.uint64)
        level = levels[values >> np.uint64(64 - COUNTER_BITS)]
        out, lengths = [values[:0]], [0]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own, common = values[a:b], level[a:b] > 0
            length = b - a - math.ceil((b - a) * share - _SLACK) + 1
            chosen = np.sort(own[~common])[:length]
            if len(chosen) < length:
                often = own[common]
                chosen = np.concatenate([chosen, often[np.lexsort((often, level[a:b][common]))][: length - len(chosen)]])
            out.append(chosen)
            lengths.append(len(chosen))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(out).view(np.int64)))

    return first


def _shared_firsts(firsts: DataFrame) -> DataFrame:
    """id, size, bit, place, freq of the first bits that more than one class has among its first."""
    firsts = firsts.select("id", "size", F.posexplode("first").alias("place", "bit")).withColumn("place", F.col("place") + 1)
    return firsts.withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("bit"))).where("freq > 1")


def _candidates(shared: DataFrame, metric: str, threshold: float, share: float) -> DataFrame:
    """left_id < right_id of the classes that can reach the threshold.

    Classes of sizes too far apart never meet: a bit's classes are cut into size
    bands so wide that partners stand in one band or in neighbouring ones.
    Every class knows the first ``KNOWN`` shared bits before the one it meets by.
    If one of them is the partner's too, the pair has met there, so nearly all
    pairs come once, by the first bit they share.  Last, what the first bits of
    both have in common and all that is behind them bound what the sets have.
    """
    width = math.log(1 / share) if share < 1 else 1e-6
    ordered = stage(shared.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("place", "bit"))).alias("own")), "ordered")
    known = ordered.withColumn("known", F.transform(F.slice("own", 1, KNOWN), lambda x: x["bit"]))
    met_by = F.transform("own", lambda x, at: F.struct(x["bit"].alias("bit"), x["place"].alias("place"), (at + 1).alias("p"), F.slice("known", F.lit(1), F.least(at, F.lit(KNOWN))).alias("before")))
    rows = known.select("id", "size", F.explode(met_by).alias("x")).select("id", "size", "x.*")
    banded = rows.withColumn("band", F.floor(F.log("size") / width + _SLACK).cast("int"))
    # The smaller set stands on the left; its partner is in its band or the next one, and shares as much as one of its size or more.
    least_own = _least_common(metric, threshold, F.col("size"), F.col("size"))
    a = banded.where(F.col("p") + F.col("size") - F.col("place") >= least_own).select("bit", "band", F.col("id").alias("a"), F.col("size").alias("n"), F.col("place").alias("i"), "p", F.col("before").alias("before_a"))
    b = banded.select("bit", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("id").alias("b"), F.col("size").alias("m"), F.col("place").alias("j"), F.col("p").alias("q"), F.col("before").alias("before_b"))
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    sizes_fit = F.col("n") >= F.col("m") * share - _SLACK
    # Up to this bit two sets share this bit alone if all bits before it are known, else no more than the shorter of their
    # stretches of shared bits; behind it no more than what is left.
    upto = F.when(F.greatest("p", "q") <= KNOWN + 1, 1).otherwise(F.least("p", "q"))
    behind = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    least = _least_common(metric, threshold, F.col("n"), F.col("m"))
    can_reach = upto + behind >= least
    met = a.join(b, ["bit", "band"]).where(once & sizes_fit & can_reach & ~F.arrays_overlap("before_a", "before_b"))
    met = met.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).where("left_id < right_id").distinct()
    lists = ordered.select("id", "size", F.transform("own", lambda x: x["bit"]).alias("own"))
    left, right = lists.toDF("left_id", "n", "own_a"), lists.toDF("right_id", "m", "own_b")
    past = lambda size: F.ceil(F.col(size) * share - _SLACK) - 1
    within = F.size(F.array_intersect("own_a", "own_b")) + F.greatest(past("n"), past("m")) >= least
    return met.join(left, "left_id").join(right, "right_id").where(within).select("left_id", "right_id").distinct()


def _intersections(held: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates with both classes' rows and sizes and what their sets have in common.

    Only sets of classes in candidates are shuffled, but for a few that the
    filter, of fixed size, lets through.  Classes are dealt into chunks by the
    least class around them, up to ``TOGETHER`` of one neighbourhood into a chunk,
    and a set goes once to each pair of chunks that one of its candidates is in,
    so a class with many links is not sent along with every one of them.
    """
    cores = held.sparkSession.sparkContext.defaultParallelism
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    sides = candidates.select("left_id", "right_id").unionAll(candidates.select("right_id", "left_id"))
    ends = stage(sides.groupBy(F.col("left_id").alias("_key")).agg(F.min("right_id").alias("near")).withColumn("near", F.least("_key", "near")), "ends")
    n_bits = ends.join(classes, F.col("_key") == F.col("id")).agg(F.sum("size")).first()[0] or 0
    chunks = max(math.ceil((8 * cores) ** 0.5), -(-n_bits // CHUNK_BITS))
    parts = ends.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    chunk = F.pmod(F.xxhash64("near", F.pmod(F.xxhash64("_key"), F.col("parts"))), F.lit(chunks)).cast("int")
    places = stage(ends.join(parts, "near").select("_key", chunk.alias("chunk")), "chunks")
    dealt = candidates.join(places.toDF("left_id", "x"), "left_id").join(places.toDF("right_id", "y"), "right_id")
    dealt = dealt.select("left_id", "right_id", (F.least("x", "y") * F.lit(chunks) + F.greatest("x", "y")).alias("block"))
    wanted = dealt.select("block", F.explode(F.array("left_id", "right_id")).alias("_key")).distinct()
    words = ends.select(slot("_key").alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("v"))
    found = held.withColumn("s", slot("_key")).join(F.broadcast(words), F.shiftright("s", 6) == F.col("w")).where("shiftright(v, cast(s & 63 AS int)) & 1 = 1")
    sent = found.join(wanted, "_key").select("block", F.col("_key").alias("id"), F.col("_digest").alias("digest"), F.col("_bits").alias("bits"))
    kinds = sent.schema
    asked = dealt.select("block", F.col("left_id").alias("id"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(kinds["bits"].dataType).alias("bits"), F.col("right_id").alias("other"))
    both = sent.withColumn("other", F.lit(None).cast(kinds["id"].dataType)).unionAll(asked).repartition(min(chunks**2, 64 * cores), "block").sortWithinPartitions("block")
    kind = kinds["id"].dataType.simpleString()
    counted = both.mapInArrow(_count(), f"left_id {kind}, right_id {kind}, left_digest binary, right_digest binary, common int, _n int, _m int")
    counted = stage(counted, "counted").distinct()  # a row that comes twice has one set
    named = lambda side: classes.select(F.col("id").alias(f"{side}_id"), F.col("_digest").alias(f"{side}_digest"), F.col("rows").alias(f"{side}_size"))
    counted = counted.join(named("left"), ["left_id", "left_digest"]).join(named("right"), ["right_id", "right_digest"])
    return counted.select("left_id", "right_id", "left_size", "right_size", "common", "_n", "_m")


def _by_block(work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of their first column, the block, go to ``work`` a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if parts and of[a] != block:
                    yield from work(block, pa.Table.from_batches(parts))
                    parts = []
                block = int(of[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from work(block, pa.Table.from_batches(parts))

    return run


def _count() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, id, digest, bits, other) in order of blocks: sets, and pairs (id, other) to be counted."""

    def shared(a: pa.Scalar, b: pa.Scalar) -> int:
        if pa.types.is_integer(a.values.type) and not a.values.null_count and not b.values.null_count:
            return len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True))
        return len(set(a.as_py()) & set(b.as_py()))

    def pairs(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_pair = pc.is_null(table.column("bits"))
        sets, asked = table.filter(pc.invert(is_pair)), table.filter(is_pair)
        places, seen = {}, set()
        digests, bits = sets.column("digest").to_pylist(), sets.column("bits")
        for i, (key, digest) in enumerate(zip(sets.column("id").to_pylist(), digests, strict=True)):
            if (key, digest) not in seen:
                seen.add((key, digest))
                places.setdefault(key, []).append(i)
        for part in asked.to_batches(max_chunksize=20_000):
            out = []
            for a, b in zip(part.column("id").to_pylist(), part.column("other").to_pylist(), strict=True):
                for i in places.get(a, []):
                    for j in places.get(b, []):
                        x, y = bits[i], bits[j]
                        out.append((a, b, digests[i], digests[j], shared(x, y), len(x.values), len(y.values)))
            kinds = [table.schema.field("id").type] * 2 + [pa.binary()] * 2 + [pa.int32()] * 3
            names = ["left_id", "right_id", "left_digest", "right_digest", "common", "_n", "_m"]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _by_block(pairs)


def _small_universe(held: DataFrame, counters: DataFrame) -> pa.Array | None:
    """All distinct bits if there are few of them."""
    if counters.count() > DENSE_BITS:
        return None
    found = held.select(F.explode("_bits").alias("bit")).distinct().limit(DENSE_BITS + 1).toArrow().column("bit").combine_chunks()
    return found if 0 < len(found) <= DENSE_BITS and not found.null_count else None


def _bitmaps_are_cheaper(shared: DataFrame, classes: DataFrame, n_bits: int) -> bool:
    meetings = shared.agg(F.sum("freq")).first()[0] or 0
    return meetings * MEETING > classes.count() ** 2 * -(-n_bits // 64)


def _bitmap(universe: pa.Array) -> Callable[[Column], Column]:
    """A set as a bit per member of the universe, in whole 64-bit words."""
    width = -(-len(universe) // 64) * 64

    @F.arrow_udf("binary")
    def bitmap(sets: pa.Array) -> pa.Array:
        ends = sets.offsets.to_numpy()
        at = pc.index_in(sets.values[ends[0] : ends[-1]], value_set=universe).to_numpy(zero_copy_only=False)
        marks = np.zeros((len(sets), width), np.uint8)
        marks[np.repeat(np.arange(len(sets)), np.diff(ends)), at] = 1
        return pa.array([row.tobytes() for row in np.packbits(marks, axis=1)], pa.binary())

    return bitmap


def _all_pairs(held: DataFrame, classes: DataFrame, universe: pa.Array, metric: str, threshold: float, share: float) -> DataFrame:
    """What ``_intersections`` gives, for all pairs that reach the threshold, by comparing bitmaps.

    Classes are dealt into chunks by a hash, and each pair of chunks is a block
    that one task compares, strip by strip.  There are as many chunks as keep
    all cores busy, and more only to bound a chunk.
    """
    maps = held.select("_digest", _bitmap(universe)("_bits").alias("map")).groupBy("_digest").agg(F.any_value("map").alias("map"))
    nodes = stage(classes.select("_digest", "id", "rows", "size").join(maps, "_digest").where("id IS NOT NULL").drop("_digest"), "bitmaps")
    n, cores = nodes.count(), nodes.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-n // CHUNK), min(-(-n // 1024), math.ceil((8 * cores) ** 0.5)))
    dealt = nodes.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("other")
    block = (F.least("chunk", "other") * F.lit(chunks) + F.greatest("chunk", "other")).alias("block")
    placed = dealt.select("*", other).select(block, "chunk", "id", "rows", "size", "map")
    placed = placed.repartition(chunks * (chunks + 1) // 2, "block").sortWithinPartitions("block")
    kind, rows_kind = nodes.schema["id"].dataType.simpleString(), nodes.schema["rows"].dataType.simpleString()
    compare = _compare(chunks, metric, threshold, share)
    found = placed.mapInArrow(compare, f"a {kind}, b {kind}, ra {rows_kind}, rb {rows_kind}, n int, m int, common int")
    swap = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return found.where("a <> b").select(
        pick("a", "b").alias("left_id"), pick("b", "a").alias("right_id"), pick("ra", "rb").alias("left_size"), pick("rb", "ra").alias("right_size"),
        "common", pick("n", "m").alias("_n"), pick("m", "n").alias("_m"),
    )


def _compare(chunks: int, metric: str, threshold: float, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, chunk, id, rows, size, map) in order of blocks to the pairs that share enough."""

    def sides(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.take(pa.array(np.argsort(table.column("size").to_numpy(), kind="stable")))
        words = np.frombuffer(b"".join(table.column("map").to_pylist()), np.uint64).reshape(len(table), -1)
        return table, words, table.column("size").to_numpy().astype(np.int64)

    name = check_metric(metric)

    def least(n: int, m: np.ndarray) -> np.ndarray:
        raw = threshold / (1 + threshold) * (n + m) if name == "tanimoto" else threshold / 2 * (n + m) if name == "dice" else threshold * np.sqrt(n * m.astype(float))
        return np.ceil(raw - _SLACK)

    def hits(x: np.ndarray, y: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        common = np.bitwise_count(x[:, None, 0] & y[None, :, 0])
        for k in range(1, x.shape[1]):
            common = common.astype(np.uint16) + np.bitwise_count(x[:, None, k] & y[None, :, k])
        i, j = np.nonzero(common >= enough.astype(common.dtype))
        return i, j, common[i, j].astype(np.int32)

    def pairs(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = divmod(block, chunks)
        chunk = table.column("chunk")
        ta, wa, na = sides(table.filter(pc.equal(chunk, low)))
        tb, wb, nb = (ta, wa, na) if low == high else sides(table.filter(pc.equal(chunk, high)))
        for n in np.unique(na).tolist() if len(nb) else []:
            first, end = np.searchsorted(na, [n, n + 1]).tolist()
            lo, hi = np.searchsorted(nb, [n * share - _SLACK, n / share + _SLACK]).tolist()
            enough = least(n, nb)
            for s in range(first, end, STRIP):
                e = min(end, s + STRIP)
                for t in range(max(lo, s) if low == high else lo, hi, WIDTH):
                    u = min(hi, t + WIDTH)
                    i, j, common = hits(wa[s:e], wb[t:u], enough[t:u])
                    i, j = i + s, j + t
                    if low == high:
                        later = j > i
                        i, j, common = i[later], j[later], common[later]
                    if len(i):
                        a, b = (x.select(["id", "rows", "size"]).take(pa.array(at)).combine_chunks() for x, at in ((ta, i), (tb, j)))
                        columns = [a["id"], b["id"], a["rows"], b["rows"], a["size"], b["size"], pa.chunked_array([pa.array(common)])]
                        yield from pa.table(columns, names=["a", "b", "ra", "rb", "n", "m", "common"]).to_batches()

    return _by_block(pairs)


def with_word_shingles(df: DataFrame, column: str, name: str, words: str, n: int = 5) -> DataFrame:
    """Add 64-bit hashes of the distinct runs of ``n`` words of a text, made of the hashes of its words.

    A shorter text is one run, no words or a null are none.  ``words`` is the
    pattern of a word.  The words and their hashes are columns of their own, used
    more than once, so Spark splits a text and hashes a word once.
    """
    split = df.withColumn("_words", F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(words), F.lit(0)))
    split = split.withColumn("_words", F.transform("_words", lambda w: F.xxhash64(w)))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - n, F.lit(0))), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(n)]))
    none = F.array().cast("array<bigint>")
    return split.withColumn(name, F.when(F.size("_words") > 0, F.array_distinct(runs)).otherwise(none)).drop("_words")
