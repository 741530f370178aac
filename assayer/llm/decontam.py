"""Benchmark decontamination by spaced seeds.

A mask slides over the words of every text and hashes the words under its ones,
whatever stands under its zeros.  A training text and a benchmark item that
share such a seed are laid on each other there, and the words around the hit are
compared one by one, so a few replaced words don't hide a passage.  Everything
is made of DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Masks that read 6 of 9 words; each reads the first and the last.
MASKS = ("110101011", "111010101", "101100111")
#: Masks of less weight for those items too.  With them every window of 9 to 16 words that is
#: equal in three quarters of its places holds a hit, wherever the replaced words stand.
DENSE_MASKS = ("11011", "1111")
#: The one mask that does so for items of fewer words than ``MASKS`` read.
SHORT_MASKS = {1: "1", 2: "11", 3: "111", 4: "11", 5: "11", 6: "111", 7: "111", 8: "11"}
#: Words of a verification window, and the share of them that must be equal.
WINDOW, SHARE = 16, 0.75
#: Bits of the filters of benchmark words, pairs of neighbours and seeds; fixed, so they are literals of any plan.
WORD_BITS, PAIR_BITS, SEED_BITS = 1 << 16, 1 << 18, 1 << 18
#: Benchmark seeds that are still broadcast, and words of its items per seed; beyond that both sides are shuffled.
BROADCAST_ROWS, ITEM_WORDS = 500_000, 10


def word_hashes(text: str | Column) -> Column:
    """Hashes of the words (letters and digits, lower case) of a text; null has none."""
    body = F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(""))
    return F.transform(F.regexp_extract_all(F.lower(body), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def _bits(values: DataFrame, size: int) -> Column:
    """A literal with a bit set for every value modulo ``size``; at most size / 32 numbers reach the driver."""
    slot = F.pmod(F.col(values.columns[0]), F.lit(size))
    got = values.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("v"))
    words = np.zeros(size // 32, np.int64)
    for w, v in got.collect():
        words[w] = v
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _has(bits: Column, value: Column, size: int) -> Column:
    slot = F.pmod(value, F.lit(size))
    return F.bit_get(F.get(bits, F.shiftright(slot, 5).cast("int")), slot.bitwiseAND(F.lit(31)).cast("int")) == 1


def _seed(words: Column, start: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, (start + o).cast("int")) for o, c in enumerate(mask) if c == "1"])


def _starts(words: Column, mask: str) -> Column:
    return F.when(F.size(words) >= len(mask), F.sequence(F.lit(0), F.size(words) - len(mask))).otherwise(F.array().cast("array<int>"))


def benchmark_seeds(benchmark: DataFrame, masks: Sequence[str], key: str, text: str, short_tolerance: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(item words, seeds, masks): items shorter than the masks get masks of their own.

    Those are full masks of their length, or with ``short_tolerance`` the ones of
    ``SHORT_MASKS``, which replaced words within the tolerance don't hide.
    """
    items = benchmark.select(F.col(key).alias("item_id"), word_hashes(text).alias("item")).where(F.size("item") > 0)
    items = items.withColumn("words_id", F.xxhash64("item")).dropDuplicates(["item_id", "words_id"])
    span = len(masks[0])
    short = [r[0] for r in items.select(F.size("item").alias("m")).where(F.col("m") < span).distinct().orderBy("m").collect()]
    held = {mask: F.size("item") >= span for mask in (*masks, *DENSE_MASKS)}
    for m in short:
        mask = SHORT_MASKS.get(m, "1" * m) if short_tolerance else "1" * m
        own = F.size("item") == m
        held[mask] = held[mask] | own if mask in held else own
    seeds = None
    for mask, which in held.items():
        rows = items.where(which).dropDuplicates(["words_id"]).select("words_id", "item", F.explode(_starts(F.col("item"), mask)).alias("at"))
        rows = rows.select(_seed(F.col("item"), F.col("at"), mask).alias("seed"), "words_id", "at")
        seeds = rows if seeds is None else seeds.unionByName(rows)
    return items, seeds, list(held)


def _pair(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1))


def _hits(mask: str, known_seed: Column) -> Column:
    """Places that may hold a seed of the benchmark, with the seed, if that is known too.

    A mask with two neighbouring ones is laid only where that pair of words is
    one of the benchmark; any other mask where all of its words are.
    """
    if (pair := mask.find("11")) >= 0:
        fits = F.filter("pairs", lambda j: (j >= pair) & (j - pair + len(mask) <= F.size("words")))
        places = F.transform(fits, lambda j: j - pair)
    else:
        ones = [o for o, c in enumerate(mask) if c == "1"]
        places = F.filter(_starts(F.col("words"), mask), lambda i: reduce(lambda a, b: a & b, [F.get("known", i + o) for o in ones]))
    seeded = F.transform(places, lambda i: F.struct(i.alias("i"), _seed(F.col("words"), i, mask).alias("seed")))
    return F.filter(seeded, lambda s: _has(known_seed, s["seed"], SEED_BITS))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    window: int = WINDOW,
    share: float = SHARE,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    short_tolerance: bool = False,
) -> DataFrame:
    """A row per document and benchmark item that overlap: doc_id, item_id, share, word_at.

    They overlap if some ``window`` words in a row around a shared seed (all
    words of an item shorter than that) are equal word by word in at least
    ``share`` of their places.  ``share`` is that of the best window, ``word_at``
    the first place in the document at which a window of that share begins.
    With ``WINDOW`` and ``SHARE`` no such window is without a seed; of items of
    fewer words than ``masks`` read that holds with ``short_tolerance``, and
    without it they are found whole only.

    Null and empty texts and items overlap with nothing; rows with one id are
    one document; rows of the benchmark with one id are one item; null ids are
    kept; no rows on either side give no rows; further columns are not carried.

    Pairs of neighbouring words that are not in the benchmark rule out most places
    before a seed is hashed, and seeds that are not in it before a row is made,
    both by filters of fixed size.  The benchmark's seeds and items are broadcast
    only up to a counted bound.
    """
    items, seeds, masks = benchmark_seeds(benchmark, masks, item_key, item_text, short_tolerance)
    neighbours = items.where(F.size("item") > 1).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("item") - 2), lambda i: _pair(F.col("item"), i))).alias("p"))
    known_pair = _bits(neighbours, PAIR_BITS)
    known_seed = _bits(seeds.select("seed"), SEED_BITS)
    # Seeds are counted by distinct texts, items by the words of all ids.
    small = seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = small and (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= ITEM_WORDS * BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    rows = docs.select(F.col(key).alias("doc_id"), word_hashes(text).alias("words"))
    pairs = F.filter(F.sequence(F.lit(0), F.size("words") - 2), lambda i: _has(known_pair, _pair(F.col("words"), i), PAIR_BITS))
    rows = rows.withColumn("pairs", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<int>")))
    if any("11" not in mask for mask in masks):
        known_word = _bits(items.select(F.explode("item").alias("w")), WORD_BITS)
        rows = rows.withColumn("known", F.transform("words", lambda w: _has(known_word, w, WORD_BITS)))
    hits = [_hits(mask, known_seed) for mask in masks]
    before = F.least(F.col("h.i"), F.lit(window))
    found = (
        rows.select("doc_id", "words", F.explode(F.concat(*hits)).alias("h"))
        .select(
            "doc_id",
            F.col("h.seed").alias("seed"),
            (F.col("h.i") - before).alias("from"),
            before.alias("before"),
            F.slice("words", F.col("h.i") - before + 1, before + F.lit(len(masks[0]) + window)).alias("near"),
        )
        .join(hint(seeds), "seed")
        .join(hint(items), "words_id")
    )
    # Place k of the region lies on place k + at - before of the item.
    shift = F.col("at") - F.col("before")
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size("near"), F.size("item") - shift)
    width = F.least(F.lit(window), F.size("item"))
    equal = F.transform(F.sequence(first, last - 1), lambda k: (F.get("near", k) == F.get("item", k + shift)).cast("int"))
    laid = found.withColumn("equal", F.when(last > first, equal)).withColumn("first", first).withColumn("width", width)
    count = F.transform(
        F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1),
        lambda s: F.struct(F.aggregate(F.slice("equal", s, F.col("width")), F.lit(0), lambda a, x: a + x).alias("n"), (-s).alias("s")),
    )
    best = laid.where(F.size("equal") >= F.col("width")).withColumn("best", F.array_max(count))
    scored = best.select(
        "doc_id",
        "item_id",
        (F.col("best.n") / F.col("width")).alias("share"),
        (F.col("from") + F.col("first") - F.col("best.s") - 1).cast("long").alias("at"),
    ).where(F.col("share") >= share)
    top = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", (-F.col("at")).alias("at"))).alias("top"))
    return top.select("doc_id", "item_id", F.col("top.share").alias("share"), (-F.col("top.at")).alias("word_at"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows, with all their columns, of documents that overlap with no item.

    Null and empty texts overlap with nothing and stay; rows that repeat an id go
    or stay together, as do rows with a null id; no items leave all rows, and no
    rows give no rows.
    """
    bad = contaminated(docs, benchmark, key=key, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__bad")), "left_anti")
