"""I-Match fingerprints over several random parts of the lexicon.

A text keeps the terms whose inverse document frequency lies in a band.  Every
part of the lexicon is a share of the hash range of terms; its hash covers the
sorted distinct terms of the text that lie in it.  One part is the whole
lexicon, quarters and eighths cover it once more each, and further parts begin
at random places of their own and have shares down to 2**-20, so texts with up
to a million distinct terms, as many as the lexicon has slots, have parts with
about one term: those tell how much of a text is the same, while equal texts
agree in all of them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.common import stage
from assayer.llm.decontam import _has, word_hashes

#: Slots of the lexicon; terms share a slot by hash, so its size is fixed.
SLOTS = 1 << 20
#: Band of the inverse document frequency: at most this share of documents, at least so many.
MOST_SHARE, LEAST_DOCS = 0.2, 2
#: Near copies that hold this share of the rows count once in the upper limit of the band.
HOT_SHARE = 0.01
#: (scale, parts): each part of scale s has the share 2**-s of the lexicon.
SCALES = ((0, 1), (2, 4), *((s, 8) for s in range(3, 21)))
_RANGE = 30
#: The sign bit of a long.
SIGN = -(2**63)


def part_ranges() -> list[tuple[int, int]]:
    """(low, high) of every part, scale by scale: in order where a scale's parts cover the range, else from a random place each."""
    out = []
    for scale, parts in SCALES:
        width = 1 << (_RANGE - scale)
        for p in range(parts):
            seeded = int(hashlib.md5(f"{scale}:{p}".encode()).hexdigest()[:8], 16) % ((1 << _RANGE) - width + 1)
            low = p * width if parts == 1 << scale else seeded
            out.append((low, low + width))
    return out


#: Rows of one range of ids, about, and ranges at most.
RANGE_ROWS, RANGES = 5_000, 8_192


def lexicon(docs: DataFrame, text: str = "text", most_share: float = MOST_SHARE, least_docs: int = LEAST_DOCS) -> Column:
    """Slots of the terms in the band, as a literal of fixed size.

    Each document counts once per slot.  Counts are summed first by a task per
    core, so that what is shuffled depends on the cores and not on the texts.
    Terms that are above the band only because texts are there several times
    stay in it: slots above it by rows are counted again over distinct texts.
    """
    slots = F.array_distinct(F.transform(word_hashes(text), lambda h: F.pmod(h, F.lit(SLOTS))))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    counted = docs.coalesce(max(1, cores)).select(F.explode(slots).alias("slot")).groupBy("slot").count()
    total = docs.count()
    above = F.col("count") > math.floor(max(least_docs, most_share * total))
    bit = F.expr("shiftleft(1L, cast(slot & 31 as int))")
    got = counted.where(F.col("count") >= least_docs).groupBy(F.shiftright("slot", 5).alias("w")).agg(
        F.bit_or(F.when(above, F.lit(0)).otherwise(bit)).alias("band"), F.bit_or(F.when(above, bit).otherwise(F.lit(0))).alias("above")
    )
    band, common = np.zeros(SLOTS // 32, np.int64), np.zeros(SLOTS // 32, np.int64)
    for w, inside, over in got.collect():
        band[w], common[w] = inside, over
    if common.any():
        for slot in _rare_but_copied(docs, text, _literal(common), total, most_share, least_docs):
            band[slot >> 5] |= 1 << (slot & 31)
    return _literal(band)


def _literal(words: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _rare_but_copied(docs: DataFrame, text: str, common: Column, total: int, most_share: float, least_docs: int) -> list[int]:
    """Slots of ``common`` that are within the upper limit if each distinct text counts once.

    So do near copies, that is texts which share the smallest and the largest hash
    of five words in a row (two that share one passage rarely do), if they hold
    ``HOT_SHARE`` of the rows, so at most 100 groups of them.  Of a text only its
    common slots are written and shuffled, which are few.
    """

    def marks(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
        held = F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda h: _has(common, h, SLOTS)), lambda h: F.pmod(h, F.lit(SLOTS)).cast("int"))))
        ends = let(runs, lambda r: F.xxhash64(F.array_min(r), F.array_max(r)))
        return F.struct(F.when(F.size(words) >= 5, ends).otherwise(F.xxhash64(words)).alias("near"), held.alias("slots"))

    rows = docs.select(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("exact"), let(word_hashes(text), marks).alias("m"))
    rows = stage(rows.select("exact", "m.near", "m.slots"), "lexicon")
    hot = [r[0] for r in rows.groupBy("near").count().where(F.col("count") >= max(2, HOT_SHARE * total)).select("near").collect()]
    texts = rows.groupBy(F.when(F.col("near").isin(hot), F.col("near")).otherwise(F.col("exact")).alias("key")).agg(F.max("slots").alias("slots"))
    limit = math.floor(max(least_docs, most_share * texts.count()))
    counts = texts.select(F.explode("slots").alias("slot")).groupBy("slot").count()
    return [r[0] for r in counts.where(F.col("count") <= limit).select("slot").collect()]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(values: list[int], kind: str = "int") -> Column:
    """A literal array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def fingerprint(text: str | Column, band: Column) -> Column:
    """16-bit hash of every part of the lexicon, null where a part holds no term of the text.

    Terms are sorted by place once, so that a part is a slice of them; all ends
    of parts are found in one pass over the terms and the ends in one order.
    """
    ranges = part_ranges()
    ends = sorted({e for r in ranges for e in r})
    at = {e: i for i, e in enumerate(ends)}
    low, high = (_numbers([at[r[side]] for r in ranges]) for side in (0, 1))
    kept = F.filter(F.array_distinct(word_hashes(text)), lambda h: _has(band, h, SLOTS))
    # With the sign bit turned, signed order is the order of places.
    by_place = F.array_sort(F.transform(kept, lambda h: h.bitwiseXOR(F.lit(SIGN))))

    def part(terms: Column, below: Column, i: Column) -> Column:
        first, last = F.get(below, F.get(low, i)), F.get(below, F.get(high, i))
        return F.when(last > first, F.xxhash64(F.slice(terms, first + 1, last - first)).bitwiseAND(F.lit(0xFFFF)).cast("int"))

    each = F.sequence(F.lit(0), F.lit(len(ranges) - 1))
    return let(by_place, lambda terms: let(_below(terms, ends), lambda below: F.transform(each, lambda i: part(terms, below, i))))


def _below(terms: Column, ends: list[int]) -> Column:
    """How many terms lie before each of the ends, which are places in ascending order."""
    # An end is an even number, and the terms of its place are the odd one behind it.
    places = F.transform(terms, lambda t: F.shiftrightunsigned(t.bitwiseXOR(F.lit(SIGN)), 64 - _RANGE) * 2 + 1)
    mixed = F.sort_array(F.concat(places, _numbers([2 * e for e in ends], "bigint")))
    found = F.array_compact(F.transform(mixed, lambda x, i: F.when(x % 2 == 0, i)))
    return F.transform(found, lambda i, k: i - k)


def as_text(parts: Column) -> Column:
    """Four hex digits per part, ``----`` for one without terms."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.lpad(F.lower(F.hex(p)), 4, "0"), F.lit("----"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that hold a term of either text.

    Only scales count of which a quarter of the parts or more hold no term: there
    a part has about one term and tells whether that is kept, while the large
    parts of a long text change with any edit.  Texts without any such part have
    the likeness 1 if all their parts are equal, else 0.
    """
    firsts = [1 + sum(parts for _, parts in SCALES[:i]) for i in range(len(SCALES))]
    first, parts = _numbers(firsts), _numbers([n for _, n in SCALES])
    codes = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), 0).when(x.eqNullSafe(y), 2).otherwise(1))

    def of_scale(all_codes: Column, i: Column) -> Column:
        held = F.filter(F.slice(all_codes, F.get(first, i), F.get(parts, i)), lambda e: e > 0)
        none = F.struct(F.lit(0).alias("told"), F.lit(0).alias("same"))
        counts = lambda h: F.struct(F.size(h).alias("told"), F.size(F.filter(h, lambda e: e == 2)).alias("same"))
        return let(held, lambda h: F.when(F.size(h) * 4 <= F.get(parts, i) * 3, counts(h)).otherwise(none))

    scales = let(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(len(SCALES) - 1)), lambda i: of_scale(c, i)))
    start = F.struct(F.lit(0).alias("told"), F.lit(0).alias("same"))
    total = F.aggregate(scales, start, lambda t, x: F.struct((t["told"] + x["told"]).alias("told"), (t["same"] + x["same"]).alias("same")))
    return let(total, lambda t: F.when(t["told"] > 0, t["same"] / t["told"]).otherwise(F.when(a == b, 1.0).otherwise(0.0)))


def _range_of(key: str, bounds: list[int]) -> Column:
    """Number of bounds below the key, by halving; a null key is in range 0."""
    steps = [1 << s for s in reversed(range(max(1, len(bounds).bit_length())))]
    padded = bounds + [2**63 - 1] * (2 * steps[0] - 1 - len(bounds))
    array = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(array, at + step - 1) < F.col(key), step).otherwise(0))
    return F.coalesce(place, F.lit(0))


def with_next(rows: DataFrame, key: str, carried: list[str], tie: list[str] | None = None) -> DataFrame:
    """Each row with ``next``, a struct of ``carried`` of the row with the next key; the last has the first's.

    Ties go by the hash of the columns ``tie``, all carried ones if not given; rows
    that tie in that too must be alike.  Rows meet in ranges of keys with about
    ``RANGE_ROWS`` rows each, cut at quantiles.  The first row of every range is
    also put behind the range before it, so no range waits for another; there
    are at most ``RANGES`` such rows.
    """
    rows = rows.withColumn("tie", F.xxhash64(*(tie or carried)))
    n = rows.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    bounds = []
    if ranges > 1:
        got = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
        bounds = sorted(set(got or []))
    placed = rows.withColumn("range", _range_of(key, bounds))
    heads = sorted(placed.groupBy("range").agg(F.min(F.struct(key, "tie")).alias("h")).select("range", "h.*").collect())
    before = [heads[i - 1][0] for i in range(len(heads))]
    first = rows.sparkSession.createDataFrame(
        [(h[1], h[2], b) for h, b in zip(heads, before, strict=True)], f"h_key {rows.schema[key].dataType.simpleString()}, h_tie long, h_range int"
    )
    marked = placed.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("h_key")) & (F.col("tie") == F.col("h_tie")), "left")
    copies = F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("copy")), F.when(F.col("h_tie").isNotNull(), F.struct(F.col("h_range").alias("r"), F.lit(1).alias("copy"))))
    dealt = marked.withColumn("at", F.explode(F.filter(copies, lambda c: c.isNotNull()))).select(*rows.columns, "at.r", "at.copy")
    order = Window.partitionBy("r").orderBy("copy", key, "tie")
    led = dealt.withColumn("next", F.lead(F.struct(*carried)).over(order))
    return led.where("copy = 0").drop("r", "copy", "tie")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", most_share: float = MOST_SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row per document: doc_id and ``parts``, the hashes of its parts.

    Null and empty texts, and texts without a term in the band, have no part.
    Equal texts have equal parts.  Repeated rows and null keys stay; no rows give
    no rows; further columns are not carried.
    """
    band = lexicon(docs, text, most_share, least_docs)
    return docs.select(F.col(key).alias("doc_id"), fingerprint(text, band).alias("parts"))


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text", most_share: float = MOST_SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row per document that compares it with an edited text and with the next document.

    The edited text has the last half of the code points, rounded down, replaced
    by the first as many of the next document (all, if it has fewer).  Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  A null text is empty; repeated rows stay and are each other's
    next; null keys come first; a single document is its own next.
    """
    band = lexicon(docs, text, most_share, least_docs)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Part hashes have 16 bits and are dealt as such.
    rows = rows.withColumn("parts", F.transform(fingerprint("text", band), lambda p: (p - (1 << 15)).cast("short")))
    rows = with_next(rows, "doc_id", ["text", "parts"], ["text"])
    wide = lambda parts: F.transform(parts, lambda p: p.cast("int") + (1 << 15))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), wide(F.col("parts")).alias("parts"), wide(F.col("next.parts")).alias("next_parts"), edited.alias("edited"))
    rows = rows.withColumn("edited_parts", fingerprint("edited", band))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("parts")).alias("fingerprint"),
        as_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
