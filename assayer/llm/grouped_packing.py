"""Packing into few sequences by linear grouping.

Pieces are large (more than a quarter of the capacity), small, or as long as a
whole sequence.  The large ones, ordered by length, are cut into groups of equal
cardinality, and a group counts as long as its longest piece.  For those few
lengths a linear programme finds how often to use which configuration; actual
pieces then take the places of their group by rank, and the small ones fill what
is left, each where it fits best.

All of that is decided on counts per length: at most as many numbers as a
sequence has tokens go to the driver, and rules of bounded size come back.  A
piece finds its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayer.llm.common import arrow_batches, pieces, stage
from assayer.llm.packing import encoder_of
from assayer.operators.numbering import number_rows

#: Groups of large pieces, and the share of the optimum of the linear programme that may be missed.
GROUPS, TOLERANCE, PIVOTS = 256, 0.0005, 4_000
#: The small pieces are those up to this part of the capacity.
SMALL_PART = 4


# --- configurations of few lengths ------------------------------------------------


def best_configuration(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable set of lengths that fits, repeats allowed: a knapsack, length by length."""
    best = np.zeros(capacity + 1)
    rows = [best]
    for length, value in zip(lengths.tolist(), values.tolist(), strict=True):
        if value > 0:
            best = best.copy()
            for _ in range(capacity // length):
                np.maximum(best[length:], best[:-length] + value, out=best[length:])
        rows.append(best)
    counts, room = np.zeros(len(lengths)), capacity
    for i in range(len(lengths) - 1, -1, -1):
        while rows[i + 1][room] > rows[i][room] + 1e-12:
            counts[i] += 1
            room -= int(lengths[i])
    return float(rows[-1][capacity]), counts


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces per length, copies) of the configurations that cover the demand.

    The linear programme is solved by making columns as they are wanted.  Its
    solution is rounded down, and what that leaves goes first fit, longest
    first; there are fewer such pieces than configurations times pieces in one.
    """
    k = len(lengths)
    if not k:
        return []
    columns = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(PIVOTS):
        worth, column = best_configuration(lengths, inverse.sum(axis=0), capacity)
        if worth <= 1 + TOLERANCE:
            break
        move = inverse @ column
        ratios = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        columns[:, out] = column
        amount = np.maximum(inverse @ demand, 0)
    copies = np.floor(amount + 1e-6).astype(np.int64)
    found = [(columns[:, j].astype(np.int64), int(copies[j])) for j in range(k) if copies[j]]
    left = demand.astype(np.int64) - sum((c * n for c, n in found), np.zeros(k, dtype=np.int64))
    rooms: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-lengths, kind="stable"):
        for _ in range(max(0, int(left[i]))):
            at = next((j for j, (room, _) in enumerate(rooms) if room >= lengths[i]), None)
            if at is None:
                rooms.append((capacity, np.zeros(k, dtype=np.int64)))
                at = len(rooms) - 1
            room, counts = rooms[at]
            counts[i] += 1
            rooms[at] = (room - int(lengths[i]), counts)
    return found + [(counts, 1) for _, counts in rooms]


@dataclass
class LargePlan:
    """Where the large pieces go: the rank of a piece, longest first, lies in a stretch of places.

    ``first`` are the ranks at which stretches begin; the pieces of a stretch
    fill the sequences from ``bin`` on, ``each`` of them a sequence.
    """

    above: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        rank = self.above[length] + rank
        at = np.searchsorted(self.first, rank, side="right") - 1
        return self.bin[at] + (rank - self.first[at]) // self.each[at]


def plan_large(counts: np.ndarray, capacity: int, groups: int = GROUPS) -> LargePlan:
    """``counts[n]`` large pieces have length n."""
    total = int(counts.sum())
    above = np.concatenate([np.cumsum(counts[::-1])[::-1][1:], [0]])
    cuts = np.unique([g * total // groups for g in range(groups)]) if total else np.empty(0, dtype=np.int64)
    # The longest piece of a group is the one at its first rank; groups of one length are one.
    by_rank = np.flatnonzero(counts)[::-1]
    lengths = by_rank[np.searchsorted(np.cumsum(counts[by_rank]), cuts, side="right")] if total else cuts
    keep = np.concatenate([[True], lengths[1:] != lengths[:-1]]) if total else np.empty(0, dtype=bool)
    starts, lengths = cuts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    sizes = np.diff(np.append(starts, total))
    stretches, bins, used = [], 0, np.zeros(len(lengths), dtype=np.int64)
    for counts_, copies in configurations(lengths, sizes.astype(float), capacity):
        for g in np.flatnonzero(counts_):
            if used[g] < sizes[g]:
                stretches.append((int(starts[g] + used[g]), bins, int(counts_[g])))
            used[g] += counts_[g] * copies
        bins += copies
    first, bin_, each = (np.array(c, dtype=np.int64) for c in (zip(*sorted(stretches), strict=True) if stretches else ([], [], [])))
    return LargePlan(above, first, bin_, each, bins)


# --- best fit of the small ones ---------------------------------------------------


@dataclass
class _Bins:
    """Sequences that had the same room from the start, rank ``low`` on, and what they took since."""

    room: int
    low: int
    count: int
    took: list[tuple[int, int, int]] = field(default_factory=list)  # length, pieces each, rank of the first

    def split(self, count: int) -> tuple[_Bins, _Bins]:
        rest = [(n, each, first + count * each) for n, each, first in self.took]
        return _Bins(self.room, self.low, count, list(self.took)), _Bins(self.room, self.low + count, self.count - count, rest)

    def take(self, length: int, each: int, first: int) -> _Bins:
        return _Bins(self.room, self.low, self.count, [*self.took, (length, each, first)])


@dataclass
class SmallPlan:
    """For every small length: stretches of ranks, the room their sequences had and the rank of the first of those."""

    stretches: dict[int, tuple[np.ndarray, ...]]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        room, at = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for n in np.unique(length):
            mine = length == n
            first, rooms, low, each = self.stretches[int(n)]
            k = np.searchsorted(first, rank[mine], side="right") - 1
            room[mine], at[mine] = rooms[k], low[k] + (rank[mine] - first[k]) // each[k]
        return room, at


#: Room of sequences that are opened for small pieces.
OPENED = -1


def plan_small(counts: np.ndarray, rooms: np.ndarray, capacity: int) -> SmallPlan:
    """Best fit, longest first, for ``counts[n]`` pieces of length n and ``rooms[r]`` sequences with room r.

    A piece goes where the least room is left that takes it.  Sequences of equal
    room are alike, so they are handled by number: all of one room take as many
    pieces of a length as fit into them, before the next larger room is touched.
    """
    classes: dict[int, list[_Bins]] = {r: [_Bins(r, 0, int(rooms[r]))] for r in np.flatnonzero(rooms).tolist()}
    opened = 0
    for n in np.flatnonzero(counts)[::-1].tolist():
        left, rank = int(counts[n]), 0
        for r in sorted(k for k in classes if k >= n):
            if not left:
                break
            each, waiting = r // n, classes.pop(r)
            while waiting and left:
                bins = waiting.pop()
                if bins.count * each > left:
                    whole = left // each
                    if whole:
                        bins, rest = bins.split(whole)
                        waiting.append(rest)
                    else:  # one sequence takes the last few
                        bins, rest = bins.split(1) if bins.count > 1 else (bins, None)
                        waiting += [rest] if rest else []
                        classes.setdefault(r - left * n, []).append(bins.take(n, left, rank))
                        rank, left = rank + left, 0
                        break
                classes.setdefault(r - each * n, []).append(bins.take(n, each, rank))
                rank, left = rank + bins.count * each, left - bins.count * each
            if waiting:
                classes.setdefault(r, []).extend(waiting)
        each = capacity // n
        for size, count in ((each, left // each), (left % each, 1 if left % each else 0)):
            if count:
                classes.setdefault(capacity - size * n, []).append(_Bins(OPENED, opened, count, [(n, size, rank)]))
                opened, rank = opened + count, rank + size * count
    found: dict[int, list[tuple]] = {}
    for group in classes.values():
        for bins in group:
            for n, each, first in bins.took:
                found.setdefault(n, []).append((first, bins.room, bins.low, each))
    return SmallPlan({n: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows), strict=True)) for n, rows in found.items()})


# --- the table --------------------------------------------------------------------

_FIELDS = [("piece_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
_PIECES = "piece_id long, doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool, key: str, text: str) -> DataFrame:
    """A row per piece: the whole sequences of a long document stand behind its first, shorter piece."""
    schema = pa.schema(_FIELDS + ([("ids", pa.binary())] if with_ids else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, end = None, TaskContext.get().partitionId() << 33, end_id.to_bytes(4, "little")
        for batch in pieces(batches):
            encoder = encoder or encoder_of(tokenizer, True)
            out: dict[str, list] = {f.name: [] for f in schema}
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                tokens = len(ids) // 4
                cuts = [0, *range(tokens % capacity or capacity, tokens + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    row = (number, doc, i, a, b - a, zlib.crc32(part), *([part] if with_ids else []))
                    for name, value in zip(schema.names, row, strict=True):
                        out[name].append(value)
                    number += 1
            yield arrow_batches(out, schema)

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


def _counts(df: DataFrame, column: str, capacity: int) -> np.ndarray:
    """Rows per value of 0 to ``capacity``: one aggregate of that many numbers at most."""
    out = np.zeros(capacity + 1, dtype=np.int64)
    for value, n in df.groupBy(column).count().collect():
        out[value] = n
    return out


def assign(lengths: DataFrame, capacity: int, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a staged table of piece_id and length (1 to ``capacity``).

    Whole sequences take the negative numbers, other sequences those from 0.  Offsets follow the
    length, longest first, and the piece_id.  A sequence has ``capacity`` pieces at most.
    """
    small = capacity // SMALL_PART
    ranked = number_rows(lengths, ["piece_id"], ["length"], "rank")
    counts = _counts(lengths, "length", capacity)
    by_length = np.arange(capacity + 1)
    large = plan_large(np.where((by_length > small) & (by_length < capacity), counts, 0), capacity, groups)

    @F.pandas_udf("long")
    def large_bin(length: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(large.place(length.to_numpy(), rank.to_numpy()))

    ranked = stage(ranked, "ranked")
    is_large = (F.col("length") > small) & (F.col("length") < capacity)
    placed = ranked.where(is_large).withColumn("sequence_id", large_bin("length", "rank"))
    room = placed.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("room"))
    bins = stage(number_rows(stage(room, "rooms"), ["sequence_id"], ["room"], "bin_rank"), "bins")
    plan = plan_small(np.where(by_length <= small, counts, 0), _counts(bins, "room", capacity), capacity)

    @F.pandas_udf(StructType([StructField("room", LongType()), StructField("at", LongType())]))
    def small_bin(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        room, at = plan.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"room": room, "at": at})

    fits = stage(ranked.where(F.col("length") <= small).withColumn("to", small_bin("length", "rank")).select("*", "to.room", "to.at").drop("to"), "fits")
    taken = bins.select(F.col("room").alias("_room"), F.col("bin_rank").alias("_at"), "sequence_id")
    joined = fits.where(F.col("room") != OPENED).join(taken, (F.col("room") == F.col("_room")) & (F.col("at") == F.col("_at"))).select(*ranked.columns, "sequence_id")
    opened = fits.where(F.col("room") == OPENED).select(*ranked.columns, (F.col("at") + F.lit(large.bins)).alias("sequence_id"))
    whole = ranked.where(F.col("length") == capacity).select("*", (-1 - F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = placed.unionByName(joined).unionByName(opened)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return parts.unionByName(whole).drop("rank")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, groups: int = GROUPS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if wanted.

    The ids of a document are those of its whole text and ``end_id``; one with
    more than ``capacity`` is cut into whole sequences behind a first piece that
    may be shorter.  ``ids`` holds little-endian 32-bit numbers.  The string of a
    special token in a text is that token, as a plain call of the tokenizer has it.

    A null or empty text is one piece with ``end_id``.  Repeated rows are packed
    as often as they come, null keys stay null, no rows give no rows, and further
    columns are not carried.
    """
    cut = stage(cut_pieces(docs, tokenizer, capacity, end_id, with_ids, key, text), "pieces")
    if not with_ids:
        packed = assign(cut, capacity, groups)
    else:
        packed = assign(cut.drop("ids"), capacity, groups).join(cut.select("piece_id", "ids"), "piece_id")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens and the joined ids of every sequence; ``packed`` has ids.  Without padding."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(members, F.lit(b""), lambda a, m: F.concat(a, m["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), whole.alias("ids"))
