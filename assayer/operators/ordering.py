"""Exact ranks without sorting a table in one task.

``row_at_rank`` finds rows by the digits of their order, ``group_cuts`` the
same for many groups at once.  ``order_statistics`` finds the values at ranks of
many columns by narrowing windows: a mergeable quantile sketch proposes bounds,
exact counts confirm them, and only a window of bounded size is ever gathered.  Numbers of all rows and running totals are in ``numbering``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, IntegralType, StringType, TimestampNTZType, TimestampType

from ..session import stage
from .numbering import prefix_sums

__all__ = ["group_cuts", "not_after", "order_statistics", "prefix_sums", "row_at_rank", "sortable"]

#: Values gathered for one rank at most; a window with more rows is narrowed.
WINDOW = 10_000
ACCURACY = 10_000
#: Bytes of text gathered with them at most.
GATHERED = 1 << 24
#: Bits of an integer that one level of a radix selection counts.
DIGIT_BITS = 16


def sortable(df: DataFrame, column: str) -> Column:
    """A column as integers or text that sort the same way; other types as they are."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("bigint")
    return value.cast("int") if isinstance(kind, BooleanType) else value


class _Slot:
    """One wanted rank: the window [low, high] that holds it, and its rank there."""

    def __init__(self, at: int, name: str, rank: int, size: int):
        self.at, self.name, self.rank = at, name, rank
        self.low = self.high = None
        self.inside, self.size, self.value = rank, size, None

    @property
    def place(self) -> tuple:
        return self.at, self.low, self.high

    @property
    def column(self) -> Column:
        return F.col(f"v{self.at}")

    def window(self) -> Column:
        if self.low is None:
            return self.column.isNotNull()
        return (self.column >= F.lit(self.low)) & (self.column <= F.lit(self.high))

    def shares(self) -> list[float]:
        """Quantiles a little below and above the rank, wider than the sketch's error."""
        margin = 2 * self.size / ACCURACY + 1
        return [max(0.0, (self.inside - margin) / self.size), min(1.0, (self.inside + margin) / self.size)]


def _by_window(slots: list[_Slot]) -> dict[tuple, list[_Slot]]:
    out: dict[tuple, list[_Slot]] = {}
    for s in slots:
        out.setdefault(s.place, []).append(s)
    return out


def order_statistics(
    df: DataFrame, wanted: dict[str, tuple[Column, list[int]]], sizes: dict[str, int] | None = None
) -> dict[tuple[str, int], object]:
    """Values at zero-based ranks among the non-null values of expressions.

    ``wanted`` maps a label to (numeric expression, ranks); ``sizes`` gives
    counts of non-null values already known.  All labels and ranks share their
    passes over the data, and a pass is one aggregate without a shuffle of
    rows.  A rank beyond the last value gives None.
    """
    labels = list(wanted)
    data = df.select(*[wanted[name][0].alias(f"v{i}") for i, name in enumerate(labels)])
    if sizes is None:
        counted = data.agg(*[F.count(f"v{i}") for i in range(len(labels))]).first()
        sizes = dict(zip(labels, counted))
    slots = [_Slot(i, name, rank, sizes[name]) for i, name in enumerate(labels) for rank in wanted[name][1]]
    live = [s for s in slots if 0 <= s.rank < s.size]
    while wide := [s for s in live if s.size > WINDOW and (s.low is None or s.low != s.high)]:
        _narrow(data, wide)
    for s in live:
        if s.low is not None and s.low == s.high:
            s.value = s.low
    rest = _by_window([s for s in live if s.value is None])
    if rest:
        # At most WINDOW values per window, gathered once for all its ranks.
        lists = [F.array_sort(F.collect_list(F.when(group[0].window(), group[0].column))) for group in rest.values()]
        picks = [
            F.get(values, F.lit(s.inside)).alias(f"g{j}_{k}")
            for j, (values, group) in enumerate(zip(lists, rest.values()))
            for k, s in enumerate(group)
        ]
        for s, value in zip([s for group in rest.values() for s in group], data.agg(*picks).first()):
            s.value = value
    return {(s.name, s.rank): s.value for s in slots}


def _narrow(data: DataFrame, wide: list[_Slot]) -> None:
    """One round: a sketch per window proposes bounds, exact counts confirm them."""
    groups = _by_window(wide)
    sketches = [
        F.percentile_approx(F.when(group[0].window(), group[0].column), [x for s in group for x in s.shares()], ACCURACY).alias(f"p{j}")
        for j, group in enumerate(groups.values())
    ]
    proposed = data.agg(*sketches).first()
    bounds = [(s, *_inside(s, b[2 * k], b[2 * k + 1])) for b, group in zip(proposed, groups.values()) for k, s in enumerate(group)]
    counts = []
    for j, (s, low, high) in enumerate(bounds):
        counts.append(F.count_if(s.window() & (s.column < F.lit(low))).alias(f"b{j}"))
        counts.append(F.count_if(s.window() & (s.column >= F.lit(low)) & (s.column <= F.lit(high))).alias(f"w{j}"))
    found = data.agg(*counts).first()
    for j, (s, low, high) in enumerate(bounds):
        below, within = found[f"b{j}"], found[f"w{j}"]
        if not below <= s.inside < below + within:
            # The sketch was off by more than it promises: split the window instead.
            ends = (s.low, s.high) if s.low is not None else data.agg(F.min(s.column), F.max(s.column)).first()
            low, high, below, within = _halve(data, s, *ends)
        if within == s.size and low != high and s.low is not None:
            # No progress by counts: split the value range instead.
            low, high, below, within = _halve(data, s, low, high)
        s.low, s.high, s.inside, s.size = low, high, s.inside - below, within


def _inside(slot: _Slot, low, high) -> tuple:
    """Proposed bounds, never wider than the window they are to narrow.

    Large integers get some room, as the sketch works in doubles.
    """
    if isinstance(low, int):
        low, high = low - (abs(low) >> 52), high + (abs(high) >> 52)
    if slot.low is not None:
        low, high = max(low, slot.low), min(high, slot.high)
    return low, high


def _halve(data: DataFrame, slot: _Slot, low, high) -> tuple:
    """Keep the half of [low, high] that holds the rank."""
    middle = low + (high - low) // 2 if isinstance(low, int) else low + (high - low) / 2
    upper = slot.window() & (slot.column > F.lit(middle))
    left, above, right = data.agg(
        F.count_if(slot.window() & (slot.column <= F.lit(middle))), F.min(F.when(upper, slot.column)), F.count_if(upper)
    ).first()
    return (low, middle, 0, left) if slot.inside < left else (above, high, left, right)


@dataclass
class _Branch:
    """Rows that agree with the wanted ones in the columns and digits found so far."""

    ranks: dict[int, int]  # wanted rank -> rank inside the branch
    size: int
    values: tuple = ()  # of the order columns that are decided
    low: int | str | None = None  # bounds of the next column, if known
    high: int | str | None = None
    prefix: bytes = b""  # of a text column
    weight: int | None = None  # bytes of text in the columns left

    def decided(self, value) -> _Branch:
        return _Branch(self.ranks, self.size, (*self.values, value))


def row_at_rank(
    df: DataFrame, order: list[Column], ranks: list[int], size: int | None = None, bounds: tuple[int, int] | None = None
) -> dict[int, tuple | None]:
    """The order values of the rows at zero-based ranks, lexicographic order, by radix selection.

    Later columns break ties of the earlier ones.  No column may hold nulls
    and the last must be unique; ``size`` is the row count when known, and
    ``bounds`` the range of the first column if it holds integers.  A rank
    beyond the table gives None.

    Integers are taken 16 bits at a time from the highest one in which they
    differ, text two bytes at a time behind what all its values begin with.  A
    level counts the rows per digit, at most 65,793 counters summed in the map
    tasks, and goes on with the digits that hold a wanted rank.  Branches of at
    most ``WINDOW`` rows and ``GATHERED`` bytes of text are gathered.
    """
    names = [f"o{k}" for k in range(len(order))]
    data = df.select(*[c.alias(n) for c, n in zip(order, names)])
    kinds = ["int" if isinstance(f.dataType, IntegralType) else "text" if isinstance(f.dataType, StringType) else "other" for f in data.schema]
    data = data.select(*[F.col(n).cast("bigint").alias(n) if kind == "int" else F.col(n) for n, kind in zip(names, kinds)])
    if size is None:
        size = data.count()
    found: dict[int, tuple | None] = {r: None for r in ranks}
    live = {r: r for r in ranks if 0 <= r < size}
    branches = [_Branch(live, size, (), *(bounds or ()))] if live else []
    while branches:
        _learn(data, names, kinds, branches)
        gather, split, after = [], [], []
        for b in branches:
            if b.low is not None and b.low == b.high:
                after.append(b.decided(b.low))
            elif b.size <= WINDOW and not (b.weight or 0) > GATHERED:
                gather.append(b)
            elif kinds[len(b.values)] == "other":
                after += _by_value(data.filter(_inside_branch(names, kinds, b)), names[len(b.values)], b)
            else:
                split.append(b)
        if gather:
            found |= _gathered(data, names, kinds, gather)
        branches = []
        for b in after + (_by_digit(data, names, kinds, split) if split else []):
            if len(b.values) == len(names):
                found |= {r: b.values for r in b.ranks}
            else:
                branches.append(b)
    return found


def _inside_branch(names: list[str], kinds: list[str], b: _Branch) -> Column:
    """True for the rows of a branch."""
    tests = [F.col(n) == F.lit(v) for n, v in zip(names, b.values)]
    at = len(b.values)
    if kinds[at] == "int" and b.low is not None:
        tests.append(F.col(names[at]).between(F.lit(b.low), F.lit(b.high)))
    elif b.prefix:
        tests.append(F.startswith(F.col(names[at]).cast("binary"), F.lit(b.prefix)))
    return reduce(lambda a, c: a & c, tests, F.lit(True))


def _learn(data: DataFrame, names: list[str], kinds: list[str], branches: list[_Branch]) -> None:
    """Fill in bounds and bytes of text where the next step needs them, in one pass."""
    asks, to = [], []
    for b in branches:
        at = len(b.values)
        texts = [n for n, kind in zip(names[at:], kinds[at:]) if kind == "text"]
        large = b.size > WINDOW
        if not texts and (b.low is not None or not large or kinds[at] == "other"):
            continue
        here, column = _inside_branch(names, kinds, b), F.col(names[at])
        weight = reduce(lambda a, c: a + c, [F.octet_length(n).cast("bigint") for n in texts], F.lit(0).cast("bigint"))
        asks.append(F.sum(F.when(here, weight)))
        ends = kinds[at] != "other" and b.low is None
        asks += [F.min(F.when(here, column)), F.max(F.when(here, column))] if ends else [F.lit(None), F.lit(None)]
        to.append(b)
    if to:
        row = data.agg(*[a.alias(f"a{i}") for i, a in enumerate(asks)]).first()
        for i, b in enumerate(to):
            b.weight = row[3 * i]
            if b.low is None:
                b.low, b.high = row[3 * i + 1], row[3 * i + 2]


def _gathered(data: DataFrame, names: list[str], kinds: list[str], branches: list[_Branch]) -> dict[int, tuple]:
    picks = []
    for j, b in enumerate(branches):
        rest = F.struct(*names[len(b.values) :])
        rows = F.sort_array(F.collect_list(F.when(_inside_branch(names, kinds, b), rest)))
        picks += [F.get(rows, F.lit(at)).alias(f"g{j}_{k}") for k, at in enumerate(b.ranks.values())]
    row = data.agg(*picks).first()
    return {r: (*b.values, *row[f"g{j}_{k}"]) for j, b in enumerate(branches) for k, r in enumerate(b.ranks)}


def _by_value(rows: DataFrame, name: str, b: _Branch) -> list[_Branch]:
    """Branches by the values of a column without digits, such as a double."""
    heads = order_statistics(rows, {"x": (F.col(name), list(b.ranks.values()))}, {"x": b.size})
    values = list(dict.fromkeys(heads[("x", at)] for at in b.ranks.values()))
    counts = [c for v in values for c in (F.count_if(F.col(name) < F.lit(v)), F.count_if(F.col(name) == F.lit(v)))]
    row = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
    out = []
    for i, v in enumerate(values):
        before, ties = row[2 * i], row[2 * i + 1]
        ranks = {r: at - before for r, at in b.ranks.items() if before <= at < before + ties}
        out.append(_Branch(ranks, ties, (*b.values, v)))
    return out


def _by_digit(data: DataFrame, names: list[str], kinds: list[str], branches: list[_Branch]) -> list[_Branch]:
    """One level: rows per branch and digit, then the digits that hold a wanted rank."""
    place, shifts, starts = None, {}, {}
    for j, b in enumerate(branches):
        at = len(b.values)
        column = F.col(names[at])
        if kinds[at] == "int":
            shifts[j] = next(s for s in range(0, 64) if (b.high >> s) - (b.low >> s) < 1 << DIGIT_BITS)
            number, text = F.shiftright(column, shifts[j]), F.lit(None).cast("binary")
        else:
            starts[j] = os.path.commonprefix([b.low.encode(), b.high.encode()])
            number, text = F.lit(None).cast("bigint"), F.substring(column.cast("binary"), len(starts[j]) + 1, 2)
        digit = F.struct(F.lit(j).alias("b"), number.alias("n"), text.alias("t"))
        here = _inside_branch(names, kinds, b)
        place = F.when(here, digit) if place is None else place.when(here, digit)
    counts = data.select(place.alias("d")).filter("d IS NOT NULL").groupBy("d.b", "d.n", "d.t").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("n", "t").rowsBetween(Window.unboundedPreceding, 0))
    wanted = [(F.col("b") == j) & (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at) for j, b in enumerate(branches) for at in b.ranks.values()]
    picked = counts.withColumn("upto", upto).filter(reduce(lambda a, c: a | c, wanted)).collect()  # a row per rank at most
    out = []
    for row in picked:
        b, before = branches[row["b"]], row["upto"] - row["c"]
        ranks = {r: at - before for r, at in b.ranks.items() if before <= at < row["upto"]}
        if row["n"] is not None:
            s = shifts[row["b"]]
            low, high = max(b.low, row["n"] << s), min(b.high, ((row["n"] + 1) << s) - 1)
            out.append(_Branch(ranks, row["c"], b.values, low, high))
        elif len(row["t"]) < 2:  # the text ends here
            out.append(_Branch(ranks, row["c"], (*b.values, (starts[row["b"]] + bytes(row["t"])).decode())))
        else:
            out.append(_Branch(ranks, row["c"], b.values, prefix=starts[row["b"]] + bytes(row["t"])))
    return out


def not_after(order: list[Column], row: tuple) -> Column:
    """True for rows at or before ``row`` in lexicographic order."""
    (column, *columns), (value, *values) = order, row
    if not columns:
        return column <= F.lit(value)
    return (column < F.lit(value)) | ((column == F.lit(value)) & not_after(columns, tuple(values)))


def group_cuts(
    df: DataFrame, group: str, position: Column, key: str, sizes: dict[str, Column], buckets_shift: int = 16
) -> DataFrame:
    """Per group, the (position, key) of the row at given one-based ranks.

    ``position`` is a seeded 32-bit hash, so its upper bits split every group,
    however large, into even buckets.  Bucket counts are aggregated map-side,
    and the one bucket per group and cut that holds the wanted rank goes on.
    While one of those has more than ``WINDOW`` rows, they are cut by further
    bits, so that what is sorted does not grow with the group.  The result is
    staged: it has a row per group.  ``sizes`` maps a cut name to its rank as an
    expression over ``n`` (rows in the group); rank 0 gives a null cut.
    """
    # A hash is never null; saying so spares a null test that repeats the hash.
    rows = df.select(F.col(group).alias("g"), F.coalesce(position, F.lit(0)).alias("h"), F.col(key).alias("k"))
    shift = buckets_shift
    per_group = Window.partitionBy("g")
    counts = (
        rows.groupBy("g", F.shiftright("h", shift).alias("b")).agg(F.count(F.lit(1)).alias("c"))
        .withColumn("upto", F.sum("c").over(per_group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("c").over(per_group))
    )
    asks = F.explode(F.array(*[F.struct(F.lit(name).alias("cut"), size.cast("bigint").alias("rank")) for name, size in sizes.items()]))
    asked = counts.select("g", "b", "c", "upto", asks.alias("ask")).select("g", "b", "c", "upto", "ask.cut", "ask.rank")
    right = _holding_rank(asked)
    while shift and (right.agg(F.max("c")).first()[0] or 0) > WINDOW:
        inside, shift = _in_buckets(rows, right, shift), max(0, shift - DIGIT_BITS)
        counts = inside.groupBy("g", "cut", F.shiftright("h", shift).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("r").alias("rank"))
        along = Window.partitionBy("g", "cut").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        right = _holding_rank(counts.withColumn("upto", F.sum("c").over(along)))
    order = Window.partitionBy("g", "cut", "r").orderBy("h", "k")
    picked = _in_buckets(rows, right, shift).withColumn("at", F.row_number().over(order)).filter(F.col("at") == F.col("r"))
    cuts = picked.groupBy(F.col("g").alias(group)).agg(
        *[F.max(F.when(F.col("cut") == name, F.struct("h", "k"))).alias(name) for name in sizes]
    )
    return stage(cuts, "cuts")


def _holding_rank(counts: DataFrame) -> DataFrame:
    """The bucket that holds each rank: one row per group and cut, staged so
    that its size decides the join before any row of the table is shuffled for it."""
    held = counts.filter((F.col("rank") > F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("upto")))
    inner = (F.col("rank") - F.col("upto") + F.col("c")).alias("r")
    return stage(held.select(F.col("g").alias("g2"), F.col("b").alias("b2"), "c", "cut", inner), "buckets")


def _in_buckets(rows: DataFrame, right: DataFrame, shift: int) -> DataFrame:
    return rows.join(right, F.col("g").eqNullSafe(F.col("g2")) & (F.shiftright("h", shift) == F.col("b2")))
