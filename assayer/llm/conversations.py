"""Repair of conversation structure by the cheapest edits.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Where a
text stands in that pattern is one of four states, so the cheapest way from any
row to the end is a vector of four costs.  Such vectors are kept at the borders
of blocks of about sqrt(n) rows only; the rows of a block are gone through
backward again when the walk forward reaches it, to pick the least tight edit.

The vectors at the borders come without a walk through the whole conversation:
each block is a 4 x 4 table of the cheapest ways through it, made in parallel,
and those tables are combined from the last block to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.common import pieces, stage
from assayer.operators.numbering import number_rows

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40
#: Nothing yet, after the system text, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a text of that initial; absent where the pattern does not allow it.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
#: Codes of rows: the initial (other than s, u, a: 3), plus 4 when truncated; 8 when the row has to go.
INITIALS, GONE = "sua", 8


def _after_inserts(ahead: np.ndarray) -> np.ndarray:
    """Least cost from each state when texts may be inserted first: a state leads on to the next by u or a."""
    ahead = ahead.copy()
    for _ in range(4):
        for (state, letter), then in NEXT.items():
            if letter != "s":
                ahead[..., state] = np.minimum(ahead[..., state], INSERT + ahead[..., then])
    return ahead


def _row_costs(code: int) -> np.ndarray:
    """[state before, state after] of one row without inserts."""
    out = np.full((4, 4), FAR, dtype=np.int64)
    out[range(4), range(4)] = DELETE
    if code < GONE:
        extra, own = TRUNCATED * (code >= 4), INITIALS[code % 4 : code % 4 + 1]
        for (state, letter), then in NEXT.items():
            cost = extra + (0 if letter == own else REROLE if letter in "ua" else FAR)
            out[state, then] = min(out[state, then], cost)
    return out


#: The cheapest ways through a row of each code, inserts before it included.
STEPS = np.stack([_after_inserts(_row_costs(c).T).T for c in range(GONE + 1)])


def through(codes: bytes) -> np.ndarray:
    """The 4 x 4 table of the cheapest ways through some rows."""
    table = STEPS[codes[0]]
    for c in codes[1:]:
        table = np.minimum((table[:, :, None] + STEPS[c][None, :, :]).min(axis=1), FAR)
    return table


def last_vector() -> np.ndarray:
    """Cost from each state after the last row."""
    return _after_inserts(np.array([0 if s in ENDS else FAR for s in range(4)], dtype=np.int64))


def vectors(codes: bytes, ahead: list[int]) -> list[list[int]]:
    """Costs from each state before every row of a block, and after the last."""
    out = [list(ahead)]
    for c in reversed(codes):
        out.append(_BACK[c](out[-1]))
    return out[::-1]


def _back(code: int):
    step = STEPS[code].tolist()
    return lambda ahead: [min(a + b for a, b in zip(row, ahead, strict=True)) for row in step]


_BACK = [_back(c) for c in range(GONE + 1)]


def tight_edit(code: int | None, state: int, here: list[int], ahead: list[int] | None) -> tuple[str, int]:
    """The ASCII-least edit that keeps to the least cost, and the state after it.

    ``here`` and ``ahead`` are the costs before and after the row; after the
    last row ``code`` is None and only inserts are left.
    """
    want = here[state]
    if code is not None and want == DELETE + ahead[state]:
        return "D", state
    for letter in "ua":
        then = NEXT.get((state, letter))
        if then is not None and want == INSERT + here[then]:
            return "I", then
    if code is not None and code < GONE:
        extra, own = TRUNCATED * (code >= 4), INITIALS[code % 4 : code % 4 + 1]
        for edit, letters, cost in (("K", own, 0), ("R", "ua", REROLE)):
            for letter in letters:
                then = NEXT.get((state, letter))
                if then is not None and want == cost + extra + ahead[then]:
                    return edit, then
    raise ValueError("no edit keeps to the cost")


# --- rows -------------------------------------------------------------------------

_BLANK = r"[^\x20\x09-\x0D]"


def or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with a planted fault by the checksum of ``conv_id:turn``; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it,
    4 makes it the user's.  Returns conv_id, turn, role, text.
    """
    fault = (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20).alias("fault")
    rows = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _order(rows: DataFrame) -> DataFrame:
    """Adds what rows of a conversation are ordered by beside the turn."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


ORDER = ("turn", "digest")


def _numbered(rows: DataFrame) -> DataFrame:
    """Staged rows without texts, numbered in their conversation: blank, cut, initial, place, n."""
    initial = F.substring("role", 1, 1)
    narrow = _order(rows).select(
        "conv_id",
        *ORDER,
        (~F.col("text").rlike(_BLANK)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
    )
    return stage(number_rows(stage(narrow, "turns"), list(ORDER), ["conv_id"], "place", "n"), "turns")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of about sqrt(n) rows: their codes, faults, turns, and the initials at their ends."""
    numbered = _numbered(rows)
    # First sightings have a key each, so that a text that comes very often is no hot key of this join.
    firsts = numbered.where("NOT blank").groupBy("conv_id", "digest").agg(F.min("place").alias("_p")).select(F.col("conv_id").alias("_c"), "_p")
    marked = numbered.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p")), "left")
    duplicate = ~F.col("blank") & F.col("_p").isNull()
    own = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.when(F.col("blank") | duplicate, GONE).otherwise(own + F.when(F.col("cut"), 4).otherwise(0)).cast("int")
    size = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")
    member = F.struct("place", "turn", "digest", code.alias("code"), "initial")
    grouped = marked.groupBy("conv_id", F.floor(F.col("place") / size).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("m"),
        F.count_if("blank").alias("blank"),
        F.count_if(duplicate).alias("duplicate"),
        F.count_if(~F.col("blank") & ~duplicate & F.col("cut")).alias("truncated"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
    )
    legal = lambda i: F.concat(F.get("m", i - 1)["initial"], F.get("m", i)["initial"]).isin("su", "ua", "au")
    pairs = F.filter(F.sequence(F.lit(1), F.size("m") - 1), lambda i: ~legal(i))
    return grouped.select(
        "conv_id",
        "block",
        F.element_at("m", 1)["place"].alias("place"),
        F.element_at("m", 1)["turn"].alias("turn"),
        F.element_at("m", 1)["digest"].alias("digest"),
        F.transform("m", lambda x: x["code"]).alias("codes"),
        "blank",
        "duplicate",
        "truncated",
        F.when(F.size("m") > 1, F.size(pairs)).otherwise(0).cast("long").alias("illegal"),
        F.element_at("m", 1)["initial"].alias("first"),
        F.element_at("m", -1)["initial"].alias("last"),
        "low",
        "high",
        F.size(F.array_compact(F.array_distinct(F.transform("m", lambda x: x["turn"])))).cast("long").alias("turns"),
    )


def _with_tables(blocks: DataFrame) -> DataFrame:
    """Adds the cheapest ways through each block, as 16 numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            tables = []
            for codes in map(bytes, batch.column("codes").to_pylist()):
                table = known.get(codes) or through(codes).ravel().tolist()
                if len(codes) <= 4:  # a few thousand different ones
                    known[codes] = table
                tables.append(table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables, pa.list_(pa.int64()))], names=[*batch.schema.names, "table"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{fields}, table array<bigint>")


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def facts_and_borders(blocks: list[dict]) -> tuple[list[int], list[list[int]]]:
    """The figures of one conversation, and the cost vector behind each of its blocks, in order."""
    ahead, borders = last_vector().tolist(), []
    for b in reversed(blocks):
        borders.append(ahead)
        rows = [b["table"][i : i + 4] for i in range(0, 16, 4)]
        ahead = [min(x + y for x, y in zip(row, ahead, strict=True)) for row in rows]
    seams = list(zip(blocks, blocks[1:], strict=False))
    illegal = sum(b["illegal"] for b in blocks) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in seams)
    lows, highs = ([b[k] for b in blocks if b[k] is not None] for k in ("low", "high"))
    distinct = sum(b["turns"] for b in blocks) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in seams)
    gaps = min(max(highs) - min(lows) + 1 - distinct, 2**63 - 1) if lows else 0
    return [gaps, *(sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated")), illegal, ahead[START]], borders[::-1]


def _headers(blocks: DataFrame) -> DataFrame:
    """A row per block: where it begins, its codes, the cost vector behind it, and its conversation's figures."""
    narrow = ("block", "table", "illegal", "first", "last", "low", "high", "turns", "blank", "duplicate", "truncated")
    grouped = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*narrow))).alias("blocks"))
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, figures, vectors_, numbers = [], [], [], []
            for conv, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                facts, borders = facts_and_borders(members)
                ids += [conv] * len(borders)
                numbers += [m["block"] for m in members]
                figures += [facts] * len(borders)
                vectors_ += borders
            columns = [pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int64()), pa.array(figures, pa.list_(pa.int64())), pa.array(vectors_, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_c", "_b", "facts", "ahead"])

    borders = grouped.mapInArrow(run, f"_c {kind}, _b bigint, facts array<bigint>, ahead array<bigint>")
    joined = blocks.join(borders, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    return joined.select("conv_id", "turn", "digest", "block", "place", "codes", "ahead", "facts")


class _Walk:
    """One conversation on its way: edits so far, the hash of the repaired texts, the block at hand."""

    def __init__(self, conv):
        self.conv, self.state, self.row = conv, START, 0
        self.edits, self.hash, self.any = [], hashlib.sha256(), False
        self.waiting: list[tuple] = []
        self.codes, self.costs, self.at, self.facts = b"", [], 0, [0] * len(FACTS)

    def header(self, place: int, codes: list[int], ahead: list[int], facts: list[int]) -> None:
        self.waiting.append((place, bytes(codes), ahead))
        self.facts = facts

    def emit(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.any else "").encode() + role.encode() + b":" + text.encode())
        self.any = True

    def step(self, code: int | None, here: list[int], ahead: list[int] | None) -> str:
        edit, then = tight_edit(code, self.state, here, ahead)
        self.edits.append(edit)
        if edit == "I":
            self.emit("user" if then == USER else "assistant", "")
        self.state = then
        return edit

    def text(self, role: str, text: str) -> None:
        if self.at == len(self.codes):
            self.waiting.sort(key=lambda w: w[0])
            _, self.codes, ahead = self.waiting.pop(0)
            self.costs, self.at = vectors(self.codes, ahead), 0
        code, here, ahead = self.codes[self.at], self.costs[self.at], self.costs[self.at + 1]
        self.at += 1
        while (edit := self.step(code, here, ahead)) == "I":
            pass
        if edit == "K":
            self.emit(role, text)
        elif edit == "R":
            self.emit("user" if self.state == USER else "assistant", text)

    def result(self) -> tuple:
        end = last_vector().tolist()
        while end[self.state]:
            self.step(None, end, None)
        return self.conv, *self.facts, "".join(self.edits), self.hash.hexdigest()


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row per conversation: its faults, the least cost of its repair, the edits and the hash of the outcome.

    ``rows`` has conv_id, turn, role, text without nulls in role and text (see
    ``damage``); ``ids`` names further conversations to report.  Rows are taken
    by turn (null first); rows of one turn by a hash of role and text, so equal
    rows are neighbours.  A row counts by its first fault: blank, duplicate,
    truncated.  Edits are D(elete), I(nsert), K(eep), R(erole).

    A null conv_id is a conversation of its own, and one without rows has zeros,
    an empty audit and the hash of the empty text.  A role other than those of
    the pattern, the empty one too, cannot be kept.  A span of turns beyond the
    range of a long counts as its largest number.  Further columns are not used.

    Blocks are made and combined in parallel, whatever the length of a
    conversation; only the last pass, which hashes the repaired text in its order,
    goes through a conversation from end to end, and it holds one block at a time.
    """
    blocks = stage(_with_tables(_blocks(rows)), "blocks")
    headers = _headers(blocks).withColumns({"kind": F.lit(1), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    texts = _order(rows).select("conv_id", *ORDER, F.lit(2).alias("kind"), "role", "text")
    stream = headers.unionByName(texts, allowMissingColumns=True)
    if ids is not None:
        stream = stream.unionByName(ids.select("conv_id").distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "kind", "block")
    stream = stream.select("conv_id", "kind", "role", "text", "place", "codes", "ahead", "facts")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *FACTS, "audit", "repaired_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, done, id_type = None, [], pa.int64()

        def out() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for whole in batches:
            id_type = whole.schema.field(0).type
            for batch in pieces([whole]):
                columns = [batch.column(i).to_pylist() for i in range(8)]
                for conv, sort, role, text, place, codes, ahead, facts in zip(*columns, strict=True):
                    if walk is None or walk.conv != conv:
                        if walk is not None:
                            done.append(walk.result())
                        walk = _Walk(conv)
                    if sort == 1:
                        walk.header(place, codes, ahead, facts)
                    elif sort == 2:
                        walk.text(role, text)
            if done:
                yield out()
        if walk is not None:
            done.append(walk.result())
        yield out()

    return stream.mapInArrow(run, ", ".join([f"conv_id {kind}", *[f"{f} bigint" for f in FACTS], "audit string", "repaired_sha256 string"]))
