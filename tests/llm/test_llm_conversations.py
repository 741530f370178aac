import hashlib
import random
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from assayer.llm import conversations as cv

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def repaired(rows):
    """All edits tried from the front, with the least audit among the cheapest ways."""
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest())
    rows = sorted(rows, key=order)
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    follow = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if i < len(rows):
            cost, edits, texts = best(i + 1, last, 0)
            ways.append((cost + 4, "D" + edits, texts))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for edit, role, more in [("K", rows[i][2], 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if (last, role[:1]) in follow:
                        cost, edits, texts = best(i + 1, role[0], 0)
                        ways.append((cost + extra + more, edit + edits, (f"{role}:{rows[i][3]}", *texts)))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (last, role[0]) in follow:
                    cost, edits, texts = best(i, role[0], inserted + 1)
                    ways.append((cost + 3, "I" + edits, (f"{role}:", *texts)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, texts = best(0, "", 0)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    count = [sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())


def brute(rows, ids):
    groups = {i: [] for i in ids}
    for r in rows:
        groups[r[0]].append(r)
    return {i: repaired(g) for i, g in groups.items()}


def found(df, ids=None):
    out = cv.repair(df, ids)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in out.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None]
    texts = ["Yes.", "no", "Well?\n ", "  ", "", None, "a.b", "ok!", "é.", "x" * 300 + "."]
    for conv in [*range(conversations), None]:
        for turn in range(rng.randrange(1, longest)):
            if rng.random() < 0.9:
                tick = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2])
                yield conv, tick, rng.choice(roles[:5] if rng.random() < 0.9 else roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(99)}."


SCHEMA = "conv_id long, turn long, role string, text string"


def test_damage_and_repair_as_brute_force(spark):
    rows = list(random_rows(5, 150, 14))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ids = {r[0] for r in rows}
    assert found(cv.damage(df), df.select("conv_id")) == brute(damaged(rows), ids)


def test_a_conversation_of_many_blocks(spark):
    """A third of all rows in one conversation, with a text that comes over and over."""
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Same again.", f"Text {i}", f"Text {i}."])) for i in range(300)]
    rows += list(random_rows(6, 60, 12))
    df = spark.createDataFrame(rows, SCHEMA).fillna(" ", ["role", "text"]).repartition(3)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert found(df) == brute(plain, {r[0] for r in rows})


def test_tables_of_blocks_make_the_vectors():
    rng = random.Random(1)
    for _ in range(60):
        codes = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 40)))
        end = cv.last_vector()
        walked = cv.vectors(codes, end.tolist())[0]
        cut = rng.randrange(1, len(codes) + 1)
        table = cv.through(codes[:cut])
        behind = cv.vectors(codes[cut:], end.tolist())[0] if cut < len(codes) else end.tolist()
        assert [min(a + b for a, b in zip(row, behind)) for row in table.tolist()] == walked


def test_edges(spark):
    empty_hash = hashlib.sha256(b"").hexdigest()
    none = spark.createDataFrame([], SCHEMA)
    assert found(none) == {} and found(none, spark.createDataFrame([(3,), (None,), (3,)], "conv_id long")) == {k: (0, 0, 0, 0, 0, 0, "", empty_hash) for k in (3, None)}
    rows = [(1, 2**63 - 1, "user", "a."), (1, -(2**63), "assistant", "b."), (2, None, "system", "only."), (3, 5, "user", "x" * 3_000_000 + "."), (3, 6, "assistant", "!")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS block", "'c' AS codes", "9 AS n")
    result = found(df)
    assert result[1][0] == 2**63 - 1 and {k: result[k] for k in (2, 3)} == {k: v for k, v in brute(rows, {1, 2, 3}).items() if k > 1}


def test_damage_keeps_other_rows(spark):
    rows = list(random_rows(8, 40, 9))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, cv.damage(df).collect()), key=repr) == sorted(damaged(rows), key=repr)
    assert cv.damage(df.select("*", F.lit(1).alias("fault"), F.lit(2).alias("copy"))).count() == len(damaged(rows))
