import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, empty
from tokenizers import Tokenizer

from assayer.llm import grouped_packing as gp
from assayer.llm.common import stage
from assayer.llm.queries import tokenizer_path


def check_sequences(rows, capacity):
    """rows: (length, sequence_id, offset); offsets without gaps, nothing above the capacity."""
    by_sequence = {}
    for length, sequence, offset in rows:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def assigned(spark, lengths, capacity=1024, groups=gp.GROUPS):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "piece_id long, length int").repartition(4)
    rows = gp.assign(stage(df, "lengths"), capacity, groups).select("piece_id", "length", "sequence_id", "offset").collect()
    assert sorted(r["piece_id"] for r in rows) == list(range(len(lengths)))
    assert all(lengths[r["piece_id"]] == r["length"] for r in rows)
    return check_sequences([tuple(r)[1:] for r in rows], capacity)


def test_the_programme_finds_known_optima():
    # 3 of 40 in 120 beside nothing; 70 + 50 pairs: 10 + 20 sequences
    found = gp.configurations(np.array([70, 50, 40]), np.array([20.0, 20.0, 30.0]), 120)
    assert sum(n for _, n in found) == 30
    covered = sum(c * n for c, n in found)
    assert (covered >= [20, 20, 30]).all()
    worth, column = gp.best_configuration(np.array([70, 50, 40]), np.array([0.6, 0.4, 0.3]), 120)
    assert worth == pytest.approx(1.0) and column.tolist() == [1, 1, 0]


def test_small_plan_is_best_fit():
    """By counts as one by one: the same rooms are left."""
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randrange(1, 26) for _ in range(rng.randrange(120))]
        rooms = [rng.randrange(60) for _ in range(rng.randrange(30))]
        counts, have = np.bincount(lengths or [0], minlength=101), np.bincount(rooms or [0], minlength=101)
        counts[0] = 0
        plan = gp.plan_small(counts, have if rooms else have * 0, 100)
        left = {(r, i): r for r, n in Counter(rooms).items() for i in range(n)}
        ranks = Counter()
        for n in lengths:
            room, at = plan.place(np.array([n]), np.array([ranks[n]]))
            ranks[n] += 1
            bin_ = (int(room[0]), int(at[0]))
            left.setdefault(bin_, 100)
            assert bin_[0] == gp.OPENED or bin_ in left
            left[bin_] -= n
        assert min(left.values(), default=0) >= 0
        plain = list(rooms)
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(plain) if r >= n]
            if fits:
                plain[min(fits, key=lambda i: plain[i])] -= n
            else:
                plain.append(100 - n)
        assert sorted(left.values()) == sorted(plain)


@pytest.mark.parametrize("kind", ["even", "few", "long", "short", "one"])
def test_few_sequences(spark, kind):
    rng = random.Random(kind)
    lengths = {
        "even": [rng.randrange(1, 1025) for _ in range(6000)],
        "few": [rng.choice([1024, 700, 400, 350, 324, 100]) for _ in range(4000)],
        "long": [rng.randrange(500, 1024) for _ in range(3000)],
        "short": [rng.randrange(1, 60) for _ in range(5000)],
        "one": [341],
    }[kind]
    used = assigned(spark, lengths)
    bound = -(-sum(lengths) // 1024)
    print(kind, used, bound, best_fit(lengths, 1024))
    assert used <= 1.02 * best_fit(lengths, 1024) + 1
    if kind == "even":
        assert used <= 1.02 * bound


def test_grouping_rounds_up(spark):
    """With few groups the result is still whole, only wider."""
    lengths = [random.Random(1).randrange(1, 1025) for _ in range(1500)]
    assert assigned(spark, lengths, groups=8) >= assigned(spark, lengths)


def test_pieces_are_those_of_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = awkward(spark, ["word " * 3000, "ü" * 500, "a  b\n\n c", "x<|endoftext|>y", "one more"])
    rows = gp.pack(docs, tokenizer_path(), with_ids=True).collect()
    check_sequences([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 1024)
    expected = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = array("I", ids[a:b]).tobytes()
            expected[(r["doc_id"], i, a, b - a, zlib.crc32(part), part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == expected


def test_sequences_and_empty_table(spark):
    packed = gp.pack(awkward(spark), tokenizer_path(), with_ids=True)
    packed = stage(packed, "packed")
    whole = {r["sequence_id"]: (r["tokens"], bytes(r["ids"])) for r in gp.sequences(packed).collect()}
    assert all(4 * n == len(ids) and n <= 1024 for n, ids in whole.values())
    for r in packed.collect():
        assert whole[r["sequence_id"]][1][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert gp.pack(empty(spark), tokenizer_path()).collect() == []


def test_plain_call_and_ordinary_text():
    """Both readings of a special token's string, and words too long to remember."""
    from assayer.llm.packing import Encoder

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y z", "plain text", "w" * 500 + " " + "q" * 41 + " end"]
    plain = Encoder(tokenizer_path(), special_tokens=True)
    assert [array("I", ids).tolist() for ids in plain.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert plain.encode(texts[-1:]) == plain.encode(texts[-1:]) and max(map(len, plain.words)) <= 40
    tokenizer.encode_special_tokens = True
    assert [array("I", ids).tolist() for ids in Encoder(tokenizer_path()).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
