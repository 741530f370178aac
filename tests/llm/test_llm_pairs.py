"""Near-duplicate groups and benchmark overlaps against brute force; the pipeline."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import decontam, ngram_join, secret_scan
from assayer.llm.common import read
from assayer.llm.queries import LLM
from llm.fixtures import awkward, empty

FOLDER = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups_brute(rows):
    """(size, smallest reachable id) of (id, text) pairs, by comparing all that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for sh in s for j in holders[sh]}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for sh in s:
            holders[sh].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(len(s), low[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def check_groups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(docs).collect()}
    assert got == {d: e for (d, _), e in zip(rows, groups_brute(rows), strict=True)}


def test_groups_of_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in LLM.queries["op1_ngram_jaccard_join"](spark, FOLDER).collect()}
    assert got == {d: e for (d, _), e in zip(rows, groups_brute(rows), strict=True)}


def test_chains_passages_and_near_copies(spark, monkeypatch):
    """Groups that hang on single links, a passage in half of the texts, edges of the limit, small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    texts, chain = [], word(120)
    for step in range(30):
        texts.append(" ".join(chain))
        chain = chain[3:] + word(3)
    passage, base = word(60), word(100)
    for i in range(60):
        texts.append(" ".join(word(30) + passage * (i % 2) + word(30)))
    for i in range(60):
        copy = list(base)
        copy[int(rng.integers(0, 100))] = f"edit{i}"
        texts.append(" ".join(copy))
    for extra in range(8, 16):
        texts.append(" ".join(base[:36] + word(extra)))
    texts += ["", "  ", "one two", "One  TWO", "one two three four five", "É é", "é é", "a " * 400, "A " * 300]
    check_groups(spark, [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)])


def test_awkward_groups(spark):
    docs = awkward(spark, ["some text without an id"])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 39_996, 5), (5, 39_996, 5), (6, 3, 6), (7, 3, 6), (None, 1, 100), (None, 0, None), (100, 1, 100)], key=repr
    )
    assert ngram_join.ngram_groups(empty(spark)).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, 100, None], key=repr)


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(7)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        assert shared <= ngram_join.overlap_bound(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b)) <= min(len(a), len(b))


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(8)
    edges = {"path": [(i, i + 1) for i in range(70)], "star": [(50, i) for i in range(50)], "random": [tuple(map(int, e)) for e in rng.integers(0, 120, (90, 2))]}[shape]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {v: find(v) for v in parent}


def overlaps_brute(docs, items, window=16, share=0.75):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    spans = [(m, [o for o, c in enumerate(m) if c == "1"]) for m in decontam.MASKS]
    found = {}
    for d, text in docs:
        w = words(text)
        for item, body in items:
            v = words(body)
            masks = spans if len(v) >= 9 else [("1" * len(v), list(range(len(v))))]
            seeds = collections.defaultdict(list)
            for mask, ones in masks if v else []:
                for p in range(len(v) - len(mask) + 1):
                    seeds[mask, tuple(v[p + o] for o in ones)].append(p)
            for mask, ones in masks if v else []:
                for i in range(len(w) - len(mask) + 1):
                    for p in seeds.get((mask, tuple(w[i + o] for o in ones)), ()):
                        size = min(window, len(v))
                        low, high = max(i - window, i - p, 0), min(i + 9 + window, i - p + len(v), len(w))
                        equal = [w[k] == v[k - i + p] for k in range(low, high)]
                        for s in range(len(equal) - size + 1):
                            part = sum(equal[s : s + size]) / size
                            if part >= share:
                                found[d, item] = max(found.get((d, item), (0, 0)), (part, -(low + s)))
    return {k: (p, -at) for k, (p, at) in found.items()}


def test_overlaps_with_the_benchmark(spark):
    docs = [tuple(r) for r in read(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    rows = LLM.queries["op9_spaced_seed_decontamination"](spark, FOLDER).collect()
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["share"], abs=1e-6), r["word_at"]) for r in rows}
    assert overlaps_brute(docs, items) == got and len(got) == len(rows) > 0


def test_replaced_words_do_not_hide_a_passage(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    items = [(i, " ".join(word(n))) for i, n in enumerate([40, 25, 16, 9, 8, 5, 1, 0])] + [(None, " ".join(word(30))), (1, " ".join(word(20)))]
    texts = []
    for _, body in items:
        v = body.split()
        changed = [x if k % 7 != 3 else "other" for k, x in enumerate(v)]
        texts += [" ".join(word(20) + v + word(20)), " ".join(word(5) + changed), " ".join(v[: len(v) // 2] + word(30)), ", ".join(x.upper() + "!" for x in v), " ".join(word(60))]
    docs = awkward(spark, texts)
    benchmark = spark.createDataFrame([(i, t, 0.1) for i, t in items], "item_id long, text string, share double")
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["share"], abs=1e-6), r["word_at"]) for r in decontam.contaminated(docs, benchmark).collect()}
    want = {}
    for (d, i), v in overlaps_brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(k, t) for k, t in enumerate([t for _, t in items])]).items():
        key = (d, items[i][0])
        want[key] = max(want.get(key, (0, 0)), v, key=lambda x: (x[0], -x[1]))
    assert got == want and {(100, 0), (101, 0), (103, 0)} <= set(got) and (104, 0) not in got
    left = decontam.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})
    assert decontam.contaminated(empty(spark), benchmark).count() == decontam.contaminated(docs, benchmark.limit(0)).count() == 0


def test_every_window_within_the_tolerance_is_found(spark):
    """Against a comparison of all windows, without seeds: a quarter of the words replaced at all kinds of places."""
    for masks, sizes in [((*decontam.MASKS, *decontam.DENSE_MASKS), range(9, 17)), *(((m,), [n]) for n, m in decontam.SHORT_MASKS.items())]:
        reads = [[o for o, c in enumerate(m) if c == "1"] for m in masks]
        for n in sizes:
            for gone in itertools.combinations(range(n), n // 4):
                assert any(not {p + o for o in ones} & set(gone) for ones, m in zip(reads, masks, strict=True) for p in range(n - len(m) + 1)), (n, gone)
    rng = np.random.default_rng(10)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    items, texts, want = [], [], set()
    for n in [*range(1, 17), 24, 40]:
        items.append((n, " ".join(word(n))))
        for many in (n // 4, n // 4 + 1):
            for _ in range(8):
                v = items[-1][1].split()
                for k in rng.choice(n, many, replace=False):
                    v[k] = "other"
                words, body = [*word(20), *v, *word(20)], items[-1][1].split()
                size = min(16, n)
                best = max(sum(a == b for a, b in zip(words[i : i + size], body[j : j + size], strict=True)) for i in range(len(words) - size + 1) for j in range(n - size + 1))
                want |= {(len(texts), n)} if best / size >= 0.75 else set()
                texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark, short_tolerance=True).collect()}
    assert got == want


def test_large_benchmarks_are_joined_without_broadcast(spark, monkeypatch):
    args = read(spark, FOLDER, "documents"), read(spark, FOLDER, "benchmark")
    small = sorted(map(tuple, decontam.contaminated(*args).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, decontam.contaminated(*args).collect())) == small


def test_pipeline_stage_by_stage(spark):
    docs = read(spark, FOLDER, "documents")
    columns, held = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        held[name] = docs
        docs = step(spark, docs, FOLDER)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in read(spark, FOLDER, "labels").collect()}
    good, kept = {d for d, q in labels.items() if q}, ids(held["near_duplicates"])
    assert len(good - kept) <= 0.02 * len(good) and len(kept & (set(labels) - good)) <= 0.1 * len(labels)
    rows = [tuple(r) for r in held["near_duplicates"].select("doc_id", "text").collect()]
    assert ids(held["decontamination"]) == {root if size else d for (d, _), (size, root) in zip(rows, groups_brute(rows), strict=True)}
    rows = [tuple(r) for r in held["decontamination"].select("doc_id", "text").collect()]
    leaks = {d for d, _ in overlaps_brute(rows, [tuple(r) for r in read(spark, FOLDER, "benchmark").select("item_id", "text").collect()])}
    assert leaks and ids(held["secrets"]) == ids(held["decontamination"]) - leaks
    for before, after in zip(held["secrets"].orderBy("doc_id").collect(), held["packing"].orderBy("doc_id").collect(), strict=True):
        assert after["text"] == secret_scan.masked(before["text"]) and after["n_chars"] == len(after["text"])
        assert not [s for s in secret_scan.find_spans(after["text"]) if s[2] != "guess"] or "[SECRET]" in after["text"]
    assert ids(docs) == ids(held["packing"])


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert rows and max(r["n"] for r in rows) <= 1024 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_many_ids_with_one_text_are_not_broadcast(spark, monkeypatch):
    """Items are counted by their ids: a text with many of them stays out of a broadcast, with the same result."""
    text = " ".join(f"item{i}" for i in range(30))
    benchmark = spark.createDataFrame([(i, text) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {text} behind"), (2, "nothing of it at all")], "doc_id long, text string")
    whole = decontam.contaminated(docs, benchmark)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 200)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    apart = decontam.contaminated(docs, benchmark)
    assert "strategy=broadcast" in plan(whole) and "strategy=broadcast" not in plan(apart)
    rows = sorted(map(tuple, whole.collect()))
    assert len(rows) == 300 and rows == sorted(map(tuple, apart.collect()))


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_stages_take_awkward_documents(spark, tmp_path, labelled):
    """Nulls, empty and long texts, repeated rows and clashing names pass all stages, with labels and benchmark or with empty ones."""
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        (table if labelled else table.limit(0)).write.parquet(str(tmp_path / f"{name}.parquet"))
    for start in (awkward(spark, ["the same words stand here in two of these texts"] * 2), empty(spark)):
        docs, some = start, not start.isEmpty()
        for i, (name, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{'some' if some else 'none'}-{name}")
            out.write.parquet(path)
            done = spark.read.schema(out.schema).parquet(path)
            if i < 4:
                assert done.columns == docs.columns and done.count() <= docs.count()
            docs = done
        assert some or docs.isEmpty()
        if some and not labelled:  # nothing is known of quality, so the texts stay but for copies
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {None, 1, 2, 3, 4, 5, 6, 100}
