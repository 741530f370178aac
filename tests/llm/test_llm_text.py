"""Page text, packing, sharding and fingerprints."""

import collections
import hashlib
import html as entities
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import html_text, imatch, packing, sharding
from assayer.llm.queries import LLM, tokenizer_path
from llm.fixtures import awkward, empty

FOLDER = "/root/testdata/sf0.01"


def test_articles_of_all_pages(spark):
    """On these pages the article's own blocks are the text."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = LLM.queries["op5_html_blocks"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


STORY = "This is the story of a man that was on the road with his dog and it is long enough to be a block."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<div class='site-menu'><p>{STORY}</p></div><p>{STORY}</p>", STORY),
        (f"<main><h2>Head</h2><p>{STORY}<p>Yes.</main><footer>{STORY}</footer>", f"Head\n{STORY}\nYes."),
        (f"<article><p>{STORY}</p><form><p>{STORY}</p></form><section id=comments><p>{STORY}</p></section></article>", STORY),
        (f"<p>{STORY}</p><ul><li><a href=1>One link here</a><li><a href=2>Another link</a></ul><p>Short.</p><p>{STORY}</p>", f"{STORY}\nShort.\n{STORY}"),
        (f"<p>{STORY}</p><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>{STORY}</p> -->", STORY),
        (f"<p>{STORY}</p><p>&copy; 2020 Some Company, all rights reserved</p>", STORY),
        ("<article><p>a <b>b</b>\n\t c&nbsp;d<br>e &lt;x&gt; 1 < 2</p><p hidden>no</p></article>", "a b c d e <x> 1 < 2"),
        ("<article><p title=\"a>b\">kept</p><p title='broken>also</p>", "kept\nalso"),
    ],
)
def test_page_rules(html, text):
    assert html_text.main_text(html or "") == text


LAW = "Copyright law in the city was a matter that the council had to decide about before the end of the year, and so it did."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f'<article class="post comments-open"><p>{STORY}</p><p>{LAW}</p></article>', f"{STORY}\n{LAW}"),
        (f'<article class="post type-post has-sidebar"><p>{STORY}</p><p>{LAW}</p></article>', f"{STORY}\n{LAW}"),
        (f'<div class="entry ad-free"><p>{STORY}</p><p>{LAW}</p></div>', f"{STORY}\n{LAW}"),
        (f'<div id="page" class="has-sidebar"><article><p>{STORY}</p></article></div>', STORY),
        (f'<div class="entry-title">Bridge</div><div><p>{STORY}</p></div>', f"Bridge\n{STORY}"),
        (f"<main>A line</main><div><p>{STORY}</p><p>{LAW}</p></div>", f"A line\n{STORY}\n{LAW}"),
        (f'<div class="sidebar"><p>{STORY}</p><p>{LAW}</p></div>', f"{STORY}\n{LAW}"),
        (f'<article><h1>T</h1><p>{STORY}</p><div class="related"><article class="post"><p>{LAW}</p></article></div></article>', f"T\n{STORY}\n{LAW}"),
        (f'<article><p>{STORY}</p><div class="comments"><div class="comment entry-comment"><p>{LAW}</p></div></div></article>', STORY),
        (f'<article><p>{STORY}</p></article><div class="ad-slot"><p>{LAW}</p></div><p>Imprint</p><p><a href="x">All of our other pages in one long list of links</a></p>', STORY),
    ],
)
def test_votes_of_names_and_text(body, text):
    page = f"<html><body><nav><a href=x>Home</a><a href=y>News of the day</a></nav>{body}<footer>Foot</footer></body></html>"
    assert html_text.main_text(page) == text


def test_pages_without_article_elements(spark):
    """The rules of pass one and two find nearly all of the text when no element tells where the article is."""
    common = found = kept = 0
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        want = collections.Counter(html_text.main_text(r["html"]).split("\n"))
        got = collections.Counter(html_text.main_text(re.sub("<(/?)article>", r"<\1div>", r["html"])).split("\n"))
        common, found, kept = common + sum((want & got).values()), found + sum(got.values()), kept + sum(want.values())
    assert common / kept > 0.95 and common / found > 0.85


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>Some text</p>", "y"), (2, "u", "<" * 50_000, "z"), (2, "u", "<a <b " * 5_000, "z"), (3, "u", "<div>" * 20_000 + "deep", "z")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] == 3} == {"deep"}
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def check_packing(rows, texts):
    """Pieces of every document are gapless and have its ids; sequences are gapless too."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return 1 - sum(r["length"] for r in rows) / 1024 / len(by_sequence)


def test_packing_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert check_packing(LLM.queries["op7_harmonic_packing"](spark, FOLDER).collect(), texts) < 0.02


def test_packing_of_odd_texts(spark):
    odd = ["  a  b\n \n c  ", " x", "a \n", "\n\n a", "<|endoftext|> hi", "it's  I'll 12 345 naïve\t\tx", "日本 語テ スト 😀", "a  b \u0085 c", "word " * 5000]
    docs = awkward(spark, odd).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    everything = awkward(spark, odd)
    pieces = packing.pack(everything, tokenizer_path())
    assert pieces.where("start = 0").count() == everything.count() and packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_memory_of_words_is_bounded_in_characters(monkeypatch):
    plain, small = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path())
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    for i in range(30):
        texts = [" ".join(f"word{i}x{j}" * 3 for j in range(40)), "the same words here " + "y" * 900]
        assert small.encode(texts) == plain.encode(texts)
    assert sum(map(len, small.words)) == small.held < 3_000


def test_classes_hold_a_fixed_number_of_pieces():
    for tokens in range(1, 3000, 7):
        cut = packing.cut(tokens, 1024, 3)
        assert sum(n for n, _ in cut) == tokens
        assert all(n * k <= 1024 < n * (k + 1) or n == 1024 // k for n, k in cut)
    bins = packing.Bins(1024, 0)
    for i in range(10):
        bins.add((i, 0, 341, b"", 341), 3)
    assert len(bins.done) == 9 and len(bins.open[3]) == 1
    bins.finish()
    assert len(bins.done) == 10 and not bins.open


def shard_brute(doc, shards):
    unit = lambda s: (int(hashlib.md5(f"{doc}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min(range(shards), key=lambda s: (-math.log(unit(s)), s))


def test_shards_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = LLM.queries["op8_rendezvous_sharding"](spark, FOLDER).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == shard_brute(r["doc_id"], 24) and r["grown_shard"] == shard_brute(r["doc_id"], 25)
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_awkward_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 3)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sizes = {r["shard"]: r["count"] for r in sharding.assign_shards(docs, [1, 3]).groupBy("shard").count().collect()}
    assert 0.7 < sizes[1] / 4000 < 0.8
    odd = awkward(spark)
    rows = sharding.assign_shards(odd, [1.0] * 3, [1.0] * 4).collect()
    assert len(rows) == odd.count() and sharding.assign_shards(empty(spark), [1.0]).count() == 0
    assert sorted(r["size"] for r in rows)[:3] == [8, 8, 8]
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    with pytest.raises(ValueError):
        sharding.shard_of("doc_id", [])


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = awkward(spark).drop("shard")
    sharding.write_shards(docs, str(tmp_path / "out"), [1.0, 1.0])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.where(F.col("shard") != sharding.shard_of("doc_id", [1.0, 1.0])).count() == 0


def fingerprint_brute(text, counts, total):
    words = set(re.findall(r"[^\W_]+", text.lower()))
    slots = {w: (h := xxhash.xxh64_intdigest(w.encode(), 42)) % imatch.SLOTS if (h := xxhash.xxh64_intdigest(w.encode(), 42)) < 2**63 else (h - 2**64) % imatch.SLOTS for w in words}
    limit = math.floor(max(imatch.LEAST_DOCS, imatch.MOST_SHARE * total))
    terms = {xxhash.xxh64_intdigest(w.encode(), 42) for w in words if imatch.LEAST_DOCS <= counts[slots[w]] <= limit}
    out = []
    for scale, parts in imatch.SCALES:
        width = 1 << (30 - scale)
        for p in range(parts):
            low = p * width if scale <= 3 else int(hashlib.md5(f"{scale}:{p}".encode()).hexdigest()[:8], 16) % (2**30 - width + 1)
            out.append(frozenset(t for t in terms if low <= t >> 34 < low + width))
    return out


def test_fingerprints_against_sets(spark):
    """Parts are equal in the fingerprint where the sets of terms are, and likeness follows."""
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    counts = collections.Counter()
    for t in texts.values():
        counts.update({xxhash.xxh64_intdigest(w.encode(), 42) % imatch.SLOTS for w in set(re.findall(r"[^\W_]+", t.lower()))})
    sets = {d: fingerprint_brute(t, counts, len(texts)) for d, t in texts.items()}
    rows = {r["doc_id"]: r for r in LLM.queries["op2_imatch_fingerprints"](spark, FOLDER).collect()}
    seen, order = {}, sorted(texts)
    for i, d in enumerate(order):
        after = texts[order[(i + 1) % len(order)]]
        n, r = len(texts[d]), rows[d]
        edited = texts[d][: n - n // 2] + after[: n // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for part, terms in zip(re.findall("....", r["fingerprint"]), sets[d], strict=True):
            assert (part == "----") == (not terms)
            assert seen.setdefault(terms, part) == part
        told = same = at = 0
        for _, parts in imatch.SCALES:
            pairs = [(a, b) for a, b in zip(sets[d][at : at + parts], sets[order[(i + 1) % len(order)]][at : at + parts], strict=True) if a or b]
            at += parts
            if len(pairs) * 4 <= parts * 3:
                told, same = told + len(pairs), same + sum(a == b for a, b in pairs)
        if told:
            assert r["near_next"] == pytest.approx(same / told, abs=0.03)
    near = [(r["near_edited"], r["near_next"]) for r in rows.values()]
    assert np.mean([a for a, _ in near]) > 0.2 > 0.05 > np.mean([b for _, b in near])


def test_copies_keep_their_terms(spark):
    """Copies and near copies hold three fifths of the rows; their own words stay in the lexicon, and common words don't."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 300, n)]
    exact, near = [f"copy{i}" for i in range(60)], [f"near{i}" for i in range(200)]
    texts = [" ".join(["the", *exact])] * 150
    texts += [" ".join(["the", *near[:k], f"edit{j}", *near[k + 1 :]]) for j, k in enumerate(rng.integers(0, 200, 150))]
    texts += [" ".join(["the", *word(20)]) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    band = imatch.lexicon(docs)
    asked = spark.createDataFrame([(w,) for w in ["the", *exact, *near]], "text string")
    held = {r["text"] for r in asked.where(imatch._has(band, imatch.word_hashes("text")[0], imatch.SLOTS)).collect()}
    assert held == {*exact, *near}
    parts = {r["doc_id"]: r["parts"] for r in imatch.fingerprints(docs).collect()}
    assert all(any(p is not None for p in parts[d]) for d in range(300)) and parts[0] == parts[149] != parts[150]


def test_parts_hold_all_terms_and_long_texts_stay_alike(spark):
    """Different short texts differ in a part; a long text with few edits is like the old one, and one with many is less so."""
    words = [f"word{i}" for i in range(60_000)]
    edits = {0: 0, 1: 3, 2: 30_000}
    long = [" ".join([f"other{i}" for i in range(n)] + words[n:]) for n in edits.values()]
    texts = long * 2 + [w for w in words[:300] for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = imatch.fingerprints(docs, most_share=1.0)
    parts = {r["doc_id"]: tuple(r["parts"]) for r in rows.collect()}
    short = [parts[d] for d in range(6, 606, 2)]
    assert all(p[0] is not None for p in parts.values()) and len(set(short)) >= 299
    a, b = (rows.where(F.col("doc_id") < 3).select(F.col("doc_id").alias(f"{n}_id"), F.col("parts").alias(n)) for n in "ab")
    like = {r["b_id"]: r["v"] for r in a.where("a_id = 0").crossJoin(b).select("b_id", imatch.likeness(F.col("a"), F.col("b")).alias("v")).collect()}
    assert like[0] == 1 and like[1] > 0.9 and 0.05 < like[2] < 0.7


def test_next_rows_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    ids = [None, None, 1, 1, 1, *range(5, 200, 3), 10**15, 2**62]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = imatch.with_next(rows, "doc_id", ["doc_id", "text"]).collect()
    follow = collections.Counter((r["doc_id"], r["next"]["doc_id"]) for r in got)
    assert follow == collections.Counter(zip(ids, [*ids[1:], ids[0]], strict=True))
    assert sorted(r["next"]["text"] for r in got) == sorted(r["text"] for r in got)


def test_edits_of_awkward_texts(spark):
    docs = awkward(spark, ["é😀x", "next one"])
    got = imatch.edit_report(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    row = next(r for r in got if r["doc_id"] == 100)
    assert row["n_chars"] == 3 and row["edited_sha256"] == hashlib.sha256("é😀n".encode()).hexdigest()
    assert imatch.edit_report(empty(spark)).count() == 0
    same = imatch.fingerprints(docs.where("doc_id in (6, 7)")).collect()
    assert same[0]["parts"] == same[1]["parts"]
