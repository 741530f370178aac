"""Checked queries: near-duplicate pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import sign_bits
from ..operators import features
from ..operators.near_duplicates import near_duplicates, with_word_shingles
from .checks_rules import WORDS_SQL
from .derived import read
from .registry import REGISTRY, rounded

query = REGISTRY.add

#: Sets of 5-word runs; texts with the same set by their smallest id; pairs of those by a join on every run.
_PAIRS_SQL = rf"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS ws FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct([CAST('0x' || substr(md5(array_to_string(ws[i : i + 4], ' ')), 1, 13) AS BIGINT) FOR i IN range(1, greatest(len(ws) - 4, 1) + 1)])) AS bits FROM w WHERE len(ws) > 0),
    k AS (SELECT bits, min(doc_id) AS id, count(*) AS n FROM s GROUP BY bits),
    t AS (SELECT id, unnest(bits) AS bit FROM k),
    c AS (SELECT a.id AS l, b.id AS r, count(*) AS c FROM t a JOIN t b ON a.bit = b.bit AND a.id < b.id GROUP BY ALL),
    p AS (SELECT l, r, x.n AS ln, y.n AS rn, c, c / CAST(len(x.bits) + len(y.bits) - c AS DOUBLE) AS score FROM c JOIN k x ON x.id = l JOIN k y ON y.id = r WHERE c / CAST(len(x.bits) + len(y.bits) - c AS DOUBLE) >= 0.75e0)"""


def _documents(spark, folder):
    docs = with_word_shingles(read(spark, folder, "documents").select("doc_id", "text"), "text", "bits", features.WORDS)
    return near_duplicates(docs, "doc_id", "bits", threshold=0.75)


@query("near_duplicate_pairs", f"WITH {_PAIRS_SQL} SELECT l AS left_id, r AS right_id, ln AS left_size, rn AS right_size, CAST(c AS INT) AS common, round(score, 6) AS similarity FROM p")
def near_duplicate_pairs(spark, folder):
    """All pairs of different documents that share three quarters of their 5-word runs, a group of copies as one."""
    return rounded(_documents(spark, folder).pairs, similarity=6)


@query(
    "near_duplicate_links",
    f"""WITH {_PAIRS_SQL}, e AS (SELECT id, sum(n) AS linked FROM (SELECT l AS id, rn AS n FROM p UNION ALL SELECT r, ln FROM p) GROUP BY id)
        SELECT d.doc_id, coalesce(k.id, d.doc_id) AS class_id, coalesce(k.n, 1) AS class_size, CAST(coalesce(k.n - 1, 0) + coalesce(e.linked, 0) AS BIGINT) AS links
        FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN k ON k.bits = s.bits LEFT JOIN e ON e.id = k.id""",
)
def near_duplicate_links(spark, folder):
    """Every document with its class of copies and the number of documents it is linked with."""
    return _documents(spark, folder).rows


@query(
    "near_duplicate_vectors",
    """WITH e AS (SELECT vec_id, [i - 1 FOR i IN range(1, len(embedding) + 1) IF embedding[i] > 0] AS bits FROM embeddings),
        k AS (SELECT bits, min(vec_id) AS id, count(*) AS n FROM e WHERE len(bits) > 0 GROUP BY bits),
        p AS (SELECT a.id AS l, b.id AS r, a.n AS ln, b.n AS rn, len(list_intersect(a.bits, b.bits)) AS c, 2 * len(list_intersect(a.bits, b.bits)) / CAST(len(a.bits) + len(b.bits) AS DOUBLE) AS score FROM k a JOIN k b ON a.id < b.id)
        SELECT l AS left_id, r AS right_id, ln AS left_size, rn AS right_size, CAST(c AS INT) AS common, round(score, 6) AS similarity FROM p WHERE score >= 0.8e0""",
)
def near_duplicate_vectors(spark, folder):
    """Vectors whose positive places agree by 0.8 of dice."""
    signs = read(spark, folder, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("bits"))
    return rounded(near_duplicates(signs, "vec_id", "bits", "dice", 0.8).pairs, similarity=6)
