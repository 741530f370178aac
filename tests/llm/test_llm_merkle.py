import hashlib
import zlib

import pytest
from fixtures import awkward, empty
from pyspark.sql import functions as F

from assayer.llm import merkle
from assayer.llm.common import crc32_fold


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """Every proof by walking plain lists of nodes."""
    def leaf(r, more=0):
        return h(*(cell(v) for v in (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))

    def climb(nodes, at):
        out = []
        while len(nodes) > 1:
            other = at ^ 1
            out.append((other - at, nodes[other]) if other < len(nodes) else (0, ""))
            nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
        return nodes[0], out

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots = [climb([leaf(r) for r in groups[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        nodes = [leaf(r) for r in groups[g]]
        root, outer = climb(subroots, k)
        for i, r in enumerate(groups[g]):
            way = climb(nodes, i)[1] + outer
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, int(bad))
            for side, other in way:
                node = h(other, node) if side < 0 else h(node, other)
            out.append((r["doc_id"], nodes[i], subroots[k], root, h(*(x for _, x in way)), node, node == root))
    return sorted(out, key=repr)


def proved(docs, height=2):
    tampered = F.col("doc_id").isNotNull() & (crc32_fold("doc_id", 7) == 0)
    manifest = merkle.Manifest(merkle.document_leaves(docs, tampered=tampered), height)
    return manifest, sorted((tuple(r) for r in merkle.verify_documents(manifest).collect()), key=repr)


@pytest.mark.parametrize("height", [0, 1, 2, 3, 6, 7])
def test_addresses_are_a_van_emde_boas_order(height):
    found = merkle.addresses(height)
    assert sorted(found) == list(range(2 ** (height + 1) - 1))
    if height == 3:  # 4 levels: the upper two, then four subtrees of two levels
        assert found.tolist() == [0, 1, 2, 3, 6, 9, 12, 4, 5, 7, 8, 10, 11, 13, 14]
    assert merkle.node_address(height, height, 0) == 0


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 8, 11, 16])
def test_siblings_of_one_block(leaves):
    texts = [h(str(i)) for i in range(leaves)]
    height = merkle.height_of(0, leaves, 9)
    nodes, root = merkle.build_block(texts, height)
    for i in range(leaves):
        way = merkle.siblings(nodes, height, leaves, i)
        assert merkle.fold(texts[i], way) == root and merkle.unpack_path(merkle.pack_path(way)) == way


def test_several_levels_of_blocks(spark):
    """A hot language, one document alone, and a null language, in blocks of four."""
    langs = ["en"] * 5 + ["fr", None]
    rows = [(i * 3, f"s{i % 4}" if i % 9 else None, langs[i % 7] if i else "zz", i if i % 5 else None, f"text {i}" if i % 6 else None) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    manifest, found = proved(docs)
    assert len(manifest.levels) > 2 and found == brute([r.asDict() for r in docs.collect()])
    assert len({r[3] for r in found}) == 1 and any(not r[6] for r in found) and any(r[6] for r in found)
    assert manifest.root.first()[0] == found[0][3]


def test_awkward_and_empty(spark):
    docs = awkward(spark).drop("source", "token", "node", "path", "shard", "score").selectExpr("*", "'x' AS node", "1 AS place", "'t' AS tree", "null AS source", "'r' AS root")
    found = proved(docs, 12)[1]
    assert found == brute([r.asDict() for r in docs.collect()]) and len(found) == docs.count()
    manifest, found = proved(empty(spark))
    assert found == [] and manifest.root.count() == 0


def test_written_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s", "en", 1, "t") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.Manifest(merkle.document_leaves(docs), 3)
    manifest.write(str(tmp_path / "manifest"))
    blocks = spark.read.parquet(str(tmp_path / "manifest"))
    assert blocks.where("kind = 'group' AND level = 0").count() == 5 and blocks.where("kind = 'top'").count() == 1
    assert all(len(r["nodes"]) == 32 * (2 ** (r["height"] + 1) - 1) for r in blocks.collect())
