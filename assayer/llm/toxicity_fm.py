"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text and their beginnings.  The machine gives
every term a weight and a short vector; the products of vectors say what two
terms mean together, which a sum of weights can't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from assayer.llm.common import labelled_sample, pieces
from assayer.llm.quality_gam import sigmoid

#: Labelled documents that a fit looks at, at most.
SAMPLE_ROWS = 10_000
BITS, RANK = 20, 4
#: Lengths of the word beginnings that are terms beside the word itself.
STEMS = (4, 5)
#: Characters of the words of which a Python worker remembers the terms.
REMEMBERED = 4_000_000
#: Texts of the rarer label that a pair of terms stands in at least, and the standard errors by which
#: they are more than the two terms alone would have it.
PAIR_ROWS, PAIR_Z = 12, 7.0
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”‘’…–—¿¡"


class Terms:
    """Hashed terms of texts, with a memory of words."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted, self.words, self.held = wanted, {}, 0

    def of_word(self, word: str) -> tuple[int, ...]:
        word = word.strip(EDGE)
        parts = {f"w:{word}"} | {f"s:{word[:k]}" for k in STEMS if len(word) > k} if word else set()
        ids = {zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts}
        return tuple(sorted(i for i in ids if self.wanted is None or self.wanted[i]))

    def of_text(self, text: str | None) -> np.ndarray:
        """Ids of the terms of a text, each once, ascending."""
        found: set[int] = set()
        words = self.words
        for word in set((text or "").lower().split()):
            ids = words.get(word)
            if ids is None:
                if self.held >= REMEMBERED:
                    words.clear()
                    self.held = 0
                ids = words[word] = self.of_word(word)
                self.held += len(word)
            if ids:
                found.update(ids)
        return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    """``terms`` ascending, with a weight and a vector each."""

    start: float
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def wanted(self) -> np.ndarray:
        out = np.zeros(1 << BITS, bool)
        out[self.terms] = True
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of texts as ascending ids that are all in ``terms``."""
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.searchsorted(self.terms, np.concatenate(texts)) if len(rows) else np.zeros(0, int)
        return sigmoid(self.start + raw(rows, at, len(texts), self.weights, self.vectors)[0])


def raw(rows: np.ndarray, at: np.ndarray, n: int, weights: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights plus pair products of each of n texts, and the sums of its vectors."""
    sums = np.stack([np.bincount(rows, vectors[at, k], n) for k in range(vectors.shape[1])], 1)
    squares = np.bincount(rows, (vectors[at] ** 2).sum(1), n)
    return np.bincount(rows, weights[at], n) + 0.5 * ((sums**2).sum(1) - squares), sums


def select(rows: np.ndarray, ids: np.ndarray, y: np.ndarray, least_rows: int = 4, least_z: float = 4.0) -> np.ndarray:
    """Terms that go with one label by themselves more than chance would have it.

    With hundreds of chance words in a text, all weights together are noise; the
    machine gets those terms whose counts differ between labels by ``least_z``
    standard errors, and that ``least_rows`` texts hold, and ``select_pairs``.
    """
    size = 1 << BITS
    count = np.bincount(ids, minlength=size).astype(float)
    ones = np.bincount(ids, y[rows], minlength=size)
    share = y.mean()
    z = (ones - share * count) / np.sqrt(np.maximum(share * (1 - share) * count, 1e-9))
    return np.flatnonzero((count >= least_rows) & (np.abs(z) >= least_z))


def select_pairs(rows: np.ndarray, ids: np.ndarray, y: np.ndarray, least_rows: int = PAIR_ROWS, least_z: float = PAIR_Z) -> np.ndarray:
    """Terms that say something only beside another one.

    Of every two terms it is counted in how many texts they stand together, and
    in how many of the rarer label.  Both are kept if those are more than the
    share of either term, or their joint lift, makes likely.  A term is a row of
    bits, one per text; two rows are counted by their common bits, first over the
    texts of the rarer label, then over the others where those are enough.
    """
    label = y == 1 if y.mean() <= 0.5 else y == 0
    size, share = 1 << BITS, label.mean()
    count, ones = np.bincount(ids, minlength=size), np.bincount(ids, label[rows], minlength=size)
    terms = np.flatnonzero(ones >= least_rows)
    place = np.where(label, np.cumsum(label), np.cumsum(~label)) - 1

    def bits(of: np.ndarray) -> np.ndarray:
        """A row per term over the texts ``of``."""
        held = of[rows] & (ones[ids] >= least_rows)
        out = np.zeros((len(terms), -(-int(of.sum()) // 64) * 64 // 8), np.uint8)
        at = place[rows[held]]
        np.bitwise_or.at(out, (np.searchsorted(terms, ids[held]), at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        return out.view(np.uint64)

    with_label, without = bits(label), bits(~label)
    own = (ones[terms] + share) / (count[terms] + 1)
    found = np.zeros(len(terms), bool)
    for i in range(len(terms) - 1):
        both = np.bitwise_count(with_label[i + 1 :] & with_label[i]).sum(1, dtype=np.int32)
        j = np.flatnonzero(both >= least_rows)
        both, j = both[j], j + i + 1
        likely = np.clip(np.maximum(np.maximum(own[i], own[j]), own[i] * own[j] / share), share, 0.99)
        # Without any text of the other label the excess is the largest it can be.
        some = (1 - likely) * both >= least_z * np.sqrt(both * likely * (1 - likely))
        both, j, likely = both[some], j[some], likely[some]
        n = both + np.bitwise_count(without[j] & without[i]).sum(1, dtype=np.int32)
        far = both - n * likely >= least_z * np.sqrt(n * likely * (1 - likely))
        if far.any():
            found[i] = found[j[far]] = True
    return terms[found]


def fit(
    texts: list[np.ndarray], y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-5, decay_pairs: float = 1e-4, seed: int = 7
) -> Machine:
    """Learn weights and vectors by Adam on the logistic loss.

    The weights alone come first, so that a term which says enough by itself does
    not lean on others; the vectors then learn what the weights miss, and are
    held small by ``decay_pairs``.

    No texts: score 0.5; one label only: the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    none = Machine(float(np.log(share / (1 - share))), np.zeros(0, int), np.zeros(0), np.zeros((0, RANK)))
    if len(set(y.tolist())) < 2:
        return none
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ids = np.concatenate(texts)
    terms = np.union1d(select(rows, ids, y), select_pairs(rows, ids, y))
    if not len(terms):
        return none
    held = np.isin(ids, terms)
    rows, at = rows[held], np.searchsorted(terms, ids[held])
    n, m = len(y), len(terms)
    rng = np.random.default_rng(seed)
    values = [np.array([none.start]), np.zeros(m), rng.normal(0, 0.05, (m, RANK))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, 2 * steps + 1):
        start, weights, vectors = values
        total, sums = raw(rows, at, n, weights, vectors)
        error = (sigmoid(start[0] + total) - y) / n
        pull = error[rows]
        slope_v = np.stack([np.bincount(at, pull * (sums[rows, k] - vectors[at, k]), m) for k in range(RANK)], 1)
        slopes = [np.array([error.sum()]), np.bincount(at, pull, m) + decay * weights, (slope_v + decay_pairs * vectors) * (step > steps)]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            values[k] = values[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Machine(float(values[0][0]), terms, values[1], values[2])


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents for which ``keep`` holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in pieces(batches):
            found = [terms.of_text(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["terms", "label", "doc_id"])

    sample = labelled_sample(docs, labels, label, rows, keep).select("text", "label", "doc_id")
    got = sample.mapInArrow(run, "terms array<int>, label int, doc_id long").toArrow().sort_by("doc_id")
    ids = got["terms"].combine_chunks()
    texts = [np.asarray(ids[i].values) for i in range(len(ids))]
    return fit(texts, got["label"].to_numpy().astype(float))


def score_toxicity(docs: DataFrame, model: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, score in 0 to 1 (higher: likelier toxic).

    Null and empty texts have no terms and get the score of that; repeated rows
    and null keys stay; no rows give no rows; further columns are not carried.
    Whole texts are scored in slices, without a shuffle.
    """
    wanted = model.wanted()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(wanted)
        for batch in pieces(batches):
            scores = model.score([terms.of_text(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, "doc_id long, score double")
