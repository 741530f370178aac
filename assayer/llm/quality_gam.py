"""Quality classifier: a generalised additive model with pairwise interactions.

A score is the logistic function of a sum of table entries, one per feature and
one per chosen pair of features.  The tables are learned by cyclic boosting:
round after round, every feature in turn adds a shallow tree on its bins to its
own table; then the pairs do the same with trees of one cut on either axis.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from assayer.llm.common import labelled_sample, pieces

#: Labelled documents that a fit looks at, at most.
SAMPLE_ROWS = 20_000

# Function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to a in is that it for was on are as with be this by from or an at not have le la les de des du un une et est que qui "
    "dans pour pas au sur par ce il se ne der die das den dem ein eine und ist von zu mit sich auf für nicht als auch im el los las y en "
    "del con su para como lo al no".split()
)
FEATURES = (
    "log_chars log_words word_chars upper digits signs marks bars bangs distinct repeats commonest trigrams lines line_words distinct_lines "
    "function_words longest non_ascii"
).split()

_CLASS = np.zeros(256, np.uint8)  # 1 lower case, 2 upper case, 3 digits, 4 other visible, 5 marks, 6 beyond ASCII
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b"\"'()+,-./:;<=?[\\]_`{}")] = 4
_CLASS[list(b"!#$%&*@^|~")] = 5
_CLASS[128:] = 6


def features(text: str | None) -> list[float]:
    """The features of one text, as named by ``FEATURES``; null is empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7)
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(raw))
    letters = max(1, kinds[1] + kinds[2])
    counts = Counter(words)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        (size - kinds[0]) / n,
        kinds[2] / letters,
        kinds[3] / size,
        kinds[4] / size,
        kinds[5] / size,
        counts.get("|", 0) / n,
        raw.count(b"!") / n,
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        len(set(lines)) / len(lines),
        sum(counts[w] for w in FUNCTION_WORDS & counts.keys()) / n,
        np.log1p(max(map(len, counts), default=0)),
        kinds[6] / size,
    ]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Gam:
    """Bin edges and tables; empty ones score the share of label 1 alone."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[at[:, i], at[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, cuts: int) -> np.ndarray:
    """Leaf value per bin of a tree with at most ``cuts`` cuts, the best one first."""
    bounds = [0, len(g)]
    for _ in range(cuts):
        best = (1e-9, 0)
        for a, b in zip(bounds, bounds[1:], strict=False):
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(left_g):
                all_g, all_h = g[a:b].sum(), h[a:b].sum()
                gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), a + k + 1))
        if not best[1]:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best pair of cuts, one on either axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a, top, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [a, top - a, left - a, c[-1, -1] - top - left + a]

    pg, ph = parts(cg), parts(ch)
    if not pg[0].size:
        return 0.0, np.zeros_like(g)
    gains = sum(_gain(a, b) for a, b in zip(pg, ph, strict=True))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.empty_like(g)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = pg[k][i, j] / (ph[k][i, j] + 1.0)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, n_bins: int = 32, rate: float = 0.1) -> Gam:
    """Learn the tables by Newton steps on the logistic loss.

    No rows: score 0.5; one class only: the smoothed share of label 1.
    """
    if not len(y):
        return Gam()
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    at = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(total)
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, size in enumerate(sizes):
            g, h = slopes()
            step = rate * tree(np.bincount(at[:, j], g, size), np.bincount(at[:, j], h, size), 3)
            model.tables[j] += step
            total += step[at[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = at[:, i] * sizes[j] + at[:, j]
        g, h = slopes()
        shape = (sizes[i], sizes[j])
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((quarters(*grid(i, j)[1:])[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for _, i, j in gains[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            cell, g, h = grid(i, j)
            step = rate * quarters(g, h)[1]
            table += step
            total += step.ravel()[cell]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> Gam:
    """Fit on at most ``rows`` labelled documents for which ``keep`` holds.

    Features are computed by the tasks; the driver gets ``rows`` short vectors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    sample = labelled_sample(docs, labels, label, rows, keep).select("text", "label")
    got = sample.mapInArrow(run, "x array<double>, label int").toPandas()
    got = got.iloc[np.lexsort(np.array([*map(list, got["x"])]).T)] if len(got) else got  # the same order on every run
    x = np.array([*map(list, got["x"])]) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: Gam, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, score in 0 to 1 (higher: better text).

    Null texts count as empty, which is a text like any other; repeated rows and
    null keys stay; no rows give no rows; further columns are not carried.
    Rows are scored in slices, whole texts each, without a shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([features(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, "doc_id long, score double")


def drop_low_quality(docs: DataFrame, model: Gam, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more; decided in place, without a shuffle.

    Null texts are scored as empty ones; repeated rows and null keys are decided
    each by its text; a model fitted without labels scores all texts alike; no
    rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array(model.score(np.array([features(t) for t in texts])) >= least))

    return docs.mapInArrow(run, docs.schema)
