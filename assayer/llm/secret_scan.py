"""Secrets in texts: three fixed patterns, and values that are hard to guess.

A value in a credential context (``login password is Xk29-vv7q``) is priced as a
guesser would pay for it: dynamic programming finds the cheapest way to write it
as words, dates, repeats, keyboard walks, sequences and brute-force spans.  The
words are common ones of passwords, then those that most texts of the corpus hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from math import lgamma, log, log10

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.common import pieces, stage

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 18
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

# Words that stand beside credentials.
CONTEXT = re.compile(
    r"""(?i)(?<![A-Za-z])(?:pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|credentials?|api[_ -]?key|access[_ -]?key|private[_ -]?key|login|auth(?:orization)?|bearer|"""
    r"""mot de passe|contraseña|kennwort)["']?\x20{0,4}(?:[:=]|is\x20|est\x20|es\x20|ist\x20|bearer\x20)\x20{0,4}["']?([^\s"'<>]{6,})"""
)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "login", "auth", "bearer", "contrase", "kennwort")

# Common words of passwords and placeholders, commonest first.
WORDS = (
    "password the qwerty and love admin welcome dragon monkey letmein football secret master shadow sunshine princess iloveyou hello login "
    "test example sample changeme change default user guest root your here my key token api none null true false enter value string text "
    "baseball batman superman michael jordan summer winter spring autumn orange purple yellow silver golden house flower magic star blue "
    "green black white red cat dog bird fish horse computer internet server service system public private access data file name email "
    "account company office school family friend money happy lucky angel baby mother father brother sister king queen power world "
    "passwort geheim hallo sommer bonjour soleil amour contrasena hola amor espana france berlin paris madrid london redacted hidden happiness"
).split()
#: Words that are counted in the corpus: so many of the commonest, in so many texts at least, of so many letters.
COUNTED, LEAST_TEXTS, LETTERS = 50_000, 3, (3, 24)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiop", "azertyuiop", "yxcvbnm")
LEET = str.maketrans("4@301!$57", "aaeolisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])[-./]?(?:[0-2]\d|3[01]))?|(?:[0-2]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:(?:19|20)\d\d|\d\d)")

NEXT_KEY = {pair for row in ROWS for a, b in zip(row, row[1:], strict=False) for pair in ((a, b), (b, a))}
#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 9.0


def _steps(value: str, joined) -> list[int]:
    """For each place, where the longest chain of joined neighbours from it ends."""
    ends = [len(value)] * len(value)
    for i in range(len(value) - 2, -1, -1):
        ends[i] = ends[i + 1] if joined(value[i], value[i + 1]) else i + 1
    return ends


def ranks(counted: Sequence[str] = ()) -> dict[str, int]:
    """Place of every word in the order in which a guesser tries them."""
    out = {w: i + 1 for i, w in enumerate(WORDS)}
    for w in counted:
        out.setdefault(w, len(out) + 1)
    return out


RANK = ranks()


def guess_cost(value: str, rank: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of a value; empty: 0.

    Segments multiply their guesses, and k of them can stand in k! orders, which
    is added at the end.  Time is linear in the length.
    """
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    repeats = _steps(value, lambda a, b: a == b)
    walks = _steps(low, lambda a, b: (a, b) in NEXT_KEY)
    ups = _steps(value, lambda a, b: ord(b) - ord(a) == 1)
    downs = _steps(value, lambda a, b: ord(b) - ord(a) == -1)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * len(value)

    def offer(i: int, j: int, cost: float, new: int = 1) -> None:
        total = best[i][0] + cost
        if total < best[j][0]:
            best[j] = (total, best[i][1] + new)

    for i, c in enumerate(value):
        size = 10 if c.isdigit() else 26 if c.isalpha() else 33
        offer(i, i + 1, log10(size), 0)
        for j in range(i + LETTERS[0], min(i + LETTERS[1], len(value)) + 1):
            for word in {plain[i:j], low[i:j]}:
                if place := rank.get(word):
                    changed = (value[i:j] != low[i:j]) + (word != low[i:j])
                    offer(i, j, log10(place) + 0.6 * changed + 0.3)
        if c.isdigit():
            match = DATE.match(value, i)
            if match:
                offer(i, match.end(), log10(365 * 120))
        for end, choices in ((repeats[i], 94), (walks[i], 47 * 4), (ups[i], 94), (downs[i], 94)):
            if end - i >= 3:
                offer(i, end, log10(choices * (end - i)))
    total, segments = best[-1]
    return total + lgamma(segments + 1) / log(10)


def frequent_words(docs: DataFrame, text: str = "text", most: int = COUNTED, least_texts: int = LEAST_TEXTS) -> list[str]:
    """The words that most texts of the whole table hold, commonest first; ties by the word.

    A text counts once per word.  Values in credential context are cut out before,
    so that a secret which many copies repeat is no common word.  Counts are
    taken in steps of a sixteenth of a doubling, from the top as long as a whole
    step fits, so at most ``most`` words come to the driver, whatever the number
    of partitions; no or empty texts give none.
    """
    body = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(CONTEXT.pattern), F.lit(" "))
    words = F.filter(F.array_distinct(F.split(body, r"[^\p{L}]+")), lambda w: F.length(w).between(*LETTERS))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least_texts)
    counts = stage(counts.withColumn("step", F.floor(F.log2("texts") * 16).cast("int")), "words")
    lowest, held = None, 0
    for step, n in sorted(counts.groupBy("step").count().collect(), reverse=True):  # some hundreds at most
        held += n
        if held > most:
            break
        lowest = step
    rows = counts.where(F.col("step") >= lowest).select("texts", "word").collect() if lowest is not None else []
    return [word for _, word in sorted(rows, key=lambda r: (-r["texts"], r["word"]))]


def find_spans(text: str, least_cost: float = LEAST_COST, rank: dict[str, int] = RANK) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, cost) by start, then kind; cost only for ``guess``.

    Base spans are whole matches.  A guess span is the value alone, without marks
    that end a sentence, and is given only where no base span overlaps it.
    """
    out: list[tuple[int, int, str, float | None]] = []
    low = text.lower()
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), m.end(), "hex", None) for m in HEX.finditer(text)]
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign", None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        base = sorted((a, b) for a, b, *_ in out)
        at, reach = 0, 0
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}")
            start, end = m.start(1), m.start(1) + len(value)
            while at < len(base) and base[at][0] < end:
                reach = max(reach, base[at][1])
                at += 1
            if reach <= start and (cost := guess_cost(value, rank)) >= least_cost:
                out.append((start, end, "guess", cost))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("cost", pa.float64())])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least_cost: float = LEAST_COST, words: Sequence[str] | None = None) -> DataFrame:
    """A row per document: doc_id and its spans (start, end, kind, cost), sorted.

    ``words`` are cheap to guess; if not given they are counted over ``docs``.
    Null and empty texts have no spans; repeated rows and null keys stay as they
    are; no rows give no rows; further columns are not carried.  Places count
    code points, the end is exclusive.  Texts are handled whole, a slice of rows
    at a time, and nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
    rank = ranks(frequent_words(docs, text) if words is None else words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            spans = [
                [dict(zip(("start", "end", "kind", "cost"), s, strict=True)) for s in find_spans(t or "", least_cost, rank)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, schema.field(1).type)], schema=schema)

    rows = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string,cost:double>>")


def masked(text: str, mask: str = "[SECRET]", least_cost: float = LEAST_COST, rank: dict[str, int] = RANK) -> str:
    """The text with every span, overlapping ones as one, replaced by the mask."""
    parts, at, reach = [], 0, -1
    for start, end, *_ in find_spans(text, least_cost, rank):
        if start >= reach:
            parts += [text[max(at, reach) : start], mask]
            at = end
        reach = max(reach, end)
    return "".join(parts) + text[max(at, reach) :] if parts else text


def mask_secrets(docs: DataFrame, text: str = "text", size: str | None = "n_chars", least_cost: float = LEAST_COST, words: Sequence[str] | None = None) -> DataFrame:
    """The same rows and columns with secrets replaced, and ``size`` counted anew where it exists.

    ``words`` as in ``scan_secrets``.  Null texts stay null and keep their size,
    empty ones stay; repeated rows and null keys stay; no rows give no rows.
    """
    rank = ranks(frequent_words(docs, text) if words is None else words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            names = batch.schema.names
            old = batch.column(names.index(text)).to_pylist()
            new = [t if t is None else masked(t, least_cost=least_cost, rank=rank) for t in old]
            if new == old:
                yield batch
                continue
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array(new, batch.schema.field(text).type)
            if size in names:
                kind = batch.schema.field(size).type
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(names.index(size)).to_pylist(), strict=True)]
                columns[names.index(size)] = pa.array(sizes, kind)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
