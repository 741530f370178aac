"""Harmonic packing of token sequences.

The capacity C is divided by whole numbers: class k holds pieces of C/(k+1) up
to C/k tokens, and a bin of class k gets exactly k of them.  A class needs no
look at any other piece, so every task fills its own bins and nothing is
shuffled.  As documents may be cut, a remainder is first cut to sizes that are
exactly C/k, which leaves its class without padding.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assayer.llm.common import arrow_batches, pieces

#: Characters of the words of which a Python worker remembers the ids, and the longest of those words.
REMEMBERED, LONGEST = 6_000_000, 40
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


# Fixed value: the split of byte-level BPE before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary.

    Visible Latin-1 bytes stand for themselves, the others for 256, 257, ...
    """
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Texts to little-endian 32-bit ids, with a memory of words.

    The byte-level split starts a new token at every space that is followed by a
    visible character, so a text is encoded word by word.  Only white space
    around a single space can join over that border; such texts are encoded whole.
    A word goes through the faster of two libraries that apply the same merges;
    it reads the vocabulary of the given file, whose ids must be in merge order.

    ``special_tokens`` says whether strings such as ``<|endoftext|>`` in a text
    are the one id that a plain call of the tokenizer gives, or ordinary text.
    """

    def __init__(self, path: str, special_tokens: bool = False):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        parts = json.loads(self.tokenizer.to_str())
        model = parts["model"]
        strings = [regex.escape(t["content"]) for t in parts["added_tokens"]] if special_tokens else []
        vocab, letters = model["vocab"], byte_letters()
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(vocab[a] >= vocab[b] for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("the ids of the vocabulary are not in merge order")
        known = set(merged)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if len(t) == 1 or t in known}
        self.word = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.joined = regex.compile("|".join([r"\s (?:\s|$)", *strings]))
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if "  " in t or self.joined.search(t) else t.split(" ") for t in texts]
        need: set[str] = set()
        for words in split:
            if words:
                need.update(words)
        if self.held > REMEMBERED:  # keep what the texts at hand use
            self.words = {w: self.words[w] for w in need & self.words.keys()}
            self.held = sum(map(len, self.words))
        word = self.word
        new = {w: array("I", word(" " + w)).tobytes() for w in need - self.words.keys()}
        self.words.update(new)
        self.held += sum(map(len, new))
        known = self.words.__getitem__
        out = [
            self._whole(t) if words is None else array("I", word(words[0])).tobytes() + b"".join(map(known, words[1:]))
            for t, words in zip(texts, split, strict=True)
        ]
        for w in [w for w in new if len(w) > LONGEST]:  # for the texts at hand only
            del self.words[w]
            self.held -= len(w)
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str, special_tokens: bool) -> Encoder:
    """The encoder of a Python worker, which its tasks use one after the other."""
    return Encoder(path, special_tokens)


def cut(tokens: int, capacity: int, cuts: int) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces, in order.

    Whole capacities first, then at most ``cuts`` pieces of the largest C/k that
    fits, then the rest in the class its length belongs to.
    """
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    for _ in range(cuts):
        if rest:
            k = -(-capacity // rest)
            out.append((capacity // k, k))
            rest -= capacity // k
    return [*out, (rest, capacity // rest)] if rest else out


class Bins:
    """Open bins, one per class; ``done`` collects the pieces of full ones."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open, self.done = capacity, first_id, {}, []

    def _close(self, bin_: list[tuple]) -> None:
        offset = 0
        for piece in bin_:
            self.done.append((*piece, self.next_id, offset))
            offset += piece[2]
        self.next_id += 1

    def add(self, piece: tuple, k: int) -> None:
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self._close(self.open.pop(k))

    def finish(self) -> None:
        """Put what the open bins hold together, longest pieces first, where it first fits."""
        left = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2])
        bins: list[list] = []
        for piece in left:
            room = next((b for b in bins if b[0] >= piece[2]), None)
            if room is None:
                bins.append(room := [self.capacity, []])
            room[0] -= piece[2]
            room[1].append(piece)
        self.open = {}
        for _, bin_ in bins:
            self._close(bin_)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, cuts: int = 3, key: str = "doc_id", text: str = "text", special_tokens: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids as little-endian 32-bit numbers; the ids of a
    document are those of its whole text and ``end_id``.  ``start`` counts the
    document's ids before the piece, ``offset`` the sequence's.  ``sequence_id``
    is unique: the number of the input partition times 2**33, and a counter.

    A null or empty text is one piece with ``end_id``.  Repeated rows are packed
    as often as they come, null keys stay null, no rows give no rows, and further
    columns are not carried.  A task holds a slice of texts and at most k - 1
    pieces of each class.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        end = end_id.to_bytes(4, "little")

        def out() -> pa.RecordBatch:
            columns = list(zip(*bins.done, strict=True)) if bins.done else [[]] * 7
            bins.done = []
            return arrow_batches(dict(zip(_ARROW.names, columns, strict=True)), _ARROW)

        for batch in pieces(batches):
            encoder = encoder or encoder_of(tokenizer, special_tokens)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                tokens, start = len(ids) // 4, 0
                for length, k in cut(tokens, capacity, cuts):
                    bins.add((doc, start, length, ids[4 * start : 4 * (start + length)], tokens), k)
                    start += length
            if len(bins.done) > 2_000:
                yield out()
        bins.finish()
        yield out()

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(run, SCHEMA)
