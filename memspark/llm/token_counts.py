"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of an Arrow batch that the worker has not met yet become one flat array of
symbols with a row number each. In every round each row finds its pair of lowest rank and applies it
at all its places at once (overlapping places from the left, every other one); rows without a pair
leave, and what is left of them is their token count. Special strings inside a text count as one
token each, as the tokenizer's own default has it.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Very long texts are counted whole, a batch of
pre-tokens at a time. Repeated rows are counted each. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_workers, picked, texts_of

#: The pattern that splits text before byte-level merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks a worker remembers before it starts anew; bounds its memory, not the result.
CACHE = 300_000
UNEASY = re.compile(r" (?:\s|\Z)")
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts what is left of pre-tokens after all merges of a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list, special: list[str]):
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> RankMerger:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        return cls(j["model"]["vocab"], j["model"]["merges"], [t["content"] for t in j.get("added_tokens", [])])

    def merged(self, words: list[str]) -> np.ndarray:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw), np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        row = np.repeat(np.arange(len(raw)), size)
        while len(symbol):
            rank = np.full(len(symbol), NONE)
            pair = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (row[:-1] == row[1:])
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(row)))
            ended = least == NONE
            out[row[first[ended]]] = length[ended]
            hit = (rank == np.repeat(least, length)) & (rank != NONE)
            # of places that overlap (a a a) every other one, from the left
            run = hit & ~np.concatenate(([False], hit[:-1]))
            index = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(run, index, -1))
            hit &= (index - start) % 2 == 0
            symbol = symbol.copy()
            symbol[hit] = self.made[rank[hit]]
            keep = ~np.concatenate(([False], hit[:-1])) & ~np.repeat(ended, length)
            symbol, row = symbol[keep], row[keep]
        return out

    def _learn_words(self, texts: list[str]) -> None:
        new = list({w for t in texts for w in self.pattern.findall(t)} - self.words.keys())
        if len(self.words) + len(new) > CACHE:
            self.words = {}
            new = list({w for t in texts for w in self.pattern.findall(t)})
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            self.words.update(zip(part, self.merged(part).tolist()))

    def _plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings.

        Where every space stands before a character that is not white space, the pattern never joins
        across a space but to put it before what follows; such a text is cut at its spaces, and each
        chunk counted once.
        """
        out = [0] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            if t and not UNEASY.search(t):
                first, *rest = t.split(" ")
                cut.append((i, [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]))
            elif t:
                whole.append(i)
        for a in range(0, len(cut), 64):
            part = cut[a : a + 64]
            new = list({c for _, cs in part for c in cs} - self.chunks.keys())
            if len(self.chunks) + len(new) > CACHE:
                self.chunks = {}
                new = list({c for _, cs in part for c in cs})
            self._learn_words(new)
            get = self.words.__getitem__
            find = self.pattern.findall
            self.chunks.update((c, sum(map(get, find(c)))) for c in new)
            for i, cs in part:
                out[i] = sum(map(self.chunks.__getitem__, cs))
        for i in whole:
            self._learn_words([texts[i]])
            out[i] = sum(map(self.words.__getitem__, self.pattern.findall(texts[i])))
        return out

    def count(self, texts: list[str]) -> list[int]:
        if self.special is None:
            return self._plain(texts)
        out = [0] * len(texts)
        pieces: list[str] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            parts = self.special.split(t)
            out[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        for i, n in zip(owner, self._plain(pieces)):
            out[i] += n
        return out


_merger: dict[str, RankMerger] = {}


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, by the byte-level tokenizer file at the path vocabulary.

    A text of null or no characters counts 0; each row of the input gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _merger:
            _merger[vocabulary] = RankMerger.load(vocabulary)
        for b in batches:
            texts = texts_of(b.column(1))
            n = _merger[vocabulary].count(texts)
            size = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(df.dtypes)[id_col]
    return picked(df, **{id_col: id_col, "text_": text_col}).transform(in_workers, run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
