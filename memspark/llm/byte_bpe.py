"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A word (a match of the split pattern) becomes a byte array, cut between all bytes; a fold takes out, step
by step, the cut inside the adjacent pair whose bytes have the lowest rank, the leftmost of equals, until
no pair has one. Ranks are a literal map, cut into small maps by a hash of the key so that a look-up is
short. Decoding looks up each id's bytes in a literal array and concatenates these binary pieces.

The words that occur most over all documents, up to a fixed number, are folded and decoded once each and
kept as a literal dictionary of bounded size; a document's ids and bytes are its words' pieces, joined.
The rare words that are left (at 0.5 GB 3 % of all, half of them met once) are folded where they stand: to
fold each once and join it back would shuffle all texts. Words of more than LONG_WORD bytes, where the
fold's square cost would show, send their document to a worker that merges with a heap; ids are the same.

Defined cases: null and empty texts have no ids, and the digests of no bytes. Very long texts are encoded
whole. Repeated rows are encoded each, and an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_workers, materialise, picked, texts_of
from .token_counts import PRE_TOKEN
from .winnow import let

LONG_WORD = 256
#: Words of the dictionary at most, and their bytes.
DICTIONARY, DICTIONARY_WORD = 1 << 19, 48
RANK_BUCKETS = 1 << 16
#: A pair's rank stands above PLACE_BITS bits of its place; NO_RANK is beyond all ranks.
PLACE_BITS, NO_RANK = 20, 1 << 30
_WHITE, _BLACK = r"\p{IsWhite_Space}", r"\P{IsWhite_Space}"
#: The split pattern for Java, whose \\s knows ASCII only; runs of letters come first, and runs are not given back.
JAVA_PRE_TOKEN = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:s|t|re|ve|m|ll|d)| ?[^{_WHITE}\p{{L}}\p{{N}}]++|{_WHITE}+(?!{_BLACK})|{_WHITE}+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of pairs; for long words."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; parts are a chain
    prev = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    live = [True] * n
    while heap:
        _, i, to = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != to:
            continue
        live[end[i]] = False
        end[i] = to
        if to < n:
            prev[to] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _bucket(key: Column, n: int) -> Column:
    """Of n, a power of two."""
    return F.xxhash64(key).bitwiseAND(F.lit(n - 1).cast("long")).cast("int")


def _look_up(buckets: Column, key: Column, n: int) -> Column:
    return F.element_at(F.get(buckets, _bucket(key, n)), key)


def _bucketed(pairs: DataFrame, n: int) -> DataFrame:
    """One row: an array of n small maps, by the hash of (key); of a bounded number of pairs (key, value)."""
    maps = pairs.groupBy(_bucket(F.col("key"), n).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    every = pairs.sparkSession.range(0, n, 1, 1).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x.b - y.b), lambda x: x.m).alias("maps"))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_PRE_TOKEN), F.lit(0))


def fold(word: Column, ranks: Column) -> Column:
    """The ids of a word.

    The state is an array with a long for every part of the byte array, and one for its end: above, the rank
    of the part with its right neighbour (NO_RANK without one); below, where the part begins. Its least
    element is the leftmost of the pairs of lowest rank. A merge takes out one element and changes two.
    """
    rank = lambda x: _look_up(ranks, x, RANK_BUCKETS)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    pair = lambda r, at: F.shiftleft(F.coalesce(r, F.lit(NO_RANK)).cast("long"), PLACE_BITS).bitwiseOR(at.cast("long"))

    def of(w):
        part = lambda a, b: F.substring(w, a, b - a)

        def merge(x, k):
            """The pair at place k + 1 (from 0) becomes one part; the pairs that begin at k and k + 1 change."""
            one = lambda v, j: F.when(F.shiftright(j - k, 1) == 0, let(place(v), lambda a: pair(rank(part(a, place(F.get(x, j + 3)))), a))).otherwise(v)
            return F.array_remove(F.transform(x, one), F.get(x, k + 2))

        def step(x, _):
            # not by one let around both arms: it would copy the array of every step that does nothing
            return F.when(F.array_min(x) >= F.lit(NO_RANK << PLACE_BITS), x).otherwise(let((F.array_position(x, F.array_min(x)) - 2).cast("int"), lambda k: merge(x, k)))

        parts = F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: pair(F.when(i < F.length(w), rank(F.substring(w, i, F.lit(2)))), i))
        ended = F.aggregate(F.sequence(F.lit(2), F.length(w)), parts, step)
        return let(F.transform(ended, place), lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: rank(part(F.get(b, i), F.get(b, i + 1)))))

    return let(word.cast("binary"), lambda w: let(rank(w), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(of(w))))


def joined(pieces: Column, of=lambda x: x) -> Column:
    """Binary pieces, got by ``of`` from the elements of an array, as one binary; the text type only carries the bytes."""
    return F.array_join(F.transform(pieces, lambda x: of(x).cast("string")), "").cast("binary")


class Codec:
    def __init__(self, spark: SparkSession, path: str, words: int = DICTIONARY):
        self.spark, self.path, self.words = spark, path, words
        self.buckets = 1 << max(0, words.bit_length() - 2)
        self.ranks = load_ranks(path)
        self.rank_maps = materialise(_bucketed(spark.createDataFrame([(bytearray(k), v) for k, v in self.ranks.items()], "key binary, value int"), RANK_BUCKETS), "ranks")
        pieces = [(bytearray(), bytearray())] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            pieces[v] = (bytearray(v.to_bytes(4, "little")), bytearray(k))
        self.pieces = materialise(spark.createDataFrame([([p[0] for p in pieces], [p[1] for p in pieces])], "le array<binary>, raw array<binary>"), "pieces")

    def literals(self, docs: DataFrame, *columns, **more: Column) -> DataFrame:
        """docs with the literal arrays; each is to be read through let, so that it stays a value of the expression and is not copied into rows."""
        return docs.select(*columns, self.value(self.rank_maps).alias("ranks"), self.value(self.pieces, "le").alias("le_of"), self.value(self.pieces, "raw").alias("raw_of"), *(c.alias(k) for k, c in more.items()))

    @staticmethod
    def coded(word: Column, ranks: Column) -> Column:
        """A word's ids as little-endian integers, and the bytes that these ids decode to."""
        concat = lambda ids, of: joined(ids, lambda i: F.get(F.col(of), i))
        return let(fold(word, ranks), lambda ids: F.struct(concat(ids, "le_of").alias("le"), concat(ids, "raw_of").alias("raw")))

    def dictionary(self, docs: DataFrame) -> tuple[DataFrame, bool]:
        """One row: what coded gives of the most frequent words, by word; whether a word is longer than the fold should take."""
        w = F.col("w")
        words = docs.select(F.explode(split_words(F.col("text"))).alias("w"))
        kept = F.when(F.octet_length(w) <= DICTIONARY_WORD, w).when(F.octet_length(w) > LONG_WORD, F.lit("")).otherwise(F.lit(None))
        counted = materialise(words.groupBy(kept.alias("w")).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | (w == "")), "words")
        level = F.floor(F.log2(F.col("n")) * 16).cast("int")
        levels = sorted((tuple(r) for r in counted.filter("w <> ''").groupBy(level.alias("l")).agg(F.count("*")).collect()), reverse=True)  # a few hundred
        least, total = math.inf, 0
        for lv, n in levels:
            total += n
            if total > self.words:
                break
            least = lv
        chosen = counted.filter((w != "") & (level >= F.lit(float(least)))).select("w")
        # many tasks for the folds, whatever the files of counted were
        own = self.literals(chosen.repartition(64, "w"), "w").select(F.col("w").alias("key"), let(F.col("ranks"), lambda r: self.coded(w, r)).alias("value"))
        return materialise(_bucketed(own, self.buckets), "dictionary"), bool(counted.filter("w = ''").take(1))

    @staticmethod
    def value(one_row: DataFrame, column: str = "maps") -> Column:
        return one_row.select(column).scalar()

    def encoded(self, docs: DataFrame, id_col: str) -> DataFrame:
        """(id, n_tokens, digests of the ids and of the decoded bytes)."""
        words, long = self.dictionary(docs)
        lit = self.literals(docs, id_col, "text", dict=self.value(words))
        slow = F.col("text").rlike(r"[^\s]{%d}|\s{%d}" % (LONG_WORD // 4, LONG_WORD // 4)) & F.exists(split_words(F.col("text")), lambda x: F.octet_length(x) > LONG_WORD)
        fast = lit.filter(~slow) if long else lit
        pieces = let(F.col("ranks"), lambda r: let(F.col("dict"), lambda d: F.transform(split_words(F.col("text")), lambda x: F.coalesce(_look_up(d, x, self.buckets), self.coded(x, r)))))
        out = let(pieces, lambda p: F.struct(joined(p, lambda x: x.le).alias("le"), joined(p, lambda x: x.raw).alias("raw")))
        out = fast.select(id_col, out.alias("x")).select(id_col, F.floor(F.octet_length("x.le") / 4).alias("n_tokens"), F.sha2("x.le", 256).alias("ids_sha256"), F.sha2("x.raw", 256).alias("decoded_sha256"))
        return out.unionByName(self._heap(docs.filter(slow), id_col)) if long else out

    def _heap(self, docs: DataFrame, id_col: str) -> DataFrame:
        path, kind = self.path, dict(docs.dtypes)[id_col]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranks, pattern = load_ranks(path), regex.compile(PRE_TOKEN)
            raw = {v: k for k, v in ranks.items()}
            for b in batches:
                ids = [[i for w in pattern.findall(t) for i in merge_bytes(w.encode(), ranks)] for t in texts_of(b.column(1))]
                digests = [(len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"".join(raw[i] for i in x)).hexdigest()) for x in ids]
                cols = list(zip(*digests)) if digests else [(), (), ()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return docs.select(id_col, "text").transform(in_workers, run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, by the rank file at the path vocabulary.

    dictionary: words folded beforehand at most. More take memory (some 100 bytes each, in every task), fewer time.
    """
    docs = picked(df, **{id_col: id_col, "text": text_col}).withColumn("text", F.coalesce("text", F.lit("")))
    return Codec(df.sparkSession, vocabulary, dictionary).encoded(docs, id_col)
