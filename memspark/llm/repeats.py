"""Removal of long strings that occur more than once, with families of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts at another place, in the same text
or another; strings are judged on the input.

Which suffixes can match at all: of the rolling hashes of half-length grams each window of ``length``
bytes keeps its least (its anchor); equal strings have equal anchors at equal offsets. The starts that
share an anchor form a segment, keyed by the anchor's gram. Segments whose key occurs once are done.
Equal segments of a key are held once, with their number. The others meet, by key, in logarithmic
families of suffix arrays over a shared text: a batch of new segments is appended to the text, its suffix
array is made, merge-scanned against the array of every level for common prefixes of ``length`` bytes, and
becomes a level itself; two levels of like size are merged into one. A family takes the batches of many
keys and ends, between two keys, when it has grown to FAMILY suffixes; no suffix matches one of another key.

A key with more than ``hot`` different segments is not gathered in one task: its segments are cut into
shorter ranges of starts, keyed by all the bytes these have in common, and go through the same steps;
a range of one start is its own string, so this ends. Joins by key and segment meet the hot ones by broadcast.

Defined cases: null and empty texts, and texts shorter than ``length``, lose nothing. A long text is anchored
whole, by one task, in some ten arrays of its length; it is to be shorter than 2**30 bytes (ValueError).
Repeated rows are copies of each other. No rows give no rows. The remaining bytes need not be valid UTF-8.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, in_workers, join_spread, materialise, picked, texts_of
from .near_dups import mix

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
POSITION = (1 << 30) - 1
#: Bytes of text anchored at once, and suffixes sorted at once.
CHUNK, BATCH = 1 << 19, 10_000
#: Rows of a batch taken at once.
ROWS = 256
#: Suffixes from which on a family ends with the next key.
FAMILY = 6 * BATCH


class Grams:
    """Rolling hashes modulo 2**64 of all n-grams of a byte buffer."""

    def __init__(self):
        self.power = self.inverse = np.zeros(0, np.uint64)

    def hashes(self, buf: np.ndarray, n: int) -> np.ndarray:
        if len(buf) > len(self.power):
            one = lambda b: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * len(buf), b, np.uint64))))
            self.power, self.inverse = one(BASE), one(INVERSE)
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[: len(buf)], dtype=np.uint64)))
        return mix((c[n:] - c[:-n]) * self.inverse[: len(buf) - n + 1])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(raws: list[bytes], length: int, grams: Grams) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, key, anchor less first start) of the runs of starts with one anchor, over several texts."""
    k = length // 2
    w = length - k + 1
    size = np.array([len(r) for r in raws], np.int64)
    buf = np.frombuffer(b"".join(raws), np.uint8)
    if len(buf) > POSITION:
        raise ValueError(f"a text of {len(buf)} bytes: at most {POSITION} can be anchored")
    if len(buf) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = grams.hashes(buf, k)
    low = np.uint64(POSITION)
    code = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    anchor = POSITION - (sliding_least(code, w) & low).astype(np.int64)
    first = np.cumsum(size) - size
    text = np.repeat(np.arange(len(raws)), size)[: len(anchor)]
    start = np.arange(len(anchor))
    ok = start + length <= (first + size)[text]
    start, text, anchor = start[ok], text[ok], anchor[ok]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(start)), bool), (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.append(new, len(start)))
    return text[new], start[new] - first[text[new]], n, h[anchor[new]].view(np.int64), anchor[new] - start[new]


def digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """(id, h, lo, n, anc, key, seg) of every segment of every text; anc: where its anchor is, from lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts_of(b.column(2))]
            a = 0
            while a < len(raws):
                e, held = a, 0
                while e < len(raws) and (e == a or held + len(raws[e]) <= CHUNK):
                    held += len(raws[e])
                    e += 1
                text, lo, n, key, anc = segments(raws[a:e], length, grams)
                seg = [digest(raws[a + t][x : x + m + length - 1]) for t, x, m in zip(text.tolist(), lo.tolist(), n.tolist())]
                at = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(anc, pa.int32()), pa.array(key, pa.int64()), pa.array(seg, pa.int64())], names=["id", "h", "lo", "n", "anc", "key", "seg"])
                a = e

    return docs.select("id", "h", "text").transform(in_workers, run, f"id {dict(docs.dtypes)['id']}, h bigint, lo int, n int, anc int, key bigint, seg bigint")


class Family:
    """Suffix arrays of geometrically growing sizes over one text, and where in it repeated strings start.

    A level is an array of positions in the order of their suffixes, one for every different string of the
    wanted length. The strings themselves are laid out only while a level is scanned.
    """

    def __init__(self, length: int):
        self.length, self.suffixes = length, 0
        self.text = np.zeros(0, np.uint8)
        self.repeated = np.zeros(0, bool)
        self.levels: list[np.ndarray] = []

    def strings(self, at: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[at]
        return np.ascontiguousarray(rows).view(f"S{self.length}").reshape(-1)

    def scan(self, level: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted strings belong in a level, and which of them stand there."""
        known = self.strings(level)
        at = np.searchsorted(known, found)
        return at, known[np.minimum(at, len(known) - 1)] == found

    def add(self, segments: list[bytes], weight: list[float]) -> np.ndarray:
        """A batch of segments, and how often each stands in the corpus; gives their places in the text."""
        size = np.array([len(x) for x in segments])
        first = len(self.text) + np.cumsum(size) - size
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(segments), np.uint8)))
        self.repeated = np.concatenate((self.repeated, np.zeros(size.sum(), bool)))
        starts = size - self.length + 1
        at = np.repeat(first - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
        found = self.strings(at)
        order = np.argsort(found, kind="stable")
        at, found, times = at[order], found[order], np.repeat(weight, starts)[order]
        new = np.concatenate(([True], found[1:] != found[:-1]))
        group = np.cumsum(new) - 1
        twice = np.bincount(group, times) >= 2
        level, found = at[new], found[new]
        for known in self.levels:
            where, same = self.scan(known, found)
            twice |= same
            self.repeated[known[where[same]]] = True
        self.repeated[at] = twice[group]
        self.suffixes += len(at)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self._merge()
        return first

    def _merge(self) -> None:
        """The last two levels become one; a string of both was found when the later one was scanned, and stays once."""
        small, large = self.levels.pop(), self.levels.pop()
        where, same = self.scan(large, self.strings(small))
        self.levels.append(np.insert(large, where[~same], small[~same]))


def spans(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """The bytes covered by strings at the given sorted starts, as maximal runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    first = starts[np.concatenate(([0], cut + 1))]
    last = starts[np.concatenate((cut, [len(starts) - 1]))] + length
    return [{"a": int(a), "b": int(b)} for a, b in zip(first, last)]


SPANS = "array<struct<a:int,b:int>>"
SPANS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def matched(records: DataFrame, length: int) -> DataFrame:
    """(key, seg, spans) of the segments with repeated strings; the records of a key lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, waiting, pending, closed = Family(length), [], [], 0, None

        def absorb() -> None:
            nonlocal pending
            if waiting:
                first = family.add([w[2] for w in waiting], [float(w[3]) for w in waiting])
                held.extend((w[0], w[1], a, len(w[2]) - length + 1) for w, a in zip(waiting, first.tolist()))
                waiting.clear()
                pending = 0

        def close() -> pa.RecordBatch:
            nonlocal family
            found = [(k, s, spans(np.flatnonzero(family.repeated[a : a + n]), length)) for k, s, a, n in held]
            found = [x for x in found if x[2]]
            family = Family(length)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], SPANS_ARROW)], names=["key", "seg", "spans"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if pending >= BATCH:
                    absorb()
                    if family.suffixes >= FAMILY and r[0] != closed:
                        yield close()
                waiting.append(r)
                pending += len(r[2]) - length + 1
                closed = r[0]
        absorb()
        if held:
            yield close()

    return records.select("key", "seg", "raw", "mult").transform(in_workers, run, f"key bigint, seg bigint, spans {SPANS}")


def cut_ranges(records: DataFrame, length: int, width: int) -> DataFrame:
    """(pkey, pseg, off, key, seg, raw, anc, mult): segments cut into ranges of at most width starts.

    The cuts are at fixed distances from the anchor, so equal strings fall into equal ranges; the key of a
    range is made of the bytes that all strings of its distances have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, seg, raw, anc, mult in zip(*(c.to_pylist() for c in b.columns)):
                n = len(raw) - length + 1
                for g in range((anc - n + 1) // width, anc // width + 1):  # distances g*width ... g*width+width-1
                    first, last = max(0, anc - g * width - width + 1), min(n - 1, anc - g * width)
                    own = raw[first : last + length]
                    common = raw[anc - g * width : anc - g * width - width + 1 + length]
                    out.append((key, seg, first, digest(b"%d %d %d " % (key, width, g) + common), digest(own), own, anc - first, mult))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["pkey", "pseg", "off", "key", "seg", "raw", "anc", "mult"])

    return records.select("key", "seg", "raw", "anc", "mult").transform(in_workers, run, "pkey bigint, pseg bigint, off int, key bigint, seg bigint, raw binary, anc int, mult bigint")


def decided(records: DataFrame, length: int, hot: int, width: int) -> DataFrame:
    """(key, seg, spans) from distinct (key, seg, raw, anc, mult); width: of the ranges that hot keys are cut into."""
    many = materialise(records.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("key"), "hot")
    if many.isEmpty():
        return matched(records.repartition("key").sortWithinPartitions("key", "seg"), length)
    many = F.broadcast(many) if fits_broadcast(many) else many
    cold = records.join(many, "key", "left_anti")
    children = materialise(cut_ranges(records.join(many, "key", "left_semi"), length, width), "ranges")
    alive = children.groupBy("key").agg(F.sum("mult").alias("m"), F.count("*").alias("n")).filter("m > 1").select("key", "n")
    distinct = join_spread(children, materialise(alive, "alive"), ["key"], "n").groupBy("key", "seg").agg(F.sum("mult").alias("mult"), F.first("raw").alias("raw"), F.first("anc").alias("anc"), F.count("*").alias("n"))
    distinct = materialise(distinct, "records")
    below = decided(distinct.select("key", "seg", "raw", "anc", "mult"), length, hot, max(1, width // 4))
    below = materialise(below.join(distinct.select("key", "seg", "n"), ["key", "seg"]), "found")
    up = join_spread(children, below, ["key", "seg"], "n").select(F.col("pkey").alias("key"), F.col("pseg").alias("seg"), F.transform("spans", lambda s: F.struct((s.a + F.col("off")).alias("a"), (s.b + F.col("off")).alias("b"))).alias("spans"))
    up = up.groupBy("key", "seg").agg(joined(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    return matched(cold.repartition("key").sortWithinPartitions("key", "seg"), length).unionByName(up)


def joined(lists):
    """Overlapping and touching spans of a sorted list as maximal runs."""
    zero = F.array().cast(SPANS)

    def step(acc, x):
        last = F.element_at(acc, -1)
        grow = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last.a.alias("a"), F.greatest(last.b, x.b).alias("b"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x.a <= last.b, grow).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(lists, zero, step)


def repeated_spans(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(id, h, spans) of the texts (id, h, text) that lose bytes; spans are maximal and sorted."""
    rows = materialise(anchored(docs, length), "segments")
    often = materialise(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    rows = materialise(join_spread(rows, often, ["key"], "c", "left_semi"), "candidates")
    kinds = materialise(rows.groupBy("key", "seg").agg(F.count("*").alias("mult"), F.min(F.struct("id", "h", "lo", "n", "anc")).alias("r")), "kinds")
    by_doc = materialise(kinds.groupBy("r.id", "r.h").agg(F.collect_list(F.struct("key", "seg", "mult", "r.lo", "r.n", "r.anc")).alias("want")), "wanted")
    texts = narrowed(docs, by_doc)
    same = F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h"))
    # equal rows would bring a segment twice
    whole = texts.alias("d").join(by_doc.alias("w"), same).select(F.encode("d.text", "UTF-8").alias("raw"), "w.want")
    records = whole.select(F.explode(F.transform("want", lambda x: F.struct(x.key.alias("key"), x.seg.alias("seg"), x.mult.alias("mult"), x.anc.alias("anc"), F.substring("raw", x.lo + 1, x.n + (length - 1)).alias("raw")))).alias("x")).select("x.*")
    records = materialise(records, "records").dropDuplicates(["key", "seg"])
    found = decided(records, length, hot, length // 8).join(kinds.select("key", "seg", "mult"), ["key", "seg"])
    placed = join_spread(rows, materialise(found, "found"), ["key", "seg"], "mult").select("id", "h", F.transform("spans", lambda s: F.struct((s.a + F.col("lo")).alias("a"), (s.b + F.col("lo")).alias("b"))).alias("spans"))
    # a set: equal rows bring equal spans
    return placed.groupBy("id", "h").agg(joined(F.array_sort(F.flatten(F.collect_set("spans")))).alias("spans"))


def narrowed(docs: DataFrame, some: DataFrame) -> DataFrame:
    """Only the documents with an id in some, if these ids are few enough to broadcast; else all."""
    ids = some.select("id").distinct()
    return docs.join(F.broadcast(ids), docs.id.eqNullSafe(ids.id), "left_semi") if fits_broadcast(ids) else docs


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = 1000, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(id, kept columns, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every row."""
    sent = [c for c in keep if c != text_col]
    names = {f"x{i}": c for i, c in enumerate(sent)}
    docs = picked(df, id=id_col, text=text_col, **names).withColumn("whole", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("whole"))
    found = materialise(repeated_spans(docs.select("id", "h", F.col("whole").alias("text")), length, hot), "spans")
    ids = found.select("id").distinct()
    few = F.broadcast(ids) if fits_broadcast(ids) else ids
    hit = docs.join(few, docs.id.eqNullSafe(ids.id), "left_semi")
    clean = docs.join(few, docs.id.eqNullSafe(ids.id), "left_anti")
    same = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.h") == F.col("s.h"))
    hit = hit.alias("d").join(found.alias("s"), same, "left").select("d.id", *(f"d.{c}" for c in names), "d.text", "s.spans")
    every = hit.unionByName(clean.select("id", *names, "text", F.lit(None).cast(SPANS).alias("spans")))
    kinds = dict(every.dtypes)
    passed = ["id", *names, *(["text"] if with_text or text_col in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            out = []
            for text, cuts in zip(texts_of(b.column(1 + len(names))), b.column(2 + len(names)).to_pylist()):
                raw, cuts = text.encode("utf-8", "surrogatepass"), cuts or []
                edges = [0, *(x for c in cuts for x in (c["a"], c["b"])), len(raw)]
                rest = b"".join(raw[a:e] for a, e in zip(edges[::2], edges[1::2])) if cuts else raw
                out.append((len(raw), len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text and cuts else None))
            cols = list(zip(*out)) if out else [()] * 5
            own = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(passed))] + own, names=[*passed, "n_bytes", "n_removed", "n_spans", "kept_sha256", "cut"])

    fields = ", ".join(f"{c} {kinds[c]}" for c in passed)
    out = every.transform(in_workers, run, f"{fields}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, cut string")
    kept = {c: k for k, c in names.items()} | {text_col: "text"}
    rest = [F.coalesce("cut", "text", F.lit("")).alias("kept_text")] if with_text else []
    return out.select(F.col("id").alias(id_col), *(F.col(kept[c]).alias(c) for c in keep), "n_bytes", "n_removed", "n_spans", "kept_sha256", *rest)
