"""Near-duplicate documents by DartMinHash signatures, banded joins, exact checks and components.

Darts are thrown at the plane (weight x rank) of every element by hashing; the darts inside the region
an element's weight spans are its own. Each dart also hashes to one of k coordinates, and a coordinate
keeps its dart of lowest rank: two weighted sets agree in a coordinate with probability equal to their
weighted Jaccard similarity. Ranks are covered up to about (ln k + 2) * k / total weight, and further for
those few sets that leave a coordinate empty, so the work follows the number of elements plus k ln k.

Elements are the distinct shingles of ``shingle`` words, of weight 1, or as often as they occur.
Documents with equal shingle sets are one from the start, and weigh nothing further on. Bands of ``rows``
coordinates are bucket keys, and sets connected by common buckets form a block of candidates. A link is a pair
of sets of a common bucket with a similarity of at least ``threshold``, checked exactly; sets connected by
links form a class. How a block is settled changes the work, not the links: one of at most ``local`` sets and
``local_elements`` elements goes to one worker. Of a larger block all members of a bucket are first compared
with one centre; in buckets that still hold several classes, the members outside the largest one with a few
members of it, for some rounds. What is left is joined by prefixes: sets that are alike enough share one of
their few rarest elements. No bucket's pairs are listed all, and pairs inside a class are not listed.

Defined cases: a text of fewer words than a shingle is one shingle; a text without words (null, empty)
is in a class with the others of its kind. Very long texts count whole. Repeated ids with different texts are
linked by what they share. A null id is kept, and is never the class's name unless all are null. No rows
give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fits_broadcast, in_workers, join_spread, materialise, picked, text_hash, texts_of
from .licences import words_of

#: Upper ranks of the strips darts are thrown in; what lies beyond doubles.
STRIPS = [1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0, 2.0]
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (always arrays: they wrap without a warning)."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Counts with a Poisson law from uniform numbers."""
    n = np.zeros(len(u), np.int64)
    p = total = float(np.exp(-mean))
    k = 0
    while (u >= total).any() and k < 200:
        n += u >= total
        k += 1
        p *= mean / k
        total += p
    return n


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures of weighted sets, given flat: hashed elements, positive weights, and whose they are.

    A row of a set without elements is all ones. Weights are spanned by levels [0,1), [1,2), [2,4), ...
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * k, none)
    total = np.bincount(owner, weights, n)
    reach = (np.log(k) + 2) * k / np.maximum(total, 1e-9)
    todo = total > 0
    low, strip, rounds = 0.0, 0, 0
    while todo.any():
        high = STRIPS[strip] if strip < len(STRIPS) else low * 2
        at = np.flatnonzero(todo[owner])
        el, wt, ow = elements[at], weights[at], owner[at]
        start, level = 0.0, 0
        while len(el):
            end = 1.0 if level == 0 else start * 2
            # cells of a mean of eight darts at most
            cells = max(1, int(np.ceil((end - start) * (high - low) / 8)))
            for c in range(cells):
                seed = mix(el ^ mix(np.array([strip << 40 | level << 20 | c], np.uint64) + GOLDEN))
                count = _poisson(_unit(seed), (end - start) * (high - low) / cells)
                hit = np.flatnonzero(count)
                if len(hit):
                    dart = np.repeat(seed[hit], count[hit])
                    nth = np.arange(len(dart)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
                    dart = mix(dart + GOLDEN * (nth.astype(np.uint64) + np.uint64(1)))
                    whose, most = np.repeat(ow[hit], count[hit]), np.repeat(wt[hit], count[hit])
                    a, b = mix(dart ^ M1), mix(dart ^ M2)
                    where = start + _unit(a) * (end - start)
                    # a cell is a slice of the strip's ranks
                    rank = low + (c + _unit(b)) * (high - low) / cells
                    ok = where < most
                    key = rank[ok].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (dart[ok] & np.uint64(0xFFFFFFFF))
                    slot = whose[ok] * k + (mix(dart[ok] + GOLDEN) % np.uint64(k)).astype(np.int64)
                    np.minimum.at(best, slot, key)
            more = wt > end
            el, wt, ow = el[more], wt[more], ow[more]
            start, level = end, level + 1
        low, strip = high, strip + 1
        empty = (best.reshape(n, k) == none).any(1)
        todo &= (low < reach) | empty
    return best.reshape(n, k)


def shingles(text: str, size: int, salt: str = "") -> dict[int, int]:
    """Hashed shingles of a text, with how often each occurs."""
    w = words_of(text)
    out: dict[int, int] = {}
    runs = [" ".join(w)] if 0 < len(w) < size else [" ".join(x) for x in zip(*(w[i:] for i in range(size)))]
    for r in runs:
        h = hash64(r)
        out[h] = out.get(h, 0) + 1
    return out


def hash64(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def word_hashes(text: str, cache: dict[str, int]) -> np.ndarray:
    out = []
    for w in words_of(text):
        h = cache.get(w)
        if h is None:
            if len(cache) > 300_000:
                cache.clear()
            h = cache[w] = hash64(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of words, in order, from the words' hashes; of fewer words, of all."""
    n = min(size, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        h = mix(h * GOLDEN + w[i : len(w) - n + 1 + i])
    return h


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), np.uint64(b + 1))
        for r in range(rows):
            h = mix(h * GOLDEN + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def class_of(elements: np.ndarray, weights: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes() + weights.astype(np.int64).tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, bands: int, rows: int, size: int, counts: bool) -> DataFrame:
    """(id, h: the text's hash, cls: that of the weighted shingle set, n: shingles, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            for part in (b.slice(a, 256) for a in range(0, b.num_rows, 256)):
                els, wts, cls = [], [], []
                for t in texts_of(part.column(1)):
                    e, c = np.unique(shingle_hashes(word_hashes(t, cache), size), return_counts=True)
                    c = c if counts else np.ones(len(c), np.int64)
                    els.append(e), wts.append(c.astype(np.float64))
                    cls.append(class_of(e, c))
                n = [len(e) for e in els]
                sig = signatures(np.concatenate(els) if els else np.zeros(0, np.uint64), np.concatenate(wts) if wts else np.zeros(0), np.repeat(np.arange(len(els)), n), len(els), bands * rows)
                keys = band_keys(sig, bands, rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), flat], names=["id", "h", "cls", "n", "bands"])

    return docs.select("id", "text", "h").transform(in_workers, run, f"id {dict(docs.dtypes)['id']}, h bigint, cls binary, n bigint, bands array<bigint>")


def sets_of(docs: DataFrame, size: int, counts: bool) -> DataFrame:
    """(cls, els, wts): the weighted shingle set of each text, in order of its elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            for part in (b.slice(a, 512) for a in range(0, b.num_rows, 512)):
                cls, els, wts = [], [], []
                for t in texts_of(part.column(0)):
                    e, c = np.unique(shingle_hashes(word_hashes(t, cache), size), return_counts=True)
                    c = c if counts else np.ones(len(c), np.int64)
                    cls.append(class_of(e, c)), els.append(e.view(np.int64)), wts.append(c if counts else c[:0])
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(els, pa.list_(pa.int64())), pa.array(wts, pa.list_(pa.int64()))], names=["cls", "els", "wts"])

    return docs.select("text").transform(in_workers, run, "cls binary, els array<bigint>, wts array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """Those of (a, b) whose sets are at least threshold alike, exactly."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("els").alias("ea"), F.col("wts").alias("wa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("els").alias("eb"), F.col("wts").alias("wb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            cols = [x.column(i) for i in range(6)]
            view = lambda c, i: c.values.to_numpy(zero_copy_only=False)[c.offsets[i].as_py() : c.offsets[i + 1].as_py()]
            for i in range(x.num_rows):
                ea, wa, eb, wb = (view(c, i) for c in cols[2:])
                common, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
                if counts:
                    both_ = np.minimum(wa[ia], wb[ib]).sum()
                    every = wa.sum() + wb.sum() - both_
                else:
                    both_ = len(common)
                    every = len(ea) + len(eb) - both_
                keep.append(bool(every and both_ >= threshold * every))
            yield pa.RecordBatch.from_arrays([cols[0], cols[1]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ea", "wa", "eb", "wb").transform(in_workers, check, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (a, b) links: the smallest node of the connected component."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        # large star: neighbours that are larger move to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_spread(both.filter("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large")
        # small star: smaller neighbours, and the node, move to the smallest
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_spread(large, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = materialise(small, "edges")
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def settle(els: list[np.ndarray], wts: list[np.ndarray], bands: np.ndarray, threshold: float, counts: bool) -> list[int]:
    """The first member of each set's component, by exact links of sets of a common bucket."""
    vocabulary, at = np.unique(np.concatenate(els), return_inverse=True)
    size = np.array([len(e) for e in els])
    start = np.cumsum(size) - size
    weight = np.concatenate(wts).astype(np.float64) if counts else np.ones(len(at))
    total = np.add.reduceat(weight, start)
    root = list(range(len(els)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(len(vocabulary))
    for i in range(len(els) - 1):
        own = at[start[i] : start[i] + size[i]]
        mark[own] = weight[start[i] : start[i] + size[i]]
        rest = slice(start[i + 1], None)
        common = np.add.reduceat(np.minimum(mark[at[rest]], weight[rest]), start[i + 1 :] - start[i + 1])
        mark[own] = 0
        alike = common >= threshold * (total[i] + total[i + 1 :] - common)
        for j in np.flatnonzero(alike & (bands[i + 1 :] == bands[i]).any(1)) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(els))]


def settled(blocks: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """(node, root) of the sets of small blocks; the rows of a block lie together in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                roots = settle([h[2] for h in held], [h[3] for h in held], np.stack([h[4] for h in held]), threshold, counts)
                yield pa.RecordBatch.from_arrays([pa.array([h[1] for h in held], pa.binary()), pa.array([held[r][1] for r in roots], pa.binary())], names=["node", "root"])

        for b in batches:
            block, cls = b.column(0).to_pylist(), b.column(1).to_pylist()
            flat = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (b.column(2), b.column(3), b.column(4))]
            for i in range(b.num_rows):
                if held and held[0][0] != block[i]:
                    yield from close()
                    held.clear()
                held.append((block[i], cls[i], *(v[o[i] : o[i + 1]].copy() for v, o in flat)))
        yield from close()

    return blocks.select("block", "cls", "els", "wts", "bands").transform(in_workers, run, "node binary, root binary")


def prefix_pairs(some: DataFrame, sets: DataFrame, threshold: float, counts: bool) -> DataFrame:
    """(a, b) of the sets (cls, root) of different roots that share a bucket and one of their rarest elements.

    Of n elements, in one order for all sets, two sets of a similarity of at least threshold share one of the
    first n - ceil(threshold * n) + 1: with fewer in common they could not reach it.
    """
    times = F.transform("els", lambda e, i: F.transform(F.sequence(F.lit(1), F.get("wts", i)), lambda k: F.xxhash64(e, k))) if counts else None
    own = some.join(sets, "cls").select("cls", "root", "bands", (F.flatten(times) if counts else F.col("els")).alias("els"))
    own = materialise(own, "own")
    flat = own.select("cls", F.size("els").alias("n"), F.explode("els").alias("e"))
    often = flat.groupBy("e").agg(F.count("*").alias("f")).filter("f > 1")  # an element of one set only links nothing
    rank = F.row_number().over(W.partitionBy("cls").orderBy(F.coalesce("f", F.lit(1)), "e"))
    # the slack keeps a rounded product from shortening a prefix
    first = flat.join(often, "e", "left").withColumn("r", rank).filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("f").isNotNull())
    first = materialise(first.select("cls", "e").join(own.select("cls", "root", "bands"), "cls"), "prefixes")
    both = first.alias("a").join(first.alias("b"), (F.col("a.e") == F.col("b.e")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root")) & F.arrays_overlap("a.bands", "b.bands"))
    return both.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def _bucketwise(members: DataFrame, sets: DataFrame, threshold: float, counts: bool, star_rounds: int, star_centres: int) -> DataFrame:
    """(node, root) of the sets of large blocks, bucket by bucket."""
    members = materialise(members, "members")
    links = materialise(similar(members.filter("cls <> centre").select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct(), sets, threshold, counts), "links")
    tried = links.select("a", "b").limit(0)
    for turn in range(star_rounds + 1):
        root = components(links)
        placed = members.join(root, F.col("cls") == F.col("node"), "left").select("key", "cls", "centre", F.coalesce("root", "cls").alias("root"))
        placed = materialise(placed, "placed")
        by = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
        mixed = by.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("roots > 1").select("key", "main")
        inside = materialise(placed.join(mixed, "key"), "mixed")
        if inside.isEmpty():
            return root
        if turn == star_rounds:
            pairs = prefix_pairs(inside.select("cls", "root").distinct(), sets, threshold, counts)
        else:
            outside = inside.filter("root <> main").select("key", F.col("cls").alias("a"), F.col("root").alias("ra"), F.col("centre").alias("ca"))
            # some members of the largest class, the same in all buckets where they are, stand for it
            some = inside.filter("root = main").groupBy("key").agg(*(F.min(F.struct(F.xxhash64("cls", F.lit(turn), F.lit(i)).alias("o"), F.col("cls").alias("b"), F.col("root").alias("rb"))).alias(f"x{i}") for i in range(star_centres)))
            others = some.select("key", F.explode(F.array_distinct(F.array(*(F.struct(f"x{i}.b", f"x{i}.rb") for i in range(star_centres))))).alias("x")).select("key", "x.b", "x.rb")
            pairs = outside.join(others, "key").filter("ra <> rb and a <> ca and b <> ca").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = materialise(tried.unionByName(pairs), "tried")
        links = materialise(links.unionByName(similar(pairs, sets, threshold, counts)), "links")
    return components(links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 32, rows: int = 6, shingle: int = 5, threshold: float = 0.8, counts: bool = False, local: int = 3000, local_elements: int = 4_000_000, star_rounds: int = 3, star_centres: int = 4) -> DataFrame:
    """(id, class_id, class_size, is_kept) of every row: class_id is the smallest id of the class, and one row with that id is kept."""
    whole = classes(df, id_col, text_col, bands, rows, shingle, threshold, counts, local, local_elements, star_rounds, star_centres)
    # of the rows that are the kept one's copies, by id and text, one
    turn = F.row_number().over(W.partitionBy("id", "h").orderBy("root"))
    out = lambda rows, kept: rows.select(F.col("id").alias(id_col), "class_id", "class_size", kept.alias("is_kept"))
    return out(whole.filter("NOT is_first"), F.lit(False)).unionByName(out(whole.filter("is_first").withColumn("_t", turn), F.col("_t") == 1))


def kept_rows(df: DataFrame) -> DataFrame:
    """(id, h, copies): id and text hash of the row that each class keeps, and how many rows of the input are that one."""
    return classes(df).filter("is_first").groupBy("id", "h").agg(F.count("*").alias("copies"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 32, rows: int = 6, shingle: int = 5, threshold: float = 0.8, counts: bool = False, local: int = 3000, local_elements: int = 4_000_000, star_rounds: int = 3, star_centres: int = 4) -> DataFrame:
    """(id, h, root, class_id, class_size, is_first) of every row; is_first: id and text are those that the class keeps."""
    docs = picked(df, id=id_col, text=text_col).withColumn("h", text_hash())
    sketches = materialise(sketch(docs, bands, rows, shingle, counts), "sketches")
    # a row for each different set: copies of a set weigh nothing from here on
    kinds = materialise(sketches.groupBy("cls").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.min(F.struct("id", "h")).alias("x"), F.count("*").alias("c")), "kinds")
    each = kinds.filter("n > 0").select("cls", F.explode("bands").alias("key"))
    # buckets with company; a key says its band too
    sizes = each.groupBy("key").agg(F.min("cls").alias("centre"), F.max("cls").alias("last")).filter("centre <> last").select("key", "centre")
    members = materialise(each.join(sizes, "key"), "buckets")
    involved = members.select("cls").distinct()
    one = materialise(kinds.join(involved, "cls", "left_semi").select("cls", "n", "bands", "x.id", "x.h"), "one")
    ids = one.select("id", "h")
    few = F.broadcast(ids) if fits_broadcast(ids) else ids
    texts = docs.alias("d").join(few.alias("o"), F.col("d.id").eqNullSafe(F.col("o.id")) & (F.col("d.h") == F.col("o.h"))).select("d.text")
    sets = materialise(sets_of(texts, shingle, counts).dropDuplicates(["cls"]).join(one.select("cls", "bands"), "cls"), "sets")
    block = materialise(components(members.select(F.col("cls").alias("a"), F.col("centre").alias("b"))).withColumnRenamed("root", "block"), "blocks")
    heavy = (F.col("sets") > local) | (F.col("elements") > local_elements)
    large = block.join(one.select(F.col("cls").alias("node"), "n"), "node").groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).filter(heavy).select("block")
    small = block.join(large, "block", "left_anti")
    inside = sets.join(small, F.col("cls") == F.col("node")).repartition("block").sortWithinPartitions("block", "cls")
    root = settled(inside, threshold, counts)
    if not large.isEmpty():
        those = block.join(large, "block", "left_semi").select(F.col("node").alias("cls"))
        root = root.unionByName(_bucketwise(members.join(those, "cls", "left_semi"), sets, threshold, counts, star_rounds, star_centres))
    rooted = kinds.select("cls", "c").join(root, F.col("cls") == F.col("node"), "left").select("cls", "c", F.coalesce("root", "cls").alias("root"))
    whole = join_spread(sketches.select("id", "h", "cls"), materialise(rooted, "roots"), ["cls"], "c").select("id", "h", "root")
    whole = materialise(whole, "classes")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x")
    names = whole.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), least).select("root", "class_id", "class_size", F.col("x.h").alias("kept_h"))
    return join_spread(whole, materialise(names, "names"), ["root"], "class_size").select("id", "h", "root", "class_id", "class_size", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("kept_h"))).alias("is_first"))
