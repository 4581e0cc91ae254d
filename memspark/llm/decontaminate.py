"""Benchmark decontamination by winnowing, with SQL functions only.

Texts and benchmark items become word arrays. Of all k-gram hashes the least of every window is kept
(k + window - 1 is the number of words of an item window, so a shared window always shares a pick);
the picks of all texts are written once, with their numbers of words, and joined with the items' picks. A hit is extended to the item windows it can lie in, and these are
joined with the item windows word by word, so hash collisions never count. Items with fewer words than
a window stand as one window and are looked up at every place, all such lengths in one more pass.

Defined cases: null and empty texts have no words; null and wordless items have no windows. Items with a
null id mark words as hit but are not listed. Repeated documents give a row each; repeated items count
once by id. No items, no hits; no documents, no rows. A text may have up to 2**28 words (places have 28 bits).
Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import winnow
from .common import WORD, materialise, picked, text_hash

#: What may be broadcast, in rows of about 40 bytes; beyond it the joins shuffle.
BROADCAST_ROWS = 500_000
#: The same for rows with a text window or a list of places, in bytes.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """In lower case beyond A-Z too, which is much faster than for A-Z alone.

    Every word keeps its place, and equal words stay equal (the one rule that looks at neighbours, for
    the last sigma of a word, is undone). What is equal only here falls away when words are compared.
    """
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ"))


def folded(text: Column) -> Column:
    """Hashes of the lowered words."""
    return F.transform(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _fps(hashes: Column, span: int, k: int) -> Column:
    return winnow.picks(winnow.codes(hashes, k), span - k + 1)


def _gram(h: Column, i: Column, m: int) -> Column:
    return F.xxhash64(*(F.get(h, i + j) for j in range(m)))


def _grams(h: Column, m: int) -> Column:
    every = F.transform(F.sequence(F.lit(0), F.size(h) - m), lambda i: _gram(h, i, m))
    return F.when(F.size(h) >= m, every).otherwise(F.array().cast("array<bigint>"))


def _placed_grams(h: Column, m: int) -> Column:
    return F.transform(_grams(h, m), lambda g, i: F.struct(F.lit(m).alias("len"), i.alias("p"), g.alias("g")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5, with_hash: bool = False) -> DataFrame:
    """(id[, h: the text's hash], n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    docs = picked(docs, id=id_col, text=text_col).withColumn("h", text_hash())
    bench = materialise(picked(items, item=item_col, text=item_text_col).select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0), "items")
    stats = bench.agg(F.count("*").alias("n"), F.sum(F.size("ws")).alias("words"), F.collect_set(F.when(F.size("ws") < span, F.size("ws"))).alias("short")).first()

    # item windows: each distinct text once, with the items that hold it
    at = F.when(F.size("ws") >= span, F.sequence(F.lit(1), F.size("ws") - span + 1)).otherwise(F.array(F.lit(1)))
    whole = bench.select("item", F.explode(F.transform(at, lambda i: F.slice("ws", i, F.lit(span)))).alias("w"))
    windows = whole.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len")).groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))

    # candidate places (0-based starts of k-grams, or of whole short items) of documents that share a pick
    item_hashes = F.transform(F.col("ws"), lambda w: F.xxhash64(lowered(w)))
    long_items = bench.filter(F.size("ws") >= span).select(F.explode(_fps(item_hashes, span, k)).alias("c")).select(winnow.gram_hash(F.col("c")).alias("g")).distinct()
    scan = docs.select("id", "h", winnow.let(folded(F.col("text")), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _fps(h, span, k).alias("picks"))).alias("x"))
    scan = materialise(scan.select("id", "h", "x.n_words", "x.picks"), "scan")
    doc_picks = scan.select("id", "h", F.explode("picks").alias("c"))
    hits = doc_picks.select("id", "h", winnow.gram_hash(F.col("c")).alias("g"), winnow.position(F.col("c")).alias("p")).join(_small(long_items, stats["words"] or 0), "g", "left_semi").select("id", "h", F.lit(span).alias("len"), "p")
    shorts = sorted(stats["short"] or [])
    if shorts:
        short = bench.filter(F.size("ws") < span).select(F.size("ws").alias("len"), winnow.let(item_hashes, lambda h: F.coalesce(*(F.when(F.size(h) == m, _gram(h, F.lit(0), m)) for m in shorts))).alias("g")).distinct()
        every = winnow.let(folded(F.col("text")), lambda h: F.flatten(F.array(*(_placed_grams(h, m) for m in shorts))))
        found = docs.select("id", "h", F.explode(every).alias("x")).select("id", "h", "x.len", "x.p", "x.g").join(_small(short, stats["n"]), ["len", "g"], "left_semi")
        hits = hits.unionByName(found.select("id", "h", "len", "p"))
    hits = materialise(hits.groupBy("id", "h").agg(F.collect_set(F.struct("len", "p")).alias("places")), "hits")
    size = hits.agg(F.count("*").alias("n"), F.sum(F.size("places")).alias("p")).first()
    places = _small(hits, size["n"] * 24 + (size["p"] or 0) * 16, BROADCAST_BYTES)

    # extension: the windows that hold a candidate place, compared word by word
    same = F.col("d.id").eqNullSafe(F.col("x.id")) & (F.col("d.h") == F.col("x.h"))
    near = docs.alias("d").join(places.alias("x"), same).select("d.id", "d.h", words(F.col("d.text")).alias("ws"), "x.places")
    reach = lambda x: F.when(x.len < span, F.array(x.p)).otherwise(F.sequence(F.greatest(F.lit(0), x.p - (span - k)), F.greatest(F.lit(0), x.p)))
    starts = F.array_distinct(F.flatten(F.transform("places", lambda x: F.transform(reach(x), lambda s: F.struct(s.alias("s"), x.len.alias("len"))))))
    inside = F.filter(starts, lambda x: x.s + x.len <= F.size("ws"))
    tried = near.select("id", "h", F.explode(winnow.let(F.col("ws"), lambda ws: F.transform(inside, lambda x: F.struct(x.s.alias("s"), x.len.alias("len"), F.array_join(F.slice(ws, x.s + 1, x.len), " ").alias("window"))))).alias("x"))
    fixed = _small(windows, (stats["words"] or 0) * 120, BROADCAST_BYTES)
    real = tried.select("id", "h", "x.s", "x.len", "x.window").join(fixed, ["window", "len"]).groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("s", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a.end, x.s + x.len).alias("end"), (a.n + F.greatest(F.lit(0), x.s + x.len - F.greatest(a.end, x.s))).alias("n"))
    real = real.select("id", "h", F.aggregate("spans", zero, step, lambda a: a.n).alias("n_hit"), "items")

    base = scan.select("id", "h", "n_words")
    same = F.col("b.id").eqNullSafe(F.col("r.id")) & (F.col("b.h") == F.col("r.h"))
    ids = F.coalesce(F.col("r.items"), F.array().cast("array<string>"))
    return base.alias("b").join(real.alias("r"), same, "left").select(
        F.col("b.id").alias(id_col), *(["b.h"] if with_hash else []), "n_words", F.coalesce("r.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.coalesce(F.col("r.n_hit") > 0, F.lit(False)).alias("contaminated")
    )
