"""Document fingerprints by winnowing, with SQL functions only, and how they stand an edit.

Units are runs of up to 16 characters without white space (a whole word, as a rule). Of the rolling
hashes of k units in a row the least of every window is kept, the rightmost of ties, with its position.
Texts that share k + window - 1 units in a row share a picked hash; likeness is the Jaccard share of the
picked hashes. The edited text has its second half replaced by the beginning of the next document.

Neighbours: documents follow one another by descending id, then by descending hash of the text. Sampled
splitters, held in one sorted literal array and searched by halving, deal them to ranges of this order; a
splitter is the first document of its range and is also given to the range before it in the order, so that
every successor is found inside one range, with one shuffle of the texts.

Defined cases: a null text counts as empty. The empty text has an empty fingerprint; it is like another
empty text (1) and nothing else (0). A text of white space, or of fewer than k units, has one pick. Positions
have 28 bits, so texts are to have fewer than 2**28 units. Ids may be of any type with an order; null ids come
last and are spread by their texts. Rows with equal id and text follow each other and lie in one range.
A single document is its own next. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import winnow
from .common import materialise, picked

UNIT = r"\S{1,16}"
#: Ranges at most, and sampled keys for each: these are gathered in one array of one row.
MOST_RANGES, SAMPLED = 1 << 17, 8


def picks(text: Column, k: int, window: int) -> Column:
    """The picks of a text, in order."""
    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))

    def of(h):
        one = F.xxhash64(h, F.when(F.size(h) == 0, text).otherwise(F.lit(""))).bitwiseAND(F.lit(~winnow.LOW)).bitwiseOR(F.lit(winnow.LOW).cast("long"))
        return F.when(F.size(h) >= k, winnow.picks(winnow.codes(h, k), window)).when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(one))

    return winnow.let(units, of)


def rendered(c: Column) -> Column:
    """hash@position of each pick, comma-joined."""
    one = lambda x: F.concat(F.lower(F.hex(winnow.gram_hash(x).bitwiseAND(F.lit((1 << 36) - 1)))), F.lit("@"), winnow.position(x).cast("string"))
    return F.array_join(F.transform(c, one), ",")


def likeness(a: Column, b: Column) -> Column:
    hashes = lambda c: F.array_distinct(F.transform(c, winnow.gram_hash))

    def share(x):
        both = F.size(F.array_intersect(x.a, x.b))
        every = F.size(x.a) + F.size(x.b) - both
        return F.when(every == 0, F.lit(1.0)).otherwise(both / every)

    return winnow.let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), share)


def splitters(docs: DataFrame, rows_per_range: int) -> tuple[DataFrame, int]:
    """One row: cuts, a sorted array of keys that exist, and the largest key; how many cuts there are at most."""
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / rows_per_range)))
    share = min(1.0, ranges * SAMPLED / max(1, n))
    luck = F.shiftrightunsigned(F.xxhash64("key", F.lit(29)), 11) / F.lit(float(1 << 53))
    some = docs.agg(F.array_sort(F.collect_set(F.when(luck < share, F.col("key")))).alias("some"), F.max("key").alias("last"))
    step = max(1, round(n * share / ranges))
    at = F.when(F.size("some") >= step, F.sequence(F.lit(step), F.size("some"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    cuts = F.filter(F.transform(at, lambda i: F.get("some", i - 1)), lambda x: x < F.col("last"))
    return materialise(some.select(cuts.alias("cuts"), "last"), "splitters"), math.ceil(n * share)


def before(cuts: Column, key: Column, most: int) -> Column:
    """How many of the sorted cuts, at most so many, are smaller than key."""

    def halve(s, _):
        middle = F.floor((s.lo + s.hi) / 2).cast("int")
        return F.when(s.lo >= s.hi, s).when(F.get(cuts, middle) < key, F.struct((middle + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), middle.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most).bit_length())), start, halve, lambda s: s.lo)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, window: int = 10, rows_per_range: int = 1000) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    docs = picked(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("key", F.struct(F.col("id"), F.xxhash64("text").alias("h")))
    found, most = splitters(docs.select("key"), rows_per_range)
    # range j holds (cuts[j-1], cuts[j]]: in descending order its splitter comes first
    lit = docs.select("id", "text", "key", found.select("cuts").scalar().alias("cuts"), found.select("last").scalar().alias("last"))
    # read through let, the array stays a value of the expression and is not copied into rows
    placed = winnow.let(F.col("cuts"), lambda cuts: winnow.let(before(cuts, F.col("key"), most), lambda home: F.struct(home.alias("home"), (F.get(cuts, home) == F.col("key")).alias("is_cut"))))
    dealt = lit.select("id", "text", "key", placed.alias("p"), (F.col("key") == F.col("last")).alias("is_last"))
    # a splitter ends the range above it too; the largest key also follows the very last document
    homes = F.array_compact(F.array(F.struct(F.col("p.home").alias("range"), F.lit(False).alias("ghost")), F.when(F.col("p.is_cut"), F.struct((F.col("p.home") + 1).alias("range"), F.lit(True).alias("ghost"))), F.when(F.col("is_last"), F.struct(F.lit(0).alias("range"), F.lit(True).alias("ghost")))))
    dealt = dealt.select("id", "text", "key", F.explode(homes).alias("at")).select("id", "text", "key", "at.range", "at.ghost")
    # ghosts come after all rows of the range they were lent to
    order = W.partitionBy("range").orderBy("ghost", F.desc("key"), "text")
    n = F.char_length("text")
    seen = dealt.withColumn("next", F.lead("text").over(order)).withColumn("n", n)
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next", F.lit(1), half))
    seen = seen.select("id", "key", "range", "ghost", "text", "n", F.when(~F.col("ghost"), edited).alias("edited"))
    seen = seen.select("id", "key", "range", "ghost", "text", "n", F.sha2("edited", 256).alias("sha"), picks(F.col("text"), k, window).alias("own"), picks(F.col("edited"), k, window).alias("cut"))
    seen = seen.withColumn("following", F.lead("own").over(order)).filter(~F.col("ghost"))
    return seen.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), rendered(F.col("own")).alias("fingerprint"), rendered(F.col("cut")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("cut")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
