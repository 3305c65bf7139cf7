"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source has a target of words and so an expected number of copies (target / words, at most
two) for each of its documents. Whole copies are given at once; the fractional part is rounded
dependently: two documents with fractional probabilities compare the words they may still take,
and mass moves at random from one to the other, keeping their sum in words and each expectation,
until one probability is zero or one. The other goes on to meet the next document. A bucket of
about BUCKET documents leaves one residual; residuals of buckets meet in buckets of the next
level, up to one residual for each source, which is rounded by chance.

So the words of a source miss its target by less than one document. Every random number is a hash
of document, level and seed: reruns agree. Buckets are salted by that hash, so a source with a
third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.llm.common import free_name, row_hashes, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET = 64

_ITEM = "struct<doc_id:bigint,hash:bigint,size:bigint,whole:bigint,p:double>"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, docs): the words wanted of each source of ``sizes``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    words. A target stops at ``most`` times its source's words; the excess is shared by weight
    among the others until none is above. That fixed point is found in one pass: sources stop in
    the order of words per weight, so the running sums before a source give the level at which
    it would stop. The windows run over one row for each source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("words"),
                                       F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = each.withColumn("weight", F.element_at(
        F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")))
    every = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    after = every.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = (F.lit(share) * F.sum("words").over(whole)
            - F.lit(most) * F.coalesce(F.sum("words").over(before), F.lit(0.0)))
    level = left / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level).withColumn(
        "stops", F.col("level") * F.col("weight") >= most * F.col("words"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("words") / F.col("weight"), "level")))
    return leveled.withColumn("final", final.over(whole)["level"]).select(
        "source", F.col("words").cast("long").alias("source_size"), "docs",
        F.when(F.col("stops"), most * F.col("words")).otherwise(
            F.col("final") * F.col("weight")).alias("target"))


def _chance(item: Column, level: int, seed: int) -> Column:
    return (F.xxhash64(item["doc_id"], item["hash"], F.lit(level), F.lit(seed)).bitwiseAND((1 << 52) - 1)
            / F.lit(float(1 << 52)))


def _meet(state: Column, item: Column, level: int, seed: int) -> Column:
    """The residual meets the next document; who becomes integral joins ``done``."""
    one, two = state["rest"], item
    a, b = one["p"] * one["size"], two["p"] * two["size"]
    sum_ = a + b
    # ends of the line on which the words' sum stays: as many as possible in the one or the other
    high = F.least(one["size"].cast("double"), sum_)
    low = F.greatest(F.lit(0.0), sum_ - two["size"])
    a_new = F.when(_chance(two, level, seed) * (high - low) < a - low, high).otherwise(low)
    b_new = sum_ - a_new
    p_of = lambda words, x: F.when(x["size"] > 0, words / x["size"]).otherwise(0.0)
    exact = lambda words, x: (words <= 0) | (words >= x["size"])
    with_p = lambda x, p: F.struct(x["doc_id"].alias("doc_id"), x["hash"].alias("hash"),
                                   x["size"].alias("size"), x["whole"].alias("whole"), p.alias("p"))
    pair = F.struct(with_p(one, p_of(a_new, one)).alias("one"), with_p(two, p_of(b_new, two)).alias("two"))
    one_ends = exact(a_new, one)
    rounded = lambda x: with_p(x, F.round(x["p"]))
    met = F.struct(F.when(one_ends, pair["two"]).otherwise(pair["one"]).alias("rest"),
                   F.concat(state["done"], F.array(rounded(
                       F.when(one_ends, pair["one"]).otherwise(pair["two"])))).alias("done"))
    start = F.struct(item.alias("rest"), state["done"].alias("done"))
    return F.when(one.isNull(), start).otherwise(met)


def _level(items: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, rest, done) of each bucket: documents in the order of their size meet in turn."""
    grouped = items.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct(
        F.col("item.size").alias("size"), F.col("item.doc_id").alias("doc_id"), "item"))).alias("all"))
    listed = F.transform("all", lambda x: x["item"])
    zero = F.struct(F.lit(None).cast(_ITEM).alias("rest"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    folded = F.aggregate(listed, zero, lambda s, x: _meet(s, x, level, seed).cast(
        f"struct<rest:{_ITEM},done:array<{_ITEM}>>"))
    return grouped.select("source", folded.alias("f")).select("source", "f.rest", "f.done")


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
         bucket: int = BUCKET, seed: int = 42) -> DataFrame:
    """(doc_id, hash, source, size, source_size, target, copies, taken) of each row of ``sizes``
    (doc_id, hash, source, size); ``hash`` is any long that tells rows with equal ids apart."""
    wanted = stored(targets(sizes, weights, share, most), "targets")
    joined = sizes.join(wanted, sizes.source.eqNullSafe(wanted.source)).select(
        "doc_id", "hash", sizes.source, "size", "docs",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("x"))
    first = joined.select("source", F.struct(
        "doc_id", "hash", "size", F.floor("x").alias("whole"),
        (F.col("x") - F.floor("x")).alias("p")).cast(_ITEM).alias("item"), "docs")
    most_docs = wanted.agg(F.max("docs")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most_docs, 2), bucket)))
    items, out = first, []
    for level in range(levels):
        n = bucket ** (level + 1)
        salt = F.pmod(F.xxhash64("item.doc_id", "item.hash", F.lit(seed + level)),
                      F.greatest(F.lit(1), F.ceil(F.col("docs") / n))) if level < levels - 1 else F.lit(0)
        dealt = items.withColumn("bucket", salt.cast("long"))
        done = stored(_level(dealt, level, seed).join(wanted.select(
            F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "rounded")
        out.append(done.select("source", F.explode("done").alias("item")))
        items = done.select("source", F.col("rest").alias("item"), "docs")
    last = F.col("item")
    out.append(items.select("source", F.struct(
        last["doc_id"].alias("doc_id"), last["hash"].alias("hash"), last["size"].alias("size"),
        last["whole"].alias("whole"),
        (_chance(last, levels, seed) < last["p"]).cast("double").alias("p")).alias("item")))
    rounded = out[0]
    for more in out[1:]:
        rounded = rounded.union(more)
    result = rounded.select("source", "item.doc_id", "item.hash", "item.size",
                            (F.col("item.whole") + F.col("item.p").cast("long")).alias("copies"))
    return result.join(wanted.select(F.col("source").alias("s"), "source_size", "target"),
                       F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "hash", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of each row of ``docs``.

    ``size`` is the number of words of the text, null has none. Documents without words take no
    part in the exchange and no words. Null ids and null sources are values like others, repeated
    rows are rounded one by one, an empty table gives no rows, further columns are ignored.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("hash"),
                        "source", word_count().alias("size"))
    return plan(stored(sizes, "sizes"), **options).drop("hash")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns, whatever
    their names.

    Chances hang on a row's content and on its number among equal rows, so reruns agree, however
    the rows are partitioned.
    """
    keys = [free_name(docs, "row_key"), free_name(docs, "row_check")]
    copies = free_name(docs, "row_copies")
    rows = docs.withColumns(dict(zip(keys, row_hashes(docs), strict=True)))
    # equal rows are one with a count, so that many of them are no large group
    each = rows.select(F.col(keys[0]).alias("a"), F.col(keys[1]).alias("b"), "doc_id", "source",
                       word_count().alias("size")).groupBy("a", "b").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count("*").alias("n"))
    sizes = stored(each.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select(
        F.xxhash64("a", "b", "k").alias("hash"), "a", "b", F.col("doc_id").cast("long").alias("doc_id"), "source", "size"), "sizes")
    taken = plan(sizes.drop("a", "b"), **options).where("copies > 0").select("hash", "copies")
    # what equal rows take together is the same whichever of them takes it
    total = taken.join(sizes.select("hash", "a", "b"), "hash").groupBy("a", "b").agg(F.sum("copies").alias(copies))
    total = total.withColumnsRenamed({"a": keys[0], "b": keys[1]})
    return rows.dropDuplicates(keys).join(total, keys).withColumn(copies, F.explode(F.sequence(
        F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
