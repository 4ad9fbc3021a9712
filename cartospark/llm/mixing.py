"""Mix sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its
documents should have; the whole part is sure, the fraction is a probability.
Pivotal rounding settles the fractions: two documents meet, words move from one
to the other at random until one of them is settled at 0 or 1, and the other
goes on. What moves is words, not probability, so a source's expected words
stay as they are at every meeting and the total is off by less than one
document in the end, while every document keeps its probability in expectation.

Meetings form a reduction tree. A source's documents fall into size classes
(powers of two), a class into blocks of about FAN by a hash. Each block leaves
one unsettled document, FAN of these leave one again, up to one per class. One
block of every class waits for the source's root, where all of them meet from
long to short, so what is unsettled in the end, and a last draw settles, is one
of the shortest documents and the total misses the target by hardly more. All draws are hashes of the documents and
a seed, so reruns agree. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let, n_words, small

WEIGHTS, CAP, FAN, SEED = (5, 2, 1), 3, 32, 20_250


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, sid, target) from (source, size).

    Sources by code point, null last, weigh WEIGHTS in turn and share all
    words; none gets more than CAP times its size, the excess is reshared by
    weight until none is above. Sorted by cap over weight, source i is capped
    exactly if its cap is below its share of what the ones before it leave, so
    one pass over the (few) sources suffices. Empty sources get 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((CAP * F.col("source_size") / F.col("weight")).asc(), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum(CAP * F.col("source_size")).over(before), F.lit(0))
    heavy = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / heavy.cast("double"))
    cap = (CAP * F.col("source_size")).cast("double")
    capped = cap <= F.col("weight") * F.col("level")
    # the level of the first uncapped source, the highest of theirs, holds for all later ones
    level = F.max(F.when(~capped, F.col("level"))).over(all_)
    return per.select("source", "source_size", "n_docs", "sid", F.when(capped, cap).otherwise(F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"))


def _draw(*keys: Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(SEED)), 11).cast("double") / float(1 << 53)


def _meet(a: Column, b: Column, settled: Column) -> Column:
    """State after the unsettled document a meets b: {p, doc_id, size, h of the one that goes on, settled ones}."""
    up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])
    down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
    rises = _draw(a["h"], b["h"]) * (up + down) < down  # a rises with probability down / (up + down): no drift
    a_full, b_void = a["size"] * (1 - a["p"]), b["size"] * b["p"]
    a_void, b_full = a["size"] * a["p"], b["size"] * (1 - b["p"])
    item = lambda x, p: F.struct(x["k"].alias("k"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.cast("double").alias("p"))
    goes = lambda on, off, p_on, p_off: F.struct(item(on, p_on).alias("on"), F.concat(settled, F.array(item(off, p_off))).alias("settled"))
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.when(rises & (a_full <= b_void), goes(b, a, b["p"] - a_full / b["size"], one)).when(rises, goes(a, b, a["p"] + b_void / a["size"], zero)).when(a_void <= b_full, goes(b, a, b["p"] + a_void / b["size"], zero)).otherwise(goes(a, b, a["p"] - b_full / a["size"], one))


ITEM = "struct<k: bigint, h: bigint, doc_id: bigint, size: bigint, p: double>"


def round_block(items: Column) -> Column:
    """{on, settled} of one block: its documents meet one after the other, long ones first, so that what stays unsettled is short."""

    def fold(sorted_items: Column) -> Column:
        start = F.struct(F.element_at(sorted_items, 1).alias("on"), F.expr(f"cast(array() as array<{ITEM}>)").alias("settled"))

        def step(acc: Column, b: Column) -> Column:
            # a rounding error may leave a settled one on: then the next simply takes its place
            done = (acc["on"]["p"] <= 0) | (acc["on"]["p"] >= 1)
            return F.when(done, F.struct(b.alias("on"), F.concat(acc["settled"], F.array(acc["on"])).alias("settled"))).otherwise(_meet(acc["on"], b, acc["settled"]))

        return F.aggregate(F.slice(sorted_items, 2, F.greatest(F.size(sorted_items), F.lit(1))), start, step)

    return let(F.array_sort(items), fold)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken (= copies * size).

    ``copies`` is between 0 and CAP. Null texts have size 0, documents of size 0
    take nothing and are settled by a draw of their own. Null sources form one
    source, the last. Ids may be null or repeat: equal rows are numbered, so each
    has draws of its own, and are interchangeable.
    An empty table gives none; other columns are ignored.
    """
    sizes = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size")))
    per = cut(source_targets(sizes))
    n = per.count()
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("twins"))
    numbered = alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "twins")).alias("twin"))
    rows = numbered.join(small(per, n), numbered["source"].eqNullSafe(per["source"])).select("doc_id", "size", "twin", "sid", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("c"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "size", "sid", "twin", F.lit(SEED))).withColumn("p", F.col("c") - F.floor("c")).withColumn("cls", F.when(F.col("size") > 0, F.floor(F.log2("size"))).cast("int"))
    item = F.struct((-F.col("size")).alias("k"), "h", "doc_id", "size", "p")
    sure = rows.where("p = 0").select("sid", item.alias("d"))
    blank = rows.where("p > 0 and size = 0").select("sid", F.struct((-F.col("size")).alias("k"), "h", "doc_id", "size", F.when(_draw(F.col("h"), F.col("doc_id")) < F.col("p"), 1.0).otherwise(0.0).alias("p")).alias("d"))
    rows = rows.where("p > 0 and size > 0")
    classes = cut(rows.groupBy("sid", "cls").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("blocks")))
    few = classes.agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("most")).first()
    live = rows.join(small(classes, few["n"]), ["sid", "cls"]).select("sid", "cls", F.pmod("h", "blocks").alias("block"), item.alias("d"))
    roots = live.where("block = 0").select("sid", "d")
    live = live.where("block > 0").withColumn("block", F.col("block") - 1)
    settled, blocks = [sure, blank], (few["most"] or 1) - 1
    while blocks > 0:
        level = cut(live.groupBy("sid", "cls", "block").agg(F.collect_list("d").alias("ds")).select("sid", "cls", "block", round_block(F.col("ds")).alias("r")))
        settled.append(level.select("sid", F.explode("r.settled").alias("d")))
        live = level.select("sid", "cls", F.floor(F.col("block") / FAN).alias("block"), F.col("r.on").alias("d"))
        if blocks == 1:
            break
        blocks = -(-blocks // FAN)
    if blocks > 0:
        roots = roots.unionByName(live.select("sid", "d"))
    root = cut(roots.groupBy("sid").agg(F.collect_list("d").alias("ds")).select("sid", round_block(F.col("ds")).alias("r")))
    settled.append(root.select("sid", F.explode("r.settled").alias("d")))
    last = root.select("sid", F.col("r.on").alias("d"))
    drawn = F.struct(F.col("d.k").alias("k"), F.col("d.h").alias("h"), F.col("d.doc_id").alias("doc_id"), F.col("d.size").alias("size"), F.when(_draw(F.col("d.h")) < F.col("d.p"), 1.0).otherwise(0.0).alias("p"))
    settled.append(last.select("sid", drawn.alias("d")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    out = out.join(small(per, n), "sid")
    whole = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    out = out.select(F.col("d.doc_id").alias("doc_id"), F.col("d.size").alias("size"), "source", "source_size", "target", (whole + F.col("d.p").cast("long")).cast("long").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as ``copies`` says; columns stay as they are, whatever their names."""
    key = ["i", "s", "n"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))).alias("r")
    taken = copies(docs, id_col, text_col, source_col).select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n"), F.col("copies").alias("c"))
    taken = taken.select("*", number).where("c > 0").select(*(F.col(x).alias(f"t{x}") for x in (*key, "r", "c")))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("i"), F.col(source_col).cast("string").alias("s"), n_words(F.col(text_col).cast("string")).alias("n")).select("*", number)
    met = rows["i"].eqNullSafe(taken["ti"]) & rows["s"].eqNullSafe(taken["ts"]) & (rows["n"] == taken["tn"]) & (rows["r"] == taken["tr"])
    return rows.join(taken, met).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("tc"))).alias("no")).select("row.*")
