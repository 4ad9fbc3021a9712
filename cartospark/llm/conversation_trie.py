"""The tree of conversation prefixes, found without comparing conversations.

A prefix of d turns has a digest that adds up: every turn is hashed together
with its place, and the 128 bits, as four integers, are summed over the prefix.
So digests come from running sums that split anywhere, and equal prefixes have
equal digests (two different ones with a chance of about n^2 / 2^129 for n
prefixes). The smallest conversation of every digest owns that node. Whoever
owns a node owns all deeper ones of its own, so each conversation's first owned
depth is found by binary search: a round looks up one digest of every open
conversation among the minima, all in one join. The owned stretches are chains;
a chain hangs on the owner of the prefix before it. What subtrees hold is summed
over the tree of chains bottom-up by pointer doubling, then along each chain.

Hot keys: a conversation of any length is numbered by ranges and summed in
blocks of BLOCK turns; joins on owners or digests treat hot ones apart
(``spread_join``); everything else meets on unique keys. All of it is DataFrame
code but for the digest of a node's conversation ids, which SHA-256 takes in
order: these ids are first joined into pieces of at most PIECE ids, and the pieces
stream through one hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, n_words, partitions, ship, spread_join, stored

#: Turns (or nodes of a chain) in a block of running sums.
BLOCK = 1024
#: Ids in a piece of a node's id list: those that agree in all bits but the lowest.
PIECE_BITS = 9
#: A conversation starts anew with up to SHARED - 1 turns of the one that begins its run of RUN ids.
RUN, SHARED = 20, 4
LIMBS = ("l0", "l1", "l2", "l3")


def turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, t, words): each turn's digest of role and text, and the words of its text; rows without conv_id are none's."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("t"), n_words(text).alias("words"))


def numbered(rows: DataFrame) -> DataFrame:
    """(c, pos, t, words): places from 1 by turn (null first), equal turns by digest, without gathering a conversation in one task.

    Ranges of (c, turn, t) are numbered apart; a conversation that goes on in a
    further range starts there from the rows before it. There are fewer such
    starts than ranges.
    """
    n = partitions(rows.sparkSession)
    order = [F.col("turn").asc_nulls_first(), F.col("t"), F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, F.col("c"), *order).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)
    here = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("part", "c").orderBy(*order)).cast("long"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before > 0").select("c", "part", "before")
    return here.join(F.broadcast(starts), ["c", "part"], "left").select("c", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "t", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(convs: c, len; turns: c, d, t, words; number of turns read): every conversation with the first turns of its run's first one."""
    c = F.col("c")
    sizes = cut(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    n_rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = sizes.where(c % RUN == 0).select(c.alias("b"), F.col("n").alias("n_base"))
    h = F.crc32(c.cast("string").cast("binary")) % SHARED
    convs = sizes.select("c", "n", (c - c % RUN).alias("b"), h.alias("h")).join(first, "b", "left")
    convs = convs.withColumn("k", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.select("c", "b", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")))
    own = spread_join(rows, convs.select("c", "h", "k"), "c", n_rows).where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "t", "words")
    shared = rows.where((c % RUN == 0) & (F.col("pos") < SHARED)).withColumnRenamed("c", "b")
    shared = shared.join(convs.select("c", "b", "h"), "b").where("pos <= h").select("c", F.col("pos").alias("d"), "t", "words")
    return convs.select("c", "len"), own.unionByName(shared), n_rows


def summed(rows: DataFrame, cols: tuple[str, ...], block: Column, backwards: bool = False) -> DataFrame:
    """``rows`` of (c, d, ...) with ``cols`` replaced by their sums over c's rows up to d (or from d on), block by block."""
    d, b = (F.col("d").desc(), F.col("block").desc()) if backwards else (F.col("d"), F.col("block"))
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy("c", "block").orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("c", "block").agg(*(F.sum(x).alias(x) for x in cols))
    totals = totals.select("c", "block", *(F.sum(x).over(before).alias(f"{x}_before") for x in cols)).where(F.col(f"{cols[0]}_before").isNotNull())
    rows = rows.withColumns({x: F.sum(x).over(inside) for x in cols}).join(totals, ["c", "block"], "left")
    return rows.withColumns({x: F.col(x) + F.coalesce(f"{x}_before", F.lit(0)) for x in cols}).drop("block", *(f"{x}_before" for x in cols))


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, key, words): the digest of c's first d turns and the words of turn d."""
    bits = rows.withColumn("g", F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("t")), 256))
    bits = bits.select("c", "d", "words", *(F.conv(F.substring("g", 1 + 8 * i, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(LIMBS)))
    sums = summed(bits, LIMBS, F.floor((F.col("d") - 1) / BLOCK))
    return sums.select("c", "d", F.unhex(F.md5(F.concat_ws(".", *LIMBS))).alias("key"), "words")


def first_owned(convs: DataFrame, found: DataFrame, minima: DataFrame) -> DataFrame:
    """(c, len, f, a, p): c owns its prefixes from depth f on (len + 1: none); a = f - 1 is the depth before, p the owner there (null at 0)."""
    state = convs.select("c", "len", F.lit(0).cast("long").alias("lo"), (F.col("len") + 1).alias("hi"), F.lit(None).cast("long").alias("at"))
    owners, places = minima.select("key", "owner"), found.select("c", F.col("d").alias("mid"), "key")
    done = None
    while True:
        state = cut(state)
        open_ = state.where("hi - lo > 1")
        ready = state.where("hi - lo <= 1")
        done = ready if done is None else done.unionByName(ready)
        n_open = open_.count()
        if not n_open:
            break
        asked = cut(open_.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2)).join(places, ["c", "mid"]))
        told = spread_join(asked, owners, "key", n_open)
        mine = F.col("owner") == F.col("c")
        state = told.select("c", "len", F.when(mine, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(mine, F.col("mid")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("at")).otherwise(F.col("owner")).alias("at"))
    return done.select("c", "len", F.col("hi").alias("f"), F.col("lo").alias("a"), F.col("at").alias("p"))


def gathered(chains: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """(c, p, ...) of a forest of chains with ``cols`` summed over all that hangs on c: after k rounds over 2^k levels."""
    rows = cut(chains.withColumn("anc", F.col("p")))
    n = rows.count()
    while rows.where("anc is not null").take(1):
        below = rows.where("anc is not null").groupBy("anc").agg(*(F.sum(x).alias(f"{x}_below") for x in cols)).withColumnRenamed("anc", "c")
        up = rows.select(F.col("c").alias("anc"), F.col("anc").alias("further"))
        more = rows.join(below, "c", "left").withColumns({x: F.col(x) + F.coalesce(f"{x}_below", F.lit(0)) for x in cols}).select("c", "p", "anc", *cols)
        climbing = spread_join(more.where("anc is not null"), up, "anc", n).select("c", "p", F.col("further").alias("anc"), *cols)
        rows = stored(climbing.unionByName(more.where("anc is null")))
    return rows.select("c", "p", *cols)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(c, d, ends_sha256) of (c, d, conv): the ids in rising order, joined by commas; a node's pieces stream through one hash."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("c", "d", F.shiftright("conv", PIECE_BITS).alias("no")).agg(piece.alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for b in batches:
            for c, d, piece in zip(*(b.column(x).to_pylist() for x in ("c", "d", "piece")), strict=True):
                if (c, d) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield from rows(out)
            out = []
        if node is not None:
            yield from rows([(*node, state.hexdigest())])

    def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["c", "d", "ends_sha256"])

    ship(ends.sparkSession)
    return pieces.repartition(partitions(ends.sparkSession), "c", "d").sortWithinPartitions("c", "d", "no").select("c", "d", "piece").mapInArrow(run, "c long, d long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Null turns come first, equal turns by the SHA-256 of role and text, repeated
    rows are turns of their own; null role or text is empty; rows without
    conv_id are left out; an empty table has no node, not even a root. Runs of
    negative ids follow SQL's remainder. Extra columns play no part.
    """
    spark = conversations.sparkSession
    rows = cut(numbered(turns(conversations)))
    convs, again, _ = rebuilt(rows)
    found = cut(prefixes(again))
    minima = cut(found.groupBy("key").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.max("words").alias("words")))
    head = convs.agg(F.min("c").alias("root"), F.count(F.lit(1)).alias("n")).first()
    root = F.lit(head["root"]).cast("long")
    marked = cut(first_owned(convs, found, minima).withColumn("p", F.coalesce("p", root)))
    chains = marked.where((F.col("f") <= F.col("len")) | (F.col("c") == root))
    chains = cut(chains.select("c", "len", *(F.when(F.col("c") != root, F.col(x)).alias(x) for x in ("a", "p")), F.when(F.col("c") == root, 0).otherwise(F.col("f")).alias("f")))

    top = spark.range(1 if head["n"] else 0).select(root.alias("c"), F.lit(0).cast("long").alias("d"), F.lit(head["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("words"))
    nodes = minima.select(F.col("owner").alias("c"), "d", "n", "words").unionByName(top)
    none, no = F.lit(None).cast("long"), F.lit(0)
    marks = chains.select("c", F.col("f").alias("d"), F.col("p").alias("parent"), F.lit(1).alias("head"), no.alias("last"), no.alias("hung"))
    marks = marks.unionByName(chains.select("c", F.col("len").alias("d"), none.alias("parent"), no.alias("head"), F.lit(1).alias("last"), no.alias("hung")))
    marks = marks.unionByName(chains.where("p is not null").select(F.col("p").alias("c"), F.col("a").alias("d"), none.alias("parent"), no.alias("head"), no.alias("last"), F.lit(1).alias("hung")))
    marks = marks.groupBy("c", "d").agg(F.max("parent").alias("parent"), F.max("head").alias("head"), F.max("last").alias("last"), F.sum("hung").alias("hung"))
    nodes = nodes.join(marks, ["c", "d"], "left").fillna(0, ["head", "last", "hung"])
    nodes = cut(
        nodes.select(
            "c", "d", "n", F.when(F.col("head") == 1, F.col("parent")).otherwise(F.col("c")).alias("parent"), (1 - F.col("last") + F.col("hung")).alias("n_children"),
            ((F.col("last") == 1) & (F.col("hung") == 0)).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"),
        )
    )
    held = nodes.groupBy("c").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    held = gathered(held.join(chains.select("c", "p"), "c"), ("leaves", "saved"))
    hung = held.join(chains.where("p is not null").select("c", "a"), "c").groupBy(F.col("p").alias("c"), F.col("a").alias("d")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    full = nodes.join(hung, ["c", "d"], "left").withColumns({x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0)) for x in ("leaves", "saved")}).drop("more_leaves", "more_saved")
    full = summed(full, ("leaves", "saved"), F.floor(F.col("d") / BLOCK), backwards=True)
    ends = marked.select(F.when(F.col("f") <= F.col("len"), F.col("c")).otherwise(F.col("p")).alias("c"), F.col("len").alias("d"), F.col("c").alias("conv"))
    out = full.join(ends_digest(ends), ["c", "d"], "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
