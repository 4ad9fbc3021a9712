"""Line dedup with content-defined line chunks.

A rolling hash over the hashes of two neighbouring lines (blank ones apart)
stands at every line end. Where the corpus has that hash more than once, the
two lines belong together; elsewhere a text is cut. So the boundaries depend on
the lines beside them only, an insertion shifts none, and a repeated passage is
one chunk from its first line to its last, whatever stands around it. A chunk
of several lines whose every rolling hash stands earlier, in a document before
or higher up in the same one, is removed; so is a line of LONG words or more
that does. Of every line the first instance stays.

Hashes are grouped with the bytes of the line (of a pair, the later line; the
shorter one beside a long line), and a hash that two different lines share
removes nothing. Only DataFrame functions run: sums are made before the
shuffle, and what is repeated joins back to the texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, cut, let, without

#: Words of a line that is removed by itself; characters that count as a word where blanks are rare (scripts without them).
LONG, CHARS = 40, 10


def _words(line: Column) -> Column:
    """Words between blanks of any kind, or one for every CHARS characters if these are more. Lines with single blanks only, nearly all, need no regular expression."""
    plain = ~(F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == ""))
    for x in BLANKS.replace(" ", "").replace("\n", ""):
        plain = plain & ~F.contains(line, F.lit(x))
    count = F.when(plain, F.length(line) - F.length(without(line, " ")) + 1).otherwise(F.regexp_count(line, F.lit(WORD)))
    return F.greatest(count, F.floor(F.length(line) / CHARS).cast("int"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def items(text: Column, with_bytes: bool) -> Column:
    """array<struct<h, a, b[, bytes]>>: the rolling hash of each two neighbouring lines a and b that are not blank, and the hash of each long line (a = b).

    Two long lines have no common hash: each is looked at by itself.
    """
    filled = lambda x: (x != "") & x.rlike(r"[^\x20\x09-\x0D]")
    long = lambda x: (F.length(x) >= 2 * LONG - 1) & ((F.length(x) >= CHARS * LONG) | (_words(x) >= LONG))
    made = F.transform(_lines(text), lambda x, i: F.when(filled(x), F.struct(i.alias("i"), F.xxhash64(x).alias("h"), long(x).alias("long"), x.alias("t"))))

    def item(h: Column, a: Column, b: Column, bytes_: Column) -> Column:
        return F.struct(h.alias("h"), a.alias("a"), b.alias("b"), *([bytes_.alias("bytes")] if with_bytes else []))

    def of(lines: Column) -> Column:
        def both(x: Column, j: Column) -> Column:
            before = F.get(lines, j - 1)
            pair = F.when((j > 0) & ~(x["long"] & before["long"]), item(F.xxhash64(before["h"], x["h"]), before["i"], x["i"], F.when(x["long"], before["t"]).otherwise(x["t"])))
            return F.array(pair, F.when(x["long"], item(F.xxhash64(x["h"], F.lit(LONG)), x["i"], x["i"], x["t"])))

        return F.array_compact(F.flatten(F.transform(lines, both)))

    return let(F.array_compact(made), of)


def _cuts(found: Column) -> Column:
    """array<struct<a, b>>: first and last lines of the chunks to remove, from the repeated items of a text."""
    by_hash = F.array_sort(F.transform(found, lambda x: F.struct(x["h"].alias("h"), x["a"].alias("a"), x["b"].alias("b"), x["early"].alias("early"))))
    again = lambda s: F.transform(s, lambda x, i: F.when(x["early"] | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)), F.struct(x["a"].alias("a"), x["b"].alias("b"))))

    def runs(s: Column) -> Column:
        starts = F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["a"].alias("v"), F.coalesce(F.get(s, i - 1)["b"] >= x["a"], F.lit(False)).alias("on"))), lambda x: ~x["on"]), lambda x: x["v"])
        ends = F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["b"].alias("v"), F.coalesce(F.get(s, i + 1)["a"] <= x["b"], F.lit(False)).alias("on"))), lambda x: ~x["on"]), lambda x: x["v"])
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(let(by_hash, lambda s: F.array_sort(F.array_compact(again(s)))), runs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``, and n_lines, n_removed_chunks, n_removed_lines added.

    Every row stays; a text of which all lines go is empty, a null text stays
    null. Documents come in order of doc_id, null ids last; rows of equal ids
    (or without one) are documents of their own, in order of a hash of the text,
    and of equal rows one keeps its lines. Blank lines are removed only between
    lines of a chunk. Empty texts have one empty line. Columns named like the
    added ones are replaced; all others are carried over.
    """
    made = ("n_lines", "n_removed_chunks", "n_removed_lines")
    docs = docs.drop(*made)
    text, order = F.col(text_col).cast("string"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    twice = docs.select(order.alias("o")).groupBy("o").agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 or o = {(1 << 63) - 1}")
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    if twice.isEmpty():
        keyed = docs.select(order.alias("key"), row, text.alias("text"))
    else:
        keyed = cut(docs.select(F.struct(order.alias("o"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("no")).alias("key"), row, text.alias("text")))
    seen = keyed.select("key", F.explode(items(F.col("text"), True)).alias("x")).groupBy(F.col("x.h").alias("h"), F.col("x.bytes").alias("bytes")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    # a hash of two different lines would be ambiguous below: none of them goes
    repeated = cut(seen.groupBy("h").agg(F.min("first").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts")).where("texts = 1 and n > 1").select("h", "first"))
    light = keyed.select("key", F.explode(items(F.col("text"), False)).alias("x")).select("key", "x.h", "x.a", "x.b")
    marked = light.join(repeated, "h").groupBy("key").agg(F.collect_list(F.struct("h", "a", "b", (F.col("first") < F.col("key")).alias("early"))).alias("found"))
    joined = keyed.select("key", "row").join(marked, "key", "left")

    t = F.col("row")[text_col].cast("string")
    none = F.expr("cast(array() as array<struct<a: int, b: int>>)")
    judged = joined.select("row", _lines(t).alias("lines"), F.when(F.col("found").isNull(), none).otherwise(_cuts(F.col("found"))).alias("cuts"))
    # what stays: the lines before each cut and after the last one
    after = lambda i: F.coalesce(F.get("cuts", i - 1)["b"] + 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: F.slice("lines", after(i) + 1, F.greatest(F.lit(0), F.coalesce(F.get("cuts", i)["a"], F.size("lines")) - after(i))))
    kept = F.when(F.col("row")[text_col].isNotNull(), F.when(F.size("cuts") == 0, F.col("row")[text_col].cast("string")).otherwise(F.array_join(F.flatten(pieces), "\n")))
    gone = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + c["b"] - c["a"] + 1)
    columns = [(kept if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    return judged.select(*columns, F.size("lines").cast("long").alias("n_lines"), F.size("cuts").cast("long").alias("n_removed_chunks"), gone.alias("n_removed_lines"))
