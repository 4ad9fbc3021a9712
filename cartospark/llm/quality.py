"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Fixed base rules reject outright. The method's own rules each measure a share
of a document, scaled so that equal values are about equally bad, and the
largest of them is the document's score. A document is rejected when its score
is above its stratum's cutoff, by the rules whose values are. The cutoffs come
from labelled documents: per stratum (language) the CUTOFFS are tested from the
loosest to stricter ones, each by the exact binomial test of "more than RISK of
the good documents would be rejected". Testing stops at the first that fails,
so a stratum's chain needs no correction within itself, and as one test speaks
for all rules together, none is needed between rules; the error ALPHA is
divided by the number of strata (Bonferroni). Of the certified cutoffs the one
that rejects most bad documents net of good ones is used, the loosest of
equals; a stratum without one has base rules only. With probability 1 - ALPHA
no stratum's cutoff rejects more than RISK of its good documents.

Everything is DataFrame functions; the binomial tail is summed in logarithms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, WORD, cut, let, small, without

#: Largest share of a stratum's good documents that its cutoff may reject, and the chance of failing that in any stratum.
RISK, ALPHA = 0.02, 0.05
#: Rules and the scale of each: the share is multiplied by it.
RULES = {"symbols": 5, "dup_lines": 1, "repeats": 1, "shouts": 2, "capitals": 1, "long_words": 2}
#: Cutoffs tested, from loose to strict.
CUTOFFS = tuple(round(1 - i / 20, 2) for i in range(1, 20)) + (0.04, 0.03, 0.02, 0.01)
SYMBOLS = "#*$%&|<>"


def measures(text: Column) -> dict[str, Column]:
    """Base measures of a text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_shouts, n_capitals, n_long."""
    t = F.coalesce(text, F.lit(""))
    lost = lambda c, chars: (F.length(c) - F.length(without(c, chars))).cast("long")
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeats(w).alias("r"), F.size(F.filter(w, lambda x: F.length(x) > 25)).cast("long").alias("l"))),
        "word_chars": F.length(without(t, BLANKS)).cast("long"),
        "n_symbols": lost(t, SYMBOLS),
        "n_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
        "n_shouts": lost(t, "!?"),
        "n_capitals": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
    }


def _repeats(words: Column) -> Column:
    """Words in five-word windows that a text holds twice or more."""

    def covered(win: Column) -> Column:
        at = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(at, lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("d"))), lambda x: x["d"]), lambda x: x["i"]))
        total = let(F.array_sort(twice), lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))), F.lit(0), lambda s, x: s + x))
        return total.cast("long")

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win))))
    return F.when(F.size(words) < 5, F.lit(0).cast("long")).otherwise(some)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, the base measures, base_failed and one share per rule."""
    m = measures(F.col(text_col).cast("string"))
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    raw = docs.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), *(c.alias(k) for k, c in m.items()))
    n, r, d = F.col("n_words.n"), F.col("n_words.r"), F.col("n_lines.d")
    share = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    chars = F.col("word_chars")
    rules = {
        "symbols": share(F.col("n_symbols"), chars), "dup_lines": share(d, F.col("n_lines.n")), "repeats": share(r, n),
        "shouts": share(F.col("n_shouts"), chars), "capitals": share(F.col("n_capitals"), chars), "long_words": share(F.col("n_words.l"), n),
    }
    return raw.select(
        *(f"_{c}" for c in keep), "doc_id", "stratum", n.alias("n_words"), "word_chars", "n_symbols", d.alias("n_dup_lines"), r.alias("n_repeat_words"),
        ((n < 10) | (100 * r > 20 * n)).alias("base_failed"), *(rules[k].alias(k) for k in RULES),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p), for k at most n * p, summed from logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("l"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        up = acc["l"] + F.log((n - i + 1).cast("double") / i.cast("double")) + odds
        return F.struct(up.alias("l"), (acc["s"] + F.exp(up)).alias("s"))

    return F.when(k < 1, start["s"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step)["s"])


def score() -> Column:
    """The largest scaled share."""
    return F.greatest(*(F.col(k) * n for k, n in RULES.items()))


def thresholds(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, cutoff, n, lost, caught) from labelled documents that the base rules keep: the certified cutoff, good documents, and good and bad ones that it rejects.

    Labels other than 0 and 1, and null ids, are left out; of several labels of
    a document the lowest counts.
    """
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    # the number of cutoffs below a score: those reject it
    under = F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: c < F.col("score")))
    rows = feats.where("not base_failed").select("doc_id", "stratum", score().alias("score")).join(good, "doc_id").select("stratum", "good", under.alias("under"))
    counts = rows.groupBy("stratum", "under").agg(F.count_if(F.col("good") == 1).alias("g"), F.count_if(F.col("good") == 0).alias("b"))
    chain = Window.partitionBy("stratum").orderBy("cutoff_no")
    grid = counts.groupBy("stratum").agg(F.sum("g").alias("n"), F.collect_list(F.struct("under", "g", "b")).alias("bins")).withColumn("cutoff_no", F.explode(F.sequence(F.lit(1), F.lit(len(CUTOFFS)))))
    # cutoff j (from 1, loose first) rejects a score that more than len - j cutoffs are below
    hit = lambda f: F.aggregate(F.filter("bins", lambda b: b["under"] > F.lit(len(CUTOFFS)) - F.col("cutoff_no")), F.lit(0).cast("long"), lambda s, b: s + b[f])
    grid = grid.select("stratum", "n", "cutoff_no", hit("g").alias("lost"), hit("b").alias("caught"), F.element_at(F.array(*map(F.lit, CUTOFFS)), F.col("cutoff_no")).alias("cutoff"))
    grid = grid.crossJoin(F.broadcast(grid.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))))
    passed = (F.col("lost") <= F.col("n") * RISK) & (binomial_tail(F.col("lost"), F.col("n"), RISK) <= ALPHA / F.col("strata"))
    certified = grid.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("ok", F.min("passed").over(chain)).where("ok and caught > lost")
    return certified.groupBy("stratum").agg(F.max_by(F.struct("cutoff", "n", "lost", "caught"), F.struct(F.col("caught") - F.col("lost"), -F.col("cutoff_no"))).alias("best")).select("stratum", "best.*")


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base measures, base_failed, kept and failed_rules (array of rule names).

    A base rule fails a text of fewer than 10 words, or with more than 20 % of
    its words in five-word windows that it holds twice. ``kept`` is false then,
    else the verdict of the certified cutoffs. Null and empty texts have no
    words and fail. Null strata are one stratum, ids may be null or repeat,
    without labels only the base rules reject; ``keep`` names columns to carry
    over (as ``_<name>``), others are ignored. Every text is measured once.
    """
    feats = cut(features(docs, id_col, text_col, stratum_col, keep))
    limits = cut(thresholds(feats, labels).select("stratum", "cutoff"))
    joined = feats.join(small(limits, limits.count()), "stratum", "left")
    failed = F.array_compact(F.array(*(F.when(F.col(k) * n > F.col("cutoff"), F.lit(k)) for k, n in RULES.items())))
    return joined.select(*(f"_{c}" for c in keep), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
