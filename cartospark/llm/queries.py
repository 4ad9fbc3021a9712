"""One query per corpus operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversation_trie, embedding_dedup, fingerprints, html_extract, license_scan, line_dedup, mixing, ngram_join, quality, sentencepiece_codec, sharding, toxicity
from .common import scratch, table


def model_path() -> str:
    """Where the public tokenizer model lies; executors open it by this path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in four arrivals, compacted, and read back through the last manifest."""
    store = sharding.compacted(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), model_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_from(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "n_offending", "worst_sentence")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_chunks", "n_removed_lines")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_ngram_jaccard, op3_html_extract, op4_mixing, op5_fingerprints, op6_license_scan, op7_quality_rules, op8_sentencepiece, op9_toxicity, op10_line_dedup,
        op11_centroids, op12_prefix_trie, op13_embedding_dedup,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": "SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "op2_ngram_jaccard": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY ALL HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM met UNION SELECT b, a FROM met),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT sets.doc_id, len(s) AS n_shingles, (SELECT min(r) FROM reach WHERE v = sets.doc_id) AS component_id, (SELECT count(*) FROM edges WHERE a = sets.doc_id) AS n_links FROM sets""",
}


def _op7_sql() -> str:
    """Base measures and certified cutoffs in SQL, with the binomial tail from log-gamma."""
    risk, error = quality.RISK, quality.ALPHA
    share = {"symbols": "n_symbols / word_chars", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words", "shouts": "n_shouts / word_chars", "capitals": "n_capitals / word_chars", "long_words": "n_long / n_words"}
    shares = ", ".join(f"{quality.RULES[k]} * coalesce(CAST({v.split(' / ')[0]} AS DOUBLE) / nullif({v.split(' / ')[1]}, 0), 0.0e0) AS {k}" for k, v in share.items())
    cutoffs = ", ".join(f"({i}, {c}e0)" for i, c in enumerate(quality.CUTOFFS, 1))
    failed = ", ".join(f"CASE WHEN {k} > cutoff THEN '{k}' END" for k in quality.RULES)
    gone = lambda chars: f"length(t) - length(regexp_replace(t, '{chars}', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS pos, w FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(w[pos:pos + 4], ' ')) AS k FROM wins) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + o.o) AS n FROM twice, (SELECT unnest(range(5)) AS o) o GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
    SELECT d.doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {gone('[#*$%&|<>]')} AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words, {gone('[!?]')} AS n_shouts, {gone('[A-Z]')} AS n_capitals, len(list_filter(w, lambda x: length(x) > 25)) AS n_long
    FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {shares} FROM m),
good AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
c(cutoff_no, cutoff) AS (VALUES {cutoffs}),
scored AS (SELECT stratum, good, greatest({', '.join(quality.RULES)}) AS score FROM f JOIN good USING (doc_id) WHERE NOT base_failed),
grid AS (
    SELECT stratum, cutoff_no, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND score > cutoff) AS k, count(*) FILTER (good = 0 AND score > cutoff) AS caught
    FROM scored, c GROUP BY ALL),
tail AS (
    SELECT *, k <= n * {risk!r}e0 AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}e0) + (n - i) * ln(1 - {risk!r}e0))) FROM (SELECT unnest(range(k + 1)) AS i))
        <= {error}e0 / (SELECT count(DISTINCT stratum) FROM grid) AS passed FROM grid),
ok AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum ORDER BY cutoff_no) AS ok FROM tail),
best AS (SELECT stratum, cutoff FROM ok WHERE ok AND caught > k QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught - k DESC, cutoff_no) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND concat_ws(',', {failed}) = '' AS kept, concat_ws(',', {failed}) AS failed_rules FROM f LEFT JOIN best USING (stratum)"""


ORACLE_SQL["op7_quality_rules"] = _op7_sql()


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of assignment and exact floors of means, one after the other; distances in full."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    assign = lambda n: f"a{n} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min(x) AS x FROM (SELECT v.*, struct_pack(d := CAST({dist} AS BIGINT), k := k) AS x FROM v, c{n} c) GROUP BY r)"
    parts = []
    for n in range(rounds):
        parts += [
            assign(n),
            f"s{n} AS (SELECT x.k AS k, i, sum(q[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY x.k, i)",
            f"m{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{n} GROUP BY k)",
            f"c{n + 1} AS (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k)",
        ]
    return f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS k, q FROM v QUALIFY k < {k}),
{", ".join(parts)}, {assign(rounds)},
per AS (SELECT x.k AS k, CAST(sum(x.d) AS BIGINT) AS s FROM a{rounds} GROUP BY x.k)
SELECT vec_id, CAST(x.k AS INT) AS cluster, x.d AS distance, s AS cluster_inertia, CAST((SELECT sum(s) FROM per) AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN per ON per.k = x.k JOIN c{rounds} c ON c.k = x.k"""


ORACLE_SQL["op11_centroids"] = _op11_sql()

#: CRC-32 bit by bit, over the characters of a decimal number.
_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE_SQL["op12_prefix_trie"] = rf"""
WITH t AS (
    SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, t, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) AS pos FROM t),
convs AS (SELECT c, c - c % 20 AS b, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT convs.c, b, h, count(n.pos) AS k FROM convs LEFT JOIN n ON n.c = b AND n.pos <= h GROUP BY ALL),
again AS (SELECT k.c AS c, pos AS d, t, words FROM k JOIN n ON n.c = b AND pos <= h UNION ALL SELECT k.c, pos - h + k, t, words FROM k JOIN n ON n.c = k.c AND pos > h),
pre AS (SELECT c, d, words, string_agg(t, ',') OVER (PARTITION BY c ORDER BY d) AS key FROM again UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT key, min(c) AS c, max(d) AS d, count(*) AS n, max(words) AS words FROM pre GROUP BY key),
up AS (SELECT x.key, p.key AS above, p.c AS parent FROM nodes x JOIN pre ON pre.c = x.c AND pre.d = x.d - 1 JOIN nodes p ON p.key = pre.key),
kids AS (SELECT above AS key, count(*) AS n_children FROM up GROUP BY above),
below AS (
    SELECT pre.key, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum((x.n - 1) * x.words) AS saved FROM nodes x JOIN pre ON pre.c = x.c AND pre.d <= x.d LEFT JOIN kids ON kids.key = x.key GROUP BY pre.key),
ends AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM pre WHERE d = (SELECT max(d) FROM pre q WHERE q.c = pre.c) GROUP BY key)
SELECT nodes.c AS conv_id, CAST(nodes.d AS BIGINT) AS depth, parent AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN below USING (key) LEFT JOIN up USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key)"""

_COS = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) / (a.norm * b.norm)"

ORACLE_SQL["op13_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
sound AS (
    SELECT *, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v
    WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = len(x) AND len(list_filter(x, lambda y: y <> 0)) > 0),
pairs AS (SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r < b.r WHERE {_COS} >= 0.93),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(r, c) USING KEY (r) AS (SELECT r, vec_id FROM v UNION (SELECT edges.b, min(reach.c) FROM reach JOIN edges ON edges.a = reach.r JOIN recurring.reach o ON o.r = edges.b WHERE reach.c < o.c GROUP BY edges.b)),
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN reach USING (r) LEFT JOIN n ON n.a = v.r"""
