"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles. Two
sketches merge by keeping the k smallest of their union, so parts of a text (or
of a corpus) may be sketched apart. The k smallest hashes of a union are a
uniform sample of it, which gives resemblance, containment and the number of
distinct shingles. As text a sketch is ``<k>:<base64 of big-endian hashes>``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import partitions, small_batches

K = 128


def sketch(h: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(h) > 4 * k:  # most hashes are far above the k smallest
        m = min(len(h) - 1, 3 * k)
        few = np.unique(np.partition(h, m)[: m + 1])
        if len(few) >= k:
            return few[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; two empty sets are alike (1), an empty and another are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty set is contained (1)."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return float(min(1.0, resemblance(a, b, k) * union / distinct(a, k))) if len(b) else 0.0


def to_text(a: np.ndarray, k: int = K) -> str:
    return f"{k}:" + base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s.split(":", 1)[1]), dtype=">u8").astype("u8")


def sketches(texts: list[str | None], k: int = K) -> list[np.ndarray]:
    """Sketches of whole texts."""
    out = []
    for _, data, offsets in hashing.slices(pa.array(texts, pa.large_string())):
        h, at, _, _ = hashing.words(data, offsets)
        out += [sketch(hashing.shingles(h[at[i] : at[i + 1]]), k) for i in range(len(offsets) - 1)]
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_chars, n_shingles, fingerprint) of every row; null texts are empty and have the empty sketch."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            made = sketches(pdf["text"].tolist(), k)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["text"].str.len().fillna(0).astype("int64"), "n_shingles": [distinct(a, k) for a in made], "fingerprint": [to_text(a, k) for a in made]})

    small_batches(docs.sparkSession, 256)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, n_chars long, n_shingles double, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, part, donor), each ``part`` in one task and sorted by descending doc_id.

    Parts are ranges of doc_id between quantiles. The first row of a part goes
    to the part before it as well, as a ``donor``: the successor of that part's
    last row. The first row of all goes to the last part. Null ids come last, in
    parts of their own by ranges of their texts' hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = 2 * partitions(docs.sparkSession)
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts), reverse=True)  # at most n numbers: descending lower bounds
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    falling = n - 1 - F.floor((F.shiftright(F.xxhash64("text"), 32) + (1 << 31)) * n / (1 << 32))
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + falling).otherwise(F.size(F.filter(bounds, lambda c: c > F.col("doc_id"))) if cuts else 0)
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"))
    placed = rows.withColumn("part", part.cast("int"))
    heads = placed.groupBy("part").agg(F.max(order).alias("top")).collect()  # a row for each part
    tops = {r["part"]: (r["top"][0], r["top"][1]) for r in heads}
    filled = sorted(tops)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    also = F.lit(None).cast("int")
    if filled:
        tops_map = F.create_map(*(x for p in filled for x in (F.lit(p), F.struct(F.lit(tops[p][0]), F.lit(tops[p][1])))))
        befores = F.create_map(*(x for p in filled for x in (F.lit(p), F.lit(before[p]))))
        also = F.when(F.element_at(tops_map, F.col("part")) == order, F.element_at(befores, F.col("part")))
    sent = placed.withColumn("to", F.explode(F.array_compact(F.array(F.struct("part", F.lit(False).alias("donor")), F.when(also.isNotNull(), F.struct(also.alias("part"), F.lit(True).alias("donor")))))))
    sent = sent.select("doc_id", "text", F.col("to.part").alias("part"), F.col("to.donor").alias("donor"))
    return sent.repartitionByRange(n, "part").sortWithinPartitions("part", "donor", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them with each other and the next text.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's, in descending order of
    doc_id; the first document follows the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_shingles (estimated). Null texts are empty. Equal ids order by a hash of
    the text; null ids come last; a sole document is its own successor. Other
    columns are ignored.
    """

    def pairs(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, str, str]]:
        held = None
        for pdf in pdfs:
            ids = pdf["doc_id"].tolist()
            for i, text, part, donor in zip(ids, pdf["text"].tolist(), pdf["part"].tolist(), pdf["donor"].tolist(), strict=True):
                if held is not None and held[2] == part:
                    yield held[0], held[1], text
                held = None if donor else (None if pd.isna(i) else int(i), text, part)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(rows: list[tuple[int | None, str, str]]) -> pd.DataFrame:
            texts, nexts = [r[1] for r in rows], [r[2] for r in rows]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
            a, b = sketches(texts, k), sketches(edited, k)
            # the next text is the next row's own text, but after the last row
            c = a[1:] + sketches(nexts[-1:], k)
            c = [x if nexts[i] is texts[i + 1] else None for i, x in enumerate(c[:-1])] + c[-1:]
            again = [i for i, x in enumerate(c) if x is None]
            for i, x in zip(again, sketches([nexts[i] for i in again], k), strict=True):
                c[i] = x
            return pd.DataFrame({
                "doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": [to_text(x, k) for x in a], "edited_fingerprint": [to_text(x, k) for x in b],
                "near_edited": [resemblance(x, y, k) for x, y in zip(a, b, strict=True)], "near_next": [resemblance(x, y, k) for x, y in zip(a, c, strict=True)],
                "n_shingles": [distinct(x, k) for x in a],
            })

        rows, size = [], 0
        for row in pairs(pdfs):
            rows.append(row)
            size += len(row[1])
            if size > hashing.SLICE or len(rows) >= 512:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)

    small_batches(docs.sparkSession, 256)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return in_order(docs, id_col, text_col).mapInPandas(run, schema)
