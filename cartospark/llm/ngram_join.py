"""N-gram Jaccard self-join: rare-first prefix filtering, exact at the threshold.

Steps, none of which gathers more than a bounded slice in one place:

1. ``shingled``: sizes of all sets, and shingles that are frequent in some task;
   the sums say how many buckets there must be, and which shingles are hot.
2. ``_postings``: each task hashes its texts' five-word shingles (one copy of
   equal texts) and packs them by hash bucket, so the shuffle moves a few large
   binary rows instead of one row per shingle. A hot shingle's postings are
   dealt over all buckets, as its frequency is known.
   ``_shared``: a bucket's task counts each other shingle's document frequency
   and sends back only the shingles that two or more different texts hold.
3. ``_survivors``: a text orders its shingles rare-first, by (frequency, hash).
   Shingles of its own come first; a text with more of them than the threshold
   allows can have no partner and is done. The others keep their shared
   shingles in that order, which is all that an intersection needs.
4. Candidates join on the shared part of the prefix, under the length,
   positional and suffix filters. Each text is first verified against one
   leader, the text with fewest own shingles among those that it meets. Where
   only components are asked for, all candidate pairs that lie in different
   components are verified then, each once; pairs inside a component cannot
   change it and are never listed. Where links are counted, every candidate
   pair is verified once but those that the distances to a common leader prove
   linked: these are counted and never listed (``counted_links``). Where many
   texts meet one another, their pairs are not listed either: such a crowd is
   cut into blocks, and a task counts the links between two of them (``_crowds``).

In the shuffles a shingle is its bucket and the upper 48 bits of its hash; that
is enough to tell the shingles of two texts apart (a false match takes a chance
of about |x| * |y| / 2^55), and sizes are counted on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import cut, partitions, small, small_batches, spread_join
from .components import components

K = 5
#: Jaccard of 0.8 as a ratio of whole numbers.
NUM, DEN = 80, 100
#: Shingles that a task packs before it sends them on, and hash classes of the suffix filter.
FLUSH, CLASSES = 1 << 21, 16
#: Postings that a bucket should hold; postings from which a shingle is hot, or this share of all if that is more, so that at most 1 / HOT_SHARE shingles are.
BUCKET, HOT, HOT_SHARE = 1 << 21, 1 << 17, 1 / 65_536
#: Steps in which distances to a leader are kept.
FAR = 10_000
#: Texts of a star from which it may be a crowd; texts that a block of a crowd should hold, texts and shingles that it holds at most, blocks of a crowd from which only these two count.
CROWD, BLOCK, BLOCK_MOST, BLOCK_SHINGLES, BLOCKS = 64, 128, 1 << 11, 1 << 22, 12
#: Shingles that a product of two blocks takes at a time.
WIDE = 1 << 10


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each text's word hashes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for first, data, offsets in hashing.slices(texts):
            h, at, _, _ = hashing.words(data, offsets)
            for i in range(len(offsets) - 1):
                yield batch, first + i, h[at[i] : at[i + 1]]


def _postings(n_buckets: int, hot: np.ndarray):
    def pack(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        size = np.array([len(s) for _, s in held], dtype=np.int32)
        key = np.array([k for k, _ in held], dtype=np.uint64)
        h = np.concatenate([s for _, s in held])
        of = np.repeat(np.arange(len(held), dtype=np.int32), size)
        bucket = (h % np.uint64(n_buckets)).astype(np.int32)
        is_hot = np.zeros(len(h), dtype=bool)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
            bucket[is_hot] = ((h[is_hot] ^ key[of[is_hot]]) % np.uint64(n_buckets)).astype(np.int32)
        slot = 2 * bucket.astype(np.int64) + is_hot
        order = np.argsort(slot, kind="stable")
        h, of, ends = h[order], of[order], np.searchsorted(slot[order], np.arange(2 * n_buckets + 1))
        rows: dict[str, list] = {"bucket": [], "hot": [], "keys": [], "sizes": [], "counts": [], "hashes": []}
        for b in np.flatnonzero(np.diff(ends)):
            lo, hi = ends[b], ends[b + 1]
            own, counts = np.unique(of[lo:hi], return_counts=True)
            rows["bucket"].append(int(b) // 2)
            rows["hot"].append(bool(b % 2))
            rows["keys"].append(key[own].tobytes())
            rows["sizes"].append(size[own].tobytes())
            rows["counts"].append(counts.astype(np.int32).tobytes())
            rows["hashes"].append(_short(h[lo:hi]))
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), *((c, pa.binary()) for c in ("keys", "sizes", "counts", "hashes"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for _, _, w in _texts(batches):
            if not len(w) or (key := hashing.sequence_key(w)) in seen:
                continue
            seen.add(key)
            held.append((key, np.unique(hashing.shingles(w, K))))
            n += len(held[-1][1])
            if n >= FLUSH:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return run


def _short(h: np.ndarray) -> bytes:
    """The upper six bytes of 64-bit hashes."""
    return h.astype("<u8").view("u1").reshape(-1, 8)[:, 2:].tobytes()


def _long(pdf: pd.DataFrame, low: int) -> np.ndarray:
    """Shingles as numbers again: six bytes of the hash, then the bucket (0 for hot ones, which are in all)."""
    raw = np.frombuffer(b"".join(pdf["hashes"]), dtype="u1").reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype="u1")
    out[:, 2:] = raw
    return out.view("<u8").reshape(-1) | np.uint64(low & 0xFFFF)


def _flat(pdf: pd.DataFrame, *columns: tuple[str, str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[c]), dtype=t) for c, t in columns]


def _shared(n_owners: int, hot: np.ndarray, hot_df: np.ndarray):
    """Of a bucket's postings, those of shingles in two texts or more, with the frequency, packed by the owner of the text."""

    def once(h: np.ndarray, of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings without repeats, by shingle and text."""
        order = np.lexsort((keys[of], h))
        h, of = h[order], of[order]
        k = keys[of]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        return h[new], of[new]

    def read(pdf: pd.DataFrame, low: int) -> tuple[np.ndarray, ...]:
        keys, sizes, counts = _flat(pdf, ("keys", "u8"), ("sizes", "i4"), ("counts", "i4"))
        return keys, sizes, _long(pdf, low), np.repeat(np.arange(len(keys), dtype=np.int64), counts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, h, of = read(pdf[~pdf["hot"]], int(pdf["bucket"].iloc[0]))
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        near = np.zeros(len(h), dtype=bool)  # a cheap first look: equal to a neighbour
        same = h[1:] == h[:-1]
        near[1:] |= same
        near[:-1] |= same
        h, of = once(h[near], of[near], keys)
        _, at, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[at]
        h, of, df = h[df > 1], of[df > 1], df[df > 1]
        if pdf["hot"].any():
            more_keys, more_sizes, more_h, more_of = read(pdf[pdf["hot"]], 0)
            more_h, more_of = once(more_h, more_of, more_keys)
            known = hot_df[np.searchsorted(hot >> np.uint64(16), more_h >> np.uint64(16))]
            h, of, df = np.concatenate([h, more_h]), np.concatenate([of, more_of + len(keys)]), np.concatenate([df, known])
            keys, sizes = np.concatenate([keys, more_keys]), np.concatenate([sizes, more_sizes])
        df = np.minimum(df, 2**31 - 1).astype(np.int32)
        owner = (keys[of] % np.uint64(n_owners)).astype(np.int64)
        order = np.lexsort((of, owner))
        h, of, df, ends = h[order], of[order], df[order], np.searchsorted(owner[order], np.arange(n_owners + 1))
        rows: dict[str, list] = {c: [] for c in ("owner", "keys", "sizes", "counts", "hashes", "dfs")}
        for w in np.flatnonzero(np.diff(ends)):
            lo, hi = ends[w], ends[w + 1]
            own, n = np.unique(of[lo:hi], return_counts=True)
            for c, v in zip(rows, (int(w), keys[own].tobytes(), sizes[own].tobytes(), n.astype(np.int32).tobytes(), h[lo:hi].tobytes(), df[lo:hi].tobytes()), strict=True):
                rows[c].append(v)
        return pd.DataFrame(rows) if rows["keys"] else pd.DataFrame()

    return run


def _survivors(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, counts, h, df = _flat(pdf, ("keys", "u8"), ("sizes", "i4"), ("counts", "i4"), ("hashes", "u8"), ("dfs", "i4"))
        of = np.repeat(np.arange(len(keys)), counts)
        k = keys[of]
        size = sizes[of]
        order = np.lexsort((h, df, k))
        k, h, size = k[order], h[order], size[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
        n, s = size[first].astype(np.int64), np.diff(np.r_[first, len(k)])
        need = -(-n * num // den)
        rows: dict[str, list] = {c: [] for c in ("key", "n", "own", "pre", "toks", "classes")}
        for i in np.flatnonzero(s >= need):
            toks = h[first[i] : first[i] + s[i]]
            own = int(n[i] - s[i])
            rows["key"].append(k[first[i]].astype(np.int64))
            rows["n"].append(int(n[i]))
            rows["own"].append(own)
            rows["pre"].append(int(n[i] - need[i] + 1) - own)
            rows["toks"].append(toks.astype(np.int64))
            rows["classes"].append(np.bincount((toks >> np.uint64(60)).astype(np.int64), minlength=CLASSES).astype(np.int32))
        return pd.DataFrame(rows) if rows["key"] else pd.DataFrame()

    return run


def shingled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n, often): a hash of the text's words, null without words, and the size of its shingle set; with ``often``, key is a shingle that n texts of a task's FLUSH shingles hold, the frequent ones only."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("often", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pool: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            rows = list(held)
            if pool:
                h, n = np.unique(np.concatenate(pool), return_counts=True)
                often = n >= max(8, FLUSH >> 15)
                rows += [(None, k, c, True) for k, c in zip(h[often].astype(np.int64).tolist(), n[often].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch, i, w in _texts(batches):
            s = np.unique(hashing.shingles(w, K))
            held.append((batch.column(0)[i].as_py(), int(np.uint64(hashing.sequence_key(w)).astype(np.int64)) if len(w) else None, len(s), False))
            pool.append(s)
            size += len(s)
            if len(held) >= 10_000 or size >= FLUSH:
                yield sent()
                held, pool, size = [], [], 0
        if held:
            yield sent()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, key long, n long, often boolean")


def _possible(x: str, y: str, num: int, den: int) -> Column:
    """Length, positional and suffix filters on a pair that meets at a prefix shingle: what is left can still reach the threshold."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    most = F.least(n - F.col(f"{x}pos"), m - F.col(f"{y}pos"))
    suffix = F.aggregate(F.zip_with(f"{x}classes", f"{y}classes", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    enough = num * (n + m)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (most * (num + den) >= enough) & (suffix * (num + den) >= enough)


def _links(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Verify each pair (a, b) once on the whole sets; (a, b, linked, far), far being the Jaccard distance in parts of FAR, rounded up."""
    side = lambda c: texts.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("toks").alias(f"t{c}"))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.col("na") + F.col("nb")).alias("sum"))
    far = F.expr(f"({FAR} * (sum - 2 * both) + sum - both - 1) div (sum - both)").cast("int")
    return rows.select("a", "b", (F.col("both") * (num + den) >= F.col("sum") * num).alias("linked"), far.alias("far"))


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _led(docs: DataFrame, base: DataFrame, text_col: str, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts that may have a partner, their prefix postings, (key, lead) of texts that meet others, and the verified pairs of these two."""
    spark = docs.sparkSession
    small_batches(spark)
    total = base.where("not often").agg(F.sum("n")).first()[0] or 0
    hot = base.where("often").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT, total * HOT_SHARE)).collect()  # at most 1 / HOT_SHARE rows
    tops = {}
    for r in hot:  # of two with the same six upper bytes, which is how they travel, the more frequent
        h = np.uint64(r["key"] & (2**64 - 1))
        tops[int(h) >> 16] = max(tops.get(int(h) >> 16, (0, 0)), (r["n"], int(h)))
    hot_h = np.array([tops[k][1] for k in sorted(tops)], dtype=np.uint64)
    hot_df = np.array([tops[k][0] for k in sorted(tops)], dtype=np.int64)
    n_buckets, n_owners = max(2 * partitions(spark), -(-total // BUCKET)), max(partitions(spark), -(-total // BUCKET))
    packed = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_postings(n_buckets, hot_h), "bucket int, hot boolean, keys binary, sizes binary, counts binary, hashes binary")
    shared = packed.groupBy("bucket").applyInPandas(_shared(n_owners, hot_h, hot_df), "owner int, keys binary, sizes binary, counts binary, hashes binary, dfs binary")
    texts = cut(shared.groupBy("owner").applyInPandas(_survivors(num, den), "key long, n long, own long, pre int, toks array<long>, classes array<int>"))

    posts = texts.select("key", "n", "own", "classes", F.posexplode(F.slice("toks", 1, F.col("pre")))).select("key", "n", "own", "classes", (F.col("own") + F.col("pos")).alias("pos"), F.col("col").alias("h"))
    posts = cut(posts)
    lead = posts.groupBy("h").agg(F.min(F.struct("own", "key", "n", "pos", "classes")).alias("l"), F.count(F.lit(1)).alias("met")).where("met > 1")
    lead = lead.select("h", *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("own", "key", "n", "pos", "classes")))
    met = posts.join(lead, "h").where(F.col("key") != F.col("l_key")).where(_possible("", "l_", num, den))
    first = met.groupBy("key").agg(F.min(F.struct("l_own", "l_key")).alias("l")).select("key", F.col("l.l_key").alias("lead"))
    first = cut(first)
    tried = cut(_links(first.select(*_pair("key", "lead")).distinct(), texts, num, den))
    return texts, posts, first, tried


def linked_texts(docs: DataFrame, base: DataFrame, text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """(v, root): the component of every text that has a link to a different text; ``base`` is what shingled() gives."""
    texts, posts, _, tried = _led(docs, base, text_col, num, den)
    comps = components(tried.where("linked"))

    placed = posts.join(comps.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = placed.groupBy("h", "root").count().groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("h", "major")
    placed = cut(placed.join(mixed, "h"))
    x = placed.where("root <> major").select("h", *(F.col(c).alias(f"x_{c}") for c in ("key", "n", "pos", "classes", "root")))
    y = placed.select("h", *(F.col(c).alias(f"y_{c}") for c in ("key", "n", "pos", "classes", "root")))
    more = x.join(y, (x.h == y.h) & (F.col("x_root") != F.col("y_root")) & _possible("x_", "y_", num, den))
    more = more.select(*_pair("x_key", "y_key")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    found = cut(_links(more, texts, num, den).where("linked"))
    return components(tried.where("linked").select("a", "b").unionByName(found.select("a", "b")))


def _crowds(per_star: DataFrame, stars: DataFrame) -> DataFrame:
    """(star, crowd): stars whose pairs are counted block by block; ``per_star`` has (h, star, n) for each prefix shingle.

    A star of CROWD texts or more is a crowd if its pairs meet once at two
    prefix shingles at most, so that the blocks never compare many more pairs than a join
    would list. A smaller star or single text joins the crowd that is the
    largest at its shingles if half of their pairs meet.
    """
    sizes = stars.groupBy("star").agg(F.count(F.lit(1)).alias("g"))
    met = per_star.groupBy("star").agg(F.sum(F.col("n") * F.col("n")).alias("met"))
    seeds = cut(met.join(sizes.where(F.col("g") >= CROWD), "star").where("2 * met >= g * g").select(F.col("star").alias("seed"), F.col("g").alias("g_seed")))
    n_seeds = seeds.count()
    top = per_star.where(F.col("n") >= CROWD // 4).groupBy("h").agg(F.max(F.struct("n", "star")).alias("t")).select("h", F.col("t.n").alias("m"), F.col("t.star").alias("seed"))
    pull = per_star.join(top, "h").where("star <> seed").groupBy("star", "seed").agg(F.sum(F.col("n") * F.col("m")).alias("met")).join(small(seeds, n_seeds), "seed")
    pull = pull.join(sizes, "star", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    pull = pull.where("2 * met >= g * g_seed and (g < g_seed or g = g_seed and star < seed)")
    to = cut(pull.groupBy("star").agg(F.max_by("seed", F.struct("met", "seed")).alias("to")))
    on = to.select(F.col("star").alias("to"), F.col("to").alias("on"))
    named = to.join(small(on.join(small(seeds.select(F.col("seed").alias("to")), n_seeds), "to", "left_semi"), n_seeds), "to", "left").select("star", F.coalesce("on", "to").alias("crowd"))
    return cut(named.unionByName(seeds.select(F.col("seed").alias("star"), F.col("seed").alias("crowd")).join(to, "star", "left_anti")))


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's texts in one row."""
    toks = [np.asarray(t, dtype="<i8") for t in pdf["toks"]]
    packed = {c: [pdf[c].to_numpy().astype("<i8").tobytes()] for c in ("key", "star", "n", "n_copies")}
    return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("crowd", "block", "blocks")} | packed | {"counts": [np.array([len(t) for t in toks], dtype="<i8").tobytes()], "toks": [np.concatenate(toks).tobytes()]})


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``, given their sizes and elements: products of 0-1 matrices, WIDE elements at a time."""
    both = np.zeros((len(a[0]), len(b[0])))
    shared = np.intersect1d(a[1], b[1])
    sides = []
    for counts, toks in (a, b):
        of = np.repeat(np.arange(len(counts)), counts)
        at = np.minimum(np.searchsorted(shared, toks), max(len(shared) - 1, 0))
        here = shared[at] == toks if len(shared) else np.zeros(len(toks), dtype=bool)
        of, at = of[here], at[here]
        order = np.argsort(at, kind="stable")
        sides.append((of[order], at[order], len(counts)))
    for lo in range(0, len(shared), WIDE):
        parts = []
        for of, at, n in sides:
            i, j = np.searchsorted(at, (lo, lo + WIDE))
            part = np.zeros((n, min(WIDE, len(shared) - lo)), dtype=np.float32)
            part[of[i:j], at[i:j] - lo] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both.astype(np.int64)


def _block_links(num: int, den: int):
    """(key, others, to): links of the texts of two blocks (or of one with itself), weighted by copies; and edges (key, to) that hang together what links hang together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for _, row in pdf.iterrows():
            key, star, n, copies, counts, toks = (np.frombuffer(row[c], dtype="<i8") for c in ("key", "star", "n", "n_copies", "counts", "toks"))
            sides.append((key, star, n, copies, (counts, toks)))
        alone = len(sides) == 1
        a, b = sides[0], sides[-1]
        linked = _common(a[4], b[4]) * (num + den) >= (a[2][:, None] + b[2][None, :]) * num
        if alone:
            np.fill_diagonal(linked, False)
        keys, others = [a[0]], [linked @ a[3] if alone else linked @ b[3]]
        if not alone:
            keys.append(b[0])
            others.append(a[3] @ linked)
        names, at = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
        at_a, at_b = at[: len(a[1])], at[len(a[1]) :]
        least = np.arange(len(names))
        while True:  # the smallest star that a star's links lead to
            before = least.copy()
            np.minimum.at(least, at_a, np.where(linked, before[at_b][None, :], len(names)).min(axis=1))
            np.minimum.at(least, at_b, np.where(linked, before[at_a][:, None], len(names)).min(axis=0))
            if (least == before).all():
                break
        moved = np.flatnonzero(least != np.arange(len(names)))
        key, n = np.concatenate([*keys, names[moved]]), len(moved)
        return pd.DataFrame({"key": key, "others": pd.array([*np.concatenate(others).tolist(), *[None] * n], dtype="Int64"), "to": pd.array([*[None] * (len(key) - n), *names[least[moved]].tolist()], dtype="Int64")})

    return run


def _crowd_links(members: DataFrame, texts: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """(key, others, to) as _block_links() gives them, for all pairs of blocks of each crowd; ``members`` has (key, star, crowd)."""
    rows = members.join(texts.select("key", "n", "toks"), "key").join(copies.select("key", "n_copies"), "key")
    sizes = cut(rows.groupBy("crowd").agg(F.count(F.lit(1)).alias("g"), F.sum(F.size("toks")).alias("t")))
    parts = lambda x, most: F.ceil(F.col(x) / most)
    blocks = F.greatest(F.least(parts("g", BLOCK), F.lit(BLOCKS)), parts("g", BLOCK_MOST), parts("t", BLOCK_SHINGLES)).cast("int")
    rows = rows.join(small(sizes.select("crowd", blocks.alias("blocks")), sizes.count()), "crowd").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    packed = rows.groupBy("crowd", "block").applyInPandas(_packed, "crowd long, block int, blocks int, key binary, star binary, n binary, n_copies binary, counts binary, toks binary")
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return cut(pairs.groupBy("crowd", "lo", "hi").applyInPandas(_block_links(num, den), "key long, others long, to long"))


def counted_links(docs: DataFrame, base: DataFrame, copies: DataFrame, text_col: str = "text", num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(v, root) as linked_texts(), and (key, others): documents with a different text that link with text ``key``; ``copies`` has key and n_copies.

    A text that links with its leader stands in the leader's star, at a known
    distance. Two texts of a star whose distances add up to the threshold at
    most are linked, by the triangle inequality; they are counted from the
    star's histogram of distances (at most FAR steps) and never listed. Pairs
    inside a crowd are counted block by block. Every other candidate pair is
    verified.
    """
    texts, posts, first, tried = _led(docs, base, text_col, num, den)
    limit = FAR * (den - num) // den
    led = cut(first.select("key", "lead", *_pair("key", "lead")).join(tried.where("linked"), ["a", "b"]).select("key", "lead", "far"))
    rows = led.count()
    centers = led.select("lead").distinct().join(led.select(F.col("key").alias("lead")), "lead", "left_anti").withColumn("center", F.lit(True))
    stars = spread_join(led, cut(centers), "lead", rows).where("center").select("key", F.col("lead").alias("star"), "far")
    stars = cut(stars.unionByName(centers.select(F.col("lead").alias("key"), F.col("lead").alias("star"), F.lit(0).alias("far"))))

    alone = [F.coalesce("star", "key").alias("star"), F.coalesce("far", F.lit(0)).alias("far")]
    units = cut(texts.select("key").join(stars, "key", "left").select("key", *alone))
    near = (2 * F.col("far") <= limit).cast("long")
    per_star = cut(posts.select("key", "h").join(units, "key").groupBy("h", "star").agg(F.count(F.lit(1)).alias("n"), F.sum(near).alias("near")))
    crowds = _crowds(per_star, stars)
    units = cut(spread_join(units, crowds, "star", units.count()))
    blocks = _crowd_links(units.where("crowd is not null").select("key", "star", "crowd"), texts, copies, num, den)

    units = units.select("key", F.coalesce("crowd", "star").alias("star"), F.when(F.col("crowd").isNull(), F.col("far")).otherwise(0).alias("far"))
    placed = posts.join(units, "key")
    per_star = placed.groupBy("h", "star").agg(F.count(F.lit(1)).alias("n"), F.sum(near).alias("near"))
    mixed = per_star.groupBy("h").agg(F.max_by("star", F.struct("near", "star")).alias("major"), F.max("near").alias("near"), F.sum("n").alias("n")).where("n > 1 and n > near").select("h", "major")
    placed = cut(placed.join(mixed, "h").withColumn("inside", (F.col("star") == F.col("major")) & (near == 1)))
    names = ("key", "n", "pos", "classes", "star", "far", "inside")
    x = placed.where("not inside").select("h", *(F.col(c).alias(f"x_{c}") for c in names))
    y = placed.select("h", *(F.col(c).alias(f"y_{c}") for c in names))
    open_ = (F.col("x_star") != F.col("y_star")) | (F.col("x_far") + F.col("y_far") > limit)
    more = x.join(y, (x.h == y.h) & (F.col("y_inside") | (F.col("x_key") < F.col("y_key"))) & open_ & _possible("x_", "y_", num, den))
    found = cut(_links(more.select(*_pair("x_key", "y_key")).distinct(), texts, num, den).where("linked").select("a", "b"))
    roots = components(tried.where("linked").select("a", "b").unionByName(found).unionByName(blocks.where("to is not null").select(F.col("key").alias("a"), F.col("to").alias("b"))))

    ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.col("a").alias("other")))).alias("e")).select("e.*")
    listed = ends.join(copies.select(F.col("key").alias("other"), "n_copies"), "other").groupBy("key").agg(F.sum("n_copies").alias("others"))
    members = cut(stars.join(crowds, "star", "left_anti").join(copies.select("key", "n_copies"), "key").withColumn("cell", F.struct("star", "far")))
    cells = members.groupBy("star", "far").agg(F.sum("n_copies").alias("w")).groupBy("star").agg(F.collect_list(F.struct("far", "w")).alias("all"))
    reach = cells.select("star", "all", F.explode("all").alias("c"))
    reach = reach.select(F.struct(F.col("star"), F.col("c.far").alias("far")).alias("cell"), F.aggregate("all", F.lit(0).cast("long"), lambda s, y: s + F.when(y["far"] + F.col("c.far") <= limit, y["w"]).otherwise(0)).alias("reach"))
    certain = spread_join(members, cut(reach), "cell", rows).select("key", (F.col("reach") - F.when(2 * F.col("far") <= limit, F.col("n_copies")).otherwise(0)).alias("others"))
    return roots, cut(listed.unionByName(certain).unionByName(blocks.where("to is null").select("key", "others")).groupBy("key").agg(F.sum("others").alias("others")))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_copies, and with ``links`` n_links.

    Two documents link when ``den * |intersection| >= num * |union|`` of their
    sets of distinct five-word shingles (A-Z lower-cased; shorter texts are one
    shingle). component_id is the smallest doc_id reachable over links, the
    document itself included; n_copies counts the documents with its very words,
    n_links the other documents that it links with, copies among them.

    Null, empty and blank texts have no shingles, link with nothing and are
    their own component. Equal texts are one text until the end, whatever their
    number. A repeated doc_id keeps its rows; a null doc_id is kept and never
    names a component unless no other id is there. Other columns are ignored.
    Shingles and texts are compared by 64-bit hashes.
    """
    base = cut(shingled(docs, id_col, text_col))
    rows = base.where("not often").count()
    copies = base.where("not often and key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first"))
    if links:
        copies = cut(copies)
        roots, others = counted_links(docs, base, copies, text_col, num, den)
        copies = copies.join(others, "key", "left").withColumn("n_links", F.col("n_copies") - 1 + F.coalesce("others", F.lit(0)))
    else:
        roots = linked_texts(docs, base, text_col, num, den)
    more = ["n_links"] if links else []
    base = base.where("not often").drop("often")
    texts = cut(copies.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    named = cut(texts.groupBy("root").agg(F.min("first").alias("least")))
    texts = cut(spread_join(texts, named, "root", rows).select("key", "least", "n_copies", *more))
    out = spread_join(base, texts, "key", rows)
    counts = [F.coalesce(c, F.lit(d)).cast("long").alias(c) for c, d in (("n_copies", 1), ("n_links", 0)) if c != "n_links" or links]
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), *counts)
