"""Sharding, mixing, HTML extraction and the pipeline."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute
from test_text_operators import base, dedup_plain

import corpus_pipeline
from cartospark.llm import html_extract, mixing, quality, sharding
from cartospark.llm.common import scratch

SF = "/root/testdata/sf0.001"


# --- sharding


def test_shards(spark, docs, odd):
    d = docs(odd)
    store = sharding.compacted(d, scratch(spark, "s"), arrivals=3)
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, d.collect()))
    store.append(docs([(77, "later")]))
    before = store.manifest()
    after = store.compact()
    assert len(after.shards) < len(before.shards) and store.read().count() == len(odd) + 1
    assert store.read(before.version).count() == len(odd) + 1  # its files are still there
    assert store.vacuum() == 0 and store.vacuum(older_than=0) > 0 and store.read().where("doc_id = 77").count() == 1
    with pytest.raises(sharding.Conflict):
        store.commit(sharding.Manifest(after.version, after.schema, []))


def test_writers_that_lose_try_again(spark, docs, monkeypatch):
    """Two writers at one version: appends and merges end up in one line of versions, without a row lost or doubled."""
    root = scratch(spark, "w")
    a, b = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    a.append(docs([(1, "one")]))
    a.append(docs([(2, "two")]))
    stale, real = a.manifest(), a.manifest
    b.append(docs([(3, "three")]))
    seen = iter([stale])
    monkeypatch.setattr(a, "manifest", lambda v=None: next(seen, None) or real(v))
    a.append(docs([(4, "four")]))
    assert sorted(r["doc_id"] for r in a.read().collect()) == [1, 2, 3, 4] and a.versions() == [1, 2, 3, 4]
    b.compact()
    seen = iter([stale])  # a merges files that b has merged already
    a.compact()
    assert sorted(r["doc_id"] for r in b.read().collect()) == [1, 2, 3, 4]
    clash = spark.createDataFrame([(1, 2, 3)], "doc_id long, arrival long, arrival_ long")
    assert [tuple(r) for r in sharding.compacted(clash, scratch(spark, "w")).read().collect()] == [(1, 2, 3)]


def test_tiers():
    s = sharding.ShardStore.__new__(sharding.ShardStore)
    s.target = 64
    assert [s.tier(x) for x in (64, 32, 31, 8, 7, 1)] == [0, 0, 1, 1, 2, 3]
    m = sharding.Manifest(1, "", [sharding.Shard(f"f{i}", b) for i, b in enumerate((64, 20, 20, 5, 1))])
    assert [[x.bytes for x in run] for run in s.plan(m)] == [[20, 20]]


def test_a_merge_keeps_tiers_apart(spark, docs):
    """Two large files and two small ones become one of each, in one commit."""
    store = sharding.ShardStore(spark, scratch(spark, "t"), 1 << 20)
    wide = F.expr("array_join(transform(sequence(1, 12), i -> sha2(concat_ws(':', id, i), 256)), '')")
    for first, n in ((0, 500), (500, 500), (1000, 20), (1020, 20)):
        store.append(spark.range(first, first + n, 1, 1).select(F.col("id").alias("doc_id"), wide.alias("text")))
    before = store.manifest()
    assert sorted(store.tier(s.bytes) for s in before.shards) == [1, 1, 3, 3] and [len(r) for r in store.plan(before)] == [2, 2]
    after = store.compact()
    assert after.version == before.version + 1
    held = [(r["a"], r["b"]) for r in store.read().groupBy(F.input_file_name()).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()]
    assert sorted(held) == [(0, 999), (1000, 1039)]


def test_empty_store(spark, docs):
    store = sharding.ShardStore(spark, scratch(spark, "e"))
    with pytest.raises(ValueError, match="no version"):
        store.read()
    assert sharding.compacted(docs([]), scratch(spark, "e")).read().count() == 0


# --- mixing


def targets(sizes):
    """Reshare until nobody is above the cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest, heavy = total - sum(capped.values()), sum(w for s, w in weight.items() if s not in capped)
        now = {s: rest * weight[s] / heavy for s in names if s not in capped} if heavy else {}
        over = {s: 3 * sizes[s] for s, t in now.items() if t > 3 * sizes[s]}
        if not over:
            return capped | now
        capped |= over


def test_mixing(docs, words, odd):
    sources = ["a", "b", "c", "dd", "É", None, "tiny"]
    rows = [(i, " ".join(words(i, 1 + i * 37 % 300)), sources[i * i % 7 if i * i % 7 != 6 else 0]) for i in range(900)] + [(900 + i, "few words", "tiny") for i in range(3)] + [(950 + (i or 0), t, "odd") for i, t in odd]
    out = mixing.copies(docs(rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((950 + (i - 950) if i else i, s) for i, _, s in rows)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["target"] == pytest.approx(want[s])
        assert all(r["copies"] in (int(want[s] // sizes[s]), int(want[s] // sizes[s]) + 1) or want[s] == 0 for r in mine) and max(r["copies"] for r in mine) <= 3
        if s not in ("odd", "tiny"):
            assert abs(sum(r["taken"] for r in mine) - want[s]) <= 60
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.copies(docs(rows[::-1])).collect()), key=str)
    mixed = mixing.mix(docs(rows))
    assert mixed.columns == docs(rows).columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.copies(docs([])).count() == 0 and mixing.copies(docs([(1, None, None)])).first()["taken"] == 0


def test_mixing_equal_rows(spark, docs):
    """Thousands of equal rows have draws of their own, and columns may have any name."""
    rows = [(7, "some words here", "a")] * 3000 + [(i, "w " * 50, "b") for i in range(100)] + [(None, None, None)] * 500
    out = mixing.copies(docs(rows)).collect()
    mine = [r for r in out if r["source"] == "a"]
    assert len(out) == 3600 and len(mine) == 3000 and len({r["copies"] for r in mine}) <= 2
    assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
    clash = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3, 4), (2, "d", "s", 5, 6, 7, 8)], "doc_id long, text string, source string, i long, s long, row long, tc long")
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in clash.collect()}


def test_rounding_keeps_words_and_probabilities(spark):
    import random

    r = random.Random(2)
    blocks = [(b, [(-s, h, h, s, 0.4) for h, s in ((b * 100 + k, r.randrange(1, 200)) for k in range(40))]) for b in range(150)]
    rows = spark.createDataFrame(blocks, "b long, ds array<struct<k: bigint, h: bigint, doc_id: bigint, size: bigint, p: double>>").select("b", "ds", mixing.round_block(F.col("ds")).alias("r")).collect()
    ones = 0
    for x in rows:
        settled, on = x["r"]["settled"], x["r"]["on"]
        assert len(settled) == 39 and all(d["p"] in (0.0, 1.0) for d in settled)
        assert sum(d["size"] * d["p"] for d in [*settled, on]) == pytest.approx(sum(0.4 * d["size"] for d in x["ds"]))
        ones += sum(d["p"] for d in settled) + on["p"]
    assert ones / (150 * 40) == pytest.approx(0.4, abs=0.03)


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><p>Site motto of the day</p>{main}<div id="comments"><p>first!</p></div><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    art = "<article><header><h1>Head&nbsp;line</h1></header><p>One <b>bold</b>\n word<br>x<p>Two &lt;ok&gt; &amp</p><div class='share-buttons'>share</div><ul><li>i<li>j</ul></article>"
    rows = [(1, "https://a.b/x/1", PAGE.format(main=art)), (2, "https://a.b/x/2", PAGE.format(main="<article><p>Other</p></article>")), (3, "http://c.d/1", PAGE.format(main="<div><p>Plain body one</p></div>")), (4, "http://c.d/2", PAGE.format(main="<div><p>Plain body two</p></div>")), (5, None, None), (6, "http://e.f/", ""), (7, "nonsense", "just text <b>here</b>"), (7, "nonsense", "just text <b>here</b>"), (None, "http://e.f/q", "<p>unclosed <i>x"), (8, "http://e.f/z", "<a" * 5000)]
    d = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, lines string")
    out = html_extract.extract(d).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and got[1] == "Head line\nOne bold word x\nTwo <ok> &\ni\nj" and got[2] == "Other"
    assert got[3].endswith("Plain body one") and "motto" not in got[3] + got[4] and "cookies" not in got[3] and "first!" not in got[3]
    assert got[5] == "" and got[6] == "" and got[7] == "just text here" and got[None] == "unclosed x"
    assert html_extract.extract(d.limit(0)).count() == 0


def test_markup_inside_an_article(spark):
    """Headings are text whatever their class, formulas and objects too; menus, adverts and forms inside go."""
    art = "<article><div class='entry-header'><h1 class='entry-header search'>Title</h1></div><p>E = <math>mc2</math> and <object>shape</object></p><div class='related'>more</div><div class='ad'>buy</div><form>f</form><xmp>raw</xmp></article>"
    rows = [(1, "https://a.b/1", PAGE.format(main=art)), (2, "https://a.b/2", PAGE.format(main="<article>x</article>"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Title\nE = mc2 and shape\nraw"


def test_boilerplate_inside_a_line_and_names_inside_values():
    kept = lambda source: [t for t, z in html_extract.blocks(source) if z >= 0]
    for inner in ('<span class="advert">Buy now</span>', "<button>Buy now</button>", "<span hidden>Buy <b>now</b></span>", '<span style="display:none">Buy now</span>', '<a class="share" href="/x">Buy now</a>', "<select><option>Buy<option>now</select>"):
        assert kept(f"<p>Hello {inner} world</p><p>next</p>") == ["Hello world", "next"], inner
        assert kept(f"<article><p>Hello {inner} world</article>tail") == ["Hello world", "tail"]
        assert html_extract.blocks(f"<article><p>Hello {inner} world</article>")[-1] == ("Hello world", 1)
    assert kept("<p>Hello <span class=ad>Buy <b>now</span> world</b> again</p>") == ["Hello world again"]
    assert kept("<p>Hello <span class=ad>Buy</p><p>next") == ["Hello", "next"] and kept("<p>Hello <span class=ad>Buy<p>next") == ["Hello", "next"]
    assert kept("<p>Hello <span class=ad>Buy") == ["Hello"] and kept("Hello <span class=ad>a <span class=ad>b</span> c</span> world") == ["Hello world"]
    for attrs in ('title="a hidden gem"', 'data-hidden="false"', 'data-id="ad"', 'href="/hidden-valley"', "href=/?id=menu", 'alt=\'class="menu"\'', "x = 'id=ad'"):
        assert kept(f"<p {attrs}>One</p>") == ["One"] and kept(f"<p>One <a {attrs}>two</a> three</p>") == ["One two three"], attrs
    assert kept('<p CLASS = "ad">no</p><p id=menu>no</p><div data-x="1" hidden>no</div><p>yes</p>') == ["yes"]
    assert kept("<html><title>Name</title><body><label>Mail</label><ol class=commentlist><li>me, too</ol><p>yes</p>") == ["yes"]


def test_differencing_decides_outside_a_named_article(spark):
    """A standfirst outside the article stays, lines of the site go; a page without a neighbour keeps its article only."""
    rows = [(i, f"https://a.b/x/{i}", PAGE.format(main=f"<p>Standfirst {i}</p><article><p>Body {i}</p><p>Same quote</p></article><p>After {i}</p>")) for i in (1, 2)]
    rows.append((3, "https://lone.b/", PAGE.format(main="<p>Standfirst</p><article><p>Body</p></article>")))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Standfirst {i}\nBody {i}\nSame quote\nAfter {i}" for i in (1, 2)} | {3: "Body"}


def test_longest_common_subsequence():
    import random

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(15))] for _ in range(2))
        for way in (html_extract.shared_lines, html_extract._by_matches, html_extract._by_bits):
            at = way(a, b)
            assert len(at) == plain(a, b) and all(a[i] == b[j] for i, j in at)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(at, at[1:], strict=False))


def test_equal_lines_and_open_tags_take_no_quadratic_time():
    import time

    began = time.time()
    a, b = [0, 1] * 10_000 + [2], [1, 0, 0] * 7_000
    assert len(html_extract.shared_lines(a, b)) >= 14_000
    assert len(html_extract.blocks("<b>" * 50_000 + "<p>x" * 20_000)) == 20_000 and html_extract.blocks("<i><b>" * 20_000 + "</i>" * 20_000 + "x") == [("x", 0)]
    assert time.time() - began < 30


def test_extract_like_brute_force(spark):
    """Hosts of pages with shared and own lines in and outside articles, against differencing line by line."""
    import random

    r = random.Random(6)

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        i = j = 0
        out = {}
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out[i] = j
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    pages, made = {}, []
    for i in range(80):
        site = [f"site {i % 4} line {k}" for k in range(6)]  # in order, so the alignment is the only one
        own = [f"own {i} {k}" for k in range(r.randrange(5))]
        quote = [f"quote {i % 4}"] * (r.random() < 0.5)
        head, foot = site[: r.randrange(1, 4)], site[r.randrange(3, 6) :]
        inside = [(x, 1) for x in [*own, *quote]] if i % 3 else [(x, 0) for x in own]
        if i % 5 == 0 and i % 3:
            inside.append((f"site {i % 4} line 5", 1))  # a line of the site within the article
        ad = [(f"ad {i}", -1)]
        pages[i] = [(x, 0) for x in head] + ad + inside + [(x, 0) for x in foot]
        body = "".join(f"<p>{x}</p>" for x, _ in pages[i][: len(head)]) + f"<div class='ad'>ad {i}</div>"
        mid = "".join(f"<p>{x}</p>" for x, _ in inside)
        made.append((i, f"https://h{i % 4}/p/{i:03d}", f"<html><body>{body}{f'<article>{mid}</article>' if i % 3 else f'<div>{mid}</div>'}{''.join(f'<p>{x}</p>' for x in foot)}</body></html>"))
    got = {x["page_id"]: x["text"] for x in html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    for i, mine in pages.items():
        other = pages[i + 4 if i + 4 in pages else i - 4]
        same = plain([x for x, _ in mine], [x for x, _ in other])
        want = [x for k, (x, z) in enumerate(mine) if z >= 0 and (k not in same or z == 1)]
        assert got[i] == "\n".join(want), i


def test_neighbours_cross_partitions(spark):
    rows = [(i, f"h{i % 3}", f"/p/{i:04d}") for i in range(200)]
    got = dict(html_extract._nearest(spark.createDataFrame(rows, "rid long, host string, path string")).collect())
    for h in range(3):
        ids = [i for i in range(200) if i % 3 == h]
        assert [got[i] for i in ids] == [*ids[1:], ids[-2]]


# --- pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    tables = [docs]
    for _, f in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, "t")
        f(spark, tables[-1], SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
        assert tables[-1].columns == list(corpus_pipeline.COLUMNS)
    rows = [{(r["doc_id"], r["text"]) for r in t.collect()} for t in tables]
    # quality: what the base rules reject by definition goes, and nothing else but what a certified cutoff rejects
    kept = {r["doc_id"] for r in quality.verdicts(docs, labels).where("kept").collect()}
    failed = {i for i, t in rows[0] if base(t)[0] < 10 or 100 * base(t)[4] > 20 * base(t)[0]}
    cutoffs = {r["stratum"] for r in quality.thresholds(quality.features(docs), labels).collect()}
    assert {i for i, _ in rows[1]} == kept and rows[1] <= rows[0] and not kept & failed
    assert cutoffs or kept == {i for i, _ in rows[0]} - failed
    # line dedup: line by line
    plain = dedup_plain(sorted(rows[1]))
    assert rows[2] == {(i, t) for i, t, n in plain if not n or t.split()} and len(rows[2]) < len(rows[1])
    # n-gram join: all pairs
    assert {i for i, _ in rows[3]} == {i for i, _, c, _ in brute(sorted(rows[2])) if i == c} and rows[3] <= rows[2]
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(tables[3]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in tables[4].select("doc_id").collect()) == Counter(copies) and rows[4] <= rows[3]
    out = corpus_pipeline.run(spark, SF)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(copies) and out.where("not matches_library").count() == 0
