"""Quality, licences, line dedup, fingerprints, toxicity, SentencePiece: brute force, round trips, edge cases."""

import hashlib
import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartospark.llm import fingerprints, license_scan, line_dedup, quality, queries, sentencepiece_codec, toxicity

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- quality rules


def base(t):
    w = re.findall(WORD, t or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, words, odd):
    rows = [*odd, (20, "l one\nl one\n l one\nl one # * $$|<>"), (21, " ".join(words(1, 30) * 2)), (22, " ".join(words(2, 40) + words(2, 40)[:6] + words(3, 40)))]
    got = quality.verdicts(docs(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    plain = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == plain
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])


def test_binomial_tail(spark):
    cases = [(0, 50), (3, 200), (10, 500), (5, 4000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)), rel=1e-9)


def test_thresholds_are_certified(spark, docs, words):
    """A cutoff is used only where enough good documents vouch for it, and then it rejects the bad ones."""
    good = [(i, " ".join(words(i, 20)), "s", "en") for i in range(300)]
    bad = [(10_000 + i, "### ".join(words(i, 20)) + "###", "s", "en") for i in range(30)]
    few = [(20_000 + i, "### ".join(words(i, 20)) + "###", "s", "fr") for i in range(20)] + [(30_000 + i, " ".join(words(i, 20)), "s", "fr") for i in range(50)]
    rows = good + bad + few
    labels = spark.createDataFrame([(i, int(10_000 > i or i >= 30_000), 0) for i, *_ in rows] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.verdicts(docs(rows), labels).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert kept >= {i for i, *_ in good + few} and not kept & {i for i, *_ in bad}
    assert {tuple(r["failed_rules"]) for r in out if r["doc_id"] in {i for i, *_ in bad}} == {("symbols",)}


def test_thresholds_like_brute_force(spark):
    """Cutoffs of random scores, stratum by stratum, against the definition."""
    import random

    r, rows, labels = random.Random(8), [], []
    scale = quality.RULES["symbols"]
    for i in range(4000):
        stratum = r.choice(["a", "a", "a", "b", "c"])
        y = int(r.random() < 0.8)
        rows.append((i, stratum, r.random() < 0.02, *(min(0.999, (0.05 if y else r.choice([0.05, 0.4])) * r.expovariate(1.0)) / scale if k == 0 else 0.0 for k in range(len(quality.RULES)))))
        if i % 2:
            labels.append((i, y))
    feats = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"{k} double" for k in quality.RULES))
    got = {x["stratum"]: tuple(x)[1:] for x in quality.thresholds(feats, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want, y = {}, dict(labels)
    for s in "abc":
        seen = [(x[3] * scale, y[x[0]]) for x in rows if x[1] == s and not x[2] and x[0] in y]
        n, best = sum(g for _, g in seen), None
        for c in quality.CUTOFFS:
            k, b = sum(g for x, g in seen if x > c), sum(1 - g for x, g in seen if x > c)
            if k > n * quality.RISK or sum(comb(n, j) * quality.RISK**j * (1 - quality.RISK) ** (n - j) for j in range(k + 1)) > quality.ALPHA / 3:
                break
            if b > k and (best is None or b - k > best[3] - best[2]):
                best = (c, n, k, b)
        if best:
            want[s] = best
    assert got == want and want


# --- licences


def test_licenses(docs, words, odd):
    texts = ["x Licensed under the Apache License, Version 2.0. y", "GNU General Public License gnu-general public_license", "released UNDER the MIT license", "licensed under cc by-nc 4.0 and CC BY", "mit license mit license", "the committee licensed it", "cc bye", " ".join(words(1, 60)) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    rows = odd + [(100 + i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(rows)).collect()}
    assert len(license_scan.scan(docs(rows)).collect()) == len(rows)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[100]["labels"] == "apache,apache-2.0" and got[103]["labels"] == "cc-by,cc-by-nc-4.0" and got[107]["labels"] == "mit" and got[107]["base_labels"] == ""
    assert got[107]["notices"][0]["offset"] == 60 and got[105]["labels"] == ""
    assert license_scan.scan(docs([])).count() == 0


def test_close_licenses_and_identifiers(docs):
    texts = {
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0", "under a Creative Commons Attribution 4.0 International License": "cc-by",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd-4.0", "licensed under the Apache Licence, Version 2.0": "apache-2.0", "GNU Lesser General Public License, version 2.1": "lgpl-2.1",
        "BSD 3-Clause License": "bsd-3-clause", "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1", "SPDX-License-Identifier: none of these": "", "the terms of the Eclipse Public License v. 2.0": "epl-2.0",
    }
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_several_notices_in_one_file(docs):
    """Every notice whose key phrase stands in a file is found, whatever other licence words are there."""
    notice = {label: text for label, text, _ in reversed(license_scan.NOTICES)}
    pairs = [("gpl", "apache-2.0"), ("bsd", "apache-2.0"), ("bsd", "mit"), ("lgpl", "mpl-2.0")]
    texts = [f"{notice[a]} x y z {notice[b]}" for a, b in pairs] + [" x ".join(t for _, t, _ in license_scan.NOTICES)]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(list(enumerate(texts)))).collect()}
    for i, (a, b) in enumerate(pairs):
        assert {(n["label"], n["offset"]) for n in got[i]["notices"]} >= {(a, 0), (b, len(notice[a].split()) + 3)}
    at, places = 0, set()
    for label, text, _ in license_scan.NOTICES:
        places.add((label, at))
        at += len(text.split()) + 1
    assert places <= {(n["label"], n["offset"]) for n in got[len(pairs)]["notices"]}


def test_notices_like_brute_force(docs, words):
    """The index finds what comparing every template with every place of every text finds: cut, changed and repeated templates, and no others."""
    import random

    r, texts = random.Random(4), []
    for k in range(60):
        _, text, _ = license_scan.NOTICES[k % len(license_scan.NOTICES)]
        w = text.split()
        w = w[r.randrange(3) if k % 2 else 0 :]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(["the", "other", "software"])
        texts.append(" ".join(words(k, r.randrange(9)) + w + (w if k % 7 == 0 else []) + words(k, 5)))
    got = {x["doc_id"]: {(n["label"], n["offset"], round(n["score"], 9)) for n in x["notices"] or []} for x in license_scan.scan(docs(list(enumerate(texts)))).collect()}
    vocabulary = {w for _, t, _ in license_scan.NOTICES for w in t.split()}
    df = Counter(w for t in texts for w in set(t.split()) & vocabulary)
    idf = {w: np.log((len(texts) + 1.0) / (df[w] + 0.5)) for w in vocabulary}
    for i, t in enumerate(texts):
        w, want = t.split(), set()
        for label, text, key in license_scan.NOTICES:
            n, k = text.split(), key.split()
            at = len(text[: text.index(key)].split())
            for offset in range(-len(n), len(w)):
                if offset + at >= 0 and w[offset + at : offset + at + len(k)] == k:
                    share = sum(idf[x] for j, x in enumerate(n) if 0 <= offset + j < len(w) and w[offset + j] == x) / sum(idf[x] for x in n)
                    if share >= license_scan.LEAST:
                        want.add((label, offset, round(min(1.0, share), 9)))
        assert got[i] == want
    assert sum(map(len, got.values())) > 20


# --- line dedup


def dedup_plain(rows):
    """Line by line: pairs of neighbouring lines and long lines that stand earlier go, runs as a whole."""
    long = lambda x: max(len(re.findall(WORD, x)), len(x) // line_dedup.CHARS) >= line_dedup.LONG
    seen, out = set(), []
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if re.search(WORD, x)]
        pairs = [(a, b) for a, b in zip(full, full[1:], strict=False) if not (long(lines[a]) and long(lines[b]))] + [(k, k) for k in full if long(lines[k])]
        gone = set()
        for a, b in sorted(pairs):
            key = (lines[a], lines[b], a == b)
            if key in seen:
                gone |= set(range(a, b + 1))
            seen.add(key)
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def test_line_dedup(spark, docs, words, odd):
    """Passages of two lines and more go wherever they stand, first instances and single short lines stay."""
    import random

    r = random.Random(3)
    line = lambda k, n=8: " ".join(words(k, n))
    block = "\n".join(line(1000 + k) for k in range(12))
    passage, two = line(5, 60), line(6, 30) + "\n" + line(7, 30)
    rows = [x for x in odd if x[0] not in (8, None)] + [(20 + i, f"{line(i)}\n{block}\n{line(50 + i)}\n{passage}\n\n{two}\n{line(90 + i)}") for i in range(5)] + [(40, f"{passage}\n{line(8)}\n{passage}"), (41, line(8)), (42, "a\nb\nc\nd\ne"), (43, "x\na\nb\nc\nd\ne"), (44, "a\n\nb\nz\na\n \nb"), (45, "q\n" * 5 + "q")]
    rows += [(100 + i, "\n".join(r.choice("uvwxyz") if r.random() < 0.5 else line(r.randrange(30), r.choice([3, 45])) for _ in range(r.randrange(25)))) for i in range(60)]
    plain = lambda d: sorted(((r["doc_id"], r["text"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(d).collect()), key=str)
    got = plain(docs(rows))
    assert got == sorted(dedup_plain(rows), key=str)
    assert sum(two in (t or "") for _, t, _ in got) == sum(passage in (t or "") for _, t, _ in got) == 1
    text = {i: t for i, t, _ in got}
    assert text[41] == line(8) and text[43] == "x" and text[24] == f"{line(4)}\n{line(54)}\n{line(94)}"
    assert line_dedup.dedup_lines(docs([])).count() == 0
    # equal and missing ids are documents of their own, and other columns may have any name
    twins = [(5, block), (5, block), (5, block + "\nend"), (None, block), (None, block), (7, passage)]
    out = [t for _, t, _ in plain(docs(twins))]
    assert sum(block in t for t in out) == 1 and len(out) == 6 and len(plain(docs(odd))) == len(odd)
    clash = spark.createDataFrame([(1, block, 1, 2, 3), (2, block, 4, 5, 6)], "doc_id long, text string, key long, row long, n_lines long")
    assert sorted((r["key"], r["row"], r["n_lines"], len(r["text"])) for r in line_dedup.dedup_lines(clash).collect()) == [(1, 2, 12, len(block)), (4, 5, 12, 0)]


def test_line_dedup_counts_words_between_any_blanks(docs, words):
    """Long lines with tabs or double blanks and of a script without blanks go like those with single blanks; blanks alone are no words."""
    long = ["\t".join(words(1, 60)), "  ".join(words(2, 60)), "\x0b".join(words(3, 60)), "中文" * 300, " ".join(words(4, 60))]
    short = ["\t".join(words(5, 20)), " " * 60 + "few words", "中文" * 20]
    rows = [(i, line) for k, line in enumerate(long + short) for i in (2 * k, 2 * k + 1)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()}
    for i, t in rows:
        assert got[i] == ("" if t in long and i % 2 else t)


# --- fingerprints


def test_fingerprints(docs, words, odd):
    rows = [(100 - i, " ".join(words(i, 40 + 20 * i))) for i in range(20)] + [r for r in odd if r[0] not in (None, 8)]
    got = {r["doc_id"]: r for r in fingerprints.edits(docs(rows)).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        a, b = fingerprints.sketches([t, edited])
        assert r["fingerprint"] == fingerprints.to_text(a) and r["near_edited"] == fingerprints.resemblance(a, b)
        assert (fingerprints.from_text(r["fingerprint"]) == a).all()
    assert len(fingerprints.edits(docs(odd)).collect()) == len(odd) and fingerprints.edits(docs([])).count() == 0
    assert fingerprints.edits(docs([(1, "a b c d e f")])).first()["near_next"] == 1.0
    assert fingerprints.fingerprint(docs(odd)).count() == len(odd)


def test_fingerprints_of_many_null_ids(docs, words):
    """Rows without an id follow the others in parts of their own, by falling hash."""
    rows = [(i, " ".join(words(i, 30))) for i in range(5)] + [(None, " ".join(words(100 + i, 30))) for i in range(300)]
    d = docs(rows)
    parts = [r["part"] for r in fingerprints.in_order(d, "doc_id", "text").where("doc_id is null and not donor").select("part").collect()]
    assert len(parts) == 300 and len(set(parts)) > 4 and max(Counter(parts).values()) < 150
    order = d.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc()).collect()
    want = Counter()
    for k, r in enumerate(order):
        t, nxt = r["text"], order[(k + 1) % len(order)]["text"]
        want[r["doc_id"], hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.edits(d).collect()) == want


def test_sketch_estimates():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64 - 1, 30_000, dtype="u8")
    a, b = x[:20_000], x[10_000:]
    sa, sb = fingerprints.sketch(a), fingerprints.sketch(b)
    assert (fingerprints.merge(sa, sb) == fingerprints.sketch(x)).all()
    assert abs(fingerprints.resemblance(sa, sb) - 1 / 3) < 0.15 and abs(fingerprints.containment(sa, sb) - 0.5) < 0.2
    assert abs(fingerprints.distinct(sa) / 20_000 - 1) < 0.4 and fingerprints.distinct(sa[:5]) == 5


# --- toxicity


def test_toxicity(spark, docs, words, odd):
    rude = lambda k: " ".join(words(k, 60)) + (". You vile" + str(k % 5) + "monger today. " if k % 3 == 0 else ". ") + " ".join(words(k + 500, 60))
    rows = [(i, rude(i)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(rows + [(1000 + (i or 0), t) for i, t in odd])
    model = toxicity.train_from(d, labels, ~toxicity.held_out(F.col("doc_id")))
    out = toxicity.score(d, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert len(out) == 600 + len(odd) and sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)
    assert all("vile" in r["worst_sentence"] for r in held if r["predicted"] and r["doc_id"] % 3 == 0)
    assert all(0 <= r["score"] <= 1 for r in out) and next(r for r in out if r["doc_id"] == 1002)["predicted"] == 0
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert not any(r["held_out"] for r in out if r["doc_id"] is None) and all(r["held_out"] is not None for r in out)
    assert toxicity.score(docs([]), model).count() == 0
    assert toxicity.train([], np.zeros(0)).bias == -20 and toxicity.train(["a"], np.ones(1)).bias == 20


# --- SentencePiece


def test_sentencepiece(docs, words, odd):
    extra = ["  a  b ", "a\nb\t c", "<s>hi</s>", "▁a ▁", "x" * 300, "é" * 70 + "   " + "ab" * 90]
    rows = odd + [(50 + i, t) for i, t in enumerate(extra)]
    out = sentencepiece_codec.round_trip(docs(rows), queries.model_path(), keep=("ids", "decoded")).collect()
    lib = sentencepiece_codec.codec(queries.model_path()).library
    assert len(out) == len(rows)
    texts = Counter((i, t or "") for i, t in rows)
    for (i, t), n in texts.items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest(), True)
        assert sum((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["matches_library"]) == want and r["doc_id"] == i and list(r["ids"]) == ids for r in out) == n
    assert sentencepiece_codec.round_trip(docs([]), queries.model_path()).count() == 0


def test_memory_of_chunks_is_bounded(words, monkeypatch):
    """Long chunks are not remembered, and what is remembered is bounded by bytes."""
    c = sentencepiece_codec.MergeCodec(queries.model_path())
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 5_000)
    for k in range(20):
        texts = [" ".join(words(k, 30)), "x" * 500 + str(k)]
        assert [np.frombuffer(i, dtype="<u4").tolist() for i in c.encode_batch(texts)] == [c.library.encode(t, add_bos=True, add_eos=True) for t in texts]
        assert max(map(len, c.known)) <= sentencepiece_codec.KEPT and c.held <= 5_000 + 30 * 300


def test_heap_and_joint_agenda_agree(words):
    c = sentencepiece_codec.codec(queries.model_path())
    chunks = [sentencepiece_codec.BLANK + w for w in words(1, 300)] + ["▁▁▁x", "中①"]
    assert c.agendas(chunks) == [c.agenda(x) for x in chunks]
