"""The prefix tree against a plain one built from whole conversations."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from cartospark.llm import conversation_trie


def plain_trie(rows):
    """Every prefix as a tuple of turns."""
    original = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            original[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in original.items()}
    again = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in again.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(again[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, c int, key string")


def odd_rows(seed=0, n=70):
    r = random.Random(seed)
    rows = []
    for c in list(range(n)) + [-3, -20, -41, 1 << 40, 1005]:
        for turn in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([turn, turn, None, 2]), r.choice(["user", "assistant", None, ""]), r.choice(["hi", "hi there", "", None, "a\tb\n c", "u:x"])))
    rows += [(None, 0, "user", "of no conversation"), (None, None, None, None)]
    rows += rows[5:9] + [(7, 1, "user", "word " * 30_000)]
    return rows


@pytest.mark.parametrize("seed", [0])
def test_trie_equals_plain_one(spark, seed):
    rows = odd_rows(seed)
    got = sorted(map(tuple, conversation_trie.trie(table(spark, rows)).collect()), key=repr)
    assert got == plain_trie(rows)


def test_blocks_and_hot_conversations(spark, monkeypatch):
    """A conversation of a third of all rows, a hot first turn, hundreds of equal conversations, long chains."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    monkeypatch.setattr(conversation_trie, "PIECE_BITS", 3)
    rows = [(3, i, "user", f"turn {i % 7}") for i in range(150)]
    rows += [(c, 0, "user", "the same start") for c in range(100, 180)]
    rows += [(c, i, "user", "equal") for c in range(200, 260) for i in range(2)]
    rows += [(1000 + 20 * c, i, "user", f"s{min(i, c)}") for c in range(12) for i in range(14)]
    got = sorted(map(tuple, conversation_trie.trie(table(spark, rows)).collect()), key=repr)
    assert got == plain_trie(rows)


def test_no_conversation(spark):
    out = conversation_trie.trie(table(spark, []))
    assert out.count() == 0 and out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert conversation_trie.trie(table(spark, [(None, 1, "a", "b")])).count() == 0
    one = conversation_trie.trie(table(spark, [(1, 0, "user", "gone")])).collect()  # its only turn is replaced by those of conversation 0, which has none
    assert [tuple(r) for r in one] == plain_trie([(1, 0, "user", "gone")])
