"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of
the piece that they would make: the best pair merges (the leftmost of equals),
its neighbours form new pairs, until no pair makes a piece. Symbols outside the
vocabulary fall back to bytes. No piece has a blank after another character, so
a text falls apart before blanks into chunks that cannot influence one another;
each worker keeps the chunks that it has met, and the agendas of new short
chunks advance together in numpy. Long chunks use a heap.

In each Arrow batch the sentencepiece library encodes every chunk that is new to
the worker and decodes every text a second time. ``matches_library`` says
whether both agree; where they ever differed, the library's answer is returned.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANK = "▁"
#: Bytes of chunks that a worker remembers at most, the longest chunk that it remembers, and the longest that the joint agenda takes.
REMEMBERED, KEPT, SHORT = 256 << 20, 64, 40
_CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class MergeCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        size = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.symbol = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        score = {i: lib.get_score(i) for i in self.symbol.values()}
        self.inner_blank = any(BLANK in p.lstrip(BLANK) for p in self.symbol)
        for p in list(self.symbol):  # characters that occur in pieces only
            for c in p:
                if c not in self.symbol:
                    self.symbol[c] = len(self.pieces) + len(self.symbol)
        order = sorted(score, key=score.__getitem__)
        rank, last, r = {}, None, 0
        for i in order:  # equal scores share a rank
            r += score[i] != last
            last = rank[i] = score[i], r
            last = score[i]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in list(self.symbol.items()):
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is not None and right is not None:
                    self.merge[left, right] = i, rank[i][1]
        self._hash_pairs()
        self.symbol_of = -np.arange(1, 0x110001, dtype=np.int64)  # by code point; negative: in no piece
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.names = {i: s for s, i in self.symbol.items()}
        self.text_of = [b"" if special[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.byte_id.items():
            self.text_of[i] = bytes([b])
        if self.unk >= 0:
            self.text_of[self.unk] = " ⁇ ".encode()
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes of it, with what Python adds to two objects
        self.check, self.differing = True, set()

    def _fallback(self, s: str) -> list[int]:
        return [self.byte_id[b] for b in s.encode()] if self.byte_id else [self.unk]

    def _symbols(self, chunk: str, foreign: dict[int, str]) -> list[int]:
        """The characters' ids; a character of no piece gets a negative one, which merges with nothing."""
        out = []
        for c in chunk:
            if (i := self.symbol.get(c)) is None:
                foreign[i := -ord(c) - 1] = c
            out.append(i)
        return out

    def _finish(self, symbols: list[int], foreign: dict[int, str]) -> bytes:
        out: list[int] = []
        for i in symbols:
            if 0 <= i < len(self.pieces):
                out.append(i)
            else:
                out += self._fallback(foreign[i] if i < 0 else self.names[i])
        return np.array(out, dtype="<u4").tobytes()

    def agenda(self, chunk: str) -> bytes:
        """One chunk's ids, with a heap of pairs by (score, leftmost)."""
        foreign: dict[int, str] = {}
        sym = self._symbols(chunk, foreign)
        n = len(sym)
        before, after, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (m := self.merge.get((sym[a], sym[b]))):
                heapq.heappush(heap, (-m[1], a, b, m[0]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, made = heapq.heappop(heap)
            if not (live[a] and live[b] and after[a] == b) or self.merge.get((sym[a], sym[b]), (None,))[0] != made:
                continue
            sym[a], live[b], after[a] = made, False, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return self._finish([s for s, on in zip(sym, live, strict=True) if on], foreign)

    def _hash_pairs(self) -> None:
        """The pairs in an open-addressed table, for lookups of whole arrays."""
        self.bits = max(4, (4 * len(self.merge)).bit_length())
        size = 1 << self.bits
        self.pair, self.pair_rank, self.pair_made = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        code = np.array([(a << 32) | b for a, b in self.merge], dtype=np.int64)
        made, rank = (np.array([v[k] for v in self.merge.values()], dtype=np.int64) for k in (0, 1))
        slot = self._slot(code)
        while len(code):
            free = self.pair[slot] < 0
            first = np.unique(np.where(free, slot, -1), return_index=True)
            put = first[1][first[0] >= 0]
            for table, values in ((self.pair, code), (self.pair_rank, rank), (self.pair_made, made)):
                table[slot[put]] = values[put]
            left = np.ones(len(code), dtype=bool)
            left[put] = False
            code, rank, made, slot = code[left], rank[left], made[left], (slot[left] + 1) & (size - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) that each pair makes; rank -1: none."""
        code = np.where((left >= 0) & (right >= 0), (left << 32) | right, 0)
        slot = self._slot(code)
        todo = np.flatnonzero((self.pair[slot] != code) & (self.pair[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.pair) - 1)
            held = self.pair[slot[todo]]
            todo = todo[(held != code[todo]) & (held >= 0)]
        hit = (self.pair[slot] == code) & (code > 0)
        return np.where(hit, self.pair_rank[slot], -1), self.pair_made[slot]

    def agendas(self, chunks: list[str]) -> list[bytes]:
        """Many short chunks' ids: every chunk's best pair merges, in all chunks at once, until none has a pair left."""
        cp = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        sym = self.symbol_of[cp]
        foreign = {int(i): chr(-int(i) - 1) for i in np.unique(sym[sym < 0])}
        of = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)))
        rank, made = np.full(len(sym), -1, dtype=np.int64), np.full(len(sym), -1, dtype=np.int64)
        rank[:-1], made[:-1] = self._lookup(sym[:-1], sym[1:])
        rank[:-1][of[:-1] != of[1:]] = -1
        done_sym, done_of = [], []
        while len(sym):
            value = np.where(rank >= 0, (rank << 32) - np.arange(len(sym)), -1)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.maximum.reduceat(value, first)
            size = np.diff(np.r_[first, len(sym)])
            on = best >= 0
            if not on.all():
                still = np.repeat(on, size)
                done_sym.append(sym[~still])
                done_of.append(of[~still])
                sym, of, rank, made, value, best, size = sym[still], of[still], rank[still], made[still], value[still], best[on], size[on]
                if not len(sym):
                    break
            where = np.flatnonzero(value == np.repeat(best, size))
            sym[where] = made[where]
            keep = np.ones(len(sym), dtype=bool)
            keep[where + 1] = False
            where = where - np.arange(len(where))  # one symbol went for each merge before
            sym, of, rank, made = sym[keep], of[keep], rank[keep], made[keep]
            fresh = np.concatenate([where, where - 1])
            fresh = fresh[(fresh >= 0) & (fresh < len(sym) - 1)]
            rank[fresh], made[fresh] = self._lookup(sym[fresh], sym[fresh + 1])
            rank[fresh[of[fresh] != of[fresh + 1]]] = -1
            rank[-1] = -1
        sym, of = np.concatenate(done_sym), np.concatenate(done_of)
        at = np.argsort(of, kind="stable")
        sym, of = sym[at], of[at]
        ends = np.searchsorted(of, np.arange(len(chunks) + 1))
        plain = np.ones(len(chunks), dtype=bool)
        plain[of[(sym < 0) | (sym >= len(self.pieces))]] = False
        raw = sym.astype("<u4").tobytes()
        return [raw[4 * ends[i] : 4 * ends[i + 1]] if plain[i] else self._finish(sym[ends[i] : ends[i + 1]].tolist(), foreign) for i in range(len(chunks))]

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks, named without the blank before them, and check each against the library."""
        known = self.known
        short, long = [c for c in chunks if len(c) < SHORT], [c for c in chunks if len(c) >= SHORT]
        found = dict(zip(short, self.agendas([BLANK + c for c in short]), strict=True)) if short else {}
        found.update((c, self.agenda(BLANK + c)) for c in long)
        if self.check:
            # the library puts the blank before a text itself
            named = [c for c in found if c]
            theirs = self.library.encode([c.replace(BLANK, " ") for c in named], num_threads=1)
            flat = np.fromiter(chain.from_iterable(theirs), dtype="<u4").tobytes()
            if flat != b"".join([found[c] for c in named]) or any(4 * len(x) != len(found[c]) for c, x in zip(named, theirs, strict=True)):
                for c, x in zip(named, theirs, strict=True):
                    if (raw := np.array(x, dtype="<u4").tobytes()) != found[c]:
                        self.differing.add(c)
                        found[c] = raw
        known.update(found)

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.inner_blank:
            return [text.replace(" ", BLANK)]
        if "  " in text or text[0] == " " or BLANK in text:
            return [c[1:] for c in _CHUNK.findall(BLANK + text.replace(" ", BLANK))]
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts with begin and end ids, as little-endian unsigned 32-bit integers."""
        chunks: list[str] = []
        ends = [0]
        for t in texts:
            chunks += self._chunks(t)
            ends.append(len(chunks))
        ids = list(map(self.known.get, chunks))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = list({chunks[i] for i in missing})
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self._learn(new)
            for i in missing:
                ids[i] = self.known[chunks[i]]
            for c in new:
                if len(c) > KEPT:  # whole texts without blanks are chunks, too
                    del self.known[c]
                else:
                    self.held += 200 + 4 * len(c)
        bos, eos = (np.array([i], dtype="<u4").tobytes() for i in (self.bos, self.eos))
        return [bos + b"".join(ids[a:b]) + eos for a, b in pairwise(ends)]

    def differs(self, text: str) -> bool:
        """Whether a text has a chunk that the library encodes in another way."""
        return bool(self.differing) and not self.differing.isdisjoint(self._chunks(text))

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids vanish, byte ids join to UTF-8, the blank put before the text goes."""
        text_of = self.text_of
        raw = b"".join([text_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


_codecs: dict[str, MergeCodec] = {}


def codec(path: str) -> MergeCodec:
    if path not in _codecs:
        _codecs[path] = MergeCodec(path)
    return _codecs[path]


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text; one row per row of ``docs``.

    Returns doc_id, n_tokens (begin and end ids included), ids_sha256,
    decoded_sha256 and matches_library (null with ``check=False``); with
    ``keep`` also "ids" (array<int>) and "decoded" (the text). ``model_path``
    names a model file that every executor can open. Null texts count as empty
    and give the begin and end ids alone. Ids may be null or repeat; other
    columns are ignored. Texts are handled one by one, whatever their length.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        own.check = check
        for pdf in pdfs:
            texts = pdf["text"].tolist()
            ids = own.encode_batch(texts)
            decoded = [own.decode(i) for i in ids]
            agree: list[bool | None] = [None] * len(texts)
            if check:
                back = own.library.decode([np.frombuffer(i, dtype="<u4").tolist() for i in ids], num_threads=1)
                agree = [a == b and not own.differs(t) for a, b, t in zip(decoded, back, texts, strict=True)]
                decoded = back
            out = pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                "matches_library": pd.array(agree, dtype="boolean"),
            })
            if "ids" in keep:
                out["ids"] = [np.frombuffer(i, dtype="<u4").astype("i4") for i in ids]
            if "decoded" in keep:
                out["decoded"] = decoded
            yield out

    small_batches(docs.sparkSession, 256)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, matches_library boolean" + ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema)
