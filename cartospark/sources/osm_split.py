"""One pass over OpenStreetMap XML of any size, in as many tasks as the file has splits.

Spark's text source cuts the file at ``>``, so it splits anywhere, whether the
file has lines or not, on every file system that Spark reads. A task parses the
elements that begin in its split and end before the split's last one begins;
what lies before its first element start (the rest of an element of an earlier
split) and its last element are fragments. The few fragments, two a split, are
put together in the order of the file and parsed in a second, small step.

Elements, comments and entities are the XML parser's business. ``ord`` is the
order of the source: file, then place in the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Characters that a task gathers before it parses them.
CHUNK = 1 << 21
_START = re.compile(r"<(?:node|way|relation)(?=[\s/>])")
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.string()), ("role", pa.string())])
_SCHEMA = pa.schema([("kind", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("id", pa.string()), ("lat", pa.string()), ("lon", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("node_refs", pa.list_(pa.string())), ("members", pa.list_(_MEMBER)), ("fragment", pa.string())])
_DDL = "kind string, file string, block long, seq long, id string, lat string, lon string, tags map<string,string>, node_refs array<string>, members array<struct<type:string,ref:string,role:string>>, fragment string"
#: Element numbers that the place of a split leaves room for: a byte of a packed file is less than sixteen elements.
_ROOM = 16
_FILE_BITS = 46


class _Elements:
    """Columns of the parsed elements of one task."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def parse(self, text: str, file: str, block: int, seq: int) -> int:
        """Parse whole elements; a broken one is left out and costs no other. The next number."""
        before = len(self.rows)
        try:
            return self._feed(text, file, block, seq)
        except expat.ExpatError:
            del self.rows[before:]
        starts = [x.start() for x in _START.finditer(text)]
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            kept = len(self.rows)
            try:
                self._feed(text[a:b], file, block, seq)
            except expat.ExpatError:
                del self.rows[kept + 1 :]  # the element stays if it was whole before what broke
            seq += 1
        return seq

    def _feed(self, text: str, file: str, block: int, seq: int) -> int:
        parser = expat.ParserCreate(encoding="utf-8")
        depth, number = 0, seq
        tags: dict[str, str] = {}
        refs: list[str | None] = []
        members: list[tuple] = []
        head: tuple = ()

        def start(name: str, at: dict[str, str]) -> None:
            nonlocal depth, head, tags, refs, members
            depth += 1
            if depth == 2:
                head, tags, refs, members = (name, at.get("id"), at.get("lat"), at.get("lon")), {}, [], []
            elif depth == 3:
                if name == "tag":
                    k, v = at.get("k"), at.get("v")
                    if k and v:
                        tags.pop(k, None)
                        tags[k] = v
                elif name == "nd":
                    refs.append(at.get("ref"))
                elif name == "member":
                    members.append((at.get("type"), at.get("ref"), at.get("role") or ""))

        def end(name: str) -> None:
            nonlocal depth, number
            depth -= 1
            if depth == 1:
                kind, id_, lat, lon = head
                if kind in ("node", "way", "relation"):
                    if id_ is not None:
                        self.rows.append((kind, file, block, number, id_, lat, lon, list(tags.items()), refs, members, None))
                    number += 1

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.Parse("<osm>", False)
        parser.Parse(text.encode(), False)
        parser.Parse("</osm>", True)
        return number

    def fragment(self, kind: str, file: str, block: int, seq: int, text: str) -> None:
        self.rows.append((kind, file, block, seq, None, None, None, None, None, None, text))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True))
        members = [None if m is None else [dict(zip(("type", "ref", "role"), x, strict=True)) for x in m] for m in cols[9]]
        return pa.RecordBatch.from_arrays([pa.array(members if i == 9 else list(c), _SCHEMA.field(i).type) for i, c in enumerate(cols)], schema=_SCHEMA)


class _Split:
    """The text of one split, as it comes."""

    def __init__(self, out: _Elements, file: str, block: int) -> None:
        self.out, self.file, self.block = out, file, block
        self.held, self.size, self.seq, self.begun = [], 0, 0, False
        self.head: list[str] = []

    def add(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size >= CHUNK:
            self.work(False)

    def work(self, last: bool) -> None:
        text = "".join(self.held)
        skip = 0 if self.begun else _comment_end(text)
        over, text = text[:skip], _COMMENT.sub("", text[skip:])
        edge = text.find("<!--")  # a comment that goes on
        edge = len(text) if edge < 0 else edge
        body, rest = text[:edge], text[edge:]
        starts = [x.start() for x in _START.finditer(body)]
        if not self.begun:
            first = starts[0] if starts else len(body)
            self.head += [over, body[:first]]
            body, starts, self.begun = body[first:], [s - first for s in starts], bool(starts)
        if starts:
            if starts[-1]:
                self.seq = self.out.parse(body[: starts[-1]], self.file, self.block, self.seq)
            body = body[starts[-1] :]
        self.held, self.size = [body, rest], 0  # the last element, and what follows
        if last:
            if self.begun:
                self.out.fragment("tail", self.file, self.block, self.seq, body + rest)
            else:
                self.head.append(rest)
            if self.block or not self.begun:
                self.out.fragment("head", self.file, self.block, -1, "".join(self.head))


def _comment_end(text: str) -> int:
    """Where a comment ends that an earlier split began; 0 if the text does not begin in one. An attribute may hold ``-->``, too."""
    end, begin = text.find("-->"), text.find("<!--")
    if end < 0 or 0 <= begin < end:
        return 0
    markup = text[text.rfind("<", 0, end) + 1 : end]
    return 0 if markup.count('"') % 2 or markup.count("'") % 2 and '"' not in markup else end + 3


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, split = _Elements(), None
    for b in batches:
        values, files, blocks = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        cuts = [0, *((blocks[1:] != blocks[:-1]).nonzero()[0] + 1).tolist(), len(blocks)] if len(blocks) else [0]
        for x, y in zip(cuts, cuts[1:], strict=False):
            names = files.slice(x, y - x).to_pylist()
            z = x
            while z < y:  # splits of several small files may begin at the same place
                file = names[z - x]
                n = next((i for i in range(z, y) if names[i - x] != file), y) if names[-1] != file else y
                if split is None or (split.file, split.block) != (file, int(blocks[z])):
                    if split is not None:
                        split.work(True)
                    split = _Split(out, file, int(blocks[z]))
                split.add("".join(t + ">" for t in values.slice(z, n - z).to_pylist()))
                z = n
        if out.rows:
            yield out.batch()
    if split is not None:
        split.work(True)
    if out.rows:
        yield out.batch()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of files in order -> elements: a tail, and the heads up to the next tail."""
    out, at, text = _Elements(), None, []

    def close() -> None:
        if at is not None:
            found = _Elements()
            whole = "".join(text)
            found.parse(_COMMENT.sub("", whole), *at)
            out.rows += found.rows[:1]

    for b in batches:
        for kind, file, block, seq, fragment in zip(*(b.column(c).to_pylist() for c in ("kind", "file", "block", "seq", "fragment")), strict=True):
            if at is not None and at[0] != file or kind == "tail":
                close()
                at, text = None, []
            if kind == "tail":
                at = (file, block, seq)
            text.append(fragment)
        if out.rows:
            yield out.batch()
    close()
    if out.rows:
        yield out.batch()


def _records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, block): the text between ``>`` and ``>``, its file and the place where its split begins."""
    rows = spark.read.option("lineSep", ">").text(paths)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def ingest(spark: SparkSession, paths: str | list[str], target: str) -> DataFrame:
    """Parse files into Parquet below ``target``, by kind; (kind, id, lat, lon, tags, node_refs, members, ord) of all elements.

    An element without an id or with broken markup is left out; so is a comment,
    with what is in it. Repeated elements stay, in the order of the source.
    """
    ship(spark)
    _records(spark, paths).mapInArrow(_parse, _DDL).write.partitionBy("kind").parquet(f"{target}/parsed")
    parsed = spark.read.schema(_DDL).parquet(f"{target}/parsed")
    pieces = parsed.where(F.col("kind").isin("head", "tail")).select("kind", "file", "block", "seq", "fragment")
    pieces = pieces.repartition("file").sortWithinPartitions("file", "block", "seq")
    pieces.mapInArrow(_join, _DDL).write.partitionBy("kind").parquet(f"{target}/joined")
    both = parsed.where(F.col("kind").isin("node", "way", "relation")).unionByName(spark.read.schema(_DDL).parquet(f"{target}/joined"))
    names = sorted(r["file"] for r in pieces.select("file").distinct().collect())  # names of the files
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "file_no long, file string"))
    order = F.shiftleft("file_no", _FILE_BITS) + F.col("block") * _ROOM + F.col("seq")
    return both.join(numbers, "file").select("kind", "id", "lat", "lon", "tags", "node_refs", "members", order.alias("ord"))
