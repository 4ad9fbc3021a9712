"""Element filters: rules, accept/reject sets, bounding box, used nodes; compiled to Columns and a semi join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import INFRASTRUCTURE, ROAD_LEVELS, ROAD_PRESETS
from .model import GeoMap

KINDS = ("nodes", "ways", "relations")


@dataclass(frozen=True)
class Rule:
    """One rule: for elements of a kind ("*": all) with this key and one of these values (none, or "*": any)."""

    kind: str
    key: str | None = None
    values: tuple[str, ...] = ()

    def column(self, tags: Column) -> Column:
        if self.key is None or self.key == "*":
            return F.lit(True)
        if not self.values or "*" in self.values:
            return F.map_contains_key(tags, F.lit(self.key))
        return F.coalesce(tags[self.key].isin(*self.values), F.lit(False))


def rule(kind: str, key: str | None = None, value: str | None = None) -> Rule:
    """A comma in the value separates alternatives."""
    return Rule(kind, key, tuple(v.strip() for v in value.split(",")) if value else ())


def simple(text: str, tags: Column, lists: bool = True) -> Column:
    """"key", "key=*", "key=value" or, with lists, "key=a,b"."""
    key, _, value = text.partition("=")
    values = tuple(v.strip() for v in value.split(",")) if lists and value else ((value,) if value else ())
    return Rule("*", key.strip(), values).column(tags)


@dataclass
class MapFilter:
    """Global rejection, bounding box (nodes only, borders included), used nodes and tag rules, in that order.

    A matching reject rule drops an element. If accept rules are there for its
    kind, one must match. Ways are filtered first, so that ``used_nodes`` keeps
    the nodes that kept ways refer to.
    """

    accept: list[Rule] = field(default_factory=list)
    reject: list[Rule] = field(default_factory=list)
    rejected_kinds: set[str] = field(default_factory=set)
    bbox: tuple[float, float, float, float] | None = None  # top, left, bottom, right
    used_nodes: bool = False

    def add_accept(self, kind: str, key: str | None = None, value: str | None = None) -> MapFilter:
        self.accept.append(rule(kind, key, value))
        return self

    def add_reject(self, kind: str, key: str | None = None, value: str | None = None) -> MapFilter:
        self.reject.append(rule(kind, key, value))
        return self

    def active(self) -> bool:
        return bool(self.accept or self.reject or self.rejected_kinds or self.bbox or self.used_nodes)

    def tags_column(self, kind: str, tags: Column) -> Column:
        mine = lambda rules: [r.column(tags) for r in rules if r.kind in (kind, "*")]
        keep, accepted, rejected = F.lit(True), mine(self.accept), mine(self.reject)
        if accepted:
            keep = accepted[0]
            for a in accepted[1:]:
                keep = keep | a
        for r in rejected:
            keep = keep & ~r
        return keep

    def column(self, kind: str, tags: Column, lat: Column | None = None, lon: Column | None = None) -> Column:
        keep = F.lit(kind not in self.rejected_kinds)
        if self.bbox and kind == "nodes" and lat is not None:
            top, left, bottom, right = self.bbox
            keep = keep & lat.between(bottom, top) & lon.between(left, right)
        return keep & self.tags_column(kind, tags)

    def apply(self, m: GeoMap) -> GeoMap:
        ways = m.ways.where(self.column("ways", F.col("tags")))
        nodes = m.nodes.where(self.column("nodes", F.col("tags"), F.col("lat"), F.col("lon")))
        refs = m.way_refs().join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")
        if self.used_nodes:
            nodes = nodes.join(refs.select(F.col("ref").alias("id")), "id", "left_semi")
        relations = None if m.relations is None else m.relations.where(self.column("relations", F.col("tags")))
        return m.with_(nodes=nodes, ways=ways, relations=relations, refs=None if m.refs is None else refs)


def from_osmosis(text: str) -> tuple[str, str | None, str | None] | None:
    """"accept:highway=a,b" or "highway=a" as (action, key, value); None without "="."""
    action, sep, rest = text.partition(":")
    if not sep or action not in ("accept", "reject"):
        action, rest = "accept", text
    key, eq, value = rest.partition("=")
    return (action, key.strip(), value.strip()) if eq else None


def osmosis_filter(accept_nodes=(), reject_nodes=(), accept_ways=(), reject_ways=(), accept_relations=(), reject_relations=(), bbox=None, used_node=False, reject_kinds=()) -> MapFilter:
    """A filter from lists of "key=value" texts for each action and kind."""
    f = MapFilter(bbox=bbox, used_nodes=used_node, rejected_kinds=set(reject_kinds))
    for kind, ok, bad in (("nodes", accept_nodes, reject_nodes), ("ways", accept_ways, reject_ways), ("relations", accept_relations, reject_relations)):
        for texts, add in ((ok, f.add_accept), (bad, f.add_reject)):
            for t in texts:
                key, eq, value = t.partition("=")
                if eq:
                    add(kind, key.strip(), value.strip())
    return f


def key_like(key: Column, pattern: str) -> Column:
    """A key against "a", "a*", "*a" or "a*b"; only the first two pieces of a pattern count."""
    if "*" not in pattern:
        return key == pattern
    head, tail = pattern.split("*")[:2]
    return key.startswith(head) & key.endswith(tail) & (F.length(key) >= len(head) + len(tail))


def text_like(value: Column, query: str, regex: bool = False, case: bool = False) -> Column:
    """Substring or regular-expression search; a malformed expression matches nothing."""
    import re

    if regex:
        try:
            re.compile(query)
        except re.error:
            return F.lit(False)
        return F.coalesce(value.rlike(query if case else f"(?i){query}"), F.lit(False))
    return F.coalesce(value.contains(query) if case else F.lower(value).contains(query.lower()), F.lit(False))


def road_levels(text: str) -> tuple[str, ...]:
    """Highway values of "1,main,footway": levels, presets and plain values together."""
    out: dict[str, None] = {}
    for part in (p.strip() for p in text.split(",")):
        if part.isdigit() and int(part) in ROAD_LEVELS:
            values = ROAD_LEVELS[int(part)]
        elif part in ROAD_PRESETS:
            values = tuple(v for k in ROAD_PRESETS[part] for v in ROAD_LEVELS[k])
        else:
            values = (part,) if part else ()
        out |= dict.fromkeys(values)
    return tuple(out)


def infra_type(tags: Column, kinds=tuple(INFRASTRUCTURE)) -> Column:
    """"tag=value" of the first infrastructure overlay that a way has, else null."""
    found = [F.when(tags[key].isin(*values), F.concat_ws("=", F.lit(key), tags[key])) for key, values in (INFRASTRUCTURE[k] for k in kinds)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def properties(tags: Column, main_key: str, keep=None) -> Column:
    """Tags as properties: those named, or all; never the main key."""
    return F.map_filter(tags, lambda k, _: (k != main_key) & (k.isin(*keep) if keep is not None else F.lit(True)))
