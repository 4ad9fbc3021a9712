"""Size-tiered compaction of an append-only table of Parquet shards.

A store is a folder with immutable data files and numbered manifests. A
manifest lists the files of one version with their rows and bytes. Appends
write an arrival's rows as they come, as small files, and commit a manifest
that adds them. Compaction takes files of one size tier (a power of TIER below
the target size), merges runs of MIN_RUN or more of them into files of about
the target size and commits a manifest that puts the results in their place.
A version becomes visible by renaming its manifest to its final name under an
exclusive claim, which one writer can hold (on file systems whose create is
exclusive, as HDFS and local ones; object stores need one that lends them this).
Who loses reads the new version and tries again: an append adds its files to
it, a merge goes on if the files it merged are still there, else it starts
anew. Readers keep the files of the version they opened; ``vacuum`` deletes
files that no kept version names and that are older than any write may take.

The driver sees file names and sizes only. Merging reads a run's files packed
into tasks of the target size and writes one file each: rows are not shuffled,
and a task that is lost is run again by itself.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES, TIER, MIN_RUN, CLAIM_SECONDS = 128 << 20, 4, 2, 600
#: Times that a losing writer tries again, and the age from which an unnamed file counts as left over.
TRIES, GRACE_SECONDS = 50, 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass
class Manifest:
    version: int
    schema: str
    shards: list[Shard] = field(default_factory=list)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> None:
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known:
            return Manifest(0, "")
        version = known[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            raw = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(raw["version"], raw["schema"], [Shard(**s) for s in raw["shards"]])

    def commit(self, new: Manifest) -> Manifest:
        """Write the manifest aside, then rename it to its version's name; Conflict if that is there."""
        folder = f"{self.root}/manifests"
        self._fs.mkdirs(self._path(folder))
        aside, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/v{new.version:010d}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": new.version, "schema": new.schema, "shards": [s.__dict__ for s in new.shards]}).encode()))
        finally:
            out.close()
        claim = self._path(f"{folder}/.claim-{new.version:010d}")
        if not self._fs.createNewFile(claim):  # exclusive on every Hadoop file system
            left = not self._fs.exists(final) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS
            if left:  # its writer died between claim and rename
                self._fs.delete(claim, False)
            self._fs.delete(aside, False)
            raise Conflict(f"version {new.version}")
        try:
            if self._fs.exists(final) or not self._fs.rename(aside, final):
                self._fs.delete(aside, False)
                raise Conflict(f"version {new.version}")
        finally:
            self._fs.delete(claim, False)
        return new

    def _rebased(self, schema: str | None, shards) -> Manifest | None:
        """Commit ``shards(manifest)`` on the newest version, again while other writers win; None as soon as it gives None."""
        for left in reversed(range(TRIES)):
            now = self.manifest()
            listed = shards(now)
            if listed is None:
                return None
            try:
                return self.commit(Manifest(now.version + 1, schema or now.schema, listed))
            except Conflict:
                if not left:
                    raise
                time.sleep(0.05 * (1 + uuid.uuid4().int % 8))
        return None

    def _listed(self, folder: str) -> list[Shard]:
        """The data files below a folder that a finished write left."""
        files, found = self._fs.listFiles(self._path(folder), True), []
        while files.hasNext():
            s = files.next()
            if s.getPath().getName().endswith(".parquet"):
                found.append(Shard(s.getPath().toString(), s.getLen()))
        return sorted(found, key=lambda s: s.path)

    # --- writing

    def append(self, arrivals: DataFrame, by: str | None = None) -> list[Manifest]:
        """Add rows as small immutable shards; with ``by``, each of its values is an arrival with a commit of its own, all written in one pass."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = arrivals.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        schema = (arrivals.drop(by) if by else arrivals).schema.json()
        groups: dict[str, list[Shard]] = {}
        for s in self._listed(folder):
            groups.setdefault(s.path.rsplit("/", 2)[-2] if by else "", []).append(s)
        done = []
        for _, shards in sorted(groups.items()):
            done.append(self._rebased(schema, lambda now, new=shards: now.shards + new))
        return done or [self._rebased(schema, lambda now: now.shards)]

    def tier(self, size: int) -> int:
        """0 from half the target up; else how many times smaller by TIER."""
        k, bound = 0, self.target / 2
        while size < bound and k < 30:
            k, bound = k + 1, bound / TIER
        return k

    def plan(self, m: Manifest) -> list[list[Shard]]:
        """Runs to merge: of each tier below the target size, all its files if they are MIN_RUN or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in m.shards:
            tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [sorted(run, key=lambda s: s.path) for k, run in sorted(tiers.items(), reverse=True) if k and len(run) >= MIN_RUN]

    def compact(self) -> Manifest:
        """Merge runs until no tier has one (a merge leaves fewer files, sooner or later of a higher tier); the final manifest.

        Every run is written by itself, so a file's rows come from one tier; the runs of a round are one commit.
        """
        m = self.manifest()
        for _ in range(32):
            runs = self.plan(m)
            if not runs:
                break
            merged: list[Shard] = []
            for run in runs:
                files = max(1, round(sum(s.bytes for s in run) / self.target))
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                self._read(m.schema, run).coalesce(files).write.mode("errorifexists").parquet(folder)
                merged += self._listed(folder)
            gone = {s.path for run in runs for s in run}
            done = self._rebased(None, lambda now: [s for s in now.shards if s.path not in gone] + merged if gone <= {s.path for s in now.shards} else None)
            if done is None:  # another writer merged some of the same files
                for s in merged:
                    self._fs.delete(self._path(s.path), False)
            m = done or self.manifest()
            if done and len(merged) >= len(gone):
                break
        return m

    def vacuum(self, keep_versions: int = 1, older_than: float = GRACE_SECONDS) -> int:
        """Delete data files that none of the last versions names and that are ``older_than`` seconds old, so that nobody is about to commit them; how many."""
        now = time.time()
        old = self._listed(f"{self.root}/data")  # listed before the manifests: what is committed meanwhile is named there
        kept = {s.path for v in self.versions()[-keep_versions:] for s in self.manifest(v).shards}
        gone = [s for s in old if s.path not in kept and (not older_than or now - self._fs.getFileStatus(self._path(s.path)).getModificationTime() / 1000 >= older_than)]
        for s in gone:
            self._fs.delete(self._path(s.path), False)
        return len(gone)

    # --- reading

    def _read(self, schema: str, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(s.path for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m.schema:
            raise ValueError("the store has no version yet")
        if not m.shards:
            from pyspark.sql.types import StructType

            return self.spark.createDataFrame([], StructType.fromJson(json.loads(m.schema)))
        return self._read(m.schema, m.shards)


def compacted(docs: DataFrame, root: str, arrivals: int = 4, target_bytes: int = TARGET_BYTES, id_col: str = "doc_id") -> ShardStore:
    """Append ``docs`` to a new store in ``arrivals`` commits (dealt by a hash of the id), compact and vacuum it.

    All columns and rows are stored as they are, nulls and repeats included,
    whatever the columns' names; an empty table makes a store with an empty version.
    """
    store, by = ShardStore(docs.sparkSession, root, target_bytes), "arrival"
    while by in {c.lower() for c in docs.columns}:
        by += "_"
    store.append(docs.withColumn(by, F.pmod(F.xxhash64(id_col), F.lit(arrivals))), by=by)
    store.compact()
    store.vacuum(older_than=0)  # the store is this call's own
    return store
