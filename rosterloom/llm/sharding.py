"""Sharding by size-tiered compaction, with a versioned manifest.

Native: DataFrame reads and writes; the driver only handles the manifest, whose
size is that of the list of shards.

A store is a folder::

    shards/<name>/part-*.parquet    immutable runs of rows
    manifest/v<N>.json              all live shards of version N, written whole

* ``append`` writes arrivals as small shards and commits the next version.
* ``compact`` merges runs of similar size: shards are put in tiers by size
  (each ``FANOUT`` times the one before), and ``FANOUT`` or more of a tier
  become one run of files near the target size.  A run that no tier merges, of
  whatever size, is written anew by itself if files near the target size are
  half as many as its own or fewer; so arrivals of many small files don't stay.
* A commit writes a temporary file and renames it to ``v<N+1>.json``; a rename
  fails if that version exists.  Of two writers the later one puts its change
  on the new version, if the shards that it replaces are still there, or else
  gives up (``Conflict``) and deletes the shards that it wrote.  Readers see a
  version whole or not at all.
* Nothing is deleted but by ``vacuum``, and that only takes shards which a
  committed version lists and no version since ``grace`` seconds does.  Folders
  that no version ever listed belong to writers that have not committed yet.

Nulls, ties, repeated rows, very long texts and extra columns are stored as they
are, whatever their names.  An empty arrival adds no shard; an empty store reads
as an empty table.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 4
SMALLEST = 1 << 20
TARGET = 128 << 20


class Conflict(RuntimeError):
    """Another writer committed this version first, or replaced the shards that a change builds on."""


@dataclass(frozen=True)
class Shard:
    name: str
    rows: int
    size: int
    files: int

    def wanted(self, target: int = TARGET) -> int:
        """The number of files near the target size that hold the run."""
        return max(1, round(self.size / target))

    def tier(self, smallest: int = SMALLEST, fanout: int = FANOUT) -> int:
        tier, bound = 0, smallest
        while self.size >= bound:
            tier, bound = tier + 1, bound * fanout
        return tier


@dataclass
class Store:
    spark: SparkSession
    path: str
    schema: T.StructType
    target: int = TARGET
    smallest: int = SMALLEST
    fanout: int = FANOUT
    log: list[dict] = field(default_factory=list)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> dict[int, float]:
        """The committed versions that can still be read, with the time of their commit in seconds."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return {}
        found = {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p) if s.getLen() > 0}
        return {int(n[1:-5]): at for n, at in found.items() if n.startswith("v") and n.endswith(".json")}

    def version(self) -> int:
        return max([0, *self.versions()])

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        fs, p = self._fs(f"{self.path}/manifest/v{version}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard], note: str) -> int:
        """Make version ``base + 1`` of these shards; ``Conflict`` if it is taken."""
        body = json.dumps({"version": base + 1, "note": note, "shards": [vars(s) for s in sorted(shards, key=lambda s: s.name)]})
        fs, tmp = self._fs(f"{self.path}/manifest/.tmp-{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/manifest/v{base + 1}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(body.encode()))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise Conflict(f"version {base + 1} exists")
        self.log.append({"version": base + 1, "note": note, "shards": len(shards)})
        return base + 1

    def change(self, gone: set[str], added: list[Shard], note: str, tries: int = 20) -> int:
        """Commit the newest version without the shards ``gone`` and with those ``added``, on top of what others commit meanwhile."""
        for _ in range(tries):
            base = self.version()
            live = self.shards(base)
            if not gone <= {s.name for s in live}:
                break
            try:
                return self.commit(base, [s for s in live if s.name not in gone] + added, note)
            except Conflict:
                continue
        for s in added:
            fs, p = self._fs(f"{self.path}/shards/{s.name}")
            fs.delete(p, True)
        raise Conflict(f"{note}: the shards that it replaces are gone, or {tries} others came first")

    def _shard(self, name: str, rows: int) -> Shard:
        fs, p = self._fs(f"{self.path}/shards/{name}")
        sizes = [int(s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
        return Shard(name, rows, sum(sizes), len(sizes))

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Write arrivals as new shards, one for each value of ``by`` (dropped), all in one job and one commit."""
        name = f"a-{uuid.uuid4().hex}"
        run = "_run"
        while run in {c.lower() for c in arrivals.columns}:
            run += "_"
        arrivals = arrivals.withColumn(run, F.lit(0)) if by is None else arrivals.withColumnRenamed(by, run)
        arrivals.write.partitionBy(run).parquet(f"{self.path}/shards/{name}")
        fs, p = self._fs(f"{self.path}/shards/{name}")
        runs = [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory()]
        counts = self._count(runs)
        return self.change(set(), [self._shard(r, counts.get(r, 0)) for r in runs], f"append {name}")

    def _read(self, names: list[str]) -> DataFrame:
        # a shard's folder is its own root, so its name doesn't become a column
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/shards/{n}" for n in names])

    def _count(self, names: list[str]) -> dict[str, int]:
        if not names:
            return {}
        run = F.regexp_extract(F.input_file_name(), r"/shards/(.+)/[^/]+$", 1)
        return {r["run"]: r["count"] for r in self._read(names).select(run.alias("run")).groupBy("run").count().collect()}

    def plan(self) -> list[list[Shard]]:
        """Groups of shards to merge: tiers that hold ``fanout`` or more, below the target size; and single shards of small files."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.size < self.target:
                tiers.setdefault(s.tier(self.smallest, self.fanout), []).append(s)
        groups = []
        for _, members in sorted(tiers.items()):
            members.sort(key=lambda s: (s.size, s.name))
            group: list[Shard] = []
            for s in members:
                group.append(s)
                if len(group) >= self.fanout and sum(x.size for x in group) >= min(self.target, self.fanout * group[0].size):
                    groups.append(group)
                    group = []
            if len(group) >= self.fanout:
                groups.append(group)
        merged = {s.name for g in groups for s in g}
        groups += [[s] for s in self.shards() if s.name not in merged and s.files >= 2 * s.wanted(self.target)]
        return groups

    def compact(self) -> bool:
        """Merge the groups of one round of the plan and commit; False if there was nothing to merge."""
        groups = self.plan()
        if not groups:
            return False
        gone = {s.name for g in groups for s in g}

        def merge(group: list[Shard]) -> Shard:
            name = f"m-{uuid.uuid4().hex}"
            files = max(1, round(sum(s.size for s in group) / self.target))
            # a merge moves no row between tasks: each file is written from whole runs
            self._read([s.name for s in group]).coalesce(files).write.parquet(f"{self.path}/shards/{name}")
            return self._shard(name, sum(s.rows for s in group))

        with ThreadPoolExecutor(min(8, len(groups))) as pool:  # Spark runs the merges side by side
            merged = list(pool.map(merge, groups))
        self.change(gone, merged, f"merge {len(gone)} shards into {len(merged)}")
        return True

    def compact_fully(self, vacuum: float | None = None) -> int:
        """Rounds until no tier has enough runs and no run has too many files; ``vacuum``: the grace of a vacuum after each."""
        rounds = 0
        while self.compact():
            rounds += 1
            if vacuum is not None:
                self.vacuum(vacuum)
        return rounds

    def vacuum(self, grace: float = 7 * 24 * 3600.0) -> int:
        """Delete the shards that only versions replaced over ``grace`` seconds ago list, and empty the manifests of these versions.

        Until then each version reads as it was.  The emptied files keep their
        names, so that no late writer takes the number of an old version.  A
        grace of 0 is for a store without readers of older versions.
        """
        order = sorted(self.versions().items())
        # a version is old since its successor was committed
        old = [v for (v, _), (_, replaced) in zip(order, order[1:], strict=False) if replaced <= time.time() - grace]
        kept = {s.name for v, _ in order if v not in old for s in self.shards(v)}
        dead = {s.name for v in old for s in self.shards(v)} - kept
        gone = 0
        for name in sorted(dead):
            fs, p = self._fs(f"{self.path}/shards/{name}")
            gone += bool(fs.delete(p, True))
            top = p.getParent()
            if "/" in name and fs.exists(top) and not any(x.isDirectory() for x in fs.listStatus(top)):
                fs.delete(top, True)
        for v in old:
            fs, p = self._fs(f"{self.path}/manifest/v{v}.json")
            fs.create(p, True).close()
        return gone

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """The rows of a version, with the column ``shard`` if asked."""
        names = [s.name for s in self.shards(version)]
        df = self._read(names) if names else self.spark.createDataFrame([], self.schema)
        return df.withColumn("shard", F.regexp_extract(F.input_file_name(), r"/shards/(.+)/[^/]+$", 1)) if with_shard else df
