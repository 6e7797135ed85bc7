"""Tables of current states: appended changes, and snapshots of what they come to.

    <path>/changes     Parquet files of changes, appended by the jobs
    <path>/snapshots   current rows, in a folder for each compaction, day and state
    <path>/manifests   a small file for each compaction: the snapshot folders that hold, and the change files that are in them

A change is a whole (narrow) row of its key, so a reader needs no other table.
It takes the snapshot folders of the states it asks for, leaves out keys that
changed since, and adds their last changes; how long the history is doesn't
matter. A compaction makes new folders for the days whose keys changed, then
publishes the next manifest in one step: if it dies before, nothing has
happened, and what it wrote is left for `vacuum`. Of two compactions at once
the second to publish gives up.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Keys that changed since the last compaction, up to so many, are broadcast to the snapshots.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Manifest:
    """Which folders hold (day, state), and which change files they include."""

    version: int = 0
    folders: dict[tuple[str, str], str] = field(default_factory=dict)
    changes: frozenset[str] = frozenset()

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "folders": [[*at, folder] for at, folder in sorted(self.folders.items())], "changes": sorted(self.changes)})

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], {(day, state): folder for day, state, folder in d["folders"]}, frozenset(d["changes"]))


@dataclass(frozen=True)
class States:
    """A state table.

    schema: columns of a change; key: what has a state; state: the column that
    tells it; since: a timestamp of the key that never changes, whose day parts
    the snapshots; order: SQL by which the last change of a key is known;
    constant: columns that are the same in all changes of a key that have them;
    closed: a state that nothing leaves, and the columns that snapshots drop then.
    """

    path: str
    schema: str
    key: str
    state: str
    since: str
    order: str
    constant: tuple[str, ...] = ()
    closed: tuple[str, tuple[str, ...]] = ("", ())

    def append(self, changes: DataFrame) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        changes.select(*names).write.mode("append").parquet(f"{self.path}/changes")

    def manifest(self, spark: SparkSession) -> Manifest:
        """The last one that was published."""
        names = files.data_files(spark, f"{self.path}/manifests")
        return Manifest.from_json(files.read_text(spark, f"{self.path}/manifests/{names[-1]}")) if names else Manifest()

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _new_files(self, spark: SparkSession, manifest: Manifest) -> list[str]:
        return [name for name in files.data_files(spark, f"{self.path}/changes") if name not in manifest.changes]

    def _last(self, changes: DataFrame) -> DataFrame:
        """The last change of each key: whole rows, found by an aggregate."""
        rest = [c for c in changes.columns if c not in (self.key, *self.constant)]
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.expr(self.order)).alias("last_"), *(F.max(c).alias(c) for c in self.constant))
        return last.select(*(F.col(f"last_.{c}").alias(c) if c in rest else c for c in changes.columns))

    def current(self, spark: SparkSession, states: list[str] | None = None, days: list[str] | None = None) -> DataFrame:
        """Rows in one of the states (None: any); days: only keys of these days need be found."""
        m = self.manifest(spark)
        fits = lambda day, state: (states is None or state in states) and (days is None or day in days)
        kept = self._read(spark, [f"{self.path}/snapshots/{folder}" for at, folder in m.folders.items() if fits(*at)])
        new = self._new_files(spark, m)
        if not new:
            return kept
        changes = self._read(spark, [f"{self.path}/changes/{name}" for name in new])
        last = self._last(changes)
        keys = changes.select(self.key)
        if changes.count() <= BROADCAST_ROWS:  # from the files' footers
            keys = F.broadcast(keys)
        rows = kept.join(keys, self.key, "left_anti").select(*kept.columns).unionByName(last)
        return rows if states is None else rows.where(F.col(self.state).isin(states))

    def compact(self, spark: SparkSession) -> int | None:
        """Bring the changes into new snapshot folders; the new version, or None where there is nothing to do or another was faster."""
        m = self.manifest(spark)
        new = self._new_files(spark, m)
        if not new:
            return None
        last = self._last(self._read(spark, [f"{self.path}/changes/{name}" for name in new]))
        day = F.coalesce(F.to_date(self.since).cast("string"), F.lit("none"))
        days = {r[0] for r in last.select(day).distinct().collect()}
        old = self._read(spark, [f"{self.path}/snapshots/{folder}" for at, folder in m.folders.items() if at[0] in days])
        # the order tells which is later, a change or what the snapshot has: an initial change that comes again loses
        merged = self._last(old.unionByName(last)).withColumn("day_", day).withColumn("state_", F.coalesce(self.state, F.lit("none")))
        state, dropped = self.closed
        merged = merged.withColumns({c: F.when(F.col(self.state) != state, F.col(c)) for c in dropped})
        folder = f"{m.version + 1:08d}-{uuid.uuid4().hex}"
        merged.repartition("day_", "state_", F.pmod(F.xxhash64(self.key), F.lit(16))).sortWithinPartitions("day_", "state_", self.key).write.partitionBy("day_", "state_").parquet(f"{self.path}/snapshots/{folder}")
        folders = {at: where for at, where in m.folders.items() if at[0] not in days}
        for day_name in (d for d, is_folder in files.listing(spark, f"{self.path}/snapshots/{folder}").items() if is_folder):
            for state_name in files.listing(spark, f"{self.path}/snapshots/{folder}/{day_name}"):
                folders[day_name.removeprefix("day_="), state_name.removeprefix("state_=")] = f"{folder}/{day_name}/{state_name}"
        there = set(files.data_files(spark, f"{self.path}/changes"))
        after = Manifest(m.version + 1, folders, frozenset((m.changes & there) | set(new)))
        published = files.publish(spark, f"{self.path}/manifests/{after.version:08d}", after.to_json())
        return after.version if published else None

    def vacuum(self, spark: SparkSession) -> None:
        """Delete change files that snapshots include, and folders of no use. Not while readers or compactions are under way."""
        m = self.manifest(spark)
        for name in m.changes:
            files.delete(spark, f"{self.path}/changes/{name}")
        used = {folder.split("/")[0] for folder in m.folders.values()}
        for name in files.listing(spark, f"{self.path}/snapshots"):
            if name not in used:
                files.delete(spark, f"{self.path}/snapshots/{name}")
        for name in files.data_files(spark, f"{self.path}/manifests")[:-1]:
            files.delete(spark, f"{self.path}/manifests/{name}")
