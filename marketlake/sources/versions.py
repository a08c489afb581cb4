"""Tables in versions: every commit writes a folder of its own, and one small manifest, moved into place last, makes it current.

A reader pins the version that it opened, so a later commit, or one that breaks off, changes nothing under it. Two writers
that start from the same version cannot both win: the second finds the next manifest there and is told so.

    path/data/<folder>/...           rows of one version, never changed
    path/manifests/000000000007.json {"folder": ..., "saved_at": ..., and facts of the caller's}
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marketlake.sources.files import _at


class Conflict(RuntimeError):
    """Another commit was first."""


@dataclass(frozen=True)
class Version:
    path: str
    number: int
    folder: str
    saved_at: float
    facts: dict = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/data/{self.folder}")

    def age_hours(self) -> float:
        return (time.time() - self.saved_at) / 3600


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, where = _at(spark, f"{path}/manifests")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version by number, or the last one; None where there is none."""
    there = _manifests(spark, path)
    number = number if number is not None else there[-1] if there else None
    if number not in there:
        return None
    fs, where = _at(spark, f"{path}/manifests/{number:012d}.json")
    stream = fs.open(where)
    try:
        said = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(path, number, said.pop("folder"), said.pop("saved_at"), said)


def commit(rows: DataFrame, path: str, after: Version | None = None, partition_by: tuple[str, ...] = (), **facts) -> Version:
    """Write rows as the next version. `after` is the version that they were made from: if it is no longer the last, nothing
    becomes current and Conflict is raised. Without it the version that is last now counts."""
    spark = rows.sparkSession
    base = after.number if after else max(_manifests(spark, path), default=0)
    made = Version(path, base + 1, f"{base + 1:012d}-{uuid.uuid4().hex}", time.time(), facts)
    rows.write.partitionBy(*partition_by).parquet(f"{path}/data/{made.folder}")
    fs, draft = _at(spark, f"{path}/manifests/.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"folder": made.folder, "saved_at": made.saved_at, **facts}).encode()))
    out.close()
    _, final = _at(spark, f"{path}/manifests/{made.number:012d}.json")
    # the move fails where the name is taken; local file systems would replace it, so they are asked first
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {made.number} of {path} is there already")
    return made


def clean_up(spark: SparkSession, path: str, keep: int = 2, least_hours: float = 24.0) -> int:
    """Delete versions but the last `keep`, and folders of commits that broke off, once they are older than that; how many."""
    old = [v for n in _manifests(spark, path)[:-keep] if (v := version(spark, path, n)).age_hours() >= least_hours]
    fs, data = _at(spark, f"{path}/data")
    for v in old:
        fs.delete(_at(spark, f"{path}/manifests/{v.number:012d}.json")[1], False)
    known = {version(spark, path, n).folder for n in _manifests(spark, path)}
    lost = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in known and time.time() - s.getModificationTime() / 1000 >= least_hours * 3600]
    for p in lost:
        fs.delete(p, True)
    return len(lost)
