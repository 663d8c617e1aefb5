"""Committed state of a stream: numbered JSON files, the highest of which holds.

A version is written under a temporary name and renamed, so a reader sees a whole version or none.
One process at a time may run a stream; a version that already exists is an error, not overwritten.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

#: Earlier versions that stay for inspection.
KEPT_VERSIONS = 10


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; a missing folder is empty."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a whole folder or file. False if the target is there already (the source is removed then)."""
    fs, to = _fs(spark, target)
    if fs.exists(to):
        delete(spark, source)
        return False
    fs.mkdirs(to.getParent())
    if not fs.rename(_fs(spark, source)[1], to):
        raise OSError(f"could not rename {source} to {target}")
    return True


@dataclass(frozen=True)
class State:
    """``arrivals``: number of the next arrival. ``generation``: folder of the known ids. ``folded``: the last
    epoch whose ids are part of the generation's base. ``epochs``: committed epochs after it. ``stream``:
    id of the checkpoint whose epochs these are."""

    version: int = 0
    arrivals: int = 0
    generation: str = "known-0"
    folded: int = -1
    epochs: list[int] = field(default_factory=list)
    stream: str | None = None

    def committed(self, epoch: int) -> bool:
        return epoch <= self.folded or epoch in self.epochs


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root}/manifest"

    def _versions(self) -> list[str]:
        return [n for n in names(self.spark, self.folder) if n.startswith("v") and n.endswith(".json")]

    def read(self) -> State:
        found = self._versions()
        return State(**json.loads(read_text(self.spark, f"{self.folder}/{found[-1]}"))) if found else State()

    def commit(self, state: State, **changes) -> State:
        """Write the next version with ``changes``."""
        new = replace(state, version=state.version + 1, **changes)
        temporary = f"{self.folder}/_{uuid.uuid4().hex}"
        fs, p = _fs(self.spark, temporary)
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            out.close()
        if not move(self.spark, temporary, f"{self.folder}/v{new.version:012d}.json"):
            raise RuntimeError(f"another process committed version {new.version} of {self.folder}")
        for old in self._versions()[:-KEPT_VERSIONS]:
            delete(self.spark, f"{self.folder}/{old}")
        return new
