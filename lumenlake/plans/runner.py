"""Stages of a study that survive a stop: what is committed is not run again.

A stage is a named function of tables and parameters.  Its table is written to the
study's folder and then entered into a manifest -- a small file a stage, put in place by
one rename, with the digests of what it was made from and of what it made.  A rerun
takes a stage from the manifest if name, parameters and the digests of its inputs are
the same, and runs it otherwise; so a changed input or parameter also reruns what
follows.  All files go through Hadoop's file system, so the folder may be any that
driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(frame: DataFrame) -> tuple[int, str]:
    """Rows, and a digest that does not depend on their order: sums of two hashes of each row, in one aggregate."""
    row = F.to_json(F.struct(*[frame[c] for c in sorted(frame.columns)]), {"ignoreNullFields": "false"})
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    got = frame.select(F.xxhash64(row).alias("a"), F.hash(row).alias("b")).agg(F.count(F.lit(1)).alias("n"), wide(F.col("a")).alias("a"), wide(F.col("b")).alias("b")).first()
    return got["n"], hashlib.sha256(f"{sorted(frame.dtypes)}|{got['n']}|{got['a']}|{got['b']}".encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    """A stage's table and its entry in the manifest."""

    name: str
    table: DataFrame
    entry: dict

    @property
    def digest(self) -> str:
        return self.entry["output"]


class Runner:
    """Runs the stages of a study in a folder, or takes them from its manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: names of the stages that this run computed, and that it found
        self.computed: list[str] = []
        self.found: list[str] = []

    def _path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        target, files = self._path(f"{self.folder}/manifest/{name}.json")
        if not files.exists(target):
            return None
        stream = files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _enter(self, entry: dict) -> None:
        """One rename puts the entry in place; a stop before it leaves the old one."""
        target, files = self._path(f"{self.folder}/manifest/{entry['stage']}.json")
        fresh, _ = self._path(f"{self.folder}/manifest/.{entry['stage']}-{uuid.uuid4().hex}")
        stream = files.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            stream.close()
        if files.exists(target):
            files.delete(target, False)
        if not files.rename(fresh, target):
            raise OSError(f"the manifest of {entry['stage']} could not be put in place")

    def run(self, name: str, function: Callable[..., DataFrame], inputs: Mapping[str, Stage] | None = None, **parameters) -> Stage:
        """The stage's table: ``function(**tables of the inputs, **parameters)``, unless the manifest has it.

        A stage that fails is entered as failed with its reason, and the error goes on.
        """
        inputs = dict(inputs or {})
        made_from = {"parameters": json.loads(json.dumps(parameters, sort_keys=True, default=list)), "inputs": {k: s.digest for k, s in sorted(inputs.items())}}
        entry = self._read(name)
        if entry and entry["status"] == "committed" and entry["made_from"] == made_from:
            self.found.append(name)
            return Stage(name, self.spark.read.parquet(entry["path"]), entry)
        path, began = f"{self.folder}/tables/{name}-{uuid.uuid4().hex}", time.time()
        try:
            function(**{k: s.table for k, s in inputs.items()}, **parameters).write.parquet(path)
            table = self.spark.read.parquet(path)
            rows, digest = content_digest(table)
        except Exception as error:
            self._enter({"stage": name, "status": "failed", "made_from": made_from, "reason": f"{type(error).__name__}: {str(error)[:500]}"})
            raise
        entry = {"stage": name, "status": "committed", "made_from": made_from, "path": path, "rows": rows, "output": digest, "seconds": round(time.time() - began, 3)}
        self._enter(entry)
        self.computed.append(name)
        return Stage(name, table, entry)

    def ledger(self) -> DataFrame:
        """stage, status, rows, reason of every entry of the manifest (a row a stage)."""
        target, files = self._path(f"{self.folder}/manifest")
        names = sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []
        entries = [self._read(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        return self.spark.createDataFrame([(e["stage"], e["status"], e.get("rows"), e.get("reason")) for e in entries], "stage string, status string, rows long, reason string")
