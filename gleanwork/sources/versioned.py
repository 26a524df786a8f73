"""Tables whose writes appear whole or not at all.

A table is a folder of Parquet parts and of manifests, one for each version,
that name the parts which belong to it. A write first stages its part with
Spark's own committer and then publishes the next manifest by a rename that
fails if that version exists. Readers see manifests only. So a job that breaks
off leaves the table as it was, and of two writers from one version one has to
look at the other's rows before it can publish.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.operators.store import without_done


class Conflict(Exception):
    """Another writer has published the version in the meantime."""


def _observed(seen: Observation, rows: DataFrame) -> int:
    """The observed count; counted again where the planner has left the observation out, as it does where nothing is new."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return rows.count()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---

    def version(self) -> int:
        """Latest version; 0 for a table without rows that nothing has written."""
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def parts(self, version: int) -> list[str]:
        """Folders of the parts of a version."""
        if version == 0:
            return []
        stream = self._fs.open(self._at(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _publish(self, base: int, parts: list[str]) -> int:
        """Make ``parts`` the version after ``base``, or fail if there is one already."""
        text = json.dumps({"version": base + 1, "parts": parts})
        staged, final = f"{self.path}/versions/.{uuid.uuid4().hex}", self._manifest(base + 1)
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        out = self._fs.create(self._at(staged), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":  # there a rename replaces what is there; a link does not
            local = lambda p: self._at(p).toUri().getPath()
            try:
                os.link(local(staged), local(final))
                done = True
            except FileExistsError:
                done = False
            self._fs.delete(self._at(staged), False)
        else:
            done = self._fs.rename(self._at(staged), self._at(final))
            if not done:
                self._fs.delete(self._at(staged), False)
        if not done:
            raise Conflict(f"version {base + 1} of {self.path} has been published by another writer")
        return base + 1

    # --- rows ---

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the latest or of a given version."""
        return self._rows(self.parts(self.version() if version is None else version))

    def _rows(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def stage(self, rows: DataFrame) -> str:
        """Write rows as a part that no version names yet; a failed job's files are removed."""
        part = f"parts/{uuid.uuid4().hex}"
        try:
            rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/{part}")
        except Exception:
            self.drop(part)
            raise
        return part

    def drop(self, part: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{part}"), True)

    def append(self, rows: DataFrame, base: int | None = None) -> int:
        """Add rows to version ``base`` (the latest) as the next version; ``Conflict`` if it has a successor already, and nothing stays."""
        base = self.version() if base is None else base
        part = self.stage(rows)
        try:
            return self._publish(base, [*self.parts(base), part])
        except Conflict:
            self.drop(part)
            raise

    def insert_new(self, rows: DataFrame, key: str, *order: Column | str, tries: int = 10, before_publish: Callable[[], None] | None = None) -> tuple[int, int]:
        """Add the rows whose ``key`` the table does not hold; returns how many, and how many were left out.

        Of rows with one key the first by ``order`` counts; rows without key
        never conflict. Where another writer publishes first, only its parts
        are held against the staged rows, and the rest is published after it.
        ``before_publish`` is called before each try, for tests.
        """
        seen = Observation()
        rows = rows.observe(seen, F.count("*").alias("n"))
        # rows without key all stay; they are spread by what they hold
        keyless = F.col(key).isNull()
        apart = F.when(keyless, F.xxhash64(F.to_json(F.struct(*self.schema.fieldNames()))))
        numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, apart).orderBy(*order)))
        first = numbered.where(keyless | (F.col("_n") == 1))
        base = self.version()
        known = self.parts(base)
        part = self.stage(without_done(first, self._rows(known), key))
        for _ in range(tries):
            if before_publish:
                before_publish()
            try:
                self._publish(base, [*known, part])
                inserted = self._rows([part]).count()
                return inserted, _observed(seen, rows) - inserted
            except Conflict:
                base = self.version()
                later = [p for p in self.parts(base) if p not in known]
                known = self.parts(base)
                again = self.stage(without_done(self._rows([part]), self._rows(later), key))
                self.drop(part)
                part = again
        self.drop(part)
        raise Conflict(f"gave up after {tries} tries")

    def append_once(self, rows: DataFrame, name: str) -> bool:
        """Add rows as a part of this name; nothing happens if the table has it, as when a batch of a stream comes again."""
        base = self.version()
        known = self.parts(base)
        if f"parts/{name}" in known:
            return False
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/parts/{name}")
        self._publish(base, [*known, f"parts/{name}"])
        return True

    def vacuum(self) -> int:
        """Remove parts that no version names; returns how many. Not while others write."""
        folder = self._at(f"{self.path}/parts")
        if not self._fs.exists(folder):
            return 0
        named = {p for v in range(1, self.version() + 1) for p in self.parts(v)}
        loose = [p for p in (f"parts/{f.getPath().getName()}" for f in self._fs.listStatus(folder)) if p not in named]
        for p in loose:
            self.drop(p)
        return len(loose)
