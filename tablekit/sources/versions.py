"""Tables that change as a whole: files are written aside, then one small file names them.

A root folder holds data folders, which are never changed, and a log of versions. A
version is a file that lists the files of every table. It appears by one rename, so a
reader sees all of a change or nothing of it, and a writer that dies midway leaves data
that no version names. Two writers that start from the same version cannot both publish:
the second finds its number taken. Renames have to be atomic, as on HDFS or a local disk.

A version's list is as long as the listing that any scan of its files holds in the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOG = "_versions"
_NAME = re.compile(r"^(\d{20})\.json$")


SHOWN = "shown"


def shown_as(name: str) -> dict[str, str]:
    """Metadata of a column whose files have another name for it."""
    return {SHOWN: name}


class VersionConflict(RuntimeError):
    """Another writer has published since."""


@dataclass(frozen=True)
class Version:
    number: int
    files: Mapping[str, tuple[str, ...]]
    schemas: Mapping[str, str]


EMPTY = Version(0, {}, {})


class Versions:
    """The tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _system(self):
        return self._path().getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """Numbers of all versions, oldest first."""
        folder, system = self._path(LOG), self._system()
        if not system.exists(folder):
            return []
        found = [_NAME.match(entry.getPath().getName()) for entry in system.listStatus(folder)]
        return sorted(int(m[1]) for m in found if m)

    def version(self, number: int | None = None) -> Version:
        """A version, by default the latest; one without tables where there is none."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return EMPTY
            number = numbers[-1]
        stream = self._system().open(self._path(LOG, f"{number:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        files = {name: tuple(paths) for name, paths in held["files"].items()}
        return Version(number, files, held["schemas"])

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """Rows of a table as a version has them."""
        held = self.version(number)
        if name not in held.files:
            raise KeyError(f"Unknown table: {name}")
        schema = T.StructType.fromJson(json.loads(held.schemas[name]))
        paths = [f"{self.root}/{path}" for path in held.files[name]]
        reader = self.spark.read.schema(schema)
        rows = reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        renamed = [f for f in schema.fields if SHOWN in f.metadata]
        return rows.withColumnsRenamed({f.name: f.metadata[SHOWN] for f in renamed}) if renamed else rows

    def new_folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> tuple[str, ...]:
        """Rows as new files that no version names yet; returns them, relative to the root."""
        folder = self.new_folder()
        rows.write.parquet(f"{self.root}/{folder}")
        return self.files_of(folder)

    def files_of(self, folder: str) -> tuple[str, ...]:
        """Files under a folder below the root; none where there is no such folder."""
        if not self._system().exists(self._path(*folder.split("/"))):
            return ()
        base = self._system().makeQualified(self._path()).toString()
        listing = self._system().listFiles(self._path(*folder.split("/")), True)
        found = []
        while listing.hasNext():
            path = listing.next().getPath()
            if not path.getName().startswith(("_", ".")):
                found.append(path.toString().removeprefix(base).lstrip("/"))
        return tuple(sorted(found))

    def publish(
        self, files: Mapping[str, Sequence[str]], schemas: Mapping[str, T.StructType], after: Version
    ) -> Version:
        """A new version: that of ``after`` with the given tables exchanged."""
        fresh = Version(
            after.number + 1,
            {**after.files, **{name: tuple(paths) for name, paths in files.items()}},
            {**after.schemas, **{name: schema.json() for name, schema in schemas.items()}},
        )
        system, number = self._system(), f"{fresh.number:020d}.json"
        aside, target = self._path(LOG, f"_{uuid.uuid4().hex}"), self._path(LOG, number)
        stream = system.create(aside)
        try:
            stream.write(json.dumps({"files": fresh.files, "schemas": fresh.schemas}).encode())
        finally:
            stream.close()
        # Without the option to overwrite, a rename fails where the number is taken.
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        context = self._hadoop.FileContext.getFileContext(system.getUri(), self._conf)
        try:
            context.rename(system.makeQualified(aside), system.makeQualified(target), options)
        except Exception as error:
            system.delete(aside, False)
            if system.exists(target):
                raise VersionConflict(f"Version {fresh.number} of {self.root} is published already.") from error
            raise
        return fresh
