"""Stored tables that change in one step, and only where a change falls.

Rows lie in hash buckets of a column.  A version of a table is a small file that names, for every bucket, the
folders its rows lie in; whoever reads a table reads the newest version, and the folders it names are never
changed.  A change writes new folders for the buckets it touches and then puts the next version in
place by one rename that refuses to replace a version: until then nobody sees any of it, a job that
fails on the way leaves the table as it was, and of two changes at a time one starts anew from the other's version.

Appending leaves out rows whose key is stored already, so an append that is tried again stores nothing twice.
Patches and deletions read and write the touched buckets only.  Folders that no version names (of failed
changes, or of versions that were forgotten) may be deleted at any time by ``forget``.

The rename must be atomic, as it is on HDFS and on POSIX file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from evidence_lake.operators import quality, tables
from evidence_lake.session import discard, write_out

BUCKETS = 64
#: Changes that start anew because another one was put in place before them.
TRIES = 5
_BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another change was put in place first, again and again."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    key: str
    by: str
    buckets: int
    #: bucket -> folders that hold its rows
    folders: dict[int, tuple[str, ...]]

    def written(self) -> str:
        rest = {"key": self.key, "by": self.by, "buckets": self.buckets, "folders": self.folders}
        return json.dumps({"number": self.number, "schema": self.schema.jsonValue(), **rest})

    @staticmethod
    def parsed(text: str) -> Version:
        v = json.loads(text)
        folders = {int(b): tuple(f) for b, f in v["folders"].items()}
        return Version(v["number"], StructType.fromJson(v["schema"]), v["key"], v["by"], v["buckets"], folders)


class BucketTable:
    """The table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, by: str | None = None, buckets: int = BUCKETS) -> BucketTable:
        """Store ``rows`` as the first version.  ``key`` tells rows apart; ``by``, the column that buckets are made
        from, is the key or something that it decides, such as a parent's key."""
        new = cls(rows.sparkSession, path)
        empty = Version(0, rows.schema, key, by or key, buckets, {})
        new._put(new._filled(empty, rows, ()))
        return new

    # versions ---------------------------------------------------------------------------------

    def _place(self, name: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, files = self._place(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and not n.startswith(("_", "."))]

    def version(self, number: int | None = None) -> Version:
        """The version of this number, or the newest."""
        number = max(self.versions()) if number is None else number
        place, files = self._place(f"versions/{number:012d}.json")
        return Version.parsed(self.spark.read.text(str(place.toString()), wholetext=True).first()[0])

    def _put(self, version: Version) -> None:
        target, files = self._place(f"versions/{version.number:012d}.json")
        draft, _ = self._place(f"versions/_draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        try:
            out.write(bytearray(version.written().encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, never)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception.toString()):
                raise Conflict(f"version {version.number} of {self.path} is there already") from None
            raise

    def _changed(self, change: Callable[[Version], Version | None]) -> Version:
        """The version that ``change`` makes of the newest one (None: no change), put in place."""
        for _ in range(TRIES):
            before = self.version()
            after = change(before)
            if after is None:
                return before
            try:
                self._put(after)
                return after
            except Conflict:
                continue
        raise Conflict(f"{TRIES} changes of {self.path} came too late")

    def forget(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions, and the folders that none of the others names.

        Not while a change is being made: its folders are not named yet.
        """
        numbers = self.versions()
        for number in numbers[:-keep]:
            place, files = self._place(f"versions/{number:012d}.json")
            files.delete(place, False)
        named = {f for n in numbers[-keep:] for of in self.version(n).folders.values() for f in of}
        for folder in self._names("rows"):
            if folder not in named:
                place, files = self._place(f"rows/{folder}")
                files.delete(place, True)

    # rows -------------------------------------------------------------------------------------

    def _bucket(self, version: Version, column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(version.buckets)).cast("int")

    def _rows(self, version: Version, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a version, or of some of its buckets; files of others are not opened."""
        wanted = version.folders if buckets is None else {b: version.folders[b] for b in buckets if b in version.folders}
        by_folder: dict[str, list[int]] = {}
        for bucket, folders in wanted.items():
            for folder in folders:
                by_folder.setdefault(folder, []).append(bucket)
        stored = StructType([*version.schema.fields, StructField(_BUCKET, IntegerType())])
        found = None
        for folder, own in sorted(by_folder.items()):
            part = self.spark.read.schema(stored).parquet(f"{self.path}/rows/{folder}").where(F.col(_BUCKET).isin(own))
            found = part if found is None else found.unionByName(part)
        found = self.spark.createDataFrame([], stored) if found is None else found
        return found.select(*[F.col(f"`{n}`") for n in version.schema.fieldNames()])

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the version of this number, or of the newest."""
        return self._rows(self.version(number))

    def read_like(self, wanted: DataFrame) -> DataFrame:
        """The rows whose bucket column is among ``wanted``'s; only their buckets are read."""
        version = self.version()
        found = self._rows(version, self._touched(version, wanted))
        return found.join(wanted.select(version.by).distinct(), version.by, "left_semi")

    def _filled(self, version: Version, rows: DataFrame, emptied: Iterable[int]) -> Version:
        """The next version, in which ``rows`` are added and what was in the ``emptied`` buckets is gone."""
        folder = uuid.uuid4().hex
        rows = rows.select(*[F.col(f"`{n}`") for n in version.schema.fieldNames()])
        placed = rows.withColumn(_BUCKET, self._bucket(version, F.col(version.by)))
        # large buckets are split into several files
        placed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/rows/{folder}")
        filled = [int(n.partition("=")[2]) for n in self._names(f"rows/{folder}") if n.startswith(f"{_BUCKET}=")]
        folders = {b: f for b, f in version.folders.items() if b not in set(emptied)}
        for bucket in filled:
            folders[bucket] = (*folders.get(bucket, ()), folder)
        return Version(version.number + 1, version.schema, version.key, version.by, version.buckets, folders)

    def _touched(self, version: Version, rows: DataFrame) -> list[int]:
        """Buckets of rows that have the bucket column, or else of the stored rows that have their keys."""
        if version.by in rows.columns:
            found = rows.select(self._bucket(version, F.col(version.by)).alias(_BUCKET))
        else:
            stored = self._rows(version).select(version.key, version.by)
            found = stored.join(rows.select(version.key).distinct(), version.key, "left_semi")
            found = found.select(self._bucket(version, F.col(version.by)).alias(_BUCKET))
        return [r[0] for r in found.distinct().collect()]  # one per bucket at most

    # changes ----------------------------------------------------------------------------------

    def append(self, rows: DataFrame, rules: quality.Rules | None = None) -> Version:
        """Add the rows whose key is not stored yet, all or none; one that breaks a rule fails the append.

        Of rows with one key one is stored.  Rows without a key are always added.
        """
        rows = quality.enforce(rows, rules) if rules else rows
        rows = write_out(rows, "appended-rows")

        def change(version: Version) -> Version | None:
            keyed = rows.where(F.col(version.key).isNotNull()).dropDuplicates([version.key])
            known = self._rows(version, self._touched(version, rows)).select(version.key)
            new = keyed.join(known, version.key, "left_anti").unionByName(rows.where(F.col(version.key).isNull()))
            return None if new.isEmpty() else self._filled(version, new, ())

        try:
            return self._changed(change)
        finally:
            discard(rows)

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Version:
        """Replace the rows of the buckets that ``keys`` (with the key or the bucket column) fall into by what
        ``change`` makes of them."""

        def changed(version: Version) -> Version | None:
            touched = [b for b in self._touched(version, keys) if b in version.folders]
            return self._filled(version, change(self._rows(version, touched)), touched) if touched else None

        return self._changed(changed)

    def patch(
        self, changes: DataFrame, updated: str | None = "updated_at", at: Column | None = None, rules: quality.Rules | None = None
    ) -> Version:
        """Partial changes, see :func:`evidence_lake.operators.tables.patch`."""
        key = self.version().key
        return self.rewrite(changes, lambda rows: tables.patch(rows, changes, key, updated, at, rules))

    def delete(self, doomed: DataFrame, on: str | None = None) -> Version:
        """Delete the rows whose ``on`` (the key, if not said) is among ``doomed``'s."""
        on = on or self.version().key
        return self.rewrite(doomed, lambda rows: rows.join(doomed.select(on).distinct(), on, "left_anti"))


def cascade_delete(
    researches: BucketTable, documents: BucketTable, chunks: BucketTable, doomed: DataFrame
) -> tuple[Version, Version, Version]:
    """Delete ``doomed`` researches (with their key) with their documents and the documents' chunks.

    ``documents`` must be bucketed by their research, ``chunks`` by their document.  Chunks go first and researches
    last, so that no reader meets a row without its parent, and a cascade that died can be run again.
    """
    research, document = researches.version(), documents.version()
    gone = doomed.select(research.key).distinct()
    parents = gone.withColumnRenamed(research.key, document.by)
    lost = write_out(documents.read_like(parents).select(document.key), "doomed-documents")
    part_of = chunks.version().by
    after = (
        chunks.delete(lost.withColumnRenamed(document.key, part_of), part_of),
        documents.delete(parents, document.by),
        researches.delete(gone, research.key),
    )
    discard(lost)
    return after[::-1]
