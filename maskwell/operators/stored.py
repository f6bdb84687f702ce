"""Stored tables that change: keyed rows in buckets, and versions that appear whole or not at all.

A table is a folder with Parquet data and numbered manifests. A manifest names the folder of
every bucket. A change writes the buckets that it touches to a new folder, and the table changes
in the one moment when the next manifest gets its name. A writer that stops before leaves the
table as it was; a writer whose version is no longer the last is refused. Readers keep the
version that they opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.shared import materialize, release

BUCKET = "_bucket"


class StaleWrite(RuntimeError):
    """Another writer committed after this version of the table was opened."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@dataclass(frozen=True)
class StoredTable:
    """One version of a stored table. ``folders`` maps the buckets that have rows to their data."""

    spark: SparkSession
    path: str
    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: T.StructType
    folders: dict[int, str]

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> StoredTable:
        """Store ``rows`` as version 1; of rows with the same keys any one is kept. A table that exists is refused."""
        empty = cls(rows.sparkSession, path, 0, tuple(keys), buckets, rows.schema, {})
        return empty.replaced(rows)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredTable:
        """The last version."""
        where, files = _files(spark, f"{path}/manifests")
        if not files.exists(where):
            raise FileNotFoundError(f"no stored table at {path}")
        names = [f.getPath().getName() for f in files.listStatus(where)]
        version = max(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))
        found = json.loads(_read_text(spark, f"{path}/manifests/{version:012d}.json"))
        folders = {int(k): v for k, v in found["folders"].items()}
        return cls(spark, path, version, tuple(found["keys"]), found["buckets"], T.StructType.fromJson(found["schema"]), folders)

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """All rows of this version, or those of some buckets."""
        paths = [f"{self.path}/{f}" for b, f in sorted(self.folders.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upserted(self, updates: DataFrame, order: str | None = None) -> StoredTable:
        """The next version, with ``updates`` in place of rows of the same keys; the last by ``order`` wins.

        Updates that equal what is stored change nothing: without others no version is made.
        Null keys are keys like any other. Only buckets of real changes are read and written.
        """
        columns = self.schema.names
        if order is not None:
            rest = [c for c in columns if c not in self.keys]
            last = updates.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("_u"))
            updates = last.select(*self.keys, *[F.col(f"_u.{c}").alias(c) for c in rest])
        else:
            updates = updates.dropDuplicates(list(self.keys))
        updates = updates.select(*columns)
        old = self.rows().alias("old")
        same = None
        for c in columns:
            test = F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
            same = test if same is None else same & test
        changed = materialize(updates.alias("new").join(old, same, "left_anti").select("new.*"), "changes")
        next_version = self._with(changed, lambda stored: merged_null_safe(stored, changed, list(self.keys)))
        release(changed)
        return next_version

    def deleted(self, gone: DataFrame) -> StoredTable:
        """The next version, without the rows of the keys of ``gone``."""
        keys = gone.select(*self.keys).distinct()
        hit = materialize(_matching(self.rows(), keys, list(self.keys), "left_semi").select(*self.keys), "deletions")
        next_version = self._with(hit, lambda stored: _matching(stored, hit, list(self.keys), "left_anti"))
        release(hit)
        return next_version

    def replaced(self, rows: DataFrame) -> StoredTable:
        """The next version, with ``rows`` instead of all there is."""
        return self._commit(self._write(rows.dropDuplicates(list(self.keys)).select(*self.schema.names)))

    def _with(self, changes: DataFrame, change) -> StoredTable:
        # One row per bucket, and buckets are a fixed number.
        touched = [r[0] for r in changes.select(self._bucket()).distinct().collect()]
        if not touched:
            return self
        written = self._write(change(self.rows(touched)))
        kept = {b: f for b, f in self.folders.items() if b not in touched}
        return self._commit({**kept, **written})

    def _write(self, rows: DataFrame) -> dict[int, str]:
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        where, files = _files(self.spark, f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self, folders: dict[int, str]) -> StoredTable:
        found = replace(self, version=self.version + 1, folders=folders)
        manifest = {"keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue(), "folders": folders}
        self._publish(found.version, json.dumps(manifest))
        return found

    def _publish(self, version: int, text: str) -> None:
        """Give a manifest its name, unless another has it: the whole commit is this one rename."""
        folder, files = _files(self.spark, f"{self.path}/manifests")
        files.mkdirs(folder)
        fs = self.spark._jvm.org.apache.hadoop.fs
        draft = fs.Path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = fs.Path(f"{self.path}/manifests/{version:012d}.json")
        context = fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        none[0] = fs.Options.Rename.NONE
        try:
            context.rename(draft, target, none)
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise StaleWrite(f"version {version} of {self.path} exists already") from None
            raise

    def vacuumed(self) -> int:
        """Delete data that this version does not name, left by older versions and broken writers. Number of folders.

        For times without other readers and writers.
        """
        used = {f.split("/")[1] for f in self.folders.values()}
        partly = {f for f in self.folders.values()}
        where, files = _files(self.spark, f"{self.path}/data")
        gone = 0
        for folder in files.listStatus(where):
            name = folder.getPath().getName()
            if name not in used:
                files.delete(folder.getPath(), True)
                gone += 1
                continue
            for bucket in files.listStatus(folder.getPath()):
                at = bucket.getPath().getName()
                if at.startswith(f"{BUCKET}=") and f"data/{name}/{at}" not in partly:
                    files.delete(bucket.getPath(), True)
                    gone += 1
        return gone


def _matching(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    test = None
    for c in names:
        one = F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
        test = one if test is None else test & one
    return rows.alias("r").join(keys.alias("k"), test, how)


def merged_null_safe(rows: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``updates`` (one per key) in place of rows of the same keys, null keys included."""
    return _matching(rows, updates, keys, "left_anti").unionByName(updates)


def verdicts(store: StoredTable, asked: DataFrame, ask, now: Column, most: int) -> tuple[StoredTable, DataFrame]:
    """Answers to ``asked`` (``context``, ...) from a stored table of verdicts, and the table after that.

    The table has ``digest``, ``spans`` (array of ``s``, ``e`` relative to the context) and
    ``used``. Contexts are known by their content: only those that the table lacks go to
    ``ask``, which adds ``spans`` to a table of ``digest``, ``context``. All that is used gets the time
    ``now``, and of more than ``most`` verdicts the longest unused go.
    """
    digest = F.sha2(F.coalesce("context", F.lit("")), 256)
    keyed = asked.withColumn("digest", digest)
    wanted = keyed.select("digest", F.coalesce("context", F.lit("")).alias("context")).dropDuplicates(["digest"])
    known = store.rows()
    unseen = wanted.join(known.select("digest"), "digest", "left_anti")
    fresh = materialize(ask(unseen).select("digest", "spans"), "verdicts")
    hit = known.join(wanted.select("digest"), "digest", "left_semi").select("digest", "spans")
    used = materialize(hit.unionByName(fresh).withColumn("used", now), "used-verdicts")
    grown = store.upserted(used)
    # The time of the last verdict that stays, by counting times: one row per distinct time.
    times = grown.rows().groupBy("used").agg(F.count("*").alias("n")).orderBy(F.desc("used"))
    left = most
    oldest = None
    for row in times.toLocalIterator():
        left -= row.n
        if left < 0:
            break
        oldest = row.used
    if left < 0:
        stale = grown.rows() if oldest is None else grown.rows().where(F.col("used") < F.lit(oldest))
        grown = grown.deleted(stale)
    return grown, keyed.join(used.select("digest", "spans"), "digest")
