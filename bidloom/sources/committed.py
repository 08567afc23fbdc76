"""Keyed tables with versions that commit: a write touches only the buckets of its keys, and readers take a version.

A table is a folder of Parquet files. Rows are dealt to buckets by a hash of their keys; a manifest, itself a Parquet table,
lists the files of each bucket with their rows. A commit is one small file ``commits/<version>.json`` that names a manifest: it
is written aside and renamed to a name that must not exist, so a version is there whole or not at all, whatever a killed
write leaves in ``data`` and ``manifests``. Of two writers that make the same version the second fails and may try again.

A write says from which writer and batch it comes; a batch that the table has already is left out, so a stream that is run
again from its checkpoint repeats nothing. Data files hold the hash of each row's key and are sorted by it: an insert reads
only this column of the buckets that its keys fall in, and the key columns of those where a hash meets, then appends. Other
writes rewrite the buckets that they touch. ``compact`` brings a bucket's many files together again.

Keys are unique; null keys are keys like others. Rows without a match, empty batches and repeated batches change nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut

HASH, BUCKET = "_key_hash", "_bucket"
MANIFEST = "bucket int, file string, rows long, low array<double>, high array<double>"


class CommitConflict(RuntimeError):
    """Another writer has made the version already."""


@dataclass(frozen=True)
class Commit:
    version: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    manifest: str | None = None
    writers: dict[str, int] = field(default_factory=dict)  # the last batch of each writer
    touched: tuple[int, ...] = ()
    rewritten: bool = False
    zones: tuple[str, ...] = ()
    applied: tuple[str, ...] = ()  # the change sets that made the schema


@dataclass(frozen=True)
class ChangeSet:
    """One step of a schema's history: columns to add (DDL), null in the rows that are there, or a copy of all rows into
    other columns, which must keep the keys."""

    id: str
    add: str | None = None
    copy: Callable[[DataFrame], DataFrame] | None = None


class _Folder:
    """Small files of a Hadoop file system, by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop, self.path, self.gateway = spark._jvm.org.apache.hadoop.fs, path, spark.sparkContext._gateway
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.system = self.hadoop.Path(path).getFileSystem(self.conf)

    def names(self) -> list[str]:
        folder = self.hadoop.Path(self.path)
        return sorted(s.getPath().getName() for s in self.system.listStatus(folder)) if self.system.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.hadoop.Path(f"{self.path}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Whether the file could be made under a name that wasn't there."""
        aside, final = self.hadoop.Path(f"{self.path}/.{name}.{uuid.uuid4().hex}"), self.hadoop.Path(f"{self.path}/{name}")
        stream = self.system.create(aside, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        none = self.gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            self.hadoop.FileContext.getFileContext(aside.toUri(), self.conf).rename(aside, final, none)
        except Py4JJavaError as e:
            self.system.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = _Folder(spark, f"{self.path}/commits")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 64, zones: tuple[str, ...] = ()) -> CommittedTable:
        """An empty table; one that is there stays as it is. The manifest holds the bounds of each file's ``zones``, columns of
        numbers or times."""
        shape = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        if missing := [k for k in (*keys, *zones) if k not in shape.fieldNames()]:
            raise ValueError(f"no columns {missing}")
        table = cls(spark, path)
        first = Commit(0, shape.json(), tuple(keys), buckets, zones=tuple(zones))
        table.folder.put(table._name(0), json.dumps(first.__dict__))
        return table

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:020d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names() if n.endswith(".json") and not n.startswith(".")]

    def commit(self, version: int | None = None) -> Commit:
        known = json.loads(self.folder.read(self._name(self.versions()[-1] if version is None else version)))
        return Commit(**known | {"keys": tuple(known["keys"]), "touched": tuple(known["touched"]), "zones": tuple(known["zones"]), "applied": tuple(known["applied"])})

    # --- Reading ------------------------------------------------------------------------------------------------------

    def bucket(self, commit: Commit | None = None) -> Column:
        c = commit or self.commit()
        return F.pmod(F.xxhash64(*c.keys), F.lit(c.buckets)).cast("int")

    def manifest(self, commit: Commit) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{commit.manifest}") if commit.manifest else self.spark.createDataFrame([], MANIFEST)

    def files(self, commit: Commit, buckets: list[int] | None = None) -> list[str]:
        """The data files of some buckets, or of all."""
        rows = self.manifest(commit)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return [f"{self.path}/{r['file']}" for r in rows.select("file").collect()]

    def _rows(self, commit: Commit, files: list[str], hashed: bool = False) -> DataFrame:
        shape = StructType.fromJson(json.loads(commit.schema))
        shape = shape.add(HASH, "long") if hashed else shape
        return self.spark.read.schema(shape).parquet(*files) if files else self.spark.createDataFrame([], shape)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A version's rows, of some buckets or all; a version that is read stays as it was."""
        commit = self.commit(version)
        return self._rows(commit, self.files(commit, buckets))

    def find(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of some keys; only the buckets of these are read."""
        commit = self.commit(version)
        wanted = cut(keys.select(*commit.keys).distinct(), "wanted-keys")
        touched = [r[0] for r in wanted.select(self.bucket(commit)).distinct().collect()]
        return _null_safe(self._rows(commit, self.files(commit, touched)), wanted, commit.keys, "left_semi")

    # --- Writing ------------------------------------------------------------------------------------------------------

    def _done(self, commit: Commit, writer: str | None, batch: int) -> bool:
        return writer is not None and commit.writers.get(writer, -1) >= batch

    def _publish(self, before: Commit, rows: DataFrame, touched: list[int], replaced: list[int] | None, writer: str | None, batch: int) -> Commit:
        """Writes rows as new files and commits; the files of ``replaced`` buckets go, all others stay."""
        data = f"data/{uuid.uuid4().hex}"
        names = StructType.fromJson(json.loads(before.schema)).fieldNames()
        keyed = rows.select(*names, F.xxhash64(*before.keys).alias(HASH), self.bucket(before).alias(BUCKET))
        parts = max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        keyed.repartition(parts, BUCKET).sortWithinPartitions(BUCKET, HASH).write.partitionBy(BUCKET).parquet(f"{self.path}/{data}")
        if any(n.startswith(f"{BUCKET}=") for n in _Folder(self.spark, f"{self.path}/{data}").names()):
            place = F.concat(F.lit(f"{data}/"), F.element_at(F.split("_metadata.file_path", f"/{data}/"), -1))
            bounds = lambda f: F.array(*[f(F.col(z).cast("double")) for z in before.zones]).cast("array<double>")
            new = self.spark.read.parquet(f"{self.path}/{data}").select(F.col(BUCKET).cast("int").alias("bucket"), place.alias("file"), *_seconds(before))
            new = new.groupBy("bucket", "file").agg(F.count("*").alias("rows"), bounds(F.min).alias("low"), bounds(F.max).alias("high"))
        else:
            new = self.spark.createDataFrame([], MANIFEST)
        old = self.manifest(before)
        if replaced is not None:
            old = old.where(~F.col("bucket").isin(replaced)) if replaced else old
        manifest = f"manifests/{before.version + 1:020d}-{uuid.uuid4().hex}"
        old.unionByName(new).coalesce(1 + before.buckets // 10_000).write.parquet(f"{self.path}/{manifest}")
        writers = before.writers | ({writer: batch} if writer is not None else {})
        return self._commit(replace(before, version=before.version + 1, manifest=manifest, writers=writers, touched=tuple(touched), rewritten=replaced is not None))

    def _commit(self, after: Commit) -> Commit:
        if not self.folder.put(self._name(after.version), json.dumps(after.__dict__)):
            raise CommitConflict(f"version {after.version} of {self.path} is there already")
        return after

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None, batch: int = 0) -> Commit:
        """Commits ``combine(rows, changes)`` in place of the rows of the buckets that the changes' keys fall in.

        ``combine`` gets these buckets' rows alone and must leave their keys in their buckets.
        """
        before = self.commit()
        if self._done(before, writer, batch):
            return before
        own = cut(changes, "changes")
        touched = sorted(r[0] for r in own.select(self.bucket(before)).distinct().collect())  # at most one for each bucket
        if not touched:
            return self._publish(before, self._rows(before, []), [], [], writer, batch) if writer is not None else before
        return self._publish(before, combine(self._rows(before, self.files(before, touched)), own), touched, touched, writer, batch)

    def insert(self, rows: DataFrame, order: str | None = None, writer: str | None = None, batch: int = 0) -> tuple[Commit, DataFrame]:
        """Appends the rows whose keys the table lacks, of equal keys the first by ``order``; (commit, the rows appended)."""
        before = self.commit()
        names = StructType.fromJson(json.loads(before.schema)).fieldNames()
        if self._done(before, writer, batch):
            return before, self._rows(before, [])
        keyed = rows.select(*names, F.xxhash64(*before.keys).alias(HASH), self.bucket(before).alias(BUCKET))
        own = cut(_one_each(keyed, before.keys, F.min_by, order), "incoming")
        touched = sorted(r[0] for r in own.select(BUCKET).distinct().collect())
        known = self._rows(before, self.files(before, touched), True).select(HASH).distinct()
        maybe = cut(own.join(known, HASH, "left_semi").select(*before.keys, BUCKET), "known-hashes")
        there = sorted(r[0] for r in maybe.select(BUCKET).distinct().collect())
        fresh = own
        if there:
            stored = self._rows(before, self.files(before, there)).select(*before.keys)
            fresh = _null_safe(own, _null_safe(stored, maybe.drop(BUCKET), before.keys, "left_semi"), before.keys, "left_anti")
        fresh = cut(fresh.select(*names), "fresh")
        made = [r[0] for r in fresh.select(self.bucket(before)).distinct().collect()]
        if not made and writer is None:
            return before, fresh
        return self._publish(before, fresh, sorted(made), None, writer, batch), fresh

    def upsert(self, rows: DataFrame, order: str | None = None, writer: str | None = None, batch: int = 0) -> Commit:
        """Rows replace those of the same key; of equal keys the last by ``order`` stands."""

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            keys = self.commit().keys
            one = _one_each(new, keys, F.max_by, order).select(*old.columns)
            return _null_safe(old, one, keys, "left_anti").unionByName(one)

        return self.merge(rows, combine, writer, batch)

    def update(self, changes: DataFrame, columns: list[str], writer: str | None = None, batch: int = 0) -> Commit:
        """Sets columns of the rows whose keys are there; a change has one row for each key."""

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            keys = self.commit().keys
            given = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            found = old.join(given, same, "left")
            return found.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])

        return self.merge(changes, combine, writer, batch)

    def delete(self, keys: DataFrame, writer: str | None = None, batch: int = 0) -> Commit:
        return self.merge(keys, lambda old, gone: _null_safe(old, gone, self.commit().keys, "left_anti"), writer, batch)

    def compact(self, most_files: int = 8) -> Commit:
        """Rewrites the buckets that have more than ``most_files`` files; the rows stay as they are."""
        before = self.commit()
        many = sorted(r["bucket"] for r in self.manifest(before).groupBy("bucket").count().where(F.col("count") > most_files).collect())
        return self._publish(before, self._rows(before, self.files(before, many)), many, many, None, 0) if many else before

    def migrate(self, sets: list[ChangeSet]) -> Commit:
        """Applies the change sets that the table doesn't have yet, in order, a version each; those it has must be the first.

        Added columns are a commit without data: files that lack a column have nulls there.
        """
        commit = self.commit()
        if tuple(s.id for s in sets[: len(commit.applied)]) != commit.applied:
            raise ValueError(f"the table has {commit.applied}, which aren't the first of the change sets")
        for one in sets[len(commit.applied) :]:
            shape, applied = StructType.fromJson(json.loads(commit.schema)), (*commit.applied, one.id)
            if one.add is not None:
                for f in StructType.fromDDL(one.add).fields:
                    if f.name in shape.fieldNames():
                        raise ValueError(f"column {f.name} is there already")
                    shape = shape.add(f.name, f.dataType)
                commit = self._commit(replace(commit, version=commit.version + 1, schema=shape.json(), applied=applied, touched=(), rewritten=False))
            if one.copy is not None:
                rows = one.copy(self._rows(commit, self.files(commit)))
                if missing := [k for k in (*commit.keys, *commit.zones) if k not in rows.columns]:
                    raise ValueError(f"{one.id} loses {missing}")
                every = list(range(commit.buckets))
                commit = self._publish(replace(commit, schema=rows.schema.json(), applied=applied), rows, every, every, None, 0)
        return commit

    # --- Change feed --------------------------------------------------------------------------------------------------

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """kind (insert, update, delete), keys, before and after of each row that differs between two versions.

        Files that both versions have hold no change and aren't read. ``before`` and ``after`` are structs of the later version's
        columns; what the earlier one lacks is null there.
        """
        old, new = self.commit(since), self.commit(until)
        one, other = self.manifest(old).select("file"), self.manifest(new).select("file")
        gone = [f"{self.path}/{r[0]}" for r in one.join(other, "file", "left_anti").collect()]
        come = [f"{self.path}/{r[0]}" for r in other.join(one, "file", "left_anti").collect()]
        names = StructType.fromJson(json.loads(new.schema)).fieldNames()
        side = lambda commit, files, alias: self._rows(commit, files).select(*[F.col(k).alias(f"{alias}_{k}") for k in new.keys], F.struct(*names).alias(alias))
        same = [F.col(f"before_{k}").eqNullSafe(F.col(f"after_{k}")) for k in new.keys]
        both = side(replace(old, schema=new.schema), gone, "before").join(side(new, come, "after"), same, "full").where(~F.col("before").eqNullSafe(F.col("after")))
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        key = [F.when(F.col("before").isNull(), F.col(f"after_{k}")).otherwise(F.col(f"before_{k}")).alias(k) for k in new.keys]
        return both.select(kind.alias("kind"), *key, "before", "after")

    def feed(self, handle: Callable[[DataFrame, int], None], checkpoint: str, since: int = 0):
        """A stream of commits: ``handle(changes, version)`` for each version after ``since``, in order. A version that was
        handled before the stream stopped may come again."""

        def batch(rows: DataFrame, _: int) -> None:
            found = sorted(json.loads(r["value"])["version"] for r in rows.collect())  # one small row for each commit
            for version in (v for v in found if v > since):
                handle(self.changes(version - 1, version), version)

        commits = self.spark.readStream.option("pathGlobFilter", "*.json").text(f"{self.path}/commits", wholetext=True)
        return commits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _one_each(rows: DataFrame, keys: tuple[str, ...], pick: Callable[[Column, Column], Column], order: str | None) -> DataFrame:
    """A row for each key, the first or last by ``order``: an aggregate, so that a key with very many rows is no matter."""
    place = F.struct(*([F.col(order)] if order else []), F.xxhash64(*rows.columns))
    return rows.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(pick(F.struct(*rows.columns), place).alias("_r")).select("_r.*")


def _seconds(commit: Commit) -> list[Column]:
    """The zones' columns as numbers, times as seconds."""
    kinds = {f.name: f.dataType.typeName() for f in StructType.fromJson(json.loads(commit.schema))}
    return [(F.col(z).cast("timestamp").cast("double") if "timestamp" in kinds[z] else F.col(z).cast("double")).alias(z) for z in commit.zones]


def _null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """A semi or anti join in which null keys meet null keys."""
    own = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)])
    return left.join(own, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)], how)
