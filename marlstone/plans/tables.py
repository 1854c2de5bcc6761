"""Tables as versioned lists of Parquet files: a write adds files, and publishes a new list by one rename of a pointer.

A version names its files, so an append writes its own rows alone, and DELETE, UPDATE and MERGE rewrite only the files
that hold a row they change; all others are carried over as they are. A reader sees the version that the pointer names
when it reads. A version is published only over the one it was built from: of two writers the later one is refused.
"""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TableLocked(RuntimeError):
    """Another writer holds the table."""


class Outrun(RuntimeError):
    """Another writer has published since the version was built."""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set, as in local tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marlstone-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Table:
    """One table: ``path/data`` holds files, ``path/v-*.json`` lists of them, ``path/CURRENT`` names the published list.

    A list's entry is a file's name under ``data`` and the values of columns that were added after it was written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._holds = False

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(f"{self.path}/{name}"), True)
        out.write(text.encode())
        out.close()

    def exists(self) -> bool:
        return self._fs.exists(self._at(f"{self.path}/CURRENT"))

    def version(self) -> str:
        return self._get("CURRENT")

    def manifest(self, version: str | None = None) -> dict:
        """A version's schema (as JSON), files, and the version it was built from."""
        return json.loads(self._get(f"{version or self.version()}.json"))

    def _scan(self, held: dict, files: list[dict], named: bool = False) -> DataFrame:
        """Rows of some of a version's files, with each row's file if it is asked for."""
        schema = T.StructType.fromJson(held["schema"])
        groups: dict[str, list[str]] = {}
        for f in files:
            groups.setdefault(json.dumps(f.get("fill", {}), sort_keys=True), []).append(f"{self.path}/data/{f['file']}")
        name = [F.concat(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("/"), F.col("_metadata.file_name")).alias("__file")] if named else []
        out = None
        for fill, paths in groups.items():
            given = json.loads(fill)
            rows = self.spark.read.schema(schema).parquet(*paths)
            part = rows.select(*((F.lit(given[f.name]).cast(f.dataType).alias(f.name) if f.name in given else F.col(f"`{f.name}`")) for f in schema), *name)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], T.StructType([*schema, *([T.StructField("__file", T.StringType())] if named else [])])) if out is None else out

    def read(self, version: str | None = None) -> DataFrame:
        held = self.manifest(version)
        return self._scan(held, held["files"])

    def _written(self, df: DataFrame, cluster_by: list[str] | None = None) -> list[dict]:
        """Writes rows as new files and lists them."""
        folder = uuid.uuid4().hex
        (df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df).write.parquet(f"{self.path}/data/{folder}")
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/data/{folder}")))
        found = [{"file": f"{folder}/{n}"} for n in sorted(names) if n.endswith(".parquet")]
        # of no rows Spark writes one empty file, which no list needs
        return [] if len(found) == 1 and self.spark.read.parquet(f"{self.path}/data/{folder}").isEmpty() else found

    def _listed(self, files: list[dict], schema: T.StructType) -> str:
        name = f"v-{uuid.uuid4().hex}"
        self._put(f"{name}.json", json.dumps({"base": self.version() if self.exists() else None, "schema": json.loads(schema.json()), "files": files}))
        return name

    def stage(self, df: DataFrame, cluster_by: list[str] | None = None) -> str:
        """Writes a version that nobody sees yet. With ``cluster_by`` a file holds a range of these columns, so that later
        changes of a range touch few files and filters skip the others by their statistics."""
        return self._listed(self._written(df, cluster_by), df.schema)

    @contextlib.contextmanager
    def locked(self) -> Iterator["Table"]:
        """One writer at a time: a lock file that only one of two can create. A crashed writer's is removed by hand."""
        at = self._at(f"{self.path}/LOCK")
        try:
            self._fs.create(at, False).close()
        except Exception as e:
            raise TableLocked(self.path) from e
        self._holds = True
        try:
            yield self
        finally:
            self._holds = False
            self._fs.delete(at, False)

    def publish(self, version: str) -> None:
        """Makes a version the current one, by one rename over the old pointer, under the table's lock."""
        with contextlib.nullcontext() if self._holds else self.locked():
            base = self.manifest(version)["base"]
            if base != (self.version() if self.exists() else None):
                raise Outrun(f"{self.path} has changed since {version} was built")
            temp, final = self._at(f"{self.path}/.{version}"), self._at(f"{self.path}/CURRENT")
            self._put(f".{version}", version)
            jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
            mode = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = gateway.new_array(mode, 1)
            options[0] = mode.OVERWRITE
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            files.rename(self._fs.makeQualified(temp), self._fs.makeQualified(final), options)

    def overwrite(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None, cluster_by: list[str] | None = None) -> "Table":
        """Build, check, publish. ``check`` gets the staged rows and raises to keep the old version."""
        version = self.stage(df, cluster_by)
        if check:
            check(self.read(version))
        self.publish(version)
        return self

    def _shaped(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """Rows in the table's columns and types; a column that is missing is null."""
        have = {c.lower() for c in df.columns}
        return df.select(*((F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def insert(self, df: DataFrame) -> "Table":
        """Adds rows: their files beside the old ones."""
        if not self.exists():
            return self.overwrite(df)
        held = self.manifest()
        schema = T.StructType.fromJson(held["schema"])
        self.publish(self._listed(held["files"] + self._written(self._shaped(df, schema)), schema))
        return self

    def _rewrite(self, touched: DataFrame | None, change: Callable[[DataFrame], DataFrame], added: list[dict] | None = None, held: dict | None = None) -> "Table":
        """Rewrites the files that ``touched`` (a column __file) names, carries the others over, and adds some."""
        held = held or self.manifest()
        schema = T.StructType.fromJson(held["schema"])
        names = {r[0] for r in touched.select("__file").distinct().collect()}  # at most one row for each file
        hit = [f for f in held["files"] if f["file"] in names]
        if hit or added:
            kept = [f for f in held["files"] if f["file"] not in names]
            fresh = self._written(self._shaped(change(self._scan(held, hit)), schema)) if hit else []
            self.publish(self._listed(kept + fresh + (added or []), schema))
        return self

    def delete(self, condition: Column) -> "Table":
        hit, held = F.coalesce(condition, F.lit(False)), self.manifest()
        return self._rewrite(self._scan(held, held["files"], named=True).filter(hit), lambda df: df.filter(~hit), held=held)

    def delete_using(self, other: DataFrame, keys: list[str]) -> "Table":
        gone, held = other.select(*keys).distinct(), self.manifest()
        return self._rewrite(self._scan(held, held["files"], named=True).join(gone, keys, "left_semi"), lambda df: df.join(gone, keys, "left_anti"), held=held)

    def replace(self, condition: Column, rows: DataFrame) -> "Table":
        """Deletes what the condition says and inserts rows, in one version."""
        hit, held = F.coalesce(condition, F.lit(False)), self.manifest()
        added = self._written(self._shaped(rows, T.StructType.fromJson(held["schema"])))
        return self._rewrite(self._scan(held, held["files"], named=True).filter(hit), lambda df: df.filter(~hit), added, held)

    def update(self, condition: Column, **values: Column) -> "Table":
        hit, held = F.coalesce(condition, F.lit(False)), self.manifest()
        changed = lambda df: df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))
        return self._rewrite(self._scan(held, held["files"], named=True).filter(hit), changed, held=held)

    def update_from(self, other: DataFrame, keys: list[str], **values: Column) -> "Table":
        """UPDATE with a join: rows that meet one of the other's take values, which may name columns of both."""
        assert_keys(other, keys)
        held = self.manifest()
        beside = other.select(*keys, *(F.col(c) for c in other.columns if c not in keys), F.lit(True).alias("__met"))

        def changed(df: DataFrame) -> DataFrame:
            met = df.join(beside, keys, "left")
            return met.select(*(F.when(F.col("__met"), values[c]).otherwise(df[c]).alias(c) if c in values else df[c] if c not in keys else F.col(c) for c in df.columns))

        return self._rewrite(self._scan(held, held["files"], named=True).join(other.select(*keys), keys, "left_semi"), changed, held=held)

    def merge(self, source: DataFrame, keys: list[str]) -> "Table":
        """Matched rows are replaced, others inserted. A source with two rows of a key is refused, as no order decides.

        The source's rows are written once, as files of the new version, and read from there.
        """
        held = self.manifest()
        schema = T.StructType.fromJson(held["schema"])
        added = self._written(self._shaped(source, schema))
        rows = self._scan(held, added)
        assert_keys(rows, keys)
        return self._rewrite(self._scan(held, held["files"], named=True).join(rows.select(*keys), keys, "left_semi"), lambda df: df.join(rows.select(*keys), keys, "left_anti"), added, held)

    def add_column(self, name: str, kind: str, default=None) -> "Table":
        """A change of the list alone: no file is rewritten, old ones give the default."""
        held = self.manifest()
        schema = T.StructType.fromJson(held["schema"]).add(name, T.DataType.fromDDL(kind))
        files = [f | {"fill": f.get("fill", {}) | {name: default}} if default is not None else f for f in held["files"]]
        self.publish(self._listed(files, schema))
        return self

    def truncate(self) -> "Table":
        self.publish(self._listed([], T.StructType.fromJson(self.manifest()["schema"])))
        return self

    def compact(self, cluster_by: list[str] | None = None) -> "Table":
        """The same rows in fewer files, in order."""
        return self.overwrite(self.read(), cluster_by=cluster_by)

    def versions(self) -> int:
        return sum(1 for s in self._fs.listStatus(self._at(self.path)) if s.getPath().getName().startswith("v-"))

    def vacuum(self) -> None:
        """Drops all versions but the current one, and the files that only they name."""
        now, held = self.version(), {f["file"] for f in self.manifest()["files"]}
        for s in self._fs.listStatus(self._at(self.path)):
            name = s.getPath().getName()
            if name.startswith("v-") and name != f"{now}.json":
                self._fs.delete(s.getPath(), True)
        for folder in self._fs.listStatus(self._at(f"{self.path}/data")):
            inside = [(s.getPath(), f"{folder.getPath().getName()}/{s.getPath().getName()}") for s in self._fs.listStatus(folder.getPath())]
            if not any(name in held for _, name in inside):
                self._fs.delete(folder.getPath(), True)
                continue
            for at, name in inside:
                if name.endswith(".parquet") and name not in held:
                    self._fs.delete(at, False)


def assert_keys(source: DataFrame, keys: list[str]) -> None:
    """Raises if a key occurs twice."""
    if not source.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"the source has two rows of one {', '.join(keys)}")


def merged(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of frames as an anti join and a union: one shuffle of the target by its keys, none if the source is small."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))
