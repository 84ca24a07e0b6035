"""A table of Parquet files in partitions that takes upserts as a whole or not at all, and that can be read as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, exists


class VersionedTable:
    """Rows by key in a folder. Each version is a manifest: the folder of every partition, and the batches that are in it.

    An upsert reads and writes the partitions of its rows only, into a new folder, and becomes a version when its manifest
    is moved to its place. A batch that fails before leaves nothing that is read; one that was taken is not taken again.
    Two writers that build on one version cannot both move a manifest to the next one's place, on stores whose rename
    fails if the target is there, as HDFS's does. Partitions and batches are listed on the driver, rows never.
    """

    _MANIFEST = "kind string, name string, folder string"

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition: str):
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), keys, partition

    def versions(self) -> list[int]:
        """The numbers of the versions there are, ascending."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not exists(self.spark, f"{self.path}/manifest"):
            return []
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        return sorted(int(x.getPath().getName().removeprefix("v")) for x in found if x.getPath().getName().startswith("v"))

    def _manifest(self, version: int | None) -> list[tuple[str, str, str]]:
        if version is None:
            return []
        return [tuple(r) for r in self.spark.read.schema(self._MANIFEST).parquet(f"{self.path}/manifest/v{version}").collect()]

    def _latest(self) -> int | None:
        return max(self.versions(), default=None)

    def _rows(self, entries: list[tuple[str, str, str]], schema) -> DataFrame:
        """The rows of partitions of a manifest."""
        places = [f"{folder}/part={name}" for kind, name, folder in entries if kind == "partition"]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest one by default; a ValueError where there is none."""
        version = self._latest() if version is None else version
        if version not in self.versions():
            raise ValueError(f"no version {version} in {self.path}")
        entries = self._manifest(version)
        schema = self.spark.read.parquet(next(folder for kind, _, folder in entries if kind == "schema")).schema
        return self._rows(entries, schema)

    def upsert(self, rows: DataFrame, batch: str) -> int:
        """Takes the rows in, each in place of the one with its keys, and returns the version that has them.

        Of rows of one key the greatest by all columns counts. A key keeps its partition: a row whose partition differs
        from its key's old one is another row. A null partition is an error. A batch of a name that was taken changes
        nothing, and one of other columns than the table's is an error.
        """
        latest = self._latest()
        entries = self._manifest(latest)
        if any(kind == "batch" and name == batch for kind, name, _ in entries):
            return latest
        if latest is not None:
            known = self.read(latest).schema
            if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in rows.schema]:
                raise ValueError(f"columns differ: {rows.schema.simpleString()}, the table has {known.simpleString()}")
        rest = [c for c in rows.columns if c not in self.keys]
        once = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("x")).select(*[F.col(c) if c in self.keys else F.col(f"x.{c}") for c in rows.columns]) if rest else rows.distinct()
        name = F.col(self.partition).cast("string")
        touched = {r[0] for r in rows.select(name).distinct().collect()}
        if None in touched:
            raise ValueError(f"rows without {self.partition}")
        old = [e for e in entries if e[0] == "partition" and e[1] in touched]
        stay = self._rows(old, rows.schema).join(once.select(*self.keys), self.keys, "left_anti").select(*rows.columns)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        merged = stay.unionByName(once).withColumn("part", name)
        merged.repartition("part", *self.keys[:1]).write.partitionBy("part").parquet(folder)
        kept = [e for e in entries if e not in old]
        if latest is None:
            shape = f"{self.path}/data/{uuid.uuid4().hex}"
            rows.limit(0).coalesce(1).write.parquet(shape)
            kept.append(("schema", "", shape))
        self._commit([*kept, *[("partition", p, folder) for p in touched], ("batch", batch, "")], 0 if latest is None else latest + 1)
        return 0 if latest is None else latest + 1

    def _commit(self, entries: list[tuple[str, str, str]], version: int) -> None:
        spark = self.spark
        fresh, place = f"{self.path}/manifest/_{uuid.uuid4().hex}", f"{self.path}/manifest/v{version}"
        spark.createDataFrame(entries, self._MANIFEST).coalesce(1).write.parquet(fresh)
        source, target = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (fresh, place))
        if exists(spark, place) or not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
            delete(spark, fresh)
            raise RuntimeError(f"version {version} was written by another writer")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all versions but the last `keep`, and what no version that stays needs, failed batches' files included."""
        versions = self.versions()
        gone, stay = versions[:-keep], versions[-keep:]
        for version in gone:
            delete(self.spark, f"{self.path}/manifest/v{version}")
        needed = {folder.rsplit("/", 1)[-1] for v in stay for _, _, folder in self._manifest(v)}
        for name, wanted in (("data", lambda x: x in needed), ("manifest", lambda x: x.startswith("v"))):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            if exists(self.spark, f"{self.path}/{name}"):
                for x in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder):
                    if not wanted(x.getPath().getName()):
                        delete(self.spark, x.getPath().toString())
