"""A store of runs on disk: staged batches, and a manifest that names the current version of each run.

Rows are written to a folder of their own first. Then a new manifest is written
beside the old one, and last the pointer to it is replaced by a rename. Until
then readers see the old state; a job that fails or is repeated leaves files
that no manifest names, and the same runs once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import kept


class RunStore:
    """Versioned runs under ``path``: ``batches/<id>/<key>=..`` with rows, ``manifests/<id>`` with key, batch, rows and seq, ``CURRENT``.

    One writer at a time; a writer that finds another manifest than it began
    with raises and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "run_id"):
        self.spark, self.path, self.key = spark, path, key
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root, name)

    def version(self) -> str:
        """The current manifest's name; empty if nothing was written."""
        if not self.files.exists(self._at("CURRENT")):
            return ""
        return self.spark.read.text(f"{self.path}/CURRENT").first()["value"]

    def manifest(self) -> DataFrame:
        """(key, batch, n, seq): the current batch of each run, its rows and the number of its commit."""
        if version := self.version():
            return self.spark.read.parquet(f"{self.path}/manifests/{version}")
        return self.spark.createDataFrame([], f"{self.key} string, batch string, n long, seq long")

    def _point(self, version: str, seen: str) -> None:
        staged = self._at(f"CURRENT-{version}")
        out = self.files.create(staged, True)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()
        if self.version() != seen:
            raise RuntimeError("another writer has committed since this one began")
        if seen:
            self.files.delete(self._at("CURRENT"), False)
        if not self.files.rename(staged, self._at("CURRENT")):
            raise RuntimeError("the pointer could not be replaced")

    def write(self, rows: DataFrame) -> DataFrame:
        """Stages all runs in ``rows`` and makes them current; runs not in ``rows`` stay. Gives the new manifest."""
        seen, batch = self.version(), uuid.uuid4().hex
        rows.withColumn(self.key, F.col(self.key).cast("string")).write.partitionBy(self.key).parquet(f"{self.path}/batches/{batch}")
        staged = self.spark.read.schema(self._schema(rows)).parquet(f"{self.path}/batches/{batch}")
        old = self.manifest()
        seq = (old.agg(F.max("seq")).first()[0] or 0) + 1
        new = staged.groupBy(self.key).agg(F.count("*").alias("n")).select(self.key, F.lit(batch).alias("batch"), "n", F.lit(seq).cast("long").alias("seq"))
        version = f"{seq:09d}-{batch}"
        old.join(new, self.key, "left_anti").unionByName(new).write.parquet(f"{self.path}/manifests/{version}")
        self._point(version, seen)
        return self.manifest()

    def _schema(self, rows: DataFrame):
        return rows.withColumn(self.key, F.col(self.key).cast("string")).schema

    def read(self) -> DataFrame:
        """The rows of the current batch of each run; files that no manifest names are not read."""
        manifest = kept(self.manifest().select(F.col(self.key).alias("_key"), F.col("batch").alias("_batch")))
        names = [r["_batch"] for r in manifest.select("_batch").distinct().collect()]
        found = None
        for name in names:
            part = self.spark.read.parquet(f"{self.path}/batches/{name}").withColumn(self.key, F.col(self.key).cast("string"))
            part = part.join(F.broadcast(manifest.filter(F.col("_batch") == name)), F.col(self.key) == F.col("_key"), "left_semi")
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        if found is None:
            return self.spark.createDataFrame([], f"{self.key} string")
        return found

    def compact(self) -> DataFrame:
        """Writes all current runs as one batch, so that reading opens one folder; contents stay the same."""
        return self.write(self.read()) if self.version() else self.manifest()

    def clean(self) -> int:
        """Deletes batches and manifests that the current manifest does not name; returns their number."""
        version = self.version()
        names = {r["batch"] for r in self.manifest().select("batch").distinct().collect()}
        gone = 0
        for folder, wanted in (("batches", names), ("manifests", {version})):
            if self.files.exists(self._at(folder)):
                for status in self.files.listStatus(self._at(folder)):
                    if status.getPath().getName() not in wanted:
                        self.files.delete(status.getPath(), True)
                        gone += 1
        return gone
