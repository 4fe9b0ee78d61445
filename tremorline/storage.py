"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tremorline-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the table written below the shared folder and read again; gone when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremorline/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Layers:
    """Stage results by name below a root of any store, reused while newer than their inputs.

    A result without inputs is reused as long as it is there; ``force`` makes all anew.
    """

    def __init__(self, spark: SparkSession, root: str, force: bool = False):
        self.spark, self.root, self.force = spark, root.rstrip("/"), force

    def path(self, layer: str, name: str) -> str:
        return f"{self.root}/{layer}/{name}"

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def changed(self, path: str) -> int | None:
        """Modification time of a finished result in ms; None if there is none."""
        fs, hadoop = self._fs(path)
        if not fs.exists(hadoop):
            return None
        if fs.getFileStatus(hadoop).isDirectory():
            done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            return fs.getFileStatus(done).getModificationTime() if fs.exists(done) else None
        return fs.getFileStatus(hadoop).getModificationTime()

    def fresh(self, path: str, inputs: list[str] = ()) -> bool:
        own = self.changed(path)
        if own is None or self.force:
            return False
        times = [self.changed(p) for p in inputs]
        return all(t is not None and t <= own for t in times)

    def table(self, layer: str, name: str, make, inputs: list[str] = ()) -> tuple[DataFrame, str]:
        """The stored table, made first if it is missing, forced or older than an input."""
        path = self.path(layer, name)
        if not self.fresh(path, inputs):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), path

    def json(self, layer: str, name: str, make, inputs: list[str] = ()) -> tuple[dict, str]:
        """The same for a small result of the driver."""
        path = self.path(layer, name)
        if not self.fresh(path, inputs):
            self.write_json(layer, name, make())
        return self.read_json(path), path

    def write_json(self, layer: str, name: str, value: dict) -> str:
        path = self.path(layer, name)
        fs, hadoop = self._fs(path)
        out = fs.create(hadoop, True)
        out.write(bytearray(json.dumps(value, indent=2).encode()))
        out.close()
        return path

    def read_json(self, path: str) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))


class Scratch:
    """What stands in for Layers where nothing is to be kept: each result is made, and tables are written to the shared folder."""

    def table(self, layer: str, name: str, make, inputs: list[str] = ()) -> tuple[DataFrame, str]:
        return written(make(), layer), ""

    def json(self, layer: str, name: str, make, inputs: list[str] = ()) -> tuple[dict, str]:
        return make(), ""
