"""Where intermediate results go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run, below the shared folder the cluster names.

    Only a local master, as in tests, gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use every task slot on a small scanned input.

    A table of fewer scan partitions than slots is at most slots x split size,
    so moving it costs little against parsing it on a few slots. Larger inputs
    are left as they are scanned.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def stored(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives lost executors; as Parquet it also lets
    later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: like ``stored``, and the partitioning is remembered."""
    work_folder(df.sparkSession, "checkpoint")  # makes sure the folder is set
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if shared and df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


class Buckets:
    """Tables bucketed by a join key: written once, joined many times without a shuffle.

    They live in the shared folder; the catalog only knows them while a loop
    runs, and ``close`` makes it forget the names.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}
        self.plain: dict[str, T.StructType] = {}

    def write(self, df: DataFrame, *keys: str, shuffle: bool = True) -> str:
        """Name of the new table. ``shuffle=False``: rows already lie by these keys."""
        name = f"pagemill_{uuid.uuid4().hex}"
        path = work_folder(self.spark, "buckets")
        laid = df.repartition(self.parts, *keys) if shuffle else df
        laid.write.format("parquet").bucketBy(self.parts, *keys).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def write_plain(self, df: DataFrame) -> str:
        """The same without buckets, for rows too few to care where they lie."""
        name = f"pagemill_{uuid.uuid4().hex}"
        self.paths[name] = work_folder(self.spark, "plain")
        self.plain[name] = df.schema
        df.write.parquet(self.paths[name])
        return name

    def rows(self, name: str) -> DataFrame:
        return self.files([name]) if name in self.plain else self.spark.table(name)

    def files(self, names: list[str]) -> DataFrame:
        """The tables' rows by path; usable after ``close``."""
        schema = self.plain.get(names[0]) or self.rows(names[0]).schema
        return self.spark.read.schema(schema).parquet(*[self.paths[n] for n in names])

    def close(self) -> None:
        for name in self.paths.keys() - self.plain.keys():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
