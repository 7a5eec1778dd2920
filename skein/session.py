"""Session helpers: a tuned local session and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs in one process (tests, a laptop) is a temporary
    folder used; on a cluster it must be named, as its machines share no temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[.*\])?", context.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared checkpoint folder and read it back from there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


class Scratch:
    """Tables of a loop, written to the shared checkpoint folder: plans stay short, sizes are known (a
    checkpoint carries the guessed sizes of its joins, whose digits double each turn), and a lost
    executor costs no more than its tasks. Of each name the last two versions are kept."""

    def __init__(self, spark: SparkSession, kind: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
        self.versions: dict[str, int] = {}

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        version = self.versions[name] = self.versions.get(name, 0) + 1
        frame.write.parquet(f"{self.folder}/{name}/{version}")
        if version > 2:
            self.remove(f"{name}/{version - 2}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}/{version}")

    def remove(self, part: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
