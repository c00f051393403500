"""What the operators share: reading tables, the shared folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters as a Java regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Upper bound of one Arrow batch; very long texts still come whole, one to a batch.
ARROW_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so that Python workers hold a few megabytes of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronolex-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """Intermediate tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def save(self, name: str, frame: DataFrame) -> DataFrame:
        """Write a table; the shuffle files that made it go at once, as nothing else reads them."""
        held = self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEAN, held)
        self.names.add(name)
        return self.load(name, frame)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._remove(f"{self.root}/{name}")
        self.names.discard(name)

    def only(self, *kept: str) -> None:
        """Remove all tables but these, which the result still reads."""
        for name in sorted(self.names - set(kept)):
            self.drop(name)

    def close(self) -> None:
        """Remove the whole workspace; for callers that have written the result elsewhere."""
        self._remove(self.root)
        self.names.clear()

    def _remove(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeeze_spaces(text: Column) -> Column:
    """Each run of ASCII white space becomes one space. The common single space is left alone, which is the fast case."""
    return F.regexp_replace(F.translate(text, "\t\n\x0b\f\r", "     "), " {2,}", " ")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
