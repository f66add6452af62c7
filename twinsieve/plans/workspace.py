"""Tables written between the steps of iterative operators.

A written table cuts the lineage, survives the loss of executors, and is
computed once even when several later steps read it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names, if any."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="spark-twinsieve-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Workspace:
    """One folder of intermediate tables; ``drop`` removes it when done, as does the end of a ``with`` block.

    Results that operators return read these tables: write them elsewhere first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/twinsieve/{uuid.uuid4().hex}"
        self.rows: dict[str, int] = {}

    @property
    def parallelism(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return a reader of it."""
        return self.save_counted(df, label)[0]

    def save_counted(self, df: DataFrame, label: str, **measures) -> tuple[DataFrame, dict]:
        """As ``save``, with the row count and other aggregates of the same pass.

        They steer the choice of plans; ``n == 0`` is reliable, larger values
        may count rows of a recomputed stage again.
        """
        path = f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()])
         .write.parquet(path))
        return self.spark.read.schema(df.schema).parquet(path), seen.get

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
