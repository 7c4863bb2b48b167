"""Intermediate tables that cut lineage in iterative operators.

Each round of a loop is written as a parquet table under the cluster's shared checkpoint folder and
read back. Compared with an RDD checkpoint this computes the round once, survives the loss of any
executor, and gives Catalyst real file sizes, so a small frontier is broadcast because its size is
known and a large one is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse. On a cluster that must not be a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        local = not warehouse.partition(":")[1] or warehouse.startswith("file:") or warehouse.startswith("/")
        if local and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir: the warehouse is a folder of the driver")
        root = f"{warehouse.rstrip('/')}/staged"
    return root.rstrip("/")


class Stage:
    """Names and writes the intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/codegrove/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[tuple[str, StructType]] = []

    def put(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """Write ``df`` once; return the table read back and its row count plus ``measures``.

        The counters ride along with the write (``observe``), so no extra job is needed.
        """
        self._n += 1
        path = f"{self.base}/t{self._n:04d}"
        seen = Observation()
        aggs = [F.count(F.lit(1)).alias("rows")]
        aggs += [expr.alias(name) for name, expr in measures.items()]
        df.observe(seen, *aggs).write.mode("overwrite").parquet(path)
        self._paths.append((path, df.schema))
        return self.spark.read.schema(df.schema).parquet(path), seen.get

    def table(self, df: DataFrame) -> DataFrame:
        """``put`` without the counters."""
        return self.put(df)[0]

    def release(self) -> None:
        """Empty the tables written so far, once nothing reads them any more."""
        for path, schema in self._paths:
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)
        self._paths.clear()
