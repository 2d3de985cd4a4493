"""Small DataFrame helpers of the corpus operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["Tables", "cut_lineage", "id_text", "partitions", "per_batch", "table", "words_count"]


class Tables:
    """Intermediate tables of one operator, written to the shared checkpoint folder.

    For iterative plans: a checkpoint keeps its plan's partitionings and orderings, and
    where joins of checkpoints are checkpointed again and again, these double each time.
    A table read back has none, and is compressed.  ``clear`` deletes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"

    def store(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store_texts(self, df: DataFrame) -> DataFrame:
        """A table with texts, compressed harder."""
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, k: int) -> None:
        """Delete the table that was stored as the ``k``-th from the end (1: the last one)."""
        self._delete(f"{self.base}/{self.n - k}")

    def release(self) -> None:
        """Let the driver collect its garbage now: shuffle files of finished jobs are deleted when
        nothing refers to them, which otherwise can be long after they have filled disks."""
        for _ in range(3):              # a plan is freed by one collection, what it alone referred to by the next
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.7)

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text (null: empty), so that no other column of the input,
    whatever its name, meets the operator's own columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a batch function to what ``mapInArrow`` takes; empty batches pass by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return run


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
