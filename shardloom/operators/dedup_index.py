"""A stored index of vectors against which batches are checked before they join it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stage
from .similarity import search, usable


def batch_duplicates(df: DataFrame, key: str, vec: str, batch: str, least: float = 0.95) -> DataFrame:
    """``key, of, cos``: rows near a row of an earlier batch, with the nearest such row.

    Rows of one batch are not held against each other: every batch is searched
    for before it is added, and all of its rows are added. ``batch`` is a
    number; there are few batches, each one search.
    """
    out = None
    numbers = [r[0] for r in df.where(F.col(batch).isNotNull()).select(batch).distinct().orderBy(batch).collect()]
    for b in numbers[1:]:
        near = search(df.where(F.col(batch) == b), df.where(F.col(batch) < b), key, vec, 1).where(F.col("cos") >= least)
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = search(df.limit(0), df, key, vec, 1)
    return out.select(key, F.col("other").alias("of"), "cos")


class VectorIndex:
    """Vectors by batch in a folder of Parquet tables; it is opened from the folder, so it outlives the driver.

    A batch is one partition and is written whole or not at all; adding it
    again replaces it, ``rollback`` takes back the last ones.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", vec: str = "vec") -> None:
        self.spark, self.folder, self.key, self.vec = spark, folder.rstrip("/"), key, vec

    def batches(self) -> list[int]:
        """Numbers of the batches that were written to their end."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(root)]
        whole = [n for n, p in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in whole)

    def stored(self, before: int | None = None) -> DataFrame | None:
        paths = [f"{self.folder}/batch={b}" for b in self.batches() if before is None or b < before]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, rows: DataFrame, batch: int, least: float = 0.95) -> DataFrame:
        """Adds the rows whose keys no earlier batch has; returns ``key, of, cos`` of those near an earlier vector."""
        new = usable(rows, self.vec).select(self.key, self.vec).dropDuplicates([self.key])
        old = self.stored(batch)
        if old is not None:
            new = new.join(old.select(self.key), self.key, "left_anti")
        new = stage(new, "new")
        near = search(new, old, self.key, self.vec, 1).where(F.col("cos") >= least) if old is not None else search(new.limit(0), new, self.key, self.vec, 1)
        found = stage(near.select(self.key, F.col("other").alias("of"), "cos"), "found")
        new.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return found

    def rollback(self, to: int) -> None:
        """Takes back every batch after number ``to``."""
        for b in self.batches():
            if b > to:
                discard(self.spark, f"{self.folder}/batch={b}")
