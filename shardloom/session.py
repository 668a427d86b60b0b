"""Session settings and the shared scratch area used to cut long lineages."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "shardloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's defaults; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULT_CONF | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is missing and all runs on one machine (tests) a
    temporary folder of this machine is used; on a cluster that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='shardloom-')}"
    sc.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table survives the loss of executors, is columnar and compressed, and
    gives the following steps exact sizes to plan with. It is removed when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the session's Python workers import this package, wherever they run.

    The package is put as an archive into the shared folder, once per application.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    path = f"{shared_dir(spark).rstrip('/')}/lib/{root.name}-{sc.applicationId}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    sc.addPyFile(path)
    atexit.register(discard, spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared area; a stopped session is no error."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - best effort at exit
        pass


def parallelism(spark: SparkSession) -> int:
    """Tasks that can be expected to run at once, at least 2."""
    return max(2, spark.sparkContext.defaultParallelism)
