"""Session helper and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Generated methods above 8000 bytes of bytecode are not compiled by the JIT. With
# this limit Spark splits such stages into smaller methods instead, which makes
# wide row-wise work (payloads, flags of four parameters) several times faster.
RECOMMENDED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors, so that Python functions run wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="rotaflow-package-"), "rotaflow_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, str(file.relative_to(home.parent)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Applies ``RECOMMENDED`` to a session made elsewhere and ships the package."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster pass the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rotaflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in (RECOMMENDED | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="rotaflow-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder, for a table written between two steps."""
    return f"{shared_folder(spark).rstrip('/')}/rotaflow/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose frames nobody holds any more; by itself it does when the driver happens to collect garbage.

    What holds the files goes in the first collection, the files in the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
