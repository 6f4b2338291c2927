"""Session settings and the shared work folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on; all can be changed at run time.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A reply may repeat a key; like a JSON reader in Python, the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Transcripts are long rows: an Arrow batch holds so many rows or bytes, whichever is less.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; the cluster decides everything else."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``.

    A cluster must name one: its machines do not share local folders. Where the master is
    ``local``, all tasks are on one machine and a temporary folder of it will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), "colloquy-work")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
