"""Session settings and the checkpoint folder."""
import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores="8", app="gridsight"):
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GRIDSIGHT_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark):
    """Use the cluster's shared checkpoint folder. Only a local session without one gets a folder of this machine; on a cluster
    executors and driver would not see each other's files there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridsight-checkpoint-"))


def pin(df):
    """Reliable checkpoint: the rows survive executor loss and are computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
