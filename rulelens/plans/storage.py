"""Intermediate tables in the shared folder that `spark.checkpoint.dir` names."""

import tempfile
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

_RUN_FOLDER = ContextVar("run_folder", default=None)


def shared_dir(spark):
    """The cluster's checkpoint folder. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rulelens-"))
    return sc.getCheckpointDir()


def run_dir(spark, label):
    """A new folder name below the open run's folder, or else below the shared one."""
    folder = _RUN_FOLDER.get() or f"{shared_dir(spark).rstrip('/')}/rulelens"
    return f"{folder}/{label}-{uuid4().hex}"


@contextmanager
def run_scope(spark):
    """Everything stored inside the `with` block is deleted at its end; write results elsewhere before that."""
    folder = f"{shared_dir(spark).rstrip('/')}/rulelens/run-{uuid4().hex}"
    token = _RUN_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _RUN_FOLDER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, label="table"):
    """Write a table once and read it back: cuts lineage, survives lost executors, is read by column."""
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
