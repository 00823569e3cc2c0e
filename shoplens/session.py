"""Session defaults and shared helpers for cluster-safe execution."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. Sizes are for local tests; on a cluster
# set spark.sql.shuffle.partitions to roughly input_bytes / 128 MB and let AQE
# coalesce small partitions and split skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "shoplens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. If it is unset, a
    local session gets a scratch folder of its own; on a cluster a folder of
    the driver's machine would not reach the executors, so that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    check_scratch_allowed(sc.master)
    path = tempfile.mkdtemp(prefix="shoplens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def check_scratch_allowed(master: str) -> None:
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: Applications that the package has been sent to.
_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once per application: executors import functions of it by name,
    and the driver serves the archive to them."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="shoplens-"), "shoplens_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("shoplens", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name among this application's intermediate tables; :func:`drop_tables` removes what is written there."""
    path = f"{_tables_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _tables_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    read it back: the lineage is cut, the data survives executor loss, and
    the upstream runs once (an unpersisted RDD ``checkpoint()`` would run its
    last stage twice and store serialized rows instead of columnar files).
    The tables belong to the application: :func:`drop_tables` removes them.
    """
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the intermediate tables, in the order written, by application.
_WRITTEN: dict[str, list[str]] = {}


def tables(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables that this application has written and not dropped, oldest first."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove intermediate tables that nothing will read any more: the given ones, or all of this application."""
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in [_tables_dir(spark)] if paths is None else paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    own[:] = [] if paths is None else [p for p in own if p not in paths]
