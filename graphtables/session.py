"""Session helpers: a local session for tests/bench, and the shared folder.

Library code never invents a machine-local folder on a cluster: durable
intermediate data (checkpoints, written edge files) goes below the folder
the cluster names in ``spark.checkpoint.dir``. Only a ``local[...]`` master
without that setting (tests, bench) gets a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "graphtables", extra: dict | None = None) -> SparkSession:
    """A ``local[cpus]`` session with the UI off and AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # broadcast only what was measured: no broadcast on a planning-time
        # estimate (compressed file sizes understate), but adaptive execution may
        # still broadcast a side whose shuffle output it measured below 10 MB
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        # checkpoint files of released loop rounds are removed by Spark's cleaner
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Read from the context (``spark.checkpoint.dir`` is applied there at
    start-up) or from the conf. When neither is set and the master is local,
    a fresh temporary folder is set, as tests do; on a cluster the setting
    is required.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context on the client, the setting is in the conf
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir is not set") from None
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a folder every executor can reach")
    tmp = tempfile.mkdtemp(prefix="graphtables-ckpt-")
    sc.setCheckpointDir(tmp)
    return sc.getCheckpointDir() or tmp


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder, for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that :func:`shared_path` named."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    hadoop, store = _file_system(spark, path)
    return store.exists(hadoop)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    hadoop, store = _file_system(spark, path)
    if not store.exists(hadoop):
        return []
    return sorted(status.getPath().getName() for status in store.listStatus(hadoop))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    hadoop, store = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f".{hadoop.getName()}-{uuid.uuid4().hex}")
    out = store.create(beside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not store.rename(beside, hadoop):
        store.delete(beside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    hadoop, store = _file_system(spark, path)
    stream = store.open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
