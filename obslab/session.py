"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "obslab", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on (adaptive joins, UTC)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call-site capture costs more than building the expressions themselves.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="obslab-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, honouring the cluster's setting."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get(CHECKPOINT_DIR, None)
        if base:
            spark.sparkContext.setCheckpointDir(base)
        else:
            shared_dir(spark, "checkpoint")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the file system that serves ``path``."""
    jvm = spark.sparkContext._jvm
    return bool(_file_system(spark, path).globStatus(jvm.org.apache.hadoop.fs.Path(path)))


def is_folder(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)).isDirectory()


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without any byte at or below ``path``, as data readers list them (names with ``_`` or ``.`` first are hidden)."""
    found, files = [], _file_system(spark, path).listFiles(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
    while files.hasNext():
        file = files.next()
        if file.getLen() == 0 and file.getPath().getName()[0] not in "_.":
            found.append(file.getPath().toString())
    return sorted(found)


def create_once(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there already. Of several writers one succeeds, whatever their timing.

    Hadoop's file systems create atomically, but the local one only looks first; there the system's own exclusive create is used.
    """
    jvm, system = spark.sparkContext._jvm, _file_system(spark, path)
    target = jvm.org.apache.hadoop.fs.Path(path)
    system.mkdirs(target.getParent())
    try:
        if system.getUri().getScheme() == "file":
            local = jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(target).toString()
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(local).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            system.create(target, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def remove_file(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), False)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
