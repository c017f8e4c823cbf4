"""Where intermediate and result tables are written."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_cleaned: set[str] = set()
_scratch: list[list[tuple[SparkSession, str]]] = []


def on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def workspace(spark: SparkSession) -> str:
    """The shared folder named by the session.

    A session on one machine that names none gets a folder of its own; its only executor is the driver's JVM. Any
    other session has to name a folder that all executors reach.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        return shared.rstrip("/")
    if not on_one_machine(spark):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="gradeline-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the workspace; nothing is ever written to it twice, and it goes when the driver's process ends."""
    root = f"{workspace(spark)}/gradeline/{spark.sparkContext.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, root: str) -> None:
    context = spark.sparkContext
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        jvm = context._jvm or SparkContext._jvm
        settings = context._jsc.hadoopConfiguration() if context._jsc else jvm.org.apache.hadoop.conf.Configuration()
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(settings).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder, sorted; nothing if there is no such folder."""
    if not exists(spark, path):
        return []
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(there)
    return sorted(f.getPath().getName() for f in found)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in one step, whole or not at all; False if there is one by that name."""
    sc = spark.sparkContext
    fs, settings = sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    aside, target = fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}"), fs.Path(path)
    files = target.getFileSystem(settings)
    out = files.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(fs, "Options$Rename")
    options = sc._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # refuses a target that is there
    try:
        fs.FileContext.getFileContext(files.makeQualified(target).toUri(), settings).rename(aside, target, options)
    except Py4JJavaError as refused:
        files.delete(aside, False)
        if "FileAlreadyExistsException" in refused.java_exception.getClass().getName():
            return False
        raise
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    opened = there.getFileSystem(sc._jsc.hadoopConfiguration()).open(there)
    try:
        return bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside go at the end, but for lasting ones. Whatever reads them has to be written by then."""
    mine: list[tuple[SparkSession, str]] = []
    _scratch.append(mine)
    try:
        yield
    finally:
        _scratch.pop()
        for spark, path in mine:
            with contextlib.suppress(Exception):  # a folder that stays is no reason to fail
                remove(spark, path)


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write the rows once and read them back.

    Inside of :func:`scratch` the table goes with it; a ``lasting`` one goes with the scratch around that, if there is one.

    Cuts the lineage, fixes whatever is not deterministic in the plan, survives the
    loss of executors, and gives the planner the true size of the result, so that
    it broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = fresh_path(df.sparkSession, name)
    around = _scratch[:-1] if lasting else _scratch
    if around:
        around[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
