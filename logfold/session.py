"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from collections.abc import Callable, Iterable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()

#: Defaults that hold on any cluster; sizes of partitions are left to AQE.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "logfold", **conf: str) -> SparkSession:
    """A session with ``CONF``; ``conf`` has further settings, with ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, unless their path already has it."""
    sc = spark.sparkContext
    paths = (os.environ.get("PYTHONPATH", "") + os.pathsep + sc.getConf().get("spark.executorEnv.PYTHONPATH", "")).split(os.pathsep)
    if sc.applicationId in _shipped or ROOT in map(os.path.abspath, filter(None, paths)):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="logfold-"), "logfold.zip")
    package = os.path.join(ROOT, "logfold")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), ROOT))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where no such folder is set (tests, one machine) is one made here."""
    sc = spark.sparkContext
    set_already = sc.getCheckpointDir()
    if set_already:
        return set_already
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="logfold-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared checkpoint folder; the result survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into a table in the shared checkpoint folder, so that the planner knows its size; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4()}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def together(work: Iterable[Callable[[], object]], at_once: int = 8) -> list:
    """The results of independent actions, of which some run at the same time, so that small jobs don't wait for each other."""
    todo = list(work)
    done: list = [None] * len(todo)
    errors: list[BaseException] = []
    room = threading.BoundedSemaphore(at_once)

    def run(i: int) -> None:
        with room:
            try:
                done[i] = todo[i]() if not errors else None
            except BaseException as e:  # noqa: BLE001
                errors.append(e)

    threads = [InheritableThread(target=run, args=(i,)) for i in range(len(todo))]  # with the job group and the properties of this thread
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return done
