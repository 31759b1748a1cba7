"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lumicurve", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the engine is designed for (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, str(v))
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where a local session has none (as in tests) a temporary one is made; a
    cluster without the setting is an error, since each of its executors would
    write to its own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="lumicurve-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/lumicurve-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str, wide_cells: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at files every executor can reach, so a lost executor
    costs a re-read and never a recomputation of what stands before. All of an
    application's files are in one folder, which ``clear_materialised`` deletes
    when no result is read any more. With
    ``wide_cells`` (kilobytes in a cell that no dictionary shortens) row groups
    are small, so that a writer holds few of them in memory.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if wide_cells:
        writer = writer.option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame that ``materialise`` returned."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def clear_materialised(spark: SparkSession) -> None:
    """Delete all files that ``materialise`` wrote in this application; to be
    called when the results of its operators have been read or written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package: as a zip file that the driver
    serves, once. Only where the master is local and its workers start with this
    very copy's folder on their path there is nothing to do."""
    root = Path(__file__).resolve().parent.parent
    app, local = spark.sparkContext.applicationId, spark.sparkContext.master.split("[")[0] == "local"
    places = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    found = next((os.path.realpath(p) for p in places if os.path.isdir(os.path.join(p, "lumicurve"))), None)
    if app in _SHIPPED or local and found == str(root):
        return
    path = os.path.join(tempfile.mkdtemp(), "lumicurve.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "lumicurve").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
