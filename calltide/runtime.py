"""Session defaults, the shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; callers count the side before they rely on it.
BROADCAST_ROWS = 100_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("calltide")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a local run takes a folder of this machine; a cluster is refused, as its executors wouldn't share one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="calltide-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/calltide-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by new_path, through Hadoop so that any shared file system works."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark resolves it to, so that code outside Spark takes the same one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, where it isn't installed: functions that run in Python workers import it."""
    folder = tempfile.mkdtemp(prefix="calltide-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/calltide", "zip", package.parent, package.name))


def together(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of a key in one partition.

    A plain repartition is left out where a join or union below seems to have done it already, although the join may
    still be turned into one that leaves rows where they are. A struct of the keys matches no join's partitioning.
    """
    return df.repartition(F.struct(*keys))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table into the shared folder and read it back.

    This cuts lineage (a lost executor costs no recomputation past it), stores columns compressed, and gives later
    joins real sizes to plan with. The table stays until ``release`` or the end of the application.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._calltide_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_calltide_path", None):
            drop_path(t.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete everything this application wrote into the shared folder. Results that still read from it are lost."""
    drop_path(spark, work_dir(spark))
