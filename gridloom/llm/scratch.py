"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset, a folder in the
warehouse stands in on a cluster, and a temporary one on a single machine. A
written table cuts lineage and survives lost executors. Slim tables that are
only read twice, outside loops, are ``kept`` on the executors' disks instead.
Both go with ``release``, or when the driver's JVM ends. Between rounds the
driver ``settles``, so that executors needn't hold what finished rounds shuffled.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.batches import trim

#: Shuffle partitions are sized for texts; of so many one task writes a slim table, unless few are left.
SLIM, FEW = 8, 24
#: Slim rows of a file, where their number is known.
FILE_ROWS = 250_000
#: Seconds from one ``settle`` to the next, at least.
SETTLE = 5

_settled = 0.0
_local: list[str] = []
_kept: list[DataFrame] = []
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/gridloom-scratch"
    if not folder:
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="gridloom-"))
        folder = _local[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared folder, removed when the JVM exits."""
    path = f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex[:12]}-{tag}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _paths.append(path)
    return path


def written(df: DataFrame, tag: str, rows: int | None = None, slim: bool = True) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    ``slim``: rows without texts, for which fewer tasks will do; ``rows``: about
    how many there are. Rounds that work on few rows so write few files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    most = max(FEW, partitions(spark) // SLIM) if rows is None else min(partitions(spark), rows // FILE_ROWS + 1)
    # nothing looks for the mark of a whole table, whose path nobody else knows
    (df.coalesce(most) if slim else df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Clear away what finished rounds left, unless that was done just now.

    Executors keep the shuffle files and broadcasts of a plan until the driver
    collects its garbage, which a driver with memory to spare puts off while
    their disks fill. What is free then goes back to the system.
    """
    global _settled
    if time.monotonic() - _settled < SETTLE:
        return
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    trim()
    try:
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call[1] = "systemTrimNativeHeap"
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # a JVM without that command
        pass
    _settled = time.monotonic()


def kept(df: DataFrame) -> DataFrame:
    """``df`` on its executors' disks once it is computed; what a lost one held is computed again.

    For slim tables that later steps read more than once, not for loops: the
    lineage stays. What is kept must come out the same when computed again.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    _kept.append(df)
    return df


def release(spark: SparkSession) -> None:
    """Drop all kept and written tables: results that are still to be read must be stored before."""
    while _kept:
        _kept.pop().unpersist()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        at.getFileSystem(hadoop).delete(at, True)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null has another key than an empty text."""
    return F.unhex(F.coalesce(F.md5(text.cast("binary")), F.lit("")))


def row_key(docs: DataFrame, text: str = "text") -> Column:
    """128 bits that stand for a row's values in all columns, whatever their names."""
    rest = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]), {"ignoreNullFields": "false"})
    return F.unhex(F.md5(F.concat(F.hex(text_key(F.col(f"`{text}`"))), F.lit("|"), rest).cast("binary")))


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``written`` table that is no longer read."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if at.getName().startswith("gridloom-"):
            at.getFileSystem(hadoop).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    here = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom_llm.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for name in ["__init__.py", *(f"llm/{p.name}" for p in (here / "llm").glob("*.py"))]:
            z.write(here / name, f"{here.name}/{name}")
    sc.addPyFile(str(bundle))
    sc._gridloom_shipped = True
