"""Small files through Hadoop's file systems, so that a root may lie in any store Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then take its place in one rename: readers find the old text or the new one."""
    fs, at = _at(spark, path)
    at = at.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    beside = at.suffix(".tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(beside, at, options)


def copy_tree(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder, without lock and temporary files."""
    (fs, a), (other, b) = _at(spark, source), _at(spark, target)
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    other.mkdirs(b)
    for s in fs.listStatus(a):
        name = s.getPath().getName()
        if name.endswith((".lock", ".tmp")):
            continue
        if s.isDirectory():
            copy_tree(spark, s.getPath().toString(), f"{target}/{name}")
        else:
            util.copy(fs, s.getPath(), other, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}"), False, True, conf)
