"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by the text's SHA-256. A batch
is reduced to one row per digest (with map-side combine), anti-joined to the
index by sort-merge (the index side needs no shuffle), and what is new is
appended to it. Only then is the keeper joined back to the batch's rows, in a
plain equi-join whose large groups adaptive execution can split.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import kept, new_path, partitions, written

_LEAST = -(2**63)
_VERSION = re.compile(r"buckets-(\d+)-v(\d+)$")


class DigestIndex:
    """A digest index in the folder ``path``, kept from session to session.

    Its files lie in a folder ``buckets-B-vN``: the number of buckets is part of
    the index, whatever the session's shuffle partitions are, and opening it
    with another one is refused. Appends leave several files a bucket;
    ``compact`` writes one each, as version N + 1, and the greatest version that
    is whole counts, so a compaction that breaks off changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._versions()
        if found and buckets and buckets != found[-1][1]:
            raise ValueError(f"the index at {path} has {found[-1][1]} buckets, not {buckets}")
        self.version, self.buckets = found[-1] if found else (0, buckets or partitions(spark))
        self.table = self._table(self.version)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, int]]:
        at, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        whole = [m for m in map(_VERSION.match, names) if m and (m[2] == "0" or self._sealed(m[0]))]
        return sorted((int(m[2]), int(m[1])) for m in whole)

    def _sealed(self, name: str) -> bool:
        at, fs = self._fs(f"{self.path}/{name}.whole")
        return fs.exists(at)

    def _folder(self, version: int) -> str:
        return f"{self.path}/buckets-{self.buckets}-v{version}"

    def _table(self, version: int) -> str:
        at, fs = self._fs(self._folder(version))
        fs.mkdirs(at)
        table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._folder(version)}'"
        )
        return table

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, fresh: DataFrame, table: str, version: int) -> None:
        writer = fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.option("path", self._folder(version)).saveAsTable(table)

    def append(self, fresh: DataFrame) -> None:
        # dealt by digest, so that each bucket gets one file
        self._append(fresh.repartition(self.buckets, "digest"), self.table, self.version)

    def compact(self) -> None:
        """One sorted file a bucket again; the bucketed read needs no shuffle."""
        version = self.version + 1
        at, fs = self._fs(self._folder(version))
        fs.delete(at, True)  # what a compaction that broke off has left
        table = self._table(version)
        rows = self.spark.read.schema(self.rows().schema).parquet(self._folder(self.version))
        self._append(rows.repartition(self.buckets, "digest"), table, version)
        seal, _ = self._fs(f"{self._folder(version)}.whole")
        fs.create(seal).close()
        old, old_folder = self.table, self._folder(self.version)
        self.table, self.version = table, version
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        for name in (old_folder, f"{old_folder}.whole"):
            fs.delete(self._fs(name)[0], True)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Deduplicate a batch against itself and the index, and append it.

        One row per input row: doc_id, keep_id, group_size (rows of this batch
        with the text), kept, text_sha256. Null text counts as empty. Of equal
        texts of a batch the largest doc_id stays (null ids least); of rows
        that repeat both id and text, one. A text that an earlier batch has
        put into the index is not kept again. Other columns are ignored; an
        empty batch gives no rows.
        """
        batch = uuid.uuid4().hex
        rows = written(
            docs.select(
                F.col(doc_id).cast("long").alias("doc_id"),
                F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"),
            ).withColumn("row", F.monotonically_increasing_id()),
            "digests",
            slim=False,
        )
        groups = kept(
            rows.groupBy("digest").agg(
                F.max("doc_id").alias("keep_id"),
                F.max_by("row", F.coalesce("doc_id", F.lit(_LEAST))).alias("keep_row"),
                F.count(F.lit(1)).alias("group_size"),
            )
        )
        fresh = groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self.append(fresh.select("digest", "keep_id", "keep_row", F.lit(batch).alias("batch")))
        keepers = written(groups.select("digest", "group_size").join(self.rows(), "digest"), "keepers")
        return rows.join(keepers, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``docs`` against the index at ``path``, a new one where none is given."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or new_path(spark, "digest-index"), buckets)
    try:
        return index.ingest(docs)
    finally:
        index.close()
