"""Secret scans over an incremental blob ledger.

Every version of every text is a blob, addressed by its SHA-256. The ledger
holds the findings of each (blob, rule, rule version) that was ever scanned,
empty findings too. A scan takes only pairs that the ledger lacks, each blob
once, and findings are joined back to all paths (documents) that hold the blob.
Everything is built of DataFrame functions: the gaps that ``split`` leaves
between a rule's matches give the matches' places, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import kept, new_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: The three base rules, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", r"([0-9a-f]+)", 1, 24),
)
#: A cheaper test for texts that may match: what each match must hold.
_HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}

_FOUND = "array<struct<start:int,at:int,end:int,kind:string>>"


def found(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in ``text``: struct(start, order of the rule, end, kind)."""
    long_runs = rule.pattern
    if rule.kind == "access":  # a match holds the rest of its run of characters, so a shorter one has no longer one inside
        long_runs = r"(AKIA[A-Z0-9]{16,})"
    elif rule.kind == "hex":
        long_runs = r"([0-9a-f]{24,})"
    gaps = F.transform(F.split(text, long_runs, -1), F.length)
    groups = F.regexp_extract_all(text, F.lit(long_runs), F.lit(rule.group))
    matches = F.regexp_extract_all(text, F.lit(long_runs), F.lit(0))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("hit"), groups.alias("group"))
    spans = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("end"), F.array().cast(_FOUND).alias("spans")),
        lambda done, m: F.struct(
            (done["end"] + m["gap"] + F.length(m["hit"])).alias("end"),
            F.when(
                F.length(m["group"]) >= rule.least,
                F.concat(
                    done["spans"],
                    F.array(F.struct(
                        (done["end"] + m["gap"]).alias("start"),
                        F.lit(order).alias("at"),
                        (done["end"] + m["gap"] + F.length(m["hit"])).alias("end"),
                        F.lit(rule.kind).alias("kind"),
                    )).cast(_FOUND),
                ),
            ).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    may = text.rlike(_HINTS[rule.kind]) if rule.kind in _HINTS else F.lit(True)
    return F.when(may, spans).otherwise(F.array().cast(_FOUND))


class BlobLedger:
    """Findings by (blob, rule, version), as Parquet folders under ``path``."""

    schema = f"blob binary, rule string, version int, found {_FOUND}"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
        """Scan what the ledger lacks of ``docs`` and give all paths' findings.

        One row per input row: doc_id, found (spans by start, then rule order).
        Null text is empty. Rows that repeat are scanned once and all returned.
        Other columns are ignored; no rows give no rows.
        """
        texts = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        paths = kept(texts.select("doc_id", "blob"))
        current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
        pairs = blobs.select("blob", "doc_id", F.inline(current))
        todo = pairs.join(self.rows().select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
        wanted = todo.groupBy("blob", "doc_id").agg(F.collect_set("rule").alias("rules"))
        source = texts.withColumnRenamed("blob", "b").withColumnRenamed("doc_id", "d")
        # the wanted pairs are built into a hash table; the texts stream past it unsorted
        to_scan = source.join(wanted.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("b") == F.col("blob")))
        per_rule = F.array(*[
            F.struct(
                F.lit(r.kind).alias("rule"),
                F.lit(r.version).alias("version"),
                F.when(F.array_contains("rules", r.kind), found(F.col("text"), r, i)).alias("found"),
            )
            for i, r in enumerate(rules)
        ])
        scanned = to_scan.select("blob", F.inline(per_rule)).where(F.col("found").isNotNull())
        scanned.write.mode("append").parquet(self.path)
        held = F.broadcast(self.spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int"))
        hits = self.rows().where(F.size("found") > 0).join(held, ["rule", "version"], "left_semi")
        # a blob may be listed twice where its first path is: rows repeating id and text
        by_blob = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
        return paths.join(by_blob, "blob", "left").select("doc_id", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Secrets of every text with the ledger at ``path`` (a new one if none is given).

    doc_id, n_<kind> of each rule, base_sha256 (of the base rules' list), spans.
    """
    ledger = BlobLedger(docs.sparkSession, path or new_path(docs.sparkSession, "ledger"))
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return ledger.scan(docs, rules).select(
        "doc_id",
        *[count(r.kind) for r in rules],
        F.sha2(listed(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
