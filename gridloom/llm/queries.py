"""The ten operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.lines import line_report
from gridloom.llm.minhash import near_dedup
from gridloom.llm.mixing import mix_sources
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import quality_report
from gridloom.llm.secrets import secret_spans
from gridloom.llm.substrings import substring_dedup
from gridloom.llm.token_counts import token_counts
from gridloom.llm.vectors import embedding_dedup


def tokenizer(name: str) -> str:
    """A tokenizer file's path; the files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(_documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"), F.round("first_position", 9).alias("first_position"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir), size=3, similar=(85, 100))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_token_counts, op3_line_dedup, op4_secrets, op5_exact_dedup, op6_quality, op7_minhash, op8_packing, op9_embeddings, op10_substring_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": """
        WITH d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[^w]', '', 'g'))::BIGINT AS size,
                          md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
             k AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS kind FROM s),
             w AS (SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS most FROM k),
             l AS (SELECT *, (sum(source_size) OVER ()::BIGINT - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                              / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level FROM w),
             t AS (SELECT source, source_size, kind, least(most::DOUBLE, weight * (SELECT arg_min(level, most / weight) FROM l WHERE level * weight <= most)) AS target FROM l),
             o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
             c AS (SELECT o.*, t.source_size, target, kind, CASE WHEN size > 0 THEN (start + size / 2 <= target)::BIGINT + (start + t.source_size + size / 2 <= target)::BIGINT + (start + 2 * t.source_size + size / 2 <= target)::BIGINT ELSE 0 END AS copies,
                          start / target AS share FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
             q AS (SELECT *, CASE WHEN kind = 2 AND share >= 0.2 / 0.9 THEN 0.5 ELSE 0 END AS t0, CASE WHEN kind = 2 AND share >= 0.2 / 0.9 THEN 0.2 / 0.9 ELSE 0 END AS g0,
                          CASE WHEN kind = 0 THEN 1.5 WHEN kind = 1 THEN 1 WHEN share >= 0.2 / 0.9 THEN 0.6 / 0.9 ELSE 0.2 / 0.9 END::DOUBLE AS h0,
                          CASE WHEN kind = 0 THEN -1 WHEN kind = 1 THEN 0 WHEN share >= 0.2 / 0.9 THEN 3.2 / 0.9 ELSE 0.8 / 0.9 END::DOUBLE AS slope FROM c)
        SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
               CASE WHEN copies > 0 THEN round(least(1, t0 + 2 * (share - g0) / (h0 + sqrt(greatest(0, h0 * h0 + 2 * slope * (share - g0))))), 9) END AS first_position
        FROM q""",
    "op3_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
             u AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
             f AS (SELECT *, row_number() OVER w AS pos, sum(length(line)) OVER w AS upto FROM u WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
             p AS (SELECT x.doc_id, x.pos, y.doc_id AS other, x.pos - y.pos AS shift FROM f x JOIN f y ON x.line = y.line AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.pos < x.pos)),
             g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY pos) AS island FROM p),
             e AS (SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id, other, shift, island) - pos + 1 AS n FROM g),
             m AS (SELECT doc_id, pos, max(n) AS n FROM e GROUP BY doc_id, pos),
             r AS (SELECT m.*, coalesce(before.n, 0) <= m.n AS maximal FROM m LEFT JOIN m before ON before.doc_id = m.doc_id AND before.pos = m.pos - 1),
             k AS (SELECT r.doc_id, r.pos, r.n FROM r JOIN f a ON a.doc_id = r.doc_id AND a.pos = r.pos JOIN f b ON b.doc_id = r.doc_id AND b.pos = r.pos + r.n - 1
                   WHERE maximal AND b.upto - a.upto + length(a.line) >= 40),
             x AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM k),
             t AS (SELECT u.doc_id, u.line, u.i, f.pos, x.pos AS gone FROM u LEFT JOIN f ON f.doc_id = u.doc_id AND f.i = u.i LEFT JOIN x ON x.doc_id = f.doc_id AND x.pos = f.pos),
             s AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM k GROUP BY doc_id)
        SELECT t.doc_id, count(pos) AS n_lines, count(gone) AS n_removed, coalesce(any_value(n_runs), 0)::BIGINT AS n_runs, coalesce(any_value(longest_run), 0)::BIGINT AS longest_run,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) AS kept_sha256
        FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
             n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
             p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
             e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
             r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op9_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
             p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
             r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
             n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
        FROM v JOIN r ON r.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id, n.n""",
    "op10_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
             r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) AS nth FROM p),
             c AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE nth > 1) GROUP BY doc_id),
             k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
             t AS (SELECT doc_id, word, n, g.k IS NULL AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS n FROM k) u LEFT JOIN (SELECT doc_id AS o, unnest(gone) AS k FROM k) g ON g.o = u.doc_id AND g.k = u.n),
             s AS (SELECT doc_id, sha256(coalesce(string_agg(word, ' ' ORDER BY n) FILTER (kept), '')) AS h, count(*) FILTER (NOT kept) AS gone FROM t GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(s.gone, 0)::BIGINT AS n_removed, coalesce(s.h, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
}
