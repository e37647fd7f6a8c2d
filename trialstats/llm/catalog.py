"""The queries of this subpackage, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.llm import toxicity
from trialstats.llm.chat import as_transcript, parse, train
from trialstats.llm.decontaminate import find_leaks
from trialstats.llm.jaccard import jaccard_components
from trialstats.llm.lm import score
from trialstats.llm.packing import pack
from trialstats.llm.quality import COUNTS, judge_quality, train_on_labels
from trialstats.llm.runs import periodic_runs, run_digest
from trialstats.llm.secrets import scan
from trialstats.llm.sharding import shard_documents
from trialstats.llm.suffix import without_repeats
from trialstats.llm.transcript_repair import audits, damaged, placed, repair_summary
from trialstats.llm.warc import archive_round_trip
from trialstats.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("set_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT hex, any_value(page_id) AS last, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // w) % 32 AS INT) + 1, 1), '' ORDER BY i, w DESC) AS digest
      FROM (SELECT DISTINCT hex FROM p) JOIN (SELECT hex AS h2, max(page_id) AS page_id FROM p GROUP BY 1) ON hex = h2,
           (SELECT i, CAST(0 AS BIGINT) AS z FROM range(8) t(i)), (SELECT unnest([1, 32, 1024, 32768]) AS w),
           LATERAL (SELECT CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT) AS v)
      GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN d USING (hex)
"""


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are hidden from the parser; two of three conversations (by a hash of their id) train it."""
    chunks = as_transcript(table(spark, sf_dir, "conversations"))
    model = train(chunks.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 != 1))
    return parse(chunks.drop("role"), model)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train_on_labels(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, trees).select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def fold(doc_id):
        return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3

    model = toxicity.train(docs, labels.where(fold(F.col("doc_id")) != 1))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted", "evidence")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CTEs (id, shingle): the distinct 5-word shingles of a table's texts, as the operators define them.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(name: str, table_name: str, id_col: str) -> str:
    return rf"""{name}_w AS MATERIALIZED (SELECT {id_col}, row_number() OVER () AS rid, regexp_extract_all({_LOWER}, '[^ 	-
]+') AS w FROM {table_name}),
{name} AS (SELECT DISTINCT rid, {id_col}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_w WHERE len(w) > 0))"""


OP9_SQL = f"""
WITH {shingle_sql('d', 'documents', 'doc_id')}, {shingle_sql('b', 'benchmark', 'item_id')},
n AS (SELECT rid, item_id, count(*) AS item_shingles FROM b GROUP BY ALL)
SELECT d.doc_id, b.item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles
FROM d JOIN b USING (shingle) JOIN n ON n.rid = b.rid
GROUP BY d.rid, b.rid, d.doc_id, b.item_id HAVING 100 * count(*) >= 75 * any_value(item_shingles)
"""


OP1_SQL = f"""
WITH RECURSIVE {shingle_sql('s', 'documents', 'doc_id')},
sets AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS k FROM s GROUP BY rid),
one AS (SELECT k, min(rid) AS rid, any_value(n) AS n FROM sets GROUP BY k),
members AS (SELECT one.rid, one.n, shingle FROM one JOIN s USING (rid)),
links AS (SELECT x.rid AS a, y.rid AS b FROM members x JOIN members y ON x.shingle = y.shingle AND x.rid <> y.rid
          GROUP BY x.rid, y.rid HAVING 175 * count(*) >= 75 * (any_value(x.n) + any_value(y.n))),
reach AS (SELECT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS rid, min(b) AS c FROM reach GROUP BY a),
labelled AS (SELECT sets.*, coalesce(c, one.rid) AS c FROM sets JOIN one USING (k) LEFT JOIN component ON component.rid = one.rid),
least AS (SELECT c, min(doc_id) AS component_id FROM labelled GROUP BY c)
SELECT w.doc_id, CAST(coalesce(labelled.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM s_w w LEFT JOIN labelled ON labelled.rid = w.rid LEFT JOIN least USING (c)
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text, by a hash of its id, is made periodic first; texts without an id stay as they are."""
    return run_digest(periodic_runs(table(spark, sf_dir, "documents"), plant_key="crc32(cast(cast(doc_id AS string) AS binary))"))


def op13_transcript_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(damaged(table(spark, sf_dir, "conversations")))
    return repair_summary(rows, audits(rows))


def queries() -> dict[str, QueryFn]:
    return {"op1_jaccard": op1_jaccard, "op2_packing": op2_packing, "op3_warc": op3_warc, "op4_chat": op4_chat, "op5_sharding": op5_sharding, "op6_lm": op6_lm, "op7_quality": op7_quality, "op8_toxicity": op8_toxicity,
            "op9_decontamination": op9_decontamination, "op10_secrets": op10_secrets, "op11_suffix_dedup": op11_suffix_dedup, "op12_periodic_runs": op12_periodic_runs, "op13_transcript_repair": op13_transcript_repair}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": OP1_SQL, "op3_warc": OP3_SQL, "op9_decontamination": OP9_SQL}
