"""Registered queries on a small table: DuckDB twins, columns of the contracts, the pipeline against brute force."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF_SMALL
from oracle import compare, duck
from plain import jaccard_components, shingles
from trialstats.llm import catalog
from trialstats.llm.quality import judge_quality, train_on_labels
from trialstats.llm.secrets import find_secrets, redact

COLUMNS = {
    "op1_jaccard": "doc_id n_shingles component_id", "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to", "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8_toxicity": "doc_id held_out score predicted",
    "op9_decontamination": "doc_id item_id", "op10_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op4_chat": "conv_id turn role n_lines text rendered",
    "op11_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_transcript_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}


def test_one_query_for_each_operator():
    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and set(names) == set(COLUMNS) == set(catalog.queries())
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF_SMALL)
    assert df.columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
    got = df.toPandas()
    assert len(got)
    if name in catalog.oracle_sql():
        assert compare(got, duck(SF_SMALL).execute(catalog.oracle_sql()[name]).df()) is None


def test_pipeline_equals_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    kept = {r["doc_id"] for r in judge_quality(docs, train_on_labels(docs, labels)).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, jaccard_components(rows)) if c == d]
    items = [shingles(r["text"]) for r in bench.collect()]
    rows = [(d, t) for d, t in rows if not any(i and 100 * len(shingles(t) & i) >= 75 * len(i) for i in items)]
    want = {d: redact(t, find_secrets(t)) for d, t in rows}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF_SMALL)
        assert out.columns == docs.columns, name
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    packed = corpus_pipeline.run(spark, SF_SMALL).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in packed} == set(want) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
