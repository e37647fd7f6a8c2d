"""Catalogue, part 2: trial-table operators, wide-log fixture, driver-table operators."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions import scalars as X
from trialstats.operators import columns as P
from trialstats.operators import joins as J
from trialstats.operators import missing as N
from trialstats.operators import outliers as O
from trialstats.operators import reshape as R
from trialstats.operators import stats as S
from trialstats.operators.sequence import first_per, ordered_scan
from trialstats.plans import metrics as M
from trialstats.plans.catalog import CBAL, ORDER_CASE, S1, _long, _trial_query, register, trials
from trialstats.plans.coding_rules import PILOT_2, code, trials_pilot2
from trialstats.plans.oracle_sql import EVENTS_BASE, summary_sql, with_trials
from trialstats.plans.trials import (
    COUNTERBALANCES, LOOP_FIELDS, code_switches, code_trials, coded_events, collapsed_loops, counterbalance, block_order, cued_task,
    events_as_trials, loop_name, pilot2_logs_from_events, wide_logs_from_events,
)
from trialstats.session import materialize
from trialstats.sources.csv_logs import stack_by_name
from trialstats.sources.tables import table

TRIAL_COLS = ("id, countBal, cBal, block, blockNr, trialNr, trial_type, task_cued, task_perf, resp, rt, corr, "
              "switch_type, switch")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _wide(spark, sf_dir) -> DataFrame:
    """The wide-log fixture: ``events`` in the reference's one-hot log shape, written to the shared folder anew for
    each query (it stands for the CSV logs on disk; a plan over its hundred computed columns would not compile)."""
    return materialize(wide_logs_from_events(_events(spark, sf_dir)), "wide_logs")


# ================================================================ D9-D12: coding

register("switch_type", with_trials() + """
SELECT id, blockNr, trialNr, event_id, task_perf, switch_type, switch FROM coded3""")(
    lambda spark, sf: coded_events(_events(spark, sf))
    .select("id", "blockNr", "trialNr", "event_id", "task_perf", "switch_type", "switch"))

register("trials_coded", with_trials() + "SELECT * FROM trials")(
    lambda spark, sf: code_trials(_wide(spark, sf), file_key="participant"))

register("trials_coded_full", with_trials() + """
SELECT c.id, countBal, cBal, e.event_type AS type, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS location,
       CASE WHEN k % 5 < 2 THEN 'circle' ELSE 'square' END AS shape, trial_type, block, task_cued, task_perf,
       CASE WHEN trial_type = 'forced' THEN CASE WHEN task_perf = task_cued THEN 'yes' ELSE 'no' END END AS cuefol,
       blockNr, trialNr, resp, rt, corr, switch_type, switch
FROM coded3 c JOIN events e USING (event_id) WHERE corr < 999 AND length(resp) <= 1""")(
    lambda spark, sf: code_trials(_wide(spark, sf), stimulus=True))

register("trials_from_events", with_trials() + "SELECT * FROM trials")(trials)

register("switch_type_legacy", with_trials("""
lg AS (SELECT id, blockNr, event_id, task_perf,
              lag(task_perf) OVER (PARTITION BY id ORDER BY ts, event_id) AS prev FROM ev4)""") + """
SELECT id, blockNr, event_id, task_perf,
       CASE WHEN task_perf = 'shape' AND prev = 'shape' THEN 'stay_shape'
            WHEN task_perf = 'loc' AND prev = 'loc' THEN 'stay_loc'
            WHEN task_perf = 'shape' AND prev = 'loc' THEN 'switch_shape'
            WHEN task_perf = 'loc' AND prev = 'shape' THEN 'switch_loc' ELSE 'unknownSwitch' END AS switch_type,
       CASE WHEN task_perf = prev AND task_perf IN ('loc', 'shape') THEN CAST(0 AS DOUBLE)
            WHEN task_perf IN ('loc', 'shape') AND prev IN ('loc', 'shape') THEN CAST(1 AS DOUBLE) END AS switch
FROM lg""")(lambda spark, sf: code_switches(events_as_trials(_events(spark, sf)), keys=("id",),
                                            order=("ts", "event_id"), unknown="unknownSwitch")
            .select("id", "blockNr", "event_id", "task_perf", "switch_type", "switch"))

# ================================================================ wide-log fixture operators (N, F, X)

register("coalesce_wide", with_trials() + """
SELECT event_id, resp, rt, corr, trialNr FROM coded3""")(
    lambda spark, sf: _coalesce_wide(_wide(spark, sf)))


def _coalesce_wide(w: DataFrame) -> DataFrame:
    keys = P.matching(w, "both_", "_keys")
    rts = P.matching(w, "both_", "_rt")
    corrs = P.matching(w, "both_", "_corr")
    this_n = P.matching(w, "nTrials", "_thisN")
    out = N.coalesce_wide(w, keys, "resp", null_value="None")
    out = N.coalesce_wide(out, rts, "rt", cast="double")
    out = N.coalesce_wide(out, corrs, "corr", cast="int", null_value="888")
    out = N.coalesce_wide(out, this_n, "_n", cast="int")
    return out.select("event_id", "resp", "rt", "corr", (F.col("_n") + 1).alias("trialNr"))


# ---------------------------------------------------------------- pilots 2-3: rules as data

_P2 = """p2 AS (
  SELECT id, ts, event_id, CASE WHEN task_perf = 'shapeloc' THEN 'shape' WHEN k = 13 THEN 'unknownTask' ELSE task_perf END AS task,
         CASE WHEN task_perf = 'shapeloc' THEN 'none' WHEN k IN (13, 14) THEN 'unknown' ELSE 'one' END AS kind, resp, corr, rt FROM ev4),
pilot2 AS (
  SELECT id, ts, event_id, task AS task_perf, CASE kind WHEN 'one' THEN resp WHEN 'unknown' THEN 'unknownResp' END AS resp,
         CASE kind WHEN 'one' THEN CAST(corr AS VARCHAR) WHEN 'unknown' THEN 'unknownCorr' END AS corr,
         CASE kind WHEN 'one' THEN rt END AS rt, lag(task) OVER (PARTITION BY id ORDER BY ts, event_id) AS prev FROM p2)"""

register("performed_task_pilot2", with_trials(_P2) + "SELECT event_id, task_perf FROM pilot2")(
    lambda spark, sf: code(pilot2_logs_from_events(_events(spark, sf)), PILOT_2[:1]).select("event_id", "task_perf"))

register("coalesce_wide_pilot2", with_trials(_P2) + "SELECT event_id, resp, corr, rt FROM pilot2")(
    lambda spark, sf: code(pilot2_logs_from_events(_events(spark, sf)), PILOT_2).select("event_id", "resp", "corr", "rt"))

register("trials_pilot2", with_trials(_P2) + """
SELECT id, ts, event_id, task_perf, resp, corr, rt,
       CASE WHEN task_perf IN ('loc', 'shape') AND prev IN ('loc', 'shape')
            THEN CASE WHEN task_perf = prev THEN 'stay_' ELSE 'switch_' END || task_perf ELSE 'unknownSwitch' END AS switch_type,
       CASE WHEN task_perf IN ('loc', 'shape') AND prev IN ('loc', 'shape') THEN CAST(task_perf <> prev AS INTEGER)::DOUBLE END AS switch
FROM pilot2 WHERE corr <> '999'""")(lambda spark, sf: trials_pilot2(pilot2_logs_from_events(_events(spark, sf))))

register("loop_collapse", "WITH " + EVENTS_BASE.strip() + """,
lastr AS (SELECT *, row_number() OVER (PARTITION BY id, blockNr ORDER BY ts DESC, event_id DESC) = 1 AS is_last FROM coded3)
SELECT event_id, """ + ", ".join(f"CAST(CASE WHEN is_last THEN {e} END AS INTEGER) AS nBlocks_{f}" for f, e in zip(
    LOOP_FIELDS, ("blockNr - 1", "blockNr % 2", "blockNr + 3", "blockNr * 7"))) + ", " + ", ".join(
    f"CAST({e} AS INTEGER) AS nTrials_{f}" for f, e in zip(LOOP_FIELDS, (
        "(trialNr - 1) // 16", "(trialNr - 1) % 16", "trialNr - 1", "trialNr + 99"))) + " FROM lastr")(
    lambda spark, sf: collapsed_loops(_wide(spark, sf), ["event_id"]))


register("fill_up", with_trials() + "SELECT event_id, blockNr FROM coded3")(
    lambda spark, sf: _fill_up(_wide(spark, sf)))


def _fill_up(w: DataFrame) -> DataFrame:
    reps = P.matching(w, "nBlocks", "_thisRepN")
    w = w.withColumn("_blk", X.to_int(X.unite(reps)) + 1)
    w = ordered_scan(w, ["participant"], ["ts", "event_id"], fill_up={"blockNr": "_blk"})
    return w.select("event_id", "blockNr")


register("performed_task", with_trials() + "SELECT event_id, task_perf FROM coded3")(
    lambda spark, sf: _performed_task(_wide(spark, sf)))


def _performed_task(w: DataFrame) -> DataFrame:
    loc = [F.nullif(F.col(c), F.lit("None")) for c in P.matching(w, "both_loc_", "_keys")]
    shape = [F.nullif(F.col(c), F.lit("None")) for c in P.matching(w, "both_shape_", "_keys")]
    t1 = F.when(X.all_null(loc), F.lit("shape"))
    t2 = F.when(X.all_null(shape), F.lit("loc"))
    return w.select("event_id", X.unite([t1, t2]).alias("task_perf"))


register("filter_any_not_null", with_trials() + """
SELECT event_id, id FROM coded3 WHERE task_perf IN ('loc', 'shape')""")(
    lambda spark, sf: _any_key(_wide(spark, sf)))


def _any_key(w: DataFrame) -> DataFrame:
    keys = P.matching(w, "both_", "_keys")
    w = N.value_to_null(w, keys, "None")
    return N.filter_any_not_null(w, keys).select("event_id", X.to_long("participant").alias("id"))


register("value_to_null", with_trials() + """
SELECT event_id, CAST(CASE WHEN task_perf IN ('loc', 'shape') THEN 1 ELSE 0 END AS INTEGER) AS n_keys,
       CAST(16 - CASE WHEN task_perf IN ('loc', 'shape') THEN 1 ELSE 0 END AS INTEGER) AS n_missing
FROM coded3""")(lambda spark, sf: _value_to_null(_wide(spark, sf)))


def _value_to_null(w: DataFrame) -> DataFrame:
    keys = P.matching(w, "both_", "_keys")
    w = N.value_to_null(w, keys, "None")
    present = sum((F.col(c).isNotNull().cast("int") for c in keys), F.lit(0))
    return w.select("event_id", present.cast("int").alias("n_keys"),
                    (F.lit(len(keys)) - present).cast("int").alias("n_missing"))


_LAST = EVENTS_BASE.strip() + """,
lastr AS (SELECT *, row_number() OVER (PARTITION BY id, blockNr ORDER BY ts DESC, event_id DESC) = 1 AS is_last
          FROM coded3)
"""

register("row_sum", "WITH " + _LAST + """
SELECT event_id, CAST(NULL AS INTEGER) AS block_sum_strict,
       CAST(CASE WHEN is_last THEN blockNr - 1 ELSE 0 END AS INTEGER) AS block_sum FROM lastr""")(
    lambda spark, sf: _row_sum(_wide(spark, sf)))


def _row_sum(w: DataFrame) -> DataFrame:
    reps = [X.to_int(c) for c in P.matching(w, "nBlocks", "_thisRepN")]
    return w.select("event_id", X.row_sum(reps, na_rm=False).cast("int").alias("block_sum_strict"),
                    X.row_sum(reps, na_rm=True).cast("int").alias("block_sum"))


register("pick_one_of_two", "WITH " + _LAST + """
SELECT event_id, CAST(CASE WHEN is_last THEN blockNr - 1 END AS INTEGER) AS blockRep
FROM lastr""")(lambda spark, sf: _pick(_wide(spark, sf)))


def _pick(w: DataFrame) -> DataFrame:
    """The counter of the mixed or the free blocks of each counterbalance; a row has values in its own counterbalance only."""
    for cb in COUNTERBALANCES:
        w = N.pick_one_of_two(w, loop_name("Blocks", "mix", cb, "thisRepN"), loop_name("Blocks", "free", cb, "thisRepN"), f"_p{cb}")
    return w.select("event_id", X.to_int(F.coalesce(*[f"_p{cb}" for cb in COUNTERBALANCES])).alias("blockRep"))


register("filter_all_not_null", with_trials() + """
SELECT event_id, resp, task_cued FROM coded3 WHERE resp != '' AND task_cued IS NOT NULL""")(
    lambda spark, sf: N.filter_all_not_null(
        N.blank_to_null(coded_events(_events(spark, sf)).select("event_id", "resp", "task_cued")),
        ["resp", "task_cued"]))

register("blank_to_null", with_trials() + """
SELECT event_id, nullif(resp, '') AS resp, nullif(task_perf, '') AS task_perf FROM coded3""")(
    lambda spark, sf: N.blank_to_null(events_as_trials(_events(spark, sf)).select("event_id", "resp", "task_perf")))

_CODED_COLS = ["id", "countBal", "cBal", "block", "blockNr", "trialNr", "trial_type", "task_cued", "task_perf",
               "resp", "rt", "corr", "switch_type", "switch"]
register("null_profile", with_trials() + "SELECT " + ", ".join(
    f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in _CODED_COLS) + " FROM coded3")(
    lambda spark, sf: S.null_profile(coded_events(_events(spark, sf)).select(*_CODED_COLS)))

# ================================================================ D1, D2, D6 and scalar functions

register("counterbalance", """
SELECT c_custkey, CAST(CASE WHEN ((c_custkey % 4) + 4) % 4 = 0 THEN 4 ELSE ((c_custkey % 4) + 4) % 4 END AS INTEGER)
         AS countBal,
       CAST(CASE WHEN (((c_nationkey - 12) % 4) + 4) % 4 = 0 THEN 4 ELSE (((c_nationkey - 12) % 4) + 4) % 4 END
         AS INTEGER) AS countBal_signed
FROM customer""")(lambda spark, sf: table(spark, sf, "customer").select(
    "c_custkey", counterbalance("c_custkey").alias("countBal"),
    counterbalance(F.col("c_nationkey") - 12).alias("countBal_signed")))

register("block_order", """
SELECT c_custkey, CASE WHEN ((c_custkey % 4) + 4) % 4 IN (1, 3) THEN 'mix-free' ELSE 'free-mix' END AS cBal
FROM customer""")(lambda spark, sf: table(spark, sf, "customer").select(
    "c_custkey", block_order(counterbalance("c_custkey")).alias("cBal")))

register("cued_task", """
SELECT event_id, CASE ((TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) + 4) % 4
                   WHEN 0 THEN 'XXXX' WHEN 1 THEN 'JAKI' WHEN 2 THEN 'GDZIE' ELSE 'xyz' END AS cue,
       CASE ((TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) + 4) % 4
                   WHEN 0 THEN 'any' WHEN 1 THEN 'shape' WHEN 2 THEN 'loc' ELSE 'unknownTask' END AS task_cued
FROM events""")(lambda spark, sf: _cued(_events(spark, sf)))


def _cued(e: DataFrame) -> DataFrame:
    k4 = X.rmod(F.get_json_object("props", "$.k").try_cast("int"), 4)
    cue = F.when(k4 == 0, "XXXX").when(k4 == 1, "JAKI").when(k4 == 2, "GDZIE").otherwise("xyz")
    return e.select("event_id", cue.alias("cue")).withColumn("task_cued", cued_task("cue"))


register("scalar_text", """
SELECT c_custkey, lower(c_name) AS name_lower, CAST(length(c_name) AS INTEGER) AS name_len,
       substr(c_name, 1, 2) AS part1, substr(c_name, 3, 1) AS part2, substr(c_name, 4) AS part3
FROM customer""")(lambda spark, sf: _scalar_text(table(spark, sf, "customer")))


def _scalar_text(c: DataFrame) -> DataFrame:
    p1, p2, p3 = X.split_fixed("c_name", [2, 3])
    return c.select("c_custkey", F.lower("c_name").alias("name_lower"), F.length("c_name").alias("name_len"),
                    p1.alias("part1"), p2.alias("part2"), p3.alias("part3"))


register("safe_cast", """
SELECT o_orderkey, CAST(trunc(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE)) AS INTEGER) AS price_int,
       TRY_CAST(o_orderpriority AS DOUBLE) AS prio_num,
       CAST(trunc(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS INTEGER) AS prio_int,
       CAST(trunc(TRY_CAST(nullif(o_orderstatus, o_orderstatus) AS DOUBLE)) AS INTEGER) AS blank_int
FROM orders""")(lambda spark, sf: _safe_cast(table(spark, sf, "orders")))


def _safe_cast(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", X.to_int(X.to_str("o_totalprice")).alias("price_int"),
                    X.to_double("o_orderpriority").alias("prio_num"),
                    X.to_int(F.substring("o_orderpriority", 1, 1)).alias("prio_int"),
                    X.to_int(F.lit("")).alias("blank_int"))


register("remap_ids", """
SELECT CAST(CASE user_id WHEN 7 THEN 108 WHEN 13 THEN 111 ELSE user_id END AS BIGINT) AS id,
       CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1""")(lambda spark, sf: S.count_by(
    _events(spark, sf).select(X.remap("user_id", {7: 108, 13: 111}).alias("id")), ["id"]))

register("row_sum_complete", """
SELECT l_orderkey, l_linenumber, CAST(l_partkey + l_suppkey + l_linenumber AS BIGINT) AS whole,
       CASE WHEN l_linenumber <> 3 THEN CAST(l_partkey + l_suppkey + l_linenumber AS BIGINT) END AS strict,
       CAST(l_partkey + l_suppkey + coalesce(nullif(l_linenumber, 3), 0) AS BIGINT) AS loose FROM lineitem""")(
    lambda spark, sf: _row_sum_complete(table(spark, sf, "lineitem")))


def _row_sum_complete(l: DataFrame) -> DataFrame:
    whole = [F.col(c).cast("long") for c in ("l_partkey", "l_suppkey", "l_linenumber")]
    some = [*whole[:2], F.nullif(whole[2], F.lit(3))]
    return l.select("l_orderkey", "l_linenumber", X.row_sum(whole, na_rm=False).cast("long").alias("whole"),
                    X.row_sum(some, na_rm=False).cast("long").alias("strict"), X.row_sum(some, na_rm=True).cast("long").alias("loose"))


register("blank_casts", """
SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 1 THEN o_custkey END AS INTEGER) AS custkey,
       CASE o_orderkey % 3 WHEN 1 THEN CAST(o_custkey AS DOUBLE) END AS custnum
FROM orders""")(lambda spark, sf: _blank_casts(table(spark, sf, "orders")))


def _blank_casts(o: DataFrame) -> DataFrame:
    """Numbers as text among blanks and words: blank and unreadable texts are null."""
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.lit("")).when(kind == 1, F.col("o_custkey").cast("string")).otherwise(F.lit("x12"))
    t = N.blank_to_null(o.select("o_orderkey", text.alias("t")))
    return t.select("o_orderkey", X.to_int("t").alias("custkey"), X.to_double("t").alias("custnum"))


# ================================================================ projections

register("rename_project", "SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice FROM orders")(
    lambda spark, sf: P.rename(table(spark, sf, "orders"), {"o_orderkey": "id", "o_custkey": "customer"})
    .select("id", "customer", "o_totalprice"))

register("select_range", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem""")(
    lambda spark, sf: P.select_range(table(spark, sf, "lineitem"), "l_orderkey", ("l_partkey", "l_quantity")))

register("drop_columns", """
SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem""")(
    lambda spark, sf: P.drop_columns(table(spark, sf, "lineitem"), ("l_discount", "l_linestatus"), "l_partkey"))

register("relocate", """
SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders""")(
    lambda spark, sf: P.relocate(table(spark, sf, "orders"), ["o_totalprice"], after="o_orderkey"))

register("transform_where", """
SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, round_even(o_totalprice, 0) AS o_totalprice,
       lower(o_orderpriority) AS o_orderpriority FROM orders""")(
    lambda spark, sf: _transform(table(spark, sf, "orders")))


def _transform(o: DataFrame) -> DataFrame:
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o = P.transform_where(o, F.lower, P.is_string)
    return P.transform_where(o, lambda c: F.bround(c, 0), lambda f: f.dataType.typeName() == "double")


register("union_by_name", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
       CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL BY NAME
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, s_nationkey AS nation FROM supplier""")(
    lambda spark, sf: _union(spark, sf))


def _union(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                            F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                            F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return stack_by_name([c, s])


# ================================================================ joins

register("left_join_common", """
WITH a AS (SELECT o_custkey, nullif(o_orderstatus, 'P') AS status, CAST(count(*) AS BIGINT) AS n_orders
           FROM orders GROUP BY 1, 2),
     b AS (SELECT o_custkey, nullif(o_orderstatus, 'P') AS status, round_even(sum(o_totalprice), 2) AS total
           FROM orders WHERE o_orderpriority != '5-LOW' GROUP BY 1, 2)
SELECT a.o_custkey, a.status, a.n_orders, b.total FROM a LEFT JOIN b
  ON a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.status IS NOT DISTINCT FROM b.status""")(
    lambda spark, sf: _ljc(table(spark, sf, "orders")))


def _ljc(o: DataFrame) -> DataFrame:
    o = o.withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    a = o.groupBy("o_custkey", "status").agg(F.count(F.lit(1)).alias("n_orders"))
    b = o.where(F.col("o_orderpriority") != "5-LOW").groupBy("o_custkey", "status") \
         .agg(F.bround(F.sum("o_totalprice"), 2).alias("total"))
    return J.left_join_common(a, b)


# ================================================================ counts, pivots, first rows

_trial_query("count_by", lambda t: S.count_by(t, ["id", "blockNr"]), with_trials() + """
SELECT id, blockNr, CAST(count(*) AS BIGINT) AS n FROM trials GROUP BY id, blockNr""")

EXPECTED_TRIALS = 63 * 4  # Q4: trials per participant in the design (63 trials x 4 blocks)
_trial_query("expected_trials", lambda t: S.count_by(t, ["id"]).withColumn(
    "complete", F.col("n") == F.lit(EXPECTED_TRIALS)), with_trials() + f"""
SELECT id, CAST(count(*) AS BIGINT) AS n, count(*) = {EXPECTED_TRIALS} AS complete FROM trials GROUP BY id""")

_trial_query("count_by_expr", lambda t: S.count_by_expr(t, ["id", "blockNr"], F.col("switch").isNotNull(),
                                                        "switch_data"), with_trials() + """
SELECT id, blockNr, switch IS NOT NULL AS switch_data, CAST(count(*) AS BIGINT) AS n
FROM trials GROUP BY id, blockNr, switch IS NOT NULL HAVING switch IS NOT NULL""")

_trial_query("pivot_wider", lambda t: R.pivot_wider(S.count_by(t, ["id", "block"]), ["id"], "block", "n",
                                                    ["mixed", "freeOnly"]), with_trials() + """
SELECT id, CAST(sum(n) FILTER (WHERE block = 'mixed') AS BIGINT) AS mixed,
       CAST(sum(n) FILTER (WHERE block = 'freeOnly') AS BIGINT) AS freeOnly
FROM (SELECT id, block, count(*) AS n FROM trials GROUP BY id, block) GROUP BY id""")

register("pivot_longer", """
SELECT l_orderkey, l_linenumber, name, value FROM (
  SELECT l_orderkey, l_linenumber, 'quantity' AS name, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'extendedprice', l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem)""")(
    lambda spark, sf: R.pivot_longer(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                                     ["l_quantity", "l_extendedprice", "l_discount"], "name", "value",
                                     names_prefix="l_"))

_trial_query("first_per_id", M.participant_attributes, with_trials() + """
SELECT id, arg_min(cBal, (blockNr, trialNr)) AS cBal FROM trials GROUP BY id""")

register("frame_rates", """
SELECT l_quantity AS frameRate, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS participant
FROM lineitem GROUP BY l_quantity""")(
    lambda spark, sf: first_per(table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("frameRate"), F.col("l_orderkey").alias("participant"), "l_linenumber"),
        ["frameRate"], ["participant", "l_linenumber"]).select("frameRate", "participant").orderBy("frameRate"))

# ================================================================ filters

_trial_query("filter_free", lambda t: t.where(M.free()).select("id", "block", "blockNr", "trialNr"),
             with_trials() + "SELECT id, block, blockNr, trialNr FROM trials WHERE trial_type = 'free'")
_trial_query("filter_not_in", lambda t: S.count_by(t.where(X.not_in("id", [5, 9, 100, 106])), ["id"]),
             with_trials() + """
SELECT id, CAST(count(*) AS BIGINT) AS n FROM trials WHERE id NOT IN (5, 9, 100, 106) GROUP BY id""")

# ================================================================ frequency tables, summaries

_trial_query("freq_one_way", lambda t: S.freq_table(t, ["task_perf"]), with_trials() + """
SELECT task_perf, CAST(count(*) AS BIGINT) AS n,
       round_even(100 * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS prop
FROM trials WHERE task_perf IS NOT NULL GROUP BY task_perf""")
_trial_query("freq_nested", lambda t: S.freq_table(t, ["block", "task_perf"]), with_trials() + """
SELECT block, task_perf, CAST(count(*) AS BIGINT) AS n,
       round_even(100 * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY block) AS DOUBLE), 1)
         AS prop
FROM trials WHERE task_perf IS NOT NULL AND block IS NOT NULL GROUP BY block, task_perf""")

register("summary_full", """WITH l AS (
  SELECT l_returnflag, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem)
""" + summary_sql("l", ["l_returnflag"], "full"))(
    lambda spark, sf: S.summary_stats(table(spark, sf, "lineitem"), ["l_returnflag"],
                                      ["l_quantity", "l_discount"], kind="full"))
_trial_query("summary_common", lambda t: S.summary_stats(t, ["block"], ["rt"]), with_trials(
    "l AS (SELECT block, 'rt' AS variable, rt AS value FROM trials)") + summary_sql("l", ["block"]))
_NUM = ["id", "countBal", "blockNr", "trialNr", "rt", "corr", "switch"]
_trial_query("summary_multi", lambda t: S.summary_stats(t, ["block"]), with_trials(
    "l AS (" + _long("trials", ["block"], [f"CAST({c} AS DOUBLE)" for c in _NUM], names=_NUM) + ")")
    + summary_sql("l", ["block"]))

register("category_codes", """
SELECT c_custkey, c_name, CAST(dense_rank() OVER (ORDER BY c_name) AS INTEGER) AS c_name_order FROM customer""")(
    lambda spark, sf: R.with_order(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name"))

_trial_query("ordered_switch_type", lambda t: R.with_order(
    S.count_by(t.where(F.col("switch_type").isNotNull()), ["switch_type"]), "switch_type", M.SWITCH_TYPE_ORDER)
    .withColumn("label", R.relabel(F.regexp_extract("switch_type", "_(loc|shape)$", 1), M.TASK_LABELS)),
    with_trials() + f"""
SELECT switch_type, CAST(count(*) AS BIGINT) AS n, {ORDER_CASE},
       CASE regexp_extract(switch_type, '_(loc|shape)$', 1) WHEN 'loc' THEN 'Easy' WHEN 'shape' THEN 'Difficult'
       END AS label
FROM trials WHERE switch_type IS NOT NULL GROUP BY switch_type""")

# ================================================================ histogram, density

_trial_query("rt_histogram", lambda t: S.histogram(t, "rt", binwidth=0.1), with_trials() + """
SELECT bin, bin * CAST(0.1 AS DOUBLE) AS x, CAST(count(*) AS BIGINT) AS count,
       count(*) / (sum(count(*)) OVER () * CAST(0.1 AS DOUBLE)) AS density
FROM (SELECT CAST(floor(rt / CAST(0.1 AS DOUBLE) + 0.5) AS BIGINT) AS bin FROM trials WHERE rt IS NOT NULL)
GROUP BY bin""")


_trial_query("rt_histogram_30", lambda t: S.histogram(t, "rt", bins=30), with_trials("""
w AS (SELECT (max(rt) - min(rt)) / 29 AS w FROM trials WHERE rt IS NOT NULL)""") + """
SELECT bin, bin * w AS x, CAST(count(*) AS BIGINT) AS count, count(*) / (sum(count(*)) OVER () * w) AS density
FROM (SELECT CAST(floor(rt / w + 0.5) AS BIGINT) AS bin, w FROM trials, w WHERE rt IS NOT NULL) GROUP BY bin, w""")

# ================================================================ outliers (M1-M3)

_trial_query("rt_outliers", lambda t: O.identify_outliers(materialize(t, "trials"), ["id", "block", "switch_type"], "rt")
             .where(F.col("is_extreme")), with_trials("""
q AS (SELECT id, block, switch_type, quantile_cont(rt, 0.25) AS q1, quantile_cont(rt, 0.75) AS q3
      FROM trials WHERE rt IS NOT NULL GROUP BY id, block, switch_type)""") + f"""
SELECT {TRIAL_COLS.replace('id, ', 't.id, ', 1).replace('block, ', 't.block, ', 1).replace(', switch_type', ', t.switch_type')},
       (rt < q1 - 1.5 * (q3 - q1) OR rt > q3 + 1.5 * (q3 - q1)) AS is_outlier,
       (rt < q1 - 3.0 * (q3 - q1) OR rt > q3 + 3.0 * (q3 - q1)) AS is_extreme
FROM trials t JOIN q ON t.id IS NOT DISTINCT FROM q.id AND t.block IS NOT DISTINCT FROM q.block
  AND t.switch_type IS NOT DISTINCT FROM q.switch_type
WHERE rt < q1 - 3.0 * (q3 - q1) OR rt > q3 + 3.0 * (q3 - q1)""")


def accuracy_outliers(t: DataFrame, legacy: bool = False) -> DataFrame:
    """M1 + J7: per (id, block, switch type) accuracy, outliers within (id, block).

    ``legacy=True`` reproduces the reference's join of sums at (id, block, switch_type)
    grain with counts at (id, block, task_perf) grain, which multiplies rows.
    """
    base = t.where(X.not_in("task_perf", ["unknownTask"]))
    if legacy:
        sums = base.groupBy("id", "block", "switch_type").agg(
            F.coalesce(F.sum(F.col("corr").cast("long")), F.lit(0).cast("long")).alias("sumCorr"))
        counts = S.count_by(base, ["id", "block", "task_perf"])
        acc = J.left_join_common(sums, counts).withColumn("acc", X.safe_divide("sumCorr", "n"))
    else:
        acc = M.accuracy_table(base, ["id", "block", "switch_type"])
    return O.identify_outliers(acc, ["id", "block"], "acc")


_trial_query("accuracy_outliers", accuracy_outliers, with_trials(
    """acc AS (
  SELECT id, block, switch_type, CAST(coalesce(sum(corr), 0) AS BIGINT) AS sumCorr, CAST(count(*) AS BIGINT) AS n,
         CAST(coalesce(sum(corr), 0) AS DOUBLE) / count(*) AS acc
  FROM trials WHERE task_perf != 'unknownTask' GROUP BY id, block, switch_type)""",
    """q AS (SELECT id, block, quantile_cont(acc, 0.25) AS q1, quantile_cont(acc, 0.75) AS q3
      FROM acc WHERE acc IS NOT NULL GROUP BY id, block)""") + """
SELECT a.id, a.block, a.switch_type, a.sumCorr, a.n, a.acc,
       (acc < q1 - 1.5 * (q3 - q1) OR acc > q3 + 1.5 * (q3 - q1)) AS is_outlier,
       (acc < q1 - 3.0 * (q3 - q1) OR acc > q3 + 3.0 * (q3 - q1)) AS is_extreme
FROM acc a JOIN q ON a.id IS NOT DISTINCT FROM q.id AND a.block IS NOT DISTINCT FROM q.block
WHERE acc < q1 - 1.5 * (q3 - q1) OR acc > q3 + 1.5 * (q3 - q1)""")


_trial_query("accuracy_outliers_legacy", lambda t: accuracy_outliers(t, legacy=True), with_trials("""
su AS (SELECT id, block, switch_type, CAST(coalesce(sum(corr), 0) AS BIGINT) AS sumCorr
       FROM trials WHERE task_perf != 'unknownTask' GROUP BY id, block, switch_type)""", """
cn AS (SELECT id, block, task_perf, CAST(count(*) AS BIGINT) AS n
       FROM trials WHERE task_perf != 'unknownTask' GROUP BY id, block, task_perf)""", """
acc AS (SELECT su.id, su.block, su.switch_type, su.sumCorr, cn.task_perf, cn.n,
               CAST(su.sumCorr AS DOUBLE) / nullif(cn.n, 0) AS acc
        FROM su LEFT JOIN cn ON su.id IS NOT DISTINCT FROM cn.id AND su.block IS NOT DISTINCT FROM cn.block)""",
    """q AS (SELECT id, block, quantile_cont(acc, 0.25) AS q1, quantile_cont(acc, 0.75) AS q3
      FROM acc WHERE acc IS NOT NULL GROUP BY id, block)""") + """
SELECT a.id, a.block, a.switch_type, a.sumCorr, a.task_perf, a.n, a.acc,
       (acc < q1 - 1.5 * (q3 - q1) OR acc > q3 + 1.5 * (q3 - q1)) AS is_outlier,
       (acc < q1 - 3.0 * (q3 - q1) OR acc > q3 + 3.0 * (q3 - q1)) AS is_extreme
FROM acc a JOIN q ON a.id IS NOT DISTINCT FROM q.id AND a.block IS NOT DISTINCT FROM q.block
WHERE acc < q1 - 1.5 * (q3 - q1) OR acc > q3 + 1.5 * (q3 - q1)""")


def _inverse_ctes(k: int) -> tuple[list[str], str]:
    """Gauss-Jordan elimination of the statistics ``s`` as a chain of CTEs, and the name of the last; entries are a{i}_{j}."""
    first = [f"cv{max(i, j)}_{min(i, j)} AS a{i}_{j}" if j < k else f"CAST({int(i == j - k)} AS DOUBLE) AS a{i}_{j}" for i in range(k) for j in range(2 * k)]
    ctes = ["e0 AS (SELECT s.*, " + ", ".join(first) + " FROM s)"]
    for p in range(k):
        entry = [f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(k) for j in range(2 * k)]
        names = ", ".join(f"a{i}_{j}" for i in range(k) for j in range(2 * k))
        ctes.append(f"e{p + 1} AS (SELECT * EXCLUDE ({names}), {', '.join(entry)} FROM e{p})")
    return ctes, f"e{k}"


def _mahal_sql(source: str, cols: list[str], keys: list[str], shown: list[str]) -> tuple[list[str], str]:
    """(CTEs, SELECT) of the distances over ``source`` by an explicit inverse."""
    k, g = len(cols), "".join(f"{x}, " for x in keys)
    aggs = [f"avg(CAST({c} AS DOUBLE)) AS mu{i}" for i, c in enumerate(cols)]
    aggs += [f"covar_samp(CAST({cols[i]} AS DOUBLE), CAST({cols[j]} AS DOUBLE)) AS cv{i}_{j}" for i in range(k) for j in range(i + 1)]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    steps, last = _inverse_ctes(k)
    terms = [f"(CAST(t.{cols[i]} AS DOUBLE) - mu{i}) * a{i}_{k + j} * (CAST(t.{cols[j]} AS DOUBLE) - mu{j})" for i in range(k) for j in range(k)]
    join = " AND ".join(f"t.{x} IS NOT DISTINCT FROM {last}.{x}" for x in keys) or "TRUE"
    ctes = [f"s AS (SELECT {g}{', '.join(aggs)} FROM {source} WHERE {whole} GROUP BY ALL)", *steps,
            f"dist AS (SELECT {', '.join('t.' + c for c in shown)}, round_even({' + '.join(terms)}, 3) AS mahal_dist FROM {source} t JOIN {last} ON {join} WHERE {whole})"]
    # 0.999 quantiles of the chi-square distribution with 3 and 7 degrees of freedom
    return ctes, f"SELECT *, mahal_dist > {({3: 16.26623619623813, 7: 24.321886347856854})[k]} AS is_outlier FROM dist"


_MAHAL_SHOWN = ["id", "blockNr", "trialNr", "block", "rt", "corr"]


def _mahal_trials_sql(keys: list[str]) -> str:
    ctes, query = _mahal_sql("trials", ["rt", "corr", "trialNr"], keys, _MAHAL_SHOWN)
    return with_trials(*ctes) + query


def _mahal(t: DataFrame, keys) -> DataFrame:
    t = materialize(t, "trials")  # read for the statistics and for the distances
    return O.mahalanobis(t, ["rt", "corr", "trialNr"], keys).select(*_MAHAL_SHOWN, "mahal_dist", "is_outlier")


_WIDE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]
_WIDE_CTES, _WIDE_QUERY = _mahal_sql("lineitem", _WIDE_COLS, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_returnflag"])
register("mahalanobis_seven_columns", "WITH " + ",\n".join(_WIDE_CTES) + "\n" + _WIDE_QUERY)(
    lambda spark, sf: O.mahalanobis(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", *_WIDE_COLS), _WIDE_COLS, ["l_returnflag"])
    .select("l_orderkey", "l_linenumber", "l_returnflag", "mahal_dist", "is_outlier"))
_trial_query("mahalanobis_rt_corr", lambda t: _mahal(t, ["block"]), _mahal_trials_sql(["block"]))
_trial_query("mahalanobis_all", lambda t: _mahal(t, []), _mahal_trials_sql([]))


def _partial_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Grouped pandas function: partial count / rt sum / corr sum of one (sub-)group."""
    return pd.DataFrame({"id": [pdf["id"].iloc[0]], "blockNr": [pdf["blockNr"].iloc[0]],
                         "n": [len(pdf)], "rt_sum": [float(pdf["rt"].sum())],
                         "corr_sum": [int(pdf["corr"].fillna(0).sum())]})


_trial_query("apply_per_group", lambda t: O.apply_per_group(
    t.select("id", "blockNr", "trialNr", "rt", "corr"), ["id", "blockNr"], _partial_sums,
    "id long, blockNr int, n long, rt_sum double, corr_sum long",
    split=F.floor(F.col("trialNr") / 4096),
    combine={"n": F.sum("n"), "rt_sum": F.bround(F.sum("rt_sum"), 6), "corr_sum": F.sum("corr_sum")}),
    with_trials() + """
SELECT id, blockNr, CAST(count(*) AS BIGINT) AS n, round_even(sum(rt), 6) AS rt_sum,
       CAST(coalesce(sum(corr), 0) AS BIGINT) AS corr_sum FROM trials GROUP BY id, blockNr""")


# ================================================================ durations (E21, E22), density

def _breaks(e: DataFrame) -> DataFrame:
    """Events as break logs: ``value`` of 'view' events in one of four ``timeBreak*`` columns
    (by user id mod 4), written in mixed case as the logs are."""
    names = ["timeBreak1", "TimeBreak2", "timebreak3", "TIMEBREAK4"]
    k = X.rmod("user_id", 4)
    shown = e.where(F.col("event_type") == "view")  # other rows have no break, and are dropped as empty anyway
    return shown.select(*[F.when(k == i, F.col("value").cast("string")).alias(n) for i, n in enumerate(names)])


def break_durations(e: DataFrame) -> DataFrame:
    """Collapse the ``timebreak*`` columns (any case), drop all-empty rows, summarise."""
    b = _breaks(e)
    cols = P.matching(b, "timebreak")
    b1 = N.filter_any_not_null(b.select(*cols))
    b1 = b1.select(X.to_double(X.unite(cols)).alias("timeBreak"))
    return S.summary_stats(b1)


register("break_durations", """WITH l AS (SELECT 'timeBreak' AS variable, value FROM events WHERE event_type = 'view')
""" + summary_sql("l", []))(lambda spark, sf: break_durations(_events(spark, sf)))


def experiment_duration(e: DataFrame) -> DataFrame:
    """Overall experiment time in minutes from the clock column (seconds)."""
    clock = e.where(F.col("event_type") == "signup").select((F.col("value") * 60).alias("globalClockTime"))
    b2 = clock.where(F.col("globalClockTime").isNotNull()) \
              .withColumn("globalClockTime", F.col("globalClockTime") / 60)
    return S.summary_stats(b2)


register("experiment_duration", """WITH l AS (
  SELECT 'globalClockTime' AS variable, (value * 60) / 60 AS value FROM events WHERE event_type = 'signup')
""" + summary_sql("l", []))(lambda spark, sf: experiment_duration(_events(spark, sf)))

# ================================================================ further grains of E1, E18, E19, A13; J2

_trial_query("vsr_block_number", lambda t: M.vsr(t, ("id", "blockNr"), free_only=False), with_trials() + """
SELECT id, blockNr, sum(switch) AS switch_sum, CAST(count(*) AS BIGINT) AS n, round_even(sum(switch) / count(*), 3) AS vsr
FROM trials WHERE switch IS NOT NULL GROUP BY id, blockNr""")
_ACC_TYPE = """acc AS (SELECT id, switch_type, CAST(coalesce(sum(corr), 0) AS BIGINT) AS sumCorr, CAST(count(*) AS BIGINT) AS n,
  CAST(coalesce(sum(corr), 0) AS DOUBLE) / count(*) AS acc FROM trials WHERE switch_type IS NOT NULL GROUP BY id, switch_type)"""
_trial_query("accuracy_id_switch_type", lambda t: M.accuracy_id(t, ("id", "switch_type")), with_trials(_ACC_TYPE) + "SELECT * FROM acc")
_trial_query("accuracy_switch_type", M.accuracy_switch_type, with_trials(
    _ACC_TYPE, "l AS (SELECT switch_type, 'acc' AS variable, acc AS value FROM acc)",
    "s AS (" + summary_sql("l", ["switch_type"]) + ")") + f"""
SELECT *, round_even(mean - 2 * se, 3) AS lower, round_even(mean + 2 * se, 3) AS upper, {ORDER_CASE} FROM s""")
_trial_query("rt_by_switch_type_only", lambda t: M.rt_by_switch_type(t, ("switch_type",)), with_trials(
    "l AS (SELECT switch_type, 'rt' AS variable, rt AS value FROM trials WHERE switch_type IS NOT NULL)",
    "s AS (" + summary_sql("l", ["switch_type"]) + ")") + f"""
SELECT *, round_even(mean - 2 * se, 3) AS lower, round_even(mean + 2 * se, 3) AS upper, {ORDER_CASE} FROM s""")
_trial_query("vsr_with_counterbalance", lambda t: J.left_join(M.vsr(t), M.counterbalance_of(t), "id"), with_trials(
    CBAL, S1) + "SELECT s1.*, cb.cBal FROM s1 LEFT JOIN cb ON s1.id IS NOT DISTINCT FROM cb.id")

_LOOPS = {(k, cb): loop_name("Blocks", k, cb, "thisRepN") for cb in COUNTERBALANCES for k in ("mix", "free")}
register("loop_counters", "WITH " + _LAST + "SELECT event_id, " + ", ".join(
    f"CAST(CASE WHEN is_last AND countBal = {cb} AND block = '{'mixed' if k == 'mix' else 'freeOnly'}' THEN blockNr - 1 END AS INTEGER) AS {name}"
    for (k, cb), name in _LOOPS.items()) + " FROM lastr")(
    lambda spark, sf: _wide(spark, sf).select("event_id", *[X.to_int(c).alias(c) for c in _LOOPS.values()]))

_trial_query("rt_density", lambda t: S.density(t, "rt"), with_trials("""
st AS (SELECT count(rt) AS n, min(rt) AS lo, max(rt) AS hi, stddev_samp(rt) AS sd,
              quantile_cont(rt, 0.25) AS q1, quantile_cont(rt, 0.75) AS q3 FROM trials WHERE rt IS NOT NULL)""",
    """bw AS (SELECT *, 0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                          ELSE sd END) * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st)""",
    """grid AS (SELECT i, (lo - 3.0 * bw) + i * (((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 511) AS x
                FROM range(512) r(i), bw)""") + """
SELECT CAST(i AS INTEGER) AS point, x,
       round_even(sum(exp(-0.5 * pow((x - rt) / bw, 2))) / (n * bw * 2.5066282746310002), 6) AS density
FROM grid, trials, bw WHERE rt IS NOT NULL GROUP BY i, x, n, bw""")


# ================================================================ duration and frame-rate histograms

def _hist_sql(source: str, width: str) -> str:
    return f"""
SELECT bin, bin * {width} AS x, CAST(count(*) AS BIGINT) AS count,
       count(*) / (sum(count(*)) OVER () * {width}) AS density
FROM (SELECT CAST(floor(v / {width} + 0.5) AS BIGINT) AS bin FROM {source} WHERE v IS NOT NULL)
GROUP BY bin"""


def _break_values(e: DataFrame) -> DataFrame:
    b = _breaks(e)
    cols = P.matching(b, "timebreak")
    return N.filter_any_not_null(b.select(*cols)).select(X.to_double(X.unite(cols)).alias("timeBreak"))


register("break_histogram", "WITH b AS (SELECT value AS v FROM events WHERE event_type = 'view')"
         + _hist_sql("b", "CAST(2 AS DOUBLE)"))(
    lambda spark, sf: S.histogram(_break_values(_events(spark, sf)), "timeBreak", binwidth=2))

register("experiment_histogram", "WITH b AS (SELECT (value * 60) / 60 AS v FROM events WHERE event_type = 'signup')"
         + _hist_sql("b", "CAST(0.1 AS DOUBLE)"))(
    lambda spark, sf: S.histogram(
        _events(spark, sf).where(F.col("event_type") == "signup")
        .select(((F.col("value") * 60) / 60).alias("globalClockTime")), "globalClockTime", binwidth=0.1))

register("frame_rate_histogram", """WITH b AS (SELECT DISTINCT l_quantity AS v FROM lineitem),
w AS (SELECT (max(v) - min(v)) / 29 AS w FROM b)
SELECT bin, bin * w AS x, CAST(count(*) AS BIGINT) AS count, count(*) / (sum(count(*)) OVER () * w) AS density
FROM (SELECT CAST(floor(v / w + 0.5) AS BIGINT) AS bin, w FROM b, w WHERE v IS NOT NULL) GROUP BY bin, w""")(
    lambda spark, sf: S.histogram(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("frameRate"))
                                  .distinct(), "frameRate", bins=30))


# ================================================================ descriptive counts

_trial_query("trials_per_block", lambda t: S.count_by(t, ["block"]), with_trials() + """
SELECT block, CAST(count(*) AS BIGINT) AS n FROM trials GROUP BY block""")

_trial_query("participants_per_counterbalance", lambda t: S.freq_table(
    first_per(t.select("id", "blockNr", "trialNr", "countBal"), ["id"], ["blockNr", "trialNr"]), ["countBal"]),
    with_trials("f AS (SELECT id, arg_min(countBal, (blockNr, trialNr)) AS countBal FROM trials GROUP BY id)") + """
SELECT countBal, CAST(count(*) AS BIGINT) AS n,
       round_even(100 * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS prop
FROM f WHERE countBal IS NOT NULL GROUP BY countBal""")


def _freq_sql(col: str) -> str:
    return with_trials() + f"""
SELECT {col}, CAST(count(*) AS BIGINT) AS n,
       round_even(100 * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS prop
FROM trials WHERE {col} IS NOT NULL GROUP BY {col}"""


for _c in ("resp", "corr", "task_cued"):
    _trial_query(f"freq_{_c}", (lambda c: lambda t: S.freq_table(t, [c]))(_c), _freq_sql(_c))


# ================================================================ plot captions of the duration plots

def caption(stats: DataFrame, unit: str, digits: int = 1) -> DataFrame:
    """'Med = <median> <unit>\\n Mean = <mean> <unit>' with both rounded (after the summary's own rounding)."""
    med, mean = F.bround("median", digits), F.bround("mean", digits)
    return stats.select(med.alias("median"), mean.alias("mean"),
                        X.paste("Med = ", med, f"{unit}\n", "Mean = ", mean, unit).alias("caption"))


def _caption_sql(source_cte: str, unit: str) -> str:
    return source_cte + ",\ns AS (" + summary_sql("l", []) + ")" + f"""
SELECT round_even(median, 1) AS median, round_even(mean, 1) AS mean,
       concat_ws(' ', 'Med = ', CAST(round_even(median, 1) AS VARCHAR), '{unit}' || chr(10), 'Mean = ',
                 CAST(round_even(mean, 1) AS VARCHAR), '{unit}') AS caption FROM s"""


register("break_caption", _caption_sql(
    "WITH l AS (SELECT 'timeBreak' AS variable, value FROM events WHERE event_type = 'view')", "(s)"))(
    lambda spark, sf: caption(break_durations(_events(spark, sf)), "(s)"))
register("experiment_caption", _caption_sql(
    "WITH l AS (SELECT 'globalClockTime' AS variable, (value * 60) / 60 AS value FROM events "
    "WHERE event_type = 'signup')", "(min)"))(
    lambda spark, sf: caption(experiment_duration(_events(spark, sf)), "(min)"))
