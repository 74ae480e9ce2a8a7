"""Registered run-gate and throughput queries (G02-G06, T03-T06) over runs
derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.catalog.attribution_q import r6
from trainlens.catalog.data_q import _TOK_SQL
from trainlens.operators import gates as G
from trainlens.registry import register
from trainlens.sources.runs import STEPS_PER_EPOCH, loss_log, run_metrics
from trainlens.sources.tables import read_table

_RUNS_SQL = f"""WITH g AS (
  SELECT user_id AS run_id, count(*) AS steps,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS train_runtime,
         arg_max(value, (ts, event_id)) AS train_loss, sum(value) AS tokens
  FROM events GROUP BY user_id),
runs AS (SELECT *, steps / {float(STEPS_PER_EPOCH)} AS epochs_completed,
           CASE WHEN train_runtime > 0 THEN steps / train_runtime END AS train_steps_per_second,
           CASE WHEN train_runtime > 0 THEN tokens / train_runtime END AS train_tokens_per_second
         FROM g),
fl AS (SELECT user_id AS run_id, arg_min(value, (ts, event_id)) AS first_loss,
              arg_max(value, (ts, event_id)) AS last_loss
       FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY user_id),
chk AS (SELECT runs.run_id,
          coalesce(steps, 0) >= 100 AS min_steps,
          coalesce(epochs_completed, 0.0) >= 1.0 AS min_epochs,
          coalesce(train_loss IS NOT NULL AND NOT isnan(train_loss) AND NOT isinf(train_loss)
                   AND train_loss <= 3.0, false) AS final_loss,
          coalesce(last_loss <= first_loss, true) AS loss_trend,
          (train_steps_per_second IS NOT NULL AND train_tokens_per_second IS NOT NULL
           AND train_runtime IS NOT NULL AND train_loss IS NOT NULL) AS runtime_metrics
        FROM runs LEFT JOIN fl ON fl.run_id = runs.run_id)"""


def _checks(spark, sf_dir) -> DataFrame:
    losses = G.loss_endpoints(loss_log(spark, sf_dir), ["ts", "event_id"])
    return G.gate_checks(run_metrics(spark, sf_dir), losses)


@register("run_gate_report", _RUNS_SQL + """
SELECT run_id, 'min_steps' AS "check", min_steps AS passed FROM chk
UNION ALL SELECT run_id, 'min_epochs', min_epochs FROM chk
UNION ALL SELECT run_id, 'final_loss', final_loss FROM chk
UNION ALL SELECT run_id, 'loss_trend', loss_trend FROM chk
UNION ALL SELECT run_id, 'runtime_metrics', runtime_metrics FROM chk
UNION ALL SELECT run_id, 'overall', min_steps AND min_epochs AND final_loss AND loss_trend AND runtime_metrics
FROM chk""")
def run_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress, loss and runtime-metric checks for every run, plus overall."""
    return G.gate_report(_checks(spark, sf_dir))


@register("run_metric_audit", _RUNS_SQL.replace("SELECT user_id AS run_id, count(*) AS steps", "SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS steps")
          .replace("FROM events GROUP BY user_id),\nruns", "FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')),\nruns").split(",\nfl AS")[0] + """,
m AS (SELECT run_id, unnest(list_filter([
        CASE WHEN train_steps_per_second IS NULL THEN 'train_steps_per_second' END,
        CASE WHEN train_tokens_per_second IS NULL THEN 'train_tokens_per_second' END,
        CASE WHEN train_steps_per_second IS NULL THEN 'throughput.steps_per_second' END,
        CASE WHEN train_tokens_per_second IS NULL THEN 'throughput.tokens_per_second' END],
        lambda x: x IS NOT NULL)) AS missing_key FROM runs)
SELECT run_id, missing_key FROM m""")
def run_metric_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G04 (G01 on a runs table): missing runtime-metric and throughput keys per
    run, a run being a user's day (one event has no duration, so no rates)."""
    return G.struct_key_audit(run_metrics(spark, sf_dir, per_day=True), G.REQUIRED_RUNTIME_METRIC_KEYS,
                              "throughput", G.REQUIRED_THROUGHPUT_KEYS)


KEYS_ABOVE = 49.0


def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, params): a run's parameter keys, here the types of its events
    that logged more than ``KEYS_ABOVE``."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("run_id"))
              .agg(F.collect_set(F.when(F.col("value") > KEYS_ABOVE, F.col("event_type"))).alias("params")))


@register("run_pair_reproducibility", _RUNS_SQL + f""",
ks AS (SELECT user_id AS run_id, list_sort(coalesce(list(DISTINCT event_type) FILTER (WHERE value > {KEYS_ABOVE}), [])) AS params
       FROM events GROUP BY user_id),
p AS (SELECT run_id // 2 AS pair_id, count(*) AS n_runs,
        arg_min(steps, run_id) AS steps_a, arg_max(steps, run_id) AS steps_b,
        arg_min(train_loss, run_id) AS loss_a, arg_max(train_loss, run_id) AS loss_b,
        arg_min(train_steps_per_second, run_id) AS rate_a, arg_max(train_steps_per_second, run_id) AS rate_b,
        arg_min(params, run_id) AS keys_a, arg_max(params, run_id) AS keys_b,
        bool_or(train_loss IS NULL OR train_steps_per_second IS NULL) AS missing
      FROM runs JOIN ks USING (run_id) GROUP BY run_id // 2),
st AS (SELECT *, CASE WHEN n_runs < 2 THEN 'unpaired' WHEN n_runs > 2 THEN 'ambiguous' WHEN keys_a <> keys_b THEN 'parameter_keys'
                      WHEN missing THEN 'metric_missing' ELSE 'paired' END AS status,
         CASE WHEN n_runs = 2 THEN array_to_string(list_sort(list_filter(list_distinct(keys_a || keys_b),
           lambda k: NOT (list_contains(keys_a, k) AND list_contains(keys_b, k)))), ',') END AS keys_differ FROM p)
SELECT pair_id, status, keys_differ,
       steps_a, steps_b, CASE WHEN n_runs = 2 THEN round(abs(loss_a - loss_b), 6) END AS loss_drift,
       CASE WHEN n_runs = 2 THEN round(abs(rate_a - rate_b), 6) END AS rate_drift,
       CASE WHEN n_runs = 2 THEN status = 'paired' AND steps_a = steps_b AND abs(loss_a - loss_b) <= 1e-4
            AND coalesce(abs(rate_a - rate_b) <= 0.5, false) END AS reproducible
FROM st""")
def run_pair_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs paired as (2i, 2i+1): equal parameter keys, required metrics,
    equal steps, loss drift <= 1e-4, rate drift <= 0.5; a run without its partner
    is reported as unpaired."""
    runs = (run_metrics(spark, sf_dir).join(run_keys(spark, sf_dir), "run_id")
            .withColumn("pair_id", F.floor(F.col("run_id") / 2).cast("long")))
    r = G.pair_reproducibility(runs, "pair_id", "run_id", params_col="params")
    return r.select("pair_id", "status", F.array_join("keys_differ", ",").alias("keys_differ"), "steps_a", "steps_b",
                    r6("loss_drift"), r6("rate_drift"), "reproducible")


BATCH, ACCUM = 4, 1


@register("run_throughput", _RUNS_SQL + f""",
views AS (SELECT user_id AS run_id, count(*) AS state_step FROM events WHERE event_type = 'view' GROUP BY user_id),
avg_len AS (SELECT avg(value) AS a FROM events),
t AS (SELECT runs.run_id, train_runtime, train_steps_per_second AS rate, train_tokens_per_second AS reported,
             views.state_step, steps AS metric_step,
             CASE WHEN a > 0 AND train_runtime > 0 AND steps > 0
                  THEN a * {BATCH} * {ACCUM} * steps / train_runtime ELSE 0.0 END AS estimated
      FROM runs LEFT JOIN views ON views.run_id = runs.run_id, avg_len)
SELECT run_id,
       CAST(coalesce(CASE WHEN state_step > 0 THEN state_step END, CASE WHEN metric_step > 0 THEN metric_step END,
                     CASE WHEN train_runtime > 0 AND rate > 0 THEN round_even(train_runtime * rate, 0) END, 0) AS BIGINT)
         AS steps_completed,
       NOT (state_step > 0) AND NOT (metric_step > 0) AS steps_estimated,
       round(estimated, 6) AS tokens_per_second_estimated,
       round(coalesce(CASE WHEN reported > 0 THEN reported END, CASE WHEN estimated > 0 THEN estimated END, 0.0), 6)
         AS tokens_per_second
FROM t""")
def run_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, steps from trainer state > metric > runtime x rate
    (flagged when estimated), the token-rate estimate from the average logged
    value, and the resolved token rate (measured > reported > estimated)."""
    from trainlens.operators import lengths as L
    ev = read_table(spark, sf_dir, "events")
    views = (ev.where(F.col("event_type") == "view").groupBy(F.col("user_id").alias("run_id"))
               .agg(F.count(F.lit(1)).alias("state_step")))
    avg_len = ev.agg(F.avg("value")).first()[0] or 0.0  # one scalar
    r = run_metrics(spark, sf_dir).join(views, "run_id", "left")
    est = L.token_rate_estimate(F.lit(avg_len), F.lit(BATCH), F.lit(ACCUM), F.col("steps"),
                                F.col("train_runtime"))
    steps, flag = L.resolve_steps(F.col("state_step"), F.col("steps"), F.col("train_runtime"),
                                  F.col("train_steps_per_second"))
    r = r.withColumn("_est", est)
    return r.select("run_id", steps.alias("steps_completed"), F.coalesce(flag, F.lit(False)).alias("steps_estimated"),
                    F.round("_est", 6).alias("tokens_per_second_estimated"),
                    F.round(L.resolve_token_rate(F.lit(None).cast("double"), F.col("train_tokens_per_second"),
                                                 F.col("_est")), 6).alias("tokens_per_second"))


@register("run_speedup", _RUNS_SQL + """,
""" + _TOK_SQL.split("WITH ", 1)[1] + """,
pl AS (SELECT len(ids) AS seq_len, row_number() OVER (ORDER BY sample_id) - 1 AS pos FROM tk),
b AS (SELECT floor(pos / 4) AS batch, max(seq_len) AS mx, count(*) AS rows FROM pl GROUP BY 1),
ratio AS (SELECT sum(least(mx, 128) * rows) / (sum(rows) * 128) AS r FROM b)
SELECT run_id, round(CASE WHEN train_steps_per_second > 0 AND r > 0 THEN train_steps_per_second * r ELSE 0.0 END, 6)
         AS baseline_steps_per_second,
       round(CASE WHEN train_steps_per_second > 0 AND r > 0
                  THEN (train_steps_per_second - train_steps_per_second * r) / (train_steps_per_second * r) * 100.0
                  ELSE 0.0 END, 6) AS speedup_pct
FROM runs, ratio""")
def run_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, the max-length-padding baseline rate (observed rate x the
    examples' padding ratio in batches of 4, cap 128) and the speed-up in %."""
    from trainlens.catalog.data_q import MAX_LEN, _tokens
    from trainlens.operators import lengths as L
    from trainlens.plans.ordinal import with_ordinal
    t = L.effective_length(_tokens(spark, sf_dir, "longest")).select("sample_id", "seq_len")
    fp = L.padding_footprint(with_ordinal(t, [F.col("sample_id")], "pos"), 4, MAX_LEN)
    ratio = fp.first()["ratio"] or 0.0  # one scalar
    r = run_metrics(spark, sf_dir)
    base = L.baseline_rate(F.col("train_steps_per_second"), F.lit(ratio))
    return r.select("run_id", F.round(base, 6).alias("baseline_steps_per_second"),
                    F.round(L.speedup_pct(F.col("train_steps_per_second"), base), 6).alias("speedup_pct"))
