"""Registered queries of the engine's own operators over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attestor.functions import scalars as fn
from attestor.operators import calibration, curves, dedupe, features, kernels, metrics, prompt, splits, temporal, verdicts
from attestor.plans import analogs as t
from attestor.plans.analogs import A, C_SQL, E2, F_SQL, H, PARSED, R, S, U, p_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _round(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits).alias(name) if name else F.round(c, digits)


# Dedupe, graph, splits


@query(f"WITH {A} SELECT doc_id, sha256, label, manipulation, scene, n_chars FROM a")
def asset_scan(spark, d):
    """The asset relation."""
    return t.assets(spark, d).select("doc_id", "sha256", "label", "manipulation", "scene", "n_chars")


@query(f"WITH {A} SELECT source, label, count(*) AS n FROM a GROUP BY ALL")
def a1_counts(spark, d):
    return t.assets(spark, d).groupBy("source", "label").agg(F.count("*").alias("n"))


@query(f"WITH {A}, {H} SELECT doc_id, phash FROM h")
def f4_phash(spark, d):
    return t.hashed_assets(spark, d).select("doc_id", "phash")


@query(f"""WITH {A}, {H}, b AS (SELECT unnest([0, 1, 2, 3, 4]) AS band)
SELECT doc_id, band::INTEGER AS band, ((h >> (band * 13)::UBIGINT) & (CASE band WHEN 4 THEN 4095 ELSE 8191 END)::UBIGINT)::BIGINT AS key FROM h, b""")
def f5_band_keys(spark, d):
    return t.hashed_assets(spark, d).select("doc_id", F.inline(fn.band_keys(fn.hex_to_long(F.col("phash")))))


_FATE_SQL = "c AS (SELECT sha256, count(DISTINCT label) AS l, min(doc_id) AS first FROM a GROUP BY sha256), f AS (SELECT a.*, CASE WHEN l > 1 THEN 'label_conflict' WHEN doc_id = first THEN 'kept' ELSE 'exact_copy' END AS fate FROM a JOIN c USING (sha256))"


@query(f"WITH {A}, {_FATE_SQL} SELECT doc_id, sha256, fate FROM f")
def dd1_dd2_exact_dedupe(spark, d):
    return dedupe.exact_dedupe(t.assets(spark, d), "doc_id").select("doc_id", "sha256", "fate")


@query(f"WITH {A}, {H}, {U}, {E2} SELECT a, b FROM e")
def j2_near_edges(spark, d):
    return dedupe.near_edges(t.unique_assets(spark, d))


@query(f"WITH {A}, {H}, {U}, {E2} SELECT a, b FROM e WHERE la = lb AND sa <> sb")
def j1_guarded_near_edges(spark, d):
    return dedupe.near_edges(t.unique_assets(spark, d), dedupe.same_label_other_scene)


_GREEDY = f"""WITH RECURSIVE {A}, {H}, {U}, {E2}, g AS (SELECT a, b FROM e WHERE la = lb AND sa <> sb),
vx AS (SELECT v, row_number() OVER (ORDER BY v) AS n, list(a) AS below FROM (SELECT b AS v, a FROM g UNION SELECT a, NULL FROM g) GROUP BY v),
k(n, kept) AS (
  SELECT 0::BIGINT, []::VARCHAR[]
  UNION ALL SELECT vx.n, CASE WHEN list_has_any(k.kept, list_filter(vx.below, lambda e: e IS NOT NULL)) THEN k.kept ELSE list_append(k.kept, vx.v) END FROM k JOIN vx ON vx.n = k.n + 1
),
z AS (SELECT kept FROM k ORDER BY n DESC LIMIT 1),
o AS (SELECT sha256, NOT (sha256 IN (SELECT v FROM vx)) OR list_contains((SELECT kept FROM z), sha256) AS kept FROM u)"""


@query(f"{_GREEDY} SELECT sha256, kept FROM o")
def dd3_greedy_near_dedupe(spark, d):
    return dedupe.near_dedupe(t.unique_assets(spark, d))


@query(f"""{_GREEDY}, {_FATE_SQL.replace('c AS', 'fc AS').replace('JOIN c', 'JOIN fc')}
SELECT count(*) AS input, count(*) FILTER (fate = 'exact_copy') AS exact_removed, count(*) FILTER (fate = 'kept' AND NOT o.kept) AS near_removed,
  count(*) FILTER (fate = 'label_conflict') AS label_conflicts, count(*) FILTER (fate = 'kept' AND o.kept) AS output
FROM f LEFT JOIN o USING (sha256)""")
def dd4_collapse_report(spark, d):
    """The flagship: quarantine, exact and near dedupe of all assets, as one row of counts."""
    return dedupe.collapse_report(dedupe.collapse(t.hashed_assets(spark, d).checkpoint(), "doc_id"))


_CLUSTERS = f"""WITH RECURSIVE {A}, {H}, {U}, {E2}, g AS (
  SELECT a, b FROM e UNION SELECT m AS a, sha256 AS b FROM u JOIN (SELECT scene, min(sha256) AS m FROM u GROUP BY scene) USING (scene) WHERE m <> sha256
),
y AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
r(v, c) AS (SELECT sha256, sha256 FROM u UNION SELECT y.b, r.c FROM r JOIN y ON r.v = y.a WHERE r.c < y.b),
cl AS (SELECT v AS sha256, min(c) AS cluster FROM r GROUP BY v)"""


@query(f"{_CLUSTERS} SELECT sha256, cluster FROM cl")
def g2_clusters(spark, d):
    return dedupe.cluster_assets(t.unique_assets(spark, d))


_TYPED = f"""{_CLUSTERS}, n AS (SELECT cluster, manipulation, count(*) AS n, min(sha256) AS first FROM u JOIN cl USING (sha256) GROUP BY ALL),
ty AS (SELECT cluster, sum(n) OVER (PARTITION BY cluster) AS size, manipulation AS dominant, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS rn FROM n)"""


@query(f"{_TYPED} SELECT cluster, size::BIGINT AS size, dominant FROM ty WHERE rn = 1")
def g3_dominant_types(spark, d):
    rows = t.unique_assets(spark, d)
    return dedupe.dominant_types(rows, dedupe.cluster_assets(rows))


@query(f"WITH {A} SELECT doc_id, sha256('{splits.SPLIT_SEED}:' || sha256) AS order_key FROM a")
def f8_order_keys(spark, d):
    return t.assets(spark, d).select("doc_id", fn.order_key(splits.SPLIT_SEED, F.col("sha256")).alias("order_key"))


# Greedy assignment over single-asset clusters: the recursion of the SQL below goes row by row.
_ASSIGN = f"""WITH RECURSIVE {A}, s AS (SELECT DISTINCT sha256, manipulation AS kind FROM a WHERE doc_id IN (SELECT min(doc_id) FROM a GROUP BY sha256)),
o AS (SELECT sha256, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256('{splits.SPLIT_SEED}:' || sha256)) AS n, count(*) OVER (PARTITION BY kind) AS total FROM s),
w(kind, n, sha256, split, ftest, ftrain, fval) AS (
  SELECT kind, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT kind FROM o)
  UNION ALL
  SELECT kind, n, sha256, split, ftest + (split = 'test')::BIGINT, ftrain + (split = 'train')::BIGINT, fval + (split = 'val')::BIGINT FROM (
    SELECT o.kind, o.n, o.sha256, w.ftest, w.ftrain, w.fval, CASE
      WHEN 0.15::DOUBLE * total - w.ftest >= 0.7::DOUBLE * total - w.ftrain AND 0.15::DOUBLE * total - w.ftest >= 0.15::DOUBLE * total - w.fval THEN 'test'
      WHEN 0.7::DOUBLE * total - w.ftrain >= 0.15::DOUBLE * total - w.fval THEN 'train' ELSE 'val' END AS split
    FROM w JOIN o ON o.kind = w.kind AND o.n = w.n + 1))"""


def _assigned(spark, d):
    first = dedupe.exact_dedupe(t.assets(spark, d).withColumn("label", F.lit("")), "doc_id").where("fate = 'kept'")
    typed = first.select(F.col("sha256").alias("cluster"), F.lit(1).cast("long").alias("size"), F.col("manipulation").alias("dominant"))
    return typed.join(splits.assign_clusters(typed), "cluster").select(F.col("cluster").alias("sha256"), F.col("dominant").alias("manipulation"), "split")


@query(f"{_ASSIGN} SELECT sha256, kind AS manipulation, split FROM w WHERE n > 0")
def g4_split_assignment(spark, d):
    return _assigned(spark, d)


@query(f"{_ASSIGN} SELECT split, kind AS manipulation, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 4) AS share FROM w WHERE n > 0 GROUP BY split, kind")
def g5_split_shares(spark, d):
    return splits.split_shares(_assigned(spark, d))


@query(f"{_ASSIGN} SELECT split, count(*) AS n, sha256(string_agg(sha256, chr(10) ORDER BY sha256) || chr(10)) AS sha256 FROM w WHERE n > 0 GROUP BY split")
def f9_canonical_hashes(spark, d):
    return splits.canonical_hash_column(_assigned(spark, d), "split")


@query()
def s11_leakage_safe_splits(spark, d):
    """Clusters of scenes and near duplicates, assigned to splits (compared with a plain loop in the tests)."""
    return splits.assign_splits(t.unique_assets(spark, d)).select("sha256", "cluster", "split")


# Metrics

_CELLS = "count(*) AS n, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp"
_VALUES = """CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0 END) / 2 AS macro_f1"""
_SHOWN = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(macro_f1, 6) AS macro_f1"
_AUC = "CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN rn END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END"
_show = lambda *by: [*by, "n", *[_round(m, m) for m in metrics.METRICS]]


@query(f"WITH {p_sql()}, c AS (SELECT {_CELLS} FROM p), m AS (SELECT n, {_VALUES} FROM c) SELECT n, {_SHOWN} FROM m")
def a7_basic_metrics(spark, d):
    return metrics.basic_metrics(t.predictions(spark, d)).select(*_show())


@query(f"WITH {p_sql()}, c AS (SELECT {_CELLS} FROM p) SELECT tn, fp, fn, tp FROM c")
def a9_confusion(spark, d):
    return metrics.confusion(t.predictions(spark, d))


@query(f"WITH {p_sql()}, c AS (SELECT manipulation, {_CELLS} FROM p GROUP BY manipulation), m AS (SELECT manipulation, n, {_VALUES} FROM c) SELECT manipulation, n, {_SHOWN} FROM m")
def a10_metrics_by_type(spark, d):
    return metrics.basic_metrics(t.predictions(spark, d), "manipulation").select(*_show("manipulation"))


_BY_TYPE = f"""WITH {p_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY manipulation ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY manipulation) AS total FROM p),
i AS (SELECT manipulation, r, k AS i, ('0x' || md5('{metrics.BOOTSTRAP_SEED}:' || manipulation || ':' || r || ':' || k)[1:8])::BIGINT % total AS k FROM k, (SELECT unnest(range({metrics.RESAMPLES})) AS r)),
x AS (SELECT manipulation, r, y, pred, row_number() OVER (PARTITION BY manipulation, r ORDER BY score, i) AS rn FROM i JOIN k USING (manipulation, k)),
c AS (SELECT manipulation, r, {_CELLS}, {_AUC} AS auroc FROM x GROUP BY manipulation, r), m AS (SELECT manipulation, {_VALUES}, auroc FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY manipulation ORDER BY score, id) AS rn FROM p), b AS (SELECT manipulation, {_CELLS}, {_AUC} AS auroc FROM o GROUP BY manipulation), q AS (SELECT manipulation, n, {_VALUES}, auroc FROM b)
""" + " UNION ALL ".join(f"SELECT manipulation, any_value(q.n) AS n, '{m}' AS metric, round(any_value(q.{m}), 6) AS value, round(quantile_cont(m.{m}, 0.025), 6) AS ci_low, round(quantile_cont(m.{m}, 0.975), 6) AS ci_high FROM q JOIN m USING (manipulation) GROUP BY manipulation" for m in [*metrics.METRICS, "auroc"])


@query(_BY_TYPE)
def a10_intervals_by_type(spark, d):
    """A10: every metric of every type with its interval; no AUROC where a class is missing."""
    found = metrics.bootstrap_by(t.predictions(spark, d), "manipulation")
    return found.select("manipulation", "n", "metric", *[_round(c, c) for c in ("value", "ci_low", "ci_high")])


@query(f"WITH {p_sql()}, r AS (SELECT *, row_number() OVER (ORDER BY score, id) AS rn FROM p) SELECT round({_AUC}, 6) AS auroc FROM r")
def w1_rank_auroc(spark, d):
    return metrics.rank_auc(t.predictions(spark, d)).select(_round("auroc", "auroc"))


@query(f"WITH {p_sql()}, s AS (SELECT score, count(*) AS n, sum(y) AS ones FROM p GROUP BY score), r AS (SELECT *, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2 AS rk FROM s) SELECT round((sum(ones * rk) - sum(ones) * (sum(ones) + 1) / 2) / (sum(ones) * (sum(n) - sum(ones))), 6) AS auroc FROM r")
def w1_rank_auroc_tied(spark, d):
    return metrics.rank_auc_tied(t.predictions(spark, d)).select(_round("auroc", "auroc"))


@query(f"WITH {p_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, id) AS rn FROM p), g AS (SELECT source, {_AUC} AS auc FROM r GROUP BY source) SELECT source, round(greatest(auc, 1 - auc), 4) AS auc FROM g WHERE auc IS NOT NULL")
def w2_auc_by_source(spark, d):
    return metrics.folded_auc(t.predictions(spark, d), "source")


def _draws(body: str, n: int = metrics.RESAMPLES) -> str:
    return f"""k AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS total FROM {body}),
i AS (SELECT r, k.k AS i, ('0x' || md5('{metrics.BOOTSTRAP_SEED}:' || r || ':' || k.k)[1:8])::BIGINT % total AS k FROM k, (SELECT unnest(range({n})) AS r))"""


@query(f"""WITH {p_sql()}, {_draws('p')}, x AS (SELECT r, i, y, pred, score, row_number() OVER (PARTITION BY r ORDER BY score, i) AS rn FROM i JOIN k USING (k)),
c AS (SELECT r, {_CELLS}, {_AUC} AS auroc FROM x GROUP BY r), m AS (SELECT {_VALUES}, auroc FROM c),
b AS (SELECT {_CELLS} FROM p), q AS (SELECT {_VALUES} FROM b), a AS (SELECT {_AUC} AS auroc FROM (SELECT *, row_number() OVER (ORDER BY score, id) AS rn FROM p))
""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round((SELECT {m} FROM {'a' if m == 'auroc' else 'q'}), 6) AS value, round(quantile_cont({m}, 0.025), 6) AS ci_low, round(quantile_cont({m}, 0.975), 6) AS ci_high FROM m" for m in [*metrics.METRICS, "auroc"]))  # fmt: skip
def a12_bootstrap(spark, d):
    return metrics.bootstrap_metrics(t.predictions(spark, d)).select("metric", *[_round(c, c) for c in ("value", "ci_low", "ci_high")])


@query(f"""WITH {p_sql()}, {p_sql('b', 'o')}, z AS (SELECT p.id, p.y, p.pred AS a, o.pred AS b FROM p JOIN o USING (id)), {_draws('z')},
x AS (SELECT r, y, a, b FROM i JOIN k USING (k)),
ca AS (SELECT r, {_CELLS.replace('pred', 'a')} FROM x GROUP BY r), cb AS (SELECT r, {_CELLS.replace('pred', 'b')} FROM x GROUP BY r),
ma AS (SELECT r, {_VALUES} FROM ca), mb AS (SELECT r, {_VALUES} FROM cb), e AS (SELECT ma.macro_f1 - mb.macro_f1 AS d FROM ma JOIN mb USING (r)),
pa AS (SELECT {_VALUES} FROM (SELECT {_CELLS.replace('pred', 'a')} FROM z)), pb AS (SELECT {_VALUES} FROM (SELECT {_CELLS.replace('pred', 'b')} FROM z)), t AS (SELECT pa.macro_f1 - pb.macro_f1 AS delta FROM pa, pb)
SELECT 'macro_f1' AS metric, round(any_value(delta), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, CASE WHEN any_value(delta) > 0 THEN 'a' ELSE 'b' END AS favors FROM e, t""")
def a13_paired_delta(spark, d):
    out = metrics.paired_delta(t.predictions(spark, d), t.predictions(spark, d, "b"))
    return out.select("metric", *[_round(c, c) for c in ("delta", "ci_low", "ci_high")], "favors")


# Calibration

_BIN = "greatest(0, len(list_filter(range(15), lambda e: e / 15::DOUBLE < greatest(score, 1 - score))) - 1)"


@query(f"""WITH {p_sql()}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(greatest(score, 1 - score)) AS c, avg((y = pred)::INTEGER) AS a FROM p GROUP BY 1)
SELECT e.bin::INTEGER AS bin, coalesce(n, 0) AS count, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM (SELECT unnest(range(15)) AS bin) e LEFT JOIN b USING (bin)""")
def a14_reliability(spark, d):
    some = lambda c: F.when(F.col("count") > 0, F.round(c, 6)).alias(c)
    return calibration.reliability(t.predictions(spark, d)).select("bin", "count", some("confidence"), some("accuracy"))


@query(f"WITH {p_sql()}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(greatest(score, 1 - score)) AS c, avg((y = pred)::INTEGER) AS a FROM p GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def a14_ece(spark, d):
    return calibration.expected_calibration_error(t.predictions(spark, d)).select(_round("ece", "ece"))


_CLIP = "greatest(1e-6, least(1 - 1e-6, score))"
_LOSS = f"avg(-(y * ln(greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-ln({_CLIP} / (1 - {_CLIP})) / t)))) ) + (1 - y) * ln(1 - greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-ln({_CLIP} / (1 - {_CLIP})) / t)))))))"
_COARSE = "(VALUES " + ", ".join(f"({x!r}::DOUBLE)" for x in calibration.coarse_grid()) + ") g(t)"


@query(f"""WITH {p_sql()}, l AS (SELECT t, {_LOSS} AS nll FROM p, {_COARSE} GROUP BY t), b AS (SELECT t AS b FROM l ORDER BY nll, t LIMIT 1),
g AS (SELECT 0.7::DOUBLE * b + k * (0.7::DOUBLE * b) / 60 AS t FROM b, (SELECT unnest(range(61)) AS k)), m AS (SELECT t, {_LOSS} AS nll FROM p, g GROUP BY t)
SELECT round(t, 6) AS temperature FROM m ORDER BY nll, t LIMIT 1""")
def a15_temperature(spark, d):
    best = calibration.fit_temperature(t.predictions(spark, d), "val")
    return spark.range(1).select(F.round(F.lit(best), 6).alias("temperature"))


@query(f"WITH {p_sql()} SELECT id, round(1 / (1 + exp(-ln({_CLIP} / (1 - {_CLIP})) / 2.5)), 6) AS scaled FROM p")
def f13_temperature_scaling(spark, d):
    return t.predictions(spark, d).select("id", F.round(fn.scaled(F.col("score"), F.lit(2.5)), 6).alias("scaled"))


# Verdicts, grounding, prompts


@query(f"WITH {R}, {PARSED} SELECT sha256, CASE WHEN failure IS NULL THEN t->>'$.label' END AS label, CASE WHEN failure IS NULL THEN (t->>'$.confidence')::DOUBLE END AS confidence, failure FROM q")
def p1_strict_parse(spark, d):
    parsed = t.replies(spark, d).select("sha256", verdicts.parse_verdict("reply").alias("p"))
    return parsed.select("sha256", "p.label", "p.confidence", "p.failure")


_GROUND = f"""WITH {R}, {PARSED}, {S}, c AS (SELECT sha256, unnest(from_json(t->'$.evidence', '["JSON"]')) AS e FROM q WHERE failure IS NULL),
n AS (SELECT c.sha256, count(*) AS cited, count(s.sha256) AS good FROM c LEFT JOIN s ON c.sha256 = s.sha256 AND c.e->>'$.signal' = s.signal AND c.e->>'$.region' = s.region GROUP BY c.sha256),
g AS (SELECT q.sha256, t, CASE WHEN good < cited THEN 'ungrounded_evidence' ELSE failure END AS failure, coalesce(good / cited, 0.0)::DOUBLE AS rate FROM q LEFT JOIN n USING (sha256))"""


def _grounded(spark, d):
    parsed = t.replies(spark, d).select("sha256", verdicts.parse_verdict("reply").alias("parsed"))
    return verdicts.ground(parsed, t.signal_store(spark, d))


@query(f"{_GROUND} SELECT sha256, failure IS NULL AS ok, CASE WHEN failure IS NULL THEN t->>'$.label' END AS label, failure, round(rate, 6) AS grounding_rate FROM g")
def p2_grounding(spark, d):
    return _grounded(spark, d).select("sha256", "ok", "label", "failure", _round("grounding_rate", "grounding_rate"))


@query(f"{_GROUND} SELECT round(avg(rate), 6) AS grounding_rate_mean FROM g")
def a16_mean_grounding(spark, d):
    return verdicts.mean_grounding(_grounded(spark, d)).select(_round("grounding_rate_mean", "grounding_rate_mean"))


@query(f"{_GROUND} SELECT failure, count(*) AS n FROM g WHERE failure IS NOT NULL GROUP BY failure")
def a11_failure_taxonomy(spark, d):
    return metrics.failure_taxonomy(_grounded(spark, d).withColumn("failed", ~F.col("ok"))).withColumnRenamed("count", "n")


_TRACK = f"""{_GROUND}, {p_sql()}, tk AS (SELECT p.id, p.y, g.sha256 IS NULL AS gone, g.failure, t->>'$.label' AS label, (CASE WHEN g.failure IS NULL THEN t->>'$.confidence' END)::DOUBLE AS c FROM p LEFT JOIN g ON g.sha256 = p.id::VARCHAR AND g.sha256::BIGINT % 5 <> 0),
tr AS (SELECT id, y, gone OR failure IS NOT NULL AS failed, CASE WHEN gone THEN 'missing' ELSE failure END AS failure, CASE WHEN gone OR failure IS NOT NULL THEN -1 WHEN label = 'manipulated' THEN 1 ELSE 0 END AS pred,
  CASE WHEN gone OR failure IS NOT NULL THEN 0.5 WHEN label = 'manipulated' THEN c ELSE 1 - c END AS score FROM tk)"""


def _track(spark, d):
    order = t.predictions(spark, d).select(F.col("id").cast("string").alias("sha256"), "y")
    return verdicts.verdict_track(order, _grounded(spark, d).where(F.col("sha256").cast("long") % 5 != 0))  # a fifth of the answers is missing


@query(f"{_TRACK} SELECT id::VARCHAR AS id, pred::INTEGER AS pred, round(score, 6) AS score, failed, failure FROM tr")
def j6_verdict_track(spark, d):
    return _track(spark, d).select("id", "pred", _round("score", "score"), "failed", "failure")


@query(f"{_TRACK}, h8 AS (SELECT y, CASE WHEN failed THEN 1 - y ELSE pred END AS pred FROM tr), c8 AS (SELECT {_CELLS} FROM h8), m8 AS (SELECT n, {_VALUES} FROM c8) SELECT n, {_SHOWN} FROM m8")
def p8_failures_wrong(spark, d):
    return metrics.basic_metrics(metrics.force_failures_wrong(_track(spark, d))).select(*_show())


_PRICES = {"small": (0.25, 1.25), "large": (3.0, 15.0)}


def _turns(spark, d):
    rows = t.table(spark, d, "conversations")
    model = F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "large").otherwise("unknown")
    tokens = fn.token_estimate(F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", model.alias("model"), tokens.alias("input_tokens"), (tokens * 2).alias("output_tokens"))


@query("""WITH c AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model, length(coalesce(text, '')) // 4 AS n FROM conversations)
SELECT model, count(*) AS calls, sum(n)::BIGINT AS input_tokens, sum(2 * n)::BIGINT AS output_tokens, round(sum(n) * CASE model WHEN 'small' THEN 2.75 WHEN 'large' THEN 33.0 ELSE 0 END / 1e6, 6)::DOUBLE AS cost_usd FROM c GROUP BY model""")
def a17_cost_report(spark, d):
    """F17, F18, A17."""
    rows = _turns(spark, d).withColumn("ok", F.lit(True)).withColumn("cost_usd", verdicts.price(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), _PRICES))
    return verdicts.cost_report(rows, "model").select("model", "calls", "input_tokens", "output_tokens", _round("cost_usd", "cost_usd"))


@query("""SELECT conv_id, turn, role, text FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)""")
def s20_last_answers(spark, d):
    rows = t.table(spark, d, "conversations").withColumnRenamed("conv_id", "sha256")
    return verdicts.last_answers(rows, "turn").select(F.col("sha256").alias("conv_id"), "turn", "role", "text")


_FAMILY = "CASE " + " ".join(f"WHEN starts_with(signal, '{p}') THEN '{title}'" for p, title in fn.FAMILIES) + " ELSE 'Other signals' END"
_PROMPT_TEXT = prompt.INSTRUCTION.replace("'", "''")


@query(f"""WITH {S}, l AS (SELECT sha256, {_FAMILY} AS family, string_agg('  ' || signal || ' [' || region || '] = ' || printf('%.4f', value) || ' (' || direction || ')', chr(10) ORDER BY signal, region) AS lines FROM s GROUP BY ALL),
m AS (SELECT sha256, string_agg(family || ':' || chr(10) || lines, chr(10) || chr(10) ORDER BY family) AS m FROM l GROUP BY sha256),
p AS (SELECT sha256, 'FORENSIC MEASUREMENTS' || chr(10) || chr(10) || m || chr(10) || chr(10) || 'TASK' || chr(10) || chr(10) || '{_PROMPT_TEXT}' AS prompt FROM m)
SELECT sha256, prompt, length(prompt) // 4 AS tokens FROM p""")
def p4_prompts(spark, d):
    """F18-F20, P3, P4, W10, W11."""
    return prompt.build_prompts(t.signal_store(spark, d))


# Temporal


@query(f"""WITH {F_SQL}, p AS (SELECT * FROM f WHERE ok AND label IS NOT NULL),
l AS (SELECT *, lag(label) OVER w AS pl, lag(cited) OVER w AS pc FROM p WINDOW w AS (PARTITION BY clip ORDER BY frame_index)),
g AS (SELECT clip, count(*) AS n, sum(CASE WHEN label = 'manipulated' THEN confidence ELSE 0 END) AS m, sum(CASE WHEN label = 'authentic' THEN confidence ELSE 0 END) AS a, count(*) FILTER (pl <> label) AS flips,
  avg(CASE WHEN pc IS NOT NULL AND len(list_distinct(cited || pc)) > 0 THEN 1 - len(list_intersect(cited, pc)) / len(list_distinct(cited || pc)) END) AS drift FROM l GROUP BY clip),
k AS (SELECT clip, count(*) AS frames FROM f GROUP BY clip),
h AS (SELECT k.clip, frames, coalesce(n, 0) AS n, m, a, CASE WHEN n > 1 THEN flips / (n - 1) ELSE 0 END AS flip, coalesce(drift, 0) AS drift FROM k LEFT JOIN g USING (clip))
SELECT clip, CASE WHEN n = 0 OR m >= a THEN 'manipulated' ELSE 'authentic' END AS label, round(CASE WHEN n = 0 THEN 0.5 WHEN m + a > 0 THEN greatest(m, a) / (m + a) * (1 - flip / 2) ELSE 0.5 * (1 - flip / 2) END, 6)::DOUBLE AS confidence,
  round(flip, 6)::DOUBLE AS flip_rate, round(drift, 6)::DOUBLE AS signal_drift, n AS parsed_frames, frames - n AS failed_frames FROM h""")
def w6_clip_verdicts(spark, d):
    out = temporal.aggregate_clips(t.frames(spark, d))
    return out.select("clip", "label", *[_round(c, c) for c in ("confidence", "flip_rate", "signal_drift")], "parsed_frames", "failed_frames")


def _turn_pixels(spark, d):
    """Turns as tiny gray frames: the bytes of their text's digest."""
    rows = t.table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("frame_index"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(F.col("m"), i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return rows.select("clip", "frame_index", pixels.alias("pixels"))


@query("""WITH f AS (SELECT conv_id AS clip, turn AS frame_index, list_transform(range(16), lambda i: ('0x' || md5(coalesce(text, ''))[i * 2 + 1:i * 2 + 2])::INTEGER) AS px FROM conversations),
h AS (SELECT clip, frame_index, list_transform(range(32), lambda b: len(list_filter(px, lambda v: least(floor(v * 32 / 255.0::DOUBLE), 31) = b)) / 16::DOUBLE) AS hist FROM f),
l AS (SELECT *, lag(hist) OVER (PARTITION BY clip ORDER BY frame_index) AS before FROM h),
x AS (SELECT clip, frame_index, list_sum(list_transform(range(1, 33), lambda i: abs(hist[i] - before[i]))) / 2 AS distance FROM l WHERE before IS NOT NULL)
SELECT clip, frame_index, round(distance, 6) AS distance FROM x WHERE distance > 0.35""")
def w3_scene_changes(spark, d):
    frames = _turn_pixels(spark, d).select("clip", "frame_index", temporal.histogram(F.col("pixels")).alias("hist"))
    return temporal.scene_changes(frames).select("clip", "frame_index", _round("distance", "distance"))


@query("""WITH n AS (SELECT conv_id AS clip, count(*) AS n FROM conversations GROUP BY conv_id), m AS (SELECT clip, n, least(8, n) AS m FROM n),
u AS (SELECT DISTINCT clip, CASE WHEN k = m - 1 THEN CASE WHEN m > 1 THEN n - 1 ELSE 0 END ELSE floor(k * ((n - 1) / (m - 1)::DOUBLE))::BIGINT END AS frame_index FROM m, range(8) r(k) WHERE k < m),
c AS (SELECT DISTINCT conv_id AS clip, turn AS frame_index FROM conversations WHERE role = 'user'),
x AS (SELECT clip, frame_index, false AS is_scene_boundary FROM u UNION ALL SELECT clip, frame_index, true FROM c WHERE (clip, frame_index) NOT IN (SELECT (clip, frame_index) FROM u))
SELECT clip, frame_index, is_scene_boundary FROM x""")
def w4_w5_frame_samples(spark, d):
    """Uniform samples of every conversation, and its user turns as cuts."""
    rows = t.table(spark, d, "conversations")
    clips = rows.groupBy(F.col("conv_id").alias("clip")).agg(F.count("*").alias("n"))
    return temporal.sample_frames(clips, rows.where("role = 'user'").select(F.col("conv_id").alias("clip"), F.col("turn").alias("frame_index")))


# Signals, features

_BOX = "CASE WHEN {0} < 3 THEN 0 WHEN {0} < 5 THEN 1 ELSE 2 END"
_CELLS_R = f"'r' || {_BOX.format('y')} || 'c' || {_BOX.format('x')}"
_NEAR = "JOIN (SELECT unnest([-1, 0, 1]) AS dy) dy ON true JOIN (SELECT unnest([-1, 0, 1]) AS dx) dx ON true JOIN c q ON q.sha256 = p.sha256 AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx))"


def _signals(spark, d, extractor, names):
    rows = kernels.extract(t.images(spark, d), {extractor: kernels.EXTRACTORS[extractor]})
    return rows.where(F.col("signal").isin(*names)).select("sha256", "signal", "region", _round("value", "value"))


@query(f"""WITH {C_SQL}, m AS (SELECT p.sha256, p.y, p.x, any_value(p.v) - median(q.v) AS r FROM c p {_NEAR} GROUP BY p.sha256, p.y, p.x),
g AS (SELECT sha256, {_CELLS_R} AS region, stddev_pop(r) AS sd, CASE WHEN var_pop(r) < 1e-16 THEN 0 ELSE kurtosis_pop(r) END AS ku FROM m GROUP BY ALL),
o AS (SELECT a.sha256, a.region, median(b.sd) AS mo FROM g a JOIN g b ON a.sha256 = b.sha256 AND a.region <> b.region GROUP BY ALL)
SELECT sha256, 'noise_residual_std' AS signal, region, round(sd, 6) AS value FROM g UNION ALL SELECT sha256, 'noise_residual_kurtosis', region, round(ku, 6) FROM g
UNION ALL SELECT sha256, 'noise_region_mismatch', region, round(abs(sd - mo) / (mo + 1e-12), 6) FROM g JOIN o USING (sha256, region)""")
def k3_noise(spark, d):
    return _signals(spark, d, "noise_residuals", ["noise_residual_std", "noise_residual_kurtosis", "noise_region_mismatch"])


@query(f"""WITH {C_SQL}, s AS (SELECT p.sha256, p.y, p.x, sum(q.v * dx * (2 - abs(dy))) AS gx, sum(q.v * dy * (2 - abs(dx))) AS gy FROM c p {_NEAR} GROUP BY p.sha256, p.y, p.x),
g AS (SELECT sha256, {_CELLS_R} AS region, avg(sqrt(gx * gx + gy * gy)) AS density, avg(gx * gx) AS xx, avg(gy * gy) AS yy, avg(gx * gy) AS xy FROM s GROUP BY ALL)
SELECT sha256, 'edge_density' AS signal, region, round(density, 6) AS value FROM g
UNION ALL SELECT sha256, 'edge_orientation_coherence', region, round(CASE WHEN xx + yy < 1e-16 THEN 0 ELSE sqrt((xx - yy) ** 2 + 4 * xy ** 2) / (xx + yy) END, 6) FROM g""")
def k4_edges(spark, d):
    return _signals(spark, d, "edges_lighting", ["edge_density", "edge_orientation_coherence"])


@query()
def k1_k4_all_signals(spark, d):
    """All 134 measurements of every image (K1, K2, K4's lighting are compared with plain loops in the tests)."""
    return kernels.extract(t.images(spark, d))


@query("""WITH c AS (SELECT vec_id, list_transform(embedding[1:11], lambda x: abs(x::DOUBLE)) AS c FROM embeddings WHERE len(embedding) >= 11),
m AS (SELECT vec_id, c, list_sum(c) / 11 AS mean FROM c),
d AS (SELECT vec_id, c, list_transform(range(2, 11), lambda i: CASE WHEN least(c[i - 1], c[i + 1]) - c[i] > 0 THEN (least(c[i - 1], c[i + 1]) - c[i]) / (mean + 1e-12) ELSE 0::DOUBLE END) AS ds FROM m)
SELECT vec_id, (40 + 5 * CASE WHEN list_max(ds) > 0 THEN list_position(ds, list_max(ds)) + 1 ELSE list_position(c, list_min(c)) END)::DOUBLE AS quality, round(list_max(ds), 6) AS depth FROM d""")
def w7_ghost_dips(spark, d):
    rows = t.table(spark, d, "embeddings").where(F.size("embedding") >= 11)
    shaped = rows.select("vec_id", F.transform(F.slice("embedding", 1, 11), lambda x: F.abs(x.cast("double"))).alias("curve"))
    return curves.strongest_dips(shaped).select("vec_id", "quality", _round("depth", "depth"))


@query(f"WITH {S} SELECT sha256, signal, region FROM s GROUP BY ALL")
def k7_vocabulary(spark, d):
    return kernels.vocabulary(t.signal_store(spark, d))


@query(f"""WITH {S} SELECT sha256, {', '.join(f"round(max(value) FILTER (signal = '{s}' AND region = '{r}'), 6) AS {s}__{r}" for s in ('edge_density', 'jpeg_ghost_depth') for r in ('r0c0', 'r1c1', 'r2c2'))} FROM s GROUP BY sha256""")
def a4_pivot(spark, d):
    """One column a signal and region."""
    names = [f"{s}__{r}" for s in ("edge_density", "jpeg_ghost_depth") for r in ("r0c0", "r1c1", "r2c2")]
    wide = features.structured_matrix(t.signal_store(spark, d), names)
    return wide.select("sha256", *[_round(c, c) for c in names])


@query("""WITH x AS (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT pos::INTEGER AS pos, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END, 6) AS std FROM x GROUP BY pos""")
def a5_scaler(spark, d):
    return features.fit_scaler(t.table(spark, d, "embeddings"), "embedding").select("pos", _round("mean", "mean"), _round("std", "std"))


@query("""WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS d FROM x GROUP BY pos)
SELECT vec_id, round(sum(abs((x - m) / d)), 4) AS total FROM x JOIN s USING (pos) GROUP BY vec_id""")
def a6_scaled_vectors(spark, d):
    rows = t.table(spark, d, "embeddings").select("vec_id", "embedding")
    scaled = features.transform(rows, features.scaler_row(features.fit_scaler(rows, "embedding")), "embedding")
    return scaled.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("total"))


@query("SELECT doc_id::VARCHAR AS sha256 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j5_u3_incomplete(spark, d):
    """Documents without an embedding."""
    keys = t.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sha256"))
    return features.incomplete(keys, t.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("sha256")))


@query(f"WITH {S} SELECT sha256, signal, round(value, 6) AS value FROM s WHERE sha256::BIGINT IN (SELECT vec_id FROM embeddings)")
def j4_semi_join(spark, d):
    keys = t.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("sha256"))
    return features.only_keys(t.signal_store(spark, d), keys).select("sha256", "signal", _round("value", "value"))


# Exploration


@query(f"WITH {A} SELECT source, label, manipulation, count(*) AS n, median(n_chars) AS median_chars, round(avg((lang = 'en')::INTEGER), 6) AS english FROM a GROUP BY source, label, manipulation")
def a2_profile(spark, d):
    rows = t.assets(spark, d).groupBy("source", "label", "manipulation")
    return rows.agg(F.count("*").alias("n"), F.median("n_chars").alias("median_chars"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("english"))


@query("SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, quantile_cont(n_chars, 0.5)::DOUBLE AS median FROM documents GROUP BY source")
def a3_describe(spark, d):
    rows = t.table(spark, d, "documents").groupBy("source")
    return rows.agg(F.count("n_chars").alias("n"), _round(F.avg("n_chars"), "mean"), _round(F.stddev_samp("n_chars"), "std"), F.percentile("n_chars", F.lit(0.5)).alias("median"))


@query(f"WITH {A}, r AS (SELECT doc_id, source, label, row_number() OVER (PARTITION BY source, label ORDER BY sha256('11:' || doc_id), doc_id) AS n FROM a) SELECT doc_id, source, label FROM r WHERE n <= 300")
def w12_stratified_sample(spark, d):
    """At most 300 of each source and label, in seeded order: the limit is the operator."""
    rank = F.row_number().over(Window.partitionBy("source", "label").orderBy(fn.order_key(11, F.col("doc_id")), "doc_id"))
    return t.assets(spark, d).withColumn("n", rank).where("n <= 300").select("doc_id", "source", "label")


# Single functions and small operators


@query(f"WITH {A}, {H}, {U} SELECT m AS a, sha256 AS b FROM u JOIN (SELECT scene, min(sha256) AS m FROM u GROUP BY scene) USING (scene) WHERE m <> sha256")
def j12_scene_edges(spark, d):
    return dedupe.scene_edges(t.unique_assets(spark, d))


@query("SELECT doc_id, ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 2147483648 * 4294967296 + ('0x' || md5(doc_id::VARCHAR)[9:16])::BIGINT AS h FROM documents")
def f7_hex_to_long(spark, d):
    """The low 63 bits of a 64-bit hash in hexadecimal."""
    value = fn.hex_to_long(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16))
    return t.table(spark, d, "documents").select("doc_id", value.bitwiseAND(F.lit((1 << 63) - 1)).alias("h"))


@query(f"WITH {A}, {H}, {U}, r AS (SELECT sha256, h, lead(h) OVER (ORDER BY doc_id) AS n FROM u) SELECT sha256, bit_count(xor(h, n))::INTEGER AS bits FROM r WHERE n IS NOT NULL")
def f6_hamming(spark, d):
    """Distance of each asset's hash to the next asset's."""
    from attestor.operators.ranking import global_row_number

    rows = global_row_number(t.unique_assets(spark, d), "doc_id").select("sha256", "rn", fn.hex_to_long(F.col("phash")).alias("h"))
    following = rows.select((F.col("rn") - 1).alias("rn"), F.col("h").alias("n"))
    return rows.join(following, "rn").select("sha256", fn.hamming(F.col("h"), F.col("n")).alias("bits"))


@query("SELECT vec_id, round(least((abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE) * 1000) % 360, 360 - (abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE) * 1000) % 360), 6) AS degrees FROM embeddings WHERE len(embedding) >= 2")
def f23_angular_distance(spark, d):
    rows = t.table(spark, d, "embeddings").where(F.size("embedding") >= 2)
    a, b = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return rows.select("vec_id", F.round(fn.angular_distance(F.abs(a - b) * 1000, F.lit(0.0)), 6).alias("degrees"))


@query("SELECT doc_id, list_transform(range(4), lambda i: round(i * n_chars / 3)::INTEGER)::VARCHAR AS edges FROM documents")
def f21_region_edges(spark, d):
    edges = fn.region_edges(F.col("n_chars")).cast("array<string>")
    return t.table(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(edges, ", "), F.lit("]")).alias("edges"))


@query(f"WITH {C_SQL}, x AS (SELECT sha256, y, x, v - lag(v) OVER (PARTITION BY sha256, y ORDER BY x) AS d FROM c) SELECT sha256, x::INTEGER AS x, round(avg(abs(d)), 6) AS mean FROM x WHERE d IS NOT NULL GROUP BY sha256, x")
def w8_column_differences(spark, d):
    """Mean absolute first difference at each column."""
    rows = t.images(spark, d).select("sha256", F.posexplode("pixels").alias("i", "v")).select("sha256", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), (F.col("v") / 255.0).alias("v"))
    step = F.col("v") - F.lag("v").over(Window.partitionBy("sha256", "y").orderBy("x"))
    return rows.withColumn("d", step).where("d IS NOT NULL").groupBy("sha256", "x").agg(_round(F.avg(F.abs("d")), "mean"))


@query(f"""WITH {C_SQL}, g AS (SELECT sha256, {_CELLS_R} AS region, avg(v) AS m FROM c GROUP BY ALL)
SELECT a.sha256, a.region AS a, b.region AS b, round(abs(a.m - b.m), 6) AS gap FROM g a JOIN g b ON a.sha256 = b.sha256 AND a.region < b.region""")
def j9_region_pairs(spark, d):
    """Every unordered pair of an image's nine regions."""
    return _region_means(spark, d, "r").alias("a").join(_region_means(spark, d, "r").alias("b"), "sha256").where("a.region < b.region").select("sha256", F.col("a.region").alias("a"), F.col("b.region").alias("b"), F.round(F.abs(F.col("a.m") - F.col("b.m")), 6).alias("gap"))


def _region_means(spark, d, prefix):
    rows = t.images(spark, d).select("sha256", F.posexplode("pixels").alias("i", "v"))
    box = lambda c: F.when(c < 3, "0").when(c < 5, "1").otherwise("2")
    region = F.concat(F.lit(prefix), box(F.floor(F.col("i") / 8)), F.lit("c"), box(F.col("i") % 8))
    return rows.groupBy("sha256", region.alias("region")).agg(F.avg(F.col("v") / 255.0).alias("m"))


@query(f"""WITH {C_SQL}, g AS (SELECT sha256, {_CELLS_R} AS region, avg(v) AS m FROM c GROUP BY ALL),
o AS (SELECT a.sha256, a.region, any_value(a.m) AS m, median(b.m) AS mo FROM g a JOIN g b ON a.sha256 = b.sha256 AND a.region <> b.region GROUP BY a.sha256, a.region)
SELECT sha256, round(stddev_pop(m), 6) AS spread, round(max(m) - min(m), 6) AS range, round(max(abs(m - mo)), 6) AS mismatch FROM o GROUP BY sha256""")
def a18_region_reducers(spark, d):
    """Spread, range and the largest distance from the median of the other regions."""
    g = _region_means(spark, d, "r")
    others = g.select("sha256", F.col("region").alias("other"), F.col("m").alias("n"))
    o = g.join(others, "sha256").where("region <> other").groupBy("sha256", "region").agg(F.first("m").alias("m"), F.median("n").alias("mo"))
    return o.groupBy("sha256").agg(_round(F.stddev_pop("m"), "spread"), _round(F.max("m") - F.min("m"), "range"), _round(F.max(F.abs(F.col("m") - F.col("mo"))), "mismatch"))


@query(f"""WITH {C_SQL}, n AS (SELECT p.sha256, p.y, p.x, sum(q.v) - 4 * any_value(p.v) AS l FROM c p
JOIN (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx)) ON true JOIN c q ON q.sha256 = p.sha256 AND q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx)) GROUP BY p.sha256, p.y, p.x)
SELECT sha256, round(avg(abs(l)), 6) AS energy FROM n GROUP BY sha256""")
def k5_laplacian_energy(spark, d):
    """K5: the exploratory pilot measure."""
    @F.pandas_udf(DoubleType())
    def energy(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: kernels.laplacian_energy(np.asarray(p).reshape(8, 8) / 255.0))

    return t.images(spark, d).select("sha256", F.round(energy("pixels"), 6).alias("energy"))


@query(f"WITH {F_SQL} SELECT clip, frame_index, len(list_distinct(cited || ['s0', 's1'])) AS either, len(list_intersect(cited, ['s0', 's1'])) AS both FROM f")
def u4_array_sets(spark, d):
    two = F.array(F.lit("s0"), F.lit("s1"))
    size = lambda c: F.size(c).cast("long")
    return t.frames(spark, d).select("clip", "frame_index", size(F.array_union("cited", two)).alias("either"), size(F.array_intersect("cited", two)).alias("both"))


@query(f"WITH {A} SELECT doc_id, 'labelled' AS part FROM a WHERE manipulation <> 'none' UNION ALL SELECT doc_id, 'all' FROM a")
def u1_union(spark, d):
    rows = t.assets(spark, d)
    return rows.where("manipulation <> 'none'").select("doc_id", F.lit("labelled").alias("part")).unionByName(rows.select("doc_id", F.lit("all").alias("part")))


@query(f"WITH {p_sql()} SELECT id::VARCHAR AS id, y, pred, round(score, 6) AS score FROM p")
def j7_prediction_track(spark, d):
    """Stored scores in the order of the split; a missing one raises."""
    rows = t.predictions(spark, d)
    order = rows.select(F.col("id").cast("string").alias("sha256"), "y")
    return verdicts.prediction_track(order, rows.select(F.col("id").cast("string").alias("sha256"), "score")).select("id", "y", "pred", _round("score", "score"))


def _files(spark, d, source):
    """Documents as image files of a source: paths by number, contents the texts."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    case = lambda *names: F.when(i % 4 == 0, names[0]).when(i % 4 == 1, names[1]).when(i % 4 == 2, names[2]).otherwise(names[3])
    named = {
        "cifake": case(F.concat(F.lit("fake/a_"), n, F.lit(".png")), F.concat(F.lit("real/b.c_"), n, F.lit(".JPG")), F.concat(F.lit("real/note_"), n, F.lit(".txt")), F.concat(F.lit("fake/"), n, F.lit(".jpeg"))),
        "micc_f220": case(F.concat(F.lit("x/CRW_"), n, F.lit("tamp1.jpg")), F.concat(F.lit("x/DSC"), n, F.lit("_scale.png")), F.concat(F.lit("x/-Tamp"), n, F.lit(".jpg")), F.concat(F.lit("x/"), n, F.lit(".gif"))),
    }[source]
    rows = t.table(spark, d, "documents").select(named.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return rows.withColumn("name", F.element_at(F.split("path", "/"), -1))


_SUFFIX = "lower(regexp_extract(name, '(\\.[^./]*)$', 1)) IN (" + ", ".join(f"'{x}'" for x in fn.SUFFIXES) + ")"


@query(f"""WITH n AS (SELECT sha256(coalesce(text, '')) AS sha256, doc_id,
  CASE doc_id % 4 WHEN 0 THEN 'fake/a_' || doc_id || '.png' WHEN 1 THEN 'real/b.c_' || doc_id || '.JPG' WHEN 2 THEN 'real/note_' || doc_id || '.txt' ELSE 'fake/' || doc_id || '.jpeg' END AS cifake,
  CASE doc_id % 4 WHEN 0 THEN 'x/CRW_' || doc_id || 'tamp1.jpg' WHEN 1 THEN 'x/DSC' || doc_id || '_scale.png' WHEN 2 THEN 'x/-Tamp' || doc_id || '.jpg' ELSE 'x/' || doc_id || '.gif' END AS micc FROM documents),
f AS (SELECT sha256, 'cifake' AS source, cifake AS path FROM n UNION ALL SELECT sha256, 'micc_f220', micc FROM n),
g AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[-2] AS parent FROM f)
SELECT sha256, source, path, CASE WHEN (source = 'cifake' AND parent = 'fake') OR (source <> 'cifake' AND contains(lower(name), 'tamp')) THEN 'manipulated' ELSE 'authentic' END AS label,
  CASE WHEN source = 'cifake' AND parent = 'fake' THEN 'ai_generated' WHEN source <> 'cifake' AND contains(lower(name), 'tamp') THEN 'copy_move' ELSE 'none' END AS manipulation,
  CASE WHEN (source = 'cifake' AND parent = 'fake') OR (source <> 'cifake' AND contains(lower(name), 'tamp')) THEN 1 ELSE 0 END AS y,
  source || ':' || CASE WHEN source = 'cifake' THEN regexp_replace(name, '\\.[^.]*$', '') WHEN regexp_matches(name, '^[A-Za-z]*_?[0-9]+') THEN regexp_extract(name, '^([A-Za-z]*_?[0-9]+)', 1) ELSE name END AS scene
FROM g WHERE {_SUFFIX}""")
def s8_file_scan(spark, d):
    """Files of two sources, by suffix, with label, type, scene and hash."""
    from attestor.sources import assets as files

    scans = [files.scan_assets(_files(spark, d, source), source, "mit") for source in ("cifake", "micc_f220")]
    return scans[0].unionByName(scans[1]).select("sha256", "source", "path", "label", "manipulation", fn.binary_label(F.col("label")).alias("y"), "scene")


@query()
def m5_batch_scores(spark, d):
    """A head on embeddings against a label's parity, with the operator's own settings; seven tenths of the rows teach, the others choose the rate and the epoch."""
    from attestor.operators import classifier

    rows = t.table(spark, d, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("y"), F.col("embedding").alias("features"))
    part = F.crc32(F.col("id").cast("string").cast("binary")) % 10
    head, _ = classifier.sweep(rows.where(part < 7), rows.where(part >= 7))
    return classifier.score(head, rows)
