"""The evaluation report: a summary from stored predictions and verdicts, and its text."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.scalars import binary_label
from attestor.operators import calibration, metrics
from attestor.operators.verdicts import mean_grounding, prediction_track, verdict_track


def _metrics(rows: DataFrame) -> dict:
    found = {r["metric"]: {k: r[k] for k in ("value", "ci_low", "ci_high")} for r in metrics.bootstrap_metrics(rows).collect()}
    return found | {"parse_failure_rate": rows.agg(F.avg(F.col("failed").cast("double"))).first()[0] if "failed" in rows.columns else 0.0}


def summarize(test: DataFrame, predictions: DataFrame, val: DataFrame, val_predictions: DataFrame, answers: DataFrame | None = None) -> dict:
    """Everything that the report states. test and val: (sha256, label, manipulation); answers: verdict records, if any."""
    order = test.select("sha256", binary_label(F.col("label")).alias("y"))
    baseline = prediction_track(order, predictions).checkpoint()
    tracks = {"baseline": _metrics(baseline)}
    by_type = metrics.basic_metrics(baseline.join(test.select(F.col("sha256").alias("id"), "manipulation"), "id"), "manipulation").collect()
    summary = {"tracks": tracks, "type_counts": {r["manipulation"]: r["n"] for r in by_type}, "type_accuracy": {r["manipulation"]: r["accuracy"] for r in by_type}}
    val_rows = prediction_track(val.select("sha256", binary_label(F.col("label")).alias("y")), val_predictions)
    best = calibration.fit_temperature(val_rows, "val")
    ece = lambda rows: calibration.expected_calibration_error(rows).first()["ece"]
    summary["calibration"] = {"temperature": best, "ece_before": ece(baseline), "ece_after": ece(calibration.apply_temperature(baseline, best))}
    if answers is None:
        tracks["reasoner"] = {"absent": True}
        return summary
    reasoner = metrics.force_failures_wrong(verdict_track(order, answers)).checkpoint()
    tracks["reasoner"] = _metrics(reasoner)
    summary["comparison"] = metrics.paired_delta(reasoner, baseline, names=("reasoner", "baseline")).first().asDict()
    summary["grounding_rate_mean"] = mean_grounding(answers).first()[0] or 0.0
    return summary


def outcome(comparison: dict) -> str:
    """Who wins: only an interval on one side of zero decides."""
    return "beats" if comparison["ci_low"] > 0 else "loses to" if comparison["ci_high"] < 0 else "ties with"


def _undefined(x: float | None) -> bool:
    return x is None or math.isnan(x)


def metric_text(m: dict) -> str:
    if _undefined(m["value"]):
        return "undefined"
    if _undefined(m["ci_low"]) or _undefined(m["ci_high"]):
        return f"{m['value']:.4f} (CI undefined)"
    return f"{m['value']:.4f} [{m['ci_low']:.4f}, {m['ci_high']:.4f}]"


def render(summary: dict) -> str:
    """Markdown."""
    out = ["# Evaluation", "", f"Intervals: percentile bootstrap, {metrics.RESAMPLES} resamples, 95 %.", "", "| track | accuracy | macro F1 | AUROC | failed replies |", "|---|---|---|---|---|"]
    for name, m in summary["tracks"].items():
        cells = ["absent"] * 4 if m.get("absent") else [*(metric_text(m[k]) for k in ("accuracy", "macro_f1", "auroc")), f"{m['parse_failure_rate']:.4f}"]
        out.append(f"| {name} | " + " | ".join(cells) + " |")
    c = summary["calibration"]
    out += ["", f"Temperature {c['temperature']:.3f}, fitted on the validation split: calibration error {c['ece_before']:.4f} before, {c['ece_after']:.4f} after.", ""]
    out += [f"- {kind}: {n} assets, accuracy {summary['type_accuracy'][kind]:.4f}" for kind, n in sorted(summary["type_counts"].items())]
    if d := summary.get("comparison"):
        out += ["", f"The reasoner {outcome(d)} the baseline: {d['metric']} {d['delta']:+.4f} [{d['ci_low']:+.4f}, {d['ci_high']:+.4f}], mean grounding rate {summary['grounding_rate_mean']:.3f}."]
    return "\n".join(out) + "\n"


def to_json(summary: dict) -> str:
    """Standard JSON: undefined numbers are null."""
    clean = lambda x: {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else None if isinstance(x, float) and math.isnan(x) else x
    return json.dumps(clean(summary), indent=2, allow_nan=False) + "\n"
