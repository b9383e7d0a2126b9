"""Operators against hand-made cases and plain loops."""

import math
import random
import re
import subprocess
import sys
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor import schemas, session
from attestor.functions import scalars as fn
from attestor.operators import calibration, classifier, dedupe, features, kernels, metrics, prompt, splits, temporal, verdicts
from attestor.plans import harness, queries, report
from attestor.sources import assets, store
from attestor.streaming.verdict_ingest import ingest


def asset_rows(spark, rows):
    return spark.createDataFrame(rows, "sha256 string, label string, scene string, phash string, path string, manipulation string")


def random_assets(n, seed=7):
    rng = random.Random(seed)
    out, hashes = [], []
    for _ in range(n):
        if hashes and rng.random() < 0.4:
            h = hashes[rng.randrange(len(hashes))]
            for _ in range(rng.randint(0, 6)):
                h ^= 1 << rng.randrange(64)
        else:
            h = rng.getrandbits(64)
        hashes.append(h)
        out.append((f"{rng.getrandbits(256):064x}", rng.choice(["authentic", "manipulated"]), f"s{rng.randrange(n // 3)}", f"{hashes[rng.randrange(len(hashes))] if rng.random() < 0.1 else h:016x}", f"p{rng.randrange(10**6)}", rng.choice(["none", "copy_move", "ai_generated"])))
    return out


def test_label_conflicts_and_copies(spark):
    rows = [("x", "authentic", "1", "0" * 16, "b", "none"), ("x", "manipulated", "2", "0" * 16, "a", "none"), ("y", "authentic", "3", "0" * 16, "d", "none"), ("y", "authentic", "4", "0" * 16, "c", "none")]
    fate = {r["path"]: r["fate"] for r in dedupe.exact_dedupe(asset_rows(spark, rows), "path").collect()}
    assert fate == {"a": "label_conflict", "b": "label_conflict", "c": "kept", "d": "exact_copy"}


def test_hashes_four_bits_apart_in_four_bands(spark):
    far = sum(1 << b for b in (0, 13, 26, 39))
    rows = [("a", "authentic", "1", "0" * 16, "a", "none"), ("b", "authentic", "2", f"{far:016x}", "b", "none"), ("c", "authentic", "3", f"{(1 << 63) | far | 1 << 62:016x}", "c", "none")]
    got = dedupe.collapse_report(dedupe.collapse(asset_rows(spark, rows), "path")).first()
    assert got["near_removed"] == 1 and got["input"] == got["output"] + 1


@pytest.mark.parametrize(("max_bits", "intact"), [(4, 1), (4, 2), (4, 4), (0, 1), (2, 3), (4, None)])
def test_near_hashes_of_any_block_choice_equal_all_pairs(spark, max_bits, intact):
    hashes = sorted({int(r[3], 16) - (1 << 63) for r in random_assets(250)})
    got = [(r["hx"], r["hy"]) for r in dedupe._near_hashes(spark.createDataFrame([(h,) for h in hashes] + [(None,)], "h long"), max_bits, intact).collect()]
    want = [(x, y) for i, x in enumerate(hashes) for y in hashes[i + 1 :] if ((x ^ y) & (1 << 64) - 1).bit_count() <= max_bits]
    assert sorted(got) == want  # each pair once
    assert [dedupe._intact_blocks(n, 4) for n in (0, 10**3, 10**6, 10**9)] == sorted(dedupe._intact_blocks(n, 4) for n in (0, 10**3, 10**6, 10**9))


def test_near_dedupe_of_hot_hashes_equals_plain_loop(spark):
    rng = random.Random(8)
    hashes = [0, 1, 3, (1 << 40) - 1, 0x1F]
    rows = [(f"{rng.getrandbits(64):016x}", rng.choice(["authentic", "manipulated"]), f"s{rng.randrange(9)}", f"{rng.choice(hashes):016x}", f"p{k}", "none") for k in range(150)]
    kept = []
    for r in sorted(rows):
        if not any(k[1] == r[1] and k[2] != r[2] and (int(k[3], 16) ^ int(r[3], 16)).bit_count() <= 4 for k in kept):
            kept.append(r)
    unknown = [("x1", None, "s1", "0" * 16, "q1", "none"), ("x2", "authentic", "s1", None, "q2", "none"), ("x3", "authentic", None, "0" * 16, "q3", "none")]
    frame = spark.createDataFrame(rows + unknown, "sha256 string, label string, scene string, phash string, path string, manipulation string")
    got = dedupe.near_dedupe(frame).collect()
    assert len(got) == len(rows) + 3
    assert {r["sha256"] for r in got if r["kept"]} == {k[0] for k in kept} | {"x1", "x2", "x3"}
    assert len({r[2] for r in kept}) > 1 and dedupe.near_dedupe(frame.limit(0)).count() == 0


def test_near_dedupe_and_clusters_equal_plain_loops(spark):
    rows = random_assets(300)
    frame = asset_rows(spark, rows)
    edges = {(r["a"], r["b"]) for r in dedupe.near_edges(frame).collect()}
    by = sorted(rows)
    want = {(p[0], q[0]) for i, p in enumerate(by) for q in by[i + 1 :] if (int(p[3], 16) ^ int(q[3], 16)).bit_count() <= 4}
    assert edges == want and edges
    kept = []
    for r in by:
        if not any((k[0], r[0]) in want and k[1] == r[1] and k[2] != r[2] for k in kept):
            kept.append(r)
    got = {r["sha256"] for r in dedupe.greedy_keep(frame, dedupe.near_edges(frame, dedupe.same_label_other_scene)).where("kept").collect()}
    assert got == {k[0] for k in kept}
    assert {r["sha256"] for r in dedupe.near_dedupe(frame).where("kept").collect()} == got

    group = {r[0]: r[0] for r in rows}
    while True:
        links = [(a, b) for a, b in want] + [(p[0], q[0]) for p in rows for q in rows if p[2] == q[2]]
        moved = False
        for a, b in links:
            low = min(group[a], group[b])
            moved |= group[a] != low or group[b] != low
            group[a] = group[b] = low
        if not moved:
            break
    clusters = {r["sha256"]: r["cluster"] for r in dedupe.cluster_assets(frame).collect()}
    assert clusters == group


def test_near_edges_deal_out_assets_not_pairs(spark):
    rng = random.Random(4)
    hashes = [0] * 700 + [1, 3, 7, (1 << 40) - 1] * 5
    rows = [(f"{rng.getrandbits(256):064x}", rng.choice(["authentic", "manipulated"]), f"s{rng.randrange(3)}", f"{h:016x}", f"p{k}", "none") for k, h in enumerate(hashes)]
    unknown = [("x1", "authentic", "s1", None, "q1", "none"), (None, "authentic", "s1", "0" * 16, "q2", "none"), ("x3", None, None, "0" * 16, "q3", "none"), ("x3", None, None, "0" * 16, "q4", "none")]
    frame = asset_rows(spark, rows + unknown)
    by = sorted([*rows, unknown[2]])
    linked = [(p, q) for i, p in enumerate(by) for q in by[i + 1 :] if (int(p[3], 16) ^ int(q[3], 16)).bit_count() <= 4]
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (store.apply(i) for i in range(store.size()))}
    for guard, want in ((None, linked), (dedupe.same_label_other_scene, [(p, q) for p, q in linked if p[1] and p[1] == q[1] and p[2] != q[2]])):
        store = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        before = stages()
        got = [(r["a"], r["b"]) for r in dedupe.near_edges(frame, guard).collect()]
        assert sorted(got) == [(p[0], q[0]) for p, q in want] and len(want) > 50_000  # each pair once
        store = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        assert 0 < sum(n for k, n in stages().items() if k not in before) < 20_000
    twice = asset_rows(spark, rows[:40] + [(r[0], "other", "s9", r[3], "r", "none") for r in rows[:20]])  # equal bytes under two labels
    got = [(r["a"], r["b"]) for r in dedupe.near_edges(twice, lambda p, q: p["label"] != q["label"]).collect()]
    by = sorted({r[0] for r in rows[:40]})
    label = {r[0]: {r[1]} for r in rows[:40]}
    for r in rows[:20]:
        label[r[0]] |= {"other"}
    assert sorted(got) == [(a, b) for i, a in enumerate(by) for b in by[i + 1 :] if len(label[a] | label[b]) > 1]


def test_near_edges_query_deals_out_no_texts(spark, tmp_path):
    import hashlib

    rng = random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(64):016x}" for _ in range(500)) for _ in range(100)]
    docs = [(2 * k + j, text + j * " again", "en", "src0", len(text) + 6 * j) for k, text in enumerate(texts) for j in (0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[0] % 2, 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before, most = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with labels that are too many to broadcast
    try:
        got = {(r["a"], r["b"]) for r in queries.QUERIES["j2_near_edges"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    sha = {d[0]: hashlib.sha256(d[1].encode()).hexdigest() for d in docs}
    assert len({tuple(sorted((sha[2 * k], sha[2 * k + 1]))) for k in range(100)} & got) > 50
    assert 0 < sum(n for k, n in written().items() if k not in before) < sum(len(d[1]) for d in docs) / 4


def test_splits_follow_the_greedy_order(spark):
    frame = asset_rows(spark, random_assets(400, 3))
    got = splits.assign_splits(frame).select("sha256", "cluster", "split", "manipulation").collect()
    where = {}
    for r in got:
        assert where.setdefault(r["cluster"], r["split"]) == r["split"]
    import hashlib

    sizes, kinds = {}, {}
    for r in sorted(got, key=lambda r: r["sha256"]):
        sizes[r["cluster"]] = sizes.get(r["cluster"], 0) + 1
        kinds.setdefault(r["cluster"], []).append(r["manipulation"])
    dominant = {c: max(dict.fromkeys(k), key=k.count) for c, k in kinds.items()}
    for kind in set(dominant.values()):
        mine = sorted((c for c in dominant if dominant[c] == kind), key=lambda c: hashlib.sha256(f"{splits.SPLIT_SEED}:{c}".encode()).hexdigest())
        total, fill = sum(sizes[c] for c in mine), dict.fromkeys(["test", "train", "val"], 0)
        for c in mine:
            best = max(fill, key=lambda s: splits.RATIOS[s] * total - fill[s])
            assert where[c] == best
            fill[best] += sizes[c]
    assigned = spark.createDataFrame(got)
    digest = splits.canonical_hash(assigned.where("split = 'test'"))
    assert digest == splits.canonical_hash_column(assigned.where("split = 'test'"), "split").first()["sha256"]
    assert splits.verify_split(assigned, digest) and not splits.verify_split(assigned, "0")


def eval_rows(spark, y, pred, score=None):
    return spark.createDataFrame([(i, a, b, float(c)) for i, (a, b, c) in enumerate(zip(y, pred, score or pred, strict=True))], "id int, y int, pred int, score double")


def test_metrics_by_hand(spark):
    m = metrics.basic_metrics(eval_rows(spark, [1, 1, 1, 0, 0], [1, 1, 0, 0, 1])).first()
    assert m["accuracy"] == pytest.approx(0.6) and m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3) and m["macro_f1"] == pytest.approx(7 / 12)
    assert tuple(metrics.confusion(eval_rows(spark, [0, 0, 1, 1, 1], [0, 1, 1, 1, 0])).first()) == (1, 1, 1, 2)
    assert metrics.rank_auc(eval_rows(spark, [0, 0, 1, 1], [0] * 4, [0.1, 0.2, 0.8, 0.9])).first()[0] == 1.0
    assert metrics.rank_auc(eval_rows(spark, [0, 0, 1, 1], [0] * 4, [0.9, 0.8, 0.2, 0.1])).first()[0] == 0.0
    assert metrics.rank_auc(eval_rows(spark, [1, 1], [0] * 2, [0.9, 0.8])).first()[0] is None
    assert metrics.rank_auc_tied(eval_rows(spark, [0, 1], [0] * 2, [0.5, 0.5])).first()[0] == 0.5


def test_ranks_and_slices_equal_plain_loops(spark):
    from attestor.operators.ranking import global_row_number, global_running_sum

    rng = random.Random(9)
    data = [(i, rng.randint(0, 1), rng.randint(0, 9) / 10, rng.choice("aab")) for i in range(500)]
    rows = spark.createDataFrame(data, "id int, y int, score double, source string")
    order = sorted(data, key=lambda r: (r[2], r[0]))
    assert {r["id"]: r["rn"] for r in global_row_number(rows, "score", "id").collect()} == {r[0]: i for i, r in enumerate(order, 1)}
    sums = {r["id"]: r["upto"] for r in global_running_sum(rows, "y", "score", "id", name="upto").collect()}
    assert all(sums[r[0]] == sum(x[1] for x in order[: i + 1]) for i, r in enumerate(order))

    def auc(part):
        ones = sum(r[1] for r in part)
        ranks = sum(i for i, r in enumerate(part, 1) if r[1])
        return (ranks - ones * (ones + 1) / 2) / (ones * (len(part) - ones))

    want = {s: auc([r for r in order if r[3] == s]) for s in "ab"}
    got = {r["source"]: r["auc"] for r in metrics.folded_auc(rows, "source").collect()}
    assert got == {s: round(max(a, 1 - a), 4) for s, a in want.items()}
    pairs = [(p[2] > q[2]) + 0.5 * (p[2] == q[2]) for p in data if p[1] for q in data if not q[1]]
    assert metrics.rank_auc_tied(rows).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_bootstrap_brackets_and_paired_delta(spark):
    rng = random.Random(1)
    y = [rng.randint(0, 1) for _ in range(300)]
    noisy = lambda p: [1 - v if rng.random() < p else v for v in y]
    a, b = noisy(0.1), noisy(0.3)
    got = {r["metric"]: r for r in metrics.bootstrap_metrics(eval_rows(spark, y, a), 200).collect()}
    assert all(r["ci_low"] <= r["value"] <= r["ci_high"] for r in got.values())
    d = metrics.paired_delta(eval_rows(spark, y, a), eval_rows(spark, y, b), count=200).first()
    assert d["favors"] == "a" and d["ci_low"] > 0
    assert metrics.paired_delta(eval_rows(spark, y, a), eval_rows(spark, y, a), count=20).first()["favors"] == "b"


def test_calibration(spark):
    rows = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.9), (1, 1, 0.9), (0, 1, 0.9)], "y int, pred int, score double")
    assert calibration.expected_calibration_error(rows).first()[0] == pytest.approx(0.4)
    assert calibration.reliability(rows).count() == 15
    rng = random.Random(2)
    data = [(i, y, 0.97 if p else 0.03, int(p)) for i in range(2000) for y in [rng.randint(0, 1)] for p in [(y == 1) == (rng.random() < 0.8)]]
    over = spark.createDataFrame(data, "id int, y int, score double, pred int")
    t = calibration.fit_temperature(over, "val")
    ece = lambda r: calibration.expected_calibration_error(r).first()[0]
    assert t > 1 and ece(calibration.apply_temperature(over, t)) < ece(over)
    with pytest.raises(ValueError):
        calibration.fit_temperature(over, "test")


PARSE = [
    ('{"label": "authentic", "confidence": 0.5, "evidence": []}', None), ('```json\n{"label": "authentic", "confidence": 1, "evidence": []}\n```', None), ('{"a":1} x', "not_json"), ("", "not_json"), (None, "not_json"),
    ('{"label": "authentic", "confidence": NaN, "evidence": []}', "confidence_out_of_range"), ('{"label": "fake", "label": "authentic", "confidence": 0.1, "evidence": []}', None), ("[]", "schema_violation"),
    ('{"label": "authentic", "confidence": 0.5}', "schema_violation"), ('{"label": "x", "confidence": 0.5, "evidence": []}', "label_invalid"), ('{"label": ["authentic"], "confidence": 0.5, "evidence": []}', "label_invalid"),
    ('{"label": "authentic", "confidence": true, "evidence": []}', "confidence_out_of_range"), ('{"label": "authentic", "confidence": 2, "evidence": []}', "confidence_out_of_range"), ('{"label": "authentic", "confidence": 0, "evidence": {}}', "evidence_malformed"),
    ('{"label": "authentic", "confidence": 0, "evidence": [{"signal": "a", "region": 1, "direction": "supports_authentic"}]}', "evidence_malformed"), ('{"label": "authentic", "confidence": 0, "evidence": [{"signal": "a", "region": "b", "direction": "c"}]}', "evidence_malformed"),
]


@pytest.mark.parametrize("reply, failure", PARSE)
def test_strict_parse(reply, failure):
    assert verdicts.parse_reply(reply)["failure"] == failure


def signal_rows(spark, shas=("a", "b", "c", "d")):
    rows = [(s, n, r, v, "higher_is_suspicious", "x", "1") for s in shas for n, r, v in (("noise_region_mismatch", "r1c1", 0.91234), ("jpeg_ghost_depth", "r0c2", 0.4567))]
    return spark.createDataFrame(rows, schemas.SIGNAL)


def test_prompt_text(spark):
    got = prompt.build_prompts(signal_rows(spark, ("a",))).first()
    want = "FORENSIC MEASUREMENTS\n\nCompression: JPEG ghost analysis:\n  jpeg_ghost_depth [r0c2] = 0.4567 (higher_is_suspicious)\n\nNoise residuals:\n  noise_region_mismatch [r1c1] = 0.9123 (higher_is_suspicious)\n\nTASK\n\n" + prompt.INSTRUCTION
    assert got["prompt"] == want and got["tokens"] == len(want) // 4


def test_four_decimals_round_like_the_binary_value(spark):
    values = [0.00015, 0.12345, 2.5e-05, -1.00005, 1e6]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(fn.four_decimals("v")).collect()
    assert [r[0] for r in got] == [f"{v:.4f}" for v in values]


def test_batch_resumes_and_counts(spark, tmp_path):
    good = '{"label": "manipulated", "confidence": 0.8, "evidence": [{"signal": "jpeg_ghost_depth", "region": "r0c2", "direction": "supports_manipulated"}]}'
    frame = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sha256 string").coalesce(1)
    out = str(tmp_path / "verdicts")
    run = lambda replies, limit=None: verdicts.run_batch("val", frame, signal_rows(spark), out, lambda: verdicts.ScriptedBackend(replies), "m", {"m": (3.0, 15.0)}, limit).first()
    first = run([good], 2)
    assert (first["total"], first["skipped"], first["calls"], first["parse_failures"]) == (2, 0, 2, 0) and first["cost_usd"] == pytest.approx(2 * (10 * 3 + 5 * 15) / 1e6)
    second = run(["nonsense"])
    assert (second["total"], second["skipped"], second["calls"], second["parse_failures"]) == (4, 2, 2, 2)
    records = verdicts.read_verdicts(spark, out)
    assert records.count() == 4 and {r["failure"] for r in records.collect()} == {None, "not_json"}
    with pytest.raises(ValueError):
        harness.reason_on_split(spark, out, "test")
    ingest(spark, out, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def test_answers_are_kept_when_a_later_one_fails(spark, tmp_path):
    frame = spark.createDataFrame([("a",), ("b",), ("z",)], "sha256 string")
    out = str(tmp_path / "verdicts")
    run = lambda frame: verdicts.run_batch("val", frame, signal_rows(spark), out, lambda: verdicts.ScriptedBackend(["nonsense"]), flush=2)
    with pytest.raises(Exception, match="no measurements for z"):
        run(frame)
    assert sorted(r["sha256"] for r in verdicts.read_verdicts(spark, out).collect()) == ["a", "b"]
    assert run(frame.where("sha256 <> 'z'")).first()["skipped"] == 2


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return verdicts.Reply("x")

    assert verdicts.call_with_retries(call, sleep=waits.append).text == "x" and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        verdicts.call_with_retries(lambda: 1 / 0, sleep=waits.append)


def clip(spark, *frames):
    return temporal.aggregate_clips(spark.createDataFrame([("c", i, *f) for i, f in enumerate(frames)], "clip string, frame_index long, ok boolean, label string, confidence double, cited array<string>")).first()


def test_clips(spark):
    steady = clip(spark, *[(True, "manipulated", 0.8, ["a"])] * 4)
    assert (steady["label"], steady["confidence"], steady["flip_rate"], steady["signal_drift"]) == ("manipulated", 1.0, 0.0, 0.0)
    swing = clip(spark, (True, "manipulated", 0.9, ["a"]), (True, "authentic", 0.9, ["b"]), (False, None, None, ["z"]), (True, "manipulated", 0.9, []))
    assert swing["flip_rate"] == 1.0 and swing["signal_drift"] == 1.0 and swing["failed_frames"] == 1
    assert clip(spark, (True, "authentic", 0.5, []), (True, "manipulated", 0.5, []))["label"] == "manipulated"
    none = clip(spark, (False, None, None, []))
    assert (none["label"], none["confidence"], none["parsed_frames"]) == ("manipulated", 0.5, 0)


def test_scene_change_and_samples(spark):
    frames = spark.createDataFrame([("c", i, [0] * 16 if i < 3 else [255] * 16) for i in range(6)], "clip string, frame_index long, pixels array<int>")
    hist = frames.select("clip", "frame_index", temporal.histogram(F.col("pixels")).alias("hist"))
    assert [r["frame_index"] for r in temporal.scene_changes(hist).collect()] == [3]
    n = spark.createDataFrame([(k, k) for k in (1, 2, 7, 24, 100)], "clip int, n long")
    for r in n.select("n", temporal.uniform_indices(F.col("n")).alias("at")).collect():
        m = min(8, r["n"])
        assert r["at"] == [(k * (r["n"] - 1)) // (m - 1) if m > 1 else 0 for k in range(m)]


def picture(side=96, seed=0):
    rng = np.random.default_rng(seed)
    return np.clip(128 + 20 * kernels.blur(rng.normal(size=(side, side)), 1.0) * 5 + rng.normal(0, 6, (side, side)), 0, 255).round()


def plain_median(x):
    p = np.pad(x, 1, mode="symmetric")
    return np.array([[np.median(p[i : i + 3, j : j + 3]) for j in range(x.shape[1])] for i in range(x.shape[0])])


def test_kernels():
    image = picture()
    for name, (kernel, _) in kernels.EXTRACTORS.items():
        rows = list(kernel(image))
        assert len({r[:2] for r in rows}) == len(rows) == {"compression_ghosts": 20, "blocking_grid": 29, "noise_residuals": 38, "edges_lighting": 47}[name]
        assert all(np.isfinite(r[2]) for r in rows)
    assert np.allclose(kernels.noise_residual(image), image - plain_median(image))
    ramp = np.add.outer(np.zeros(96), np.arange(96.0))
    degrees = lambda x: np.degrees(np.angle(kernels.shading(x)))
    assert degrees(ramp) == pytest.approx(np.zeros((3, 3)), abs=1) and degrees(ramp.T[::-1]) == pytest.approx(np.full((3, 3), 90), abs=1)
    assert not kernels.shading(np.full((50, 70), 0.3)).any()
    assert kernels.strongest_dip(np.array([9.0, 8, 5, 7, 6, 5, 4, 3, 2, 1, 0])) == (55.0, pytest.approx(2 / (50 / 11)))
    assert kernels.strongest_dip(np.arange(11.0)) == (45.0, 0.0)
    with pytest.raises(ValueError):
        kernels.check_signal("Bad Name", "r0c0")


def test_ghost_and_grid_follow_the_image():
    image = kernels.recompress(picture(192, 1), 60)
    errors = [((image - kernels.recompress(image, q)) ** 2).mean() for q in kernels.QUALITIES]
    assert kernels.QUALITIES[int(np.argmin(errors))] in (60, 55, 65, 95) and errors[kernels.QUALITIES.index(60)] < 0.5
    most = lambda found: max(found, key=found.count)
    for cut, grid in ((0, (7, 7)), (3, (4, 4))):
        _, lines, columns = kernels.blocking_phases(kernels.recompress(picture(192, 1), 45)[cut:, cut:])
        assert most(list(zip(lines.tolist(), columns.tolist(), strict=True))) == grid


def plain_phase(part, first):
    """(contrast, phase) of column steps, phase by phase."""
    steps = [[abs(int(b) - int(a)) for a, b in zip(row, row[1:], strict=False)] for row in part.tolist()]
    if len(part) == 0 or len(steps[0]) < 16:
        return 0.0, first % 8
    by_phase = {p: Fraction(sum(sum(row[p::8]) for row in steps), len(steps) * len(steps[0][p::8])) for p in range(8)}
    best = max(by_phase, key=lambda p: (by_phase[p], -p))
    rest = sum(e for p, e in by_phase.items() if p != best) / 7
    return float(by_phase[best] - rest) / (float(sum(by_phase.values()) / 8) + 1e-12), (best + first) % 8


def plain_shading(part):
    k = [math.exp(-0.5 * (i / 12) ** 2) for i in range(-48, 49)]
    mirror = lambda i, n: (lambda j: j if j < n else 2 * n - 1 - j)(i % (2 * n))
    line = lambda v: np.array([sum(w * v[mirror(i + d, len(v))] for d, w in zip(range(-48, 49), k, strict=True)) / sum(k) for i in range(len(v))])
    smooth = np.array([line(row) for row in np.array([line(col) for col in part.T]).T])
    p = np.pad(smooth, 1, mode="symmetric")
    gx = sum(w * (p[d : d + len(part), 2:] - p[d : d + len(part), :-2]) for d, w in ((0, 1), (1, 2), (2, 1)))
    gy = sum(w * (p[2:, d : d + part.shape[1]] - p[:-2, d : d + part.shape[1]]) for d, w in ((0, 1), (1, 2), (2, 1)))
    return complex(gx.mean(), -gy.mean()) / (np.hypot(gx, gy).mean() + 1e-12)


@pytest.mark.parametrize("shape", [(24, 24), (50, 61), (55, 9), (130, 70)])
def test_grid_and_light_equal_plain_loops(shape):
    image = picture(140, 3)[: shape[0], : shape[1]]
    strength, lines, columns = kernels.blocking_phases(image)
    light = kernels.shading(image / 255.0).ravel()
    for k, (rows, cols) in enumerate(kernels.regions(image).values()):
        across, v = plain_phase(image[rows, cols], cols.start)
        down, h = plain_phase(image[rows, cols].T, rows.start)
        assert (h, v) == (lines[k], columns[k]) and strength[k] == pytest.approx((across + down) / 2)
        assert light[k] == pytest.approx(plain_shading(image[rows, cols] / 255.0), abs=1e-9)


def images(spark, n, start=0):
    rows = [(f"i{k}", 24, 24, picture(24, k).ravel().tolist()) for k in range(start, start + n)]
    return spark.createDataFrame(rows, "sha256 string, height int, width int, pixels array<double>")


def test_store_is_incremental_by_version(spark, tmp_path):
    path = str(tmp_path / "store")
    extractors = {"blocking_grid": (kernels.blocking_grid, "1"), "noise_residuals": (kernels.noise, "1")}
    new = lambda df, e: {r["extractor"]: r["new_assets"] for r in store.build_store(df, path, e).collect()}
    assert store.load_features(spark, path).count() == 0
    assert new(images(spark, 3), extractors) == {"blocking_grid": 3, "noise_residuals": 3}
    assert new(images(spark, 4), extractors) == {"blocking_grid": 1, "noise_residuals": 1}
    assert store.load_features(spark, path, extractors=extractors).count() == 4 * (29 + 38)
    bumped = extractors | {"noise_residuals": (kernels.noise, "2")}
    assert store.load_features(spark, path, extractors=bumped).count() == 4 * 29
    assert new(images(spark, 4), bumped) == {"blocking_grid": 0, "noise_residuals": 4}
    assert store.load_features(spark, path, images(spark, 1), bumped).count() == 29 + 38


def test_embedding_cache_and_assembly(spark, tmp_path):
    path = str(tmp_path / "cache")
    embed = lambda df: df.select("sha256", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert store.append_embeddings(images(spark, 3), path, embed) == 3 and store.append_embeddings(images(spark, 5), path, embed) == 2
    emb = store.load_embeddings(spark, path)
    signals = kernels.extract(images(spark, 5), {"blocking_grid": (kernels.blocking_grid, "1")})
    full = features.assemble(images(spark, 5), emb, signals)
    assert full.count() == 5 and len(full.first()["features"]) == 2 + 29
    with pytest.raises(Exception, match="no features for"):
        features.assemble(images(spark, 6), emb, signals).collect()
    assert features.incomplete(images(spark, 6), emb).count() == 1
    with pytest.raises(ValueError):
        features.structured_matrix(signals, ["file_size__global"])


def test_scaler(spark):
    v = spark.createDataFrame([([0.0, 10.0, 3.0],), ([2.0, 30.0, 3.0],)], "features array<float>")
    s = features.scaler_row(features.fit_scaler(v))
    assert s.first()["mean"] == [1.0, 20.0, 3.0] and s.first()["std"] == [1.0, 10.0, 1.0]
    assert sorted(r[0] for r in features.transform(v, s).collect()) == [[-1.0, -1.0, 0.0], [1.0, 1.0, 0.0]]


def test_split_gate(spark, tmp_path):
    path = str(tmp_path / "splits")
    store.write_splits(spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "val")], "sha256 string, split string"), path)
    assert [r[0] for r in store.load_split(spark, path, "train").collect()] == ["a"]
    with pytest.raises(store.TestSplitAccessError):
        store.load_split(spark, path, "test")
    with pytest.raises(store.TestSplitAccessError):
        store.HarnessToken()
    with pytest.raises(ValueError):
        store.load_split(spark, path, "other")
    assert [r[0] for r in harness.load_test_split(spark, path).collect()] == ["b"]
    once = spark.range(1)
    store.write_once(once, str(tmp_path / "once"))
    with pytest.raises(Exception, match="exists"):
        store.write_once(once, str(tmp_path / "once"))


def png(gray):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = gray.shape
    lines = []
    for y in range(h):
        before = gray[y - 1] if y else np.zeros(w, dtype=np.uint8)
        left = np.concatenate(([0], gray[y, :-1]))
        kinds = [gray[y], gray[y] - left, gray[y] - before]
        lines.append(bytes([y % 3]) + (kinds[y % 3].astype(np.int64) & 255).astype(np.uint8).tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_sources(spark, tmp_path):
    import hashlib
    import io
    import zipfile

    gray = np.random.default_rng(0).integers(0, 256, (9, 7)).astype(np.uint8)
    assert np.array_equal(assets.decode_gray(png(gray)), gray)
    assert np.array_equal(assets.decode_gray(b"P5\n7 9\n255\n" + gray.tobytes()), gray)
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("fake/img_2.png", png(gray))
        f.writestr("real/img_1.JPG", b"x")
        f.writestr("real/notes.txt", b"y")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(z.getvalue())
    files = assets.read_files(spark, str(tmp_path / "in"))
    digest = hashlib.sha256(z.getvalue()).hexdigest()
    assets.check_files(files, spark.createDataFrame([("http://x/a.zip", digest)], "url string, sha256 string"))
    with pytest.raises(assets.ChecksumMismatchError) as e:
        assets.check_files(files, spark.createDataFrame([("http://x/a.zip", "0")], "url string, sha256 string"))
    assert e.value.actual == digest and e.value.expected == "0"
    members = assets.extract_archives(files).withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = {r["path"]: r for r in assets.scan_assets(members, "cifake", "mit").collect()}
    assert {p: (r["label"], r["manipulation"], r["scene"]) for p, r in rows.items()} == {"fake/img_2.png": ("manipulated", "ai_generated", "cifake:img_2"), "real/img_1.JPG": ("authentic", "none", "cifake:img_1")}
    named = spark.createDataFrame([("micc_f220", "d/CRW_4809tamp1.jpg"), ("micc_f220", "d/CRW_4809_scale.jpg"), ("micc_f220", "d/-x.jpg")], "s string, p string")
    got = named.select(fn.classify(F.col("s"), F.col("p")).alias("c"), fn.scene_of(F.col("s"), F.col("p")).alias("scene")).collect()
    assert [(r["c"]["label"], r["scene"]) for r in got] == [("manipulated", "micc_f220:CRW_4809"), ("authentic", "micc_f220:CRW_4809"), ("authentic", "micc_f220:-x.jpg")]
    (tmp_path / "sources.yaml").write_text("sources:\n- {name: a, kind: archive, license: mit, enabled: false}\n- {name: b, kind: hf_parquet, license: mit, classes: [x, 1], urls: [{url: 'http://x', sha256: '0'}]}\n")
    found = assets.load_sources(spark, str(tmp_path / "sources.yaml"))
    assert [r["name"] for r in assets.enabled_sources(found).collect()] == ["b"] and found.where("name = 'b'").first()["files"][0]["sha256"] == "0"
    spark.createDataFrame([(bytearray(b"1"), 0), (bytearray(b"2"), 1)], "image binary, label int").coalesce(1).write.parquet(str(tmp_path / "train.parquet"))
    assert sorted(r["path"] for r in assets.embedded_images(spark, str(tmp_path / "train.parquet")).collect()) == ["fake/train_000001.png", "real/train_000000.png"]


def test_report(spark):
    rng = random.Random(1)
    rows = [(f"k{i:03}", rng.choice(["authentic", "manipulated"]), "none") for i in range(120)]
    split = spark.createDataFrame(rows, "sha256 string, label string, manipulation string")
    scores = spark.createDataFrame([(k, min(0.99, max(0.01, (0.7 if label == "manipulated" else 0.3) + rng.gauss(0, 0.2)))) for k, label, _ in rows], "sha256 string, score double")
    answers = spark.createDataFrame([(k, True, label, 0.9, [], None, 1.0, 1, 1, 0.0) for k, label, _ in rows[:100]], schemas.VERDICT)
    summary = report.summarize(split, scores, split, scores, answers)
    text = report.render(summary)
    assert "| reasoner |" in text and report.outcome(summary["comparison"]) in text and "0.8333" in text
    assert report.outcome({"ci_low": -0.2, "ci_high": -0.1}) == "loses to" and report.outcome({"ci_low": -0.1, "ci_high": 0.1}) == "ties with"
    assert report.to_json({"a": float("nan")}) == '{\n  "a": null\n}\n'
    assert "absent" in report.render(report.summarize(split, scores, split, scores))


def separable(spark, n=400):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, (rng.normal(size=4) + (i % 2) * 2).tolist()) for i in range(n)]
    data = spark.createDataFrame(rows, "id int, y int, features array<double>")
    return rows, data.where("id < 300"), data.where("id >= 300")


def test_head_gradients():
    rng = np.random.default_rng(1)
    head, x, y = classifier.Head(5, [4, 3]), rng.normal(size=(9, 5)), rng.integers(0, 2, 9).astype(float)
    loss, g = head.gradient(x, y)
    p = 1 / (1 + np.exp(-head.logits(x)))
    assert loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    for k in range(len(head.flat)):
        around = []
        for step in (1e-6, -1e-6):
            head.flat[k] += step
            around.append(head.gradient(x, y)[0])
            head.flat[k] -= step
        assert (around[0] - around[1]) / 2e-6 == pytest.approx(g[k], abs=1e-6)


def test_classifier(spark, tmp_path):
    """Rates matter, training stops by patience on rows of its own, the best epoch wins, and a frozen head cannot change."""
    rows, train, val = separable(spark)
    head, history = classifier.sweep(train, val, rates=[1e-4, 1e-2], hidden=[8], epochs=25, patience=3, batch=32)
    by_rate = {r: [h for h in history if h["rate"] == r] for r in (1e-4, 1e-2)}
    assert by_rate[1e-4][0]["train_loss"] != by_rate[1e-2][0]["train_loss"] and by_rate[1e-2][-1]["train_loss"] < by_rate[1e-2][0]["train_loss"]
    for run in by_rate.values():
        f1 = [h["val_macro_f1"] for h in run]
        best = f1.index(max(f1))
        assert len(run) == min(25, best + 1 + 3)  # three epochs without a better one end it
    scored = classifier.score(head, val)
    top = max(h["val_macro_f1"] for h in history)
    assert metrics.basic_metrics(scored).first()["macro_f1"] == pytest.approx(top) and top > 0.85
    x = np.array([r[2] for r in rows[300:]])
    assert np.allclose([r["score"] for r in scored.orderBy("id").collect()], 1 / (1 + np.exp(-head.logits(x))))
    path = str(tmp_path / "head")
    digest = classifier.freeze(spark, head, path)
    assert np.array_equal(classifier.load_frozen(spark, path, digest).flat, head.flat)
    with pytest.raises(classifier.FrozenModelError):
        classifier.load_frozen(spark, path, "0")
    with pytest.raises(Exception, match="exists"):
        classifier.freeze(spark, head, path)


def test_training_in_one_partition_is_plain(spark):
    """One partition: the same as mini-batches of Adam in a loop."""
    rows, train, val = separable(spark)
    head, _ = classifier.sweep(train.coalesce(1), val, rates=[3e-3], hidden=[6], epochs=2, patience=9, batch=64, dropout=0.0)
    x, y = np.array([r[2] for r in rows[:300]]), np.array([r[1] for r in rows[:300]], dtype=float)
    plain, m, v, step, kept = classifier.Head(4, [6]), 0.0, 0.0, 0, []
    for epoch in range(2):
        order = np.random.default_rng([classifier.SEED, epoch, 0, 0]).permutation(300)
        for at in range(0, 300, 64):
            g, step = plain.gradient(x[order[at : at + 64]], y[order[at : at + 64]])[1], step + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            plain.flat = plain.flat - 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        kept.append(plain.flat)
    assert any(np.allclose(head.flat, k, atol=1e-12) for k in kept)


def jpeg_bytes(gray, quality, chroma=False, restart=0):
    """A sequential JPEG with flat code tables (every code has eight bits)."""
    from attestor.sources.jpeg import ZIGZAG

    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    table = np.clip((np.array(kernels.LUMINANCE) * scale + 50) // 100, 1, 255)
    h, w = gray.shape
    symbols = sorted({r << 4 | n for r in range(16) for n in range(11)})
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body
    counts = bytes([0] * 7 + [len(symbols)] + [0] * 8)
    codes = b"".join(bytes([number]) + counts + bytes(symbols) for number in (0, 16))
    parts = [(1, 0x22 if chroma else 0x11)] + ([(2, 0x11), (3, 0x11)] if chroma else [])
    out = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes(table[ZIGZAG].tolist())) + segment(0xC4, codes)
    out += segment(0xC0, bytes([8]) + h.to_bytes(2) + w.to_bytes(2) + bytes([len(parts)]) + b"".join(bytes([n, s, 0]) for n, s in parts))
    if restart:
        out += segment(0xDD, restart.to_bytes(2))
    out += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([n, 0]) for n, _ in parts) + bytes([0, 63, 0]))
    unit = 16 if chroma else 8
    full = np.pad(gray, ((0, -h % unit), (0, -w % unit)), mode="edge") - 128.0
    c, bits, data, before = kernels._cosines(), "", b"", {}

    def put(symbol, value, size):
        return f"{symbols.index(symbol):08b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    def block(values, name):
        size = lambda x: int(abs(x)).bit_length()
        step = int(values[0]) - before.get(name, 0)
        before[name] = int(values[0])
        text, run = put(size(step), step, size(step)), 0
        for x in values[ZIGZAG][1:].tolist():
            if x == 0:
                run += 1
                continue
            while run > 15:
                text += put(0xF0, 0, 0)
                run -= 16
            text += put(run << 4 | size(x), x, size(x))
            run = 0
        return text + (put(0, 0, 0) if run else "")

    close = lambda bits: np.packbits([int(b) for b in bits + "1" * (-len(bits) % 8)]).astype(np.uint8).tobytes().replace(b"\xff", b"\xff\x00")
    units, mark = [(y, x) for y in range(0, full.shape[0], unit) for x in range(0, full.shape[1], unit)], 0
    for k, (y, x) in enumerate(units):
        if restart and k and k % restart == 0:
            data += close(bits) + bytes([0xFF, 0xD0 + mark % 8])
            bits, before, mark = "", {}, mark + 1
        for dy in range(0, unit, 8):
            for dx in range(0, unit, 8):
                kept = np.rint(c @ full[y + dy : y + dy + 8, x + dx : x + dx + 8] @ c.T / table.reshape(8, 8)).astype(int)
                bits += block(kept.ravel(), 1)
        for name, _ in parts[1:]:
            bits += block(np.zeros(64, dtype=int), name)
    return out + data + close(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("shape", "chroma", "restart"), [((24, 16), False, 0), ((21, 35), True, 0), ((33, 18), False, 2), ((40, 40), True, 1)])
def test_jpeg(spark, shape, chroma, restart):
    from attestor.sources import jpeg

    image = picture(48, 2)[: shape[0], : shape[1]]
    for q in (30, 60, 95):
        content = jpeg_bytes(image, q, chroma, restart)
        unit = 16 if chroma else 8
        padded = np.pad(image, ((0, -shape[0] % unit), (0, -shape[1] % unit)), mode="edge")
        assert np.array_equal(assets.decode_gray(content), kernels.recompress(padded, q)[: shape[0], : shape[1]])
        assert jpeg.quality(content) == pytest.approx(q, abs=1.5)
    rows = spark.createDataFrame([(bytearray(content),), (bytearray(b"no image"),), (None,)], "content binary")
    found = [r[0] for r in rows.select(jpeg.quality_of("content")).collect()]
    assert found == [jpeg.quality(content), None, None] and math.isnan(jpeg.quality(b"no image"))
    with pytest.raises(ValueError, match="sequential"):
        assets.decode_gray(content.replace(b"\xff\xc0", b"\xff\xc2", 1))


def test_png_filters_and_gray_maxima():
    """All five filters, by the format's own formulas, byte by byte; gray maxima other than 255."""
    rng = np.random.default_rng(3)
    for step in (1, 3):
        above, line = (rng.integers(0, 256, (11, step)).astype(np.uint8) for _ in range(2))
        for kind in range(5):
            left = corner = [0] * step
            for x, row in enumerate(assets._unfilter(kind, line, above).tolist()):
                for k in range(step):
                    a, b, c = left[k], int(above[x, k]), corner[k]
                    p = a + b - c
                    paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    assert row[k] == (int(line[x, k]) + (0, a, b, (a + b) // 2, paeth)[kind]) % 256
                left, corner = row, above[x].tolist()
    assert assets.decode_gray(b"P5\n3 1\n15\n" + bytes([0, 5, 15])).tolist() == [[0, 85, 255]]


def test_fetch_and_verified_files(tmp_path, monkeypatch):
    import hashlib
    import io

    (tmp_path / "a.bin").write_bytes(b"abc")
    url, digest, folder = f"file://{tmp_path}/a.bin", hashlib.sha256(b"abc").hexdigest(), tmp_path / "to"
    folder.mkdir()
    path = assets.ensure_file(url, digest, str(folder))
    monkeypatch.setattr(assets, "fetch", lambda *_: pytest.fail("fetched again"))
    assert assets.ensure_file(url, digest, str(folder)) == path and (folder / "a.bin.verified").read_text() == digest
    with pytest.raises(assets.ChecksumMismatchError):
        assets.ensure_file(url, "0" * 64, str(folder))
    assert not (folder / "a.bin").exists()
    monkeypatch.undo()

    class Short(io.BytesIO):
        headers = {"Content-Length": "9"}

    monkeypatch.setattr(assets.urllib.request, "urlopen", lambda _: Short(b"abc"))
    with pytest.raises(assets.TruncatedDownloadError):
        assets.fetch("http://x/b.bin", str(folder / "b.bin"))
    assert sorted(p.name for p in folder.iterdir()) == ["a.bin.verified"]


def test_only_the_harness_reads_the_test_split():
    """Static scan: nothing else makes a token or asks for the test split."""
    from pathlib import Path

    package = Path(assets.__file__).parents[1]
    for path in package.rglob("*.py"):
        text = path.read_text()
        if path.name not in ("harness.py", "store.py"):
            assert "HarnessToken" not in text and not re.search(r"load_split\([^)]*[\"']test[\"']", text), path


def test_last_answers_are_one_a_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "x"), ("b", 1, "x")], "sha256 string, n int, label string")
    assert sorted(map(tuple, verdicts.last_answers(rows, "n").collect())) == [("a", 2, "z"), ("b", 1, "x")]


def test_stages_from_files(spark, tmp_path):
    import json

    from attestor.plans import stages

    root = tmp_path / "raw"
    for source, names in (("micc_f220", ["CRW_4809_scale.png", "CRW_4809tamp1.png", "DSC_1_a.png"]), ("cifake", ["real/img_1.png", "fake/img_2.png", "fake/img_3.png"])):
        for i, name in enumerate(names):
            (root / source / name).parent.mkdir(parents=True, exist_ok=True)
            (root / source / name).write_bytes(png(picture(24, len(source) * 10 + min(i, 1 if source == "cifake" else 9)).astype(np.uint8)))
        (root / source / "source_record.json").write_text(json.dumps({"source": source, "license": "mit"}))
    out = str(tmp_path / "manifest")
    done = stages.build_manifest(spark, str(root), out)
    assert done["input"] == 6 and done["exact_removed"] == 1 and done["output"] == 5 and done["by_source"] == {"cifake": 2, "micc_f220": 3}
    assert stages.build_manifest(spark, str(root), out) is None and stages.build_manifest(spark, str(root), out, force=True) == done
    manifest = spark.read.parquet(out)
    assert manifest.columns == schemas.MANIFEST.names and manifest.where("width = 24 AND length(phash) = 16").count() == 5
    parts = str(tmp_path / "splits")
    summary = stages.build_splits(spark, out, parts)
    assert sum(summary["counts"].values()) == 5 and stages.verify_splits(spark, out, parts) and stages.build_splits(spark, out, parts) is None
    signals = str(tmp_path / "signals")
    assert set(stages.build_signals(spark, str(root), out, signals).values()) == {5}
    assert store.load_features(spark, signals).count() == 5 * 134
    assert set(stages.build_signals(spark, str(root), out, signals).values()) == {0}


def test_phash_moves_little_with_the_image():
    from attestor.plans.stages import image_phash

    a = picture(64, 5)
    b = a.copy()
    b[3, 4] += 9
    far = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    assert far(image_phash(a), image_phash(b)) <= 4 < far(image_phash(a), image_phash(picture(64, 6)))


def test_the_optional_subpackage_is_not_needed():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "attestor"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"\bllm\b", file.read_text()), file


def test_driver_keeps_few_threads_for_exchanges():
    code = """
from attestor.session import build_session
spark = build_session(master="local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
for _ in range(20):
    spark.range(50).groupBy("id").count().count()
print("waiting", sum(t.getName().startswith("shuffle-exchange") for t in spark._jvm.java.lang.Thread.getAllStackTraces().keySet()))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=session.ROOT).stdout
    assert 0 < int(said.rpartition("waiting")[2]) <= 16
