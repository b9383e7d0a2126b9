"""Model verdicts: strict parse, grounding, tracks, cost, batch runs with resume."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import schemas
from attestor.functions.scalars import verdict_score
from attestor.operators.prompt import build_prompts
from attestor.operators.ranking import global_row_number
from attestor.session import prepare

#: Failure labels in the order of the checks, keys and directions of a verdict.
FAILURES = ["not_json", "schema_violation", "label_invalid", "confidence_out_of_range", "evidence_malformed", "ungrounded_evidence"]
KEYS, EVIDENCE_KEYS = {"label", "confidence", "evidence"}, {"signal", "region", "direction"}
LABELS, DIRECTIONS = ("authentic", "manipulated"), ("supports_manipulated", "supports_authentic")
_FENCED = re.compile(r"```(?:json)?\s*\n(?P<body>.*?)\n\s*```", re.DOTALL)


def _fault(value: object) -> tuple[int, str] | None:
    """(index of the failed check, detail) of a decoded verdict; None if it is sound."""
    if not isinstance(value, dict) or value.keys() != KEYS:
        return 1, f"keys: {sorted(value) if isinstance(value, dict) else type(value).__name__}"
    if value["label"] not in LABELS:
        return 2, repr(value["label"])
    number = value["confidence"]
    if isinstance(number, bool) or not isinstance(number, (int, float)) or not 0 <= number <= 1:
        return 3, repr(number)
    if not isinstance(value["evidence"], list):
        return 4, type(value["evidence"]).__name__
    for cited in value["evidence"]:
        sound = isinstance(cited, dict) and cited.keys() == EVIDENCE_KEYS and all(isinstance(x, str) for x in cited.values())
        if not sound or cited["direction"] not in DIRECTIONS:
            return 4, repr(cited)
    return None


def parse_reply(raw: str | None) -> dict:
    """Strict parse of one reply: label, confidence, evidence, or failure and detail."""
    text = (raw or "").strip()
    if whole := _FENCED.fullmatch(text):
        text = whole["body"].strip()
    none = {"label": None, "confidence": None, "evidence": [], "failure": None, "detail": ""}
    try:
        value = json.loads(text)
        fault = _fault(value)
    except (json.JSONDecodeError, RecursionError) as error:
        return none | {"failure": FAILURES[0], "detail": str(error)}
    if fault:
        return none | {"failure": FAILURES[fault[0]], "detail": fault[1]}
    return none | {"label": value["label"], "confidence": float(value["confidence"]), "evidence": [{k: e[k] for k in ("signal", "region", "direction")} for e in value["evidence"]]}


@F.pandas_udf(schemas.PARSED)
def parse_verdict(replies: pd.Series) -> pd.DataFrame:
    """struct(label, confidence, evidence, failure, detail); built-in JSON functions are not strict enough."""
    return pd.DataFrame([parse_reply(r) for r in replies], columns=schemas.PARSED.names)


def ground(parsed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Verdicts (sha256, parsed) against the signals (sha256, signal, region) that an asset has.

    One citation without its measurement fails the whole verdict. The rate is the share of grounded
    citations of the parsed verdict, 0 without any. Citations join the vocabulary on all three keys.
    """
    cited = parsed.select("sha256", F.posexplode("parsed.evidence").alias("k", "e")).select("sha256", "k", "e.signal", "e.region")
    known = vocabulary.select("sha256", "signal", "region").distinct().withColumn("known", F.lit(True))
    checked = cited.join(known, ["sha256", "signal", "region"], "left").groupBy("sha256").agg(
        F.count("*").alias("cited"), F.count("known").alias("grounded"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("k", "signal", "region")))), lambda m: F.concat(m["signal"], F.lit("["), m["region"], F.lit("]"))), ", ").alias("missing"),
    )
    out = parsed.join(checked, "sha256", "left")
    ungrounded = F.coalesce(F.col("missing") != "", F.lit(False))
    ok = F.col("parsed.failure").isNull() & ~ungrounded
    return out.select(
        "sha256", ok.alias("ok"), F.when(ok, F.col("parsed.label")).alias("label"), F.when(ok, F.col("parsed.confidence")).alias("confidence"),
        F.when(ok, F.col("parsed.evidence")).otherwise(F.array().cast(schemas.VERDICT["evidence"].dataType)).alias("evidence"),
        F.when(ungrounded, FAILURES[5]).otherwise(F.col("parsed.failure")).alias("failure"), F.when(ungrounded, F.col("missing")).otherwise(F.col("parsed.detail")).alias("detail"),
        F.coalesce(F.col("grounded") / F.col("cited"), F.lit(0.0)).alias("grounding_rate"),
    )


def price(model: Column, input_tokens: Column, output_tokens: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """US dollars by a table of (input, output) prices a million tokens; unknown models cost nothing."""
    per = F.lit(0.0)
    for name, (a, b) in prices.items():
        per = F.when(model == name, (input_tokens * a + output_tokens * b) / 1e6).otherwise(per)
    return per


def last_answers(verdicts: DataFrame, sequence: str) -> DataFrame:
    """Of each asset the answer with the highest sequence number; of several with that number the one with the largest fields, once."""
    rest = [c for c in verdicts.columns if c not in ("sha256", sequence)]
    newest = verdicts.groupBy("sha256").agg(F.max(F.struct(sequence, *rest)).alias("last"))
    return newest.select(*[F.col("sha256") if c == "sha256" else F.col(f"last.{c}") for c in verdicts.columns])


def verdict_track(order: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, y, pred, score, failed, failure) of the assets in ``order`` (sha256, y); absent verdicts fail as missing."""
    joined = order.join(verdicts.select("sha256", "ok", "label", "confidence", "failure", F.lit(True).alias("present")), "sha256", "left")
    failed = ~F.coalesce("ok", F.lit(False))
    return joined.select(
        F.col("sha256").alias("id"), "y", F.when(~failed, (F.col("label") == "manipulated").cast("int")).otherwise(-1).alias("pred"),
        F.when(~failed, verdict_score(F.col("label"), F.col("confidence"))).otherwise(0.5).alias("score"), failed.alias("failed"), F.when(F.col("present").isNull(), "missing").when(failed, F.col("failure")).alias("failure"),
    )


def prediction_track(order: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, y, pred, score) of stored scores; a missing score raises."""
    joined = order.join(predictions, "sha256", "left")
    score = F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col("sha256")))).otherwise(F.col("score"))
    return joined.select(F.col("sha256").alias("id"), "y", (score > 0.5).cast("int").alias("pred"), score.alias("score"))


def mean_grounding(verdicts: DataFrame) -> DataFrame:
    """Mean over all verdict lines; failures and verdicts without citations count as 0."""
    return verdicts.agg(F.avg(F.coalesce("grounding_rate", F.lit(0.0))).alias("grounding_rate_mean"))


@dataclass
class Reply:
    text: str
    input_tokens: int = 10
    output_tokens: int = 5


class ScriptedBackend:
    """Replies from a list; the last one repeats."""

    def __init__(self, replies: list[str]):
        self.replies, self.at = replies, 0

    def generate(self, sha256: str, prompt: str) -> Reply:
        text = self.replies[min(self.at, len(self.replies) - 1)]
        self.at += 1
        return Reply(text)


def call_with_retries(call: Callable[[], Reply], attempts: int = 4, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """The call's result; failures wait 2, 4, 8 s, and the last one is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(delay * 2**attempt)
    raise AssertionError


def reason(assets: DataFrame, store: DataFrame, make_backend: Callable[[], object], model: str, prices: dict[str, tuple[float, float]], attempts: int = 4) -> DataFrame:
    """Verdict records of assets (sha256): prompts from the store, one call each, strict parse, grounding.

    The store is read once for all assets. ``make_backend`` makes a backend in each task.
    """
    prepare(assets.sparkSession)
    mine = store.join(assets.select("sha256"), "sha256", "left_semi")
    prompts = assets.select("sha256").join(build_prompts(mine), "sha256", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for batch in batches:
            rows = []
            for sha, prompt in zip(batch["sha256"], batch["prompt"], strict=True):
                if prompt is None:
                    raise ValueError(f"no measurements for {sha}")
                reply = call_with_retries(lambda sha=sha, prompt=prompt: backend.generate(sha, prompt), attempts)
                rows.append((sha, reply.text, reply.input_tokens, reply.output_tokens))
            yield pd.DataFrame(rows, columns=["sha256", "reply", "input_tokens", "output_tokens"])

    # one call for each asset, whatever is later computed from the replies
    replies = prompts.select("sha256", "prompt").mapInPandas(run, "sha256 string, reply string, input_tokens long, output_tokens long").checkpoint()
    grounded = ground(replies.select("sha256", parse_verdict("reply").alias("parsed")), mine)
    cost = price(F.lit(model), F.col("input_tokens"), F.col("output_tokens"), prices)
    return grounded.join(replies.drop("reply"), "sha256").withColumn("cost_usd", cost).select(*schemas.VERDICT.names)


def run_batch(split: str, frame: DataFrame, store: DataFrame, out: str, make_backend: Callable[[], object], model: str = "", prices: dict | None = None, limit: int | None = None, flush: int = 1000) -> DataFrame:
    """Answer what ``out`` (a folder of JSON lines) does not answer yet, append, and report one row.

    Answers are appended after every ``flush`` assets, in the order of sha256: a failure loses what is
    not appended yet, and the next run goes on from there. ``limit`` takes the first assets by sha256; 0
    or None takes all.
    """
    spark = frame.sparkSession
    assets = frame.select("sha256").orderBy("sha256").limit(limit) if limit else frame.select("sha256")
    done = read_verdicts(spark, out).select("sha256").distinct().checkpoint()
    todo = global_row_number(assets.join(done, "sha256", "left_anti"), "sha256").checkpoint()
    sums = ["calls", "parse_failures", "cost_usd", "input_tokens", "output_tokens"]
    spent = dict.fromkeys(sums, 0)
    for first in range(0, todo.count(), flush):
        new = reason(todo.where(F.col("rn").between(first + 1, first + flush)).select("sha256"), store, make_backend, model, prices or {}).checkpoint()
        new.write.mode("append").json(out)
        row = new.agg(F.count("*").alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("parse_failures"), *[F.sum(c).alias(c) for c in sums[2:]]).first()
        spent = {c: spent[c] + (row[c] or 0) for c in sums}
    types = {f.name: f.dataType for f in schemas.BATCH_REPORT.fields}
    known = {"split": split, "total": assets.count(), "skipped": done.count(), **spent}
    return spark.range(1).select(*[F.lit(known[c]).cast(types[c]).alias(c) for c in schemas.BATCH_REPORT.names])


def read_verdicts(spark, path: str) -> DataFrame:
    """Verdict records of a folder of JSON lines; blank lines and a missing folder give nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schemas.VERDICT)
    return spark.read.schema(schemas.VERDICT).json(path)


def cost_report(verdicts: DataFrame, *by: str) -> DataFrame:
    return verdicts.groupBy(*by).agg(F.count("*").alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("parse_failures"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


