"""Prompts: an asset's measurements as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.scalars import family, four_decimals, token_estimate

#: The texts before, between and after the measurements.
HEADER = "FORENSIC MEASUREMENTS\n\n"
TASK = "\n\nTASK\n\n"
INSTRUCTION = """\
You are a forensic image analyst. Decide whether the image is authentic or
manipulated, using the image itself and the measurements above. Measurements
are named signals over a 3x3 region grid (r0c0 top-left through r2c2
bottom-right) plus global; each carries its direction of suspicion.

Answer with exactly one JSON object and nothing else:

{"label": "authentic" or "manipulated",
 "confidence": a number between 0.0 and 1.0,
 "evidence": [{"signal": "<signal name from the measurements>",
               "region": "<its region>",
               "direction": "supports_manipulated" or "supports_authentic"}]}

Cite only signals and regions that appear in the measurements. Any cited
signal that does not appear above invalidates the whole answer."""


def measurement_line(signal: Column, region: Column, value: Column, direction: Column) -> Column:
    return F.concat(F.lit("  "), signal, F.lit(" ["), region, F.lit("] = "), four_decimals(value), F.lit(" ("), direction, F.lit(")"))


def render_measurements(store: DataFrame) -> DataFrame:
    """(sha256, measurements): families by title, their lines by signal and region."""
    lines = store.select("sha256", family(F.col("signal")).alias("family"), "signal", "region", measurement_line(*map(F.col, ("signal", "region", "value", "direction"))).alias("line"))
    # an asset has some hundreds of measurements at most
    blocks = lines.groupBy("sha256", "family").agg(F.array_sort(F.collect_list(F.struct("signal", "region", "line"))).alias("rows"))
    text = F.concat("family", F.lit(":\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    whole = blocks.select("sha256", F.struct("family", text.alias("text")).alias("block")).groupBy("sha256").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    return whole.select("sha256", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("measurements"))


def build_prompts(store: DataFrame) -> DataFrame:
    """(sha256, prompt, tokens): assets without measurements have no row, and so no prompt."""
    prompt = F.concat(F.lit(HEADER), "measurements", F.lit(TASK), F.lit(INSTRUCTION))
    return render_measurements(store).select("sha256", prompt.alias("prompt")).withColumn("tokens", token_estimate(F.col("prompt")))
