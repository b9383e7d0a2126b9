"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, D, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

SOURCE_FILE = _struct(url=S, sha256=S)
SOURCE = _struct(name=S, kind=S, license=S, classes=T.ArrayType(S), enabled=B, files=T.ArrayType(SOURCE_FILE), notes=S)
SOURCE_RECORD = _struct(source=S, license=S, classes=T.ArrayType(S), files=T.ArrayType(SOURCE_FILE), extracted_files=L, notes=S)
MANIFEST = _struct(sha256=S, source=S, license=S, label=S, manipulation=S, scene=S, width=I, height=I, phash=S, path=S)
SPLIT_SUMMARY = _struct(seed=L, counts=T.MapType(S, L), type_shares=T.MapType(S, T.MapType(S, D)), test_sha256=S)
SIGNAL = _struct(sha256=S, signal=S, region=S, value=D, direction=S, extractor=S, version=S)
EMBEDDING = _struct(sha256=S, embedding=T.ArrayType(T.FloatType()))
SCALER = _struct(mean=T.ArrayType(D), std=T.ArrayType(D))
PREDICTION = _struct(sha256=S, score=D)
EVIDENCE = _struct(signal=S, region=S, direction=S)
VERDICT = _struct(
    sha256=S, ok=B, label=S, confidence=D, evidence=T.ArrayType(EVIDENCE), failure=S, grounding_rate=D, input_tokens=L, output_tokens=L, cost_usd=D,
)
PARSED = _struct(label=S, confidence=D, evidence=T.ArrayType(EVIDENCE), failure=S, detail=S)
METRIC = _struct(value=D, ci_low=D, ci_high=D)
CALIBRATION_BIN = _struct(bin_low=D, bin_high=D, count=L, confidence=D, accuracy=D)
FRAME_VERDICT = _struct(clip=S, frame_index=L, ok=B, label=S, confidence=D, cited=T.ArrayType(_struct(signal=S, region=S)))
CLIP_VERDICT = _struct(clip=S, label=S, confidence=D, flip_rate=D, signal_drift=D, parsed_frames=L, failed_frames=L)
BATCH_REPORT = _struct(split=S, total=L, skipped=L, calls=L, parse_failures=L, cost_usd=D, input_tokens=L, output_tokens=L)

#: The regions of the 3 x 3 grid and the directions of suspicion.
REGIONS = ["r0c0", "r0c1", "r0c2", "r1c0", "r1c1", "r1c2", "r2c0", "r2c1", "r2c2"]
GLOBAL = "global"
HIGHER, LOWER, CONTEXT = "higher_is_suspicious", "lower_is_suspicious", "context"
