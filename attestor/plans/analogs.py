"""The engine's relations over the driver's text tables: each concept of the data model has an analog.

An asset is a document, its bytes the text; quality 0 stands for manipulated; an embedding is an
8 x 8 image; a conversation is a clip, its turns the frames; scores and replies derive from ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.scalars import text_phash
from attestor.schemas import REGIONS
from attestor.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _assets(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """One row a document with its label and scene; docs has sha256, and what else is named is kept."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    return docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").select(
        "doc_id", *more, "sha256", "source", "lang", "n_chars", F.when(bad, "manipulated").otherwise("authentic").alias("label"),
        F.when(bad & (F.col("toxic") == 1), "ai_generated").when(bad, "copy_move").otherwise("none").alias("manipulation"),
        F.concat("source", F.lit(":"), "lang", F.lit(":"), (F.col("doc_id") % 7).cast("string")).alias("scene"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("sha256", F.sha2("text", 256))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, without its hash."""
    return _assets(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), "text")


def hashed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets with their perceptual hash, without their texts: both hashes are taken where texts are read, so that no join deals out texts."""
    docs = _documents(spark, sf_dir).withColumn("phash", text_phash("text")).drop("text")
    rows = _assets(docs, table(spark, sf_dir, "labels"), "phash")
    return rows.select(*[c for c in rows.columns if c != "phash"], "phash")


def unique_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first asset of each text; written once, since graph operators read it several times."""
    from attestor.operators.dedupe import exact_dedupe

    rows = hashed_assets(spark, sf_dir)
    return exact_dedupe(rows, "doc_id").where("fate = 'kept'").drop("fate").checkpoint()


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def predictions(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """(id, y, pred, score, manipulation, source): scores in steps of 0.01, so that many tie."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    y = (F.col("quality") == 0).cast("int")
    r = _hex(F.concat(F.lit(salt), F.col("doc_id").cast("string")), 6) % 1000
    score = F.floor((y * 350 + F.floor(r * 65 / 100)) / 10) * 10 / 1000
    kind = F.when((y == 1) & (F.col("toxic") == 1), "ai_generated").when(y == 1, "copy_move").otherwise("none")
    rows = labels.join(sources, "doc_id").select(F.col("doc_id").alias("id"), y.alias("y"), score.alias("score"), kind.alias("manipulation"), "source")
    return rows.withColumn("pred", (F.col("score") > 0.5).cast("int"))


#: (signal, direction) of the analog store, one region an asset.
SIGNALS = [
    ("blocking_grid_strength", "context"), ("edge_density", "context"), ("jpeg_ghost_depth", "higher_is_suspicious"), ("lighting_direction_deg", "context"), ("noise_region_mismatch", "higher_is_suspicious"), ("pilot_energy", "context"),
]


def region_of(doc_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, REGIONS)), (doc_id % 9 + 1).cast("int"))


def signal_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha256 = document number as text, signal, region, value, direction) of every document."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("signal"), F.lit(d).alias("direction")) for k, (s, d) in enumerate(SIGNALS)]))
    rows = table(spark, sf_dir, "documents").select("doc_id", each.alias("s"))
    value = (F.col("doc_id") * 7919 + F.col("s.k") * 104729) % 10007 / 10007
    return rows.select(F.col("doc_id").cast("string").alias("sha256"), "s.signal", region_of(F.col("doc_id")).alias("region"), value.alias("value"), "s.direction")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha256, reply): sound replies and every way to fail, by document number modulo 12."""
    r = region_of(F.col("doc_id"))
    cite = lambda signal, direction="supports_manipulated": F.concat(F.lit(f'{{"signal": "{signal}", "region": "'), r, F.lit(f'", "direction": "{direction}"}}'))
    body = lambda evidence, label='"manipulated"', confidence="0.75": F.concat(F.lit(f'{{"label": {label}, "confidence": {confidence}, "evidence": ['), *evidence, F.lit("]}"))
    two = [cite("edge_density"), F.lit(", "), cite("jpeg_ghost_depth", "supports_authentic")]
    cases = [
        body(two), body([], '"authentic"', "0.9"), F.concat(F.lit("```json\n"), body([cite("jpeg_ghost_depth")], confidence="1"), F.lit("\n```")), F.lit("The image looks authentic."),
        F.lit("[1, 2]"), F.lit('{"label": "authentic", "confidence": 0.5}'), body([], '"fake"'), body([], confidence="1.5"), body([], confidence='"0.5"'),
        F.lit('{"label": "authentic", "confidence": 0.5, "evidence": "none"}'), body([cite("edge_density", "unsure")]), body([cite("edge_density"), F.lit(", "), cite("invented_signal")]),
    ]
    reply = F.lit(None).cast("string")
    for k, case in enumerate(cases):
        reply = F.when(F.col("doc_id") % 12 == k, case).otherwise(reply)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sha256"), reply.alias("reply"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame verdicts: conversations' turns, with labels, confidences and citations by digest."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    h = _hex(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 7)
    label = F.when(h % 5 == 0, F.lit(None).cast("string")).when(h % 3 == 0, "manipulated").otherwise("authentic")
    cited = F.array_distinct(F.array(F.concat(F.lit("s"), (h % 4).cast("string")), F.concat(F.lit("s"), (F.floor(h / 4) % 4).cast("string"))))
    return rows.select(F.col("conv_id").alias("clip"), F.col("turn").alias("frame_index"), (h % 7 != 0).alias("ok"), label.alias("label"), (F.floor(h / 16) % 100 / 100).alias("confidence"), F.when(h % 11 == 0, F.array().cast("array<string>")).otherwise(cited).alias("cited"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images (the first 64 components; 0..255)."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64)
    pixels = F.transform(F.slice("embedding", 1, 64), lambda x: (x.cast("double") + 1) * 127.5)
    return rows.select(F.col("vec_id").cast("string").alias("sha256"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))


# The same relations for DuckDB, as common table expressions.
A = """a AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS sha256, source, lang, n_chars,
    CASE WHEN quality = 0 THEN 'manipulated' ELSE 'authentic' END AS label,
    CASE WHEN quality = 0 AND toxic = 1 THEN 'ai_generated' WHEN quality = 0 THEN 'copy_move' ELSE 'none' END AS manipulation,
    source || ':' || lang || ':' || (doc_id % 7) AS scene
  FROM documents LEFT JOIN (SELECT doc_id, quality, toxic FROM labels) USING (doc_id))"""
H = """w AS (SELECT sha256, unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) AS w FROM (SELECT DISTINCT sha256, text FROM a)),
t AS (SELECT sha256, ('0x' || md5(w)[1:16])::UBIGINT AS h, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
v AS (SELECT sha256, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS v FROM t, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY ALL),
x AS (SELECT sha256, sum(CASE WHEN v > 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END)::UBIGINT AS h FROM v GROUP BY sha256),
h AS (SELECT a.*, coalesce(x.h, 0::UBIGINT) AS h, format('{:016x}', coalesce(x.h, 0::UBIGINT)) AS phash FROM a LEFT JOIN x USING (sha256))"""
U = "u AS (SELECT * FROM h WHERE doc_id IN (SELECT min(doc_id) FROM a GROUP BY sha256 HAVING count(DISTINCT label) = 1))"
E2 = "e AS (SELECT p.sha256 AS a, q.sha256 AS b, p.label AS la, q.label AS lb, p.scene AS sa, q.scene AS sb FROM u p JOIN u q ON p.sha256 < q.sha256 AND bit_count(xor(p.h, q.h)) <= 4)"


def _score_sql(salt: str = "") -> str:
    r = f"(('0x' || md5('{salt}' || doc_id)[1:6])::BIGINT % 1000)"
    return f"((CASE quality WHEN 0 THEN 350 ELSE 0 END) + {r} * 65 // 100) // 10 * 10 / 1000.0::DOUBLE"


def p_sql(salt: str = "", name: str = "p") -> str:
    return f"""{name} AS (SELECT doc_id AS id, CASE quality WHEN 0 THEN 1 ELSE 0 END AS y, {_score_sql(salt)} AS score, CASE WHEN {_score_sql(salt)} > 0.5 THEN 1 ELSE 0 END AS pred,
  CASE WHEN quality = 0 AND toxic = 1 THEN 'ai_generated' WHEN quality = 0 THEN 'copy_move' ELSE 'none' END AS manipulation, source
  FROM labels JOIN (SELECT doc_id, source FROM documents) USING (doc_id))"""


_REGION = "(" + repr(REGIONS) + ")[doc_id % 9 + 1]"
S = "s AS (SELECT doc_id::VARCHAR AS sha256, z.s AS signal, " + _REGION + " AS region, (doc_id * 7919 + z.k * 104729) % 10007 / 10007::DOUBLE AS value, z.d AS direction FROM documents, (VALUES " + ", ".join(f"({k}, '{s}', '{d}')" for k, (s, d) in enumerate(SIGNALS)) + ") z(k, s, d))"


def _replies_sql() -> str:
    cite = lambda s, d="supports_manipulated": f"""'{{"signal": "{s}", "region": "' || {_REGION} || '", "direction": "{d}"}}'"""
    body = lambda evidence, label='"manipulated"', confidence="0.75": f"""'{{"label": {label}, "confidence": {confidence}, "evidence": [' || {evidence or "''"} || ']}}'"""
    cases = [
        body(f"{cite('edge_density')} || ', ' || {cite('jpeg_ghost_depth', 'supports_authentic')}"), body("", '"authentic"', "0.9"), f"'```json' || chr(10) || {body(cite('jpeg_ghost_depth'), confidence='1')} || chr(10) || '```'",
        "'The image looks authentic.'", "'[1, 2]'", """'{"label": "authentic", "confidence": 0.5}'""", body("", '"fake"'), body("", confidence="1.5"), body("", confidence='"0.5"'),
        """'{"label": "authentic", "confidence": 0.5, "evidence": "none"}'""", body(cite("edge_density", "unsure")), body(f"{cite('edge_density')} || ', ' || {cite('invented_signal')}"),
    ]
    return "r AS (SELECT doc_id::VARCHAR AS sha256, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END AS reply FROM documents)"


R = _replies_sql()
PARSED = r"""j AS (SELECT sha256, trim(reply) AS t FROM r),
k AS (SELECT sha256, CASE WHEN regexp_full_match(t, '```(json)?\s*\n(.*)\n\s*```', 's') THEN regexp_extract(t, '```(?:json)?\s*\n(.*)\n\s*```', 1, 's') ELSE t END AS t FROM j),
o AS (SELECT sha256, CASE WHEN json_valid(t) THEN t::JSON END AS t FROM k),
q AS (SELECT sha256, t, CASE
  WHEN t IS NULL THEN 'not_json'
  WHEN json_type(t) <> 'OBJECT' OR list_sort(json_keys(t)) <> ['confidence', 'evidence', 'label'] THEN 'schema_violation'
  WHEN t->>'$.label' NOT IN ('authentic', 'manipulated') THEN 'label_invalid'
  WHEN json_type(t->'$.confidence') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') OR (t->>'$.confidence')::DOUBLE NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range'
  WHEN json_type(t->'$.evidence') <> 'ARRAY' OR len(list_filter(from_json(t->'$.evidence', '["JSON"]'), lambda e: e->>'$.direction' NOT IN ('supports_manipulated', 'supports_authentic'))) > 0 THEN 'evidence_malformed'
  END AS failure FROM o)"""
F_SQL = """f AS (SELECT conv_id AS clip, turn AS frame_index, h % 7 <> 0 AS ok, CASE WHEN h % 5 = 0 THEN NULL WHEN h % 3 = 0 THEN 'manipulated' ELSE 'authentic' END AS label,
  (h // 16) % 100 / 100.0::DOUBLE AS confidence, CASE WHEN h % 11 = 0 THEN [] ELSE list_distinct(['s' || (h % 4), 's' || (h // 4 % 4)]) END AS cited
  FROM (SELECT conv_id, turn, ('0x' || md5(conv_id || ':' || turn)[1:7])::BIGINT AS h FROM conversations))"""
C_SQL = "c AS (SELECT vec_id::VARCHAR AS sha256, i // 8 AS y, i % 8 AS x, (embedding[i + 1]::DOUBLE + 1) * 127.5 / 255.0 AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) >= 64))"
