"""Session defaults of the engine."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Environment of the Python workers: their allocators give freed memory back, since a worker lives from task to task.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_MMAP_THRESHOLD_": str(4 << 20)}

#: Threads of the driver that wait for exchanges and results. Spark starts one for each exchange, up to 1024, and every one holds some hundred KB for a minute.
THREADS = {"spark.sql.shuffleExchange.maxThreadThreshold": "16", "spark.sql.resultQueryStage.maxThreadThreshold": "16"}


def build_session(app: str = "attestor", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers can import the package; the driver's pools are bounded; the checkpoint folder is the one that the cluster names.

    Only a local session without ``spark.checkpoint.dir`` (a test, a laptop) gets a folder of its own;
    on a cluster, whose machines share no temporary folder, its absence is an error.
    """
    sc = spark.sparkContext
    for name, value in WORKERS.items():
        sc.environment.setdefault(name, os.environ.get(name, value))
    named, conf = sc.getConf(), spark._jsparkSession.sessionState().conf()
    for name, value in THREADS.items():  # static settings, but a pool is made at the first exchange, by the session's settings
        if not named.contains(name) and conf.getConfString(name) != value:
            conf.setConfString(name, value)
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    if sc.getCheckpointDir() is None:
        folder = named.get("spark.checkpoint.dir")
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="attestor-checkpoint-"))
    return spark
