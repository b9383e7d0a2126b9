"""What the operators of this subpackage share: session set-up, table reading, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import prepare as prepare_session

#: Rows and bytes that a Python worker gets at once, at most: whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Files whose numbers are broadcast, at most; more are joined by a shuffle.
BROADCAST_FILES = 20_000


def prepare(spark: SparkSession) -> SparkSession:
    """The engine's settings for workers and checkpoints, and batches of bounded size."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    return prepare_session(spark)


def give_back() -> None:
    """What this process has freed goes back to the system: glibc keeps it otherwise, and a driver lives on."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with one more column: a number of each row, the same in every later reading.

    Splits of files depend on how many executors there are when a plan is made, so numbers by
    partition may change between two readings. A row of a table of files is numbered by its file (in
    the order of the paths) and its place there, ``file << 33 | place``; the files' paths, which the
    driver's listing holds anyway, are counted on the driver. Any other frame is numbered once and
    written by checkpoint().
    """
    spark, own = prepare(docs.sparkSession), [F.col(f"`{c}`") for c in docs.columns]
    path, place = unused(docs, "__file_path"), unused(docs, "__file_place")
    try:
        if unused(docs, "_metadata") != "_metadata":
            raise AnalysisException("a column hides the files' metadata")
        placed = docs.select(*own, F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return docs.select(*own, F.monotonically_increasing_id().alias(name)).checkpoint()
    paths = sorted(r[0] for r in placed.select(path).distinct().collect())
    number = unused(docs, "__file_number")
    files = spark.createDataFrame(list(enumerate(paths)), f"{number} long, {path} string")
    joined = placed.join(F.broadcast(files) if len(paths) <= BROADCAST_FILES else files, path)
    return joined.select(*own, (F.shiftleft(number, 33) + F.col(place)).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of(df: DataFrame) -> int:
    """Bytes of a frame as the optimizer knows them: of a table the size of its files; 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() of a result that is small beside its input, in an eighth as many files as shuffles have partitions."""
    return df.coalesce(max(1, partitions(df.sparkSession) // 8)).checkpoint()


def fold(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo modulus (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
