"""Session helpers of the corpus operators: checkpoints, text keys, column checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them, as a Java regular expression.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Frees the shuffle files of a statement when it ends; what it wrote is complete by then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This session's folder where the whole cluster reads and writes, removed when Python exits.

    It lies in ``spark.checkpoint.dir``; only where that is unset and everything
    runs on one machine, as in tests, a temporary folder takes its place. A cluster
    without that setting is an error: its executors share no other folder.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        top = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not top and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = top or tempfile.mkdtemp(prefix="checkpoints-")
        _folders[app] = f"{top.rstrip('/')}/tables-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def clear(spark: SparkSession) -> None:
    """Removes this session's intermediate tables; for callers who have read their results and go on."""
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        _remove(spark, folder)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``checkpoint`` made and that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._table_path)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read back.

    Compressed and columnar, so smaller than a checkpoint of rows, and whatever
    reads it needs no executor that helped to write it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


#: For rows that are whole texts: bytes of a batch that goes to Python (64 MB otherwise), and rows read from Parquet at a time (4,096 otherwise).
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def small_batches(spark: SparkSession) -> None:
    """From now on this session takes whole texts in batches of a few MB; what the caller has set stays.

    It stays set, as plans that operators return are run later. All rows pass as before.
    """
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def few_keys(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The rows whose key's hash is among the smallest, about ``2 * size`` different keys or all of them.

    A filter by a threshold: nothing is ranked or gathered, and all rows of a key
    stay or go together. Rows without a key go.
    """
    rows = rows.filter(F.col(key).isNotNull())
    n = rows.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    return rows if n <= 2 * size else rows.filter(F.shiftrightunsigned(F.xxhash64(key), 1) / F.lit(2.0**63) <= 2 * size / n)


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text: rows of equal text share them (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("second"), text).alias("_k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(total: Column, size: int) -> Column:
    """How many blocks of at most ``size`` hold ``total``, at least one."""
    return F.greatest(F.lit(1), F.ceil(total / F.lit(size))).cast("int")
