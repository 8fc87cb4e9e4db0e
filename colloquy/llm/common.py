"""What several operators share: the folder all executors see, cutting lineage, per-process caches, bounded label samples."""

import atexit
import ctypes
import shutil
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on, and most characters they have together where their texts are collected.
#: Those with the smallest hash of their id are taken.
MAX_LABELLED = 12_000
MAX_LABELLED_CHARS = 64_000_000
#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 2_000
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a session whose executors are threads of the driver gets
    a temporary folder that goes with the process; any other is refused, as its executors would not see such a folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _local:
        _local["folder"] = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, _local["folder"], ignore_errors=True)
    return _local["folder"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost no recomputation."""
    return _written(df, new_path(df.sparkSession, name), options)


def _written(df: DataFrame, path: str, options: dict) -> DataFrame:
    spark = df.sparkSession
    with rows_a_batch(spark, BATCH_ROWS):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables that live while a block runs: `cut` as above, but all of them are removed when the block is left without an
    error. What outlives the block must be cut by the function above. `drop` removes one before that."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = new_path(self.spark, name)
        made = _written(df, path, options)
        self.paths[id(made)] = made, path
        return made

    def drop(self, *tables: DataFrame) -> None:
        remove(self.spark, *(self.paths.pop(id(t))[1] for t in tables))

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            remove(self.spark, *(path for _, path in self.paths.values()))


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most for what runs within the block, so that a task holds few long texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(work):
    """The function over batches, which at the end of a task gives back to the system what it has freed: worker processes
    live on between tasks, and what their allocators keep counts against the executor's memory."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, also those with dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def in_chunks(texts: list[str], chars: int):
    """Slices of texts of about so many characters; a longer text stands alone."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield slice(at, k)
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process; functions sent by value find it again in later tasks."""
    return sys.modules.setdefault("_colloquy_cache", types.ModuleType("_colloquy_cache")).__dict__


def id_crc(column: str):
    """crc32 of an id written as text, null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(rows: DataFrame, limit: int, chars: int | None = None) -> DataFrame:
    """Distinct rows (doc_id, text and more columns without nulls): at most `limit` of them, and at most `chars` characters.

    They are taken in the order of hashes of the id and then the text, up to the first that would be too much; texts longer
    than `chars` are no candidates. So what comes to a driver is bounded also where one id has very many texts, and it is the
    same in every run. Only ids, hashes and lengths are ordered; the rows taken are broadcast as such and then found.
    """
    more = [c for c in rows.columns if c != "text"]
    keyed = rows.withColumn("_print", F.xxhash64("text"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_chars")
    few = keyed.select(*more, "_print", size)
    few = (few if chars is None else few.where(F.col("_chars") <= chars)).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_print"), *more]
    few = few.orderBy(*order).limit(limit)
    if chars is not None:  # over `limit` rows at most
        so_far = F.sum("_chars").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        few = few.withColumn("_so_far", so_far).where(F.col("_so_far") <= chars)
    return keyed.join(F.broadcast(few.select(*more, "_print")), [*more, "_print"], "left_semi").drop("_print").dropDuplicates()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, limit: int = MAX_LABELLED, chars: int | None = None) -> DataFrame:
    """Texts and labels (doc_id, text, y) of at most `limit` labelled rows for which `usable` (a condition on doc_id) holds, and
    of at most `chars` characters together where given; which ones, `bounded_rows` states.

    The side of ids is bounded by `limit` too and therefore broadcast. Null ids or labels are never used; a document labelled
    twice counts once, with the higher label. Rows that repeat an id and its text count once. Empty labels or documents give
    an empty sample.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return bounded_rows(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), limit, chars)
