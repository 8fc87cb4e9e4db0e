"""Tables that are written on the way, in the folder that all executors see."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a session whose executors are threads of the driver gets a
    temporary one that goes with the process; any other session is refused, as its executors would not see it."""
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


def staged(rows: DataFrame, name: str, folder: str | None = None, **options) -> DataFrame:
    """The rows, written down and read again: what follows neither makes nor plans them again. options: of the writer."""
    spark = rows.sparkSession
    place = f"{folder or f'{shared_folder(spark)}/staged-{uuid.uuid4().hex}'}/{name}"
    rows.write.options(**options).parquet(place)
    return spark.read.schema(rows.schema).parquet(place)
