"""Session-keyed replacement: what arrives takes the place of everything the table holds of its sessions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_sessions(old: DataFrame, new: DataFrame, arrived: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of `old` whose session isn't among `arrived` (a column of keys), and all of `new`."""
    return old.join(arrived.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def resolve_parents(sessions: DataFrame, key: str = "session_id", parent: str = "parent_session_id") -> DataFrame:
    """Sessions with the parent's id where that session is there, and null where it isn't (yet). Links are kept as written
    and resolved when read, so the order in which sessions arrive doesn't matter."""
    known = sessions.select(F.col(key).alias("_parent")).distinct()
    return sessions.join(known, F.col(parent) == F.col("_parent"), "left").withColumn(parent, F.col("_parent")).drop("_parent")
