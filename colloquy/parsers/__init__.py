"""Session formats: each parser turns numbered lines (path, source_seq, line, v) of its files into the four tables."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ERRATA, MESSAGES, SESSIONS, TABLES, TOOL_CALLS


@dataclass
class Parsed:
    sessions: DataFrame
    messages: DataFrame
    tool_calls: DataFrame
    errata: DataFrame

    def union(self, other: "Parsed") -> "Parsed":
        return Parsed(*(getattr(self, t).unionByName(getattr(other, t)) for t in TABLES))


def shaped(df: DataFrame, schema) -> DataFrame:
    """The columns of a table in order; those missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


#: Writes rows down and gives them back to be read, as `scratch.staged` does.
Stage = Callable[[DataFrame, str], DataFrame]


def first_of(value: Column, order: str = "source_seq") -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def last_of(value: Column, order: str = "source_seq") -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def judged(lines: DataFrame, good: Column, *fields: Column) -> DataFrame:
    """path, source_seq, good, the fields, and the beginning of lines that aren't good."""
    good = F.coalesce(good, F.lit(False))
    return lines.select("path", "source_seq", good.alias("good"), F.when(~good, F.substring("line", 1, 500)).alias("bad"), *fields)


def bad_lines(rows: DataFrame) -> DataFrame:
    return rows.where("not good").select("path", "source_seq", F.lit("parse_error").alias("kind"), F.col("bad").alias("snippet"))


def good_lines(rows: DataFrame) -> DataFrame:
    return rows.where("good").drop("good", "bad")


# State along a file ----------------------------------------------------------------------------------------------------

#: Lines of a block. State goes along a file block by block, so no task holds more of a file than a block.
BLOCK_LINES = 50_000


@dataclass(frozen=True)
class First:
    """The first value in the file that isn't null, on all its rows."""

    value: Column


@dataclass(frozen=True)
class Latest:
    """The last value in the file that isn't null, on all its rows."""

    value: Column


@dataclass(frozen=True)
class LastSoFar:
    """The last value up to the row that isn't null."""

    value: Column


@dataclass(frozen=True)
class Count:
    """How many rows up to this one hold the condition."""

    holds: Column


def along_file(rows: DataFrame, state: dict[str, First | Latest | LastSoFar | Count], *order: str) -> DataFrame:
    """The rows with a column for each state. Rows are taken by blocks of lines: each block has a summary, the summaries of a file
    are scanned (a file has few), and what they carry into a block is met by its rows, which lie together already."""
    order = order or ("source_seq",)
    rows = rows.withColumn("_block", F.floor(F.col("source_seq") / BLOCK_LINES))
    place, sums = F.struct(*order), []
    for name, s in state.items():
        if isinstance(s, Count):
            sums.append(F.count_if(s.holds).alias(f"_{name}"))
            continue
        some, pick, end = F.when(s.value.isNotNull(), place), *((F.min_by, F.min) if isinstance(s, First) else (F.max_by, F.max))
        sums += [pick(s.value, some).alias(f"_{name}"), end(some).alias(f"_at_{name}")]
    blocks = rows.groupBy("path", "_block").agg(*sums)
    whole = Window.partitionBy("path")
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        First: lambda n: F.min_by(f"_{n}", f"_at_{n}").over(whole), Latest: lambda n: F.max_by(f"_{n}", f"_at_{n}").over(whole),
        LastSoFar: lambda n: F.last(f"_{n}", ignorenulls=True).over(before), Count: lambda n: F.sum(f"_{n}").over(before)
    }
    blocks = blocks.select("path", "_block", *[carried[type(s)](n).alias(f"_{n}") for n, s in state.items()])
    met = rows.join(blocks, ["path", "_block"])
    inside = Window.partitionBy("path", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, s in state.items():
        had = F.col(f"_{name}")
        if isinstance(s, Count):
            had = F.coalesce(had, F.lit(0)) + F.count_if(s.holds).over(inside)
        elif isinstance(s, LastSoFar):
            had = F.coalesce(F.last(s.value, ignorenulls=True).over(inside), had)
        met = met.withColumn(name, had)
    return met.drop("_block", *[f"_{name}" for name in state])


def finish(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame, errata: DataFrame) -> Parsed:
    """Counts, times and sums that all formats share. sessions: path, session_id, source, ... ; errata: path, kind, ...
    Sessions are as many as files or more, so no join sends them, or what is counted of them, through the driver.

    Errata of a file that gives no session keep their path and have no session."""
    counts = messages.groupBy("path").agg(F.count("*").alias("message_count"), F.max("turn_number").alias("turn_count"))
    calls = tool_calls.groupBy("path").agg(F.count("*").alias("tool_call_count"))
    faults = errata.groupBy("path").agg(F.count("*").alias("error_count"))
    for rows in (counts, calls, faults):
        sessions = sessions.join(rows.hint("merge"), "path", "left")
    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    numbers = (*tokens, "message_count", "turn_count", "tool_call_count", "error_count")
    known = {name: F.coalesce(F.col(name), F.lit(0)) if name in sessions.columns else F.lit(0) for name in numbers}
    known |= {
        "total_tokens": sum((known[t] for t in tokens[1:]), known[tokens[0]]), "started_ts": F.try_to_timestamp("started_at"),
        "ended_ts": F.try_to_timestamp("ended_at"), "raw_path": F.col("path")
    }
    if "project_root" in sessions.columns:
        known["project_slug"] = F.nullif(F.regexp_extract("project_root", r"([^/\\]+)[/\\]*$", 1), F.lit(""))
    sessions = sessions.withColumns(known)
    ids = sessions.select("path", F.col("session_id").alias("sid"))

    def own(rows: DataFrame) -> DataFrame:
        if "session_id" not in rows.columns:
            rows = rows.join(ids.hint("merge"), "path", "left").withColumnRenamed("sid", "session_id")
        return rows.withColumn("raw_path", F.col("path"))

    return Parsed(shaped(sessions, SESSIONS), shaped(own(messages), MESSAGES), shaped(own(tool_calls), TOOL_CALLS), shaped(own(errata), ERRATA))
