"""From a path to the four tables: which parser each file goes to is decided by what it holds."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..operators.periods import Recency
from ..parsers import Parsed, Stage, claude, codex, copilot, hermes, opencode
from ..schemas import TABLES
from ..scratch import staged
from .lines import by_kind, detect_kinds, session_lines
from .sqlite import store_rows

LINE_PARSERS = {"claude": claude.parse, "codex": codex.parse, "copilot-chat": copilot.parse_chat, "copilot-transcript": copilot.parse_transcript}
STORE_PARSERS = {"opencode": opencode.parse, "hermes": hermes.parse}


def parse_lines(lines: DataFrame, stage: Stage = staged) -> Parsed:
    """Every file by the parser of its kind; files of no kind give one erratum each. Only the parsers of kinds that there are run.
    Parsed lines are written down by `stage`, so each is parsed once."""
    kinds = [r.kind for r in detect_kinds(lines).select("kind").distinct().collect()]
    rows = by_kind(lines)
    out = None
    for kind, parse in LINE_PARSERS.items():
        if kind in kinds:
            found = parse(rows.where(F.col("kind") == kind).drop("kind"), stage)
            out = found if out is None else out.union(found)
    if None in kinds or out is None:
        unknown = rows.where("kind is null").groupBy("path").agg(F.min_by("line", "source_seq").alias("line"))
        lost = unknown.select(
            F.lit(None).cast("string").alias("session_id"), F.lit(1).cast("long").alias("source_seq"), F.lit("parse_error").alias("kind"),
            F.substring("line", 1, 500).alias("snippet"), F.col("path").alias("raw_path")
        )
        if out is None:
            none = {t: lines.sparkSession.createDataFrame([], schema) for t, schema in TABLES.items()}
            out = Parsed(**none)
        out.errata = out.errata.unionByName(lost)
    return out


def parse_stores(rows: DataFrame, stage: Stage = staged) -> Parsed:
    """The stores by the parsers of their kinds."""
    kinds = [r.kind for r in rows.select("kind").distinct().collect()]
    kinds = [k for k in kinds if k in STORE_PARSERS] or ["opencode"]
    out = None
    for kind, parse in STORE_PARSERS.items():
        if kind in kinds:
            found = parse(rows, stage)
            out = found if out is None else out.union(found)
    return out


def read_sessions(spark: SparkSession, path: str | list[str], recency: Recency = Recency(), stage: Stage = staged) -> Parsed:
    """A store file, a .jsonl file, a folder of .jsonl files (stores in it are not read), or a list of .jsonl files."""
    for name in [path] if isinstance(path, str) else path:
        if "://" not in name and not os.path.exists(name):
            raise NotFound(f"no such file or folder: {name}")
    if isinstance(path, str) and path.endswith((".db", ".sqlite")):
        rows = stage(store_rows(spark, path, recency), "store")  # read once for all its tables
        found = parse_stores(rows, stage)
    else:
        found = parse_lines(session_lines(spark, path, recency), stage)
    return one_path_a_session(found, stage)


def one_path_a_session(parsed: Parsed, stage: Stage = staged) -> Parsed:
    """Of a session found at several paths the last in their order stays, whole: its row, messages, calls and errata.
    Errata without a session stay. Calls whose request is no message of their session are errata too."""
    sessions = stage(parsed.sessions, "sessions")  # all tables meet them
    last = sessions.groupBy(F.col("session_id").alias("_session")).agg(F.max("raw_path").alias("_path"))

    def own(rows: DataFrame) -> DataFrame:
        return rows.join(last, (F.col("session_id") == F.col("_session")) & (F.col("raw_path") == F.col("_path")), "left_semi")

    errata = own(parsed.errata).unionByName(parsed.errata.where("session_id is null"))
    out = Parsed(own(sessions), own(parsed.messages).dropDuplicates(["uuid"]), own(parsed.tool_calls).dropDuplicates(["uuid"]), errata)
    asked = out.messages.select(F.col("uuid").alias("_request"))
    lost = out.tool_calls.join(asked, F.col("request_message") == F.col("_request"), "left_anti")
    lost = lost.select("session_id", "source_seq", F.lit("unmatched_request").alias("kind"), F.col("call_id").alias("snippet"), "raw_path")
    return Parsed(out.sessions, out.messages, out.tool_calls, out.errata.unionByName(lost))


def summary(sessions: DataFrame) -> DataFrame:
    """A row for each session: how much of it was taken in."""
    return sessions.select("session_id", "source", "message_count", "tool_call_count", "error_count", "total_tokens")


def tables(parsed: Parsed) -> dict[str, DataFrame]:
    return {name: getattr(parsed, name) for name in TABLES}
