"""Sessions' transcripts in Markdown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFound

# The labels of the head, and the columns they show.
CHANNELS = (("in", "input_tokens"), ("out", "output_tokens"), ("cache_r", "cache_read_tokens"), ("cache_w", "cache_write_tokens"))
UNTITLED, UNKNOWN = "Untitled session", "unknown"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _or(column: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(other))


def _head() -> Column:
    tokens = [_text(" " if k else "", f"{name}=", _or(column, "0")) for k, (name, column) in enumerate(CHANNELS)]
    facts = {
        "Session ID": F.col("session_id").cast("string"), "Source": _or("source", UNKNOWN), "Project": _or("project_slug", UNKNOWN),
        "Started": _text(
            _or("started_at", "?"), " · **Ended:** ", _or("ended_at", "?")
        ), "Model": _or("model", UNKNOWN), "Tokens": _text(*tokens), "Tool calls": _or("tool_call_count", "0"),
    }
    return _text("# ", _or("title", UNTITLED), "\n\n", *[_text(f"- **{name}:** ", value, "\n") for name, value in facts.items()], "\n---\n\n")


def _call() -> Column:
    given = F.coalesce(_text("**Input:**\n```json\n", F.col("tool_input"), "\n```\n"), F.lit(""))
    failed = F.when(F.col("is_error"), "\n(error)").otherwise("")
    return _text(
        "### Tool: ", F.coalesce("tool_name", F.lit(UNKNOWN)), " (`", F.coalesce("call_id", F.lit("")), "`)\n", given, "**Output:**\n```\n",
        F.coalesce("tool_output", F.lit("")), failed, "\n```\n\n"
    )


def _message() -> Column:
    said = F.coalesce(_text(F.col("content"), "\n"), F.lit(""))
    thought = F.coalesce(_text("> **thinking:** ", F.col("thinking"), "\n\n"), F.lit(""))
    return _text(
        "## [", F.coalesce(F.col("turn_number").cast("string"), F.lit("?")), "] ", F.col("role"), "\n", said, thought, F.coalesce("calls", F.lit("")), "\n"
    )


def _joined(order: list[str], text: str) -> Column:
    """The texts of a group in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "")


def transcripts(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """session_id and markdown of each session: its head, its messages in order, and after each the calls that it asked for.
    Calls meet their messages grouped by message, messages their sessions grouped by session."""
    calls = tool_calls.select("session_id", "request_message", "source_seq", "call_id", _call().alias("text"))
    calls = calls.groupBy("session_id", "request_message").agg(_joined(["source_seq", "call_id"], "text").alias("calls"))
    rows = messages.select("session_id", "uuid", "source_seq", "turn_number", "role", "content", "thinking")
    rows = rows.join(calls.withColumnRenamed("request_message", "uuid"), ["session_id", "uuid"], "left")
    body = rows.select(
        "session_id", "source_seq", "turn_number", "uuid", _message().alias("text")
    ).groupBy("session_id").agg(_joined(["source_seq", "turn_number", "uuid"], "text").alias("body"))
    heads = sessions.select("session_id", _head().alias("head"))
    return heads.join(body, "session_id", "left").select("session_id", _text(F.col("head"), F.coalesce("body", F.lit(""))).alias("markdown"))


def export_markdown(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame, session_id: str) -> str:
    """One session's transcript; NotFound where there is no such session."""
    of = F.col("session_id") == session_id
    found = transcripts(sessions.where(of), messages.where(of), tool_calls.where(of)).first()
    if found is None:
        raise NotFound(f"session {session_id} not found")
    return found.markdown
