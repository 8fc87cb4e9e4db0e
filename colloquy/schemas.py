"""The tables of a vault: sessions, messages, tool calls and errata, keyed by deterministic ids."""

from pyspark.sql import types as T


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


S, L, B = T.StringType(), T.LongType(), T.BooleanType()

SESSIONS = _struct(
    session_id=S, source=S, native_id=S, parent_session_id=S, project_root=S, project_slug=S, title=S, model=S, git_branch=S, tool_version=S,
    started_at=S, ended_at=S, started_ts=T.TimestampType(), ended_ts=T.TimestampType(),
    input_tokens=L, output_tokens=L, cache_read_tokens=L, cache_write_tokens=L, total_tokens=L, estimated_cost_usd=T.DoubleType(),
    message_count=L, tool_call_count=L, turn_count=L, error_count=L, raw_path=S, summary_embedding=T.ArrayType(T.FloatType()),
    embedding_sums=T.ArrayType(_struct(n=L, x=T.DoubleType())),
)
MESSAGES = _struct(
    session_id=S, uuid=S, parent_uuid=S, role=S, content=S, thinking=S, source_seq=L, turn_number=L, input_tokens=L, output_tokens=L,
    embedding=T.ArrayType(T.FloatType()), ingested_at=T.TimestampType(), n_tokens=T.IntegerType(), raw_path=S,
)
TOOL_CALLS = _struct(
    session_id=S, uuid=S, call_id=S, tool_name=S, tool_input=S, tool_output=S, is_error=B, request_message=S, response_message=S,
    source_seq=L, started_at=S, ended_at=S, duration_ms=L, raw_path=S,
)
ERRATA = _struct(session_id=S, source_seq=L, kind=S, snippet=S, raw_path=S)
#: The full-text index of messages; made from them, so it is no part of what is taken in.
POSTINGS = _struct(term=S, session_id=S, uuid=S, source_seq=L, n_tokens=T.IntegerType(), places=T.ArrayType(T.IntegerType()))
#: Stems of all words that messages have had.
VOCABULARY = _struct(term=S, stem=S)
#: What each segment of a vault replaces in those before it.
REPLACED = _struct(key=S)
TABLES = {"sessions": SESSIONS, "messages": MESSAGES, "tool_calls": TOOL_CALLS, "errata": ERRATA}

#: Names of the sources a vault knows, in the order of their ids.
SOURCES = ("claude", "codex", "opencode", "hermes", "copilot")
