"""Conversations written as session files of each format and parsed again: what comes back must be what went in."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ingest import one_path_a_session, parse_lines, parse_stores
from ..sources.lines import detect_kinds
from . import derived

BORN = "2024-01-01T00:00:00Z"


def _turns(spark, sf_dir) -> DataFrame:
    rows = derived.turns(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("source_seq"))
    return rows.select(F.col("session_id").cast("string").alias("path"), order.cast("long").alias("n"), "role", "content")


def _lines(rows: DataFrame, line: Column, head: Column | None = None) -> DataFrame:
    """path, source_seq and line, with a head line at 0 for each file if one is given."""
    out = rows.select("path", F.col("n").alias("source_seq"), line.alias("line"))
    if head is not None:
        out = out.unionByName(rows.select("path").distinct().select("path", F.lit(0).cast("long").alias("source_seq"), head.alias("line")))
    return out


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _nested(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def claude_lines(rows: DataFrame) -> DataFrame:
    usage = _nested(input_tokens=F.col("n"), output_tokens=F.lit(1))
    return _lines(
        rows,
        _json(
            uuid=F.concat_ws("-", "path", "n"), type=F.col("role"), timestamp=BORN, sessionId=F.col("path"), version="1", cwd="/work/app",
            message=_nested(model="m", content=F.col("content"), usage=usage)
        )
    )


def codex_lines(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user_message").otherwise("agent_message")
    line = _json(timestamp=BORN, type="event_msg", payload=_nested(type=kind, message=F.col("content")))
    return _lines(rows, line, _json(timestamp=BORN, type="session_meta", payload=_nested(id=F.col("path"), cwd="/work/app")))


def transcript_lines(rows: DataFrame) -> DataFrame:
    line = _json(type=F.concat("role", F.lit(".message")), timestamp=F.col("n"), content=F.nullif("content", F.lit("")))
    return _lines(rows, line, _json(type="session.start", sessionId=F.col("path"), timestamp=F.lit(0)))


def chat_lines(rows: DataFrame) -> DataFrame:
    """A chat session that starts empty and gets a request, with its answer, by a patch for each turn."""
    request = _nested(message=_nested(text=F.col("content")), response=F.array(_nested(value=F.concat(F.lit("Re: "), "role"))))
    line = _json(kind=2, k=F.array(F.lit("requests")), v=F.array(request))
    return _lines(rows, line, _json(kind=0, v=_nested(sessionId=F.col("path"), creationDate=0, requests=F.array().cast("array<string>"))))


def claude_call_lines(rows: DataFrame) -> DataFrame:
    """Each turn of an assistant asks for a call besides what it says; the user's next event answers it, with an error in
    every fourth. Every fifth is never answered."""
    def event(kind, number, content):
        return _json(
            uuid=F.concat_ws("-", "path", number), type=kind, timestamp=BORN, sessionId=F.col("path"), version="1", cwd="/work/app",
            message=_nested(content=content)
        )

    call = F.concat(F.lit("c"), "n")
    none = F.lit(None).cast("string")
    asked = _nested(type="tool_use", id=call, name=F.concat(F.lit("tool"), F.col("n") % 3), input=_nested(n=F.col("n")), text=none)
    told = _nested(type="text", id=none, name=none, input=F.lit(None).cast("struct<n: bigint>"), text=F.coalesce("content", F.lit("")))
    answered = _nested(type="tool_result", tool_use_id=call, content=F.concat(F.lit("out "), "n"), is_error=F.col("n") % 4 == 0)
    assistant = F.col("role") == "assistant"
    events = F.array(
        F.struct(
            (F.col("n") * 2 - 1).alias("source_seq"),
            F.when(
                assistant, event("assistant", F.col("n") * 2, F.array(told, asked))
            ).otherwise(event("user", F.col("n") * 2, F.coalesce("content", F.lit("")))).alias("line")
        ),
        F.struct(
            (F.col("n") * 2).alias("source_seq"), F.when(assistant & (F.col("n") % 5 != 0), event("user", F.col("n") * 2 + 1, F.array(answered))).alias("line")
        ),
    )
    return rows.select("path", F.inline(events)).where("line is not null")


def codex_call_lines(rows: DataFrame) -> DataFrame:
    """Each turn of an assistant is followed by a function call and, but for every fifth, its output."""
    said = codex_lines(rows).withColumn("source_seq", F.col("source_seq") * 3)
    call = F.concat(F.lit("c"), "n")
    asked = _json(
        timestamp=BORN, type="response_item",
        payload=_nested(type="function_call", name=F.concat(F.lit("tool"), F.col("n") % 3), arguments=_nested(n=F.col("n")), call_id=call)
    )
    given = _json(timestamp=BORN, type="response_item", payload=_nested(type="function_call_output", call_id=call, output=F.concat(F.lit("out "), "n")))
    more = F.array(
        F.struct((F.col("n") * 3 + 1).alias("source_seq"), asked.alias("line")),
        F.struct((F.col("n") * 3 + 2).alias("source_seq"), F.when(F.col("n") % 5 != 0, given).alias("line"))
    )
    return said.unionByName(rows.where("role = 'assistant'").select("path", F.inline(more)).where("line is not null"))


def _store(kind: str, **tables) -> DataFrame:
    """Rows as the reader of stores gives them."""
    out = None
    for name, rows in tables.items():
        found = rows.select(
            F.lit("store.db").alias("path"), F.lit(kind).alias("kind"), F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns)).alias("row")
        )
        out = found if out is None else out.unionByName(found)
    return out


def opencode_rows(rows: DataFrame) -> DataFrame:
    """A message with a part of text for each turn; those of assistants have a part for a call, of which every fourth failed."""
    message = F.concat_ws("-", "path", "n")
    sessions = rows.groupBy("path").agg(F.sum("n").alias("tokens_input"), F.count("*").alias("tokens_output"))
    sessions = sessions.select(
        F.col("path").alias("id"), F.lit("/work/app").alias("directory"), F.lit("t").alias("title"), F.lit(0).alias("time_created"),
        F.lit(0).alias("time_updated"), F.lit('{"id":"m"}').alias("model"), "tokens_input", "tokens_output", F.lit(0).alias("tokens_cache_read"),
        F.lit(0).alias("tokens_cache_write")
    )
    messages = rows.select(message.alias("id"), F.col("path").alias("session_id"), F.col("n").alias("time_created"), _json(role=F.col("role")).alias("data"))
    text = rows.select(
        F.concat(message, F.lit("-a")).alias("id"), message.alias("message_id"), F.col("n").alias("time_created"),
        _json(type="text", text=F.col("content")).alias("data")
    )
    state = _nested(
        status=F.when(F.col("n") % 4 == 0, F.lit("error")).otherwise(F.lit("completed")), input=_nested(n=F.col("n")), output=F.concat(F.lit("out "), "n")
    )
    calls = rows.where("role = 'assistant'").select(
        F.concat(message, F.lit("-b")).alias("id"), message.alias("message_id"), F.col("n").alias("time_created"),
        _json(type="tool", callID=F.concat(F.lit("c"), "n"), tool=F.concat(F.lit("tool"), F.col("n") % 3), state=state).alias("data")
    )
    return _store("opencode", session=sessions, message=messages, part=text.unionByName(calls))


def hermes_rows(rows: DataFrame) -> DataFrame:
    """Messages of assistants ask for a call each, all by one id within a session; but for every fifth, tool messages answer
    them after the last message, so the answers are paired first in, first out."""
    sessions = rows.select("path").distinct().select(
        F.col("path").alias("id"), F.lit("web").alias("source"), F.lit("m").alias("model"), F.lit(0.5).alias("started_at"),
        F.lit(1.0).alias("input_tokens").cast("long")
    )
    assistant = F.col("role") == "assistant"
    asked = F.to_json(
        F.array(_nested(call_id="c", function=_nested(name=F.concat(F.lit("tool"), F.col("n") % 3), arguments=F.concat(F.lit('{"n":'), "n", F.lit("}")))))
    )
    own = [F.col("path").alias("session_id"), F.lit(1.5).alias("timestamp")]
    said = rows.select(
        F.col("n").alias("id"), *own, "role", "content", F.lit(None).cast("string").alias("tool_call_id"), F.when(assistant, asked).alias("tool_calls")
    )
    answers = rows.where(assistant).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("n")))
    answers = answers.where("k % 5 != 0").select(
        (F.col("n") + 1_000_000).alias("id"), *own, F.lit("tool").alias("role"), F.concat(F.lit("out "), "k").alias("content"),
        F.lit("c").alias("tool_call_id"), F.lit(None).cast("string").alias("tool_calls")
    )
    return _store("hermes", session=sessions, every=sessions.select("id", "source"), message=said.unionByName(answers))


def _parsed(make):
    return lambda spark, sf_dir: (parse_stores if make in (opencode_rows, hermes_rows) else parse_lines)(make(_turns(spark, sf_dir)))


def _messages(make):
    def run(spark, sf_dir):
        parsed = _parsed(make)(spark, sf_dir)
        named = parsed.sessions.select("session_id", "native_id")
        return parsed.messages.join(named.hint("merge"), "session_id").select("native_id", "turn_number", "role", F.coalesce("content", F.lit("")).alias("content"))

    return run


def _calls(make):
    """Calls with the messages that asked for them, by their numbers in the session."""

    def run(spark, sf_dir):
        parsed = _parsed(make)(spark, sf_dir)
        named = parsed.sessions.select("session_id", "native_id")
        asked = parsed.messages.select(F.col("uuid").alias("request_message"), F.col("source_seq").alias("asked_at"))
        calls = parsed.tool_calls.join(named.hint("merge"), "session_id").join(asked.hint("merge"), "request_message", "left")
        return calls.select(
            "native_id", "asked_at", "call_id", "tool_name", F.regexp_replace("tool_input", " ", "").alias("tool_input"), "tool_output", "is_error"
        )

    return run


def same_session_two_paths(spark, sf_dir):
    """Every session is written at two paths, the second time without its last turn; the last path's copy stays, whole."""
    rows = _turns(spark, sf_dir)
    last = F.max("n").over(Window.partitionBy("path"))
    lines = claude_lines(rows).withColumn("path", F.concat(F.lit("a/"), "path"))
    shorter = claude_lines(rows.withColumn("last", last).where("n < last or last = 1")).withColumn("path", F.concat(F.lit("b/"), "path"))
    found = one_path_a_session(parse_lines(lines.unionByName(shorter)))
    counted = found.messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("turn_number").alias("last_turn"))
    return found.sessions.join(counted, "session_id").select(
        "native_id", "message_count", "input_tokens", "messages", "last_turn", F.substring("raw_path", 1, 2).alias("path")
    )


def parsed_sessions(spark, sf_dir):
    """Counts and tokens of the sessions that come back from the claude format."""
    found = parse_lines(claude_lines(_turns(spark, sf_dir))).sessions
    return found.select("native_id", "message_count", "input_tokens", "output_tokens", "total_tokens", "error_count")


def errata_counts(spark, sf_dir):
    """Every third turn is written broken; each broken line is an erratum."""
    lines = claude_lines(_turns(spark, sf_dir))
    broken = lines.withColumn("line", F.when(F.col("source_seq") % 3 == 0, F.lit("{broken")).otherwise(F.col("line")))
    return parse_lines(broken).errata.groupBy("kind").agg(F.count("*").alias("n"))


def unmatched_requests(spark, sf_dir):
    """Every session starts a call before anyone has spoken, which never ends; its request is no message."""
    rows = _turns(spark, sf_dir)
    call = _json(type="tool.execution_start", tool_call_id="early", tool_name="run", timestamp=0)
    early = rows.select("path").distinct().select("path", F.lit(1).cast("long").alias("source_seq"), call.alias("line"))
    lines = transcript_lines(rows).withColumn("source_seq", F.col("source_seq") * 2).unionByName(early)
    return one_path_a_session(parse_lines(lines)).errata.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


def detect_kind(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    lines = claude_lines(rows.where("path % 3 = 0")).unionByName(codex_lines(rows.where("path % 3 = 1"))).unionByName(
        transcript_lines(rows.where("path % 3 = 2"))
    )
    return detect_kinds(lines).groupBy("kind").agg(F.count("*").alias("files"))


_TURNS = "r AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n, role, text FROM conversations WHERE role IN ('user', 'assistant'))"
_MESSAGES = f"WITH {_TURNS} SELECT CAST(conv_id AS VARCHAR) AS native_id, n AS turn_number, role, coalesce(text, '') AS content FROM r"

_CHAT = f"WITH {_TURNS} SELECT CAST(conv_id AS VARCHAR) AS native_id, n * 2 - 1 AS turn_number, 'user' AS role, coalesce(text, '') AS content FROM r UNION ALL SELECT CAST(conv_id AS VARCHAR), n * 2, 'assistant', 'Re: ' || role FROM r"


def _calls_sql(asked_at: str, call_id: str, output: str, is_error: str) -> str:
    return f"""WITH {_TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k FROM r WHERE role = 'assistant'),
      g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS place FROM a WHERE k % 5 <> 0)
      SELECT CAST(a.conv_id AS VARCHAR) AS native_id, CAST({asked_at} AS BIGINT) AS asked_at, {call_id} AS call_id, 'tool' || CAST(a.n % 3 AS VARCHAR) AS tool_name, '{{"n":' || CAST(a.n AS VARCHAR) || '}}' AS tool_input,
        {output} AS tool_output, {is_error} AS is_error FROM a LEFT JOIN g ON g.conv_id = a.conv_id AND g.place = a.k"""


_OWN_ID = "'c' || CAST(a.n AS VARCHAR)"
_ANSWERED = "CASE WHEN a.n % 5 <> 0 THEN 'out ' || CAST(a.n AS VARCHAR) END"
_LOST = f"""WITH {_TURNS}, l AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS last FROM r)
  SELECT CAST(conv_id AS VARCHAR) AS native_id, count(*) AS message_count, CAST(sum(n) AS BIGINT) AS input_tokens, count(*) AS messages, max(n) AS last_turn, 'b/' AS path FROM l WHERE n < last OR last = 1 GROUP BY 1"""

ROUND_TRIPS = {
    "parse_copilot_chat": (_messages(chat_lines), _CHAT),
    "parse_opencode": (_messages(opencode_rows), _MESSAGES),
    "parse_hermes": (_messages(hermes_rows), _MESSAGES.replace("CAST(conv_id AS VARCHAR) AS native_id", "'web:' || conv_id AS native_id")),
    "parse_claude_calls": (_calls(claude_call_lines), _calls_sql("a.n * 2 - 1", _OWN_ID, _ANSWERED, "CASE WHEN a.n % 5 <> 0 THEN a.n % 4 = 0 END")),
    "parse_codex_calls": (_calls(codex_call_lines), _calls_sql("a.n * 3", _OWN_ID, _ANSWERED, "CAST(NULL AS BOOLEAN)")),
    "parse_opencode_calls": (_calls(opencode_rows), _calls_sql("a.n", _OWN_ID, "'out ' || CAST(a.n AS VARCHAR)", "a.n % 4 = 0")),
    "parse_hermes_calls": (
        _calls(hermes_rows),
        _calls_sql("a.n", "'c'", "'out ' || CAST(g.k AS VARCHAR)", "CAST(NULL AS BOOLEAN)").replace("CAST(a.conv_id AS VARCHAR) AS", "'web:' || a.conv_id AS")
    ),
    "same_session_two_paths": (same_session_two_paths, _LOST),
    "parse_claude": (_messages(claude_lines), _MESSAGES),
    "parse_codex": (_messages(codex_lines), _MESSAGES),
    "parse_copilot": (_messages(transcript_lines), _MESSAGES),
    "parsed_sessions": (
        parsed_sessions,
        f"WITH {_TURNS} SELECT CAST(conv_id AS VARCHAR) AS native_id, count(*) AS message_count, CAST(sum(n) AS BIGINT) AS input_tokens, count(*) AS output_tokens, CAST(sum(n) + count(*) AS BIGINT) AS total_tokens, CAST(0 AS BIGINT) AS error_count FROM r GROUP BY 1"
    ),
    "unmatched_requests": (
        unmatched_requests,
        f"WITH {_TURNS}, k AS (SELECT unnest(['tool_before_any_message', 'unmatched_request', 'dangling_tool_start']) AS kind) SELECT kind, count(DISTINCT conv_id) AS n, count(DISTINCT conv_id) AS sessions FROM r, k GROUP BY kind"
    ),
    "errata_counts": (errata_counts, f"WITH {_TURNS} SELECT 'parse_error' AS kind, count(*) AS n FROM r WHERE n % 3 = 0"),
    "detect_kind": (
        detect_kind,
        f"WITH {_TURNS} SELECT CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'copilot-transcript' END AS kind, count(DISTINCT conv_id) AS files FROM r GROUP BY 1"
    ),
}
