"""Rollout lines {timestamp, type, payload}: messages, calls that several events complete, cumulative token counts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.columns import child_uuid, session_uuid
from ..scratch import staged
from . import Count, First, LastSoFar, Parsed, Stage, along_file, bad_lines, finish, first_of, good_lines, judged

# Names of the format.
QUIET = ("turn_started", "turn_complete", "task_started", "task_complete", "model_reroute", "exec_approval_request")
SKIPPED = ("world_state", "inter_agent_communication", "ghost_snapshot")
NOT_STORED = ("agent_nickname", "agent_role", "agent_path", "model_provider", "originator", "cli_version")
TEXT_PARTS = ("text", "output_text", "input_text")
FAULTS = ("error", "warning", "stream_error")
CALLS = ("function_call", "web_search_call")
BEGINS = ("exec_command_begin", "mcp_tool_call_begin", "web_search_begin")
ENDS = ("exec_command_end", "mcp_tool_call_end")
SPOKEN = ("user_message", "agent_message")


def _parts(content: Column) -> Column:
    return V.joined(F.transform(V.array(content), lambda p: F.when(V.string(p, "$.type").isin(*TEXT_PARTS), F.nullif(V.string(p, "$.text"), F.lit("")))))


def _count(p: Column, name: str, nested: str) -> Column:
    return F.coalesce(V.integer(p, f"$.{name}"), V.integer(p, f"$.info.total_token_usage.{nested}"), F.lit(0))


def parse(lines: DataFrame, stage: Stage = staged) -> Parsed:
    v = F.col("v")
    p, kind, sub, seq = F.col("p"), F.col("type"), F.col("sub"), F.col("source_seq")
    type_, payload = V.string(v, "$.type"), V.get(v, "$.payload")
    below = F.when(type_.isin("response_item", "event_msg"), F.coalesce(V.string(payload, "$.type"), F.lit("")))
    rows = stage(judged(
        lines, V.is_object(v) & type_.isNotNull(), type_.alias("type"), V.string(v, "$.timestamp").alias("at"), payload.alias("p"), below.alias("sub")
    ), "codex")
    message = (kind == "response_item") & sub.isin("message", "reasoning") | (kind == "event_msg") & sub.isin(*SPOKEN)
    message = F.coalesce(message, F.lit(False))
    role = F.when(sub == "message", F.coalesce(V.string(p, "$.role"), F.lit("assistant"))).when(sub == "user_message", "user").otherwise("assistant")
    events = along_file(
        good_lines(rows),
        {
            "meta": First(F.when(kind == "session_meta", p)), "spoke_at": LastSoFar(F.when(message & (role == "assistant"), seq)), "turn_number": Count(message)
        }
    )
    events = events.withColumn("native", V.string(F.col("meta"), "$.id"))
    ids = session_uuid(F.lit("codex"), F.col("native"))
    at_line = lambda n: child_uuid(F.col("session_id"), F.concat(F.lit("seq-"), n))
    events = events.withColumn("session_id", F.when(F.col("native").isNotNull(), ids)).withColumns({
        "uuid": F.when(message, at_line(seq)), "role": F.when(message, role),
        "speaker": F.when(F.col("spoke_at").isNotNull(), at_line(F.col("spoke_at")))
    })
    events = stage(events, "codex-events")
    lost = events.where("native is null").select("path").distinct()
    events = events.where("native is not null")
    said = F.when(sub == "message", _parts(V.get(p, "$.content"))).when(sub.isin(*SPOKEN), V.string(p, "$.message"))
    messages = events.where(message).select(
        "path", "session_id", "uuid", "role", "source_seq", said.alias("content"), F.when(sub == "reasoning", V.string(p, "$.text")).alias("thinking"), "turn_number"
    )

    summary = F.nullif(V.string(p, "$.summary"), F.lit(""))
    title = F.when(kind.isin("turn_context", "compacted"), summary).when(
        (kind == "event_msg") & (sub == "user_message"), F.nullif(F.substring(V.string(p, "$.message"), 1, 80), F.lit(""))
    )
    tokens = (kind == "event_msg") & (sub == "token_count")
    most = lambda x: F.greatest(F.lit(0), F.max(F.when(tokens, x)))
    made = _count(p, "output", "output_tokens") + _count(p, "reasoning_output", "reasoning_output_tokens")
    m = F.col("meta")
    sessions = events.groupBy("path", "session_id").agg(
        F.first("native").alias("native_id"), F.first("meta").alias("meta"), F.min_by("at", "source_seq").alias("started_at"), F.max_by("at", "source_seq").alias("ended_at"),
        first_of(title).alias("title"), first_of(F.when(kind == "turn_context", F.nullif(V.string(p, "$.model"), F.lit("")))).alias("model"),
        most(_count(p, "input", "input_tokens")).alias("input_tokens"), most(made).alias("output_tokens"), most(
            _count(p, "cached_input", "cached_input_tokens")
        ).alias("cache_read_tokens"),
    )
    parent = F.coalesce(V.string(m, "$.forked_from_id"), V.string(m, "$.parent_thread_id"))
    sessions = sessions.withColumns(
        {
            "source": F.lit("codex"), "project_root": F.nullif(V.string(m, "$.cwd"), F.lit("")), "git_branch": V.string(m, "$.git.branch"),
            "tool_version": V.string(m, "$.cli_version"), "parent_session_id": session_uuid(F.lit("codex"), parent)
        }
    )
    stored = F.lit(False)
    for name in NOT_STORED:
        stored = stored | V.string(m, f"$.{name}").isNotNull()
    dropped = sessions.where(stored).select(
        "path", F.lit(None).cast("long").alias("source_seq"), F.lit("dropped_metadata").alias("kind"), F.lit("session_meta.*").alias("snippet")
    )

    calls, call_errata = _calls(events)
    note = lambda rows, name, snippet: rows.select(
        "path", "source_seq", F.lit(name).alias("kind") if isinstance(name, str) else name.alias("kind"), snippet.alias("snippet")
    )
    first_only = F.row_number().over(Window.partitionBy("path", "type", "sub").orderBy("source_seq"))
    handled = (*SPOKEN, *BEGINS, *ENDS, *FAULTS, *QUIET, "token_count")
    other = events.where(
        kind.isin(*SKIPPED) | (kind == "event_msg") & ~sub.isin(*handled) | ~kind.isin(
            *SKIPPED, "session_meta", "turn_context", "compacted", "response_item", "event_msg"
        )
    ).withColumn("n", first_only).where("n = 1")
    known = (*SKIPPED, "event_msg")
    errata = [
        bad_lines(rows),
        dropped,
        call_errata,
        note(events.where(kind == "compacted"), "history_compacted", F.lit("type:compacted")),
        note(other, F.when(kind.isin(*known), "skipped_event").otherwise("unknown_event_type"), F.concat_ws(":", "type", "sub")),
        note(
            events.where((kind == "response_item") & ~sub.isin("message", "reasoning", "function_call_output", *CALLS)), "unknown_response_subtype",
            F.col("sub")
        ),
        note(events.where((kind == "event_msg") & sub.isin(*FAULTS)), F.col("sub"), F.coalesce(V.string(p, "$.message"), F.to_json(p))),
        lost.select(
            "path", F.lit(None).cast("long").alias("source_seq"), F.lit("parse_error").alias("kind"), F.lit("no session_meta with an id").alias("snippet")
        ),
    ]
    out = errata[0]
    for rows in errata[1:]:
        out = out.unionByName(rows)
    return finish(sessions, messages, calls, out)


def _calls(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A call is made by the last event that opens its id, and completed by outputs and ends after it. An end whose id
    nothing has opened opens one itself, if it brings an output or an exit code."""
    p, sub = F.col("p"), F.col("sub")
    call_id = F.coalesce(V.string(p, "$.call_id"), F.lit(""))
    item, msg = F.col("type") == "response_item", F.col("type") == "event_msg"
    rows = events.where(item & sub.isin(*CALLS, "function_call_output") | msg & sub.isin(*BEGINS, *ENDS))
    end = msg & sub.isin(*ENDS)
    rows = rows.withColumn(
        "call_id", F.when(end & (call_id == ""), F.concat(F.lit("synthetic-"), F.col("source_seq"))).otherwise(call_id)
    ).withColumn("end", end)
    rows = rows.where((F.col("call_id") != "") | (sub == "function_call_output"))
    output = F.when(end, F.coalesce(V.text(p, "$.aggregated_output"), V.text(p, "$.result"))).when(sub == "function_call_output", V.text(p, "$.output"))
    rows = rows.withColumn("output", output).withColumn("failed", F.when(end, V.integer(p, "$.exit_code") != 0))
    upto = Window.partitionBy("path", "call_id").orderBy("source_seq")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    opens = item & sub.isin(*CALLS)
    able = end & (F.col("output").isNotNull() | F.col("failed").isNotNull())
    rows = rows.withColumn("asked", F.coalesce(F.max(opens).over(before), F.lit(False))).withColumn("ended", F.coalesce(F.max(able).over(before), F.lit(False)))
    rebuilt = able & ~F.col("asked") & ~F.col("ended")
    rows = rows.withColumn("opens", opens | rebuilt).withColumn("rebuilt", rebuilt)
    rows = rows.withColumn("made", F.max(F.when(F.col("opens"), F.col("source_seq"))).over(Window.partitionBy("path", "call_id")))
    rows = rows.withColumn("open", F.coalesce(F.max("opens").over(before), F.lit(False)))
    orphan = F.col("opens") & F.col("speaker").isNull()
    begun = rows.where(msg & sub.isin(*BEGINS)).groupBy("path", "call_id").agg(F.max_by("p", "source_seq").alias("begin"), F.min("at").alias("begun_at"))

    made = rows.where(F.col("source_seq") == F.col("made")).where("opens").join(begun, ["path", "call_id"], "left")
    request = F.coalesce("speaker", child_uuid(F.col("session_id"), F.concat(F.lit("seq-"), F.col("source_seq"))))
    given = F.when(sub == "web_search_call", V.string(p, "$.query")).when(sub == "function_call", F.coalesce(V.json(p, "$.arguments"), V.json(p, "$.input")))
    given = given.otherwise(F.coalesce(V.json(F.col("begin"), "$.arguments"), V.string(F.col("begin"), "$.query"), V.json(p, "$.arguments")))
    name = F.when(sub == "web_search_call", "web_search").when(
        sub == "function_call", F.coalesce(V.string(p, "$.name"), F.lit("unknown"))
    ).when(sub == "exec_command_end", "exec_command").otherwise(F.coalesce(V.string(p, "$.tool"), F.lit("mcp_tool_call")))
    made = made.select(
        "path", "session_id", "call_id", "source_seq", request.alias("request_message"), name.alias("tool_name"), given.alias("tool_input"),
        F.coalesce("at", "begun_at").alias("started_at"), F.when(F.col("rebuilt") | F.col("speaker").isNull(), request).alias("own_response"),
        F.when(F.col("rebuilt"), F.col("output")).alias("own_output"), F.when(F.col("rebuilt"), F.col("failed")).alias("own_failed"),
        F.when(F.col("rebuilt"), F.col("at")).alias("own_end")
    )

    after = rows.where((F.col("source_seq") > F.col("made")) & (F.col("end") | (sub == "function_call_output")))
    answer = sub == "function_call_output"
    seq = F.col("source_seq")
    done = after.groupBy("path", "call_id").agg(
        F.max_by("output", F.when(answer, seq)).alias("answer"), F.max_by("speaker", F.when(answer, seq)).alias("responder"), F.count_if(answer).alias("answers"),
        F.min_by(
            "output", F.when(F.col("end") & F.col("output").isNotNull(), seq)
        ).alias("end_output"), F.max_by("failed", F.when(F.col("failed").isNotNull(), seq)).alias("failed"), F.max_by("at", seq).alias("at"),
    )
    calls = made.join(done, ["path", "call_id"], "left").select(
        "path", "session_id", "call_id", "source_seq", "request_message", "tool_name", "tool_input", "started_at", F.coalesce("at", "own_end").alias("ended_at"),
        F.coalesce("answer", "own_output", "end_output").alias("tool_output"), F.coalesce("failed", "own_failed").alias("is_error"),
        F.when(F.col("answers") > 0, F.col("responder")).otherwise(F.col("own_response")).alias("response_message"), child_uuid(
            F.col("session_id"), F.col("request_message"), F.col("call_id")
        ).alias("uuid"),
    )
    note = lambda where, kind: rows.where(where).select("path", "source_seq", F.lit(kind).alias("kind"), F.col("call_id").alias("snippet"))
    errata = note(orphan, "orphan_tool_call").unionByName(note(F.col("rebuilt"), "tool_call_from_event_msg")).unionByName(
        note(answer & ~F.col("open"), "unpaired_tool_output")
    )
    return calls, errata
