"""Two formats of one tool: chat sessions kept as patches that are replayed in order, and event transcripts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.columns import child_uuid, iso_of_millis, session_uuid
from ..scratch import staged
from . import Count, First, LastSoFar, Latest, Parsed, Stage, along_file, bad_lines, finish, first_of, good_lines, judged, last_of


TEXT_PARTS = ("text", "output_text", "input_text")


def _parts(content: Column) -> Column:
    return V.joined(F.transform(V.array(content), lambda p: F.when(V.string(p, "$.type").isin(*TEXT_PARTS), F.nullif(V.string(p, "$.text"), F.lit("")))))


def _text(content: Column) -> Column:
    """A string that isn't empty, or the texts of an array of parts."""
    return F.coalesce(F.nullif(V.string(content), F.lit("")), _parts(content))


def parse_chat(lines: DataFrame, stage: Stage = staged) -> Parsed:
    v = F.col("v")
    good = V.is_object(v) & (V.is_null(V.get(v, "$.kind")) | V.integer(v, "$.kind").isNotNull())
    all_rows = stage(judged(lines, good, V.integer(v, "$.kind").alias("patch"), F.to_json(V.get(v, "$.k")).alias("key"), V.get(v, "$.v").alias("x")), "chat")
    x, patch, key = F.col("x"), F.col("patch"), F.col("key")
    seed = patch == 0
    titled, appended = (patch == 1) & (key == '["customTitle"]'), (patch == 2) & (key == '["requests"]')
    rows = along_file(good_lines(all_rows), {"native": Latest(F.when(seed, V.string(x, "$.sessionId")))})
    lost = rows.where("native is null").select("path").distinct()
    rows = rows.where("native is not null").withColumn("session_id", session_uuid(F.lit("copilot"), F.col("native")))

    asked = F.when(seed, V.array(x, "$.requests")).when(appended, V.array(x))
    requests = rows.select("path", "session_id", "source_seq", F.posexplode(asked).alias("place", "r"))
    requests = stage(along_file(requests, {"n": Count(F.lit(True))}, "source_seq", "place").withColumn("n", F.col("n") - 1), "requests")
    r = F.col("r")
    base = F.concat(F.lit("req"), F.col("n"))
    items = F.transform(
        V.array(r, "$.responseItems"),
        lambda i: F.when(F.coalesce(V.string(i, "$.kind"), F.lit("text")).isin("text", "code", "markdown"), V.string(i, "$.text"))
    )
    answers = F.transform(V.array(r, "$.response"), lambda i: V.string(i, "$.value"))
    question = F.coalesce(V.string(r, "$.message.text"), _text(V.get(r, "$.message.content")), _parts(V.get(r, "$.message.parts")))
    answer = F.when(V.is_array(V.get(r, "$.responseItems")), V.joined(items)).otherwise(V.joined(answers))
    first = child_uuid(F.col("session_id"), base)
    turn = lambda role, content, uuid, parent, k: F.struct(
        F.lit(role).alias("role"), content.alias("content"), uuid.alias("uuid"), parent.alias("parent_uuid"), (F.col("n") * 2 + k).alias("turn_number")
    )
    pair = F.array(
        turn("user", question, first, F.lit(None).cast("string"), 1),
        turn("assistant", answer, child_uuid(F.col("session_id"), F.concat(base, F.lit("-resp"))), first, 2)
    )
    messages = requests.select("path", "session_id", "source_seq", F.inline(pair))

    title = last_of(F.coalesce(F.when(seed, V.string(x, "$.customTitle")), F.when(titled, V.string(x))))
    born = F.max_by(V.integer(x, "$.creationDate"), F.when(seed, F.col("source_seq")))
    sessions = rows.groupBy("path", "session_id").agg(
        F.first("native").alias("native_id"), iso_of_millis(born).alias("started_at"), F.lit(None).cast("string").alias("ended_at"), title.alias("title")
    )
    models = requests.groupBy("path").agg(first_of(V.string(F.col("r"), "$.model"), "n").alias("model"), F.count("*").alias("requests"))
    sessions = sessions.join(models, "path", "left").withColumn("source", F.lit("copilot"))

    wrong = F.when(
        (patch == 1) & ~F.coalesce(titled, F.lit(False)), "unhandled_property_patch"
    ).when((patch == 2) & ~F.coalesce(appended, F.lit(False)), "unhandled_array_patch").when(patch.isNull() | ~patch.isin(0, 1, 2), "unknown_patch_kind")
    errata = rows.select("path", "source_seq", wrong.alias("kind"), key.alias("snippet")).where("kind is not null")
    none = sessions.where("requests is null").select(
        "path", F.lit(None).cast("long").alias("source_seq"), F.lit("empty_session").alias("kind"), F.col("native_id").alias("snippet")
    )
    gone = lost.select("path", F.lit(None).cast("long").alias("source_seq"), F.lit("parse_error").alias("kind"), F.lit("no sessionId").alias("snippet"))
    calls = rows.where("false").select("path")
    return finish(sessions, messages, calls, bad_lines(all_rows).unionByName(errata).unionByName(none).unionByName(gone))


def parse_transcript(lines: DataFrame, stage: Stage = staged) -> Parsed:
    v = F.col("v")
    good = V.is_object(v) & V.string(v, "$.type").isNotNull()
    kind, seq = F.col("type"), F.col("source_seq")
    all_rows = stage(judged(
        lines, good, V.string(v, "$.type").alias("type"), V.string(v, "$.sessionId").alias("sid"), V.integer(v, "$.timestamp").alias("ms"),
        V.get(v, "$.content").alias("said"), F.nullif(V.string(v, "$.model"), F.lit("")).alias("model"), V.string(v, "$.tool_name").alias("tool"),
        V.string(v, "$.tool_call_id").alias("call"), V.get(v, "$.result").alias("result")
    ), "transcript")
    message = kind.isin("user.message", "assistant.message")
    # the first start counts, with or without an id
    started = F.when(kind == "session.start", F.struct("sid"))
    rows = stage(along_file(good_lines(all_rows), {"start": First(started), "turn_number": Count(message)}), "transcript-turns")
    rows = rows.withColumn("native", F.col("start.sid")).drop("start")
    lost = rows.where("native is null").select("path").distinct()
    rows = rows.where("native is not null").withColumn("session_id", session_uuid(F.lit("copilot"), F.col("native")))
    letter = F.when(kind == "user.message", "u").otherwise("a")
    rows = rows.withColumn("uuid", F.when(message, child_uuid(F.col("session_id"), F.concat(letter, F.col("turn_number")))))
    rows = stage(along_file(rows, {
        "speaker": LastSoFar(F.when(kind == "assistant.message", F.col("uuid"))), "asker": LastSoFar(F.when(kind == "user.message", F.col("uuid")))
    }), "transcript-events")
    role = F.regexp_extract("type", r"^(\w+)\.", 1)
    messages = rows.where(message).select("path", "session_id", "uuid", role.alias("role"), _text(F.col("said")).alias("content"), "source_seq", "turn_number")
    sessions = rows.groupBy("path", "session_id").agg(
        F.first("native").alias("native_id"), iso_of_millis(first_of(F.col("ms"))).alias("started_at"), iso_of_millis(last_of(F.col("ms"))).alias("ended_at"),
        last_of(F.when(kind == "assistant.message", F.col("model"))).alias("model"), F.count_if(message).alias("said"),
        last_of(F.coalesce("speaker", "asker")).alias("last_said")
    )
    sessions = sessions.withColumn("source", F.lit("copilot"))

    # Calls: a start opens an id; a completion of an id that nothing has opened opens it too, if anyone has spoken.
    start, done = kind == "tool.execution_start", kind == "tool.execution_complete"
    tools = rows.where(start | done).withColumn(
        "call_id", F.coalesce(F.when(start, F.nullif(F.col("call"), F.lit(""))).otherwise(F.col("call")), F.col("source_seq").cast("string"))
    ).withColumn("who", F.coalesce("speaker", "asker"))
    before = Window.partitionBy("path", "call_id").orderBy("source_seq").rowsBetween(Window.unboundedPreceding, -1)
    tools = tools.withColumn("known", F.coalesce(F.max(start | F.col("who").isNotNull()).over(before), F.lit(False)))
    tools = tools.withColumn("orphan", done & ~F.col("known")).withColumn("opens", start | F.col("orphan") & F.col("who").isNotNull())
    tools = tools.withColumn("made", F.max(F.when(F.col("opens"), seq)).over(Window.partitionBy("path", "call_id")))
    request = F.coalesce("who", child_uuid(F.col("session_id"), F.concat(F.lit("tool-"), F.col("source_seq"))))
    iso = iso_of_millis(F.col("ms"))
    output = V.string(F.col("result"))
    made = tools.where(F.col("opens") & (seq == F.col("made"))).select(
        "path", "session_id", "call_id", "source_seq", request.alias("request_message"), F.coalesce("tool", F.lit("unknown")).alias("tool_name"),
        iso.alias("started_at"), F.when(F.col("orphan"), iso).alias("own_end"), F.when(F.col("orphan"), output).alias("own_output"),
        F.when(F.col("orphan"), F.col("who")).alias("own_response")
    )
    ended = tools.where(done & F.col("known") & (seq > F.col("made"))).groupBy("path", "call_id").agg(
        F.max_by(output, seq).alias("output"), F.max_by(iso, seq).alias("ended"), F.max_by("who", seq).alias("who"), F.count("*").alias("n")
    )
    joined = made.join(ended, ["path", "call_id"], "left").join(sessions.select("path", "last_said"), "path", "left")
    response = F.coalesce(F.when(F.col("n") > 0, F.col("who")), F.col("own_response"))
    calls = joined.select(
        "path", "session_id", "call_id", "source_seq", "request_message", "tool_name", "started_at", F.coalesce("ended", "own_end").alias("ended_at"),
        F.coalesce("output", "own_output").alias("tool_output"), F.coalesce(response, F.col("last_said")).alias("response_message"),
        response.isNull().alias("dangling"), child_uuid(F.col("session_id"), F.col("request_message"), F.col("call_id")).alias("uuid")
    )

    note = lambda df, where, name, snippet="call_id": df.where(where).select("path", "source_seq", F.lit(name).alias("kind"), F.col(snippet).alias("snippet"))
    errata = bad_lines(all_rows)
    for rows_ in (
        note(tools, start & F.col("speaker").isNull() & F.col("asker").isNotNull(), "tool_before_assistant"),
        note(tools, start & F.col("who").isNull(), "tool_before_any_message"),
        note(tools, done & F.col("known") & F.col("speaker").isNull() & F.col("asker").isNotNull(), "tool_response_no_assistant_msg"),
        note(tools, F.col("orphan"), "orphan_tool_complete"),
        note(calls, F.col("dangling"), "dangling_tool_start"),
        note(rows, ~message & ~start & ~done & (kind != "session.start"), "unknown_transcript_event", "type"),
        sessions.where("said = 0").select(
            "path", F.lit(None).cast("long").alias("source_seq"), F.lit("empty_session").alias("kind"), F.col("native_id").alias("snippet")
        ),
        lost.select("path", F.lit(None).cast("long").alias("source_seq"), F.lit("parse_error").alias("kind"), F.lit("no session.start").alias("snippet")),
    ):
        errata = errata.unionByName(rows_)
    return finish(sessions, messages, calls, errata)
