"""One event a line, strictly typed: an event that isn't of the right shape is an erratum."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.columns import child_uuid, session_uuid
from ..scratch import staged
from . import Count, First, Parsed, Stage, along_file, bad_lines, finish, first_of, good_lines, judged, last_of

REQUIRED = ("uuid", "type", "timestamp", "sessionId", "version", "cwd")
TITLES = ("custom-title", "ai-title")


def _optional(v: Column, path: str, good) -> Column:
    x = V.get(v, path)
    return V.is_null(x) | good(x)


def _is_result(x: Column) -> Column:
    parts = V.array(x)
    return V.is_string(x) | F.coalesce(F.forall(parts, lambda p: V.string(p, "$.text").isNotNull()), F.lit(False))


def _is_block(b: Column) -> Column:
    kind = V.string(b, "$.type")
    named = V.string(b, "$.id").isNotNull() & V.string(b, "$.name").isNotNull() & V.get(b, "$.input").isNotNull()
    answered = V.string(b, "$.tool_use_id").isNotNull() & _is_result(V.get(b, "$.content"))
    fine = F.when(kind == "text", V.string(b, "$.text").isNotNull()).when(kind == "thinking", V.string(b, "$.thinking").isNotNull())
    fine = fine.when(kind == "tool_use", named).when(kind == "tool_result", answered).otherwise(F.lit(True))
    return kind.isNotNull() & fine


def _is_event(v: Column) -> Column:
    good = V.is_object(v)
    for name in REQUIRED:
        good = good & V.string(v, f"$.{name}").isNotNull()
    content = lambda x: V.is_string(x) | F.coalesce(F.forall(V.array(x), _is_block), F.lit(False))
    good = good & _optional(v, "$.message", V.is_object) & _optional(v, "$.message.content", content) & _optional(v, "$.message.usage", V.is_object)
    for name in ("parentUuid", "gitBranch", "message.model"):
        good = good & _optional(v, f"$.{name}", V.is_string)
    return good


def _result_text(b: Column) -> Column:
    content = V.get(b, "$.content")
    return F.coalesce(V.string(content), F.array_join(F.transform(V.array(content), lambda p: V.string(p, "$.text")), "\n"))


def parse(lines: DataFrame, stage: Stage = staged) -> Parsed:
    v = F.col("v")
    usage = lambda name: F.coalesce(V.integer(v, f"$.message.usage.{name}"), F.lit(0))
    rows = stage(judged(
        lines, _is_event(v),
        V.string(v, "$.uuid").alias("event"), V.string(v, "$.type").alias("type"), V.string(v, "$.timestamp").alias("at"), V.string(v, "$.sessionId").alias("native"),
        V.string(v, "$.cwd").alias("cwd"), V.string(v, "$.version").alias("version"), V.string(v, "$.parentUuid").alias("parent_uuid"), F.nullif(V.string(v, "$.gitBranch"), F.lit("")).alias("branch"),
        V.string(v, "$.message.model").alias("model"), V.string(v, "$.message.content").alias("text"), V.array(v, "$.message.content").alias("blocks"), (~V.is_null(V.get(v, "$.message.usage"))).alias("has_usage"),
        usage("input_tokens").alias("u_in"), usage("output_tokens").alias("u_out"), usage("cache_read_input_tokens").alias("u_read"), usage("cache_creation_input_tokens").alias("u_write"),
    ), "claude")
    spoken = F.col("type").isin("user", "assistant")
    events = along_file(good_lines(rows), {"first_native": First(F.col("native")), "turn_number": Count(spoken)})
    events = stage(events.withColumn("session_id", session_uuid(F.lit("claude"), F.col("first_native"))).drop("first_native"), "claude-events")
    counted = ~F.col("type").isin(*TITLES, "system")
    total = lambda name: F.sum(F.when(counted, F.col(name))).alias
    sessions = events.groupBy("path", "session_id").agg(
        F.min_by("native", "source_seq").alias("native_id"), F.min_by("at", "source_seq").alias("started_at"), F.max_by("at", "source_seq").alias("ended_at"),
        F.min_by("cwd", "source_seq").alias("project_root"), F.min_by("version", "source_seq").alias("tool_version"), last_of(F.col("branch")).alias("git_branch"),
        last_of(F.when(F.col("type").isin(*TITLES), F.col("text"))).alias("title"), first_of(F.when(counted, F.col("model"))).alias("model"),
        total("u_in")("input_tokens"), total("u_out")("output_tokens"), total("u_read")("cache_read_tokens"), total("u_write")("cache_write_tokens"),
    ).withColumn("source", F.lit("claude"))

    turns = events.where(spoken).withColumns({"uuid": child_uuid(F.col("session_id"), F.col("event")), "role": F.col("type")})
    user = F.col("role") == "user"
    said = F.transform(
        "blocks",
        lambda b: F.when(V.string(b, "$.type") == "text", V.string(b, "$.text")).when(user & (V.string(b, "$.type") == "tool_result"), _result_text(b))
    )
    thought = F.transform("blocks", lambda b: F.when(V.string(b, "$.type") == "thinking", V.string(b, "$.thinking")))
    messages = turns.select(
        "path", "session_id", "uuid", "parent_uuid", "role", "source_seq", "turn_number", F.coalesce("text", V.joined(said)).alias("content"), F.when(~user, V.joined(thought)).alias("thinking"),
        F.when(user & F.col("has_usage"), F.col("u_in")).alias("input_tokens"), F.when(~user & F.col("has_usage"), F.col("u_out")).alias("output_tokens"),
    )

    blocks = turns.select("path", "session_id", "source_seq", "uuid", "role", "at", F.posexplode("blocks").alias("place", "b"))
    order = F.struct("source_seq", "place")
    uses = blocks.where((F.col("role") == "assistant") & (V.string(F.col("b"), "$.type") == "tool_use")).withColumn("call_id", V.string(F.col("b"), "$.id"))
    last = F.row_number().over(Window.partitionBy("path", "call_id").orderBy(F.desc("source_seq"), F.desc("place")))
    uses = uses.withColumn("n", last).where("n = 1").select(
        "path", "session_id", "call_id", "source_seq", order.alias("asked"), F.col("uuid").alias("request_message"), F.col("at").alias("started_at"),
        V.string(F.col("b"), "$.name").alias("tool_name"), V.json(F.col("b"), "$.input").alias("tool_input")
    )
    results = blocks.where((F.col("role") == "user") & (V.string(F.col("b"), "$.type") == "tool_result"))
    results = results.select(
        "path", V.string(F.col("b"), "$.tool_use_id").alias("call_id"), order.alias("answered"),
        F.struct(
            F.col("uuid").alias("response_message"), _result_text(F.col("b")).alias("tool_output"), V.boolean(F.col("b"), "$.is_error").alias("is_error")
        ).alias("r")
    )
    met = uses.join(results, ["path", "call_id"], "left").where(F.col("answered").isNull() | (F.col("answered") > F.col("asked")))
    latest = met.groupBy("path", "call_id").agg(F.max_by("r", "answered").alias("r"))
    calls = uses.join(latest, ["path", "call_id"], "left").select(
        "path", "session_id", "call_id", "source_seq", "request_message", "started_at", "tool_name", "tool_input", "r.response_message", "r.tool_output", "r.is_error",
        child_uuid(F.col("session_id"), F.col("request_message"), F.col("call_id")).alias("uuid")
    )

    unknown = events.where(~F.col("type").isin("user", "assistant", "system", *TITLES)).select(
        "path", "source_seq", F.lit("unknown_event_kind").alias("kind"), F.col("type").alias("snippet")
    )
    return finish(sessions, messages, calls, bad_lines(rows).unionByName(unknown))
