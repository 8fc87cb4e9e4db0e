"""Sessions, messages and parts in SQLite; data columns hold JSON."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.columns import child_uuid, iso_of_millis, session_uuid
from ..sources.sqlite import table_of
from ..scratch import staged
from . import Parsed, Stage, finish

SESSION = "id string, directory string, title string, time_created long, time_updated long, model string, tokens_input long, tokens_output long, tokens_cache_read long, tokens_cache_write long"
PASSED = ("file", "step-start", "step-finish", "compaction")


def parse(rows: DataFrame, stage: Stage = staged) -> Parsed:
    """Both sides of a join grow with the store, and Spark takes texts for short: so all are merged, none goes through the driver."""
    store = lambda name, schema: table_of(rows, "opencode", name, schema)
    base = store("session", SESSION).withColumn("path", F.concat_ws("#", "file", "id")).withColumn("session_id", session_uuid(F.lit("opencode"), F.col("id")))
    model = F.try_parse_json("model")
    sessions = base.select(
        "path", "session_id", F.lit("opencode").alias("source"), F.col("id").alias("native_id"), "title", iso_of_millis(F.col("time_created")).alias("started_at"), iso_of_millis(F.col("time_updated")).alias("ended_at"),
        V.string(model, "$.id").alias("model"), F.col("directory").alias("project_root"), F.col("tokens_input").alias("input_tokens"), F.col("tokens_output").alias("output_tokens"), F.col("tokens_cache_read").alias("cache_read_tokens"), F.col("tokens_cache_write").alias("cache_write_tokens"),
    )
    none = F.lit(None).cast("long")
    fault = lambda df, kind, snippet, seq=none: df.select(
        "path", seq.alias("source_seq"), F.lit(kind).alias("kind"), F.substring(snippet, 1, 500).alias("snippet")
    )
    errata = fault(base.where(F.col("model").isNotNull() & model.isNull()), "parse_error", F.col("model"))

    kept = base.select("path", "session_id", F.col("file").alias("f"), F.col("id").alias("native"))
    messages = store("message", "id string, session_id string, time_created long, data string").withColumnRenamed("session_id", "of")
    messages = messages.join(kept.hint("merge"), (F.col("file") == F.col("f")) & (F.col("of") == F.col("native"))).drop("f", "native", "of")
    order = Window.partitionBy("path").orderBy("time_created", "id")
    messages = messages.withColumn("source_seq", F.row_number().over(order).cast("long")).withColumn("v", F.try_parse_json("data"))
    messages = stage(messages, "opencode-messages")
    errata = errata.unionByName(fault(messages.where("v is null"), "parse_error", F.col("data"), F.col("source_seq")))
    role = F.coalesce(V.string(F.col("v"), "$.role"), F.lit("unknown"))
    turns = messages.withColumn("role", role).where(F.col("v").isNotNull() & F.col("role").isin("user", "assistant"))
    turns = turns.withColumn("turn_number", F.row_number().over(order).cast("long")).withColumn("uuid", child_uuid(F.col("session_id"), F.col("id")))

    parts = store(
        "part", "id string, message_id string, time_created long, data string"
    ).withColumnRenamed("id", "part").withColumnRenamed("time_created", "part_time").withColumnRenamed("file", "part_file").withColumnRenamed("data", "part_data")
    joined = turns.select("path", "file", "session_id", "id", "uuid", "source_seq").join(
        parts.hint("merge"), (F.col("file") == F.col("part_file")) & (F.col("id") == F.col("message_id"))
    ).withColumn("p", F.try_parse_json("part_data"))
    joined = stage(joined, "opencode-parts")
    errata = errata.unionByName(fault(joined.where("p is null"), "parse_error", F.col("part_data"), F.col("source_seq")))
    p = F.col("p")
    joined = joined.where("p is not null").withColumn("type", F.coalesce(V.string(p, "$.type"), F.lit("unknown")))
    place = F.struct("part_time", "part")
    text = lambda kind: V.joined(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("part_time", "part", V.string(p, "$.text").alias("text"))))), lambda x: x["text"]
        )
    )
    said = joined.groupBy(F.col("uuid").alias("u")).agg(text("text").alias("content"), text("reasoning").alias("thinking"))
    assistant = F.col("role") == "assistant"
    v = F.col("v")
    out = turns.join(said.hint("merge"), F.col("uuid") == F.col("u"), "left").select(
        "path", "uuid", "role", "content", "thinking", "source_seq", "turn_number", F.when(
            assistant, child_uuid(F.col("session_id"), V.string(v, "$.parentID"))
        ).alias("parent_uuid"),
        F.when(assistant, V.integer(v, "$.tokens.input")).alias("input_tokens"), F.when(assistant, V.integer(v, "$.tokens.output")).alias("output_tokens"),
    )

    tools = joined.where(F.col("type") == "tool").withColumn("call_id", F.coalesce(V.string(p, "$.callID"), F.lit("unknown")))
    tools = tools.withColumn("n", F.row_number().over(Window.partitionBy("path", "id", "call_id").orderBy(place)))
    status = V.string(p, "$.state.status")
    first = tools.where("n = 1")
    calls = first.select(
        "path", "call_id", "source_seq", child_uuid(
            F.col("session_id"), F.col("uuid"), F.col("call_id")
        ).alias("uuid"), F.col("uuid").alias("request_message"), F.col("uuid").alias("response_message"),
        F.coalesce(V.string(p, "$.tool"), F.lit("unknown")).alias("tool_name"), V.json(p, "$.state.input").alias("tool_input"), V.string(p, "$.state.output").alias("tool_output"),
        F.when(status == "error", True).when(status == "completed", False).alias("is_error"), iso_of_millis(V.integer(p, "$.state.time.start")).alias("started_at"), iso_of_millis(V.integer(p, "$.state.time.end")).alias("ended_at"),
    )
    for extra in (
        fault(tools.where("n > 1"), "duplicate_tool_call", F.col("call_id"), F.col("source_seq")),
        fault(first.where(status == "running"), "incomplete_tool_call", F.col("call_id"), F.col("source_seq")),
        fault(joined.where(~F.col("type").isin("text", "reasoning", "tool", *PASSED)), "unknown_part_type", F.col("type"), F.col("source_seq")),
        fault(sessions.join(out.select("path").distinct().hint("merge"), "path", "left_anti"), "empty_session", F.col("native_id")),
    ):
        errata = errata.unionByName(extra)
    return finish(sessions, out, calls, errata)
