"""Sessions and messages in SQLite; calls are asked for in messages of the assistant and answered, first in first out, by
tool messages, which are no messages of their own."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.columns import child_uuid, iso_of_seconds, session_uuid
from ..operators.pairing import first_in_first_out
from ..sources.sqlite import table_of
from ..scratch import staged
from . import Parsed, Stage, finish

SESSION = "id string, source string, model string, parent_session_id string, started_at double, ended_at double, title string, cwd string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long"
MESSAGE = "id long, session_id string, role string, content string, tool_call_id string, tool_calls string, reasoning_content string, timestamp double"


def parse(rows: DataFrame, stage: Stage = staged) -> Parsed:
    store = lambda name, schema: table_of(rows, "hermes", name, schema)
    base = store("session", SESSION).withColumn("path", F.concat_ws("#", "file", "id")).withColumn("native_id", F.concat_ws(":", "source", "id"))
    every = store("every", "id string, source string").select(
        F.col("file").alias("pf"), F.col("id").alias("pid"), F.concat_ws(":", "source", "id").alias("parent_native")
    )
    base = base.join(
        every, (F.col("file") == F.col("pf")) & (F.col("parent_session_id") == F.col("pid")), "left"
    ).withColumn("session_id", session_uuid(F.lit("hermes"), F.col("native_id")))
    sessions = base.select(
        "path", "session_id", F.lit("hermes").alias("source"), "native_id", "title", "model", F.nullif("cwd", F.lit("")).alias("project_root"), iso_of_seconds(F.col("started_at")).alias("started_at"), iso_of_seconds(F.col("ended_at")).alias("ended_at"),
        session_uuid(F.lit("hermes"), F.col("parent_native")).alias("parent_session_id"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    )
    kept = base.select("path", F.col("session_id").alias("sid"), F.col("file").alias("f"), F.col("id").alias("native"))
    messages = store("message", MESSAGE).join(kept, (F.col("file") == F.col("f")) & (F.col("session_id") == F.col("native"))).drop("session_id")
    order = Window.partitionBy("path").orderBy("id")
    messages = stage(messages.withColumn("source_seq", F.row_number().over(order).cast("long")), "hermes-messages")
    turns = messages.where(F.col("role").isin("user", "assistant")).withColumn("turn_number", F.row_number().over(order).cast("long")).withColumn(
        "uuid", child_uuid(F.col("sid"), F.col("id").cast("string"))
    )
    assistant = F.col("role") == "assistant"
    out = turns.select(
        "path", "uuid", "role", "source_seq", "turn_number", F.nullif("content", F.lit("")).alias("content"),
        F.when(assistant, F.nullif("reasoning_content", F.lit(""))).alias("thinking")
    )

    asked = turns.where(assistant & F.col("tool_calls").isNotNull()).withColumn("v", F.try_parse_json("tool_calls"))
    c = F.col("c")
    call_id = F.coalesce(V.string(c, "$.call_id"), V.string(c, "$.id"), F.lit("unknown"))
    requests = asked.select("path", "sid", "uuid", "source_seq", "timestamp", F.posexplode(V.array(F.col("v"))).alias("place", "c")).select(
        "path", "source_seq", call_id.alias("call_id"), F.col("uuid").alias("request_message"), child_uuid(F.col("sid"), F.col("uuid"), call_id).alias("uuid"), F.struct("source_seq", "place").alias("order"),
        F.coalesce(
            V.string(c, "$.function.name"), F.lit("unknown")
        ).alias("tool_name"), V.string(c, "$.function.arguments").alias("tool_input"), iso_of_seconds(F.col("timestamp")).alias("started_at"),
    )
    answers = messages.where((F.col("role") == "tool") & F.col("tool_call_id").isNotNull())
    answers = answers.select(
        "path", "source_seq", F.col("tool_call_id").alias("call_id"), F.struct("source_seq", F.lit(0).alias("place")).alias("order"), "content",
        iso_of_seconds(F.col("timestamp")).alias("ended_at")
    )
    both = requests.select("path", "call_id", "order", "source_seq", F.lit(True).alias("opens")).unionByName(
        answers.select("path", "call_id", "order", "source_seq", "content", "ended_at", F.lit(False).alias("opens")), allowMissingColumns=True
    )
    paired = stage(first_in_first_out(stage(both, "hermes-calls"), ["path", "call_id"], "order", "opens"), "hermes-paired")
    content = F.try_parse_json("content")
    code = V.integer(content, "$.exit_code")
    wrong = F.when(V.is_object(content) & ~V.is_null(V.get(content, "$.error")), True).when(code.isNotNull(), code != 0)
    given = paired.where("opened_by is not null").select(
        F.col("path").alias("ap"), F.col("call_id").alias("ac"), F.col("opened_by"), F.nullif("content", F.lit("")).alias("tool_output"),
        wrong.alias("is_error"), "ended_at"
    )
    calls = requests.join(
        given, (F.col("path") == F.col("ap")) & (F.col("call_id") == F.col("ac")) & (F.col("order") == F.col("opened_by")), "left"
    ).drop("ap", "ac", "opened_by", "order")

    fault = lambda df, kind, snippet: df.select(
        "path", F.col("source_seq") if "source_seq" in df.columns else F.lit(None).cast("long").alias("source_seq"), F.lit(kind).alias("kind"),
        F.substring(snippet, 1, 500).alias("snippet")
    )
    errata = fault(asked.where(~V.is_array(F.col("v"))), "parse_error", F.col("tool_calls"))
    for extra in (
        fault(paired.where("waiting > 1 and opened_by is not null"), "duplicate_call_id", F.col("call_id")),
        fault(paired.where("opened_by is null"), "orphaned_tool_response", F.col("call_id")),
        fault(messages.where(~F.col("role").isin("user", "assistant", "tool", "session_meta")), "unknown_role", F.col("role")),
        fault(calls.where("ended_at is null"), "unresolved_tool_call", F.col("call_id")),
        fault(sessions.join(out.select("path").distinct(), "path", "left_anti"), "empty_session", F.col("native_id")),
    ):
        errata = errata.unionByName(extra)
    return finish(sessions, out, calls, errata)
