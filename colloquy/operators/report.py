"""Usage reports: one filtered set of sessions, and what belongs to them, counted in several ways.

Every function takes sessions already filtered by `in_scope`; counts from messages and tool calls are grouped by session
before they meet sessions, so what is joined has at most a row a session.
"""

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .periods import Period

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
TOP = 10


def total_tokens():
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in TOKENS[1:]), F.coalesce(F.col(TOKENS[0]), F.lit(0)))


@dataclass(frozen=True)
class Scope:
    project: str | None = None
    source: str | None = None

    @property
    def label(self) -> str:
        parts = [f"{k}:{v}" for k, v in (("project", self.project), ("source", self.source)) if v is not None]
        return ";".join(parts) or "global"


def in_scope(sessions: DataFrame, period: Period, scope: Scope = Scope()) -> DataFrame:
    found = sessions.where(period.holds(F.col("started_ts")))
    if scope.project is not None:
        found = found.where(F.col("project_slug") == scope.project)
    return found if scope.source is None else found.where(F.col("source") == scope.source)


def is_empty(sessions: DataFrame) -> bool:
    return sessions.limit(1).isEmpty()


def totals(sessions: DataFrame) -> DataFrame:
    """One row. Sums of nothing are 0, but cost is null where no session has one, and so is the mean duration."""
    seconds = (F.unix_micros("ended_ts") - F.unix_micros("started_ts")) / 1e6
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in TOKENS]
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        *sums,
        F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("total_tokens"),
        F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_count"),
        F.count_distinct("model").alias("unique_models"),
        F.avg(seconds).alias("avg_session_duration_seconds"),
    )


def of_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    return rows.join(sessions.select("session_id"), "session_id", "left_semi")


def messages_by_role(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return of_sessions(messages, sessions).groupBy("role").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "role")


def tool_call_count(sessions: DataFrame, tool_calls: DataFrame) -> DataFrame:
    return of_sessions(tool_calls, sessions).agg(F.count("*").alias("tool_call_count"))


def top_tools(sessions: DataFrame, tool_calls: DataFrame, limit: int = TOP) -> DataFrame:
    return of_sessions(tool_calls, sessions).groupBy("tool_name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tool_name").limit(limit)


def _use(sessions: DataFrame, by: str, name: str) -> DataFrame:
    grouped = sessions.groupBy(F.col(by).alias(name))
    return grouped.agg(
        F.count("*").alias("session_count"), F.sum(total_tokens()).alias("total_tokens")
    ).orderBy(F.desc("session_count"), F.coalesce(name, F.lit("")))


def top_projects(sessions: DataFrame, limit: int = TOP) -> DataFrame:
    """Sessions without a project are a group of their own, with a null slug."""
    return _use(sessions, "project_slug", "slug").limit(limit)


def source_breakdown(sessions: DataFrame) -> DataFrame:
    return _use(sessions, "source", "source")


def with_counts(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Sessions with the numbers of their messages and tool calls."""
    out = sessions.drop("message_count", "tool_call_count")
    for rows, name in ((messages, "message_count"), (tool_calls, "tool_call_count")):
        out = out.join(rows.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def daily_breakdown(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """All counts belong to the day on which the session started; days without sessions are left out."""
    counted = with_counts(sessions, messages, tool_calls)
    return counted.groupBy(F.to_date("started_ts").alias("date")).agg(
        F.count("*").alias("session_count"), F.sum("message_count").alias("message_count"), F.sum("tool_call_count").alias("tool_call_count"),
        F.sum(total_tokens()).alias("total_tokens")
    ).orderBy("date")


#: What a vault keeps of the rollup; the day is the partition.
ROLLUP = (
    "source string, project string, session_count long, message_count long, tool_call_count long, input_tokens long, output_tokens long, "
    "cache_read_tokens long, cache_write_tokens long, total_tokens long, estimated_cost_usd double, date date"
)


def usage_rollup(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """A row for each day, source and project (null: none)."""
    counted = with_counts(sessions, messages, tool_calls)
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in TOKENS]
    return counted.groupBy(F.to_date("started_ts").alias("date"), "source", F.col("project_slug").alias("project")).agg(
        F.count_distinct("session_id").alias("session_count"), F.sum("message_count").alias("message_count"), F.sum("tool_call_count").alias("tool_call_count"),
        *sums, F.sum(total_tokens()).alias("total_tokens"), F.sum("estimated_cost_usd").alias("estimated_cost_usd")
    )


def merge_rollup(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same key; a missing project is a key like any other."""
    stays = old.alias("o").join(new.select("date", "source", "project").alias("n"), key_of("o", "n"), "left_anti")
    return stays.unionByName(new)


def key_of(a: str, b: str):
    same = F.col(f"{a}.project").eqNullSafe(F.col(f"{b}.project")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    return (F.col(f"{a}.date") == F.col(f"{b}.date")) & same


# The fields of a report's document, with their values where there is nothing, and the labels of its text.
EMPTY = {
    "total_sessions": 0, "total_input_tokens": 0, "total_output_tokens": 0, "total_cache_read_tokens": 0, "total_cache_write_tokens": 0, "total_tokens": 0, "estimated_cost_usd": None,
    "message_count": 0, "messages_by_role": [], "tool_call_count": 0, "top_tools": [], "error_count": 0, "unique_models": 0, "avg_session_duration_seconds": None, "top_projects": [], "daily_breakdown": [], "sources": [],
}


#: What grouping_id says of the sections over (project, source, day): bits of the keys that are left out.
WHOLE, BY_PROJECT, BY_SOURCE, BY_DAY = 7, 3, 5, 6


def sections(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame, limit: int = TOP) -> DataFrame:
    """All that is counted by session, in one pass: a row for the whole, for each source, for each day, and for each of the `limit`
    projects with most sessions. section is WHOLE, BY_PROJECT, BY_SOURCE or BY_DAY; keys of other sections are null."""
    seconds = (F.unix_micros("ended_ts") - F.unix_micros("started_ts")) / 1e6
    rows = with_counts(sessions, messages, tool_calls).select(
        F.col("project_slug").alias("project"), "source", F.to_date("started_ts").alias("date"), *TOKENS, total_tokens().alias("tokens"), "estimated_cost_usd",
        "error_count", "model", seconds.alias("seconds"), "message_count", "tool_call_count"
    )
    keys = [F.col("project"), F.col("source"), F.col("date")]
    found = rows.groupingSets([[], [keys[0]], [keys[1]], [keys[2]]], *keys).agg(
        F.grouping_id().cast("int").alias("section"), F.count("*").alias("session_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in TOKENS],
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("error_count"), F.count_distinct("model").alias("unique_models"),
        F.avg("seconds").alias("avg_session_duration_seconds"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"),
        F.coalesce(F.sum("tool_call_count"), F.lit(0)).alias("tool_call_count")
    )
    top = found.where(F.col("section") == BY_PROJECT).orderBy(F.desc("session_count"), F.coalesce("project", F.lit(""))).limit(limit)
    return found.where(F.col("section") != BY_PROJECT).unionByName(top)


def names(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame, limit: int = TOP) -> DataFrame:
    """kind, name and count of all roles of messages and of the `limit` tools that are called most."""
    rows = messages.select("session_id", F.lit("role").alias("kind"), F.col("role").alias("name")).unionByName(
        tool_calls.select("session_id", F.lit("tool").alias("kind"), F.col("tool_name").alias("name"))
    )
    found = of_sessions(rows, sessions).groupBy("kind", "name").agg(F.count("*").alias("count"))
    top = found.where("kind = 'tool'").orderBy(F.desc("count"), "name").limit(limit)
    return found.where("kind = 'role'").unionByName(top)


def metrics(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> dict:
    """All figures of a report, from two plans. What is collected are a few rows: roles, sources, days and two lists of ten."""
    found = [r.asDict() for r in sections(sessions, messages, tool_calls).collect()]
    named = sorted((r.asDict() for r in names(sessions, messages, tool_calls).collect()), key=lambda r: (-r["count"], r["name"] is not None, r["name"]))
    of = lambda section: [r for r in found if r["section"] == section]
    use = lambda rows, key, name: [
        {name: r[key], "session_count": r["session_count"], "total_tokens": r["total_tokens"]} for r in sorted(rows, key=lambda r: (-r["session_count"], r[key] or ""))
    ]
    out = dict(EMPTY)
    for whole in of(WHOLE):
        out |= {k: v for k, v in whole.items() if k in EMPTY} | {"total_sessions": whole["session_count"]}
    out["messages_by_role"] = [{"role": r["name"], "count": r["count"]} for r in named if r["kind"] == "role"]
    out["top_tools"] = [{"tool_name": r["name"], "count": r["count"]} for r in named if r["kind"] == "tool"]
    out["top_projects"], out["sources"] = use(of(BY_PROJECT), "project", "slug"), use(of(BY_SOURCE), "source", "source")
    days = ("session_count", "message_count", "tool_call_count", "total_tokens")
    out["daily_breakdown"] = [{"date": r["date"].isoformat()} | {k: r[k] for k in days} for r in sorted(of(BY_DAY), key=lambda r: r["date"])]
    return {k: out[k] for k in EMPTY}


def document(period: Period, scope: Scope, generated_at: str, figures: dict, from_cache: bool = False) -> dict:
    return {
        "scope": scope.label, "period_kind": period.kind, "period_start": period.start.isoformat(), "period_end": period.end.isoformat(),
        "generated_at": generated_at, "from_cache": from_cache, "metrics": figures
    }


def render_json(doc: dict) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False)


def _section(title: str, lines: list[str]) -> list[str]:
    return ["", f"## {title}", *(lines or ["_(none)_"])]


def render_markdown(doc: dict) -> str:
    m = doc["metrics"]
    cost = "no data" if m["estimated_cost_usd"] is None else f"${m['estimated_cost_usd']:.2f}"
    mean = m["avg_session_duration_seconds"]
    channels = " ".join(f"{name}={m[f'total_{column}']}" for name, column in zip(("in", "out", "cache_r", "cache_w"), TOKENS))
    use = lambda r: f"{r['session_count']} sessions, {r['total_tokens']} tokens"
    days = [f"| {d['date']} | {d['session_count']} | {d['message_count']} | {d['tool_call_count']} | {d['total_tokens']} |" for d in m["daily_breakdown"]]
    head = ["| date       | sessions | messages | tools | tokens |", "|------------|----------|----------|-------|--------|"]
    lines = [
        f"# Usage Report — {doc['scope']}", "", f"- **Period:** {doc['period_kind']} ({doc['period_start']} → {doc['period_end']})",
        f"- **Generated:** {doc['generated_at']}", f"- **Source:** {'cached' if doc['from_cache'] else 'fresh'}"
    ]
    lines += _section(
        "Totals",
        [
            f"- Sessions: {m['total_sessions']}", f"- Tokens: {channels} total={m['total_tokens']}", f"- Estimated cost: {cost}",
            f"- Messages: {m['message_count']}", f"- Tool calls: {m['tool_call_count']}", f"- Errors: {m['error_count']}",
            f"- Unique models: {m['unique_models']}", f"- Avg session duration: {'n/a' if mean is None else f'{mean:.0f}s'}"
        ]
    )
    lines += _section("Messages by role", [f"- {r['role']}: {r['count']}" for r in m["messages_by_role"]])
    lines += _section("Top tools", [f"{k}. {r['tool_name']} — {r['count']}" for k, r in enumerate(m["top_tools"], 1)])
    lines += _section("Top projects", [f"{k}. {r['slug'] or 'unknown'} — {use(r)}" for k, r in enumerate(m["top_projects"], 1)])
    lines += _section("Sources", [f"- {r['source']} — {use(r)}" for r in m["sources"]])
    lines += _section("Daily breakdown", head + days if days else [])
    return "\n".join(lines) + "\n"
