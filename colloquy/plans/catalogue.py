"""Every query of the engine by name, and its SQL where SQL can express it."""

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import child_uuid, embed_text, iso_of_millis, iso_of_seconds, session_uuid, snippet
from ..functions.porter import stem
from ..operators import embedding, export, fulltext, projects, report, vectors
from ..operators.periods import Period, Recency, period, recency
from ..scratch import staged
from . import derived
from .round_trips import ROUND_TRIPS
from .stores import STORES

NOW = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
WHOLE = Period("custom", date(2024, 1, 1), date(2024, 1, 30))

# Shared SQL ------------------------------------------------------------------------------------------------------------

EVENTS = "e AS (SELECT *, CAST(user_id AS VARCHAR) || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id FROM events)"
_TOKEN = "CAST(sum(CASE WHEN event_type = '{}' THEN floor(value) ELSE 0 END) AS BIGINT) AS {}"
SESSIONS = f"""{EVENTS}, s AS (
  SELECT session_id, 'source' || CAST(user_id % 5 AS VARCHAR) AS source, CASE WHEN user_id % 7 <> 0 THEN 'project' || CAST(user_id % 20 AS VARCHAR) END AS project_slug,
         'model' || CAST(user_id % 3 AS VARCHAR) AS model, min(ts) AS started_ts, max(ts) AS ended_ts, count(*) FILTER (WHERE event_type = 'error') AS error_count,
         {', '.join(_TOKEN.format(kind, name) for kind, name in derived.CHANNELS.items())}
  FROM e GROUP BY session_id, user_id),
t AS (SELECT *, CAST(started_ts AS DATE) AS dd, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens AS total_tokens FROM s),
m AS (SELECT session_id, event_type AS role FROM e WHERE event_type IN ('view', 'click', 'signup')),
k AS (SELECT session_id, event_type AS tool_name FROM e WHERE event_type IN ('purchase', 'error')),
mc AS (SELECT session_id, count(*) AS n FROM m GROUP BY session_id), kc AS (SELECT session_id, count(*) AS n FROM k GROUP BY session_id),
c AS (SELECT t.*, coalesce(mc.n, 0) AS message_count, coalesce(kc.n, 0) AS tool_call_count FROM t LEFT JOIN mc USING (session_id) LEFT JOIN kc USING (session_id))"""


def _days(first: str = "2024-01-01", last: str = "2024-01-30", more: str = "") -> str:
    return f"dd BETWEEN DATE '{first}' AND DATE '{last}'{more}"


def _totals_sql(where: str) -> str:
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS total_{c}" for c in report.TOKENS)
    return f"""WITH {SESSIONS} SELECT count(*) AS total_sessions, {sums}, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(NULL AS DOUBLE) AS estimated_cost_usd,
      CAST(coalesce(sum(error_count), 0) AS BIGINT) AS error_count, count(DISTINCT model) AS unique_models, round(avg((epoch_us(ended_ts) - epoch_us(started_ts)) / 1e6), 3) AS avg_session_duration_seconds FROM t WHERE {where}"""


# Reports ---------------------------------------------------------------------------------------------------------------


class _Base:
    def __init__(self, spark: SparkSession, sf_dir: str, when: Period = WHOLE, scope: report.Scope = report.Scope()):
        self.sessions = report.in_scope(derived.sessions(spark, sf_dir, when), when, scope)
        self.messages, self.tool_calls = derived.messages(spark, sf_dir, when), derived.tool_calls(spark, sf_dir, when)


def _totals(spark, sf_dir, when=WHOLE, scope=report.Scope()) -> DataFrame:
    return report.totals(_Base(spark, sf_dir, when, scope).sessions).withColumn("avg_session_duration_seconds", F.round("avg_session_duration_seconds", 3))


def report_totals(spark, sf_dir):
    return _totals(spark, sf_dir)


def report_totals_filtered(spark, sf_dir):
    return _totals(spark, sf_dir, scope=report.Scope("project3", "source3"))


def messages_by_role(spark, sf_dir):
    base = _Base(spark, sf_dir)
    return report.messages_by_role(base.sessions, base.messages)


def tool_call_total(spark, sf_dir):
    base = _Base(spark, sf_dir)
    return report.tool_call_count(base.sessions, base.tool_calls)


def top_tools(spark, sf_dir):
    base = _Base(spark, sf_dir)
    return report.top_tools(base.sessions, base.tool_calls)


def top_projects(spark, sf_dir):
    return report.top_projects(_Base(spark, sf_dir).sessions)


def source_breakdown(spark, sf_dir):
    return report.source_breakdown(_Base(spark, sf_dir).sessions)


def daily_breakdown(spark, sf_dir):
    base = _Base(spark, sf_dir)
    return report.daily_breakdown(base.sessions, base.messages, base.tool_calls)


def report_sections(spark, sf_dir):
    base = _Base(spark, sf_dir)
    kept = ("section", "project", "source", "date", "session_count", "total_tokens", "message_count", "tool_call_count", "error_count", "unique_models")
    return report.sections(base.sessions, base.messages, base.tool_calls).select(*kept)


def report_names(spark, sf_dir):
    base = _Base(spark, sf_dir)
    return report.names(base.sessions, base.messages, base.tool_calls)


def usage_rollup(spark, sf_dir):
    base = _Base(spark, sf_dir)
    return report.usage_rollup(base.sessions, base.messages, base.tool_calls)


def usage_rollup_upsert(spark, sf_dir):
    """The rollup of the whole month, then that of its last week merged in twice: nothing changes."""
    month, week = _Base(spark, sf_dir), _Base(spark, sf_dir, period("weekly", NOW))
    new = report.usage_rollup(week.sessions, week.messages, week.tool_calls)
    once = report.merge_rollup(report.usage_rollup(month.sessions, month.messages, month.tool_calls), new)
    return report.merge_rollup(once, new)


def _period_query(kind: str, **days):
    return lambda spark, sf_dir: _totals(spark, sf_dir, period(kind, NOW, **days))


def avg_session_duration(spark, sf_dir):
    return _totals(spark, sf_dir).select("avg_session_duration_seconds")


def unique_models(spark, sf_dir):
    return _totals(spark, sf_dir).select("unique_models")


def scope_empty(spark, sf_dir):
    """Whether scopes hold any session; existence stops at the first row."""
    base = derived.sessions(spark, sf_dir)
    scopes = {"all": report.Scope(), "unknown": report.Scope("no-such-project")}
    rows = [(name, report.is_empty(report.in_scope(base, WHOLE, scope))) for name, scope in scopes.items()]
    return spark.createDataFrame(rows, "scope string, is_empty boolean")


def semi_join_counts(spark, sf_dir):
    base = _Base(spark, sf_dir, scope=report.Scope(source="source2"))
    day = base.sessions.select("session_id", F.to_date("started_ts").alias("date"))
    counted = report.of_sessions(base.messages, base.sessions).groupBy("session_id").agg(F.count("*").alias("n"))
    return day.join(counted, "session_id").groupBy("date").agg(F.sum("n").alias("message_count"))


def preagg_left_join(spark, sf_dir):
    base = _Base(spark, sf_dir)
    return report.with_counts(base.sessions, base.messages, base.tool_calls).select("session_id", "message_count", "tool_call_count")


# Search ----------------------------------------------------------------------------------------------------------------


def _texts(spark, sf_dir) -> DataFrame:
    return derived.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project"), F.col("text").alias("content"))


def _grep(pattern: str, project: str | None = None):
    def run(spark, sf_dir):
        rows = fulltext.token_table(_texts(spark, sf_dir).withColumn("snippet", snippet(F.col("content"))))
        found = fulltext.search(rows, pattern, 20, ("doc_id",), stemmed=False, where=None if project is None else F.col("project") == project)
        return found.select("doc_id", "snippet", F.round("rank", 6).alias("rank"))

    return run


def _grep_index(pattern: str, project: str | None = None, stemmed: bool = False):
    """The same through an index that is written in runs sorted by word, of words or of stems."""

    def run(spark, sf_dir):
        docs = _texts(spark, sf_dir)
        table = fulltext.token_table(docs.select("doc_id", "content"), accents=not stemmed)
        sizes = table.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
        words = staged(fulltext.index(table, ("doc_id",), stemmed), "words")
        own = None if project is None else docs.where(F.col("project") == project).select("doc_id")
        found = fulltext.search_index(words, *sizes, pattern, 20, ("doc_id",), stemmed, own)
        return found.join(docs.select("doc_id", snippet(F.col("content")).alias("snippet")), "doc_id").select("doc_id", "snippet", F.round("rank", 6).alias("rank"))

    return run


def grep_turns(spark, sf_dir):
    turns = derived.turns(spark, sf_dir)
    rows = fulltext.token_table(turns.withColumn("snippet", snippet(F.col("content"))))
    found = fulltext.search(rows, "the", 20, ("session_id", "source_seq"), stemmed=False, where=F.col("project") == 3)
    return found.select("session_id", "source_seq", "role", "snippet", F.round("rank", 6).alias("rank"))


GREPS = {  # name: pattern, project
    "grep_term": ("worthless", None),
    "grep_and": ("the worthless", None),
    "grep_or": ("idiot OR scum", None),
    "grep_not": ("idiot NOT worthless", None),
    "grep_phrase": ('"of the"', None),
    "grep_prefix": ("worth*", None),
    "grep_near": ("NEAR(idiot of, 3)", None),
    "grep_first": ("^the", None),
    "grep_project_filter": ("worthless", "src1"),
}


def _grep_sql(phrases: list[tuple[str, int]], matches: str, counts: list[str] | None = None, project: str | None = None, close: str = "") -> str:
    """phrases: condition for a start at i (tokens tk, 1-based) and width."""
    starts = ", ".join(f"list_filter(range(1, len(tk) + 1), lambda i: {cond}) AS p{k}" for k, (cond, _) in enumerate(phrases))
    counts = counts or [f"len(p{k})" for k in range(len(phrases))]
    tally = ", ".join(f"count(*) FILTER (WHERE len(p{k}) > 0) AS n{k}" for k in range(len(phrases)))
    score = " + ".join(
        f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * ({c}) * 2.2 / (({c}) + 1.2 * (0.25 + 0.75 * len(tk) / (total / n)))" for k,
        c in enumerate(counts)
    )
    where = "" if project is None else f" AND source = '{project}'"
    return f"""WITH d AS (SELECT doc_id, source, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS tk FROM documents),
    p AS (SELECT *, {starts} FROM d), q AS (SELECT *{close} FROM p), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(tk)) AS DOUBLE) AS total, {tally} FROM p)
    SELECT doc_id, substr(coalesce(text, ''), 1, 200) AS snippet, round(-({score}), 6) AS rank FROM q, n WHERE ({matches}){where} ORDER BY -({score}), doc_id LIMIT 20"""


# Endings that may be added to a word or a word without its last letter.
ENDINGS = (
    "", "s", "es", "ed", "ing", "ings", "ly", "ness", "nesses", "ful", "fulness", "fully", "er", "ers", "ment", "ments", "able", "ation", "edly", "ingly",
    "ive", "ate", "ated"
)


def _stemmed_sql(*stems: str) -> str:
    """The words of a stem are those that its endings make and that stem to it; accents are stripped."""
    conditions = []
    for word in stems:
        forms = sorted({base + end for base in (word, word + "e") for end in ENDINGS if stem(base + end) == stem(word)})
        conditions.append((f"tk[i] IN ({', '.join(map(repr, forms))})", 1))
    sql = _grep_sql(conditions, " OR ".join(f"len(p{k}) > 0" for k in range(len(stems))))
    return sql.replace("lower(coalesce(text, ''))", "strip_accents(lower(coalesce(text, '')))", 1)


def _near_sql() -> str:
    close = ", list_filter(list_distinct(list_concat(p0, p1)), lambda m: len(list_filter(p0, lambda x: x <= m AND x >= m - 4)) > 0 AND len(list_filter(p1, lambda x: x <= m AND x >= m - 4)) > 0) AS close"
    count = lambda k: f"len(list_filter(p{k}, lambda x: len(list_filter(close, lambda m: x <= m AND x >= m - 4)) > 0))"
    return _grep_sql([("tk[i] = 'idiot'", 1), ("tk[i] = 'of'", 1)], "len(close) > 0", [count(0), count(1)], close=close)


GREP_SQL = {
    "grep_term": _grep_sql([("tk[i] = 'worthless'", 1)], "len(p0) > 0"),
    "grep_and": _grep_sql([("tk[i] = 'the'", 1), ("tk[i] = 'worthless'", 1)], "len(p0) > 0 AND len(p1) > 0"),
    "grep_or": _grep_sql([("tk[i] = 'idiot'", 1), ("tk[i] = 'scum'", 1)], "len(p0) > 0 OR len(p1) > 0"),
    "grep_not": _grep_sql([("tk[i] = 'idiot'", 1), ("tk[i] = 'worthless'", 1)], "len(p0) > 0 AND len(p1) = 0", ["len(p0)", "0"]),
    "grep_phrase": _grep_sql([("tk[i] = 'of' AND tk[i + 1] = 'the'", 2)], "len(p0) > 0"),
    "grep_prefix": _grep_sql([("starts_with(tk[i], 'worth')", 1)], "len(p0) > 0"),
    "grep_near": _near_sql(),
    "grep_first": _grep_sql([("tk[i] = 'the' AND i = 1", 1)], "len(p0) > 0"),
    "grep_project_filter": _grep_sql([("tk[i] = 'worthless'", 1)], "len(p0) > 0", project="src1"),
    "grep_turns": """WITH d AS (SELECT conv_id AS session_id, turn AS source_seq, role, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}\\p{Co}]+') AS tk FROM conversations),
      p AS (SELECT *, len(list_filter(tk, lambda x: x = 'the')) AS c FROM d), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(tk)) AS DOUBLE) AS total, count(*) FILTER (WHERE c > 0) AS n0 FROM p),
      r AS (SELECT *, greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(tk) / (total / n))) AS score FROM p, n WHERE c > 0 AND session_id % 10 = 3)
      SELECT session_id, source_seq, role, substr(coalesce(text, ''), 1, 200) AS snippet, round(-score, 6) AS rank FROM r ORDER BY -score, session_id, source_seq LIMIT 20""",
}


def knn_cosine(spark, sf_dir):
    """The 20 vectors nearest to that of the least id."""
    rows = derived.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    query = rows.orderBy("vec_id").first()["embedding"]
    return vectors.nearest(rows, vectors.vector_literal(query), 20, ("vec_id",)).select("vec_id", F.round("distance", 6).alias("distance"))


def knn_each(spark, sf_dir):
    """The 5 vectors nearest to every one whose id is divisible by 50, among all."""
    rows = derived.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vectors.nearest_to_each(rows, rows.where("vec_id % 50 = 0"), 5)
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"))


def knn_all(spark, sf_dir):
    """The 3 vectors nearest to every one, in small blocks."""
    rows = derived.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vectors.nearest_to_each(rows, rows, 3, query_bytes=1 << 20, row_bytes=1 << 20)
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"))


def vector_blobs(spark, sf_dir):
    """Vectors written as blobs and read again."""
    rows = derived.table(spark, sf_dir, "embeddings").select("vec_id", vectors.to_blob(F.col("embedding")).alias("blob"))
    return rows.select(
        "vec_id", F.length("blob").alias("n_bytes"), F.posexplode(vectors.from_blob(F.col("blob"))).alias("place", "x")
    ).select("vec_id", "n_bytes", "place", "x")


def project_remotes(spark, sf_dir):
    """Folders, with remotes of several forms, resolved to owner and repository."""
    base = derived.sessions(spark, sf_dir).withColumn("project_root", F.concat(F.lit("/work/"), "project_slug"))
    slugs = derived.sessions(spark, sf_dir).select("project_slug").distinct().where("project_slug is not null")
    n = F.regexp_extract("project_slug", r"(\d+)$", 1).cast("int")
    forms = [
        F.concat(F.lit(a), n.cast("string"), F.lit(b)) for a,
        b in (
            ("https://host.example/team", "/tool.git"), ("git@host.example:team", "/tool.git"), ("ssh://git@host.example/team", "/tool/"), ("not a remote ", "")
        )
    ]
    url = F.element_at(F.array(*forms), n % 4 + 1)
    remotes = slugs.select(F.concat(F.lit("/work/"), "project_slug").alias("root_path"), url.alias("git_remote"))
    return projects.projects(base, remotes)


def _means(spark, sf_dir):
    return vectors.mean_vectors(derived.table(spark, sf_dir, "embeddings").select("label", "embedding"), "label")


def session_mean_embedding(spark, sf_dir):
    return _means(spark, sf_dir).select("label", F.posexplode("embedding").alias("place", "x")).select(
        "label", "place", F.round(F.col("x").cast("double"), 5).alias("x")
    )


def session_mean_increments(spark, sf_dir):
    """Means after two increments: the kept sums of the first and those of the second."""
    rows = derived.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    first, second = (vectors.vector_sums(rows.where(F.col("vec_id") % 3 == 0 if k else F.col("vec_id") % 3 != 0), "label") for k in (0, 1))
    both = first.join(second.withColumnRenamed("sums", "more"), "label", "full_outer")
    mean = vectors.mean_of_sums(vectors.added_sums(F.col("sums"), F.col("more")))
    return both.select("label", F.posexplode(mean).alias("place", "x")).select("label", "place", F.round(F.col("x").cast("double"), 5).alias("x"))


def similar_sessions(spark, sf_dir):
    rows = _means(spark, sf_dir).withColumnRenamed("embedding", "summary_embedding")
    return vectors.similar(rows, "label", 0, 10).select("label", F.round("distance", 4).alias("distance"))


def has_embeddings(spark, sf_dir):
    found = not derived.table(spark, sf_dir, "embeddings").where("embedding is not null").limit(1).isEmpty()
    return spark.createDataFrame([(found,)], "has_embeddings boolean")


# Conversations ---------------------------------------------------------------------------------------------------------


def embed_text_query(spark, sf_dir):
    return derived.turns(spark, sf_dir).select(
        "session_id", "source_seq", embed_text(F.col("role"), F.col("content"), F.lit(None).cast("string")).alias("input")
    )


def snippet_200(spark, sf_dir):
    return derived.turns(spark, sf_dir).select("session_id", "source_seq", snippet(F.col("content")).alias("snippet"))


def _embeddable(spark, sf_dir) -> DataFrame:
    """Turns as messages: every third has a vector, and they came over thirty days."""
    turns = derived.turns(spark, sf_dir).withColumn("uuid", F.concat_ws("-", "session_id", "source_seq")).withColumn("thinking", F.lit(None).cast("string"))
    came = F.date_add(F.lit(date(2024, 1, 1)), (F.col("session_id") % 30).cast("int")).cast("timestamp")
    return turns.withColumn("embedding", F.when(F.col("source_seq") % 3 == 0, F.array(F.lit(1.0)))).withColumn("ingested_at", came)


def _candidates(**options):
    """Messages to embed that were taken in since a day."""

    def run(spark, sf_dir):
        since = Recency(datetime(2024, 1, 15, tzinfo=timezone.utc)).holds(F.col("ingested_at"))
        return embedding.candidates(_embeddable(spark, sf_dir), since, **options).select("session_id", "source_seq", F.col("text").alias("input"))

    return run


def transcript_order(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy("source_seq")
    return derived.turns(spark, sf_dir).select("session_id", "source_seq", "role", F.row_number().over(order).cast("long").alias("position"))


def transcript_markdown(spark, sf_dir):
    """The transcripts of all conversations; every fifth turn of an assistant asks for a call, every tenth of which fails."""
    turns = derived.turns(spark, sf_dir)
    sessions = turns.groupBy("session_id").agg(F.count("*").alias("tool_call_count")).select(
        "session_id", F.lit(None).cast("string").alias("title"), F.lit("chat").alias("source"), F.concat(
            F.lit("project"), F.col("session_id") % 10
        ).alias("project_slug"), F.lit("m").alias("model"),
        F.lit(None).cast("string").alias("started_at"), F.lit(None).cast("string").alias("ended_at"), "tool_call_count", *[
            F.lit(k).alias(name) for k, (_, name) in enumerate(export.CHANNELS)
        ],
    )
    messages = turns.select(
        "session_id", F.concat_ws("-", "session_id", "source_seq").alias("uuid"), "source_seq", F.col("source_seq").alias("turn_number"), "role", "content",
        F.when(F.col("source_seq") % 7 == 3, F.lit("hm")).alias("thinking")
    )
    calls = messages.where("role = 'assistant' and source_seq % 5 = 1").select(
        "session_id", F.col("uuid").alias("request_message"), "source_seq", F.concat(F.lit("c"), "source_seq").alias("call_id"), F.lit("run").alias("tool_name"),
        F.when(
            F.col("source_seq") % 2 == 0, F.lit("{}")
        ).alias("tool_input"), F.lit("done").alias("tool_output"), (F.col("source_seq") % 10 == 1).alias("is_error"),
    )
    return export.transcripts(sessions, messages, calls)


def session_summary(spark, sf_dir):
    rows = derived.turns(spark, sf_dir)
    return rows.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("assistant_count"),
        F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars")
    )


def uuid5_ids(spark, sf_dir):
    rows = derived.turns(spark, sf_dir).select("source_seq", F.col("session_id").cast("string").alias("native"))
    session = session_uuid(F.lit("claude"), F.col("native"))
    return rows.select("native", "source_seq", session.alias("session_uuid"), child_uuid(session, F.col("source_seq").cast("string")).alias("message_uuid"))


def json_extract_props(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "events")
    parsed = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return rows.select("event_id", parsed.alias("k"))


def iso_stamps(spark, sf_dir):
    """Times as the stores keep them, in milliseconds and in seconds with a fraction, as ISO text."""
    rows = derived.events(spark, sf_dir)
    millis = F.unix_millis("ts")
    return rows.select("event_id", iso_of_millis(millis).alias("of_millis"), iso_of_seconds(millis / 1000).alias("of_seconds"))


def recency_window(spark, sf_dir):
    """What is as new as a day; unknown times (every tenth here) pass."""
    rows = derived.events(spark, sf_dir).withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return rows.where(recency(None, "2024-01-20", NOW).holds(F.col("ts"))).select("event_id", "user_id")


# The order-dependent cores of the parsers, over events of a user in order ---------------------------------------------------


def dedup_first(spark, sf_dir):
    """The first event of each user and type."""
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return derived.events(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n = 1").select("user_id", "event_type", "event_id")


def fifo_pairing(spark, sf_dir):
    """The n-th click of a user answers its n-th view that no earlier click has answered."""
    from ..operators.pairing import first_in_first_out

    rows = derived.events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return first_in_first_out(
        rows.select("user_id", "event_id", (F.col("event_type") == "view").alias("opens")), ["user_id"], "event_id", "opens"
    ).select("user_id", "event_id", "opened_by")


def asof_last_assistant(spark, sf_dir):
    """For each error the latest purchase of the user before it."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return derived.events(spark, sf_dir).withColumn("last_purchase", last).where("event_type = 'error'").select("event_id", "last_purchase")


def cumulative_max(spark, sf_dir):
    return derived.events(spark, sf_dir).groupBy("session_id").agg(F.max(F.floor("value")).cast("long").alias("most"))


def patch_replay(spark, sf_dir):
    """The last value set for each user and type, as replayed patches leave it."""
    rows = derived.events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("props"), F.count("*").alias("patches"))
    return rows


def session_upsert_idempotent(spark, sf_dir):
    """Every conversation, with the tenth of them replaced by themselves twice."""
    from ..operators.upsert import replace_sessions

    rows = derived.turns(spark, sf_dir)
    some = rows.where("session_id % 10 = 0")
    return replace_sessions(
        replace_sessions(rows, some, some.select("session_id").distinct()), some, some.select("session_id").distinct()
    ).groupBy("session_id").agg(F.count("*").alias("n"))


def parent_links(spark, sf_dir):
    """Each conversation's parent is the one 50 before it, if there is such."""
    from ..operators.upsert import resolve_parents

    rows = derived.turns(spark, sf_dir).select("session_id").distinct().withColumn("parent_session_id", F.col("session_id") - 50)
    return resolve_parents(rows).select("session_id", "parent_session_id")


_S = f"WITH {SESSIONS} "
_UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr({h}, 17, 1) AS INTEGER) % 4) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_ROLLUP_SQL = f"""{_S} SELECT dd AS date, source, project_slug AS project, count(DISTINCT session_id) AS session_count, CAST(sum(message_count) AS BIGINT) AS message_count, CAST(sum(tool_call_count) AS BIGINT) AS tool_call_count,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in report.TOKENS)}, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(NULL AS DOUBLE) AS estimated_cost_usd FROM c WHERE {_days()} GROUP BY 1, 2, 3"""
_UNIT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_MEANS = "w AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding) AS x FROM embeddings), mean AS (SELECT label, place, CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS x FROM w GROUP BY label, place)"

_CANDIDATES_SQL = "SELECT conv_id AS session_id, turn AS source_seq, role || chr(10) || coalesce(text, '') AS input FROM conversations WHERE {more}DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) >= DATE '2024-01-15'{limit}"
_TRANSCRIPT_SQL = """WITH b AS (SELECT conv_id, turn, '## [' || turn || '] ' || role || chr(10) || coalesce(text || chr(10), '') || CASE WHEN turn % 7 = 3 THEN '> **thinking:** hm' || repeat(chr(10), 2) ELSE '' END
    || CASE WHEN role = 'assistant' AND turn % 5 = 1 THEN '### Tool: run (`c' || turn || '`)' || chr(10) || CASE WHEN turn % 2 = 0 THEN '**Input:**' || chr(10) || '```json' || chr(10) || '{}' || chr(10) || '```' || chr(10) ELSE '' END
      || '**Output:**' || chr(10) || '```' || chr(10) || 'done' || CASE WHEN turn % 10 = 1 THEN chr(10) || '(error)' ELSE '' END || chr(10) || '```' || repeat(chr(10), 2) ELSE '' END || chr(10) AS block FROM conversations)
  SELECT conv_id AS session_id, '# Untitled session' || repeat(chr(10), 2) || '- **Session ID:** ' || conv_id || chr(10) || '- **Source:** chat' || chr(10) || '- **Project:** project' || conv_id % 10 || chr(10)
    || '- **Started:** ? · **Ended:** ?' || chr(10) || '- **Model:** m' || chr(10) || '- **Tokens:** in=0 out=1 cache_r=2 cache_w=3' || chr(10) || '- **Tool calls:** ' || count(*) || chr(10) || chr(10) || '---' || repeat(chr(10), 2) || string_agg(block, '' ORDER BY turn) AS markdown
  FROM b GROUP BY conv_id"""

QUERIES = {
    "report_totals": (report_totals, _totals_sql(_days())),
    "report_totals_filtered": (report_totals_filtered, _totals_sql(_days(more=" AND project_slug = 'project3' AND source = 'source3'"))),
    "avg_session_duration": (avg_session_duration, f"SELECT avg_session_duration_seconds FROM ({_totals_sql(_days())})"),
    "unique_models": (unique_models, f"SELECT unique_models FROM ({_totals_sql(_days())})"),
    "report_sections": (
        report_sections,
        f"""WITH {SESSIONS}, g AS (SELECT CAST(grouping_id(project_slug, source, dd) AS INTEGER) AS section, project_slug AS project, source, dd AS date, count(*) AS session_count,
              CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(message_count) AS BIGINT) AS message_count, CAST(sum(tool_call_count) AS BIGINT) AS tool_call_count,
              CAST(sum(error_count) AS BIGINT) AS error_count, count(DISTINCT model) AS unique_models
            FROM c WHERE {_days()} GROUP BY GROUPING SETS ((), (project_slug), (source), (dd)))
            SELECT * FROM g QUALIFY section <> 3 OR row_number() OVER (PARTITION BY section ORDER BY session_count DESC, coalesce(project, '')) <= 10"""
    ),
    "report_names": (
        report_names,
        f"""{_S}, n AS (SELECT session_id, 'role' AS kind, role AS name FROM m UNION ALL SELECT session_id, 'tool', tool_name FROM k)
            SELECT kind, name, count(*) AS "count" FROM n WHERE session_id IN (SELECT session_id FROM t WHERE {_days()}) GROUP BY kind, name
            QUALIFY kind = 'role' OR row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) <= 10"""
    ),
    "messages_by_role": (
        messages_by_role, f'{_S} SELECT role, count(*) AS "count" FROM m WHERE session_id IN (SELECT session_id FROM t WHERE {_days()}) GROUP BY role'
    ),
    "tool_call_total": (tool_call_total, f"{_S} SELECT count(*) AS tool_call_count FROM k WHERE session_id IN (SELECT session_id FROM t WHERE {_days()})"),
    "top_tools": (
        top_tools,
        f'{_S} SELECT tool_name, count(*) AS "count" FROM k WHERE session_id IN (SELECT session_id FROM t WHERE {_days()}) GROUP BY tool_name ORDER BY 2 DESC, 1 LIMIT 10'
    ),
    "top_projects": (
        top_projects,
        f"{_S} SELECT project_slug AS slug, count(*) AS session_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM t WHERE {_days()} GROUP BY 1 ORDER BY 2 DESC, coalesce(project_slug, '') LIMIT 10"
    ),
    "source_breakdown": (
        source_breakdown, f"{_S} SELECT source, count(*) AS session_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM t WHERE {_days()} GROUP BY 1"
    ),
    "daily_breakdown": (
        daily_breakdown,
        f"{_S} SELECT dd AS date, count(*) AS session_count, CAST(sum(message_count) AS BIGINT) AS message_count, CAST(sum(tool_call_count) AS BIGINT) AS tool_call_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM c WHERE {_days()} GROUP BY 1"
    ),
    "usage_rollup": (usage_rollup, _ROLLUP_SQL),
    "usage_rollup_upsert": (usage_rollup_upsert, _ROLLUP_SQL),
    "period_daily": (_period_query("daily"), _totals_sql(_days("2024-01-30"))),
    "period_weekly": (_period_query("weekly"), _totals_sql(_days("2024-01-24"))),
    "period_monthly": (_period_query("monthly"), _totals_sql(_days("2024-01-01"))),
    "period_last30": (_period_query("last-30-days"), _totals_sql(_days("2024-01-01"))),
    "period_custom": (_period_query("custom", start="2024-01-10", end="2024-01-12"), _totals_sql(_days("2024-01-10", "2024-01-12"))),
    "scope_empty": (
        scope_empty,
        f"{_S} SELECT 'all' AS scope, NOT EXISTS (SELECT 1 FROM t WHERE {_days()}) AS is_empty UNION ALL SELECT 'unknown', NOT EXISTS (SELECT 1 FROM t WHERE {_days(more=' AND project_slug = ' + chr(39) + 'no-such-project' + chr(39))})"
    ),
    "semi_join_counts": (
        semi_join_counts,
        f"{_S} SELECT t.dd AS date, count(*) AS message_count FROM m JOIN t USING (session_id) WHERE {_days()} AND source = 'source2' GROUP BY 1"
    ),
    "preagg_left_join": (preagg_left_join, f"{_S} SELECT session_id, message_count, tool_call_count FROM c WHERE {_days()}"),
    **{name: (_grep(pattern, project), GREP_SQL[name]) for name, (pattern, project) in GREPS.items()},
    "grep_turns": (grep_turns, GREP_SQL["grep_turns"]),
    "grep_stemmed": (_grep_index("worthlessness OR disgusted", stemmed=True), _stemmed_sql("worthless", "disgust")),
    "knn_cosine": (
        knn_cosine,
        f"WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), r AS (SELECT vec_id, 1 - {_UNIT.format(a='embedding', b='q')} / (sqrt({_UNIT.format(a='embedding', b='embedding')}) * sqrt({_UNIT.format(a='q', b='q')})) AS x FROM embeddings, q) SELECT vec_id, round(x, 6) AS distance FROM r ORDER BY x, vec_id LIMIT 20"
    ),
    "knn_each": (
        knn_each,
        f"WITH r AS (SELECT q.vec_id AS query, e.vec_id, 1 - {_UNIT.format(a='e.embedding', b='q.embedding')} / (sqrt({_UNIT.format(a='e.embedding', b='e.embedding')}) * sqrt({_UNIT.format(a='q.embedding', b='q.embedding')})) AS x FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) SELECT query, vec_id, round(x, 6) AS distance FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY x, vec_id) <= 5"
    ),
    "knn_all": (
        knn_all,
        f"WITH r AS (SELECT q.vec_id AS query, e.vec_id, 1 - {_UNIT.format(a='e.embedding', b='q.embedding')} / (sqrt({_UNIT.format(a='e.embedding', b='e.embedding')}) * sqrt({_UNIT.format(a='q.embedding', b='q.embedding')})) AS x FROM embeddings q, embeddings e WHERE e.vec_id <> q.vec_id) SELECT query, vec_id, round(x, 6) AS distance FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY x, vec_id) <= 3"
    ),
    "vector_blobs": (
        vector_blobs,
        "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes, CAST(unnest(range(len(embedding))) AS INTEGER) AS place, unnest(embedding) AS x FROM embeddings"
    ),
    "project_remotes": (project_remotes, f"""{_S}, p AS (SELECT project_slug AS slug, count(DISTINCT session_id) AS session_count, CAST(regexp_extract(project_slug, '(\\d+)$', 1) AS INTEGER) AS n FROM t WHERE project_slug IS NOT NULL GROUP BY 1)
      SELECT '/work/' || slug AS root_path, slug, CASE n % 4 WHEN 0 THEN 'https://host.example/team' || n || '/tool.git' WHEN 1 THEN 'git@host.example:team' || n || '/tool.git' WHEN 2 THEN 'ssh://git@host.example/team' || n || '/tool/' ELSE 'not a remote ' || n END AS git_remote,
      CASE WHEN n % 4 < 3 THEN 'team' || n END AS git_owner, CASE WHEN n % 4 < 3 THEN 'tool' END AS git_repo, session_count FROM p"""),
    "session_mean_embedding": (
        session_mean_embedding, f"WITH {_MEANS} SELECT label, CAST(place - 1 AS INTEGER) AS place, round(CAST(x AS DOUBLE), 5) AS x FROM mean"
    ),
    "session_mean_increments": (
        session_mean_increments, f"WITH {_MEANS} SELECT label, CAST(place - 1 AS INTEGER) AS place, round(CAST(x AS DOUBLE), 5) AS x FROM mean"
    ),
    "similar_sessions": (
        similar_sessions,
        f"WITH {_MEANS}, v AS (SELECT label, list(x ORDER BY place) AS a FROM mean GROUP BY label), q AS (SELECT a AS b FROM v WHERE label = 0), r AS (SELECT label, 1 - {_UNIT.format(a='a', b='b')} / (sqrt({_UNIT.format(a='a', b='a')}) * sqrt({_UNIT.format(a='b', b='b')})) AS x FROM v, q WHERE label <> 0) SELECT label, round(x, 4) AS distance FROM r ORDER BY x, label LIMIT 10"
    ),
    "has_embeddings": (has_embeddings, "SELECT EXISTS (SELECT 1 FROM embeddings WHERE embedding IS NOT NULL) AS has_embeddings"),
    "embed_text": (embed_text_query, "SELECT conv_id AS session_id, turn AS source_seq, role || chr(10) || coalesce(text, '') AS input FROM conversations"),
    "snippet_200": (snippet_200, "SELECT conv_id AS session_id, turn AS source_seq, substr(coalesce(text, ''), 1, 200) AS snippet FROM conversations"),
    "embed_candidates": (_candidates(), _CANDIDATES_SQL.format(more="turn % 3 <> 0 AND ", limit="")),
    "embed_candidates_forced": (_candidates(force=True), _CANDIDATES_SQL.format(more="", limit="")),
    "embed_candidates_limit": (_candidates(limit=100), _CANDIDATES_SQL.format(more="turn % 3 <> 0 AND ", limit=" ORDER BY conv_id, turn LIMIT 100")),
    "transcript_order": (
        transcript_order,
        "SELECT conv_id AS session_id, turn AS source_seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations"
    ),
    "transcript_markdown": (transcript_markdown, _TRANSCRIPT_SQL),
    "session_summary": (
        session_summary,
        "SELECT conv_id AS session_id, count(*) AS message_count, count(*) FILTER (WHERE role = 'assistant') AS assistant_count, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id"
    ),
    "uuid5_ids": (
        uuid5_ids,
        f"WITH a AS (SELECT CAST(conv_id AS VARCHAR) AS native, turn AS source_seq, sha1(unhex('019257924a7c4e6f9d6f1a2b3c4d5e6f') || ('claude:' || CAST(conv_id AS VARCHAR))::BLOB) AS h FROM conversations), b AS (SELECT native, source_seq, {_UUID.format(h='h')} AS session_uuid FROM a), c AS (SELECT *, sha1(unhex('019257924a7c4e6f9d6f1a2b3c4d5e6f') || (session_uuid || ':' || CAST(source_seq AS VARCHAR))::BLOB) AS g FROM b) SELECT native, source_seq, session_uuid, {_UUID.format(h='g')} AS message_uuid FROM c"
    ),
    "json_extract_props": (json_extract_props, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "iso_stamps": (
        iso_stamps,
        "SELECT event_id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS of_millis, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS of_seconds FROM events"
    ),
    "recency_window": (recency_window, "SELECT event_id, user_id FROM events WHERE event_id % 10 = 0 OR ts >= TIMESTAMP '2024-01-20'"),
    "dedup_first": (dedup_first, "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2"),
    "fifo_pairing": (fifo_pairing, """WITH x AS (SELECT user_id, event_id, event_type = 'view' AS opens FROM events WHERE event_type IN ('view', 'click')),
      w AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER u AS level FROM x WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
      l AS (SELECT *, least(0, min(level) OVER u) AS low, lag(least(0, min_level)) OVER u AS was FROM (SELECT *, min(level) OVER (PARTITION BY user_id ORDER BY event_id) AS min_level FROM w) WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
      a AS (SELECT *, NOT opens AND low < coalesce(was, 0) AS orphan FROM l),
      o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM a WHERE opens), c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM a WHERE NOT opens AND NOT orphan)
      SELECT a.user_id, a.event_id, o.event_id AS opened_by FROM a LEFT JOIN c ON a.event_id = c.event_id LEFT JOIN o ON c.user_id = o.user_id AND c.n = o.n WHERE NOT a.opens"""),
    "asof_last_assistant": (
        asof_last_assistant,
        "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'error'"
    ),
    "cumulative_max": (cumulative_max, f"WITH {EVENTS} SELECT session_id, CAST(max(floor(value)) AS BIGINT) AS most FROM e GROUP BY 1"),
    "patch_replay": (patch_replay, "SELECT user_id, event_type, arg_max(props, event_id) AS props, count(*) AS patches FROM events GROUP BY 1, 2"),
    "parent_links": (
        parent_links,
        "WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT a.conv_id AS session_id, b.conv_id AS parent_session_id FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id - 50"
    ),
    **ROUND_TRIPS,
    "session_upsert_idempotent": (session_upsert_idempotent, "SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY 1"),
}


QUERIES |= {f"grep_index_{name.removeprefix('grep_')}": (_grep_index(*asked), GREP_SQL[name]) for name, asked in GREPS.items()}
QUERIES |= STORES


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
