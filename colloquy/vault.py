"""A vault: sessions and what belongs to them under one path, replaced session by session, and everything asked of them.

A change appends a segment: the arriving rows of all tables, the keys they replace, and the full-text index of its
messages. Its manifest is published last (see `store`), so readers see all of a change or none of it, and of two writers both
changes count, one after the other. Rows count unless a later segment replaces their session. Segments are merged when some
have gathered behind an older one and grown to half its size, so there are few of them, a row is rewritten a logarithmic
number of times, and what a change costs depends on what arrives, not on what is there.
"""

import hashlib
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EmbedderError, UsageError
from .functions.columns import snippet
from .operators import embedding, export, fulltext, projects, report, vectors
from .operators.periods import Recency, period, utc_now
from .operators.upsert import resolve_parents
from .parsers import shaped
from .schemas import POSTINGS, REPLACED, TABLES, VOCABULARY
from .scratch import staged
from .sources.ingest import read_sessions, summary
from .sources.ingest import tables as parsed_tables
from .store import Conflict, Store

ALL = TABLES | {"postings": POSTINGS}
FORMAT = 3
#: A segment is merged with those after it when they hold more than this share of its sessions, and so many are to merge.
MERGE_SHARE = 0.5
LEAST_MERGED = 4
#: What was never published is left alone for so many seconds, as its writer may be at work.
ABANDONED = 24 * 3600.0
#: How often an embedding run is made again when its sessions were replaced meanwhile.
EMBED_TRIES = 3


def _no_session(path: str):
    """The key of what has a file but no session."""
    return F.concat(F.lit("path:"), F.col(path))


def _key(table: str):
    return F.coalesce("session_id", _no_session("raw_path")) if table == "errata" else F.col("session_id")


class Vault:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self.path = self.store.path
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    # Storage ---------------------------------------------------------------------------------------------------------

    def init(self) -> "Vault":
        """Make an empty vault; one that is there stays as it is, brought to the present format."""
        if not self.exists():
            self.store.publish({"version": 1, "format": FORMAT, "segments": [], "config": {}})
        self.migrate()
        return self

    def exists(self) -> bool:
        return self.store.latest() is not None

    def manifest(self) -> dict:
        return self.store.manifest()

    def migrate(self) -> bool:
        """Bring a vault of an earlier format to the present one. In format 1 tables lie in buckets of several versions, in 2
        segments have numbers for names, and reports and remotes stand in the manifest. Columns that came later are null in older
        rows, so tables need no rewriting beyond that. Returns whether anything was done."""
        manifest = self.manifest()
        form, config = manifest.get("format", 1), dict(manifest["config"])
        if form >= FORMAT:
            return False
        if form == 1:
            rows = {}
            for name, schema in TABLES.items():
                paths = [f"{self.path}/{name}/v={v}/bucket={b}" for b, v in manifest["tables"][name].items() if v]
                rows[name] = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            segment = self._write(rows, self._keys(rows))
            segments = [segment] if segment[1] else []
        else:
            segments = [[f"v={v}", n] for v, n in manifest["segments"]]
            for name, doc in config.pop("reports", {}).items():
                self._save_report(name, doc)
            if "rollup" in config:
                self._roll_up(self.spark.read.parquet(f"{self.path}/usage_summary/v={config.pop('rollup')}"))
            if "remotes" in config:
                config["remotes"] = self._write_remotes(config["remotes"])
        made = {"version": manifest["version"] + 1, "format": FORMAT, "segments": segments, "config": config}
        if not self.store.publish(made):  # another process has migrated it
            return self.migrate()
        return True

    def table(self, name: str, manifest: dict | None = None, segments: list | None = None) -> DataFrame:
        """The rows of a table that no later segment replaces."""
        if segments is None:
            segments = (manifest or self.manifest())["segments"]
        schema = ALL[name]
        read = lambda kind, segment, form: self.spark.read.schema(form).parquet(f"{self.path}/{kind}/{segment}")
        if not segments:
            return self.spark.createDataFrame([], schema)
        newest = read(name, segments[-1][0], schema)
        if len(segments) == 1:
            return newest
        older = [read(name, segment, schema).withColumn("_segment", F.lit(k)) for k, (segment, _) in enumerate(segments[:-1])]
        gone = [read("replaced", segment, REPLACED).withColumn("_by", F.lit(k)) for k, (segment, _) in enumerate(segments) if k]
        last = reduce(DataFrame.unionByName, gone).groupBy("key").agg(F.max("_by").alias("_by"))
        rows = reduce(DataFrame.unionByName, older).join(last, _key(name) == F.col("key"), "left").where("_by is null or _by <= _segment")
        return rows.select(*schema.names).unionByName(newest)

    @staticmethod
    def _keys(rows: dict[str, DataFrame]) -> DataFrame:
        """What arriving rows replace: their sessions, and errata without a session of the same files."""
        files = rows["sessions"].select("raw_path").unionByName(rows["errata"].where("session_id is null").select("raw_path"))
        keys = rows["sessions"].select(F.col("session_id").alias("key")).unionByName(
            files.where("raw_path is not null").select(_no_session("raw_path").alias("key"))
        )
        return keys.distinct()

    def _write(self, rows: dict[str, DataFrame], keys: DataFrame) -> list:
        """Write a segment; returns its name and its number of keys. Nobody knows of it until it is published."""
        segment = self.store.new_segment()
        place = lambda name: f"{self.path}/{name}/{segment}"

        def write(name: str) -> None:
            if name == "replaced":
                keys.write.parquet(place(name))
                return
            new = shaped(rows[name], TABLES[name])
            if name == "messages":
                new = new.withColumn(
                    "ingested_at", F.coalesce("ingested_at", F.current_timestamp())
                ).withColumn("n_tokens", F.size(fulltext.tokens(F.col("content"))))
            new.sortWithinPartitions("session_id").write.parquet(place(name))

        with ThreadPoolExecutor(len(TABLES) + 1) as pool:  # the jobs don't need each other
            list(pool.map(write, [*TABLES, "replaced"]))
        messages = self.spark.read.schema(TABLES["messages"]).parquet(place("messages"))
        table = fulltext.token_table(messages.select("session_id", "uuid", "source_seq", "content"), accents=False)
        words = staged(fulltext.index(table, ("session_id", "uuid", "source_seq")), "words", f"{self.path}/staging/{segment}")
        index = fulltext.stemmed_index(words, self._vocabulary(words))
        # dealt by word, and a frequent word by its texts too
        index.select(*POSTINGS.names).repartitionByRange("term", "uuid").sortWithinPartitions("term", "uuid").write.parquet(place("postings"))
        self.store.remove(f"staging/{segment}")
        return [segment, self.spark.read.schema(REPLACED).parquet(place("replaced")).count()]

    def _vocabulary(self, words: DataFrame) -> DataFrame:
        """term and stem of the words, after stemming those that no segment had before. A stem depends on its word alone, so what
        several writers add at once, or one that dies, is right all the same."""
        read = lambda: self.spark.read.schema(VOCABULARY).parquet(f"{self.path}/vocabulary/*")
        known = read() if self.store.names("vocabulary") else None
        fulltext.stems_of(words, known).write.parquet(f"{self.path}/vocabulary/{self.store.new_segment()}")
        return read().distinct()

    def _append(self, rows: dict[str, DataFrame], keys: DataFrame | None = None, config: dict | None = None, made_from: dict | None = None) -> list:
        """Write a segment and publish it after all others. If its rows were made from those that a manifest names, no session
        among them may have been replaced since; else it is a Conflict and nothing is published."""
        segment = self._write(rows, self._keys(rows) if keys is None else keys)

        def make(latest: dict) -> dict:
            if made_from is not None and self._replaced_since(made_from, latest, segment):
                raise Conflict(f"sessions were replaced meanwhile at {self.path}")
            segments = [*latest["segments"], segment] if segment[1] else latest["segments"]
            return latest | {"segments": segments, "config": latest["config"] | (config or {})}

        self.store.change(make)
        self.merge()
        return segment

    def _replaced_since(self, before: dict, after: dict, segment: list) -> bool:
        known = {name for name, _ in before["segments"]}
        keys = lambda name: self.spark.read.schema(REPLACED).parquet(f"{self.path}/replaced/{name}")
        others = [keys(name) for name, _ in after["segments"] if name not in known]
        return bool(others) and not reduce(DataFrame.unionByName, others).join(keys(segment[0]), "key", "left_semi").limit(1).isEmpty()

    def merge(self, all_of_them: bool = False) -> None:
        """Merge the newest segments as far back as MERGE_SHARE asks, or all. Their rows are read once and written once. If another
        writer has merged some of them meanwhile, that counts and this doesn't."""
        segments = self.manifest()["segments"]
        at = max(0, len(segments) - 1)
        while at and (all_of_them or sum(n for _, n in segments[at:]) > MERGE_SHARE * segments[at - 1][1]):
            at -= 1
        if len(segments) - at < (2 if all_of_them else LEAST_MERGED):
            return
        part = segments[at:]
        rows = {name: self.table(name, segments=part) for name in TABLES}
        keys = [self.spark.read.schema(REPLACED).parquet(f"{self.path}/replaced/{name}") for name, _ in part]
        merged = self._write(rows, reduce(DataFrame.unionByName, keys).distinct())

        def make(latest: dict) -> dict | None:
            now = latest["segments"]
            if now[at : at + len(part)] != part:
                return None
            return latest | {"segments": [*now[:at], merged, *now[at + len(part) :]]}

        self.store.change(make)

    def vacuum(self, abandoned: float = ABANDONED) -> int:
        """Remove manifests but the last, the segments that only those name, and segments that no manifest names and that are
        older than `abandoned` seconds (their writers have died). Nothing must be reading them. Returns how many went."""
        manifest, gone = self.manifest(), 0
        needed, named = {name for name, _ in manifest["segments"]}, set()
        keep = f"{manifest['version']:08d}.json"
        for name in self.store.names("manifests"):
            if name.endswith(".json") and not name.startswith(".") and name < keep:
                former = self.store.read(f"manifests/{name}") or {}
                named |= {str(segment) if "=" in str(segment) else f"v={segment}" for segment, _ in former.get("segments", [])}
        remotes = manifest["config"].get("remotes")
        for folder in (*ALL, "replaced", "remotes", "staging"):
            for name, changed in self.store.listing(folder):
                used = name == remotes if folder == "remotes" else name in needed
                if not used and (name in named or time.time() - changed >= abandoned):
                    gone += self.store.remove(f"{folder}/{name}")
        gone += self.store.remove("usage_summary")  # of format 2
        for name, changed in self.store.listing("manifests"):
            if name < keep and not name.startswith(".") or name.startswith(".") and time.time() - changed >= abandoned:
                gone += self.store.remove(f"manifests/{name}")
        return gone

    def replace(self, incoming: dict[str, DataFrame]) -> list:
        """Everything the vault holds of the incoming sessions goes, and the incoming rows come, in one change. Returns the
        segment: its name and number of keys."""
        return self._append(incoming)

    # Taking in and giving out ----------------------------------------------------------------------------------------

    def ingest(self, path: str | list[str], recency: Recency = Recency()) -> DataFrame:
        """Take in the sessions at a path (or of a list of session files); those taken in before are replaced. Returns a row
        a session, as written."""
        staging = f"staging/{self.store.new_segment()}"
        stage = lambda rows, name: staged(rows, name, f"{self.path}/{staging}")
        try:
            segment = self.replace(parsed_tables(read_sessions(self.spark, path, recency, stage)))
        finally:
            self.store.remove(staging)
        return summary(self.table("sessions", segments=[segment]))

    def note(self, path: str, message: str) -> None:
        """Record that a file could not be taken in."""
        errata = self.spark.createDataFrame([(None, None, "ingest_error", message[:500], path)], TABLES["errata"])
        rows = {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()} | {"errata": errata}
        self._append(rows)

    def grep(self, pattern: str, limit: int = 20, project: str | None = None) -> list[dict]:
        """The best messages for a pattern. The index is read for the pattern's words only; of messages, their lengths, and
        the rows that are given back."""
        fulltext.parse(pattern)
        manifest = self.manifest()
        messages = self.table("messages", manifest)
        sizes = messages.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        postings = self.table("postings", manifest)
        if project is not None:
            own = self.table("sessions", manifest).where(F.col("project_slug") == project).select("session_id")
        order = ("session_id", "source_seq", "uuid")
        found = fulltext.search_index(postings, sizes["n"], sizes["tokens"], pattern, limit, order, where=None if project is None else own)
        best = {r.uuid: r for r in found.collect()}  # limit rows
        if not best:
            return []
        of = messages.where(F.col("session_id").isin(*{r.session_id for r in best.values()}) & F.col("uuid").isin(*best))
        texts = {r.uuid: r for r in of.select("uuid", "role", snippet(F.col("content")).alias("snippet")).collect()}
        return [{"session_id": r.session_id, "role": texts[k].role, "snippet": texts[k].snippet, "rank": r["rank"]} for k, r in best.items()]

    def sessions(self) -> DataFrame:
        """All sessions, with parents that the vault holds."""
        return resolve_parents(self.table("sessions"))

    def export(self, session_id: str) -> str:
        manifest = self.manifest()
        return export.export_markdown(*(self.table(t, manifest) for t in ("sessions", "messages", "tool_calls")), session_id)

    def projects(self) -> DataFrame:
        """root_path, slug, git_remote, git_owner, git_repo and session_count of each project folder; remotes as last found."""
        return projects.projects(self.table("sessions"), self._remotes())

    def _remotes(self) -> DataFrame:
        name = self.manifest()["config"].get("remotes")
        return self.spark.read.schema(projects.REMOTES).parquet(f"{self.path}/remotes/{name}") if name else self.spark.createDataFrame([], projects.REMOTES)

    def _write_remotes(self, found: dict[str, str]) -> str:
        name = self.store.new_segment()
        self.spark.createDataFrame([*found.items()], projects.REMOTES).coalesce(1).write.parquet(f"{self.path}/remotes/{name}")
        return name

    def find_remotes(self) -> int:
        """Ask git on this machine for the origins of the project folders that are here. Returns how many are known."""
        roots = [r.root_path for r in projects.projects(self.table("sessions")).select("root_path").toLocalIterator()]
        found = {r.root_path: r.git_remote for r in self._remotes().collect()} | dict(projects.read_remotes(roots))
        name = self._write_remotes(found)
        self.store.change(lambda latest: latest | {"config": latest["config"] | {"remotes": name}})
        return len(found)

    # Vectors ---------------------------------------------------------------------------------------------------------

    def embed(self, provider: str, recency: Recency = Recency(), force: bool = False, limit: int | None = None, scope: str = "all") -> int:
        """Embed messages and set their sessions' mean vectors, over all their vectors or (scope "run") over this run's.
        Nothing changes if the embedder fails or answers wrongly. If some of the sessions are replaced meanwhile, it is done
        again. Returns how many were embedded."""
        for n in range(EMBED_TRIES):
            try:
                return self._embed(provider, recency, force, limit, scope)
            except Conflict:
                if n == EMBED_TRIES - 1:
                    raise
        return 0

    def _embed(self, provider: str, recency: Recency, force: bool, limit: int | None, scope: str) -> int:
        manifest = self.manifest()
        messages = self.table("messages", manifest)
        asked = embedding.candidates(messages, recency.holds(F.col("ingested_at")), force, limit)
        done = embedding.embed(asked, provider).persist()
        try:
            model = embedding.one_model(done)
            if model is None:
                model, _ = embedding.run_embedder(provider, [])
            count = done.count()
            touched = done.select("session_id").distinct().persist()
            own = {name: self.table(name, manifest).join(touched, "session_id", "left_semi") for name in TABLES}
            new = done.select(F.col("uuid").alias("u"), F.col("embedding").alias("fresh"))
            rows = own["messages"].join(new, F.col("uuid") == F.col("u"), "left").withColumn("embedding", F.coalesce("fresh", "embedding")).drop("u", "fresh")
            own["sessions"] = self._summarized(own["sessions"], rows, done, force, scope)
            own["messages"] = rows
            config = {"embedding_model": model.name, "embedding_dimensions": model.dimensions, "embedding_provider": provider}
            self._append(own, touched.select(F.col("session_id").alias("key")), config, made_from=manifest)
            touched.unpersist()
            return count
        except PythonException as e:
            raise EmbedderError(
                str(e).strip().splitlines()[-1] if "EmbedderError" not in str(e) else str(e).partition("EmbedderError: ")[2].splitlines()[0]
            ) from None
        finally:
            done.unpersist()

    @staticmethod
    def _summarized(sessions: DataFrame, messages: DataFrame, done: DataFrame, force: bool, scope: str) -> DataFrame:
        """Sessions with their vectors' sums and mean after a run. Sums are kept, so a run adds those of its own vectors. Summed
        anew are only the vectors of sessions whose vectors it replaces (force), or that were embedded before sums were kept."""
        keyed = lambda rows, name: vectors.vector_sums(rows, "session_id").select(F.col("session_id").alias(f"_of_{name}"), F.col("sums").alias(name))
        run = keyed(done, "_run")
        unknown = sessions if force else sessions.where("embedding_sums is null and summary_embedding is not null")
        fresh = F.col("uuid") == F.col("_fresh")
        before = messages.join(unknown.select("session_id"), "session_id", "left_semi").join(done.select(F.col("uuid").alias("_fresh")), fresh, "left_anti")
        out = sessions.join(run, F.col("session_id") == F.col("_of__run"), "left").join(keyed(before, "_before"), F.col("session_id") == F.col("_of__before"), "left")
        former = F.col("_before") if force else F.coalesce("_before", "embedding_sums")
        sums = vectors.added_sums(former, F.col("_run"))
        mean = vectors.mean_of_sums(F.col("_run") if scope == "run" else sums)
        return out.withColumn("summary_embedding", F.coalesce(mean, "summary_embedding")).withColumn("embedding_sums", sums).select(*sessions.columns)

    def search(self, query: str, limit: int = 20) -> list[dict]:
        """The messages nearest to a text, none if nothing is embedded."""
        manifest = self.manifest()
        rows = self.table("messages", manifest).where("embedding is not null")
        if rows.limit(1).isEmpty():
            return []
        config = manifest["config"]
        if "embedding_provider" not in config:
            raise UsageError("no embedder is known to this vault")
        model, found = embedding.run_embedder(config["embedding_provider"], [("query", query)])
        if model.dimensions != config["embedding_dimensions"]:
            raise UsageError(f"the query's vector has {model.dimensions} numbers, those of the vault have {config['embedding_dimensions']}")
        rows = rows.select("session_id", "source_seq", "role", snippet(F.col("content")).alias("snippet"), "embedding")
        near = vectors.nearest(rows, vectors.vector_literal(found["query"]), limit, ("session_id", "source_seq"))
        return [r.asDict() for r in near.select("session_id", "role", "snippet", "distance").collect()]

    def similar(self, session_id: str, limit: int = 10) -> list[dict]:
        return [r.asDict() for r in vectors.similar(self.table("sessions"), "session_id", session_id, limit).collect()]

    # Reports ---------------------------------------------------------------------------------------------------------

    def report(
        self, kind: str | None = None, start: str | None = None, end: str | None = None, project: str | None = None, source: str | None = None,
        save: bool = False, now: datetime | None = None
    ) -> dict:
        """A report's document. A saved one of a period that is over is served again, unless the period moves with today;
        any report of sessions that exist brings the rollup of its period up to date."""
        now = now or utc_now()
        when, scope = period(kind, now, start, end), report.Scope(project, source)
        name = f"{scope.label}|{when.start}|{when.end}"
        manifest = self.manifest()
        if save and when.end < now.date() and when.kind != "last-30-days":
            saved = self.store.read(self._report_file(name))
            if saved is not None:
                return saved | {"from_cache": True}
        sessions = self.table("sessions", manifest)
        base = report.in_scope(sessions, when, scope)
        stamp = now.strftime("%Y-%m-%dT%H:%M:%SZ")
        if report.is_empty(base):
            return report.document(when, scope, stamp, dict(report.EMPTY))
        messages, calls = self.table("messages", manifest), self.table("tool_calls", manifest)
        base = base.persist()
        try:
            doc = report.document(when, scope, stamp, report.metrics(base, messages, calls))
        finally:
            base.unpersist()
        self._roll_up(report.usage_rollup(report.in_scope(sessions, when), messages, calls))
        if save:
            self._save_report(name, doc)
        return doc

    @staticmethod
    def _report_file(name: str) -> str:
        return f"reports/{hashlib.sha256(name.encode()).hexdigest()}.json"

    def _save_report(self, name: str, doc: dict) -> None:
        self.store.write(self._report_file(name), doc, replace=True)

    def rollup(self) -> DataFrame | None:
        """The days that reports have covered, a row for each day, source and project; None before the first report."""
        if not any(name.startswith("date=") for name in self.store.names("usage_days")):
            return None
        return self.spark.read.schema(report.ROLLUP).parquet(f"{self.path}/usage_days")

    def _roll_up(self, new: DataFrame) -> None:
        """The days of a report take the place of what was known of them; a day is a partition, and others aren't touched."""
        days = new.repartition("date").write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        days.parquet(f"{self.path}/usage_days")
