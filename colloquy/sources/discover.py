"""What the default roots of all tools hold, without taking it in."""

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.periods import Recency
from .lines import detect_kinds, session_lines
from .roots import default_roots, resolve_store
from .sqlite import store_rows

#: Sources whose sessions lie in a store, and the store's name in a folder.
STORES = {"opencode": "opencode.db", "hermes": "state.db"}


@dataclass
class Discovery:
    """A source's roots, the paths to take in, the number of sessions found there, and what went wrong by root."""

    source: str
    roots: list[str]
    paths: list[str] = field(default_factory=list)
    sessions: int = 0
    errors: list[str] = field(default_factory=list)


def discover_all(spark: SparkSession, home: str, recency: Recency = Recency(), env: dict[str, str] | None = None) -> list[Discovery]:
    """One for each source that has a root. A root that fails stops no other; one without sessions is no error."""
    out = []
    for source, roots in default_roots(home, env).items():
        found = Discovery(source, roots)
        for root in roots:
            try:
                path = resolve_store(root, STORES[source]) if source in STORES else root
                if path is None:
                    continue
                found.sessions += _count(spark, source, path, recency)
                found.paths.append(path)
            except Exception as e:  # noqa: BLE001
                found.errors.append(f"{root}: {str(e).strip().splitlines()[0]}")
        out.append(found)
    return out


def _count(spark: SparkSession, source: str, path: str, recency: Recency) -> int:
    if source in STORES:
        rows = store_rows(spark, path, recency).where(F.col("table").isin("session", "error")).groupBy("table").agg(
            F.count("*").alias("n"), F.first("row").alias("row")
        ).collect()
        broken = [r.row for r in rows if r["table"] == "error"]
        if broken:
            raise ValueError(broken[0])
        return sum(r.n for r in rows)
    return detect_kinds(session_lines(spark, path, recency)).where(F.startswith("kind", F.lit(source))).count()


def total_count(found: list[Discovery]) -> int:
    return sum(d.sessions for d in found)
