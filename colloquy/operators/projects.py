"""Project folders: their name, and the git remote they come from where one is known."""

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import owner, repository

REMOTES = "root_path string, git_remote string"


def projects(sessions: DataFrame, remotes: DataFrame | None = None) -> DataFrame:
    """root_path, slug, git_remote, git_owner, git_repo and session_count of each folder that sessions ran in. remotes:
    root_path and git_remote; a folder without one, or with one that isn't a URL of a repository, has nulls."""
    found = sessions.where("project_root is not null").groupBy(F.col("project_root").alias("root_path"))
    found = found.agg(F.max("project_slug").alias("slug"), F.count_distinct("session_id").alias("session_count"))
    if remotes is None:
        found = found.withColumn("git_remote", F.lit(None).cast("string"))
    else:
        known = remotes.groupBy("root_path").agg(F.max("git_remote").alias("git_remote"))
        found = found.join(known, "root_path", "left")
    return found.select(
        "root_path", "slug", "git_remote", owner(F.col("git_remote")).alias("git_owner"), repository(F.col("git_remote")).alias("git_repo"), "session_count"
    )


def read_remotes(roots: list[str]) -> list[tuple[str, str]]:
    """The origin of each folder that is a git work tree on this machine; the others are left out."""
    out = []
    for root in roots:
        try:
            done = subprocess.run(["git", "-C", root, "remote", "get-url", "origin"], capture_output=True, text=True, check=False, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            continue
        if not done.returncode and done.stdout.strip():
            out.append((root, done.stdout.strip()))
    return out
