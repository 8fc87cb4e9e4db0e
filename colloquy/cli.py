"""Commands. Status 2: arguments that don't parse; 1: a failure that is told; 0 otherwise."""

import argparse
import os
import sys

from .errors import VaultError, UsageError
from .operators import report as reports
from .operators.periods import KINDS, period, recency, utc_now
from .sources.discover import discover_all, total_count


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="colloquy", description="Session analytics on Spark")
    top.add_argument("--vault", default=os.path.expanduser("~/.colloquy/vault"), help="where the vault is")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *arguments):
        sub = commands.add_parser(name, help=text)
        for names, options in arguments:
            sub.add_argument(*names, **options)

    arg = lambda *names, **options: (names, options)
    window = (arg("--recency", type=int, help="the last N days"), arg("--since", help="since YYYY-MM-DD"))
    add("init", "make an empty vault", arg("path", nargs="?"), arg("--force", action="store_true", help="run again on a vault that is there"))
    add(
        "setup", "init, find sessions, take them in, embed", *window, arg("--ingest-recency", type=int), arg("--embed-recency", type=int), arg("--provider"),
        arg("--force", action="store_true"), arg("-y", "--yes", action="store_true")
    )
    add("ingest", "take in session files", arg("path"), *window)
    add("grep", "search messages for words", arg("pattern"), arg("--limit", type=int, default=20), arg("--project"))
    add("export", "a session's transcript", arg("session_id"), arg("--format", default="markdown", choices=("markdown", "md")))
    add(
        "embed", "embed messages by an external program", arg("--provider", required=True), arg("--limit", type=int), *window,
        arg("--force", action="store_true")
    )
    add("search", "messages nearest to a text", arg("query"), arg("--limit", type=int, default=20))
    add("similar", "sessions like a session", arg("session_id"), arg("--limit", type=int, default=10))
    add(
        "watch", "take in files as they change", arg("paths", nargs="*"), arg("--debounce", type=int, default=1500), arg("--interval", type=int, default=60),
        arg("--once", action="store_true")
    )
    add("projects", "the folders that sessions ran in", arg("--remotes", action="store_true", help="ask git for their origins first"))
    add("vacuum", "remove files that no reader needs any more")
    add("autostart", "a service file that runs watch", arg("paths", nargs="*"), arg("--remove", action="store_true"))
    add(
        "report", "usage in a period", arg("--period", choices=KINDS[:-1]), arg("--from", dest="start"), arg("--to", dest="end"),
        arg("--format", default="markdown", choices=("markdown", "md", "json")), arg("--save", action="store_true"), arg("--project"), arg("--source")
    )
    return top


def setup_windows(args, now) -> tuple:
    """Windows for taking in and for embedding. One for both, or one for each; the embedding's defaults to the other's."""
    split = args.ingest_recency is not None or args.embed_recency is not None
    if split and (args.recency is not None or args.since is not None):
        raise UsageError("give either one window or one for each step")
    if not split:
        both = recency(args.recency, args.since, now)
        return both, both
    wide = recency(args.ingest_recency, None, now)
    return wide, recency(args.embed_recency, None, now) if args.embed_recency is not None else wide


def discover(home: str) -> list[str]:
    from .sources.roots import default_roots

    return [root for roots in default_roots(home).values() for root in roots]


def confirm(question: str) -> bool:
    try:
        return input(f"{question} [y/N] ").strip().lower() in ("y", "yes")
    except EOFError:
        return False


def session(name: str = "colloquy"):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _take_in_all(vault, paths, window, say) -> int:
    """Each root by itself; a root that fails is told, recorded and passed over. Returns how many sessions came."""
    total = 0
    for path in paths:
        try:
            total += vault.ingest(path, window).count()
        except VaultError as e:
            say(f"{path}: {e}")
            vault.note(path, str(e))
    return total


def main(argv: list[str] | None = None, say=print) -> int:
    args, now = _parser().parse_args(argv), utc_now()
    try:
        return _run(args, now, say)
    except VaultError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args, now, say) -> int:
    """Flags are checked before the vault is opened."""
    window = recency(args.recency, args.since, now) if args.command in ("ingest", "embed") else None
    windows = setup_windows(args, now) if args.command == "setup" else None
    if args.command == "report":
        period(args.period, now, args.start, args.end)
    if args.command == "autostart":
        from .streaming.autostart import service_text

        say(service_text(args.vault, args.paths, remove=args.remove))
        return 0

    from .vault import Vault

    vault = Vault(session(), getattr(args, "path", None) or args.vault if args.command == "init" else args.vault)
    if args.command == "init":
        if vault.exists() and not args.force:
            raise UsageError(f"there is a vault at {vault.path}; --force brings it to the present format")
        vault.init()
        say(f"vault at {vault.path}")
    elif args.command == "setup":
        found = discover_all(vault.spark, os.path.expanduser("~"), windows[0])
        say(f"vault: {vault.path}")
        for d in found:
            say(f"{d.source}: {d.sessions} sessions in {', '.join(d.roots)}")
            for error in d.errors:
                say(f"  {error}")
        say(f"{total_count(found)} sessions found")
        if not args.yes and not confirm("Take these in?"):
            say("nothing done")
            return 0
        vault.init()
        say(f"{_take_in_all(vault, [p for d in found for p in d.paths], windows[0], say)} sessions taken in")
        provider = args.provider or vault.manifest()["config"].get("embedding_provider")
        say(f"{vault.embed(provider, windows[1], args.force)} messages embedded" if provider else "nothing embedded: no provider is known")
    elif args.command == "ingest":
        count = 0
        for r in vault.ingest(args.path, window).toLocalIterator():
            say(f"{r['session_id']} {r['source']}: {r['message_count']} messages, {r['tool_call_count']} tool calls, {r['total_tokens']} tokens")
            count += 1
        say(f"{count} sessions")
    elif args.command == "grep":
        for r in vault.grep(args.pattern, args.limit, args.project):
            say(f"{r['session_id']} [{r['role']}] {r['snippet']}")
    elif args.command == "export":
        say(vault.export(args.session_id))
    elif args.command == "embed":
        say(f"{vault.embed(args.provider, window, args.force, args.limit)} messages embedded")
    elif args.command == "search":
        found = vault.search(args.query, args.limit)
        for r in found:
            say(f"{r['distance']:.4f} {r['session_id']} [{r['role']}] {r['snippet']}")
        if not found:
            say("nothing is embedded yet; run embed first")
    elif args.command == "similar":
        found = vault.similar(args.session_id, args.limit)
        for r in found:
            say(f"{r['distance']:.4f} {r['session_id']}")
        if not found:
            say("the session has no vector, or no other has; run embed first")
    elif args.command == "projects":
        if args.remotes:
            say(f"{vault.find_remotes()} remotes known")
        for r in vault.projects().orderBy("root_path").toLocalIterator():
            say(f"{r['root_path']} {r['slug']} {r['git_owner'] or '-'}/{r['git_repo'] or '-'}: {r['session_count']} sessions")
    elif args.command == "vacuum":
        say(f"{vault.vacuum()} folders and files removed")
    elif args.command == "watch":
        from .streaming.watch import watch

        query = watch(vault, args.paths or discover(os.path.expanduser("~")), f"{vault.path}/watch", args.debounce, args.once, say, args.interval)
        if not args.once:
            query.awaitTermination()
    else:
        doc = vault.report(args.period, args.start, args.end, args.project, args.source, args.save, now)
        if not doc["metrics"]["total_sessions"]:
            say("no sessions found")
        else:
            say(reports.render_json(doc) if args.format == "json" else reports.render_markdown(doc))
    return 0
