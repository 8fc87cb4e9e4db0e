"""Where the tools keep their sessions by default, and which files a path holds. Driver side, small listings."""

import os
from pathlib import Path

# Folders and files under the home and XDG folders, in order of preference.
CLAUDE = (".claude/projects",)
CODEX = (".codex/sessions", ".config/codex/sessions")
OPENCODE = (".config/opencode/opencode.db",)
COPILOT = (".config/Code/User/workspaceStorage", ".config/Code - Insiders/User/workspaceStorage")


def default_roots(home: str, env: dict[str, str] | None = None) -> dict[str, list[str]]:
    """The roots that exist, by source. Of the places for the hermes store the first counts."""
    env = os.environ if env is None else env
    under = lambda names: [str(Path(home, n)) for n in names if Path(home, n).exists()]
    data, config = env.get("XDG_DATA_HOME"), env.get("XDG_CONFIG_HOME")
    hermes = [
        Path(home, ".hermes/state.db"), *([Path(data, "hermes/state.db")] if data else []), Path(home, ".local/share/hermes/state.db"),
        *([Path(config, "hermes/state.db")] if config else []), Path(home, ".config/hermes/state.db")
    ]
    found = {
        "claude": under(CLAUDE), "codex": under(CODEX), "opencode": under(OPENCODE), "hermes": [str(p) for p in hermes if p.exists()][:1],
        "copilot": under(COPILOT)
    }
    return {source: roots for source, roots in found.items() if roots}


def resolve_store(path: str, default: str | None = None) -> str | None:
    """The SQLite file a path means: itself, the default name in a folder, or the folder's first .db or .sqlite."""
    if os.path.isfile(path):
        return path
    if default and os.path.isfile(os.path.join(path, default)):
        return os.path.join(path, default)
    names = sorted(n for n in os.listdir(path) if n.endswith((".db", ".sqlite"))) if os.path.isdir(path) else []
    return os.path.join(path, names[0]) if names else None


def session_files(path: str) -> dict[str, float]:
    """Modification times of the session files under a path: .jsonl at any depth but in `subagents`, stores at the top."""
    out = {}

    def add(name: str) -> None:
        try:
            out[name] = os.stat(name).st_mtime
        except OSError:
            pass

    if os.path.isfile(path):
        add(path)
    for folder, folders, names in os.walk(path):
        folders[:] = [f for f in folders if f != "subagents"]
        for name in names:
            if name.endswith(".jsonl") or folder == path and name.endswith((".db", ".sqlite")):
                add(os.path.join(folder, name))
    return out
