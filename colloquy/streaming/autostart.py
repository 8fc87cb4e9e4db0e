"""The text of a service that keeps `watch` running; nothing is installed or run here."""

import shlex
import sys

UNIT = """[Unit]
Description=Take in session files as they change

[Service]
ExecStart={command}
Restart=on-failure

[Install]
WantedBy=default.target
"""


def service_text(vault: str, paths: list[str], remove: bool = False) -> str:
    """A systemd user unit, or how to take it away."""
    if remove:
        return "systemctl --user disable --now colloquy-watch.service && rm ~/.config/systemd/user/colloquy-watch.service"
    return UNIT.format(command=shlex.join([sys.executable, "-m", "colloquy", "--vault", vault, "watch", *paths]))
