"""What can go wrong, by kind."""


class VaultError(Exception):
    """Any failure that is told to the user; exit status 1."""


class UsageError(VaultError):
    """Flags or arguments that don't go together or don't parse."""


class NotFound(VaultError):
    """A session, file or vault that isn't there."""


class ParseError(VaultError):
    """A session file of which nothing can be read."""


class EmbedderError(VaultError):
    """An embedder that failed or answered wrongly."""


class QueryError(VaultError):
    """A full-text pattern that isn't in the grammar."""
