"""Column expressions that several operators use; all of them stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of all ids of a vault.
NAMESPACE = "01925792-4a7c-4e6f-9d6f-1a2b3c4d5e6f"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version 5 UUID of a name, null where the name is."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    part = lambda start, length: F.substring(digest, start, length)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def session_uuid(source: Column, native_id: Column) -> Column:
    return uuid5(F.concat(source, F.lit(":"), native_id))


def child_uuid(*parts: Column) -> Column:
    return uuid5(F.concat(*[x for k, p in enumerate(parts) for x in ((F.lit(":"), p) if k else (p,))]))


def iso_of_millis(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis.cast("long")), ISO_MILLIS)


def iso_of_seconds(seconds: Column) -> Column:
    """From seconds with a fraction, rounded to milliseconds."""
    return iso_of_millis(F.round(seconds.cast("double") * 1000).cast("long"))


def snippet(text: Column, length: int = 200) -> Column:
    """The first code points, an empty string for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def embed_text(role: Column, content: Column, thinking: Column) -> Column:
    return F.concat(role, F.lit("\n"), F.coalesce(content, thinking, F.lit("")))


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null for a zero vector, a null one, or lengths that differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), 1 - dot(a, b) / norms)


# Forms of a git remote: scheme://host/owner/name and user@host:owner/name.
_REMOTES = (r"^[a-z+]+://[^/]+/+([^/]+)/([^/]+?)(?:\.git)*(?:/.*)?$", r"^(?:[^@/:]+@)?[^/:]+:([^/]+)/([^/]+?)(?:\.git)*$")


def _of_remote(url: Column, group: int) -> Column:
    found = [F.nullif(F.regexp_extract(F.trim(url), form, group), F.lit("")) for form in _REMOTES]
    return F.coalesce(*found)


def owner(url: Column) -> Column:
    """The owner in a git remote's URL; null where it has none."""
    return _of_remote(url, 1)


def repository(url: Column) -> Column:
    """The repository's name in such a URL."""
    return _of_remote(url, 2)
