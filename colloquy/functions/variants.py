"""Reading loosely shaped JSON: every getter gives null where the value is missing or of another kind."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY<...>, OBJECT<...>, VOID and so on; null where there is nothing."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("ARRAY")), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False))


def is_null(v: Column) -> Column:
    """Missing, or JSON's null."""
    return v.isNull() | F.coalesce(kind(v) == "VOID", F.lit(False))


def string(v: Column, path: str | None = None) -> Column:
    x = v if path is None else get(v, path)
    return F.when(is_string(x), F.try_variant_get(x, "$", "string"))


def integer(v: Column, path: str | None = None) -> Column:
    x = v if path is None else get(v, path)
    return F.when(kind(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))


def number(v: Column, path: str) -> Column:
    x = get(v, path)
    return F.when(kind(x).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(x, "$", "double"))


def boolean(v: Column, path: str) -> Column:
    x = get(v, path)
    return F.when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))


def array(v: Column, path: str | None = None) -> Column:
    x = v if path is None else get(v, path)
    return F.when(is_array(x), F.try_variant_get(x, "$", "array<variant>"))


def text(v: Column, path: str | None = None) -> Column:
    """A string as it is, anything else as JSON; null where there is nothing."""
    x = v if path is None else get(v, path)
    return F.when(is_string(x), F.try_variant_get(x, "$", "string")).when(~is_null(x), F.to_json(x))


def json(v: Column, path: str) -> Column:
    """As JSON, strings in quotes; null where there is nothing."""
    x = get(v, path)
    return F.when(x.isNotNull(), F.to_json(x))


def joined(parts: Column) -> Column:
    """Texts of an array with line ends between; null where none is left."""
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))
