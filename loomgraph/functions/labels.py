"""Names for a property graph: node labels and relationship types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

DEFAULT_LABEL, DEFAULT_REL = "Entity", "RELATED"


def _safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z_]", "_")


def _prefixed(c: Column, prefix: str) -> Column:
    return F.when(F.regexp_like(c, F.lit("^[0-9]")), F.concat(F.lit(prefix), c)).otherwise(c)


def label_of(kind: Column) -> Column:
    name = _safe(strip(kind))
    name = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(DEFAULT_LABEL)).otherwise(_prefixed(name, "T_"))


def rel_type_of(kind: Column) -> Column:
    name = _safe(F.upper(strip(kind)))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(DEFAULT_REL)).otherwise(_prefixed(name, "R_"))


def no_nulls(c: Column) -> Column:
    """A text array as a property: a null element becomes "null"."""
    return F.transform(c, lambda x: F.coalesce(x, F.lit("null")))
