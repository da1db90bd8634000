"""Node-name functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_node(c: Column) -> Column:
    """Control characters and runs of white space become one space; trimmed; case kept. NULL stays NULL."""
    return F.trim(F.regexp_replace(c, r"(?U)[\x00-\x1f\x7f\s]+", " "))


def clean_nodes(c: Column) -> Column:
    """Normalised names of an array, without NULL and blank elements; a NULL array gives an empty one."""
    names = F.transform(F.coalesce(c, F.array().cast("array<string>")), normalise_node)
    return F.filter(names, lambda x: x.isNotNull() & (x != ""))


def clean_type(c: Column) -> Column:
    """Edge types vary in case and outer blanks."""
    return F.upper(F.trim(c))
