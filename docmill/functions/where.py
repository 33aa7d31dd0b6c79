"""Metadata filters: a nested dict compiled to a Column predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def predicate(where: dict | None, columns: list[str]) -> Column:
    """Compile {"key": {"$eq": v}}, "$ne", "$in", "$and", "$or"; a bare value is equality.

    Values are compared as text; a missing column or null counts as "None"; an unknown operator
    never holds. An empty filter always holds.
    """
    parts = []
    for key, rule in (where or {}).items():
        if key == "$and":
            parts += [predicate(r, columns) for r in rule]
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, (predicate(r, columns) for r in rule), F.lit(False)))
        else:
            value = F.coalesce(F.col(key).cast("string"), F.lit("None")) if key in columns else F.lit("None")
            for op, wanted in (rule if isinstance(rule, dict) else {"$eq": rule}).items():
                if op == "$eq":
                    parts.append(value == F.lit(str(wanted)))
                elif op == "$ne":
                    parts.append(value != F.lit(str(wanted)))
                elif op == "$in":
                    parts.append(value.isin([str(w) for w in wanted]))
                else:
                    parts.append(F.lit(False))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
