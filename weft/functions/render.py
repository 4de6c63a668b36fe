"""Values as text, and results as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown(value: Column, kind: str) -> Column:
    return value.cast("string")


def _text(value: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(value.cast("array<string>"), ", "), F.lit("]"))
    return value.cast("string")


def lines(result: DataFrame) -> DataFrame:
    """One string column: a value; ``key:[values]`` or ``key:n`` for groups; ``[a:x, b:y]`` for several columns."""
    kinds = dict(result.dtypes)
    if result.columns == ["value"]:
        line = _text(F.col("value"), kinds["value"])
    elif result.columns[0] == "key":
        line = F.concat_ws(":", _text(F.col("key"), kinds["key"]), _text(F.col(result.columns[1]), kinds[result.columns[1]]))
    else:
        parts = [F.concat(F.lit(f"{c}:"), F.coalesce(_text(F.col(f"`{c}`"), kinds[c]), F.lit(""))) for c in result.columns]
        line = F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    return result.select(line.alias("line"))
