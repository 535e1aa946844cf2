"""Joins on keys of which some may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one HEAD-th of the counted rows is frequent; there are fewer than HEAD of them.
HEAD = 10_000


def met(rows: DataFrame, keys: DataFrame, on: list[str], times: str, head: int | None = None) -> DataFrame:
    """The inner join of `rows` with `keys` on `on`; `keys` has one row a key and, in `times`, how often `rows` show it.

    Frequent keys are broadcast, of which `head` bounds the number whatever the input; the others are dealt out by
    key, where none has more than one `head`-th of the rows.
    """
    head = head or HEAD
    total = keys.agg(F.sum(times)).first()[0] or 0
    often = F.col(times) * head > F.lit(total)
    frequent, others = F.broadcast(keys.where(often)), keys.where(~often)
    return rows.join(frequent, on).unionByName(rows.join(frequent.select(*on), on, "left_anti").join(others, on))
