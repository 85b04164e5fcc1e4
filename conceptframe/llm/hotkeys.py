"""Joins to a table of groups whose largest groups may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptframe.llm.shared import spread


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows to the one group row of their key; `size` is the group's number of rows.

    Groups with more than the share of half a partition are fewer than twice the partitions: that is the
    proven bound of what is broadcast, and their rows stay where they are. The others are joined by a
    shuffle in which no key is large. `groups` is read several times and should be a written table.
    """
    parts = spread(rows.sparkSession)
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(1, total // (2 * parts))
    hot, cold = groups.filter(F.col(size) > bound), groups.filter(F.col(size) <= bound)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(few.join(cold.hint("merge"), key))
