"""Tables over all cores, in tasks of like size."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Stored bytes of a table that one task takes, and the largest number of tasks.
TASK_BYTES, MOST_TASKS = 8 << 20, 20_000


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table over the session's cores, in as many tasks as its bytes ask for.

    One task reads all rows of a row group, into however many splits its bytes are
    cut: a small table may be one, and a large one a few that leave most cores idle
    and the longest task with much of the work.  The shuffle writes the table once.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(MOST_TASKS, -(-size // TASK_BYTES))
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)
