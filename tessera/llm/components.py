"""Connected components of a link graph, as joins and aggregates.

Each round turns every node's links towards the least node it sees (first among all its
neighbours, then among the smaller ones), which shortens paths by half or more; stars
are done after one round.  A node that links with a third of all others is one key of
an aggregate with map-side combining and of a join that adaptive execution can split.
A small graph stays in few tasks, whatever the session's number of shuffle partitions:
each task leaves files for each of a round's shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links that one task takes in a round.
TASK_LINKS = 1 << 16


def shared_folder(df: DataFrame) -> None:
    """checkpoint() writes to the session's spark.checkpoint.dir; one is set here only where that is unset (tests)."""
    from tessera.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long): the least node that
    links lead to.  Links to oneself and repeated links change nothing; rows with a NULL
    end are left out; no links give no rows.  Links only: nodes without any aren't listed.
    """
    shared_folder(edges)
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint()
    state = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
        if now[0] == 0 or now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
        tasks = math.ceil(now[0] / TASK_LINKS)
        e = e.coalesce(tasks)
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().checkpoint()
    raise RuntimeError(f"components: no end after {most_rounds} rounds")
