"""Reverse closure: what depends on the seeds, directly or through others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import work


def reverse_closure(edges: DataFrame, seeds: DataFrame, edge_keys: Sequence[str] = (), seed_keys: Sequence[str] = (), max_rounds: int = 100_000) -> DataFrame:
    """``seeds`` and everything that reaches one of them over ``edges(src, dst)``, src depending on dst.

    ``seeds`` has ``node_id``, and per row the ``edge_keys`` that both tables share (a project) and ``seed_keys`` of its own (a change
    set); the closure is taken for each combination. Cycles, self edges, repeated rows and edges to unknown ids are allowed; rows with a null id are dropped.

    Semi-naive: a round joins only the nodes found in the round before. The edges are dealt out by dst once; a frontier that was counted to
    be small is broadcast to them, a large one joins them by a shuffle of itself. Each frontier is checkpointed, so lineage doesn't grow with
    the graph's depth and a lost executor costs one round.
    """
    keys = [*edge_keys, *seed_keys]
    spark = edges.sparkSession
    cols = [*keys, "node_id"]
    e = edges.select(*edge_keys, "src", F.col("dst").alias("node_id")).where("src IS NOT NULL AND node_id IS NOT NULL AND src <> node_id")
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *edge_keys, "node_id").persist()
    try:
        frontier = work.checkpoint(seeds.select(*cols).where("node_id IS NOT NULL").distinct())
        seen, n = [frontier], frontier.count()
        total = n
        for _ in range(max_rounds):
            if not n:
                break
            step = e.join(work.small(frontier, n), [*edge_keys, "node_id"]).select(*keys, F.col("src").alias("node_id")).distinct()
            known = reduce(DataFrame.unionByName, seen)
            frontier = work.checkpoint(step.join(work.small(known, total), cols, "left_anti"))
            n = frontier.count()
            total += n
            seen.append(frontier)
            if len(seen) >= 16:  # many small parts read slowly
                seen = [work.checkpoint(reduce(DataFrame.unionByName, seen).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))]
        else:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        return reduce(DataFrame.unionByName, seen)
    finally:
        e.unpersist()
