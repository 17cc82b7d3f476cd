"""Reports of computed impact, as rows and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import work
from ..functions import paths
from .impact import SET

COUNTS = ["selected", "total", "skip_pct"]


def skip_percent(selected: Column, total: Column) -> Column:
    """The share not selected, in percent, half to even; 0 of nothing."""
    return F.when(total > 0, F.bround((total - selected) / total * 100, 0)).otherwise(F.lit(0.0)).cast("double")


def totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project").agg(F.count_if("has_tests").alias("total"))


def report(impact: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row a target: ``(project, change_set_id, target, marker, selected, total, skip_pct)``.

    Markers: ``*`` for a changed node, ``~`` for one only there for an unresolved import, else a blank. The lists are parted by hash sets, no list is searched for each target.
    """
    unchanged = F.array_except("targets", "changed_targets")
    parts = {"*": F.array_intersect("targets", "changed_targets"), "~": F.array_intersect(unchanged, "uncertain_targets"), " ": F.array_except(unchanged, "uncertain_targets")}

    def marked(m: str) -> Column:
        return F.transform(parts[m], lambda t: F.struct(t.alias("target"), F.lit(m).alias("marker")))

    sets = with_total(impact.select(*SET, F.size("targets").cast("long").alias("selected"), F.concat(*map(marked, parts)).alias("t")), nodes)
    return sets.select(*SET, F.explode("t").alias("t"), *COUNTS).select(*SET, "t.*", *COUNTS)


def report_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``report`` from the rows of ``impact_rows`` by joins, for target lists too long for arrays."""
    marked = work.checkpoint(markers(rows))
    n = work.checkpoint(with_total(marked.groupBy(*SET).agg(F.count("*").alias("selected")), nodes))
    return marked.join(work.small(n, n.count()), SET).select(*SET, "target", "marker", *COUNTS)


def with_total(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Change sets with ``selected``, and the project's total and the share left out beside it."""
    r = sets.join(totals(nodes), "project", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return r.withColumn("skip_pct", skip_percent(F.col("selected"), F.col("total")))


def markers(rows: DataFrame) -> DataFrame:
    """The markers from ``impact_rows`` by joins, for target lists too long for arrays."""
    key = [*SET, "node_id"]
    flags = rows.groupBy(*key).agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("target", "changed", "uncertain")])
    marker = F.when(F.col("changed"), "*").when(F.col("uncertain"), "~").otherwise(" ")
    return flags.where("target").select(*SET, F.col("node_id").alias("target"), marker.alias("marker"))


def full_run_report(impact: DataFrame, root: Column) -> DataFrame:
    """``(project, change_set_id, ord, reason)`` with reasons relative to ``root`` where inside it."""
    r = impact.where("full_run").select(*SET, F.posexplode("full_run_reasons").alias("ord", "path"))
    return r.select(*SET, "ord", paths.relative_or_self(root, F.col("path")).alias("reason"))


def changed_report(changes: DataFrame, root: Column) -> DataFrame:
    """``(project, change_set_id, n_changed, ord, path)``: the verbose list."""
    from .classify import ordered_changes

    c = ordered_changes(changes)
    n = c.groupBy(*SET).agg(F.count("*").alias("n_changed"))
    return c.join(n, SET).select(*SET, "n_changed", "ord", paths.relative_or_self(root, F.col("path")).alias("path"))


HINT = "An import of a fixed name would end that."
HINT_JEST = "An import of a fixed path, or an alias in moduleNameMapper or tsconfig, would end that."


def relative_text(path: str, root: str) -> str:
    return path[len(root) + 1 :] if path.startswith(root.rstrip("/") + "/") else path


def text(row, total: int, analyzer: str, root: str) -> list[str]:
    """The lines for one change set, from its row of ``compute``."""
    if row["full_run"]:
        return [f"tidegraph: all tests run ({analyzer}), as these changes could reach any of them:", *(f"  - {relative_text(r, root)}" for r in row["full_run_reasons"])]
    targets = row["targets"]
    if not targets:
        return ["tidegraph: the change reaches no test"]
    pct = (total - len(targets)) / total * 100 if total else 0.0
    out = [f"tidegraph: {len(targets)} of {total} test targets to run ({analyzer}, {pct:.0f}% left out)"]
    changed, uncertain = set(row["changed_targets"]), set(row["uncertain_targets"])
    if uncertain:
        out.append(f"tidegraph: {len(uncertain)} of them, marked ~, depend on an import whose target only shows at run time, and run with every change. {HINT_JEST if analyzer == 'jest' else HINT}")
    return out + [f"  {'*' if t in changed else '~' if t in uncertain else ' '} {relative_text(t, root)}" for t in targets]
