"""Limits on queries, all off unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.paths import Path, PathError, root
from loomdoc.operators.leaves import subtree


def check(path: Path, max_steps: int | None = None, descend: bool = True, filters: bool = True) -> Path:
    """path, or an error if it has more steps, or kinds of step, than allowed."""
    kinds = [s[0] for s in path.steps]
    if max_steps is not None and len(kinds) > max_steps or not descend and "descend" in kinds or not filters and "where" in kinds:
        raise PathError("the path is not allowed here")
    return path


def allowed(allow: list[str] | None = None, block: tuple[str, ...] = (), column: str = "pointer") -> Column:
    """Whether a node may be seen: at, below or above an allowed pointer, and not below a blocked one."""
    ok = F.lit(allow is None)
    for p in allow or ():
        ok = ok | subtree(p, column) | F.lit(p).startswith(F.concat(F.col(column), F.lit("/")))
    for p in block:
        ok = ok & ~subtree(p, column)
    return ok


def at_most(df: DataFrame, n: int) -> DataFrame:
    """df, or an error when it has over n rows; at most n + 1 are counted."""
    seen = df.limit(n + 1).agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(seen)).where(F.when(F.col("_n") <= n, True).otherwise(F.raise_error(F.lit(f"more than {n} results")).cast("boolean"))).drop("_n")


#: Fixed values of the secure preset: how deep a node may be, and how many nodes a document may yield and a path may pass.
SECURE = {"max_depth": 20, "max_results": 1000, "max_nodes": 10000}


def secure_query(df: DataFrame, path: Path, column: str, keep: tuple[str, ...] = (), max_depth: int = SECURE["max_depth"], max_results: int = SECURE["max_results"], max_nodes: int = SECURE["max_nodes"]) -> DataFrame:
    """As paths.query for paths that aren't trusted: no descent, and an error where a document passes a limit.

    max_nodes bounds the nodes of every part of the path on the way to the last.
    """
    check(path, descend=False)
    doc = root(df, column)
    seen = sum((F.size(Path(path.steps[:i]).nodes(doc)[0]) for i in range(1, len(path.steps))), F.lit(0))
    nodes, _ = path.nodes(doc)
    deep = F.exists(nodes, lambda n: F.size(F.split(n["pointer"], "/")) - 1 > max_depth)
    ok = F.when((F.size(nodes) <= max_results) & (seen <= max_nodes) & ~deep, nodes).otherwise(F.raise_error(F.lit("a document passes the limits")))
    return df.select(*keep, F.posexplode(ok).alias("ord", "node")).select(*keep, "ord", "node.pointer", "node.value")
