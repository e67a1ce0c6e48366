"""Hierarchies: structural formulas, aggregation over all their levels, summation and constraint relations.

An aggregated key is told from a missing one by a flag column ``<key>__agg``.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.meta import SeriesFrame, quoted

AGGREGATED = "<aggregated>"
#: Nodes of a hierarchy that the driver may hold as a matrix.
MOST_NODES = 2000


def flag(key: str) -> str:
    return f"{key}__agg"


def parse_spec(spec: str) -> list[tuple[str, ...]]:
    """Key sets of a formula: ``a / b`` nests, ``a * b`` crosses, ``+`` adds, ``- 1`` drops the total; by size, then order."""
    names: dict[str, str] = {}
    text = spec
    for k, part in enumerate(spec.split("`")[1::2]):
        names[f"__q{k}"] = part
        text = text.replace(f"`{part}`", f"__q{k}")
    order: list[str] = []

    def name(n: str) -> str:
        out = names.get(n, n)
        if out not in order:
            order.append(out)
        return out

    def terms(node: ast.expr) -> tuple[list[frozenset[str]], bool]:
        """(terms, whether the total is left out)"""
        if isinstance(node, ast.Name):
            return [frozenset([name(node.id)])], False
        if isinstance(node, ast.Constant) and node.value in (0, 1):
            return [], node.value == 0
        if not isinstance(node, ast.BinOp):
            raise ValueError(f"not a structural formula: {spec}")
        if isinstance(node.op, ast.Sub):
            left, no_total = terms(node.left)
            if not (isinstance(node.right, ast.Constant) and node.right.value == 1):
                gone = terms(node.right)[0]
                return [t for t in left if t not in gone], no_total
            return left, True
        (left, a), (right, b) = terms(node.left), terms(node.right)
        if isinstance(node.op, ast.Add):
            out = left + right
        elif isinstance(node.op, ast.Mult):
            out = left + right + [x | y for x in left for y in right]
        elif isinstance(node.op, ast.Div):
            whole = frozenset().union(*left)
            out = left + [whole | y for y in right]
        else:
            raise ValueError(f"not a structural formula: {spec}")
        return list(dict.fromkeys(out)), a or b

    found, no_total = terms(ast.parse(text, mode="eval").body)
    sets = sorted((tuple(k for k in order if k in t) for t in found), key=lambda t: (len(t), [order.index(k) for k in t]))
    return ([] if no_total else [()]) + sets


def aggregate_key(frame: SeriesFrame, spec: str | None = None, aggs: Mapping[str, Column] | None = None, partial: Mapping[str, str] | None = None, levels: Sequence[tuple[str, ...]] | None = None) -> SeriesFrame:
    """Every level of ``spec`` (default: all keys crossed), with ``aggs`` evaluated over the rows of each level.

    ``partial`` names aggregates that add up (column: sum, min, max or count of
    it): rows are then aggregated at the finest level first, so only cells, not
    rows, are expanded over the levels.  ``aggs`` may be anything, such as a
    median, and always sees all rows.  ``levels`` keeps some of the key sets.  Keys
    that the formula doesn't name are aggregated away.  The result has for each
    key a flag column; a missing key stays apart from an aggregated one.
    """
    sets = parse_spec(spec) if spec else parse_spec(" * ".join(f"`{k}`" for k in frame.key))
    keys = [k for k in frame.key if any(k in s for s in sets)]
    if unknown := {k for s in sets for k in s} - set(frame.key):
        raise ValueError(f"not keys: {sorted(unknown)}")
    sets = [s for s in sets if levels is None or s in levels]
    df, index = frame.df, frame.index
    if partial and not aggs:
        how = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
        df = df.groupBy(*quoted((index, *keys))).agg(*[how[f](c).alias(f"{f}_{c}") for c, f in partial.items()])
        aggs = {f"{f}_{c}": (F.sum if f in ("sum", "count") else how[f])(f"{f}_{c}") for c, f in partial.items()}
    out = df.groupingSets([quoted((index, *s)) for s in sets], *quoted((index, *keys))).agg(*[F.grouping(f"`{k}`").cast("boolean").alias(flag(k)) for k in keys], *[c.alias(n) for n, c in aggs.items()])
    out = out.select(index, *[c for k in keys for c in (k, flag(k))], *aggs)
    return SeriesFrame(out, tuple(c for k in keys for c in (k, flag(k))), index, frame.interval)


def agg_vec(df: DataFrame, key: str, aggregated: Column) -> DataFrame:
    """Mark a key as aggregated by hand, for hierarchies that aren't balanced."""
    hide = F.coalesce(aggregated, F.lit(False))
    return df.withColumns({key: F.when(~hide, F.col(f"`{key}`")), flag(key): hide})


def is_aggregated(df: DataFrame, key: str) -> Column:
    """False throughout for an ordinary column."""
    return F.col(f"`{flag(key)}`") if flag(key) in df.columns else F.lit(False)


def agg_equal(a: str, b: Column | str, df: DataFrame) -> Column:
    """Both aggregated, or equal values (missing equals missing, and an aggregated cell too); a text ``<aggregated>`` means the flag."""
    mine = is_aggregated(df, a)
    if isinstance(b, str) and b == AGGREGATED:
        return mine
    if isinstance(b, str) and b in df.columns:
        return (mine & is_aggregated(df, b)) | F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))
    value = b if isinstance(b, Column) else F.lit(b)
    return F.col(f"`{a}`").eqNullSafe(value)


def is_missing(df: DataFrame, key: str) -> Column:
    return F.col(f"`{key}`").isNull() & ~is_aggregated(df, key)


def format_key(df: DataFrame, key: str) -> Column:
    """The key as text, ``<aggregated>`` where it is."""
    return F.when(is_aggregated(df, key), F.lit(AGGREGATED)).otherwise(F.trim(F.col(f"`{key}`").cast("string")))


def key_order(keys: Sequence[str]) -> list[Column]:
    """Sort order: aggregated last."""
    return [c for k in keys for c in (F.col(f"`{flag(k)}`").asc(), F.col(f"`{k}`").asc_nulls_first())]


def recode(df: DataFrame, key: str, names: Mapping[str, str]) -> DataFrame:
    """Other values for a key; flags stay."""
    k = F.col(f"`{key}`")
    out = k
    for a, b in names.items():
        out = F.when(k == a, F.lit(b)).otherwise(out)
    return df.withColumn(key, out)


def base_keys(frame: SeriesFrame) -> list[str]:
    return [k for k in frame.key if flag(k) in frame.key]


def node_key(keys: Sequence[str]) -> Column:
    """One text for a node, distinct for missing and aggregated keys."""
    parts = [F.when(F.col(f"`{flag(k)}`"), F.lit("*")).otherwise(F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.col(f"`{k}`").cast("string"), r"([|\\])", r"\\$1")), F.lit("?"))) for k in keys]
    return F.concat_ws("|", *parts)


def nodes(frame: SeriesFrame) -> DataFrame:
    """(node, keys and flags): the distinct nodes of a hierarchy."""
    keys = base_keys(frame)
    return frame.df.select(*quoted(frame.key)).distinct().withColumn("node", node_key(keys))


def _ancestors(frame: SeriesFrame, own: DataFrame, name: str) -> DataFrame:
    """(``name``, node): each node of ``own`` with itself and all keys that it could be summed into.

    A node has 2 to the number of keys of them at most, whatever the number of
    nodes, so what is joined to them is joined by equality.
    """
    keys = base_keys(frame)
    up = own.select(F.col("node").alias(name), *quoted(frame.key))
    for k in keys:
        rows = F.array(F.struct(F.col(f"`{k}`").alias("x"), F.col(f"`{flag(k)}`").alias("g")), F.struct(F.lit(None).cast(frame.df.schema[k].dataType).alias("x"), F.lit(True).alias("g")))
        up = up.withColumn("__e", F.explode(F.array_distinct(rows))).withColumn(k, F.col("__e.x")).withColumn(flag(k), F.col("__e.g")).drop("__e")
    return up.select(name, node_key(keys).alias("node"))


def leaves(frame: SeriesFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """Nodes that no other node refines: nobody's ancestor but their own.  In a hierarchy that isn't balanced they may have aggregated keys."""
    n = nodes(frame) if all_nodes is None else all_nodes
    above = _ancestors(frame, n, "below").filter("below <> node").select("node").distinct()
    return n.join(above, "node", "left_anti")


def coherent_smat(frame: SeriesFrame, with_bottom: bool = True, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, leaf, value): 1 where the leaf is summed into the node; ``all_nodes`` is a saved result of :func:`nodes`."""
    n = nodes(frame) if all_nodes is None else all_nodes
    own = leaves(frame, n)
    out = _ancestors(frame, own, "leaf").join(n.select("node"), "node", "left_semi").select("node", "leaf", F.lit(1).alias("value"))
    return out if with_bottom else out.join(own.select("node"), "node", "left_anti")


def coherent_cmat(frame: SeriesFrame) -> DataFrame:
    """(constraint, node, value) of [I -A]: an aggregate less its leaves is zero."""
    a = coherent_smat(frame, with_bottom=False)
    tops = a.select(F.col("node").alias("constraint")).distinct()
    eye = tops.select("constraint", F.col("constraint").alias("node"), F.lit(1).alias("value"))
    return eye.union(a.select(F.col("node").alias("constraint"), F.col("leaf").alias("node"), F.lit(-1).alias("value")))


def incoherence(frame: SeriesFrame, value: str) -> DataFrame:
    """(constraint, index, gap): how far each aggregate is from the sum of its leaves."""
    c = coherent_cmat(frame).withColumnRenamed("value", "__c")
    rows = frame.df.withColumn("node", node_key(base_keys(frame)))
    return rows.join(c, "node").groupBy("constraint", frame.index).agg(F.sum(F.col(f"`{value}`") * F.col("__c")).alias("gap"))
