"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import named, spare
from .scratch import discard, running_total, save


def count_words(text: Column) -> Column:
    """Maximal runs of characters that aren't one of the six ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(id_col: str, text: str, seed: int = 0) -> Column:
    """The place of a document in its source's shuffled order: a uniform long."""
    return F.xxhash64(F.lit(seed), named(id_col), named(text))


def _measured(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(named(id_col).alias("id"), named(source).alias("source"), shuffle_key(id_col, text, seed).alias("h"), count_words(named(text)).alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(rank, source, source_size, target) from rows of (source, size): one row for each source.

    Sources by code point, null last, get the weights in turn.  ``share`` times
    all sizes is dealt by weight; no target exceeds ``most`` times its source,
    and the excess goes to the others by weight.  That water level has a closed
    form: with sources in the order of cap / weight, it is the largest of
    (budget - caps before k) / weights from k on.  The window over all sources
    holds one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    cap = most * F.col("source_size")
    by_ratio = whole.orderBy((F.col("cap") / F.col("weight")), "rank")
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", cap)
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.least(share * F.sum("source_size").over(whole), F.sum("cap").over(whole))
    level = F.max("level").over(whole)
    return per.withColumn("level", (budget - before) / after).withColumn("target", F.least("cap", level * F.col("weight"))).select("rank", "source", "source_size", "target")


def _cuts(measured: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(rank, copy, cut): the last shuffle key of a source that the mix takes for the first, second, ... time.

    A document's virtual finish time is the words of its source up to it over the
    source's target; later copies come a whole source later.  All sources' items
    are sorted by it in ranges of finish time, and the total budget cuts the
    order.  A source's items are taken in its shuffled order, so what is taken of
    it is a prefix and its last key tells all.
    """
    some = measured.filter("size > 0").join(targets, measured.source.eqNullSafe(targets.source)).filter("target > 0")
    some = save(some.select("rank", "source_size", "target", "h", "size", F.shiftright("h", 52).alias("bucket")), "queued")
    summed = running_total(some, ["rank"], "bucket", ["h"], "size", "words")
    finish = (F.col("words") + F.col("copy") * F.col("source_size")) / F.col("target")
    items = summed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", finish)
    # ranges of finish time, equal up to 1.5 and then ever longer: every source's words are spread evenly over its time
    at = F.when(F.col("finish") < 1.5, F.col("finish") * 2048).otherwise(3072 + 2048 * F.log2(F.col("finish") / 1.5))
    items = save(items.select("rank", "copy", "h", "size", "finish", F.floor(at).alias("range")), "items")
    placed = running_total(items, [], "range", ["finish", "rank", "h"], "size", "place")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    # what straddles the end is taken if more than half of it is within the budget
    return placed.filter(F.col("place") - F.col("size") / 2 <= budget).groupBy("rank", "copy").agg(F.max("h").alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(measured rows: id, source, h, size; plan: source, source_size, target, cut0, cut1, ...).

    A document belongs to the mix once for each cut that its shuffle key does not
    exceed.  Rows of a source with the same id and text share their key and are
    taken together.  Texts without words take nothing from the budget.  The plan
    has one row a source; joins with it are left to adaptive execution, which
    broadcasts it by its measured size.
    """
    measured = save(_measured(docs, id_col, text, source, seed), "measured")
    targets = save(source_targets(measured, weights, share, float(most)).coalesce(1), "targets")
    cuts = _cuts(measured, targets, most).groupBy("rank").agg(*[F.max(F.when(F.col("copy") == k, F.col("cut"))).alias(f"cut{k}") for k in range(most)])
    return measured, save(targets.join(cuts, "rank", "left").drop("rank").coalesce(1), "mix-plan")


def copies(key: Column, most: int = 2) -> Column:
    """How often the mix takes the document with this shuffle key."""
    return sum((F.coalesce(key <= F.col(f"cut{k}"), F.lit(False)).cast("int") for k in range(most)), F.lit(0))


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row: null texts have size 0, empty tables give empty results."""
    measured, plan = mix(docs, seed=seed)
    joined = measured.join(plan, measured.source.eqNullSafe(plan.source))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies(F.col("h"))).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, twice where it takes them twice; all columns as they were.

    Texts without words take nothing from the budget and go with their source's
    order; an empty table stays empty.
    """
    measured, plan = mix(docs, seed=seed, id_col=id_col, text=text, source=source)
    discard(measured)
    own, c0, c1, taken = spare(docs, "__source", "__cut0", "__cut1", "__taken")
    plan = plan.select(F.col("source").alias(own), F.col("cut0").alias(c0), F.col("cut1").alias(c1))
    key = shuffle_key(id_col, text, seed)
    n = sum((F.coalesce(key <= F.col(c), F.lit(False)).cast("int") for c in (c0, c1)), F.lit(0))
    joined = docs.join(plan, named(source).eqNullSafe(F.col(own))).withColumn(taken, n).filter(F.col(taken) > 0)
    return joined.withColumn(taken, F.explode(F.sequence(F.lit(1), F.col(taken)))).drop(own, c0, c1, taken)
