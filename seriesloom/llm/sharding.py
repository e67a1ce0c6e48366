"""Best-fit-decreasing bin packing of indivisible groups into shards of near equal size."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import named
from .scratch import running_total, save

#: Leading bits of a group's size that packing looks at.
BITS = 16


@dataclass(slots=True)
class _Node:
    key: tuple[int, int]
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


class CapacityTree:
    """AVL tree of (remaining capacity, bin): the tightest bin that still takes a size, in logarithmic time."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, room: int, bin_: int) -> None:
        self.root = self._add(self.root, (room, bin_))

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least ``size``; None if there is none."""
        at, best = self.root, None
        while at:
            if at.key[0] >= size:
                best, at = at.key, at.left
            else:
                at = at.right
        if best is not None:
            self.root = self._remove(self.root, best)
        return best

    def _add(self, t: _Node | None, key: tuple[int, int]) -> _Node:
        if t is None:
            return _Node(key)
        if key < t.key:
            t.left = self._add(t.left, key)
        else:
            t.right = self._add(t.right, key)
        return self._balance(t)

    def _remove(self, t: _Node | None, key: tuple[int, int]) -> _Node | None:
        if t is None:
            return None
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is None or t.right is None:
            return t.left or t.right
        else:
            low = t.right
            while low.left:
                low = low.left
            t.key = low.key
            t.right = self._remove(t.right, low.key)
        return self._balance(t)

    @staticmethod
    def _tall(t: _Node | None) -> int:
        return t.height if t else 0

    def _fix(self, t: _Node) -> _Node:
        t.height = 1 + max(self._tall(t.left), self._tall(t.right))
        return t

    def _turn(self, t: _Node, to_right: bool) -> _Node:
        if to_right:
            up = t.left
            t.left, up.right = up.right, t
        else:
            up = t.right
            t.right, up.left = up.left, t
        self._fix(t)
        return self._fix(up)

    def _balance(self, t: _Node) -> _Node:
        self._fix(t)
        lean = self._tall(t.left) - self._tall(t.right)
        if lean > 1:
            if self._tall(t.left.left) < self._tall(t.left.right):
                t.left = self._turn(t.left, False)
            return self._turn(t, True)
        if lean < -1:
            if self._tall(t.right.right) < self._tall(t.right.left):
                t.right = self._turn(t.right, True)
            return self._turn(t, False)
        return t


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, most_bins: int | None = None, first: int = 0) -> list[tuple[int, int, int, int]] | None:
    """Place (size, count) classes, largest size first, each group into the tightest bin that takes it.

    Returns runs (size, first rank, end rank, bin) over the ranks of the groups of
    a size.  A bin that took a group is the tightest again for the next of that
    size, so as many as fit go at once.  A new bin opens when none fits; None if
    that would exceed ``most_bins``.  Groups above the capacity get bins of their
    own.  Bins count from ``first``.
    """
    tree, runs, opened = CapacityTree(), [], 0
    for size, count in sorted(sizes, reverse=True):
        done = 0
        while done < count:
            got = tree.take(size)
            if got is None:
                if most_bins is not None and opened >= most_bins:
                    return None
                got, opened = (max(capacity, size), first + opened), opened + 1
            room, b = got
            n = min(count - done, room // size) if size else count - done
            runs.append((size, done, done + n, b))
            tree.add(room - n * size, b)
            done += n
    return runs


def pack_evenly(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs that fill exactly up to ``bins`` bins as evenly as best fit can.

    A group that alone exceeds an even share of what is left gets a bin of its
    own; the rest is packed under the smallest capacity, found by doubling steps
    up from the even share, at which best fit needs no more bins than are left.
    """
    left = {s: n for s, n in sizes if n}
    total, runs, used, own = sum(s * n for s, n in left.items()), [], 0, {}
    while left and used < bins - 1 and (top := max(left)) * (bins - used) > total:
        runs.append((top, own.get(top, 0), own.get(top, 0) + 1, used))
        own[top] = own.get(top, 0) + 1
        total, used, left[top] = total - top, used + 1, left[top] - 1
        if not left[top]:
            del left[top]
    if left:
        even = max(-(-total // (bins - used)), max(left))
        low, step = even, 0
        while (got := best_fit_decreasing(left.items(), even + step, bins - used, used)) is None:
            low, step = even + step + 1, 2 * step + 1
        high = even + step
        while low < high and high - low > max(1, even // 1_000_000):
            mid = (low + high) // 2
            if (closer := best_fit_decreasing(left.items(), mid, bins - used, used)) is None:
                low = mid + 1
            else:
                high, got = mid, closer
        runs += [(s, a + own.get(s, 0), b + own.get(s, 0), k) for s, a, b, k in got]
    return runs


def size_class(size: Column) -> Column:
    """The size rounded up to BITS leading bits: at most one part in 32,768 more, and as it is up to 65,536."""
    more = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    below = F.call_function("shiftleft", F.lit(1).cast("long"), more) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", size + below, more), more)


def shard_documents(docs: DataFrame, shards: int = 40, capacity: int | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text (null: none) plus 16; rows with equal
    texts (null and empty count as equal) are a group that isn't divided.  With
    ``capacity`` the shards have that fixed capacity and are as few as best fit
    needs; without it there are ``shards`` of near equal sizes.  Slots count the
    rows of a shard from 0 without gaps.  What reaches the driver is the number
    of groups of each size, rounded up to 16 leading bits (:func:`size_class`), so
    no capacity is exceeded: at most 32,768 rows for each doubling of size above
    65,536 bytes, whatever the corpus, and few where the sizes are large.  Groups are numbered within their size, and rows within their shard,
    by running totals over hash buckets, so no size, group or shard meets in one
    task.  Ties and repeated rows get slots in any order; an empty table gives
    an empty result.
    """
    t = F.coalesce(named(text), F.lit(""))
    base = docs.select(named(id_col).cast("long").alias("id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("hash"))
    base = save(base, "sizes")
    key = ["hash", "crc", "size"]
    groups = base.groupBy(*key).agg(F.count("*").alias("n"))
    groups = save(groups.select(*key, size_class(F.col("size") * F.col("n")).alias("bytes"), F.shiftright("hash", 52).alias("bucket"), F.lit(1).alias("one")), "groups")
    sizes = [(s, n) for s, n in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]
    runs = pack_evenly(sizes, shards) if capacity is None else best_fit_decreasing(sizes, capacity)
    whole = {s: n for s, n in sizes}
    single = [(s, k) for s, a, b, k in runs if b - a == whole[s]]
    split = [(s, a, b, k) for s, a, b, k in runs if b - a != whole[s]]
    spark = docs.sparkSession
    of_size = save(spark.createDataFrame(single, "bytes long, shard int").coalesce(1), "shard-of-size")
    parts = groups.join(of_size, "bytes").select(*key, "shard")
    if split:
        of_rank = save(spark.createDataFrame(split, "bytes long, lo long, hi long, shard int").coalesce(1), "shard-of-rank")
        spread = save(groups.join(save(of_rank.select("bytes").distinct(), "split-sizes"), "bytes", "left_semi"), "split-groups")
        ranked = running_total(spread, ["bytes"], "bucket", ["hash", "crc"], "one", "rank")
        parts = parts.union(ranked.join(of_rank, (ranked["bytes"] == of_rank["bytes"]) & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi"))).select(*key, "shard"))
    placed = base.join(save(parts, "shard-of-group"), key).withColumn("mix", F.xxhash64("id", "crc"))
    placed = save(placed.select("id", "size", "crc", "shard", "mix", F.shiftright("mix", 52).alias("bucket")), "placed")
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("mix", "id", "crc"))
    out = placed.withColumn("nth", nth).join(counts, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))
