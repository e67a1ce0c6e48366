"""One document of each group of near copies: SimHash classes and min-hash bands find, shingle sets decide.

The SimHash operator (:mod:`.simhash`, generalised pigeonhole) gives the classes
of fingerprints within two bits.  At a similarity of 0.8 two 64-bit fingerprints
differ in about 10 bits, out of reach of any pigeonhole that still tells texts
apart, so bands of min-hashes find the candidates beyond.  Both are buckets; every
link is verified by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import array, extended, named, raw, spare
from .components import connected_components
from .scratch import discard, save, sieved
from .simhash import _least_reached, fingerprint, near_duplicates, shingle_hashes, signed

#: What is apart in buckets with more members than this meets in blocks, not pair by pair.
HOT = 64
#: Texts and shingles that a block is meant to hold at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 1 << 20


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles, A-Z lower-cased; a text of fewer words is one shingle, no words give none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 step of each state."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> list[int]:
    """A signed long for each band of ``rows`` min-hashes of a shingle set; none for the empty set."""
    if not len(shingles):
        return []
    k = np.arange(1, 2 * bands * rows + 1).astype(np.uint64)
    mask, factor = _mixed(k[: bands * rows]), _mixed(k[bands * rows :]) | np.uint64(1)
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for b in range(0, len(shingles), 256):
        least = np.minimum(least, ((shingles[b : b + 256, None] ^ mask) * factor).min(0))
    return [signed(xxhash.xxh64_intdigest(least[x * rows : (x + 1) * rows].tobytes(), x)) for x in range(bands)]


def _profiled(docs: DataFrame, text: str, words: int, bands: int, rows: int, names: list[str]) -> DataFrame:
    """Add a 128-bit digest of the shingle set, the number of its shingles, the SimHash fingerprint and the bands."""

    def task() -> Callable[[pa.Array], list[pa.Array]]:
        def make(texts: pa.Array) -> list[pa.Array]:
            got: list[tuple] = []
            for x in texts:
                blocks = list(shingle_hashes(raw(x), words))
                s = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
                got.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), signed(fingerprint(blocks)), band_hashes(s, bands, rows)))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return [array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]

        return make

    kinds = (T.BinaryType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()))
    return extended(docs, text, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], task)


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, s): the shingle sets of (node, text)."""

    def task() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda column: [array([shingle_set(raw(x), words).view(np.int64) for x in column], pa.list_(pa.int64()))]

    return extended(texts, "t", [T.StructField("s", T.ArrayType(T.LongType()))], task, ("t",))


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have at least that Jaccard similarity, counted over all members, 4,096 shingles at a time."""
    n = np.array([len(x) for x in sets], np.float64)
    common = np.zeros((len(sets), len(sets)))
    owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = count[of] > 1  # a shingle of one set alone is in no intersection
    owner, (_, of) = owner[met], np.unique(of[met], return_inverse=True)
    order = np.argsort(of, kind="stable")
    owner, of = owner[order], of[order]
    for c in range(0, int(of[-1]) + 1 if len(of) else 0, 4096):
        x, y = np.searchsorted(of, [c, c + 4096])
        hit = np.zeros((len(sets), 4096), np.float32)
        hit[owner[x:y], of[x:y] - c] = 1
        common += hit @ hit.T
    np.fill_diagonal(common, n)
    return common >= similarity * (n[:, None] + n[None, :] - common)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node_a, node_b) whose shingle sets are similar enough, as (src, dst)."""
    left, right = (sets.select(F.col("node").alias(f"node_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(left, "node_a").join(right, "node_b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    union = F.size("s_a") + F.size("s_b") - F.col("common")
    return both.filter(F.col("common") >= F.lit(similarity) * union).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"))


def _may(similarity: float) -> Column:
    return F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")


def _led(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links of the members (h, node, n) of buckets with the smallest node of their bucket: one comparison a member."""
    lead = met.groupBy("h").agg(F.min(F.struct("node", "n")).alias("l")).select("h", F.col("l.node").alias("node_a"), F.col("l.n").alias("n_a"))
    lead = save(lead, "leaders")  # apart from the join, whose partition with a hot bucket can then be split
    pairs = met.select("h", F.col("node").alias("node_b"), F.col("n").alias("n_b")).join(lead, "h").filter(F.col("node_a") != F.col("node_b")).filter(_may(similarity))
    return _verified(save(pairs.select("node_a", "node_b").distinct(), "led-pairs"), sets, similarity)


def _left_over(hot: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links in large buckets between members (h, node, n, c) of different components c.

    Each bucket's largest component is its main one.  The members outside it are
    cut into blocks, the whole bucket into blocks too, and each pair of such
    blocks is compared in a task of its own, so the work is members outside times
    members, and none where the leader's component is the whole bucket.
    """
    import pandas as pd

    sizes = hot.groupBy("h", "c").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    of = sizes.groupBy("h").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"), F.sum("w").alias("w"))
    of = of.filter(F.col("top.k") < F.col("k")).select("h", F.col("top.c").alias("main"), "k", "w", (F.col("k") - F.col("top.k")).alias("out"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK_TEXTS, F.col("w") / BLOCK_SHINGLES))
    of = save(of.withColumn("nb", blocks.cast("int")).withColumn("no", F.ceil(blocks * F.col("out") / F.col("k")).cast("int")), "hot-buckets")
    some = hot.join(of, "h").withColumn("x", F.xxhash64("node"))
    outer = some.filter("c <> main").select("h", "node", "c", F.pmod("x", "no").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(True).alias("outside"))
    every = some.select("h", "node", "c", F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("i"), F.pmod("x", "nb").alias("j"), F.lit(False).alias("outside"))
    rows = outer.select("h", "node", "c", F.col("i").cast("int").alias("i"), "j", "outside").union(every.select("h", "node", "c", "i", F.col("j").cast("int"), "outside")).join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        node, c = pdf["node"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        least = _least_reached(node, similar(list(pdf["s"]), similarity) | (c[:, None] == c[None, :]))
        out = node != least
        return pd.DataFrame({"src": least[out], "dst": node[out]})

    return rows.groupBy("h", "i", "j").applyInPandas(run, "src long, dst long")


def jaccard_links(buckets: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (src, dst) between nodes that share a bucket, each verified by the exact Jaccard similarity of the shingle sets.

    buckets: (h, node, n shingles), texts: (node, text), both from saved tables.
    Each member first meets the smallest node of its bucket, so a group of copies
    costs one comparison a member.  Only members that are still apart meet
    further: pair by pair in buckets of up to HOT members, in blocks beyond.
    """
    size = save(buckets.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    met = save(buckets.join(size, "h"), "members")
    some = save(met.select("node").distinct(), "some")
    wanted = sieved(texts, "node", some, "may").filter("may").select("node", "t")
    sets = save(_shingle_sets(wanted.join(some, "node", "left_semi"), words), "shingles")
    led = save(_led(met, sets, similarity), "led")
    comp = connected_components(led).select("node", "component")
    known = save(met.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "known")
    cool = known.filter(F.col("size") <= HOT)
    a, b = (cool.select("h", *[F.col(k).alias(f"{k}_{x}") for k in ("node", "c", "n")]) for x in "ab")
    pairs = a.join(b, "h").filter((F.col("node_a") < F.col("node_b")) & (F.col("c_a") != F.col("c_b")) & _may(similarity))
    pairs = save(pairs.select("node_a", "node_b").distinct(), "pairs")
    links = led.union(_verified(pairs, sets, similarity))
    hot = known.filter(F.col("size") > HOT)
    if not hot.isEmpty():
        links = links.union(_left_over(hot, sets, similarity))
    out = save(links, "links")
    discard(size, met, some, sets, led, known)
    return out


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8, radius: int = 2, bands: int = 24, rows: int = 5) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Two texts are linked if the Jaccard similarity of their sets of word shingles, over the whole texts, is at
    least ``similarity``.  Candidates are the SimHash classes (fingerprints within ``radius`` bits) and ``bands``
    groups of ``rows`` min-hashes.  A pair of similarity s shares no band with the chance (1 - s^rows)^bands:
    0.00007 at 0.8.  Equal sets are one node, so copies cost nothing.  Null and empty texts
    are equal to each other; null ids come after all others; of repeated rows one
    stays; all columns are kept as they are; an empty table stays empty.
    """
    row, digest, n, fp, found = names = spare(docs, "__row", "__set", "__n", "__fp", "__bands")
    wide = save(_profiled(docs.withColumn(row, F.monotonically_increasing_id()), text, words, bands, rows, names[1:]), "wide")
    first = F.min(F.struct(named(id_col).isNull().alias("n"), named(id_col).alias("i"), F.col(row).alias("r")))
    nodes = wide.groupBy(digest).agg(first.alias("first"), *[F.first(c).alias(c) for c in (n, fp, found)])
    nodes = save(nodes.select("first", F.col("first.r").alias("node"), F.col(n).alias("n"), F.col(fp).alias("fp"), F.col(found).alias("bands")), "nodes")
    classes = near_duplicates(nodes, radius, "node")
    of_class = nodes.join(classes, "fp").select(F.xxhash64(F.lit("class"), "component").alias("h"), "node", "n")
    buckets = of_class.union(nodes.select(F.explode("bands").alias("h"), "node", "n"))
    links = jaccard_links(buckets, wide.select(F.col(row).alias("node"), named(text).alias("t")), similarity, words)
    comp = connected_components(links).withColumnRenamed("node", "was")
    joined = nodes.select("node", "first").join(comp, F.col("node") == F.col("was"), "left").withColumn("c", F.coalesce("component", "node"))
    stay = joined.groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.r").alias(row))
    gone = save(wide.select(row).join(stay, row, "left_anti"), "gone")
    discard(nodes, links)
    may = spare(docs, *names, "__may")[-1]
    sifted = sieved(wide.drop(digest, n, fp, found), row, gone, may)
    kept = sifted.filter(~F.col(may)).union(sifted.filter(may).join(gone, row, "left_anti").select(*[named(c) for c in sifted.columns]))
    return kept.select(*[named(c) for c in docs.columns])
