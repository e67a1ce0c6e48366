"""SimHash near-duplicates by the generalised pigeonhole principle.

A pair within ``radius`` bits must, for any split of the 64 bits into m parts
and any part thresholds T_i >= -1 that add up to radius - m + 1, lie within T_i
bits in some part i.  Correlated bits are put into the same part (what is left
then tells more), the thresholds come from a dynamic program over estimated
candidate counts, and the parts are probed and verified natively.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import array, extended, named, raw
from .components import connected_components
from .scratch import save

#: Shingles hashed at a time: bounds a very long text's memory.
BLOCK = 1 << 16
#: A bucket with more members than this isn't joined with itself but takes the linear or blocked way.
HOT = 64


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash: the splitmix64 step of the k-th state after it; k = 0 leaves it as it is."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | bytes | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 hashes of the word shingles of a text with A-Z lower-cased, repeats included, BLOCK at a time.

    A text of fewer words is one shingle; null and texts without words give none.
    """
    w = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not w:
        return
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    del w
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(lengths) - words + 1], ends[words - 1 :]
    for b in range(0, len(starts), BLOCK):
        yield np.array([digest(joined[x:y], 42) for x, y in zip(starts[b : b + BLOCK].tolist(), ends[b : b + BLOCK].tolist(), strict=True)], np.uint64)


def fingerprint(blocks: Iterable[np.ndarray]) -> int:
    """The unsigned 64-bit fingerprint of hashes: a bit is 1 if it is set in over half of them; no hashes give 0."""
    total, counts = 0, np.zeros(64, np.int64)
    for h in blocks:
        total += len(h)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def simhash(text: str | bytes | None, words: int = 3) -> int:
    """The fingerprint of the word shingles of a text; 0 for no words or null."""
    return fingerprint(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, out: str = "fp", keep_text: bool = True) -> DataFrame:
    """Add the fingerprint as a signed long; all other columns pass through untouched."""

    def task() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: [array([signed(simhash(raw(x), words)) for x in texts], pa.int64())]

    return extended(docs, text, [T.StructField(out, T.LongType())], task, () if keep_text else (text,))


@dataclass(frozen=True)
class Plan:
    """Bit masks of the parts and how many differing bits each part may have; -1: the part isn't probed."""

    masks: tuple[int, ...]
    radii: tuple[int, ...]
    cost: float = 0.0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in equal parts, each grown greedily by the strongest mean correlation. together[i, j]: how often both bits are set."""
    p = np.diag(together) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            b = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(b)
            left.remove(b)
        out.append(sorted(part))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The radii, one for each part, that add up to ``total`` at the least cost. costs[i][e]: cost of radius e in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for e, x in part.items():
                if s + e not in nxt or c + x < nxt[s + e][0]:
                    nxt[s + e] = (c + x, [*chosen, e])
        best = nxt
    return best[total]


def _bits_together(fps: DataFrame) -> tuple[np.ndarray, int]:
    """Over all fingerprints, how often each pair of bits is set; 64 x 64 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            bits = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).astype(">i8").view(np.uint8)).reshape(-1, 64).astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        flat = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([array(range(flat.size), pa.int32()), array(flat, pa.int64())], names=["k", "c"])

    got = fps.select("fp").mapInArrow(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(64 * 64 + 1)
    for k, c in got:
        flat[k] = c
    return flat[:-1].reshape(64, 64), int(flat[-1])


def make_plan(fps: DataFrame, radius: int) -> Plan:
    """Choose the parts and their radii from statistics over all of ``fps`` (distinct fingerprints)."""
    together, n = _bits_together(fps)
    p = np.diag(together) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1)
    splits = {m: group_bits(together, n, m) for m in range(2, min(radius, 4) + 2)}
    masks = {(m, i): sum(1 << (63 - b) for b in part) for m, parts in splits.items() for i, part in enumerate(parts)}
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(m * 64 + i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("v")) for (m, i), x in masks.items()])).alias("x")).select("x.*")
    squares = {k: s for k, s in rows.groupBy("k", "v").count().groupBy("k").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect()}
    best = None
    for m, parts in splits.items():
        costs = []
        for i, part in enumerate(parts):
            odds, ball = [(1 - agree[b]) / agree[b] for b in part], [1.0]
            for o in odds:  # elementary symmetric sums: disagreements in k bits against none
                ball = [(ball[k] if k < len(ball) else 0) + (ball[k - 1] * o if k else 0) for k in range(min(len(ball) + 1, radius + 1))]
            cost, pairs, probes = {-1: 0.0}, squares.get(m * 64 + i, 0.0), 0
            for e in range(min(radius, len(part)) + 1):
                probes += comb(len(part), e)
                if probes > 700:
                    break
                cost[e] = min(pairs * sum(ball[: e + 1]), float(n) * n) + 20.0 * n * (probes + 1)
            costs.append(cost)
        try:
            c, radii = allocate(costs, radius - m + 1)
        except KeyError:
            continue
        if best is None or c < best.cost:
            best = Plan(tuple(masks[m, i] for i in range(m)), tuple(radii), c)
    return best


def _place(part: int, mask: int) -> Callable[[Column], Column]:
    return lambda flip: F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseXOR(flip).bitwiseAND(F.lit(signed(mask))).alias("v"))


def _entries(fps: DataFrame, plan: Plan, probe: bool) -> DataFrame:
    """(part, v, columns of ``fps``): where a fingerprint is stored, or with ``probe`` all the places where it looks."""
    parts = []
    for i, (mask, r) in enumerate(zip(plan.masks, plan.radii, strict=True)):
        if r < 0:
            continue
        bits = [1 << b for b in range(64) if mask >> b & 1]
        flips = [sum(c) for e in range((r if probe else 0) + 1) for c in combinations(bits, e)]
        flipped = F.array(*[F.lit(signed(x)) for x in flips])
        parts.append(F.transform(flipped, _place(i, mask)))
    return fps.select("*", F.explode(F.concat(*parts)).alias("at")).select("at.part", "at.v", *fps.columns)


def star_links(fps: DataFrame) -> DataFrame:
    """All links of 2 bits or fewer among ``fps``, as stars and without pairs: two fingerprints are that close just if
    some value is within one bit of both, and at most 65 fingerprints are within one bit of a value."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)])
    met = fps.select("fp", F.explode(near).alias("s")).groupBy("s").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return met.select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).filter("src <> dst").distinct()


def _forest(a: np.ndarray, b: np.ndarray, close: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the bipartite graph ``close`` between a and b."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(close), strict=True):
        x, y = find(int(a[i])), find(int(b[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a[i]), int(b[j])))
    return out


def blocked_links(hot: DataFrame, radius: int, block: int = 128) -> DataFrame:
    """Links among the members of each hot bucket (part, v), as stars: a bucket is cut into blocks by hash, each pair of
    blocks is compared in a task of its own, and what leaves it is each member's link to the smallest of its component there."""
    import pandas as pd

    size = hot.groupBy("part", "v").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    rows = hot.join(save(size, "hot-sizes"), ["part", "v"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    rows = rows.select("part", "v", "node", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    rows = rows.select("part", "v", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "node", "fp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "fp"])
        node, fp = pdf["node"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
        least = _least_reached(node, np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
        out = node != least
        return pd.DataFrame({"src": least[out], "dst": node[out]})

    return rows.groupBy("part", "v", "i", "j").applyInPandas(run, "src long, dst long")


def _least_reached(node: np.ndarray, close: np.ndarray) -> np.ndarray:
    """For each node the smallest one that it reaches over the symmetric relation ``close``."""
    least = node.copy()
    while True:
        nxt = np.where(close, least[None, :], np.iinfo(np.int64).max).min(1)
        if (nxt == least).all():
            return least
        least = nxt


def link_fingerprints(fps: DataFrame, radius: int = 2, plan: Plan | None = None) -> DataFrame:
    """Links (src, dst) whose connected components are those of "at most ``radius`` bits of fp differ".

    ``fps`` has ``node`` (longs) and ``fp`` (signed longs) in a saved table; rows
    of one node count as linked already.  Buckets of up to HOT members
    are joined with their probes and verified.  Larger ones lose nothing: at
    radius 2 their members meet at shared one-bit neighbours (:func:`star_links`,
    where node is fp), else in pairs of blocks (:func:`blocked_links`).
    """
    plan = plan or make_plan(fps, radius)
    index, probe = _entries(fps, plan, False), _entries(fps, plan, True)
    hot = save(probe.groupBy("part", "v").count().filter(F.col("count") > HOT * (1 if max(plan.radii) < 1 else 4)).select("part", "v"), "hot-keys")
    cool_i, cool_p, links = index, probe, None
    if not hot.isEmpty():
        cool_i = save(index.join(hot, ["part", "v"], "left_anti"), "index")
        cool_p = cool_i if max(plan.radii) < 1 else save(probe.join(hot, ["part", "v"], "left_anti"), "probes")
        if radius == 2:
            links = star_links(probe.join(hot, ["part", "v"], "left_semi").select("fp").distinct())
        else:
            links = blocked_links(save(probe.join(hot, ["part", "v"], "left_semi"), "hot"), radius)
    a, b = (x.select("part", "v", F.col("node").alias(f"node_{n}"), F.col("fp").alias(f"fp_{n}")) for x, n in ((cool_i, "a"), (cool_p, "b")))
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius
    pairs = a.join(b, (a.part == b.part) & (a.v == b.v) & (F.col("node_a") < F.col("node_b")) & near).select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"))
    return (pairs if links is None else pairs.union(links)).distinct()


def near_duplicates(prints: DataFrame, radius: int = 2, id_col: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(fp, component, component_id): for every fingerprint of ``prints`` (a saved table) its component, named by its
    smallest fingerprint, and the smallest id reachable over links.

    Rows with equal fingerprints are linked.  A null id counts as the largest;
    a component of null ids alone has a null component_id.  An empty table gives
    an empty result.
    """
    fps = save(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("rep")), "fingerprints")
    links = link_fingerprints(fps.select(F.col("fp").alias("node"), "fp"), radius)
    comp = connected_components(links)
    of = save(comp.join(fps, comp.node == fps.fp).select("fp", "component", "rep"), "linked")
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = of.join(save(least, "least"), "component").select("fp", "component", "component_id")
    alone = fps.join(of.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("rep").alias("component_id"))
    return save(alone.union(linked), "components")


def simhash_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id.

    Null and empty texts have fingerprint zero, which links like any other;
    repeated rows give repeated rows; other columns are not read.
    """
    prints = save(with_fingerprint(docs.select(named(id_col).alias("id"), named(text).alias("t")), "t", words, keep_text=False), "prints")
    comp = near_duplicates(prints, radius, "id")
    return prints.join(comp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
