"""Near-duplicate vectors: PCA-ordered tiles, suffix-norm bounds, exact cosine at the end."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import named
from .components import connected_components
from .scratch import save
from .simhash import _forest

#: Vectors in a tile: what is compared with one matrix product.
TILE = 512
#: Numbers that a block is meant to hold (the vectors of a block are as many fewer as they are longer), and the leaves of the
#: tree at most, whose pairs are listed on the driver; a leaf with more vectors than a block has is cut into blocks by hash.
BLOCK, LEAVES = 1 << 20, 512
#: Vectors that lay out the blocks. Every vector is compared, whichever block it falls in.
SAMPLE = 20_000
#: Leading dimensions after which a pair may be given up.
STAGES = (8, 16, 32)


def _packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, raw): the vector as 8-byte doubles, equal just for equal vectors; null for null, empty, zero and non-finite ones."""

    def pack(x: pa.Scalar) -> bytes | None:
        if not x.is_valid or x.values.null_count or not len(x.values):
            return None
        v = x.values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            return None
        return (v if 1e-100 < top < 1e100 else v / top).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x) for x in b.column(1)], pa.binary())], names=["id", "raw"])

    return vectors.select(named(id_col).cast("long").alias("id"), named(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, raw binary")


def _moments(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each length d the d x d second moments of all unit vectors of that length, summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in _by_length(b.column(0)).items():
                u = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            k = np.arange(d * d, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int64)), pa.array(k), pa.array(m.ravel())], names=["d", "k", "s"])

    got: dict[int, np.ndarray] = {}
    for d, k, s in reps.select("raw").mapInArrow(run, "d long, k long, s double").groupBy("d", "k").agg(F.sum("s").alias("s")).collect():
        got.setdefault(d, np.zeros(d * d))[k] = s
    return {d: m.reshape(d, d) for d, m in got.items()}


def _by_length(column: pa.Array) -> dict[int, np.ndarray]:
    out: dict[int, list[bytes]] = {}
    for x in column:
        out.setdefault(len(x.as_buffer()) // 8, []).append(x.as_buffer().to_pybytes())
    return {d: np.frombuffer(b"".join(v)).reshape(-1, d) for d, v in out.items()}


def _layout(points: np.ndarray, blocks: int) -> list:
    """A k-d tree over leading coordinates: nested [axis, cut, below, above], leaves are block numbers."""
    leaf = iter(range(1 << 30))

    def cut(x: np.ndarray, n: int) -> list | int:
        if n <= 1 or len(x) < 2:
            return next(leaf)
        axis = int(np.argmax(x.max(0) - x.min(0)))
        at = float(np.quantile(x[:, axis], (n // 2) / n))
        below = x[:, axis] < at
        if below.all() or not below.any():
            return next(leaf)
        return [axis, at, cut(x[below], n // 2), cut(x[~below], n - n // 2)]

    return cut(points, blocks)


def _leaf(tree: list | int, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        t, rows = todo.pop()
        if isinstance(t, int):
            out[rows] = t
        else:
            below = x[rows, t[0]] < t[1]
            todo += [(t[2], rows[below]), (t[3], rows[~below])]
    return out


def block_of(d: int) -> int:
    """Vectors of length d in a block."""
    return max(TILE, BLOCK // d)


def close_pairs(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold. a, b: unit vectors in PCA order; raw: as given, for the final value.

    Leading dimensions are multiplied first; what the others can add is at most
    the product of the suffix norms, and pairs that cannot reach the threshold
    any more are dropped with their rows and columns.
    """
    i, j = np.arange(len(a)), np.arange(len(b))
    done, score = 0, np.zeros((len(a), len(b)))
    d = a.shape[1]
    for stop in [s for s in STAGES if s < d]:
        score = score + a[i, done:stop] @ b[j, done:stop].T
        rest_a, rest_b = (np.sqrt(np.maximum((x[k, stop:] ** 2).sum(1), 0)) for x, k in ((a, i), (b, j)))
        alive = score + np.outer(rest_a, rest_b) >= threshold - 1e-9
        rows, cols = alive.any(1), alive.any(0)
        i, j, score, done = i[rows], j[cols], score[np.ix_(rows, cols)], stop
        if not i.size:
            return i, j
    x, y = np.nonzero(score + a[i, done:] @ b[j, done:].T >= threshold - 1e-9)
    x, y = i[x], j[y]
    keep = np.zeros(x.size, bool)
    for k in range(0, x.size, 1 << 16):
        p, q = raw_a[x[k : k + (1 << 16)]], raw_b[y[k : k + (1 << 16)]]
        keep[k : k + (1 << 16)] = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= threshold
    return x[keep], y[keep]


def vector_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    Exactly equal vectors become one with a weight first.  The rest are rotated
    to the principal axes of all vectors and dealt to leaves of a k-d tree over
    the leading axes and blocks of bounded size within them; only pairs of blocks
    whose leaves' boxes come within sqrt(2 - 2 * threshold) are compared, each in
    a task of its own, tile by tile.  A task returns link counts and spanning
    links, never pairs.  Where the leading axes tell nothing apart (vectors spread
    evenly over many dimensions) all blocks meet: what a vector costs then grows
    with the number of blocks, as exact comparison must.

    Null, empty, zero and non-finite vectors link with nothing (n_links 0, their
    own id as component); vectors of different lengths don't link; repeated rows
    link with each other; an empty table gives an empty result.
    """
    rows = save(_packed(vectors, id_col, vec_col), "vectors")
    reps = rows.filter("raw is not null").groupBy("raw").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    reps = save(reps.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    n = reps.count()
    spin, trees, boxes_of = {}, {}, {}
    for d, m in _moments(reps).items():
        spin[d] = np.linalg.eigh(m)[1][:, ::-1].copy()
    part = min(1.0, 2 * SAMPLE / max(n, 1))
    some = _by_length(pa.array([bytes(r[0]) for r in reps.select("raw").sample(part, seed=7).limit(SAMPLE).collect()], pa.binary())) if n else {}
    for d in spin:
        x = some.get(d, np.zeros((0, d)))
        lead = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ spin[d][:, :8]
        trees[d] = _layout(lead, min(max(1, ceil(n / block_of(d))), LEAVES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.array([len(x.as_buffer()) // 8 for x in b.column(0)], np.int64)
            leaf, lead = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 8))
            for d, x in _by_length(b.column(0)).items():
                u = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ spin[d][:, :8]
                at = length == d
                lead[at, : u.shape[1]], leaf[at] = u, _leaf(trees[d], u)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(length), pa.array(leaf), pa.array(list(lead), pa.list_(pa.float64()))], names=["raw", "rep", "weight", "d", "leaf", "lead"])

    dealt = save(reps.select("raw", "rep", "weight").mapInArrow(deal, "raw binary, rep long, weight long, d long, leaf long, lead array<double>"), "dealt")
    box = [f(F.col("lead")[k]).alias(f"{g}{k}") for k in range(8) for f, g in ((F.min, "lo"), (F.max, "hi"))]
    boxes = dealt.groupBy("d", "leaf").agg(F.count("*").alias("n"), *box).orderBy("d", "leaf").collect()
    reach = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    near: list[tuple[int, int, int, int, bool, int, int]] = []
    for d in spin:
        own = [r for r in boxes if r.d == d]
        lo, hi = (np.array([[r[f"{g}{k}"] for k in range(8)] for r in own]) for g in ("lo", "hi"))
        parts = [ceil(r.n / block_of(d)) for r in own]
        for k, r in enumerate(own):
            gap = np.maximum(0, np.maximum(lo[k:] - hi[k], lo[k] - hi[k:]))
            for o in np.nonzero((gap**2).sum(1) <= reach**2)[0].tolist():
                pair = len(near)
                near.append((d, r.leaf, pair, 0, o == 0, parts[k], parts[k + o]))
                if o:
                    near.append((d, own[k + o].leaf, pair, 1, False, parts[k + o], parts[k]))
    pairs = dealt.sparkSession.createDataFrame(near, "d long, leaf long, pair long, side int, same boolean, mine int, others int")
    met = dealt.drop("lead").join(pairs, ["d", "leaf"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("mine")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    first = F.when(F.col("same"), F.least("own", "other")).otherwise(F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")))
    second = F.when(F.col("same"), F.greatest("own", "other")).otherwise(F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    side = F.when(F.col("same"), (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    met = met.select("raw", "rep", "weight", "d", "pair", first.alias("a"), second.alias("b"), side.alias("side"), (F.col("same") & (F.col("own") == F.col("other"))).alias("self"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        if not pdf["self"].iloc[0] and pdf["side"].nunique() == 1:  # the other block is empty
            return pd.DataFrame({"rep": [], "links": [], "dst": []}).astype({"rep": "int64", "links": "int64", "dst": "Int64"})
        sides = []
        for _, side in pdf.groupby("side", sort=True):
            raw = np.frombuffer(b"".join(side["raw"])).reshape(-1, d)
            u = (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ spin[d]
            order = np.argsort(u[:, 0], kind="stable")
            sides.append((raw[order], u[order], side["rep"].to_numpy(np.int64)[order], side["weight"].to_numpy(np.int64)[order]))
        (ra, a, ia, wa), (rb, b, ib, wb) = sides[0], sides[-1]
        ca, cb, forest = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
        for s in range(0, len(a), TILE):
            for t in range(s if len(sides) == 1 else 0, len(b), TILE):
                p, q = slice(s, s + TILE), slice(t, t + TILE)
                if max(a[p][0, 0] - b[q][-1, 0], b[q][0, 0] - a[p][-1, 0]) > reach:
                    continue
                x, y = close_pairs(a[p], b[q], ra[p], rb[q], threshold)
                if len(sides) == 1 and s == t:
                    x, y = x[x < y], y[x < y]
                if x.size:
                    np.add.at(ca, x + s, wb[y + t])
                    np.add.at(cb if len(sides) > 1 else ca, y + t, wa[x + s])
                    close = np.zeros((min(TILE, len(a) - s), min(TILE, len(b) - t)), bool)
                    close[x, y] = True
                    forest += _forest(ia[p], ib[q], close)
        out = [pd.DataFrame({"rep": i[c > 0], "links": c[c > 0], "dst": pd.NA}) for i, c in ([(ia, ca)] if len(sides) == 1 else [(ia, ca), (ib, cb)])]
        out.append(pd.DataFrame({"rep": [f[0] for f in forest], "links": 0, "dst": [f[1] for f in forest]}))
        return pd.concat(out).astype({"rep": "int64", "links": "int64", "dst": "Int64"})

    found = save(met.groupBy("pair", "a", "b").applyInPandas(compare, "rep long, links long, dst long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.filter("dst is not null").select(F.col("rep").alias("src"), "dst"))
    of = reps.join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = save(of.select("raw", "least", F.coalesce("component", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("l")), "of-vectors")
    named = save(of.groupBy("c").agg(F.min("least").alias("m")), "named")
    of = save(of.join(named, "c").select("raw", "l", "m"), "of-vectors")
    out = rows.filter("raw is not null").join(of, "raw").select("id", "l", "m").union(rows.filter("raw is null").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("l").alias("n_links"), F.col("m").alias("component_id"), F.coalesce(F.col("id") == F.col("m"), F.lit(False)).alias("kept"))
