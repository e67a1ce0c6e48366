"""Byte-level BPE: chunks are pre-tokenised apart and stitched where boundaries agree; pieces are encoded; ids decode to bytes."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import array, extended, named, raw, slices, spare
from .scratch import discard, save

#: Code points of a chunk, and how far a chunk reads into the next one.
CHUNK, OVERLAP = 16_384, 1_024
#: Pieces kept with their ids in a worker, and the longest piece kept.
CACHED, LONG = 100_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file, read by the driver; some megabytes whatever the corpus."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank, leftmost first, is merged until none is left; n log n."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: merged into an earlier one
    prev = list(range(-1, n - 1))

    def rank(a: int) -> int | None:
        b = end[a]
        return ranks.get(piece[a : end[b]]) if b < n else None

    heap = [(r, a, a + 1, a + 2) for a in range(n - 1) if (r := ranks.get(piece[a : a + 2])) is not None]
    heapify(heap)
    while heap:
        _, a, b, c = heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            prev[c] = a
            if (r := rank(a)) is not None:
                heappush(heap, (r, a, c, end[c]))
        if (p := prev[a]) >= 0 and (r := rank(p)) is not None:
            heappush(heap, (r, p, a, end[a]))
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : end[a]]])
        a = end[a]
    return out


class Codec:
    """Encodes pieces to little-endian 32-bit ids and back; one in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def piece(self, s: str) -> bytes:
        if len(s) > LONG:  # the library's merging is quadratic
            return np.array(merge(s.encode(), self.ranks), "<u4").tobytes()
        ids = self.short.encode_ordinary(s)  # a match of the pattern matches the pattern as a whole
        ids = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(self.known) >= CACHED:
            self.known.clear()
        self.known[s] = ids
        return ids

    def pieces(self, parts: Iterable[str]) -> bytes:
        get = self.known.get
        return b"".join([get(s) or self.piece(s) for s in parts])

    def encode(self, text: str) -> bytes:
        return self.pieces(self.pattern.findall(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def worker_codec(spec: Broadcast, key: str) -> Codec:
    """The worker's codec, kept between tasks (functions travel by value, so it can't live in this module)."""
    home = sys.modules.setdefault("_seriesloom_worker", types.ModuleType("_seriesloom_worker"))
    if getattr(home, "key", None) != key:
        home.key, home.codec = key, Codec(*spec.value)
    return home.codec


def boundaries(pattern: regex.Pattern, text: str) -> list[int]:
    """Starts of the pattern's matches that don't follow a space: what stands before such a start is encoded the same
    way if the text ends there (a run of spaces before a word isn't: its last space goes to the word)."""
    return [a for m in pattern.finditer(text) if not (a := m.start()) or not text[a - 1].isspace()]


def chunk_cuts(pattern: regex.Pattern, chunk: str, last: bool, size: int = CHUNK) -> tuple[list[int], list[int]]:
    """(boundaries in the first OVERLAP code points, boundaries from ``size`` on) of a chunk that holds ``size`` and then
    up to OVERLAP more code points.  Unless it is the last, the chunk's end may cut a match, and a match that ends
    just before it might have gone on: the last boundaries aren't trusted.  At boundary 0 of a later chunk nothing is
    known of what stands before it, so it isn't offered."""
    starts = boundaries(pattern, chunk)
    trusted = starts if last else starts[:-3]
    return [x for x in trusted if 0 < x < OVERLAP], [x - size for x in trusted if x >= size]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", chunk: int = CHUNK, keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit token ids) and ``decoded`` (bytes of the decoded ids) to each row.

    Null texts encode as empty.  Texts of up to ``chunk`` code points are encoded
    where they are.  Longer ones are cut into chunks that overlap; each is
    pre-tokenised in a task of its own; between two chunks the text is cut at the
    first boundary that both found in their overlap, from where they must agree,
    since a match depends only on what follows its start; then the spans are
    encoded, again apart, and the ids put together.  Where no boundary is shared
    (a piece longer than the overlap) the whole text is encoded in one task.
    Equal long texts are encoded once.  Text without spaces costs n log n.  Repeated
    rows give equal ids; an empty table stays empty.
    """
    spark = docs.sparkSession
    ranks = read_ranks(rank_path)
    spec, key = spark.sparkContext.broadcast((ranks, pattern)), f"{rank_path} {len(ranks)} {pattern}"
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]

    def task() -> Callable[[pa.Array], list[pa.Array]]:
        codec = worker_codec(spec, key)

        def make(texts: pa.Array) -> list[pa.Array]:
            ids = [codec.encode(x.as_py() or "") for x in texts]
            return [array(ids, pa.binary()), array(map(codec.decode, ids), pa.binary())]

        return make

    t, names = named(text), [c for c in docs.columns if c not in ("ids", "decoded") and (keep_text or c != text)]
    length = F.coalesce(F.length(t), F.lit(0))
    short = extended(docs.filter(length <= chunk), text, fields, task, () if keep_text else (text,))
    k1, k2, own, i = spare(docs, "__k1", "__k2", "__own", "__ids")
    long = docs.filter(length > chunk).select(*[named(c) for c in names], F.xxhash64(t).alias(k1), F.md5(t.cast("binary")).alias(k2), t.alias(own))
    coded = _encode_long(long.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(own).alias("t")), spec, key, chunk)
    coded = coded.withColumnsRenamed({"k1": k1, "k2": k2, "ids": i})
    joined = long.drop(own).join(coded, [k1, k2]).select(*[named(c) for c in names], F.col(i).alias("ids"))

    def back() -> Callable[[pa.Array], list[pa.Array]]:
        codec = worker_codec(spec, key)
        return lambda ids: [array((codec.decode(raw(x)) for x in ids), pa.binary())]

    return short.union(extended(joined, "ids", fields[1:], back))


def _encode_long(long: DataFrame, spec: Broadcast, codec_key: str, chunk: int) -> DataFrame:
    """(k1, k2, ids) for the distinct texts of ``long``."""
    key = ["k1", "k2"]
    texts = save(long.dropDuplicates(key), "long-texts")
    n = F.ceil(F.length("t") / chunk).cast("int")
    at = texts.withColumn("n", n).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pieces = at.select(*key, "n", "c", F.substring(F.col("t"), F.col("c") * chunk + 1, F.lit(chunk + OVERLAP)).alias("s"))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = worker_codec(spec, codec_key).pattern
        for b in slices(batches, 4):
            heads, tails = [], []
            for x in b.column(4):
                head, tail = chunk_cuts(pattern, s := x.as_py(), len(s) < chunk + OVERLAP, chunk)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], array(heads, pa.list_(pa.int32())), array(tails, pa.list_(pa.int32()))], names=["k1", "k2", "n", "c", "s", "head", "tail"])

    found = save(pieces.repartition(*key, "c").mapInArrow(cuts, "k1 long, k2 string, n int, c int, s string, head array<int>, tail array<int>"), "chunk-cuts")
    before = found.select(*key, (F.col("c") + 1).alias("c"), F.col("tail").alias("met"))
    cut = found.filter("c > 0").join(before, [*key, "c"]).select(*key, "n", "c", F.array_min(F.array_intersect("head", "met")).alias("at"))
    cut = save(cut, "cuts")
    # a span lies in the piece that it begins in, since that reads on to where the next one is cut at the latest
    starts = cut.select(*key, "c", F.col("at").alias("a"))
    ends = cut.select(*key, (F.col("c") - 1).alias("c"), (F.col("at") + chunk).alias("z"))
    placed = found.join(starts, [*key, "c"], "left").join(ends, [*key, "c"], "left")
    a = F.coalesce("a", F.lit(0))
    spans = placed.select(*key, "c", F.substring(F.col("s"), a + 1, F.coalesce("z", F.length("s")) - a).alias("s"))
    torn = save(cut.filter("at is null").select(*key).distinct(), "torn")
    if not torn.isEmpty():  # texts with a piece longer than the overlap, as they are
        whole = texts.join(torn, key, "left_semi").select(*key, F.lit(0).alias("c"), F.col("t").alias("s"))
        spans = spans.join(torn, key, "left_anti").union(whole)
    else:
        discard(texts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(spec, codec_key)
        for b in slices(batches, 3):
            ids = [codec.encode(s.as_py()) for s in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], array(ids, pa.binary())], names=["k1", "k2", "c", "ids"])

    coded = spans.mapInArrow(encode, "k1 long, k2 string, c int, ids binary")
    put = coded.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("all"))
    # all pieces in one go, as text of two digits a byte, since only text is joined in one step
    out = save(put.select(*key, F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["ids"])), "")).alias("ids")), "long-ids")
    discard(texts, found, cut, torn)
    return out


def digests(encoded: DataFrame) -> list[Column]:
    """n_tokens, ids_sha256, decoded_sha256 as columns of an encoded table."""
    ids, decoded = encoded["ids"], encoded["decoded"]
    return [(F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")]
