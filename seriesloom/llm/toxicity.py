"""Toxicity by a weighted finite-state grammar over clauses.

Tokens get a class from a lexicon (insult, threat, target, negation, reported
speech, quotes, clause ends).  Three transducers over classes are composed into
one table: negation marks what stands in its scope, reported speech marks what
is quoted or told, and the pattern transducer emits, where a clause ends, the kind
of clause that it was: a plain or targeted insult, a threat, or one that was only
negated or reported.  A clause weighs what its marked words add up to, and the
score comes from the clauses, not from words.  The lexicon, its weights and those
of the kinds of clause are fitted to a bounded sample of labelled rows; learnt
words that mostly have a target for an object are threats, the others insults.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import array, extended, named, spare
from .scratch import save

#: Token classes.
WORD, INSULT, THREAT, TARGET, NEGATION, SAYING, QUOTE, END = range(8)
#: What clauses the grammar emits.
KINDS = ("plain", "targeted", "threat", "negated", "reported")
PLAIN, TARGETED, THREATENED, NEGATED, REPORTED = range(1, 6)
#: Further outputs: a clause with a threat and no target; a word that counts as it stands, negated, reported.
OPEN, BARE, UNDER_NEGATION, IN_REPORT = range(6, 10)

# Seed words of the classes in English, German, Spanish and French.
SEEDS = {
    INSULT: "clown disgusting idiot loser moron pathetic scum stupid trash worthless",
    THREAT: "kill hurt stab strangle töten umbringen verprügeln matar golpear tuer frapper",
    TARGET: "you your yourself du dich dir ihr euch tú ti usted ustedes vosotros tu toi vous",
    NEGATION: "not no never nobody isn't aren't don't nicht nie kein keine nunca jamás pas jamais",
    SAYING: "said says say called calls told tells wrote sagte sagt nannte dijo dice llamó dit appelle",
}
#: Words after a negation that it reaches.
SCOPE = 3
#: Labelled rows of each label that fit the grammar, at most (about; chosen by hash).
SAMPLE = {1: 4000, 0: 8000}
#: Lengths of the word beginnings that the lexicon may hold beside whole words.
STEMS = range(3, 9)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]|[\"“”„«»]")
_ENDS, _QUOTES = frozenset(".!?;\n"), frozenset("\"“”„«»")


@dataclass(frozen=True)
class Transducer:
    """arcs[state, input] = (next state, output); state 0 is the start."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int]]

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, ``other`` reads. Only reachable pairs of states are built."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        inputs = sorted({i for _, i in self.arcs})
        while todo:
            a, b = at = todo.pop()
            for i in inputs:
                a2, mid = self.arcs[a, i]
                b2, out = other.arcs[b, mid]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                arcs[number[at], i] = (number[a2, b2], out)
        return Transducer(len(number), arcs)


#: A class with a mark: negated adds 8, reported adds 16.
_NEG, _REP = 8, 16


def negation() -> Transducer:
    """State k: k more words are negated. Insults and threats in reach get the mark; a clause's end ends it."""
    arcs = {}
    for k, c in product(range(SCOPE + 1), range(8)):
        nxt = SCOPE if c == NEGATION else 0 if c == END else k if c == QUOTE else max(k - 1, 0)
        arcs[k, c] = (nxt, c | _NEG if k and c in (INSULT, THREAT) else c)
    return Transducer(SCOPE + 1, arcs)


def reported_speech() -> Transducer:
    """State 1: after a verb of saying in the clause; 2: within quotes that such a verb opened."""
    arcs = {}
    for s, c in product(range(3), [*range(8), INSULT | _NEG, THREAT | _NEG]):
        if s == 0:
            nxt = 1 if c == SAYING else 0
        elif s == 1:
            nxt = 2 if c == QUOTE else 0 if c == END else 1
        else:
            nxt = 0 if c == QUOTE else 2
        arcs[s, c] = (nxt, c | _REP if s and c & 7 in (INSULT, THREAT) else c)
    return Transducer(3, arcs)


def patterns() -> Transducer:
    """States: the gravest kind of clause so far, and whether a target was named.  Words that count are told by their mark;
    a clause's kind is told at its end.  A target, before or after, makes an insult targeted and an open threat a threat."""
    grave = [0, NEGATED, REPORTED, PLAIN, OPEN, TARGETED, THREATENED]
    marks = [0, _NEG, _REP, _NEG | _REP]
    arcs = {}
    for kind, aimed, c in product(grave, (0, 1), [*range(8), *[w | m for w in (INSULT, THREAT) for m in marks[1:]]]):
        out, nxt, aim = 0, kind, aimed
        if c == END:
            out, nxt, aim = kind, 0, 0
        elif c == TARGET:
            nxt, aim = {PLAIN: TARGETED, OPEN: THREATENED}.get(kind, kind), 1
        elif c & 7 in (INSULT, THREAT):
            out = IN_REPORT if c & _REP else UNDER_NEGATION if c & _NEG else BARE
            bare = (TARGETED if aimed else PLAIN) if c == INSULT else (THREATENED if aimed else OPEN)
            own = REPORTED if c & _REP else NEGATED if c & _NEG else bare
            nxt = max(kind, own, key=grave.index)
        arcs[2 * kind + aimed, c] = (2 * nxt + aim, out)
    return Transducer(14, arcs)


def grammar() -> list[list[tuple[int, int]]]:
    """The composed transducer as table[state][class] = (next state, kind or 0)."""
    t = negation().then(reported_speech()).then(patterns())
    return [[t.arcs[s, c] for c in range(8)] for s in range(t.states)]


class Model(NamedTuple):
    """words, stems: lexicon with weights; coef: bias and a weight for each kind of clause; threats: entries that aren't insults."""

    words: dict[str, float]
    stems: dict[str, float]
    coef: tuple[float, ...]
    threats: frozenset[str] = frozenset()


#: Where the fit of the clause weights starts from and is drawn to: bias, plain, targeted, threat, negated, reported.
PRIOR = (-3.0, 3.0, 3.5, 2.0, 1.0, 1.0)


def seed_model() -> Model:
    return Model({w: 3.0 for w in SEEDS[INSULT].split()}, {}, PRIOR)


class Scorer:
    """Classes tokens, runs the grammar, sums the clauses' weights; one in each task."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, grammar()
        self.known: dict[str, tuple[int, float]] = {w: (c, 1.0) for c, words in SEEDS.items() for w in words.split() if c != INSULT}
        self.known |= {w: (THREAT, self.entry(w)[1] or 1.0) for w in SEEDS[THREAT].split()}
        self.known |= {x: (END, 0.0) for x in _ENDS} | {x: (QUOTE, 0.0) for x in _QUOTES}
        self.fixed = dict(self.known)

    def entry(self, token: str) -> tuple[int, float]:
        """Class and weight of a token by the lexicon: as a whole word, else by the strongest of its beginnings."""
        m = self.model
        found = [(m.words[token], token)] if m.words.get(token) else [(m.stems[token[:n]], token[:n]) for n in STEMS if n < len(token) and token[:n] in m.stems]
        if not found:
            return WORD, 0.0
        weight, of = max(found)
        return (THREAT if of in m.threats else INSULT), weight

    def look_up(self, token: str) -> tuple[int, float]:
        if len(self.known) > 100_000:  # forms seen, not results: what is dropped is looked up again
            self.known = dict(self.fixed)
        got = self.known[token] = self.entry(token)
        return got

    def clauses(self, text: str) -> np.ndarray:
        """Summed weights of the matched clauses of each kind.  A clause with a threat but no target counts as a plain one by
        its insults and by threats that the labels taught; the seeds among them mean nothing without a target."""
        out, state, known, hot = [0.0] * (len(KINDS) + 1), 0, self.known, False
        seen = []
        for token in TOKEN.findall(text.lower()):
            got = known.get(token) or self.look_up(token)
            hot = hot or got[0] == INSULT or got[0] == THREAT
            seen.append(got)
        if hot:
            sums, unaimed = [0.0, 0.0, 0.0], 0.0
            for c, weight in [*seen, (END, 0.0)]:
                state, told = self.table[state][c]
                if told >= BARE:
                    sums[told - BARE] += weight
                    unaimed += weight if told == BARE and (c == INSULT or weight > 1) else 0.0
                elif told:
                    out[PLAIN if told == OPEN else told] += unaimed if told == OPEN else sums[{NEGATED: 1, REPORTED: 2}.get(told, 0)]
                if c == END:
                    sums, unaimed = [0.0, 0.0, 0.0], 0.0
        return np.log1p(np.array(out[1:]))

    def score(self, text: str | None) -> float:
        z = self.model.coef[0] + float(np.dot(self.model.coef[1:], self.clauses(text or "")))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _min_hashes(words: list[str], n: int = 4) -> list[int]:
    shingles = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh64_intdigest(s, k) for s in shingles) >> 1 for k in range(n)]


def _forms(words: Iterable[str]) -> set[str]:
    """Word beginnings, and whole words marked by $."""
    return {f for w in set(words) for f in (w + "$", *(w[:n] for n in STEMS if n < len(w)))}


def _directed(tokens: list[str]) -> set[str]:
    """The forms of words that a target follows within SCOPE words of the same clause."""
    targets, out, reach = frozenset(SEEDS[TARGET].split()), set(), 0
    for w in reversed(tokens):
        if w in _ENDS:
            reach = 0
        elif w in targets:
            reach = SCOPE
        elif w not in _QUOTES:
            if reach:
                out.add(w)
            reach = max(reach - 1, 0)
    return _forms(out)


def choose_entries(toxic: Counter[str], clean: Counter[str], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and stems that tell toxic from clean documents, with log odds as weights.

    An entry is in at least one toxic document in a hundred (three at least) and
    at least twenty times as frequent there.  A stem gives way to a longer one or
    a word that has nine tenths of its documents, and what a chosen stem covers is
    left out.
    """
    least = max(3, n_toxic // 100)
    odds = {f: math.log((t + 0.5) / (n_toxic + 1)) - math.log((clean[f] + 0.5) / (n_clean + 1)) for f, t in toxic.items() if t >= least}
    good = {f for f, x in odds.items() if x >= math.log(20)}
    longer = defaultdict(int)
    for f in good:
        bare = f.rstrip("$")
        for n in range(min(STEMS), len(f) if f[-1] == "$" else len(bare)):
            longer[bare[:n]] = max(longer[bare[:n]], toxic[f])
    words, stems = {}, {}
    for f in sorted(good, key=lambda f: (len(f), f)):
        bare = f.rstrip("$")
        if any(bare[:n] in stems for n in STEMS if n <= len(bare)):
            continue
        if f[-1] == "$":
            words[bare] = odds[f]
        elif longer[f] < 0.9 * toxic[f]:
            stems[f] = odds[f]
    return words, stems


def fit_clauses(x: np.ndarray, y: np.ndarray, pull: float = 0.2) -> tuple[float, ...]:
    """Logistic regression of the labels on clause weights, drawn to PRIOR; weights of clauses stay at zero or above."""
    prior = np.array(PRIOR)
    w, design = prior.copy(), np.column_stack([np.ones(len(x)), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + pull * (w - prior)
        hess = (design * (p * (1 - p))[:, None]).T @ design + pull * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", sample: dict[int, int] | None = None) -> Model:
    """Learn the lexicon and the clause weights from labelled rows; rows without text or with a null label are left out.

    About ``sample[label]`` rows of each label are taken, chosen by a hash of the
    id, whatever the table's size; only those are read by what follows, and of
    near copies among them one counts.  Their ids are broadcast: the sample bounds
    them.  Without labelled rows of both kinds the seed lexicon is the model.
    """
    sample = sample or SAMPLE
    given = labels.filter(named(label).isin(0, 1)).select(named(id_col).alias("__id"), named(label).cast("int").alias("__y"))
    sizes = dict(given.groupBy("__y").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return seed_model()
    place = F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1 << 20))
    some = given.filter(F.when(F.col("__y") == 1, place < int((1 << 20) * min(1.0, sample[1] / sizes[1]))).otherwise(place < int((1 << 20) * min(1.0, sample[0] / sizes[0]))))
    chosen = docs.filter(named(text).isNotNull()).select(named(id_col).alias("__id"), named(text).alias("__t")).join(F.broadcast(some), "__id").select("__y", "__t")

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [TOKEN.findall(t.lower()) for t in b.column(1).to_pylist()]
            words = [[w for w in ws if w[0] not in _ENDS and w[0] not in _QUOTES] for ws in words]
            hashes = [_min_hashes(ws) for ws in words]
            yield pa.RecordBatch.from_arrays([b.column(0), array(hashes, pa.list_(pa.int64())), b.column(1)], names=["y", "h", "t"])

    rows = save(chosen.mapInArrow(prepared, "y int, h array<long>, t string"), "toxicity-sample").withColumn("k", F.expr("h[0]"))
    met: list[set[int]] = [set() for _ in range(4)]
    kept = []
    for y, h in sorted((r.y, tuple(r.h)) for r in rows.select("y", "h").distinct().collect()):
        if not any(x in m for x, m in zip(h, met, strict=True)):
            kept.append((y, h[0]))
        for x, m in zip(h, met, strict=True):
            m.add(x)
    spark = docs.sparkSession
    once = pa.table({"y": pa.array([y for y, _ in kept], pa.int32()), "k": pa.array([k for _, k in kept], pa.int64())})
    once = spark.createDataFrame(once, "y int, k long")  # rows would start further Python workers on each executor
    rows = save(rows.join(F.broadcast(once), ["y", "k"]).dropDuplicates(["y", "k"]).select("y", "t"), "toxicity-distinct")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str], Counter[str]] = (Counter(), Counter(), Counter())

        def told() -> Iterator[pa.RecordBatch]:
            forms = list(seen[0].keys() | seen[1].keys())
            for k in range(0, len(forms), 10_000):
                part = forms[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([array([f.encode() for f in part], pa.binary()).cast(pa.string()), *[array([s[f] for f in part], pa.int64()) for s in seen]], names=["f", "clean", "toxic", "aimed"])
            for s in seen:
                s.clear()

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall(t.lower())
                seen[y].update(_forms(w for w in tokens if w[0] not in _ENDS and w[0] not in _QUOTES))
                if y:
                    seen[2].update(_directed(tokens))
                if len(seen[0]) + len(seen[1]) > 200_000:  # a task's memory doesn't grow with its rows
                    yield from told()
        yield from told()

    n = dict(rows.groupBy("y").count().collect())
    least = max(3, n.get(1, 0) // 100)
    tally = rows.mapInArrow(counted, "f string, clean long, toxic long, aimed long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "aimed")])
    strong = tally.filter((F.col("toxic") >= least) & (F.col("toxic") * max(n.get(0, 0), 1) >= 10 * F.col("clean") * max(n.get(1, 0), 1))).collect()
    words, stems = choose_entries(Counter({r.f: r.toxic for r in strong}), Counter({r.f: r.clean for r in strong}), n.get(1, 0), n.get(0, 0))
    threats = frozenset(r.f.rstrip("$") for r in strong if 2 * r.aimed >= r.toxic and r.f.rstrip("$") in (words if r.f[-1] == "$" else stems))
    model = Model({**seed_model().words, **words}, stems, PRIOR, threats - frozenset(SEEDS[INSULT].split()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            x = [scorer.clauses(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(measured, "y int, x array<double>").collect()
    return model._replace(coef=fit_clauses(np.array([r.x for r in got]), np.array([r.y for r in got]))) if got else model


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """Add the score from 0 to 1; null and empty texts get the bias's. All other columns pass through untouched."""

    def task() -> Callable[[pa.Array], list[pa.Array]]:
        scorer = Scorer(model)
        return lambda texts: [array([scorer.score(x.as_py()) for x in texts], pa.float64())]

    return extended(docs, text, [T.StructField(out, T.DoubleType())], task, () if keep_text else (text,))


def held_out(id_: Column) -> Column:
    """The third of the ids whose labels no model here sees."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; fitted to the labels outside the held-out third.

    Null ids are not held out; repeated rows are scored alike; an empty table
    gives an empty result, and empty labels the seed lexicon's scores.
    """
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = with_score(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they were.

    Null and empty texts stay; repeated rows are judged alike; an empty table stays empty.
    """
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    score = spare(docs, "__score")[0]
    return with_score(docs, model, out=score).filter(F.col(score) < threshold).drop(score)
