"""Personal data: base patterns with code point spans, and terms that give a protected entity away.

DataFrame operations only.  A term near an entity is judged by how much of the
entity's information content it reveals over the corpus: with n(c) word places
near entity c, n(t) places of term t, n(c, t) places of t near c and N words,
the ratio of ln(n(c, t) N / (n(c) n(t))) to ln(N / n(c)).  It is 1 for a term
that is never seen away from the entity.  At few places n(c, t) / n(t) is
smoothed by one place as likely as any other, (n(c, t) + n(c) / N) / (n(t) + 1).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import named, spare
from .scratch import discard, save

KINDS = ("email", "ip", "card", "phone", "generalise", "remove", "secret")
GENERALISE, REMOVE, SECRET = 4, 5, 6
PLACE = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "", "[SECRET]")
#: The patterns of kinds 0 to 3 and of secrets in forms that Java matches in linear time.  Possessive runs and the look-behinds change no
#: match: all starts within a run go on alike, and a card is a maximal run of digits, so its number of digits can stand in the pattern.
#: A secret is a run of 20 or more letters and digits, three digits and a letter at least: more than a word's information.
_PATTERNS = {
    0: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    1: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    2: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
    SECRET: r"(?<![A-Za-z0-9])(?=(?:[A-Za-z]*+[0-9]){3})(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPACES = r"[\x20\x09-\x0D]"
_SPAN = "array<struct<kind:int,start:int,end:int>>"
#: Code points of context on either side of an entity, and of a piece that texts are cut into.
CONTEXT, PIECE = 60, 256
#: Stands for each code point of a span; a word that holds it touches a span (or held it from the start: it is no character).
_MASK = "\uffff"


class Limits(NamedTuple):
    """Ratios from which a term is generalised or removed, and the places near the entity below which they are smoothed."""

    generalise: float = 0.7
    remove: float = 0.9
    support: int = 3


def _valid(kind: int, m: Column) -> Column:
    if kind == 1:
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == 2:
        return F.call_function("luhn_check", F.regexp_replace(m, r"[\x20-]", ""))
    if kind == 3:
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once, wherever and however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _moved(a: Column, k: Column, fill: Column) -> Column:
    """The array 2 to the power of k places later, with ``fill`` before it."""
    d = F.call_function("shiftleft", F.lit(1), k)
    return F.concat(F.array_repeat(fill, d), F.slice(a, 1, F.size(a) - d))


def _doubling(a: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` for 1, 2, 4, ... places below the length of ``a``."""
    last = F.length(F.bin((F.size(a) - 1).cast("long"))) - 1
    return F.when(F.size(a) > 1, F.aggregate(F.sequence(F.lit(0), last), start, step)).otherwise(start)


def _running(lengths: Column) -> Column:
    """[l0, l0 + l1, ...] in n log n steps: each pass adds what stands 1, 2, 4, ... places before."""

    def add(acc: Column, k: Column) -> Column:
        return F.zip_with(acc, _moved(acc, k, F.lit(0)), lambda x, y: x + y)

    return let(lengths, lambda a: _doubling(a, a, add))


def _matches(kind: int, text: Column) -> Column:
    """What the kind's pattern matches, leftmost and non-overlapping; texts that can't hold any aren't searched."""
    maybe = {0: text.contains("@"), 3: text.contains("+")}.get(kind, text.rlike("[0-9]"))
    return F.when(maybe, F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _placed(kind: int, text: Column, matches: Column) -> Column:
    """Array of (kind, start, end, m) of the matches, the failing ones dropped; what lies between the matches tells their places."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,m:string>>")

    def place(m: Column) -> Column:
        ends = _running(F.zip_with(F.split(text, _PATTERNS[kind], -1), m, lambda p, x: F.length(p) + F.coalesce(F.length(x), F.lit(0))))
        spans = F.zip_with(m, ends, lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(x)).alias("start"), e.alias("end"), x.alias("m")))
        return F.filter(spans, lambda s: s["m"].isNotNull() & _valid(kind, s["m"]))

    return F.when(F.size(matches) > 0, let(matches, place)).otherwise(none)


def with_base_spans(df: DataFrame, text: str, out: str, kinds: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Add all spans of these kinds of a text without nulls as an array of (kind, start, end, m) by kind, then start."""
    t, names = named(text), spare(df, *[f"{out}{k}" for k in kinds])
    found = df.withColumns({n: _matches(k, t) for n, k in zip(names, kinds, strict=True)})
    return found.withColumn(out, F.concat(*[_placed(k, t, F.col(n)) for n, k in zip(names, kinds, strict=True)])).drop(*names)


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``, whatever stands before them in the text: only their own pieces are read."""
    first = F.floor(start / PIECE).cast("int")
    many = F.floor((end - 1) / PIECE).cast("int") - first + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, many), ""), start - first * PIECE + 1, end - start)).otherwise("")


def _merged(spans: Column) -> Column:
    """(start, end, kind) of the stretches that the spans cover, in order, of those that overlap as one with the first's kind."""
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def reach(a: Column) -> Column:
        """For each span, how far it and those before it go: a running maximum."""
        return _doubling(a, F.transform(a, lambda s: s["end"]), lambda acc, k: F.zip_with(acc, _moved(acc, k, F.lit(0)), lambda x, y: F.greatest(x, y)))

    def stretches(a: Column) -> Column:
        def join(far: Column) -> Column:
            before = F.concat(F.array(F.lit(-1)), F.slice(far, 1, F.size(far) - 1))
            heads = F.filter(F.zip_with(a, before, lambda s, b: F.struct(s.alias("s"), b.alias("b"))), lambda x: x["s"]["start"] >= x["b"])
            # a stretch ends where the reach before the next head is, the last one where all end
            ends = F.concat(F.transform(F.slice(heads, 2, F.greatest(F.size(heads) - 1, F.lit(0))), lambda x: x["b"]), F.slice(far, -1, 1))
            return F.zip_with(heads, ends, lambda x, e: F.struct(x["s"]["start"].alias("start"), e.alias("end"), x["s"]["kind"].alias("kind")))

        return let(reach(a), join)

    return F.when(F.size(spans) > 0, let(ordered, stretches)).otherwise(none)


def _woven(pieces: Column, stretches: Column, length: Column, put: Callable[[Column], Column]) -> Column:
    """The text with ``put`` of each stretch in its stead."""
    froms = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda s: s["end"]))
    gaps = F.zip_with(froms, stretches, lambda a, s: F.concat(_cut(pieces, a, F.coalesce(s["start"], length)), F.when(s.isNotNull(), put(s)).otherwise("")))
    return F.array_join(gaps, "")


def _entity(s: Column) -> Column:
    """The protected entity of a span: kind and value without writing variants."""
    plain = F.when(s["kind"] == 0, F.lower(s["m"])).when(s["kind"].isin(1, SECRET), s["m"]).otherwise(F.regexp_replace(s["m"], "[^0-9]", ""))
    return F.concat(s["kind"].cast("string"), F.lit(":"), plain)


def term(word: Column) -> Column:
    """Lower case without what isn't a letter or number at either end."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def masked(text: Column, spans: Column) -> Column:
    """The text with each code point of a span replaced by a mark."""
    return let(_pieces(text), lambda p: let(_merged(spans), lambda m: _woven(p, m, F.length(text), lambda s: F.repeat(F.lit(_MASK), s["end"] - s["start"]))))


def _contexts(mask: Column, spans: Column) -> Column:
    """Array of (entity, terms near it) for all spans of a masked text; words that touch a span or are cut are left out."""
    length = F.length(mask)

    def terms(part: Column, skip: Column, less: Column) -> Column:
        whole = let(F.split(part, _SPACES, -1), lambda w: F.slice(w, 1 + skip, F.greatest(F.size(w) - skip - less, F.lit(0))))
        return F.filter(F.transform(whole, lambda w: F.when(~w.contains(_MASK), term(w)).otherwise("")), lambda w: w != "")

    def near(pieces: Column) -> Column:
        def one(s: Column) -> Column:
            low, high = F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["end"] + CONTEXT, length)
            left = terms(_cut(pieces, low, s["start"]), F.when(low > 0, 1).otherwise(0), F.lit(0))
            right = terms(_cut(pieces, s["end"], high), F.lit(0), F.when(high < length, 1).otherwise(0))
            return F.struct(_entity(s).alias("entity"), F.concat(left, right).alias("words"))

        return F.transform(spans, one)

    return let(_pieces(mask), near)


def _places(mask: Column) -> Column:
    """Array of (term, start, end) of the words of a masked text that touch no span."""

    def place(words: Column) -> Column:
        ends = _running(F.transform(words, lambda w: F.length(w) + 1))
        found = F.zip_with(words, ends, lambda w, e: F.struct(F.when(~w.contains(_MASK), term(w)).otherwise("").alias("term"), (e - 1 - F.length(w)).alias("start"), (e - 1).alias("end")))
        return F.filter(found, lambda x: x["term"] != "")

    return let(F.split(mask, _SPACES, -1), place)


def disclosing_terms(near: DataFrame, texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(entity, term, kind): the terms that give an entity away; kind 4 is to be generalised, 5 to be removed.

    near: (entity, term) for each word place near an entity, a saved table.
    texts: one column ``t``, all texts; every word of every text is counted, words
    of equal form within a task first.
    """
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("nct"))
    of_entity = near.groupBy("entity").agg(F.count("*").alias("nc"))
    raw = texts.select(F.explode(F.split("t", _SPACES + "+")).alias("w")).groupBy("w").count()
    counts = save(raw.groupBy(term(F.col("w")).alias("term")).agg(F.sum("count").alias("nt")).filter("term <> ''"), "term-counts")
    total = counts.agg(F.sum("nt")).first()[0] or 0
    some = save(pairs, "pairs")
    joined = some.join(counts, "term").join(save(of_entity, "entities"), "entity")
    n = F.lit(float(max(total, 1)))
    nt = F.greatest("nt", "nct")
    share = F.when(F.col("nct") >= limits.support, F.col("nct") / nt).otherwise((F.col("nct") + F.col("nc") / n) / (nt + 1))
    ratio = F.ln(share * n / F.col("nc")) / F.ln(n / F.col("nc"))
    out = joined.filter(F.col("nc") < n).withColumn("ratio", ratio).filter(F.col("ratio") >= limits.generalise)
    out = save(out.select("entity", "term", F.when(F.col("ratio") >= limits.remove, 5).otherwise(4).alias("kind")), "disclosing")
    discard(some)
    return out


def find_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), limits: Limits = Limits(), out: str = "__spans") -> DataFrame:
    """Columns ``keep`` and ``out`` for each row: base spans (kinds 0-3), disclosing terms (4-5) and secrets (6), ordered.

    A term that gives an entity away is hidden at all its places in each row that holds the entity.
    Only contexts of entities, words of rows that hold an entity, term counts and
    spans are shuffled; texts are not, unless ``keep`` has them: then those of rows
    with spans.  Rows with null or empty texts have no spans; repeated rows have
    the same ones; an empty table gives an empty result.
    """
    row, t, m, base, both, near, places, extra = spare(docs, "__row", "__t", "__m", "__base", "__both", "__near", "__places", "__extra")
    cols = [named(c) for c in keep]
    whole = F.coalesce(named(text), F.lit(""))
    found = docs.select(*cols, whole.alias(t), F.monotonically_increasing_id().alias(row))
    found = with_base_spans(found, t, m, (0, 1, 2, 3, SECRET))
    some, bare = F.size(m) > 0, F.transform(m, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    around = let(masked(F.col(t), F.col(m)), lambda x: F.struct(_contexts(x, F.col(m)).alias("near"), _places(x).alias("places")))
    rows = found.select(*cols, row, bare.cast(_SPAN).alias(base), F.when(some, around).alias(both))
    rows = save(rows.select(*cols, row, base, F.col(f"{both}.near").alias(near), F.col(f"{both}.places").alias(places)), "base-spans")
    held = rows.filter(F.col(near).isNotNull())
    words = save(held.select(F.col(row).alias("row"), F.explode(near).alias("n")).select("row", "n.entity", F.explode("n.words").alias("term")), "near-words")
    reveal = disclosing_terms(words.select("entity", "term"), docs.select(whole.alias("t")), limits)
    entities = held.select(F.col(row).alias("row"), F.explode(F.array_distinct(F.transform(near, lambda n: n["entity"]))).alias("entity"))
    own = held.select(F.col(row).alias("row"), F.explode(places).alias("p")).select("row", "p.*")
    hits = own.join(reveal, "term").join(entities, ["row", "entity"], "left_semi").groupBy("row", "start", "end").agg(F.max("kind").alias("kind"))
    hits = save(hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias(extra)).withColumnRenamed("row", row), "row-terms")
    plain = rows.filter(F.col(near).isNull()).select(*cols, F.col(base).alias(out))
    joined = held.drop(near, places).join(hits, row, "left")
    full = F.array_sort(F.concat(base, F.coalesce(F.col(extra), F.array().cast(_SPAN))))
    discard(words)
    return plain.union(joined.select(*cols, full.alias(out)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def form(word: Column) -> Column:
    """The class that a term is generalised to: by its form a number, a code, a name or a word."""
    digit, letter = word.rlike("[0-9]"), word.rlike(r"\p{L}")
    return F.when(digit & letter, "[CODE]").when(digit, "[NUMBER]").when(word.rlike(r"^\P{L}*\p{Lu}"), "[NAME]").otherwise("[WORD]")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span's place holder in its stead; spans that overlap are replaced together, by the first's."""
    place = F.array(*[F.lit(p) for p in PLACE])

    def put(pieces: Column) -> Callable[[Column], Column]:
        return lambda s: F.when(s["kind"] == GENERALISE, form(_cut(pieces, s["start"], s["end"]))).otherwise(F.get(place, s["kind"]))

    done = let(_pieces(text), lambda p: let(_merged(spans), lambda m: _woven(p, m, F.length(text), put(p))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, n_terms, n_secret, base_sha256, spans for each row.

    Null and empty texts have no spans; repeated rows give repeated rows; an empty table gives an empty result.
    """
    found = find_spans(docs, text, (id_col,), limits)
    s = F.col("__spans")

    def number(*kinds: int) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"].isin(*kinds))).cast("long")

    counts = [number(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    base = F.filter(s, lambda x: x["kind"] < 4)
    return found.select(named(id_col).alias(id_col), *counts, number(GENERALISE, REMOVE).alias("n_terms"), number(SECRET).alias("n_secret"), F.sha2(written(base), 256).alias("base_sha256"), written(s).alias("spans"))


def sanitised(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """All rows and columns with the text sanitised: base spans and secrets become place holders, terms are generalised or removed.

    Null texts stay null; repeated rows are sanitised alike; an empty table stays empty.
    """
    out = spare(docs, "__spans")[0]
    found = find_spans(docs, text, tuple(docs.columns), limits, out)
    t = named(text)
    return found.select(*[F.when(t.isNotNull(), redact(t, F.col(out))).alias(c) if c == text else named(c) for c in docs.columns])
