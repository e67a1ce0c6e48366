"""URL rules with redirect equivalence: decisions reach all aliases of a page, explicit allows come first."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import named
from .components import connected_components
from .scratch import save
from .urls import canonical, host, path

#: A rule list is configuration; this many are compiled into the plan at most.
MOST_RULES = 10_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    text: str  # host/path prefix, such as ``example.net/en/``


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def match_rule(host_: Column, path_: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(text, verdict), or null; an allow wins over a block of the same text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.text.partition("/")[0], []).append(r)
    one = "struct<size:int,first:boolean,text:string,verdict:string>"
    found: list[Column] = []
    for name, own in by_host.items():
        fits = (host_ == name) | host_.endswith(f".{name}")
        for r in own:
            prefix = "/" + r.text.partition("/")[2]
            hit = F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.verdict == "allow").alias("first"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
            found.append(F.when(fits & path_.startswith(prefix), hit))
    return F.array_max(F.array_compact(F.array(*found)).cast(f"array<{one}>")) if found else F.lit(None).cast(one)


def resolved(base: Column, to: Column) -> Column:
    """A reference against the URL it stands in: absolute, ``//host``, from the root, or relative to the folder, without dot
    segments, query kept and fragment dropped; null where the base has no ``://`` or the reference is empty, a fragment or of another scheme."""
    plain = F.regexp_replace(to, "#.*$", "")
    scheme, root = F.regexp_extract(base, "^[^:/?#]*:", 0), F.regexp_extract(base, "^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), plain))
    steps = F.split(F.regexp_extract(whole, r"^/([^?]*)", 1), "/", -1)
    walked = F.aggregate(steps, F.lit(""), lambda a, x: F.when(x == ".", a).when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), x)))
    local = F.concat(root, walked, F.regexp_extract(whole, r"\?.*$", 0))
    out = F.when(plain.contains("://"), plain).when(plain.startswith("//"), F.concat(scheme, plain))
    return out.when((plain == "") | plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (root == ""), F.lit(None).cast("string")).otherwise(local)


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): all canonical links and refreshes that the pages declare, resolved against the page's URL."""
    links = F.regexp_extract_all(named(html), F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    jumps = F.regexp_extract_all(named(html), F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    to = F.concat(
        F.transform(links, lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(jumps, lambda x: F.regexp_extract(x, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    some = pages.filter(named(html).rlike(r"(?i)\bcanonical\b|\bhttp-equiv\b")).select(named(url).alias("src"), F.explode(to).alias("to"))
    return some.select("src", resolved(F.col("src"), F.col("to")).alias("dst")).filter("src <> dst")


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """id, host, path, rule, verdict, how, component for each row of ``pages``.

    A page that a rule fits gets the rule's verdict.  The others get the verdict
    of their alias class, the connected component over (a) each URL and its
    canonical form, (b) canonical links and refreshes declared in the html, and
    (c) ``redirects`` (src, dst): allow if a rule explicitly allows any URL of the
    class, else block if a rule blocks any, else allow.  ``how`` is rule, alias
    or default.  Null and malformed URLs have empty host and path, fit no rule
    and are allowed.  Repeated rows are judged alike; an empty table gives an empty result.
    """
    p = save(pages.select(named(id_col).alias("id"), named(url).alias("u")), "urls")
    judged = p.select("id", "u", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"))
    judged = judged.withColumn("r", match_rule(F.col("host"), F.col("path"), rules))
    links = p.select(F.col("u").alias("src"), canonical(F.col("u")).alias("dst"))
    if html is not None:
        links = links.union(declared_links(pages, url, html))
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    ends = links.filter("src <> dst")
    ends = ends.union(ends.select("dst", canonical(F.col("dst"))).filter("dst is not null")).distinct()
    comp = save(connected_components(ends), "aliases")
    own = match_rule(host(F.col("node")), path(F.col("node")), rules)["verdict"]
    votes = comp.withColumn("own", own).groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    votes = votes.filter("allowed or blocked").select("component", F.when(F.coalesce("allowed", F.lit(False)), "allow").otherwise("block").alias("says"))
    said = comp.join(save(votes, "votes"), "component", "left").select(F.col("node").alias("u"), "component", "says")
    out = judged.join(save(said, "said"), "u", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.col("says"), F.lit("allow"))
    how = F.when(F.col("r").isNotNull(), "rule").when(F.col("says").isNotNull(), "alias").otherwise("default")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.text").alias("rule"), verdict.alias("verdict"), how.alias("how"), F.coalesce("component", "u").alias("component"))
