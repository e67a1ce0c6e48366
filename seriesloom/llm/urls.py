"""URL columns: host, path, canonical form."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """https, no ``www.``, no default port, fragment, tracking parameters, ``index.html``, ``.html`` or final slash.

    Null stays null; what has no ``://`` stays as it is.
    """
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), ":(80|443)$", "")
    kept = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref)(=|$)"))
    args = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    clean = F.concat(F.lit("https://"), name, F.regexp_replace(path(url), r"(/index)?\.html$|/$", ""), args)
    return F.when(F.instr(url, "://") > 0, clean).otherwise(url)


#: DuckDB's version of :func:`canonical` for a column u.
CANONICAL_SQL = r"""CASE WHEN contains({u}, '://') THEN 'https://' ||
  regexp_replace(regexp_replace(translate(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(80|443)$', '') ||
  regexp_replace(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1), '(/index)?\.html$|/$', '') ||
  coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&'), ''), '') ELSE {u} END"""
