"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule is a regular expression over the lower-cased host followed by the path,
with literal tokens (runs of a-z and 0-9) that any URL it matches must contain
whole. The index holds a rule once, under the one of its tokens that the fewest
URLs of the table contain. A URL's own tokens fetch its candidate rules by an
equi-join, and only those run. No candidate can be missed: a URL that matches a
rule contains the token under which the rule lies.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``rank`` decides between the rules that fit a URL: the largest wins, then the smaller name."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    reported: bool = True


def host_rule(host: str, path: str, action: str) -> UrlRule:
    """A rule for ``host`` and its subdomains and paths that start with ``path``; longer ones outrank shorter."""
    whole = re.findall("[a-z0-9]+", host)
    inside = re.findall("[a-z0-9]+", path.lower())
    if inside and path[-1:].isalnum():
        inside.pop()  # the URL's token may go on
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    return UrlRule(host + path, action, pattern, tuple(dict.fromkeys(whole + inside)), 1000 + len(host + path))


def word_rule(words: str, action: str = "block") -> UrlRule:
    """A rule for whole ``words``, joined by ``-``, anywhere in host or path; any host rule outranks it."""
    tokens = tuple(dict.fromkeys(words.split("-")))
    return UrlRule(words, action, f"(?:^|[^a-z0-9])(?i:{words})(?:[^a-z0-9]|$)", tokens, len(words), reported=False)


def glob_rule(glob: str, action: str = "block") -> UrlRule:
    """A rule for all of host and path, ``*`` for any text and ``{a,b}`` for one of several; any host rule outranks it.

    Its tokens are the runs outside of braces that neither a star nor a brace can make longer.
    """
    parts = re.findall(r"\*|\{[^{}]*\}|[^*{]+|\{", glob)
    pattern, plain = "", ""
    for part in parts:
        if part == "*":
            pattern, plain = pattern + ".*", plain + "*"
        elif part[0] == "{" and len(part) > 1:
            pattern += "(?:" + "|".join(map(re.escape, part[1:-1].split(","))) + ")"
            plain += "*"
        else:
            pattern, plain = pattern + re.escape(part), plain + part
    whole = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", plain.lower())
    return UrlRule(glob, action, rf"(?is)^{pattern}\z", tuple(dict.fromkeys(whole)), len(glob), reported=False)


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """The table that ``judge_urls`` reads, from rules of the driver."""
    kinds = [("name", pa.string()), ("action", pa.string()), ("pattern", pa.string()), ("tokens", pa.list_(pa.string())), ("rank", pa.int32()), ("reported", pa.bool_())]
    return spark.createDataFrame(pa.table({n: pa.array([getattr(r, n) for r in rules], k) for n, k in kinds}))


def host_and_path(url):
    """The two parts as columns: both empty for a null URL or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (null if none is reported), verdict.

    Without any rule that fits, the verdict is ``allow``. Null, empty and odd URLs
    have empty parts and fit only rules for empty parts; repeated rows get equal
    verdicts; an empty table or no rules are fine. ``rules`` is a table of (name, action,
    pattern, tokens, rank, reported), of any size, or a list for ``rule_table``; a rule
    with null or no tokens is tried on every URL. Equal rules count once.
    """
    listed = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    places = parts.select("host", "path").distinct()
    tokens = F.regexp_extract_all(F.lower(F.concat("host", F.lit("/"), "path")), F.lit("([a-z0-9]+)"), 1)
    exploded = places.select(
        "host", "path", F.explode(F.array_union(F.array_distinct(tokens), F.array(F.lit("")))).alias("token")
    )
    rule = ["name", "action", "pattern", "rank", "reported"]
    whole = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    listed = listed.select(*rule, F.explode(whole).alias("token"))
    held = exploded.join(listed.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("held"))
    index = (
        listed.join(held, "token", "left")
        .groupBy(*rule)
        .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))["token"].alias("token"))
    )
    fits = exploded.join(index, "token").where(F.expr("rlike(concat(host, path), pattern)"))
    best = fits.groupBy("host", "path").agg(
        F.min(F.struct((-F.col("rank")).alias("order"), "name", "action", "reported")).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(F.col("best.reported"), F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )
