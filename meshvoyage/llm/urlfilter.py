"""URL filtering with redirect equivalence, in DataFrame functions only.

Pages that redirect to each other or name a canonical address are one resource:
connected components over those edges carry block decisions to all aliases.  An
explicit allow anywhere in a component outweighs its blocks for the aliases that no
rule fits; a page that a rule fits follows its rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .decontam import LOWER, UPPER
from .storage import materialize

#: Up to this many rules are one expression; more are a table that is joined by host.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block, for ``host`` and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a rule's verdict is allow or block, not {self.verdict}")

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' for null or without it."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _node(url: Column) -> Column:
    """The address as a node: scheme and host lower-cased, without fragment; null without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path_of(url), query))


def _order(length, host_length, allow, name, verdict) -> Column:
    return F.struct(length.alias("length"), host_length.alias("host_length"), allow.alias("allow"), name.alias("name"), verdict.alias("verdict"))


def with_rule(rows: DataFrame, rules: list[Rule], host: str, path: str) -> DataFrame:
    """``rows`` with ``_rule``: the longest rule that fits (of equal ones, the longer host, then allow), or null."""
    if len(rules) <= INLINE_RULES:
        fits = [
            F.when(
                ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path)),
                _order(F.lit(len(r.name)), F.lit(len(r.host)), F.lit(r.verdict == "allow"), F.lit(r.name), F.lit(r.verdict)),
            )
            for r in rules
        ]
        if not fits:
            none = F.struct(F.lit("").alias("name"), F.lit("").alias("verdict"))
            return rows.withColumn("_rule", F.when(F.lit(False), none))
        return rows.withColumn("_rule", F.array_max(F.array(*fits)))
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "r_host string, r_path string, r_verdict string")
    labels = F.split(F.col(host), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = rows.select(host, path).distinct().withColumn("r_host", F.explode(ends)).join(table, "r_host").where(F.startswith(path, F.col("r_path")))
    name = F.concat("r_host", "r_path")
    best = each.groupBy(F.col(host).alias("_h"), F.col(path).alias("_p")).agg(F.max(_order(F.length(name), F.length("r_host"), F.col("r_verdict") == "allow", name, F.col("r_verdict"))).alias("_rule"))
    return rows.join(best, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").drop("_h", "_p")


def _unquoted(value: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(value), r"""^["'](.*)["']$""", "$1"), F.lit("&amp;"), F.lit("&"))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): the pages' own addresses and those of their canonical links and refresh redirects."""
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    href = lambda t: _unquoted(F.regexp_extract(t, r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1))
    fresh = lambda t: _unquoted(F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)""", 1))
    target = F.transform(
        F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b""") | t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b""")),
        lambda t: F.when(t.rlike("(?i)^<link"), href(t)).otherwise(fresh(t)),
    )
    rows = pages.select(F.col(url_col).alias("_u"), F.explode(target).alias("_t")).where("_t <> '' AND _u IS NOT NULL")
    u, t = F.col("_u"), F.col("_t")
    scheme, host, path = F.substring_index(u, "://", 1), host_of(u), path_of(u)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    whole = (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t)
        .when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(scheme, F.lit("://"), host, t))
        .when(F.startswith(t, F.lit("?")), F.concat(scheme, F.lit("://"), host, path, t))
        .when(~F.startswith(t, F.lit("#")), F.concat(scheme, F.lit("://"), host, folder, t))
    )
    return rows.select("_u", whole.alias("_whole")).select(_node(u).alias("a"), _node(F.col("_whole")).alias("b"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``redirects`` (a, b) adds edges, such as a crawler's log, to those that the pages
    name.  Targets that are no pages count as aliases, with their own rules.  Without
    a fitting rule or a blocked alias a page is allowed.  A null url, or one without
    ``://``, has an empty host and path and no aliases.  Repeated rows are judged
    alike; columns called host, path, rule or verdict are replaced; an empty table
    gives no rows.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(_node(F.col("a")), _node(F.col("b"))))
    edges = materialize(edges.distinct(), "aliases").where("a <> b")
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(url_col).alias("_u"))
    ruled = with_rule(plain.withColumns({"_host": host_of(F.col("_u")), "_path": path_of(F.col("_u"))}), rules, "_host", "_path")
    verdict = F.coalesce(F.col("_rule.verdict"), F.lit("allow"))
    if not edges.isEmpty():
        nodes = connected_components(edges)
        nodes = with_rule(nodes.withColumns({"_host": host_of(F.col("node")), "_path": path_of(F.col("node"))}), rules, "_host", "_path")
        said = F.col("_rule.verdict")
        blocked = nodes.groupBy("component").agg(F.max(F.when(said == "allow", 2).when(said == "block", 1)).alias("_said")).where("_said = 1").select("component")
        aliases = materialize(nodes.join(blocked, "component", "left_semi").select(F.col("node").alias("_alias")), "blocked")
        ruled = ruled.join(aliases, _node(F.col("_u")) == F.col("_alias"), "left")
        verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_alias").isNotNull(), "block"), F.lit("allow"))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)]
    return ruled.select(*back, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.name").alias("rule"), verdict.alias("verdict"))
