"""Allow and block decisions for urls, carried over to their aliases.

A rule names a host and a path prefix.  A url that no rule fits takes the
decision of its aliases: redirects and canonical links are edges of a graph
whose vertices are urls, and a connected component (found by
components.connected_components) is one set of aliases.  A component that holds
an explicitly blocked url is blocked, unless it also holds an explicitly allowed
one: allow takes precedence.  Only columns and joins are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: A rule is written host followed by path.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first "://"; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """From the first "://" up to /, ?, # or the end, A-Z lower-cased; empty for null or without "://"."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without "://"."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _vertex(url: Column) -> Column:
    """A url without scheme and fragment, its host lower-cased: what stands for a page in the graph."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit(""))))


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (name, verdict) of the longest rule that fits, null if none does; of equally long rules, an allowing one."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow"))
    table = F.array(*[F.struct(*[F.lit(getattr(r, x)).alias(x) for x in ("name", "verdict", "host", "path")]) for r in ordered])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.replace(F.trim(F.regexp_replace(value, r"^[\"']|[\"']$", "")), F.lit("&amp;"), F.lit("&"))


def _absolute(base: Column, target: Column) -> Column:
    """target as seen from the page base; null if it names no page."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.concat(root, F.regexp_replace(path_of(base), r"[^/]*$", ""))
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.rlike(r"^(#|\?|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .otherwise(F.concat(F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder), target))
    )


def page_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(source, target) urls: each page's canonical links and meta refreshes. Pages without url or html give none."""
    url, html = F.col(url_column), F.col(html_column)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>)"), F.lit(1))
    found = pages.where(html.rlike("(?i)canonical|refresh")).select(url.alias("source"), F.explode(tags).alias("tag"))
    canonical = F.when(F.lower(_attribute(F.col("tag"), "rel")) == "canonical", _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*['\"]?([^'\"\s]+)", 1))
    # Exploding, unlike projecting, keeps the optimizer from writing an expression out wherever it is used.
    raw = found.select("source", F.explode(F.array_compact(F.array(canonical, refresh))).alias("raw")).where("source IS NOT NULL")
    return raw.select("source", F.explode(F.array_compact(F.array(_absolute(F.col("source"), F.col("raw"))))).alias("target"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Columns page_id, host, path, rule (the fitting rule's name or null), verdict ("allow" or "block").

    redirects: further edges (source, target).  A page whose url fits a rule gets that rule's verdict, whatever its aliases;
    one that fits none is blocked if some alias, in the table or only linked to, is blocked by a rule and none is allowed by
    one; otherwise it is allowed.  A null url, or one without "://", has no aliases and is allowed.  Every row of pages gives
    one row, repeated rows equal ones; an empty table gives none; other columns are ignored.
    """
    url = F.col(url_column)
    base = pages.select(F.col(id_column).alias("page_id"), url.alias("__url")).withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    base = base.withColumn("__rule", match_rule(F.col("host"), F.col("path"), rules))
    links = page_links(pages, url_column, html_column)
    if redirects is not None:
        links = links.union(redirects.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL"))
    ends = links.select(_vertex(F.col("source")).alias("u"), _vertex(F.col("target")).alias("v"))
    parts = connected_components(ends)
    # A vertex is host, path and query, which is all that rules look at.
    named = F.concat(F.lit("any://"), F.col("vertex"))
    own = match_rule(host_of(named), path_of(named), rules)["verdict"]
    aliases = parts.select("vertex", "component", own.alias("verdict"))
    blocked = aliases.groupBy("component").agg(F.max(F.col("verdict") == "block").alias("b"), F.max(F.col("verdict") == "allow").alias("a"))
    blocked = aliases.join(blocked.where("b AND NOT coalesce(a, false)"), "component").select(F.col("vertex").alias("__vertex"), F.lit(True).alias("__blocked"))
    judged = base.withColumn("__vertex", _vertex(F.col("__url"))).join(blocked, "__vertex", "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("__rule.name").alias("rule"), verdict.alias("verdict"))


def urls_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """judge_urls in SQL: rules, links between the pages and reachability over them."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def rule(host: str, path: str, what: str) -> str:
        cases = " ".join(
            f"WHEN ({host} = {quote(r.host)} OR ends_with({host}, {quote('.' + r.host)})) AND starts_with({path}, {quote(r.path)}) THEN {quote(getattr(r, what))}"
            for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow"))
        )
        return f"CASE {cases} END"

    def rest(x: str) -> str:
        return f"(CASE WHEN instr({x}, '://') > 0 THEN substr({x}, instr({x}, '://') + 3) END)"

    def host(x: str) -> str:
        return f"coalesce(translate(regexp_extract({rest(x)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"

    def path(x: str) -> str:
        return f"coalesce(regexp_extract({rest(x)}, '^[^/?#]*([^?#]*)', 1), '')"

    def vertex(x: str) -> str:
        return f"{host(x)} || {path(x)} || coalesce(regexp_extract({rest(x)}, '^[^?#]*(\\?[^#]*)?', 1), '')"

    return f"""
        WITH RECURSIVE p AS (SELECT page_id, url, {host("url")} AS host, {path("url")} AS path, {vertex("url")} AS vertex FROM pages),
        tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*(?:canonical|refresh)[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
        links AS (SELECT url, coalesce(nullif(regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?(\\w+://[^"''\\s>]+)', 1), ''), nullif(regexp_extract(tag, '(?i)url\\s*=\\s*(\\w+://[^"''\\s>]+)', 1), '')) AS target FROM tags),
        ends AS (SELECT {vertex("url")} AS u, {vertex("target")} AS v FROM links WHERE target IS NOT NULL),
        edges AS (SELECT u, v FROM ends UNION SELECT v, u FROM ends),
        reach(u, v) AS (SELECT u, u FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
        named AS (SELECT u, v, {host("'any://' || v")} AS host, {path("'any://' || v")} AS path FROM reach),
        blocked AS (SELECT u FROM named GROUP BY u HAVING bool_or(({rule("host", "path", "verdict")}) IS NOT DISTINCT FROM 'block') AND NOT bool_or(({rule("host", "path", "verdict")}) IS NOT DISTINCT FROM 'allow'))
        SELECT page_id, host, path, {rule("host", "path", "name")} AS rule,
            coalesce({rule("host", "path", "verdict")}, CASE WHEN vertex IN (SELECT u FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p"""
