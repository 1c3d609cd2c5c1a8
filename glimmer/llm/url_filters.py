"""URL filters with redirect equivalence, in DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; of those that
fit the longest decides. Method for urls without a rule: redirects (meta refresh) and canonical links are edges
between urls, connected components of these edges are aliases of one page, and a block of one alias is a block of
all, unless a rule allows one of them explicitly. A url's own rule always comes first.

Scale. A page is read once for its edges; only urls with an edge take part in the components, whose labels
and decisions are aggregated map-side, so one host or one component with a third of all rows is no hot group.
The join of decisions is on the url's alias, one row per alias on the right; Spark splits a hot key of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.components import components

ALLOW, BLOCK = "allow", "block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Elements that may name another url; a tag ends before the next one begins.
_TAGS = r"(?is)<(?:link|meta|base)\b[^<>]*>"
_MAY_NAME = r"(?i)canonical|refresh"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_of(url: Column) -> Column:
    """What urls that always lead to the same page share: host, path and query, without scheme, user, the scheme's own port, and fragment; no path is /."""
    after = _after_scheme(url)
    site = F.regexp_replace(F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER), "^.*@", "")
    site = F.regexp_replace(site, F.when(url.rlike("(?i)^https:"), F.lit(":(?:443)?$")).otherwise(F.lit(":(?:80)?$")), F.lit(""))
    rest = F.regexp_extract(after, r"^[^/?#]*([^#]*)", 1)
    return F.when(F.length(site) > 0, F.concat(site, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(F.lit(""))


def decoded(text: Column) -> Column:
    """HTML's character references in an attribute: the named ones that markup needs, and numbers; others stay."""
    def character(part: Column) -> Column:
        hexed = F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.when(F.length(hexed) > 0, F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(part, r"^([0-9]{1,7});", 1)).try_cast("int")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        return F.when(known, F.concat(letter, F.regexp_extract(part, r"(?s)^[0-9A-Fa-fxX]+;(.*)$", 1))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    numbered = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), character), ""))
    out = F.when(text.contains("&#"), numbered).otherwise(text)
    for name, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    return out


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its . and .. segments resolved."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(url: Column, goal: Column) -> Column:
    """The absolute form of a link on the page `url`; a link with a scheme stays as it is."""
    own = F.when(F.length(path_of(url)) > 0, path_of(url)).otherwise("/")
    folder = F.regexp_extract(own, r"^(.*/)", 1)
    path, rest = F.regexp_extract(goal, r"^([^?#]*)", 1), F.regexp_extract(goal, r"^[^?#]*(.*)$", 1)
    site = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(goal.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), goal)
        .when(goal.startswith("//"), F.concat(F.lit("http:"), goal))
        .when(goal.startswith("/"), F.concat(site, _without_dots(path), rest))
        .when(goal.startswith("#"), url)
        .when(goal.startswith("?"), F.concat(site, own, rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest))
    )


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Index of the longest rule (host/path) that fits, else null. The rule list is part of the plan."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), rules[k][1]))
    found = F.lit(None).cast("int")
    for k in reversed(order):
        rule_host, slash, rest = rules[k][1].partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in quotes of either kind or none, trimmed; empty where there is none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.trim(F.regexp_replace(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]), r"[\t\n\f\r]", " "))


def _goal_of(tag: Column) -> Column:
    """Where a canonical link or a refresh leads, as written; else empty."""
    rel = F.split(F.lower(_attribute(tag, "rel")), r"\s+")
    goes = F.regexp_extract(_attribute(tag, "content"), r"(?is)^[\d.\s]*[;,\s]\s*(?:url\s*=\s*)?[\"']?\s*([^\"'\s]+)", 1)
    return F.when(tag.rlike(r"(?i)^<link\b") & F.array_contains(rel, "canonical"), _attribute(tag, "href")).when(tag.rlike(r"(?i)^<meta\b") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), goes).otherwise(F.lit(""))


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b): aliases that a redirect or a canonical link joins, for every such link of a page.

    Character references are decoded, relative links resolved against the page's host and path, or its base element.
    """
    tags = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(F.col("html").rlike(_MAY_NAME)).select("url", F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)).alias("tags"))
    bases = F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b") & (F.length(_attribute(t, "href")) > 0)), lambda t: _attribute(t, "href"))
    goals = tags.select("url", F.get(bases, 0).alias("base"), F.explode(F.array_distinct(F.transform("tags", _goal_of))).alias("goal")).where(F.length("goal") > 0)
    goals = _worked_out(goals, F.col("url"), decoded(F.col("base")).alias("base"), decoded(F.col("goal")).alias("goal"))
    goals = _worked_out(goals, F.col("url"), F.coalesce(resolved(F.col("url"), F.col("base")), "url").alias("base"), F.col("goal"))
    return _edges(_worked_out(goals, F.col("url"), resolved(F.col("base"), F.col("goal")).alias("goal")))


def _worked_out(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows.select(*columns), behind which the optimizer can't put an expression into another one or a filter below it, again and again."""
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("row")).select("row.*")


def _edges(links: DataFrame) -> DataFrame:
    """(a, b) of (url, goal), absolute ones."""
    return _worked_out(links, alias_of(F.col("url")).alias("a"), alias_of(F.col("goal")).alias("b")).where((F.length("a") > 0) & (F.length("b") > 0))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (or null), verdict (allow or block).

    rules: (allow or block, "host/path"). redirects: further (from url, to url) rows, of a crawl log for instance.
    A null url, or one without ://, has empty host and path, fits no rule and is allowed. Null html has no edges.
    Rows may repeat; other columns, whatever their names, play no part; an empty table gives no rows. All canonical
    links and redirects of a page count.
    """
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rule = F.lit(None).cast("int") if not rules else best_rule(F.col("host"), F.col("path"), rules)
    own = slim.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), alias_of(F.col("url")).alias("alias")).withColumn("k", rule)
    names, verdicts = F.array(*[F.lit(r) for _, r in rules] or [F.lit("")]), F.array(*[F.lit(v) for v, _ in rules] or [F.lit("")])
    own = own.select("id", "host", "path", "alias", F.try_element_at(names, F.col("k") + 1).alias("rule"), F.try_element_at(verdicts, F.col("k") + 1).alias("said"))

    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        a, b = redirects.columns[:2]
        log = redirects.select(F.col(f"`{a}`").alias("url"), F.col(f"`{b}`").alias("goal"))
        edges = edges.unionByName(_edges(_worked_out(log, F.col("url"), resolved(F.col("url"), F.col("goal")).alias("goal"))))
    groups = components(edges)
    # a target may be known only from links: it is judged by the rules as well
    known = groups.select("node", "component", F.regexp_extract("node", r"^([^/?#]*)", 1).alias("host"), F.regexp_extract("node", r"^[^/?#]*([^?]*)", 1).alias("path"))
    said = F.try_element_at(verdicts, (best_rule(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("int")) + 1)
    decided = known.withColumn("said", said).groupBy("component").agg(F.max(F.col("said") == BLOCK).alias("blocked"), F.max(F.col("said") == ALLOW).alias("allowed"))
    spread = groups.join(decided, "component").where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False))).select(F.col("node").alias("alias"), F.lit(BLOCK).alias("spread"))
    return own.join(spread, "alias", "left").select("id", "host", "path", "rule", F.coalesce("said", "spread", F.lit(ALLOW)).alias("verdict"))
