"""Operator 2: URL rules, with decisions propagated over redirect and canonical-link equivalence."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, staged, table
from .components import connected_components

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
CANONICAL = [r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref\s*=\s*["']([^"']+)["']""", r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*\brel\s*=\s*["']?canonical\b"""]
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*["']?([^"'>\s]+)"""
BASE = r"""(?is)<base\b[^>]*\shref\s*=\s*["']?([^"'>\s]+)"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
#: What makes no other page: names of tracking parameters, host prefixes, index pages and slashes at the end.
TRACKING = r"[?&](?:utm_[^=&]*|ref|gclid|fbclid)=[^&]*"
ENDS = r"(?s)^([^?]*?)(?:/index\.html?)?/*(\?.*)?$"
FRONT = r"(?s)^[a-z][a-z0-9+.-]*://(?:www\.|m\.)?(.*)$"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; null or without :// empty."""
    rest = F.expr("substring(u, instr(u, '://') + 3)") if isinstance(url, str) else F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or without :// empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as struct(rule, action), else null; of equally long ones allow is first."""
    fits = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,action:string>"))


def node_of(url: Column) -> Column:
    """The url with scheme and host A-Z lower-cased (user names are not), as equal nodes are compared."""
    part = lambda i: F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)(.*)$", i)
    return F.when(url.rlike(ABSOLUTE), F.concat(ascii_lower(part(1)), part(2), ascii_lower(part(3)), part(4))).otherwise(url)


def canonical_of(node: Column) -> Column:
    """The url that a node (as node_of has it) redirects to by convention: http, no www. or m., no fragment, no tracking
    parameters, no index page and no slashes at the end. Null for what is no absolute url."""
    bare = F.regexp_replace(node, r"(?s)#.*$", "")
    cut = F.regexp_replace(bare, TRACKING, "")
    cut = F.when(F.contains(bare, F.lit("?")) & ~F.contains(cut, F.lit("?")), F.regexp_replace(cut, r"(?s)^([^&]*)&", "$1?")).otherwise(cut)
    ended = F.regexp_replace(cut, ENDS, "$1$2")
    return F.when(node.rlike(ABSOLUTE) & ended.rlike(FRONT), F.concat(F.lit("http://"), F.regexp_extract(ended, FRONT, 1)))


def alias_edges(urls: DataFrame, url: str = "url") -> DataFrame:
    """(a, b): each distinct url, as node_of has it, and the url that canonical_of gives, where they differ."""
    a = urls.select(node_of(F.col(url)).alias("a")).where("a IS NOT NULL").distinct()
    return a.select("a", canonical_of(F.col("a")).alias("b")).where("a <> b")


def _join(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:
        return ""


def _resolved(url: pd.Series, base: pd.Series, target: pd.Series) -> pd.Series:
    """Relative targets by the page's url and its base href; those that cannot be resolved are empty."""
    return pd.Series([_join(_join(u, b or ""), t) if u is not None and t is not None else None for u, b, t in zip(url, base, target, strict=True)], dtype=object)


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's url and the url that its canonical link or its refresh names, resolved and as node_of has it."""
    h = F.col(html)
    canonical = F.coalesce(*(F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in CANONICAL))
    low = F.lower(h)
    hit = pages.where(low.contains("canonical") | low.contains("refresh"))
    both = hit.where(F.col(url).isNotNull()).select(F.col(url).alias("a"), F.regexp_extract(h, BASE, 1).alias("base"), F.explode(F.array(canonical, F.nullif(F.regexp_extract(h, REFRESH, 1), F.lit("")))).alias("t"))
    both = both.withColumn("t", F.trim("t", F.lit(WS))).where("t <> ''")
    b = F.when(F.col("t").rlike(ABSOLUTE), F.col("t")).otherwise(F.pandas_udf(_resolved, "string")("a", "base", "t"))
    return both.select(node_of(F.col("a")).alias("a"), node_of(b).alias("b")).where(F.col("b").rlike(ABSOLUTE))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html", default: str = "allow", aliases: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every row of pages.

    A rule that fits a url decides it. Other urls follow their component under redirects (columns a and b,
    say from a crawl log), the pages' own canonical links and refreshes and, with aliases, the redirects by convention
    that canonical_of states: allow if a url in it is
    explicitly allowed, else block if one is blocked, else the default. A component's urls count whether
    or not a page has them; links may be relative, and scheme and host are compared (and component given) in lower case. Null urls have empty host and path and no component; repeated rows stay;
    other columns of pages are ignored. rules: the policy, a list of some hundreds at most.
    """
    cols = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("u"))
    own = lambda d, u: d.withColumn("host", host_of(F.col(u))).withColumn("path", path_of(F.col(u))).withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    judged = own(cols, "u").withColumn("u", node_of(F.col("u")))
    edges = html_edges(pages, url, html)
    if redirects is not None:
        given = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        edges = edges.unionAll(given)
    if aliases:
        edges = edges.unionAll(alias_edges(pages.select(F.col(url).alias("url"))))
        if redirects is not None:
            edges = edges.unionAll(alias_edges(given.select(F.explode(F.array("a", "b")).alias("url"))))
    nodes = own(staged(connected_components(edges), "nodes"), "node")
    by = nodes.groupBy("component").agg(F.max((F.col("hit.action") == "allow").cast("int")).alias("ok"), F.max((F.col("hit.action") == "block").cast("int")).alias("bad"))
    of = nodes.select("node", "component").join(by, "component").select(F.col("node").alias("u"), "component", F.when(F.col("ok") == 1, "allow").when(F.col("bad") == 1, "block").alias("by"))
    judged = judged.join(of, "u", "left").withColumn("component", F.coalesce("component", "u"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.action"), F.col("by"), F.lit(default)).alias("verdict"), "component")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_HOST = r"CASE WHEN instr({u}, '://') > 0 THEN translate(regexp_extract(substring({u}, instr({u}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = r"CASE WHEN instr({u}, '://') > 0 THEN regexp_extract(substring({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_RULE = "CASE " + " ".join(f"WHEN (host = '{r[: r.index('/')]}' OR host LIKE '%.{r[: r.index('/')]}') AND starts_with(path, '{r[r.index('/') :]}') THEN '{a} {r}'" for a, r in sorted(RULES, key=lambda x: (-len(x[1]), x[0]))) + " END"
_NODE = r"CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract({u}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)(.*)$', 1)) || regexp_extract({u}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)(.*)$', 2) || translate(regexp_extract({u}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)(.*)$', 3), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract({u}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)(.*)$', 4) ELSE {u} END"
_C0, _C1, _R = (p.replace("(?is)", "").replace("'", "''") for p in (*CANONICAL, REFRESH))
SQL = f"""
WITH RECURSIVE e0 AS (
  SELECT url AS a, unnest([nullif(coalesce(nullif(regexp_extract(html, '{_C0}', 1, 'is'), ''), regexp_extract(html, '{_C1}', 1, 'is')), ''), nullif(regexp_extract(html, '{_R}', 1, 'is'), '')]) AS b FROM pages WHERE url IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
u0 AS (SELECT DISTINCT {_NODE.format(u='url')} AS u FROM pages WHERE url IS NOT NULL),
u1 AS (SELECT u, regexp_replace(u, '(?s)#.*$', '') AS bare FROM u0),
u2 AS (SELECT u, bare, regexp_replace(bare, '{TRACKING}', '', 'g') AS cut FROM u1),
u3 AS (SELECT u, regexp_replace(CASE WHEN contains(bare, '?') AND NOT contains(cut, '?') THEN regexp_replace(cut, '(?s)^([^&]*)&', '\\1?') ELSE cut END, '{ENDS}', '\\1\\2') AS ended FROM u2),
u4 AS (SELECT u, 'http://' || regexp_extract(ended, '{FRONT}', 1) AS b FROM u3 WHERE regexp_matches(u, '{ABSOLUTE}') AND regexp_matches(ended, '{FRONT}')),
e1 AS (SELECT {_NODE.format(u='a')} AS a, {_NODE.format(u='b')} AS b FROM e0 WHERE contains(b, '://') UNION SELECT u, b FROM u4 WHERE u <> b),
e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
n AS (SELECT *, {_RULE} AS hit FROM (SELECT node, component, {_HOST.format(u='node')} AS host, {_PATH.format(u='node')} AS path FROM comp)),
c AS (SELECT component, CASE WHEN bool_or(starts_with(hit, 'allow')) THEN 'allow' WHEN bool_or(starts_with(hit, 'block')) THEN 'block' END AS by FROM n GROUP BY component),
p AS (SELECT *, {_RULE} AS hit FROM (SELECT page_id, {_NODE.format(u='url')} AS url, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path FROM pages))
SELECT p.page_id, p.host, p.path, substring(p.hit, 7) AS rule, coalesce(substring(p.hit, 1, 5), c.by, 'allow') AS verdict, coalesce(n.component, p.url) AS component
FROM p LEFT JOIN n ON n.node = p.url LEFT JOIN c ON c.component = n.component
"""
