"""URL filters with redirect equivalence, in DataFrame functions only.

Rules block or allow a host, all its subdomains and, with a path, what starts with it; the longest fitting rule decides.
Other pages follow the pages that they are equivalent to: edges are a page's canonical links and redirects found in its
HTML (every link rel=canonical, meta refresh, meta og:url) and its own url. In the connected components of these edges, a
page without a rule is blocked if a page of its component is blocked by a rule and none is explicitly allowed; an explicit
allow always stays.

Urls are one node if they differ only in scheme, in A-Z of the host, in a leading www. or m., in a trailing slash or .html
of the path, in dot segments or in the fragment; the query counts. References are resolved as RFC 3986 does, against the
page's own url (a base element isn't read); other schemes than http and https, and references to the page itself, are no
edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import components, shared_dir, written

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What refers to another page, with the reference as the group.
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
OPEN_GRAPH = r"(?is)<meta\b(?=[^>]*\bproperty\s*=\s*[\"']?og:url\b)[^>]*?\bcontent\s*=\s*[\"']?([^\"'\s>]+)"


def rest_of(url: Column) -> Column:
    """What follows the first ://, or the empty text."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; of equal lengths the first in order of name."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, of, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(of)
        found = F.coalesce(found, F.when(fits, F.struct(F.lit(name + of).alias("rule"), F.lit(verdict).alias("verdict"))))
    return found


def query_of(url: Column) -> Column:
    """The query with its question mark, or the empty text."""
    found = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    return F.when(found != "", F.concat(F.lit("?"), found)).otherwise(F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(part)))
    walked = F.array_join(F.aggregate(F.slice(F.split(path, "/"), 2, 1_000_000), F.array(F.lit("")), step), "/")
    return F.when(F.contains(path, F.lit("/.")), walked).otherwise(path)


def canonical(url: Column) -> Column:
    """The form that variants of a url share; null for a url without ://."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(without_dots(path_of(url)), r"(/|\.html?)$", "")
    return F.when(host != "", F.concat(host, path, query_of(url)))


def resolved(reference: Column, base: Column) -> Column:
    """The absolute url of a reference in the page `base`, or null if it isn't one to another page."""
    ref = F.regexp_replace(F.regexp_replace(F.trim(reference), r"(?i)&amp;", "&"), r"#.*$", "")
    site, path = F.concat(F.lit("x://"), host_of(base)), path_of(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when((ref == "") | (host_of(base) == ""), F.when(ref.rlike(r"(?i)^https?://"), ref))
        .when(ref.rlike(r"(?i)^https?://"), ref)
        .when(ref.startswith("//"), F.concat(F.lit("x:"), ref))
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(ref.startswith("/"), F.concat(site, ref))
        .when(ref.startswith("?"), F.concat(site, path, ref))
        .otherwise(F.concat(site, folder, ref))
    )


def edges(pages: DataFrame) -> DataFrame:
    """(page_id, nodes): the canonical forms that a page is equivalent to, each the hash of a url; its own comes first."""
    html = F.coalesce("html", F.lit(""))
    found = F.concat(*(F.regexp_extract_all(html, F.lit(x), F.lit(1)) for x in (CANONICAL, REFRESH, OPEN_GRAPH)))
    pages = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", found.alias("__refs"))
    linked = F.transform("__refs", lambda x: canonical(resolved(x, F.col("url"))))
    nodes = F.array_compact(F.concat(F.array(canonical(F.col("url"))), linked))
    return pages.select("page_id", F.transform(nodes, lambda x: F.xxhash64(x)).alias("nodes"))


def classes(pages: DataFrame, root: str | None = None) -> DataFrame:
    """(page_id, alias): pages of equal alias are equivalent. Pages of one canonical url share a node without being joined
    to each other; only nodes that some page has with another node are edges, so the graph holds redirects alone."""
    root = root or shared_dir(pages.sparkSession)
    found = written(edges(pages), root, "nodes")
    across = found.where("size(array_distinct(nodes)) > 1").select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b")).where("a <> b").distinct()
    joined = components(across, root)
    first = found.select("page_id", F.coalesce(F.get("nodes", F.lit(0)), F.xxhash64(F.col("page_id"), F.lit("page"))).alias("id"))
    return first.join(joined, "id", "left").select("page_id", F.coalesce("component", "id").alias("alias"))


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, root: str | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and alias (null for a null page_id); columns of these names are replaced.

    A null url has an empty host and path. Rows of one page_id are one page: their urls are equivalent. Rows with a null
    page_id are judged by rules alone. An empty table gives an empty result.
    """
    root = root or shared_dir(pages.sparkSession)
    pages = pages.drop("host", "path", "rule", "verdict", "alias")
    url = F.coalesce("url", F.lit(""))
    ruled = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    ruled = ruled.withColumn("__fit", fitting(F.col("host"), F.col("path"), rules))
    of = written(classes(pages, root).groupBy("page_id").agg(F.min("alias").alias("alias")), root, "aliases")
    own = ruled.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("__fit.verdict").alias("v"))
    spread = own.where("v is not null").join(of, "page_id").groupBy("alias").agg(F.bool_or(F.col("v") == "block").alias("blocked"), F.bool_or(F.col("v") == "allow").alias("allowed"))
    judged = of.join(spread, "alias", "left").select(F.col("page_id").alias("__page"), "alias", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("__verdict"))
    out = ruled.join(judged, ruled["page_id"] == judged["__page"], "left")
    return out.withColumns({"rule": F.col("__fit.rule"), "verdict": F.coalesce(F.col("__fit.verdict"), "__verdict", F.lit("allow"))}).drop("__fit", "__page", "__verdict")


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return filtered(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with recursive rules(host, path, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut as (
  select page_id, url, html, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parsed as (
  select page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query
  from cut
), ruled as (
  select p.page_id, p.host, p.path, p.query, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from parsed p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by p.page_id, p.host, p.path, p.query
), forms as (
  select *, case when host = '' then page_id::varchar else regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?)$', '') || case when query <> '' then '?' || query else '' end end as alias from ruled
)
select page_id, host, path, rule, coalesce(verdict, case when bool_or(coalesce(verdict = 'block', false)) over (partition by alias)
  and not bool_or(coalesce(verdict = 'allow', false)) over (partition by alias) then 'block' else 'allow' end) as verdict
from forms
"""
