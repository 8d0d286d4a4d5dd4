"""URL verdicts: rules on hosts and paths, and block decisions carried to aliases.

Redirects and canonical links make pages aliases of each other; the components of that graph, found on
the cluster, share their decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*+"  # what does not close ends with the text, so each character is read once
_VALUE = r"""\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+))"""
_CANONICAL = r"""(?is)[\s"'/]rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?is)[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """From the ? before any # up to it or the end, with the ?; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)


def address(url: Column, spellings: bool = True) -> Column:
    """What names a page: scheme, host, path and query, without the fragment. Null without ://.

    With ``spellings`` also without the scheme and closing slashes of the path, between which servers redirect.
    """
    whole = F.concat(F.lower(F.regexp_extract(url, r"(?s)^(.*?://)", 1)), host(url), path(url), query(url))
    bare = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), query(url))
    return F.when(host(url) != "", bare if spellings else whole)


def _attribute(tag: Column, name: str) -> Column:
    pattern = r"""(?is)[\s"'/]""" + name + _VALUE
    return F.trim(F.replace(F.concat(*(F.regexp_extract(tag, pattern, g) for g in (1, 2, 3))), F.lit("&amp;"), F.lit("&")))


def targets(html: Column) -> Column:
    """What the canonical links and refresh redirects of a page point to, as written, of all its link and meta tags."""
    tags = F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))
    found = F.transform(
        tags,
        lambda t: F.when(F.lower(t).startswith("<link") & t.rlike(_CANONICAL), _attribute(t, "href")).when(
            F.lower(t).startswith("<meta") & t.rlike(_REFRESH), F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)""", 1)
        ),
    )
    return F.filter(found, lambda t: t.isNotNull() & (t != ""))


def resolved(url: Column, target: Column) -> Column:
    """The absolute address of a target on a page; null for other schemes and for places on the page itself."""
    scheme, origin = F.regexp_extract(url, r"(?s)^(.*?):", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    whole = F.when(own == "", path(url)).when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    plain = F.array_join(F.aggregate(F.split(F.regexp_replace(whole, r"/(\.{1,2})$", "/$1/"), "/"), F.array().cast("array<string>"), step), "/")
    plain = F.when(whole.rlike(r"(^|/)\.{1,2}(/|$)"), plain).otherwise(whole)
    return (
        F.when(target.startswith("#") | (target == ""), None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .otherwise(F.concat(origin, plain, rest))
    )


def matching_rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, allow, rule); null if none does.

    A rule is host and path in one string. It fits its host and all subdomains where the path begins with
    the rule's; of rules equally long an allow comes first.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")
    table = F.array(
        *(
            F.struct(F.lit(len(r)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(r).alias("rule"), F.lit(r.partition("/")[0]).alias("h"), F.lit("/" + r.partition("/")[2]).alias("p"))
            for r, v in rules
        )
    )
    fits = F.filter(table, lambda r: ((h == r["h"]) | h.endswith(F.concat(F.lit("."), r["h"]))) & p.startswith(r["p"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"), r["rule"].alias("rule"))))


def rule_table(rules: DataFrame) -> DataFrame:
    """(h, p, allow, rule) of a table (rule, verdict): a rule is host and path in one string, up to its first slash the host."""
    r = F.col("rule").cast("string")
    rows = rules.select(F.regexp_extract(r, "(?s)^([^/]*)", 1).alias("h"), F.regexp_extract(r, "(?s)^[^/]*/?(.*)$", 1).alias("p"), (F.col("verdict") == "allow").alias("allow"), r.alias("rule"))
    return rows.where("rule is not null").select("h", F.concat(F.lit("/"), "p").alias("p"), "allow", "rule")


def fitting(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, own) of the distinct (host, path) that a rule of a table of any size fits; ``own`` as in ``matching_rule``.

    Every suffix of a host at a dot asks for the lengths of paths that rules have for it, and with each of these its path's beginning asks for the
    rule. Both are joins of equal keys; a place asks as often as its host has parts and these have lengths.
    """
    table = rule_table(rules)
    some = places.select("host", "path").where("host != ''").distinct()
    part = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size("part")), lambda i: F.array_join(F.slice("part", i, F.size("part") - i + 1), "."))
    asked = some.withColumn("part", part).select("host", "path", F.explode(F.array_distinct(suffix)).alias("h"))
    lengths = table.select("h", F.length("p").alias("n")).distinct()
    asked = asked.join(lengths, "h").where(F.col("n") <= F.length("path")).select("host", "path", "h", F.substring("path", F.lit(1), F.col("n")).alias("p"))
    best = F.struct(F.length("rule").alias("size"), F.col("allow"), F.col("rule"))
    return asked.join(table, ["h", "p"]).groupBy("host", "path").agg(F.max(best).alias("own"))


def _with_rule(rows: DataFrame, url: str, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds ``own``, the rule that fits the url's host and path; a list is tried as literals, a table is joined."""
    if not isinstance(rules, DataFrame):
        return rows.withColumn("own", matching_rule(host(F.col(url)), path(F.col(url)), rules))
    placed = rows.withColumns({"_h": host(F.col(url)), "_p": path(F.col(url))})
    found = fitting(placed.select(F.col("_h").alias("host"), F.col("_p").alias("path")), rules)
    found = found.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "own")
    return placed.join(found, ["_h", "_p"], "left").drop("_h", "_p")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, *, redirects: DataFrame | None = None, spellings: bool = True) -> DataFrame:
    """page_id, url, host, path, rule, verdict, component of every row.

    A page with a fitting rule has that rule's verdict. Any other is blocked if a page or link target of
    its component is blocked by a rule and none is explicitly allowed by one, and allowed otherwise. Edges lead from a page to the
    targets of all its canonical links and refresh redirects, absolute or relative, and from the first to the second
    column of ``redirects`` (absolute urls), where a crawl recorded some. Urls are one node if they differ in
    the fragment only, or, with ``spellings``, also in scheme or closing slashes; a query is part of the address.

    Null urls and urls without :// have empty host and path, no rule, no edges, and are allowed. Repeated rows and ids
    keep their rows; other columns are ignored. The html column may be missing or null. A hub that very many pages link to is an
    ordinary node: nothing is gathered by component but two flags. Only addresses with a link are nodes, numbered one by
    one, so no two share a number. A tag ends at its first >, and <base> is not read. ``rules`` is a list of (rule, verdict), which become literals of the plan and are each tried
    on each url, or for more than some hundreds a table of these columns, which is joined.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    url = F.col("url").cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"), address(url, spellings).alias("address"),
        F.when(html.rlike("(?i)canonical|http-equiv"), targets(html)).alias("targets"),
    )
    rows = scratch.save(_with_rule(rows, "url", rules))

    links = rows.where("host != ''").select("url", F.explode("targets").alias("to")).select("url", resolved(F.col("url"), F.col("to")).alias("to"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col(redirects.columns[0]).cast("string").alias("url"), F.col(redirects.columns[1]).cast("string").alias("to")))
    ends = address(F.col("url"), spellings).alias("a"), address(F.col("to"), spellings).alias("b")
    links = scratch.save(links.select("url", "to", *ends).where("a is not null and b is not null"))
    own = lambda c, at: _with_rule(links.select(c, at), c, rules).select(F.col(at).alias("address"), F.col("own.allow").alias("allow"))
    places = own("url", "a").unionByName(own("to", "b"))
    places = places.groupBy("address").agg(F.max("allow").alias("any_allow"), F.min("allow").alias("all_allow"))
    # a page's other spellings and repeats share its node, with their rules
    same = rows.where("own is not null").select("address", F.col("own.allow").alias("allow")).groupBy("address").agg(F.max("allow").alias("more"), F.min("allow").alias("less"))
    places = places.join(same, "address", "left").select(
        F.monotonically_increasing_id().alias("node"), "address", F.coalesce(F.greatest("any_allow", "more"), F.lit(False)).alias("any_allow"), (~F.coalesce(F.least("all_allow", "less"), F.lit(True))).alias("any_block")
    )
    places = scratch.save(places)
    number = lambda c, n: places.select(F.col("address").alias(c), F.col("node").alias(n))
    edges = links.select("a", "b").where("a != b").distinct().join(number("a", "x"), "a").join(number("b", "y"), "b").select("x", "y")
    comp = scratch.save(components(edges, scratch))
    placed = places.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    decided = placed.groupBy("component").agg(F.max("any_allow").alias("any_allow"), F.max("any_block").alias("any_block"))
    decided = decided.select("component", (F.col("any_block") & ~F.col("any_allow")).alias("blocked"))
    placed = scratch.save(placed.select("address", "component").join(decided, "component"))
    scratch.keep(rows, placed)
    # pages that share an address without a link are one node, too
    if spellings:
        alone = same.join(placed, "address", "left_anti").select("address", (~F.col("less") & ~F.col("more")).alias("blocked"), F.lit(None).cast("long").alias("component"))
        placed = placed.unionByName(alone)
    out = rows.where("address is not null").join(placed, "address", "left")
    nowhere = {f.name: F.lit(None).cast(f.dataType) for f in out.schema.fields if f.name not in rows.columns}
    out = out.unionByName(rows.where("address is null").withColumns(nowhere))  # so that they don't meet in one task
    verdict = F.when(F.col("own").isNotNull(), F.when(F.col("own.allow"), "allow").otherwise("block")).when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")
