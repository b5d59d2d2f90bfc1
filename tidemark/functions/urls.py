"""URL functions as Column expressions: host, site, canonical form, pagination, policy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that name a campaign or a click, never a document.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader", "utm_name", "fbclid", "gclid", "gclsrc",
    "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "twclid", "ttclid", "yclid", "_ga", "ref_src", "ref_url",
]
# Query keys that carry a page number, and those that carry an offset.
PAGE_KEYS = ["page", "p", "pg"]
OFFSET_KEYS = ["start", "offset", "from", "skip"]


def host(url: Column) -> Column:
    """Lower-cased host without user, port or bracketed leftovers; '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def domain(url: Column) -> Column:
    """The host less one leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Equal, or one a subdomain of the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalize(url: Column) -> Column:
    """Canonical http(s) URL: no fragment, default port or tracking parameters, query sorted; else null.

    Parameters keep their spelling: they are compared as written, so no decoding round trip is needed.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    where = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(scheme.isin("http", "https") & (authority != ""), F.concat(scheme, F.lit("://"), authority, where, tail))


def result_key(url: Column) -> Column:
    """Identity of a search result: the canonical form without a slash before its query or end."""
    return F.regexp_replace(normalize(url), r"/(\?|$)", "$1")


def unwrap_redirect(url: Column) -> Column:
    """Target of a click URL (``uddg``, base64url ``u=a1...``, ``url``) if it is http(s), else the URL."""
    def param(key: str) -> Column:
        return F.regexp_extract(query(url), rf"(?:^|&){key}=([^&]*)", 1)

    b64 = F.translate(F.substring(param("u"), 3, 10_000), "-_", "+/")
    padded = F.rpad(b64, (F.ceil(F.length(b64) / 4) * 4).cast("int"), F.lit("="))
    coded = F.when(F.contains(path(url), F.lit("/ck/a")) & param("u").startswith("a1"), F.try_to_binary(padded, F.lit("base64")).cast("string"))
    found = F.coalesce(F.when(param("uddg") != "", F.try_url_decode(param("uddg"))), coded, F.when(param("url") != "", F.try_url_decode(param("url"))))
    found = F.when(found.startswith("//"), F.concat(F.lit("https:"), found)).otherwise(found)
    return F.when(found.rlike("^https?://"), found).otherwise(url)


def page_number(url: Column) -> Column:
    """struct<kind,key,n>: a page or offset key of the query with an integer value, else /page/N; or null."""
    keys = "|".join(PAGE_KEYS + OFFSET_KEYS)
    pattern = rf"(?:^|&)({keys})=([0-9]{{1,9}})(?:&|$)"
    by_query = F.when(F.regexp_extract(query(url), pattern, 1) != "", F.struct(F.lit("query").alias("kind"), F.regexp_extract(query(url), pattern, 1).alias("key"), F.regexp_extract(query(url), pattern, 2).cast("long").alias("n")))
    by_path = r"/(page)/([0-9]{1,9})/?$"
    return F.coalesce(by_query, F.when(F.regexp_extract(path(url), by_path, 1) != "", F.struct(F.lit("path").alias("kind"), F.lit("page").alias("key"), F.regexp_extract(path(url), by_path, 2).cast("long").alias("n"))))


def next_page(url: Column) -> Column:
    """URL of the following page: numbers go up by one, offsets double (from 0 there is no telling: null)."""
    at = page_number(url)
    offset = at["key"].isin(OFFSET_KEYS)
    n = F.when(~offset, at["n"] + 1).when(at["n"] > 0, at["n"] * 2).cast("string")
    by_query = F.regexp_replace(url, F.concat(F.lit(r"([?&]"), at["key"], F.lit(r"=)[0-9]+")), F.concat(F.lit("$1"), n))
    by_path = F.regexp_replace(url, F.lit(r"(/page/)[0-9]+"), F.concat(F.lit("$1"), n))
    return F.when(n.isNotNull(), F.when(at["kind"] == "query", by_query).otherwise(by_path))


def is_root(p: Column) -> Column:
    return p.isin("", "/", "/index.html")


def is_deep(p: Column) -> Column:
    """More than one segment, or a long one."""
    inner = F.regexp_replace(p, "^/|/$", "")
    return F.contains(inner, F.lit("/")) | (F.length(inner) > 12)


def parent_suffixes(h: Column) -> Column:
    """The host and its parent domains that keep a dot: a.b.c gives a.b.c, b.c."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def blocked_hosts(rows: DataFrame, rules: DataFrame, url_col: str, key: str) -> DataFrame:
    """Rows whose host or a parent of it is listed (``rules.host``): a semi-join on host suffixes."""
    suffix = rows.select(key, F.explode(parent_suffixes(domain(F.col(url_col)))).alias("host"))
    return rows.join(suffix.join(rules, "host", "left_semi").select(key).distinct(), key, "left_semi")


def longest_route(rows: DataFrame, routes: DataFrame, host_col: str, key: str) -> DataFrame:
    """(key, route) by the longest listed suffix of the host, or null."""
    s = rows.select(key, F.explode_outer(parent_suffixes(F.col(host_col))).alias("suffix"))
    hit = s.join(routes.select(F.col("host").alias("suffix"), "route"), "suffix", "left")
    return hit.groupBy(key).agg(F.max_by("route", F.when(F.col("route").isNotNull(), F.length("suffix"))).alias("route"))


def url_shape(url: Column) -> Column:
    """Digit runs as ``#``: URLs of one endpoint share a shape."""
    return F.regexp_replace(url, "[0-9]+", "#")


def private_host(h: Column) -> Column:
    return h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[?::1)") | h.endswith(".local")


def origin_policy(url: Column, block: list[str], allow: list[str]) -> Column:
    """'blocked', 'private', 'not_listed' or 'ok'; block rules come first, then addresses, then the list."""
    h = domain(url)

    def under(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (h == n) | h.endswith("." + n)
        return out

    return F.when(under(block), "blocked").when(private_host(h), "private").when(F.lit(bool(allow)) & ~under(allow), "not_listed").otherwise("ok")


# Hosts and paths, and parameters, that carry a referral.
AFFILIATE_ENDPOINTS = [
    "amzn.to", "s.click.aliexpress.com", "awin1.com", "anrdoezrs.net", "dpbolvw.net", "jdoqocy.com", "kqzyfj.com", "tkqlhce.com", "tqlkg.com", "hop.clickbank.net", "rover.ebay.com", "ebay.us", "flexlinks.com", "fxo.co",
    "refersion.com", "shareasale.com", "go.redirectingat.com", "shop-links.co", "go.skimresources.com",
]
AFFILIATE_PARAMS = ["aff_id=", "affiliate_id=", "aff_platform=", "utm_medium=affiliate", "irclickid=", "ranmid=", "siteid="]
# Marks of a search engine's own links.
AD_MARKS = ["duckduckgo.com/y.js", "duckduckgo.com/duckduckgo-help-pages", "bing.com/aclick", "ad_domain="]
AD_START = "https://duckduckgo.com/?"


def _any_of(x: Column, marks: list[str]) -> Column:
    return x.rlike("|".join(re.escape(m) for m in marks))


def is_affiliate(url: Column) -> Column:
    """Whether a link carries a referral: a known endpoint or parameter, or a tag on the retailer's host."""
    low = F.lower(url)
    return _any_of(low, AFFILIATE_ENDPOINTS + AFFILIATE_PARAMS) | (F.contains(low, F.lit("amazon.")) & low.rlike("[?&]tag="))


def is_ad(url: Column) -> Column:
    """Whether a link of a result page is the engine's own advertising."""
    return _any_of(url, AD_MARKS) | url.startswith(AD_START)


def block_patterns(rules: DataFrame, domain_col: str, most: int) -> DataFrame:
    """(place, pattern): two browser patterns for each of the ``most`` broadest domains: fewest labels, then shortest,
    then by name. ``most`` is what a browser takes."""
    labels = F.length(domain_col) - F.length(F.replace(domain_col, F.lit("."), F.lit("")))
    d = F.col(domain_col)
    top = rules.select(d).distinct().orderBy(labels, F.length(d), d).limit(most)
    both = F.array(F.concat(F.lit("*://"), d, F.lit("/*")), F.concat(F.lit("*://*."), d, F.lit("/*")))
    return top.select(d, F.posexplode(both).alias("place", "pattern"))


def path_prefixes(p: Column) -> Column:
    """Every directory of a path, from ``/`` to the path itself without a last slash."""
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.concat(F.array(F.lit("/")), F.transform(parts, lambda x, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))))


def alt_svc(header: Column) -> Column:
    """struct<port, max_age> of the first HTTP/3 alternative, drafts too; null for none or ``clear``.
    Without a port it is 443, without an age a day."""
    found = F.regexp_extract(header, r"(?i)(?:^|,)\s*(h3(?:-[^=,;]*)?=[^,]*)", 1)
    port, age = F.regexp_extract(found, r'^[^;]*:([0-9]{1,5})"?\s*(?:;|$)', 1), F.regexp_extract(found, r";\s*ma=\s*([0-9]+)", 1)
    return F.when(found != "", F.struct(F.coalesce(port.try_cast("int"), F.lit(443)).alias("port"), F.coalesce(age.try_cast("long"), F.lit(86400)).cast("long").alias("max_age")))
