"""URL functions as column expressions: nothing here leaves the JVM.

All take absolute http(s) URLs (``resolve`` makes them absolute); anything else
gives null, as an invalid URL does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values); those that begin with utm_ are dropped as well.
TRACKING = ["dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "ref_src", "igshid"]
MATCH_TRACKING = [*TRACKING, "ref", "source"]
#: Hosts of submission platforms and networks (fixed values).
PLATFORM_HOSTS = [
    "filmfreeway.com", "festhome.com", "shortfilmdepot.com", "clickforfestivals.com", "movibeta.com", "submittable.com",
    "eventival.com", "filmfestplatform.com", "forms.gle", "docs.google.com", "formstack.com", "smapply.org", "wixsite.com",
    "facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com", "linkedin.com", "tiktok.com", "wikipedia.org", "web.archive.org",
]
BLOCKED_HOSTS = ["filmfreeway.com"]
PARTS = r"(?i)^\s*(https?)://(?:[^/?#@\s]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\s]+)(?::([0-9]+))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query; an empty string if missing."""
    return F.regexp_extract(F.trim(url), PARTS, i)


def raw_host(url: Column) -> Column:
    """The lower-cased host, null for what is no http(s) URL."""
    h = F.regexp_replace(F.lower(part(url, 2)), r"\.$", "")
    return F.when(h != "", h)


def host(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(raw_host(url), r"^www\.", "")


def base_domain(h: Column) -> Column:
    """About the registrable domain of a host: three labels if the last has two letters and the one before at most three."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    second = F.when(n > 1, F.element_at(labels, -2))
    keep = F.when((F.length(F.element_at(labels, -1)) == 2) & (F.length(second) <= 3), 3).otherwise(2)
    return F.when(h.isNotNull() & (h != ""), F.array_join(F.slice(labels, F.greatest(F.lit(1), n - keep + 1), keep), "."))


def host_in(h: Column, hosts: list[str]) -> Column:
    """The host is one of the list or below one."""
    out = F.lit(False)
    for x in hosts:
        out |= (h == x) | h.endswith(f".{x}")
    return F.coalesce(out, F.lit(False))


def is_platform(h: Column) -> Column:
    return host_in(h, PLATFORM_HOSTS)


def is_private(h: Column) -> Column:
    """Loopback, private and link-local addresses, and localhost."""
    v4 = h.rlike(r"^(?:10|127|0)\.\d{1,3}\.\d{1,3}\.\d{1,3}$|^169\.254\.\d{1,3}\.\d{1,3}$|^192\.168\.\d{1,3}\.\d{1,3}$|^172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}$")
    return v4 | (h == "localhost") | h.endswith(".localhost") | h.rlike(r"^\[(?:::1\]|f[cd]|fe80:)")


def _query(url: Column, tracking: list[str], utm: bool) -> Column:
    """The sorted query without tracking parameters, with its question mark."""
    pairs = F.filter(F.split(part(url, 5), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.split(p, "=", 2)[0])
    kept = F.filter(pairs, lambda p: ~name(p).isin(tracking) & ~(name(p).startswith("utm_") if utm else F.lit(False)))
    text = F.array_join(F.array_sort(kept), "&")
    return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")


def _port(url: Column) -> Column:
    p, scheme = part(url, 3), F.lower(part(url, 1))
    default = F.when(scheme == "https", "443").otherwise("80")
    return F.when((p == "") | (p == default), "").otherwise(F.concat(F.lit(":"), p))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, without default port, fragment, tracking parameters and doubled slashes; parameters sorted; null if private or no http(s)."""
    h = raw_host(url)
    path = F.regexp_replace(part(url, 4), "/{2,}", "/")
    path = F.when(path == "", "/").otherwise(path)
    out = F.concat(F.lower(part(url, 1)), F.lit("://"), h, _port(url), path, _query(url, TRACKING, True))
    return F.when(h.isNotNull() & ~is_private(h), out)


def match_key(text: Column) -> Column:
    """For matching: host without www, path without index page and last slash, sorted query; taken from the first URL in a text."""
    url = F.regexp_replace(F.regexp_extract(text, r"(?i)https?://[^\s<>\"'`]+", 0), r"[),.;\]}]+$", "")
    path = F.regexp_replace(F.regexp_replace(part(url, 4), "/{2,}", "/"), r"(?i)/index\.(?:html?|php)$", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    h = host(url)
    out = F.concat(h, _port(url), F.when(path == "", "/").otherwise(path), _query(url, [*MATCH_TRACKING, "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"], False))
    return F.when(h.isNotNull(), out)


def origin(url: Column) -> Column:
    """The root of a URL's site."""
    return F.when(raw_host(url).isNotNull(), F.concat(F.lower(part(url, 1)), F.lit("://"), raw_host(url), _port(url), F.lit("/")))


def resolve(href: Column, base: Column) -> Column:
    """An href against its page: absolute, scheme-relative, root-relative or relative to the page's folder; null for other schemes."""
    h = F.trim(href)
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(part(base, 4), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    page = F.concat(root, F.when(part(base, 4) == "", "/").otherwise(part(base, 4)))
    return (
        F.when(h.rlike("(?i)^https?://"), h)
        .when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(h.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(page, h))
        .when((h == "") | h.startswith("#"), base)
        .otherwise(F.concat(root, folder, h))
    )


def is_root(url: Column) -> Column:
    """The site's root or that of a language, or an index page."""
    return F.coalesce(part(url, 4).rlike(r"(?i)^/?(?:[a-z]{2}(?:-[a-z]{2})?/?)?(?:(?:index|home)(?:\.(?:html?|php))?/?)?$") & (part(url, 1) != ""), F.lit(False))


def path(url: Column) -> Column:
    return F.when(raw_host(url).isNotNull(), F.when(part(url, 4) == "", "/").otherwise(part(url, 4)))


def grounded(url: Column, seen: Column) -> Column:
    """The URL is among those seen, whatever the last slash."""
    bare = lambda u: F.regexp_replace(u, "/+$", "")
    return F.coalesce(F.array_contains(F.transform(seen, bare), bare(url)), F.lit(False))


def safe(url: Column) -> Column:
    """An http(s) URL without credentials, without its fragment."""
    u = F.trim(url)
    ok = u.rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#]|$)")
    return F.when(ok, F.regexp_replace(u, "#.*$", ""))


def next_request(url: Column, param: str, value: Column) -> Column:
    """The URL with ``{param}`` filled in, else with the parameter set."""
    text = F.url_encode(value.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(url, f"([?&]){param}=[^&#]*&?", "$1"), "[?&]$", "")
    added = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit(f"{param}="), text)
    return F.when(url.contains("{" + param + "}"), F.replace(url, F.lit("{" + param + "}"), text)).otherwise(added)
