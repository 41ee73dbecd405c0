"""URL functions as columns, and resolution of links for Python code."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def clean_seed(seed: Column) -> Column:
    """A trimmed seed with a scheme."""
    t = F.regexp_replace(seed, r"^\s+|\s+$", "")
    return F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def domain(url: Column) -> Column:
    """The host unless it is an address; null for those and for URLs without a host."""
    h = host(url)
    return F.when((h != "") & ~h.rlike(r"^(\[.*\]|\d+(\.\d+){3})$"), h)


def path(url: Column) -> Column:
    """The path of a URL with a host, "/" if it is empty."""
    p = F.regexp_extract(url, _PATH, 1)
    return F.when(p == "", "/").otherwise(p)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def segments(url: Column) -> Column:
    """The non-empty segments of the path; ["/"] where there is no host."""
    found = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return F.when(url.rlike(_AUTHORITY), found).otherwise(F.array(F.lit("/")))


def catalogue(url: Column) -> Column:
    """The folder a URL stands in: its parent folder, or itself if it is a folder; no query or fragment."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    bare = F.when(bare.rlike(r"^[^/]+//[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(bare)
    own = segments(bare)
    last = F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit(""))
    parent = F.regexp_replace(bare, r"[^/]*$", "")
    inside = F.when(last.contains(".") | (F.size(own) > 1), parent).otherwise(F.concat(bare, F.lit("/")))
    return F.when(~url.rlike(_AUTHORITY), F.lit(None)).when(bare.endswith("/"), bare).otherwise(inside)


def slug(url: Column) -> Column:
    """A file name for a page: its last segment without extension, other than letters, digits, - and _ as -."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    named = F.regexp_replace(stem, r"[^\p{IsAlphabetic}\p{N}\-_]", "-")
    named = F.translate(named, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    unparsed = F.concat(F.lit("page_"), F.hex(F.xxhash64(url)))
    return F.when(~url.rlike(_AUTHORITY), unparsed).when(named == "", "index").otherwise(named)


def extension(url: Column, default: str = "png") -> Column:
    last = F.regexp_extract(path(url), "([^/]*)$", 1)
    found = F.regexp_extract(last, r"\.([^.]+)$", 1)
    return F.when(found == "", default).otherwise(found)


# Links seen from a page, as columns.

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?:(//)([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_SPECIAL = ("http", "https", "ftp")
#: Characters besides letters and digits that stay as they are, by the part of a URL.
_PLAIN_PATH, _PLAIN_QUERY, _PLAIN_FRAGMENT, _PLAIN_OTHER = "!$%&'()*+,./:;=@[\\]^_|~-", "!$%&()*+,./:;=?@[\\]^_`{|}~-", "!$%&'()*+,./:;=?@[\\]^_{|}~#-", " !\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~-"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, where a lambda leaves no room for a column of its own."""
    return F.get(F.transform(F.array(value), body), 0)


def _parts(url: Column) -> Column:
    names = ("scheme", "mark", "site", "path", "query", "fragment")
    return F.struct(*(F.regexp_extract(url, _PARTS, k + 1).alias(n) for k, n in enumerate(names)))


def escaped(value: Column, plain: str) -> Column:
    """Other characters than letters, digits and these percent-encoded as UTF-8."""
    safe = "A-Za-z0-9" + "".join("\\" + c for c in plain)

    def piece(p: Column) -> Column:
        return F.when(p.rlike(f"^[^{safe}]"), F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")).otherwise(p)

    def whole(v: Column) -> Column:
        pieces = F.regexp_extract_all(v, F.lit(f"[{safe}]++|[^{safe}]++"), F.lit(0))
        return F.when(v.rlike(f"[^{safe}]"), F.array_join(F.transform(pieces, piece), "")).otherwise(v)

    return let(value, whole)


def without_dots(path: Column) -> Column:
    """A path that starts with / without its . and .. segments."""

    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    def whole(p: Column) -> Column:
        parts = F.slice(F.split(p, "/"), F.lit(2), F.length(p) + 1)
        last = F.when(p.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        kept = F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), last)
        return F.when(p.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(p)

    return let(path, whole)


def _written(t: Column) -> Column:
    """The URL of resolved parts, or null where browsers refuse it."""
    usual = F.when(t["scheme"] == "http", 80).when(t["scheme"] == "https", 443).when(t["scheme"] == "ftp", 21).otherwise(-1)
    number = F.when(t["port"].rlike("^[0-9]{1,9}$"), t["port"].cast("int"))
    shown = F.when((t["port"] == "") | (number == usual), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    fault = (t["scheme"] == "") | ((t["name"] == "") & t["scheme"].isin(*_SPECIAL)) | ((t["port"] != "") & (number.isNull() | (number > 65535)))
    tail = F.when(t["fragment"].isin("", "#"), "").otherwise(escaped(t["fragment"], _PLAIN_FRAGMENT))
    whole = F.concat(t["scheme"], F.lit("://"), t["user"], t["name"], shown, escaped(without_dots(t["path"]), _PLAIN_PATH), escaped(t["query"], _PLAIN_QUERY), tail)
    return F.when(~fault, whole)


def _target(b: Column, u: Column) -> Column:
    """The parts of a link u seen from a page b."""
    whole = ((u["scheme"] != "") & (F.lower(u["scheme"]) != F.lower(b["scheme"]))) | (u["mark"] != "")
    folder = F.regexp_replace(F.regexp_replace(b["path"], "^$", "/"), "[^/]*$", "")
    way = F.when(whole | u["path"].startswith("/"), u["path"]).when(u["path"] == "", b["path"]).otherwise(F.concat(folder, u["path"]))
    asked = F.when(~whole & (u["path"] == "") & (u["query"] == ""), b["query"]).otherwise(u["query"])
    site = F.when(whole, u["site"]).otherwise(b["site"])
    place = F.regexp_replace(site, "^.*@", "")
    return F.struct(
        F.lower(F.when((~whole | (u["scheme"] == "")) & (b["mark"] == ""), "").when(u["scheme"] != "", u["scheme"]).otherwise(b["scheme"])).alias("scheme"),
        F.regexp_extract(site, "^(.*@)", 1).alias("user"),
        F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)).alias("name"),
        F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1).alias("port"),
        F.regexp_replace(way, "^$", "/").alias("path"), asked.alias("query"), u["fragment"].alias("fragment"),
    )


def resolved(base: Column, reference: Column) -> Column:
    """A link's target seen from the page at `base`, in the form browsers write it; null where they refuse it.

    Host names that are not ASCII are left as they are written (lower case), not turned into Punycode.
    """

    def link(r: Column) -> Column:
        own = F.lower(F.regexp_extract(r, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        rest = F.substring(r, F.length(own) + 2, F.length(r))
        special = (own == "") | own.isin(*_SPECIAL)
        opaque = F.concat(own, F.lit(":"), escaped(rest, _PLAIN_OTHER))
        slashes = F.regexp_replace(F.translate(r, "\\", "/"), r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//+", "$1//")
        u = _parts(F.when(special, slashes).otherwise(r))
        seen = let(F.struct(_parts(F.coalesce(base, F.lit(""))).alias("b"), u.alias("u")), lambda p: let(_target(p["b"], p["u"]), _written))
        return F.when(~special & ~rest.startswith("//"), opaque).otherwise(seen)

    trimmed = F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return let(trimmed, link)


# For Python code in Arrow batches.

_DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def normalise(url: str) -> str | None:
    """A URL in the form browsers write it, or None where they refuse it."""
    try:
        parts = urllib.parse.urlsplit(url)
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if not scheme:
        return None
    if scheme not in _DEFAULT_PORTS and not parts.netloc:
        # mailto:, tel:, javascript: and such keep what follows; only controls and non-ASCII are escaped.
        return scheme + ":" + urllib.parse.quote(url[len(parts.scheme) + 1 :], safe=" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    name = (parts.hostname or "").lower()
    if scheme in _DEFAULT_PORTS and not name:
        return None
    try:
        name = name.encode("ascii").decode() if name.isascii() else name.encode("idna").decode()
    except UnicodeError:
        return None
    user = parts.netloc.rpartition("@")[0]
    host_part = (f"{user}@" if user else "") + (f"[{name}]" if ":" in name else name)
    if port is not None and port != _DEFAULT_PORTS.get(scheme):
        host_part += f":{port}"
    clean = urllib.parse.quote(parts.path, safe="!$%&'()*+,-./:;=@[\\]^_|~") or "/"
    query = "?" + urllib.parse.quote(parts.query, safe="!$%&()*+,-./:;=?@[\\]^_`{|}~") if parts.query or url.split("#")[0].endswith("?") else ""
    fragment = "#" + urllib.parse.quote(parts.fragment, safe="!$%&'()*+,-./:;=?@[\\]^_{|}~#") if parts.fragment else ""
    return f"{scheme}://{host_part}{clean}{query}{fragment}"


def resolve(base: str, reference: str) -> str | None:
    """A link's target, seen from the page at `base`."""
    trimmed = re.sub(r"[\t\n\r]", "", reference.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0b\x0c\r\x0e\x0f \x1f"))
    if _SCHEME.match(trimmed) and not trimmed.lower().startswith(("http:", "https:", "ftp:")):
        return normalise(trimmed)
    try:
        return normalise(urllib.parse.urljoin(base, trimmed.replace("\\", "/")))
    except ValueError:
        return None


def drop_fragment(url: str) -> str:
    return url.split("#", 1)[0]
