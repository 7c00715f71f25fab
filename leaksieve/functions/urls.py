"""URL columns: parts, resolution against a page, and what to leave out."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from unicodedata import normalize
from urllib.parse import uses_params, uses_relative

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaksieve.rules.model import quote

# Hosts whose links are left out, wherever the name stands in the host.
CDN_HOSTS = (
    "cdnjs.cloudflare.com", "unpkg.com", "jsdelivr.net",
    "code.jquery.com", "cdn.jsdelivr.net", "stackpath.bootstrapcdn.com",
    "cdn.skypack.dev", "esm.sh", "cdn.esm.sh", "jspm.dev",
    "fonts.googleapis.com", "fonts.gstatic.com", "ajax.googleapis.com",
    "maps.googleapis.com", "www.google-analytics.com",
    "www.googletagmanager.com", "www.gstatic.com",
    "cdn.rawgit.com", "raw.githubusercontent.com",
)

# Endings of a URL path that mark a file.
FILE_ENDINGS = (
    ".js", ".ts", ".jsx", ".tsx", ".json", ".xml", ".html", ".htm",
    ".css", ".scss", ".sass", ".less", ".txt", ".md", ".yaml", ".yml",
    ".vue", ".svelte", ".astro", ".php", ".asp", ".aspx", ".jsp",
    ".env", ".env.local", ".env.production", ".env.development",
    ".config", ".conf", ".ini", ".toml", ".properties", ".lock",
    ".lockfile", ".gitignore", ".dockerignore", ".editorconfig",
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "Pipfile", "poetry.lock", "Cargo.toml",
    "composer.json", "Gemfile", "pom.xml", "build.gradle",
    "go.mod", "pubspec.yaml", "mix.exs",
    ".travis.yml", ".gitlab-ci.yml", ".github/workflows/*.yml",
    ".jenkins", ".jenkinsfile", ".circleci/config.yml",
    ".rst", ".adoc", ".tex", ".latex", ".doc", ".docx", ".pdf",
    ".swagger", ".openapi", ".graphql", ".gql", ".wsdl", ".xsd",
    ".pem", ".key", ".crt", ".cer", ".p12", ".pfx",
    ".htaccess", ".htpasswd", ".htgroup", ".htdigest",
    ".log", ".out", ".err", ".debug", ".trace", ".profile",
    ".map", ".min.js", ".min.css", ".bundle.js", ".chunk.js",
    ".manifest", ".webmanifest", ".service-worker.js",
    ".csv", ".tsv", ".xls", ".xlsx", ".ods", ".sql", ".db",
    ".bak", ".backup", ".old", ".orig", ".tmp", ".temp",
    ".cache", ".session", ".cookie", ".localstorage",
)

# Last path parts that are files whatever their ending.
FILE_NAMES = (
    "robots.txt", "sitemap.xml", "favicon.ico", "manifest.json",
    "sw.js", "service-worker.js", "webmanifest",
)

FILE_ENDING_REGEX = "(?:" + "|".join(quote(e.lower()) for e in FILE_ENDINGS) + r")\z"
CDN_REGEX = "|".join(quote(host) for host in CDN_HOSTS)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc_of(url: Column) -> Column:
    """Everything between ``//`` and the path, port and user included."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*\z", "")


def file_name_of(url: Column) -> Column:
    return F.substring_index(path_of(url), "/", -1)


def is_file_url(url: Column) -> Column:
    path = F.lower(path_of(url))
    return path.rlike(FILE_ENDING_REGEX) | F.substring_index(path, "/", -1).isin(*FILE_NAMES)


def is_left_out(url: Column) -> Column:
    """Links to a CDN host and links that are not http(s)."""
    return netloc_of(url).rlike(CDN_REGEX) | ~scheme_of(url).isin("http", "https")


_CLEAN_BASE = r"^https?://[\p{ASCII}&&[^/?#\s\[\]]]+(?:[/?#]|\z)"
_CLEAN_URL = r"^https?://[\p{ASCII}&&[^/?#;\s\[\]\p{Cntrl}]]+(?:/[^?#;\s\p{Cntrl}]*)?(?:\?[^#\s\p{Cntrl}]+)?(?:#[^\s\p{Cntrl}]+)?\z"
_CLEAN_ROOT = r"^/(?!/)[^?#;\s\p{Cntrl}]*(?:\?[^#\s\p{Cntrl}]+)?(?:#[^\s\p{Cntrl}]+)?\z"
_DOTS = r"^[^?#]*/\.\.?(?:[/?#]|\z)"


def resolve(base: Column, link: Column) -> Column:
    """``link`` as seen from the page at ``base``, as Python's ``urljoin`` has it; null where it is no URL.

    Plain absolute links and plain rooted paths take a short way; the others are cut into
    parts and put together again. All of it runs in the JVM. A path of n segments
    with dots among them costs up to n * n / 2 copied references.
    """
    rooted = link.rlike(_CLEAN_ROOT) & ~link.rlike(_DOTS) & base.rlike(_CLEAN_BASE)
    site = F.regexp_extract(base, r"^https?://[^/?#]+", 0)
    other = _bound(_parts(base, F.lit("")), lambda page: _bound(_parts(link, page["scheme"]), lambda to: _joined(page, to, link)))
    return (
        F.when(link.rlike(_CLEAN_URL), link)
        .when(rooted, F.concat(site, link))
        .when(base.isNull() | link.isNull(), F.lit(None))
        .when(base == "", link)
        .when(link == "", base)
        .otherwise(other)
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _parts(url: Column, scheme: Column) -> Column:
    """Scheme (or the given one), netloc, path, parameters, query and fragment of a URL."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def tail_of(url: Column) -> Column:
        rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
        return F.struct(
            F.coalesce(F.nullif(scheme_of(url), F.lit("")), scheme).alias("scheme"),
            F.regexp_extract(rest, r"^//([^/?#]*)", 1).alias("netloc"),
            F.regexp_replace(rest, r"^//[^/?#]*", "").alias("tail"),
        )

    def cut(url: Column) -> Column:
        path = F.regexp_extract(url["tail"], r"^[^?#]*", 0)
        has_params = url["scheme"].isin(*uses_params)
        return F.struct(
            url["scheme"].alias("scheme"),
            url["netloc"].alias("netloc"),
            F.when(has_params, F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path).alias("path"),
            F.when(has_params, F.regexp_extract(path, r";([^/]*)\z", 1)).otherwise(F.lit("")).alias("params"),
            F.regexp_extract(url["tail"], r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(url["tail"], r"(?s)#(.*)\z", 1).alias("fragment"),
        )

    return _bound(_bound(plain, tail_of), cut)


def _joined(page: Column, to: Column, link: Column) -> Column:
    foreign = (to["scheme"] != page["scheme"]) | ~to["scheme"].isin(*uses_relative)
    same_page = (to["path"] == "") & (to["params"] == "")
    away = to["netloc"] != ""

    def choose(name: str, otherwise: Column) -> Column:
        return F.when(~away & same_page, page[name]).when(away, to[name]).otherwise(otherwise).alias(name)

    whole = F.struct(
        F.when(away, to["netloc"]).otherwise(page["netloc"]).alias("netloc"),
        choose("path", _walked(page["path"], to["path"])),
        choose("params", to["params"]),
        F.when(~away & same_page & (to["query"] == ""), page["query"]).otherwise(to["query"]).alias("query"),
    )

    def written(url: Column) -> Column:
        path = F.concat(url["path"], _after(";", url["params"]))
        slashed = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        bare = path.startswith("//") | ((to["scheme"] != "") & ((path == "") | path.startswith("/")))
        located = F.when(url["netloc"] != "", F.concat(F.lit("//"), url["netloc"], slashed)).otherwise(
            F.when(bare, F.concat(F.lit("//"), path)).otherwise(path)
        )
        scheme = F.when(to["scheme"] == "", "").otherwise(F.concat(to["scheme"], F.lit(":")))
        return F.concat(scheme, located, _after("?", url["query"]), _after("#", to["fragment"]))

    valid = _is_netloc(page["netloc"]) & _is_netloc(to["netloc"])
    return F.when(valid, F.when(foreign, link).otherwise(_bound(whole, written)))


def _after(mark: str, text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit(mark), text))


def _walked(page: Column, path: Column) -> Column:
    """A path that is not empty, seen from the page's: a stack of segments, popped by ``..``."""
    steps = F.split(path, "/")
    # The page's last segment is its name; without a path there is one empty segment.
    folders = F.when(page == "", F.array(F.lit(""))).otherwise(F.split(F.regexp_replace(page, r"[^/]*\z", ""), "/"))
    named = (page != "") & ~page.endswith("/")
    folders = F.when(named, F.slice(folders, 1, F.size(folders) - 1)).otherwise(folders)

    def inner_filled(segments: Column) -> Column:
        return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == F.size(segments) - 1))

    segments = F.when(path.startswith("/"), steps).otherwise(_bound(F.concat(folders, steps), inner_filled))

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    def walk(segments: Column) -> Column:
        dotted = F.arrays_overlap(segments, F.array(F.lit("."), F.lit("..")))
        stack = F.aggregate(segments, F.array().cast("array<string>"), step)
        ends_in_folder = F.element_at(segments, -1).isin(".", "..")
        stack = F.when(ends_in_folder, F.concat(stack, F.array(F.lit("")))).otherwise(stack)
        return F.array_join(F.when(dotted, stack).otherwise(segments), "/")

    return F.coalesce(F.nullif(_bound(segments, walk), F.lit("")), F.lit("/"))


def _address_regex() -> str:
    """What may stand between the brackets of a host: an IPv6 address, with a zone or without, or one of a later version."""
    group, byte = "[0-9A-Fa-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = rf"{byte}(?:\.{byte}){{3}}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{v4}"]
    for left in range(8):
        start = f"{group}(?::{group}){{{left - 1}}}::" if left else "::"
        forms.append(start + (f"(?:{group}(?::{group}){{0,{6 - left}}})?" if left < 7 else ""))
        if left < 6:
            forms.append(start + f"(?:{group}:){{0,{5 - left}}}{v4}")
    return rf"(?s)^(?:(?:{'|'.join(forms)})(?:%[^%]+)?|v[0-9A-Fa-f]+\.[^\n]+)\z"


@cache
def _split_marks() -> str:
    """Letters that become one of ``/?#@:`` when a host is normalised."""
    return "".join(c for c in map(chr, range(0x80, 0x110000)) if set(normalize("NFKC", c)) & set("/?#@:"))


def _is_netloc(netloc: Column) -> Column:
    opened, closed = netloc.contains("["), netloc.contains("]")
    # What follows the first "[", up to the next "]" or to the end.
    address = F.regexp_extract(netloc, r"^[^\[]*\[([^\]]*)", 1)
    bracketed = F.when(opened & closed, address.rlike(_address_regex())).otherwise(opened == closed)
    return bracketed & ~netloc.rlike(f"[{_split_marks()}]")
