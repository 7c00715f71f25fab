"""Links of stored pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.text import fold_case
from leaksieve.functions.urls import is_file_url, is_left_out, resolve


# The link regexes, in order.  Case is ignored.
LINK_REGEXES = (
    r"src=[\"']([^\"']*\.(?:js|ts|jsx|tsx|json|xml|html|htm|css|scss|sass|less|txt|md|yaml|yml|vue|svelte|astro|php|asp|aspx|jsp)[^\"']*)[\"']",
    r"href=[\"']([^\"']*\.(?:css|html|htm|xml|pdf|doc|docx)[^\"']*)[\"']",
    r"url\([\"']?([^\"')\s]+\.(?:js|css|json|xml|ya?ml|png|jpe?g|gif|svg|ico|woff2?|ttf|eot)(\?[^\"')\s]*)?)[\"']?\)",
    r"[\"']([^\"']*\.(?:env|config|conf|ini|toml|properties|lock|lockfile|gitignore|dockerignore|editorconfig)[^\"']*)[\"']",
    r"[\"']([^\"']*(?:package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|requirements\.txt|Pipfile|poetry\.lock|Cargo\.toml|composer\.json|Gemfile|pom\.xml|build\.gradle|go\.mod|pubspec\.yaml|mix\.exs)[^\"']*)[\"']",
    r"[\"']([^\"']*\.(?:travis\.yml|gitlab-ci\.yml|jenkins|jenkinsfile|circleci/config\.yml)[^\"']*)[\"']",
    r"[\"']([^\"']*\.(?:swagger|openapi|graphql|gql|wsdl|xsd)[^\"']*)[\"']",
    r"[\"']([^\"']*\.(?:pem|key|crt|cer|p12|pfx|htaccess|htpasswd|htgroup|htdigest)[^\"']*)[\"']",
    r"[\"']([^\"']*\.(?:log|out|err|debug|trace|profile)[^\"']*)[\"']",
    r"[\"']([^\"']*\.(?:map|min\.js|min\.css|bundle\.js|chunk\.js|manifest|webmanifest|service-worker\.js)[^\"']*)[\"']",
    r"[\"']([^\"']*\.(?:csv|tsv|xls|xlsx|ods|sql|db|bak|backup|old|orig|tmp|temp|cache|session|cookie|localstorage)[^\"']*)[\"']",
    r"href=[\"']([^\"']*\.(?:html|htm|php|asp|aspx|jsp)[^\"']*)[\"']",
    r"action=[\"']([^\"']*\.(?:php|asp|aspx|jsp)[^\"']*)[\"']",
    r"[\"']([^\"']*/api/[^\"']*)[\"']",
    r"[\"']([^\"']*/v[0-9]+/[^\"']*)[\"']",
    r"[\"']([^\"']*/graphql[^\"']*)[\"']",
    r"[\"']([^\"']*/ws[^\"']*)[\"']",
    r"[\"']([^\"']*/socket\.io[^\"']*)[\"']",
    r"[\"']([^\"']*/static/[^\"']*)[\"']",
    r"[\"']([^\"']*/assets/[^\"']*)[\"']",
    r"[\"']([^\"']*/public/[^\"']*)[\"']",
    r"[\"']([^\"']*/dist/[^\"']*)[\"']",
    r"[\"']([^\"']*/build/[^\"']*)[\"']",
    r"[\"']([^\"']*/docs/[^\"']*)[\"']",
    r"[\"']([^\"']*/documentation/[^\"']*)[\"']",
    r"[\"']([^\"']*/api-docs/[^\"']*)[\"']",
    r"[\"']([^\"']*/(?:robots\.txt|sitemap\.xml)[^\"']*)[\"']",
)


_FROM_QUOTE = r"[\"']([^\"']*"


def _fixed_part(regex: str) -> str:
    """Path every link of a regex holds, if it seeks one between quotes."""
    path = re.match("/[a-z/-]*", regex.removeprefix(_FROM_QUOTE))
    return path[0] if path else ""


def extract_links(
    pages: DataFrame, *, url: str = "url", html: str = "html", keep: Sequence[str] = ()
) -> DataFrame:
    """``(url, link, *keep)``: each page's distinct link targets, as written.

    A regex that seeks a fixed path is run only on pages that hold the path.
    """
    sources = pages.select(F.col(url).alias("url"), *keep, F.col(html).alias("_html")).withColumn(
        "_folded", fold_case(F.col("_html"))
    )
    found = []
    for regex in LINK_REGEXES:
        links = F.regexp_extract_all("_html", F.lit(f"(?diuU){regex}"), 1)
        if part := _fixed_part(regex):
            links = F.when(F.col("_folded").contains(part.upper()), links).otherwise(F.array())
        found.append(links)
    targets = F.array_distinct(F.concat(*found))
    return sources.select("url", *keep, F.explode(targets).alias("link"))


def resolve_links(links: DataFrame) -> DataFrame:
    """Adds ``target``, the absolute URL; what is no URL is dropped."""
    return links.withColumn("target", resolve(F.col("url"), F.col("link"))).where("target is not null")


def filter_links(links: DataFrame, *, target: str = "target") -> DataFrame:
    return links.where(~is_left_out(F.col(target)))


def page_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct ``(src, dst, is_file)`` edges of the followable links of all pages."""
    links = filter_links(resolve_links(extract_links(pages, url=url, html=html)))
    edges = links.select(F.col("url").alias("src"), F.col("target").alias("dst")).distinct()
    return edges.withColumn("is_file", is_file_url(F.col("dst")))


def at_depth(edges: DataFrame, depth: int | Column, max_depth: int) -> DataFrame:
    """Below the deepest level every link counts, at it only links to files."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return edges.where((depth < max_depth) | F.col("is_file"))
