"""Landed HTML pages to links and listings.

Pages: url, html; listing jobs also use platform, category, source_query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import extract as ex
from postmill.functions import quality as ql
from postmill.functions import text as tx
from postmill.sources.listings import CRAWLED

# --- links -------------------------------------------------------------------------------


def site_detail_url(url: Column, rules: list[tuple] = lx.SITE_RULES) -> Column:
    """Per-site rule for known sites, NULL for others."""
    host, path = tx.url_host(url), tx.url_path(url)
    result = F.lit(None).cast("boolean")
    for site, include, exclude in reversed(rules):
        fits = path.rlike(include)
        if exclude:
            fits = fits & ~path.rlike(exclude)
        if site == "indeed.com":
            fits = fits & (path.startswith("/rc/clk") | tx.url_query(url).rlike(r"(^|&)jk="))
        result = F.when(F.contains(host, F.lit(site)), fits).otherwise(result)
    return result


def detail_url(url: Column, page_url: Column) -> Column:
    return F.coalesce(site_detail_url(url), ql.is_detail_url(url, tx.base_host(page_url)))


def page_links(pages: DataFrame, keep: Column | None = None) -> DataFrame:
    """(page_url, link): hrefs and bare URLs, cleaned, absolute, normalised, distinct per page."""
    c = F.col
    flat = F.regexp_replace(F.replace("html", F.lit("\\u002F"), F.lit("/")), r"\\/", "/")
    candidates = F.concat(
        F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)),
        F.regexp_extract_all(flat, F.lit("(https?://[^\"'<>\\s)]+)"), F.lit(1)),
        F.regexp_extract_all(flat, F.lit("(/(?:is-ilani|ilan|jobs)/[^\"'<>\\s)]+)"), F.lit(1)),
    )
    links = pages.select(
        c("url").alias("page_url"),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.array_distinct(candidates),
                    lambda x: tx.normalize_url(tx.absolute_url(tx.clean_candidate_url(x), c("url"))),
                )
            )
        ).alias("link"),
    ).filter("link is not null")
    return links.filter(detail_url(c("link"), c("page_url")) if keep is None else keep)


# --- page fields -------------------------------------------------------------------------


def page_title(html: Column) -> Column:
    return tx.clean_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_heading(html: Column) -> Column:
    return tx.clean_html(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))


def meta_title(html: Column) -> Column:
    """og:title or <title>, without the leading site name."""
    tag = F.regexp_extract(
        html, r"(?is)<meta\b(?=[^>]*(?:property|name)\s*=\s*[\"'](?:og:title|title)[\"'])[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1
    )
    raw = F.when(tag != "", tx.clean_html(tag)).otherwise(page_title(html))
    parts = F.filter(F.split(raw, r"\s*[|–—]\s*"), lambda p: F.length(F.trim(p)) > 2)
    rest = F.trim(F.array_join(F.slice(parts, 2, 1000), " - "))
    return F.when(raw == "", F.lit(None).cast("string")).when(rest != "", rest).otherwise(raw)


_POSTING = (
    "struct<`@type`:string,title:string,description:string,datePosted:string,employmentType:string,"
    "jobLocationType:string,hiringOrganization:struct<name:string>,jobLocation:string>"
)


def json_ld_posting(html: Column) -> Column:
    """First posting of the page's JSON-LD blocks: top level, list or @graph."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )

    def postings(block: Column) -> Column:
        text = F.trim(block)
        single = F.from_json(text, _POSTING)
        listed = F.from_json(text, f"array<{_POSTING}>")
        graph = F.get_json_object(text, "$['@graph']")
        return F.concat(
            F.array(single), F.coalesce(listed, F.array(single)),
            F.coalesce(F.from_json(graph, f"array<{_POSTING}>"), F.array(single)),
        )

    found = F.filter(
        F.flatten(F.transform(blocks, postings)), lambda p: F.coalesce(p["@type"].rlike("(?i)JobPosting"), F.lit(False))
    )
    return F.get(found, F.lit(0))


def _posting_place(raw: Column) -> Column:
    place = F.coalesce(F.get_json_object(raw, "$[0]"), raw)
    parts = F.filter(
        F.array(*[
            tx.clean_html(F.get_json_object(place, f"$.address.{name}"))
            for name in ("addressLocality", "addressRegion", "addressCountry")
        ]),
        lambda x: x != "",
    )
    named = tx.clean_html(F.get_json_object(place, "$.name"))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).when(named != "", named)


class _Elements(HTMLParser):
    """Flat element list with ancestors and text, enough for simple selectors."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        element = {"tag": tag, "attrs": dict(attrs), "up": list(self.open), "text": []}
        self.elements.append(element)
        if tag not in self.VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not any(e["tag"] in ("script", "style") for e in self.open):
            for element in self.open:
                element["text"].append(data)


_STEP = re.compile(r'^(\w+)?(?:\.([\w-]+))?(?:\[([\w-]+)(?:(\*?=)"([^"]*)")?\])?$')


def _fits(element: dict, step: tuple) -> bool:
    tag, cls, name, op, value = step
    if tag and element["tag"] != tag:
        return False
    attrs = element["attrs"]
    if cls and cls not in (attrs.get("class") or "").split():
        return False
    if name:
        have = attrs.get(name)
        if have is None or (op == "*=" and value not in have) or (op == "=" and value != have):
            return False
    return True


def _first_text(elements: list[dict], selectors: list[list[tuple]]) -> str | None:
    for *above, last in selectors:
        for element in elements:
            if _fits(element, last) and all(any(_fits(up, s) for up in element["up"]) for s in above):
                attrs = element["attrs"]
                text = attrs.get("content") or attrs.get("datetime") or "".join(element["text"])
                text = " ".join(text.split())
                if text:
                    return text
                break
    return None


def select_fields(pages: DataFrame, selectors: dict[str, list[str]] = lx.FIELD_SELECTORS) -> DataFrame:
    """Pages with one `sel_<field>` column per selector list; runs in Arrow batches."""
    fields = list(selectors)
    names = pages.columns
    steps = {f: [[_STEP.match(step).groups() for step in selector.split()] for selector in selectors[f]] for f in fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list] = {f: [] for f in fields}
            for html in batch["html"]:
                parser = _Elements()
                parser.feed(html or "")
                for f in fields:
                    found[f].append(_first_text(parser.elements, steps[f]))
            yield batch.assign(**{f"sel_{f}": pd.Series(v, index=batch.index, dtype=object) for f, v in found.items()})

    schema = ", ".join([f"`{x}` {t}" for x, t in pages.dtypes] + [f"sel_{f} string" for f in fields])
    return pages.select(*names).mapInPandas(run, schema)


def pages_to_listings(pages: DataFrame, selectors: dict[str, list[str]] = lx.FIELD_SELECTORS) -> DataFrame:
    """Usable listings: JSON-LD first, then selectors with meta title and page text as fallback."""
    c = F.col
    # generators run once a page; projections would be computed again by the filter on usable pages and by every use
    page_text = tx.clean_html(F.regexp_replace("html", r"(?is)^.*?<body\b", "<body"))
    read = F.struct(json_ld_posting(c("html")).alias("ld"), page_text.alias("page_text"))
    rows = select_fields(pages, selectors).select("*", F.inline(F.array(read)))
    ld_title, ld_text = tx.cleanup_title(c("ld.title")), tx.clean_html(tx.clean_html(c("ld.description")))
    use_ld = c("ld").isNotNull() & ql.is_usable_detail(ld_title, ld_text, c("url"))
    own = tx.cleanup_title(c("sel_title"))
    trusted = (own != "") & ql.title_matches_url(own, c("url"))
    title = F.when(trusted, own).otherwise(F.coalesce(tx.cleanup_title(meta_title(c("html"))), own))
    block = tx.clean_html(c("sel_description"))
    body = F.when(F.length(block) > 120, block).otherwise(c("page_text"))
    basis = rows.select(F.inline(F.array(F.struct(
        *[x for x in ("platform", "category", "source_query") if x in rows.columns], "url",
        F.when(use_ld, ld_title).otherwise(title).alias("title"),
        F.when(use_ld, tx.cleanup_company(c("ld.hiringOrganization.name"))).otherwise(tx.cleanup_company(c("sel_company"))).alias("company"),
        F.when(use_ld, F.coalesce(_posting_place(c("ld.jobLocation")), tx.infer_city(ld_text)))
        .otherwise(F.coalesce("sel_location", tx.infer_city(c("page_text")))).alias("location"),
        tx.infer_work_mode(
            F.when(use_ld, F.concat_ws(" ", ld_text, c("ld.employmentType"), c("ld.jobLocationType"))).otherwise(c("page_text"))
        ).alias("work_mode"),
        F.when(use_ld, ld_text).otherwise(body).alias("description"),
        F.when(use_ld, ld_text).otherwise(c("page_text")).alias("section_text"),
        F.when(use_ld, c("ld.datePosted")).otherwise(c("sel_date")).alias("posted_text"),
    ))))
    usable = basis.filter(ql.is_usable_detail(c("title"), c("description"), c("url")))
    shaped = usable.select(
        *[c(x) if x in basis.columns else F.lit(None).cast("string").alias(x) for x in ("platform", "category")],
        tx.external_id(c("url")).alias("external_id"), "title", "company", "location", "work_mode", "description",
        ex.section_sentences(c("section_text"), lx.REQUIREMENT_SECTION, lx.CRITERIA_SECTION).alias("requirements"),
        ex.section_sentences(c("section_text"), lx.CRITERIA_SECTION, lx.REQUIREMENT_SECTION).alias("candidate_criteria"), "url",
        (c("source_query") if "source_query" in basis.columns else F.lit(None).cast("string")).alias("source_query"),
        F.try_to_timestamp("posted_text").alias("posted_at"),
    )
    return shaped.select(*CRAWLED)
