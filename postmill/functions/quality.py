"""Quality gates: predicates over listing and page columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import text as tx


BLOCK_HEAD = 300


def is_blocked_page(title: Column, description: Column, head: int | None = BLOCK_HEAD) -> Column:
    """A wall instead of a listing says so at once: in its title or the first `head` characters (None: anywhere)."""
    start = F.coalesce(description, F.lit(""))
    start = start if head is None else F.substring(start, 1, head)
    return tx.fold(F.concat_ws(" ", title, start)).rlike(lx.BLOCK_PAGE)


def is_non_listing_page(
    title: Column, url: Column, title_pattern: str = lx.NON_LISTING_TITLE, url_pattern: str = lx.NON_LISTING_URL
) -> Column:
    return tx.fold(title).rlike(title_pattern) | F.lower(F.coalesce(url, F.lit(""))).rlike(url_pattern)


def title_words(title: Column) -> Column:
    return F.filter(F.split(tx.normalize(title), " "), lambda w: F.length(w) >= 4)


def slug_words(url: Column) -> Column:
    path = F.coalesce(F.try_url_decode(tx.url_path(url)), tx.url_path(url))
    return F.filter(
        F.split(tx.normalize(path), " "),
        lambda w: (F.length(w) >= 4) & ~w.isin(lx.SLUG_BOILERPLATE) & ~w.rlike("^[0-9]+$"),
    )


def title_matches_url(title: Column, url: Column) -> Column:
    """Title and URL share a telling word; anything undecidable counts as a match."""
    host = tx.url_host(url)
    in_title, in_slug = title_words(title), slug_words(url)
    return (
        host.isNull()
        | host.rlike(lx.OPAQUE_HOSTS)
        | (F.size(in_title) == 0)
        | (F.size(in_slug) == 0)
        | F.arrays_overlap(in_title, in_slug)
    )


def is_usable_detail(title: Column, description: Column, url: Column) -> Column:
    key = tx.fold(title)
    site_chrome = key.rlike(lx.SITE_NAME_TITLE) & ~key.rlike(lx.ROLE_WORD_TITLE)
    return F.coalesce(
        F.length(title).between(3, 180)
        & ~site_chrome
        & (F.length(description) >= 80)
        & (F.length(tx.url_path(url)) > 5),
        F.lit(False),
    )


def _bare_path(url: Column) -> Column:
    return F.lower(F.regexp_replace(tx.url_path(url), "/+$", ""))


def fell_back_to_generic(requested: Column, final: Column) -> Column:
    """A search redirected to another host, a parent path, or lost a query parameter."""
    asked, got = _bare_path(requested), _bare_path(final)
    kept = F.transform(
        F.filter(F.split(tx.url_query(final), "&"), lambda p: p.rlike("=.")),
        lambda p: F.substring_index(p, "=", 1),
    )
    needed = F.transform(
        F.filter(F.split(tx.url_query(requested), "&"), lambda p: p.rlike("=.")),
        lambda p: F.substring_index(p, "=", 1),
    )
    return F.coalesce(
        (tx.url_host(requested) != tx.url_host(final))
        | ((asked != got) & asked.startswith(got))
        | (F.size(F.array_except(needed, kept)) > 0),
        F.lit(False),
    )


def left_detail_page(requested: Column, final: Column) -> Column:
    return F.coalesce(_bare_path(requested) != _bare_path(final), F.lit(False))


def is_detail_url(url: Column, base_host: Column) -> Column:
    """Generic rule: same site, not a search or corporate path, and an id or a long slug at the end."""
    host, path = tx.base_host(url), F.lower(tx.url_path(url))
    same_site = (base_host != "") & (host.endswith(base_host) | base_host.endswith(host))
    last = F.element_at(F.split(F.regexp_replace(tx.url_path(url), "/+$", ""), "/"), -1)
    has_id = last.rlike("[0-9]") | last.rlike("[0-9A-Za-z]{16,}$")
    long_slug = F.size(F.filter(F.split(last, "-"), lambda w: F.length(w) > 1)) >= 3
    return F.coalesce(
        same_site
        & ~path.rlike(lx.NON_DETAIL_PATH)
        & (path.rlike(r"-[0-9]{4,}/?$") | (path.rlike(lx.DETAIL_PATH) & (has_id | long_slug))),
        F.lit(False),
    )


def is_code_noise(c: Column) -> Column:
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[{}\[\]<>=;|]", ""))
    object_literal = text.rlike(r"[{};]\s*[a-zA-Z_$][\w$]*\s*:") & text.rlike(r"[{}]")
    return (text == "") | object_literal | (symbols / F.length(text) > 0.08)


def cleanup_reason(title: Column, description: Column, url: Column) -> Column:
    """Why a listing must go; NULL keeps it."""
    return (
        F.when(is_blocked_page(title, description), "blocked_page")
        .when(is_non_listing_page(title, url), "not_a_listing")
        .when(~title_matches_url(title, url), "title_url_mismatch")
    )


def closed_marker(body: Column) -> Column:
    return tx.fold(body).rlike(lx.CLOSED_MARKERS)


def matches_any_token(text: Column, tokens: Column) -> Column:
    """Structured-feed filter: no tokens keeps everything."""
    found = tx.let(tx.normalize(text), lambda hay: F.exists(tokens, lambda t: F.contains(hay, t)))
    return (F.size(tokens) <= 0) | found
