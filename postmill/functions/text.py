"""Text projections. Every function maps Columns to a Column and stays on the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import lexicon as lx

SPACE = r"[\s\u00a0]+"


def let(value: Column, body) -> Column:
    """Bind a value once: inside higher-order functions Spark would evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def fold(c: Column) -> Column:
    """Lower case with Turkish letters as ASCII; keeps every character position."""
    return F.lower(F.translate(c, lx.TURKISH_FROM, lx.TURKISH_TO))


def normalize(c: Column) -> Column:
    """The comparison form of a text: folded words over [a-z0-9+#.] and single blanks.

    The words are taken out rather than what stands between them replaced: on long texts a tenth of the time.
    """
    return F.array_join(F.regexp_extract_all(fold(c), F.lit("[a-z0-9+#.]+"), F.lit(0)), " ")


def needles(pattern: str) -> tuple[list[str], bool] | None:
    """Plain strings of which a text that matches the pattern holds one, and whether holding one is a match.

    None where some alternative needs no plain string; only what stands for itself in any text is taken.
    """
    if re.search(r"\(\?|\\[QEpPxu0-9]", pattern):
        return None
    inner = re.fullmatch(r"(?:\\b)?\(((?:[^()\[\]\\]|\\\.)*)\)(?:\\b)?", pattern)
    bounded = inner is not None and "\\b" in pattern
    body = inner[1] if inner else pattern
    # a class, a group, or any other sign ends a plain string; so does a character that need not be there
    tokens = re.findall(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|\{[^}]*\}|.", body, re.S)
    found, runs, run, depth, exact = [], [], "", 0, not bounded
    for k, token in enumerate([*tokens, "|"]):
        following = tokens[k + 1] if k + 1 < len(tokens) else ""
        plain = token[1] if token == "\\." else token if len(token) == 1 and token not in "\\.[](){}*+?|^$" else ""
        if token == "|" and depth == 0:
            runs.append(run)
            found.append(max(runs, key=len))
            runs, run = [], ""
            continue
        depth += (token == "(") - (token == ")")
        if plain and depth == 0 and not (following[:1] in ("?", "*", "+", "{") and following):
            run += plain
        else:
            exact = False
            runs.append(run)
            run = ""
    return (list(dict.fromkeys(found)), exact) if all(found) and depth == 0 else None


def found(text: Column, pattern: str) -> Column:
    """`text.rlike(pattern)`; a text without any of the plain strings that the pattern needs is not searched by it."""
    needed = needles(pattern)
    if needed is None:
        return text.rlike(pattern)
    held = reduce(or_, [F.contains(text, F.lit(x)) for x in needed[0]])
    return held if needed[1] else held & text.rlike(pattern)


def first_found(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern is found in `text`, else NULL."""
    return F.coalesce(*[F.when(found(text, pattern), label) for pattern, label in rules])


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def words(normalized: Column) -> Column:
    """Words of an already normalised text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def clean_html(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    text = F.regexp_replace(text, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.regexp_replace(text, "(?i)" + entity, char)
    return squeeze(text)


def slugify(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0)), "-")


def distinct_by_key(items: Column, keys: Column) -> Column:
    """Items whose key is seen for the first time, null keys left out; `keys` runs parallel to `items`.

    Keys are sorted with their places and met by their neighbours, so the cost is that of sorting; both inputs are computed once.
    """
    def firsts(placed: Column) -> Column:
        return F.filter(placed, lambda p, j: p["key"].isNotNull() & ((j == 0) | (F.get(placed, j - 1)["key"] != p["key"])))

    def chosen(x: Column) -> Column:
        placed = F.array_sort(F.transform(x["keys"], lambda key, i: F.struct(key.alias("key"), i.alias("place"))))
        places = F.array_sort(F.transform(let(placed, firsts), lambda p: p["place"]))
        return F.transform(places, lambda i: F.get(x["items"], i))

    return let(F.struct(items.alias("items"), keys.alias("keys")), chosen)


def first(items: Column, limit: int | None) -> Column:
    """The first `limit` items; None is all."""
    return items if limit is None else F.slice(items, 1, limit)


def distinct_ignore_case(items: Column) -> Column:
    return let(F.filter(items, lambda s: s != ""), lambda kept: distinct_by_key(kept, F.transform(kept, turkish_lower)))


def dedupe_location_segments(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    unique = distinct_ignore_case(parts)
    return F.when(F.size(unique) > 0, F.array_join(unique, ", ")).otherwise(F.trim(c))


# --- URLs ----------------------------------------------------------------------------

_URL_HEAD = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def url_host(c: Column) -> Column:
    """Lower-case host without user, port; NULL when the text is not a URL."""
    host = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def url_path(c: Column) -> Column:
    path = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(url_host(c).isNotNull(), F.when(path == "", F.lit("/")).otherwise(path))


def url_query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def normalize_url(c: Column) -> Column:
    head = F.lower(F.regexp_extract(c, _URL_HEAD, 1))
    tail = F.regexp_replace(F.regexp_replace(c, _URL_HEAD, ""), r"#.*$", "")
    return F.regexp_replace(F.when(head != "", F.concat(head, tail)).otherwise(c), r"/+$", "")


def url_key(c: Column) -> Column:
    """The key listings are considered the same under."""
    return turkish_lower(normalize_url(c))


def absolute_url(href: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, _URL_HEAD, 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(url_path(base) == "/", F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_replace(page, r"[^/]*$", "")
    )
    target = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when((href == "") | href.startswith("#"), base)
        .otherwise(F.concat(folder, href))
    )
    return F.when(origin != "", F.regexp_replace(target, r"#.*$", ""))


def base_host(c: Column) -> Column:
    return F.regexp_replace(url_host(c), r"^www\.", "")


def external_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"([0-9]{5,})(?:[/?#]|$)", 1)
    return F.when(found != "", found)


def clean_candidate_url(c: Column) -> Column:
    text = F.replace(F.replace(F.replace(c, F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(text, r"[),.;]+$", ""))


def fill_search_template(template: Column, query: Column) -> Column:
    # the URL encoder writes form encoding; query templates want percent-encoded blanks
    encoded = F.replace(F.url_encode(query), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(template, F.lit("{query_slug}"), slugify(query)), F.lit("{query}"), encoded)


# --- inference -----------------------------------------------------------------------


def infer_work_mode(c: Column) -> Column:
    text = normalize(c)
    return (
        F.when(text.rlike(lx.REMOTE_WORDS), "remote")
        .when(text.rlike(lx.HYBRID_WORDS), "hybrid")
        .when(text.rlike(lx.ONSITE_WORDS), "onsite")
    )


def known_work_mode(c: Column) -> Column:
    return F.when(c.isin("remote", "hybrid", "onsite"), c)


def _fold_py(value: str) -> str:
    return value.translate(str.maketrans(lx.TURKISH_FROM, lx.TURKISH_TO)).lower()


def infer_city(c: Column, cities: Sequence[str] = lx.CITIES) -> Column:
    """First city named in the text, in its official spelling."""
    by_key = {_fold_py(city): city for city in cities}
    alternation = "|".join(sorted(by_key, key=len, reverse=True))
    found = F.regexp_extract(normalize(c), rf"(?:^|[^a-z0-9])({alternation})(?:[^a-z0-9]|$)", 1)
    labels = F.create_map(*[F.lit(x) for pair in by_key.items() for x in pair])
    return F.when(found != "", F.element_at(labels, found))


def truncate(c: Column, limit: int = 420) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.trim(F.substring(c, 1, limit)), F.lit("...")))


def clean_extracted_text(c: Column) -> Column:
    text = F.replace(c, F.lit("\u0000"), F.lit(" "))
    text = F.regexp_replace(text, r"[\t ]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_preview(c: Column, limit: int = 1200) -> Column:
    return truncate(clean_extracted_text(c), limit)


# --- identity keys -------------------------------------------------------------------


def normalize_company(c: Column) -> Column:
    name = squeeze(F.replace(normalize(F.coalesce(c, F.lit(""))), F.lit("."), F.lit(" ")))
    suffixes = "|".join(sorted(lx.COMPANY_SUFFIXES, key=len, reverse=True))
    return F.when(name.isin(lx.MENU_COMPANIES), F.lit("")).otherwise(
        F.regexp_replace(name, rf"(?: (?:{suffixes}))+$", "")
    )


def normalize_title(c: Column) -> Column:
    return squeeze(F.regexp_replace(normalize(F.coalesce(c, F.lit(""))), lx.TITLE_DECORATION, " "))


def city_token(location: Column) -> Column:
    return F.element_at(F.split(normalize(F.coalesce(location, F.lit(""))), " "), 1)


def employment_marker(title: Column) -> Column:
    text = normalize(F.coalesce(title, F.lit("")))
    return (
        F.when(text.rlike("staj|intern"), "staj")
        .when(text.rlike(r"part\s*time|yari\s*zamanli"), "part")
        .when(text.rlike(r"full\s*time|tam\s*zamanli"), "full")
    )


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    firm, role = normalize_company(company), normalize_title(title)
    return F.when((firm == "") | (role == ""), F.lit("")).otherwise(
        F.concat_ws("|", firm, role, city_token(location))
    )


def content_hash(title: Column, company: Column, description: Column, requirements: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "::", title, F.coalesce(company, F.lit("")), F.coalesce(description, F.lit("")),
            F.array_join(requirements, "|"),
        ),
        256,
    )


def _term(c: Column) -> Column:
    return turkish_lower(squeeze(F.coalesce(c, F.lit(""))))


def _term_list(c: Column) -> Column:
    terms = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _term), lambda t: t != "")
    return F.array_join(F.array_sort(F.array_distinct(terms)), ",")


def search_fingerprint(
    user_id: Column, cv_id: Column, cv_text: Column, positions: Column, seniority: Column,
    location_mode: Column, cities: Column, work_mode: Column, note: Column,
) -> Column:
    """Same hash exactly when user, CV content and every search criterion are the same."""
    cv = F.regexp_replace(F.coalesce(cv_text, F.lit("")), r"^\s+|\s+$", "")
    cv_hash = F.when(cv == "", F.lit("-")).otherwise(F.substring(F.sha2(cv, 256), 1, 16))
    level = F.when(_term(seniority) == "", F.lit("any")).otherwise(_term(seniority))
    parts = [
        ("u", F.coalesce(user_id.cast("string"), F.lit("-"))),
        ("cv", F.coalesce(cv_id.cast("string"), F.lit("-"))),
        ("ct", cv_hash),
        ("p", _term_list(positions)),
        ("s", level),
        ("l", _term(location_mode)),
        ("c", _term_list(cities)),
        ("w", _term(work_mode)),
        ("n", _term(note)),
    ]
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(name + ":"), value) for name, value in parts]), 256)


def base_city(location: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(location, F.lit("")), r"[(/,]"), 1))


def company_slugs(company: Column) -> Column:
    """Board slugs a company may use: whole name, compact name, first two words."""
    base = slugify(F.regexp_replace(normalize_company(company), lx.SECTOR_WORDS, " "))
    parts = F.filter(F.split(base, "-"), lambda w: w != "")
    short = F.slice(parts, 1, 2)
    all_forms = F.array_distinct(
        F.concat(
            F.array(base, F.replace(base, F.lit("-"), F.lit(""))),
            F.when(F.size(parts) > 2, F.array(F.array_join(short, "-"), F.array_join(short, ""))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )
    usable = F.filter(all_forms, lambda s: F.length(s).between(3, 40))
    return F.when(base.rlike("[a-z]{3,}"), usable).otherwise(F.array().cast("array<string>"))


def query_tokens(queries: Column, min_length: int = 3) -> Column:
    """Distinct words of an array of queries."""
    joined = F.array_join(F.transform(queries, lambda q: normalize(q)), " ")
    return F.array_distinct(F.filter(F.split(joined, " "), lambda w: F.length(w) >= min_length))


# --- clean-up ------------------------------------------------------------------------


def sanitize_term(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "[<>\"'`]", ""))


def sanitize_name(c: Column) -> Column:
    return F.substring(sanitize_term(c), 1, 120)


def sanitize_email(c: Column) -> Column:
    return F.substring(F.lower(F.trim(c)), 1, 190)


def is_valid_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def clean_terms(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, sanitize_term), lambda t: t != ""))


def cleanup_title(c: Column) -> Column:
    text = F.regexp_replace(clean_html(c), r"\s+\|\s+.*$", "")
    # positions survive folding, so the site suffix found on folded text can be cut from the text
    suffix = F.regexp_instr(fold(text), F.lit(lx.SITE_SUFFIX))
    return F.trim(F.when(suffix > 0, F.substring(text, F.lit(1), suffix - 1)).otherwise(text))


def cleanup_company(c: Column) -> Column:
    text = clean_html(c)
    menu = normalize(text).isin(lx.MENU_COMPANIES + lx.MENU_BUTTONS)
    return F.when(~menu & (F.length(text) > 2) & (F.length(text) < 160), text)
