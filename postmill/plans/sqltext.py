"""DuckDB SQL for the same views and text keys, used by the oracle queries."""

from __future__ import annotations

from postmill import lexicon as lx
from postmill.plans.tables import DAY, NOW


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(e: str) -> str:
    return f"lower(translate({e}, {q(lx.TURKISH_FROM)}, {q(lx.TURKISH_TO)}))"


def norm(e: str) -> str:
    return f"trim(regexp_replace({fold(e)}, '[^a-z0-9+#.]+', ' ', 'g'))"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def trlower(e: str) -> str:
    return f"lower(translate({e}, 'Iİ', 'ıi'))"


def slug(e: str) -> str:
    return f"regexp_replace(regexp_replace({norm(e)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def words(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda w: w <> '')"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def clean_html(e: str) -> str:
    text = f"coalesce({e}, '')"
    for pattern, by in (
        ("(?is)<script.*?</script>", " "), ("(?is)<style.*?</style>", " "), ("<[^>]+>", " "), ("(?i)&nbsp;", " "),
        ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"),
    ):
        text = f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"
    return squeeze(text)


def host(e: str) -> str:
    return f"nullif(lower(regexp_extract({e}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"


def path(e: str) -> str:
    raw = f"regexp_extract({e}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
    return f"CASE WHEN {host(e)} IS NOT NULL THEN CASE WHEN {raw} = '' THEN '/' ELSE {raw} END END"


HEAD = "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"


def norm_url(e: str) -> str:
    return (
        f"regexp_replace(CASE WHEN regexp_extract({e}, '{HEAD}', 1) <> '' THEN lower(regexp_extract({e}, '{HEAD}', 1)) "
        f"|| regexp_replace(regexp_replace({e}, '{HEAD}', ''), '#.*$', '') ELSE {e} END, '/+$', '')"
    )


def url_key(e: str) -> str:
    return trlower(norm_url(e))


def company(e: str) -> str:
    name = squeeze(f"replace({norm(f'coalesce({e}, {q(str())})')}, '.', ' ')")
    suffixes = "|".join(sorted(lx.COMPANY_SUFFIXES, key=len, reverse=True))
    return f"CASE WHEN {name} IN {in_list(lx.MENU_COMPANIES)} THEN '' ELSE regexp_replace({name}, '(?: (?:{suffixes}))+$', '') END"


def title_key(e: str) -> str:
    return squeeze(f"regexp_replace({norm(f'coalesce({e}, {q(str())})')}, {q(lx.TITLE_DECORATION)}, ' ', 'g')")


def city(e: str) -> str:
    return f"split_part({norm(f'coalesce({e}, {q(str())})')}, ' ', 1)"


def fingerprint(title: str, firm: str, location: str) -> str:
    return (
        f"CASE WHEN {company(firm)} = '' OR {title_key(title)} = '' THEN '' ELSE "
        f"{company(firm)} || '|' || {title_key(title)} || '|' || {city(location)} END"
    )


def first_match(folded: str, rules: list[tuple[str, str]], default: str = q(lx.UNSPECIFIED)) -> str:
    cases = " ".join(f"WHEN regexp_matches({folded}, {q(p)}) THEN {q(label)}" for p, label in rules)
    return f"CASE {cases} ELSE {default} END"


def round_half_up(e: str, digits: int = 0) -> str:
    scale = 10**digits
    return f"floor(({e}) * {scale} + 0.5) / {scale}"


# --- views ---------------------------------------------------------------------------------

LISTINGS = f"""
docs AS (
  SELECT *, trim(substr(split_part(text, chr(10), 1), 1, 100)) AS title FROM documents
),
base_listings AS (
  SELECT doc_id AS listing_id, source AS platform, lang AS country, title,
    lang || ' ' || split_part({norm('title')}, ' ', 1) AS company,
    CASE WHEN n_chars % 5 <> 0 THEN lang || ', ' || source END AS location,
    CASE WHEN source IN ('src0', 'src5') THEN 'remote' WHEN source IN ('src1', 'src6') THEN 'hybrid'
         WHEN source = 'src2' THEN 'onsite' END AS work_mode,
    text AS description,
    'https://' || source || '.example.com/jobs/' || {slug('substr(title, 1, 60)')} ||
      CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END AS url,
    CASE WHEN n_chars < 100 THEN 'stale' ELSE 'active' END AS status,
    {NOW} - (doc_id % 40) * {DAY} - doc_id AS last_seen,
    {NOW} - (n_chars % 45) * {DAY} AS posted_s,
    {NOW} - (doc_id % 97) * 3600 AS first_seen_s,
    CASE WHEN doc_id % 7 <> 0 THEN {NOW} - (doc_id % 13) * {DAY} END AS last_checked_s,
    n_chars
  FROM docs
)"""

_PLAIN = f"regexp_replace({norm('description')}, '[.+#]', '', 'g')"

FULL_LISTINGS = LISTINGS + f""",
listing_words AS (SELECT *, {words(_PLAIN)} AS w FROM base_listings),
listings AS (
  SELECT * EXCLUDE (w),
    list_filter(list_transform(range(0, (len(w) + 11) // 12), lambda k: array_to_string(w[12 * k + 1:12 * k + 12], ' ')),
                lambda x: length(x) >= 8) AS requirements,
    CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars % 7 END AS min_years,
    n_chars % 7 = 0 AS accepts_none,
    n_chars % 3 AS education_kind,
    n_chars % 4 = 0 AS wants_english
  FROM listing_words
)"""

PROFILES = f"""
bench AS (
  SELECT item_id, {words(f"regexp_replace({norm('text')}, '[.+#]', '', 'g')")} AS w FROM benchmark
),
profiles AS (
  SELECT item_id AS profile_id, array_to_string(w[1:2], ' ') AS target_role,
    [array_to_string(w[1:2], ' '), array_to_string(w[3:4], ' ')] AS titles,
    list_filter(w[5:], lambda x, i: length(x) >= 4 AND list_position(w[5:], x) = i) AS skills,
    list_filter(w[8:], lambda x, i: length(x) >= 3 AND list_position(w[8:], x) = i) AS keywords,
    [array_to_string(w[5:6], ' ')] AS query_variations,
    CASE WHEN item_id % 2 = 0 THEN ['ingilizce'] WHEN item_id % 4 = 1 THEN ['almanca'] ELSE []::VARCHAR[] END AS languages,
    CASE WHEN item_id % 3 = 0 THEN ['en'] ELSE []::VARCHAR[] END AS locations,
    CASE WHEN item_id % 3 = 0 THEN 'cities' ELSE 'all-turkey' END AS location_mode,
    CASE WHEN item_id % 4 = 1 THEN 'remote' WHEN item_id % 4 = 2 THEN 'hybrid' ELSE 'any' END AS work_mode,
    CASE WHEN item_id % 5 = 0 THEN 'stajyer' WHEN item_id % 5 = 1 THEN 'junior' WHEN item_id % 5 = 2 THEN 'senior'
         ELSE 'belirtilmemis' END AS seniority,
    item_id % 11 = 0 AS wants_internship,
    CASE WHEN item_id % 10 <> 7 THEN item_id % 9 END AS years,
    CASE WHEN item_id % 3 = 0 THEN 0 WHEN item_id % 3 = 1 THEN 2 WHEN item_id % 7 = 2 THEN 3 END AS education_rank,
    item_id % 3 = 1 AS says_student
  FROM bench
)"""

CRAWL_LOG = """
crawl_log AS (
  SELECT user_id AS source, ts, event_id, event_type AS status,
    CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE CAST(floor(value) AS INTEGER) + 1 END AS parsed,
    CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INTEGER) + 2 END AS discovered,
    event_type = 'error' AND value > 60 AS blocked
  FROM events
)"""

SCAN_LOG = """
scan_log AS (
  SELECT user_id AS source, ts, event_id, event_type <> 'error' AS succeeded,
    CAST(floor(value) AS INTEGER) AS new_jobs, CAST(floor(value / 2) AS INTEGER) AS relevant_jobs,
    CAST(floor(value / 5) AS INTEGER) AS duplicate_jobs, value > 250 AS rate_limited
  FROM events
)"""

REGISTRY = f"""
registry AS (
  SELECT s_name AS name, CASE WHEN s_nationkey < 15 THEN 'TR' ELSE 'US' END AS country,
    list_extract(['general-board', 'niche-board', 'ats', 'remote-board', 'company-career', 'aggregator'], CAST(s_suppkey % 6 AS INTEGER) + 1) AS source_type,
    CASE WHEN s_suppkey % 17 = 0 THEN 'candidate' ELSE 'active' END AS status,
    s_suppkey % 60 + 1 AS priority,
    (s_acctbal - 100 * floor(s_acctbal / 100)) / 100 AS reliability,
    CASE WHEN s_suppkey % 5 <> 0 THEN {NOW} - (s_suppkey % 72) * 3600 END AS last_scanned_s,
    s_suppkey % 4 AS total_scans, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 4 END AS successful_scans,
    s_suppkey % 23 AS new_jobs, s_suppkey % 11 AS relevant_jobs, s_suppkey % 7 AS duplicate_jobs,
    list_extract(['tech,genel', 'saglik', 'finans', 'genel', 'tech', 'egitim,genel', 'muhendislik'], CAST(s_suppkey % 7 AS INTEGER) + 1) AS profession_tags
  FROM supplier
)"""

APPLICATIONS = """
applications AS (
  SELECT o_orderkey AS application_id, o_custkey AS user_id,
    CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'needs_review' ELSE 'manual_required' END
         WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'sent' END
         WHEN o_orderkey % 3 = 0 THEN 'queued' WHEN o_orderkey % 3 = 1 THEN 'preparing' ELSE 'skipped' END AS status,
    CAST(floor(o_totalprice / 5000) AS INTEGER) AS score, o_orderdate AS created_at, o_orderpriority AS priority
  FROM orders
)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n"
