"""Retrieval, relevance, eligibility and scoring queries: benchmark items as profiles, documents as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import profile as pf
from postmill.functions import text as tx
from postmill.operators import analytics as an
from postmill.operators import dictionary as dc
from postmill.operators import eligibility as el
from postmill.operators import retrieve as rt
from postmill.operators import score as sc
from postmill.plans import sqltext as s
from postmill.plans.registry import query
from postmill.plans.tables import HOME_CITIES, NOW, now
from postmill.session import cut, small

c = F.col

_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def ordered_distinct(e: str) -> str:
    return f"list_transform(list_filter(list_zip({e}, range(1, len({e}) + 1)), lambda p: list_position({e}, p[1]) = p[2]), lambda p: p[1])"


_TERMS = "list_filter([target_role] || titles || query_variations || skills || keywords, lambda x: length(x) >= 2)"
_LIKE = "list_filter([target_role] || titles || query_variations || skills, lambda x: length(x) >= 2)"
_STOP = s.in_list(lx.FULLTEXT_STOPWORDS)
_LISTING_TEXT = "title || ' ' || company || ' ' || description"

RETRIEVED = f"""
active AS (SELECT listing_id, last_seen, {s.norm(_LISTING_TEXT)} AS t FROM listings WHERE status = 'active'),
tokens AS (SELECT listing_id, last_seen, unnest(list_distinct(string_split(t, ' '))) AS token FROM active),
term_lists AS (SELECT profile_id, {_TERMS} AS a, {_LIKE} AS l FROM profiles),
wanted AS (
  SELECT DISTINCT profile_id, token FROM (
    SELECT profile_id, unnest(string_split({s.norm("array_to_string(" + ordered_distinct('a') + ", ' ')")}, ' ')) AS token FROM term_lists)
  WHERE length(token) >= {lx.FULLTEXT_MIN_TOKEN} AND token NOT IN {_STOP}
),
tier1 AS (
  SELECT profile_id, listing_id, last_seen, 1 AS tier FROM (
    SELECT DISTINCT profile_id, listing_id, last_seen FROM wanted JOIN tokens USING (token))
  QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY last_seen DESC, listing_id DESC) <= {lx.RETRIEVAL_LIMIT}
),
short AS (
  SELECT profile_id, unnest(list_filter({ordered_distinct('l')}, lambda x: length(x) >= 3)) AS term FROM term_lists
  WHERE profile_id NOT IN (SELECT profile_id FROM tier1 GROUP BY profile_id HAVING count(*) >= {lx.RETRIEVAL_LIMIT})
),
tier2 AS (
  SELECT profile_id, listing_id, last_seen, 2 AS tier FROM (
    SELECT DISTINCT profile_id, listing_id, last_seen FROM short JOIN active ON contains(t, term))
  QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY last_seen DESC, listing_id DESC) <= {lx.RETRIEVAL_LIMIT}
),
both_tiers AS (SELECT profile_id, listing_id, min(tier) AS tier, max(last_seen) AS last_seen FROM (SELECT * FROM tier1 UNION ALL SELECT * FROM tier2) GROUP BY profile_id, listing_id),
merged AS (
  SELECT * FROM both_tiers QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY tier, last_seen DESC, listing_id DESC) <= {lx.RETRIEVAL_LIMIT}
),
pool AS (SELECT listing_id, last_seen FROM active ORDER BY last_seen DESC, listing_id DESC LIMIT {lx.TOP_UP_LIMIT}),
retrieved AS (
  SELECT profile_id, listing_id, tier, last_seen FROM merged
  UNION ALL SELECT profile_id, listing_id, 3, last_seen FROM profiles, pool WHERE profile_id NOT IN (SELECT profile_id FROM merged)
)"""
BASE = (s.FULL_LISTINGS, s.PROFILES, RETRIEVED)


def retrieved(t):
    return rt.retrieve(t.profiles, t.base_listings)


def of_pairs(listings, pairs):
    """Listings that some profile retrieved (`pairs` is cut); the semi join goes below whatever is parsed from them, and
    where their ids are counted to be few, no text is shuffled."""
    return listings.join(small(pairs.select("listing_id").distinct()), "listing_id", "left_semi")


def required(t, pairs):
    """Retrieved listings with requirement lines. They are parsed after the semi join, dealt over the tasks as the newest may
    lie side by side; the filter is on what a generator gives, as one on the parsed column would go below and parse all."""
    kept = t.parsed(t.dealt(of_pairs(t.base_listings, pairs), "listing_id"))
    return kept.withColumn("requirements", F.explode(F.array("requirements"))).filter(F.size("requirements") > 0)


@query("term_retrieval", s.with_(*BASE) + "SELECT profile_id, listing_id, tier FROM retrieved")
def term_retrieval(t):
    return retrieved(t).select("profile_id", "listing_id", "tier")


_RARE = """
rare_profiles AS (SELECT profile_id, [target_role || ' zz'] AS titles, target_role || ' zz' AS target_role, []::VARCHAR[] AS query_variations,
  list_filter(skills, lambda x: length(x) >= 12) AS skills, []::VARCHAR[] AS keywords FROM profiles)"""


@query("sparse_retrieval", s.with_(s.FULL_LISTINGS, s.PROFILES, _RARE, RETRIEVED.replace("FROM profiles", "FROM rare_profiles")) + "SELECT profile_id, listing_id, tier FROM retrieved")
def sparse_retrieval(t):
    """Profiles with few usable terms, so that the phrase and top-up tiers do the work."""
    none = F.array().cast("array<string>")
    role = F.concat("target_role", F.lit(" zz"))
    rare = t.profiles.select(
        "profile_id", role.alias("target_role"), F.array(role).alias("titles"), none.alias("query_variations"),
        F.filter("skills", lambda x: F.length(x) >= 12).alias("skills"), none.alias("keywords"),
    )
    return rt.retrieve(rare, t.base_listings).select("profile_id", "listing_id", "tier")


def _phrases(t):
    return t.profiles.select("profile_id", F.explode(F.array_distinct(F.concat("titles", "skills"))).alias("term"))


_PHRASES = "phrases AS (SELECT DISTINCT unnest(titles || skills) AS term FROM profiles),\ntexts AS (SELECT listing_id, " + s.norm("description") + " AS t FROM base_listings)"


@query("phrase_hits", s.with_(s.LISTINGS, s.PROFILES, _PHRASES) + "SELECT term, listing_id FROM phrases JOIN texts ON contains(t, term)")
def phrase_hits(t):
    texts = cut(t.base_listings.select("listing_id", tx.normalize(c("description")).alias("text")))
    return rt.containing_texts(texts, _phrases(t).select("term")).select("term", "listing_id")


_PTERMS = f"""
profile_terms AS (
  SELECT profile_id, list_distinct(list_filter(flatten(list_transform([target_role] || titles || skills || keywords || query_variations,
    lambda x: [x] || string_split(x, ' '))), lambda x: length(x) >= 3 AND x NOT IN {s.in_list(lx.GENERIC_TERMS)})) AS terms FROM profiles
)"""


def _terms(t):
    sources = F.concat(F.array("target_role"), "titles", "skills", "keywords", "query_variations")
    return t.profiles.select("profile_id", pf.profile_terms(sources).alias("terms"))


@query("profile_terms", s.with_(s.PROFILES, _PTERMS) + "SELECT profile_id, array_to_string(list_sort(terms), '|') AS terms FROM profile_terms")
def profile_terms(t):
    return _terms(t).select("profile_id", F.array_join(F.array_sort("terms"), "|").alias("terms"))


_GATE = f"""
gate AS (
  SELECT profile_id, listing_id, len(terms) = 0 OR (ti = '' AND b = '') OR (ti <> '' AND len(list_filter(terms, lambda x: contains(ti, x))) > 0)
    OR len(list_filter(terms, lambda x: contains(b, x))) >= 2 AS relevant
  FROM retrieved JOIN profile_terms USING (profile_id)
  JOIN (SELECT listing_id, {s.norm("title || ' ' || company")} AS ti, {s.norm("description || ' ' || array_to_string(requirements, ' ')")} AS b FROM listings) USING (listing_id)
)"""


def _sides(t, pairs):
    return of_pairs(t.listings, pairs).select(
        "listing_id", tx.normalize(F.concat_ws(" ", "title", "company")).alias("head"),
        tx.normalize(F.concat_ws(" ", "description", F.array_join("requirements", " "))).alias("body"),
    )


@query("relevance_gate", s.with_(*BASE, _PTERMS, _GATE) + "SELECT profile_id, listing_id, relevant FROM gate")
def relevance_gate(t):
    found = cut(retrieved(t).select("profile_id", "listing_id"))
    pairs = found.join(_terms(t), "profile_id").join(_sides(t, found), "listing_id")
    return pairs.select("profile_id", "listing_id", rt.relevance(c("terms"), c("head"), c("body")).alias("relevant"))


_ALL_RELEVANT = f"""
sides AS (SELECT listing_id, {s.norm("title || ' ' || company")} AS ti, {s.norm('description')} AS b FROM base_listings),
strict AS (SELECT profile_id, terms FROM profile_terms)"""


@query("relevant_pairs", s.with_(s.LISTINGS, s.PROFILES, _PTERMS, _ALL_RELEVANT) + """
SELECT profile_id, listing_id FROM strict, sides
WHERE len(list_filter(terms, lambda x: contains(ti, x))) > 0 OR len(list_filter(terms, lambda x: contains(b, x))) >= 2
""")
def relevant_pairs(t):
    """The gate as a containment join over everything, with no pair that shares no term."""
    terms = cut(_terms(t).select("profile_id", F.explode("terms").alias("term")))
    head, body = tx.normalize(F.concat_ws(" ", "title", "company")), tx.normalize(c("description"))
    return rt.relevant_everywhere(terms, t.base_listings.select("listing_id", head.alias("head"), body.alias("body")))


_CITY = f"""
city_ok AS (
  SELECT profile_id, listing_id, location_mode <> 'cities' OR p.work_mode = 'remote' OR len(locations) = 0 OR {s.norm("coalesce(location, '')")} = ''
    OR len(list_filter(locations, lambda w: contains({s.norm("coalesce(location, '')")}, w))) > 0 OR coalesce(l.work_mode = 'remote', false) AS kept
  FROM retrieved JOIN profiles p USING (profile_id) JOIN listings l USING (listing_id)
)"""


@query("city_filter", s.with_(*BASE, _CITY) + "SELECT profile_id, listing_id, kept FROM city_ok")
def city_filter(t):
    return _in_city(t, retrieved(t))


def _in_city(t, pairs):
    who = t.profiles.select("profile_id", "locations", "location_mode", c("work_mode").alias("wanted_mode"))
    where = t.base_listings.select("listing_id", "location", "work_mode")
    joined = pairs.select("profile_id", "listing_id").join(who, "profile_id").join(where, "listing_id")
    return joined.select(
        "profile_id", "listing_id",
        rt.in_wanted_city(c("location"), c("work_mode"), c("locations"), c("location_mode"), c("wanted_mode")).alias("kept"),
    )


_CHEAP = f"""
listing_keys AS (SELECT *, {s.norm('title')} AS tk, {s.norm('description')} AS dk, {s.norm("coalesce(location, '')")} AS lk FROM listings),
cheap AS (
  SELECT profile_id, listing_id, platform, country, p.work_mode AS profile_mode, CASE WHEN status <> 'active' THEN -1 ELSE
    CASE WHEN target_role <> '' AND contains(tk, target_role) THEN 30 ELSE 0 END
    + CASE WHEN len(list_filter(titles, lambda x: x <> target_role AND x <> '' AND contains(tk, x))) > 0 THEN 20 ELSE 0 END
    + least(30, 5 * len(list_filter(skills, lambda x: length(x) >= 2 AND contains(dk, x))))
    + least(20, 2 * len(list_filter(keywords, lambda x: length(x) >= 3 AND NOT list_contains(skills, x) AND contains(dk, x))))
    + CASE WHEN location_mode = 'cities' AND lk <> '' AND len(list_filter(locations, lambda w: contains(lk, w))) > 0 THEN 15 ELSE 0 END
    + CASE WHEN p.work_mode = 'any' OR l.work_mode IS NULL THEN 0 WHEN p.work_mode = l.work_mode THEN 15 WHEN 'hybrid' IN (p.work_mode, l.work_mode) THEN 8 ELSE 0 END
    + CASE WHEN {NOW} - l.last_seen <= 14 * 86400 THEN 10 ELSE 0 END + CASE WHEN length(trim(description)) > 0 THEN 5 ELSE 0 END END AS cheap_score
  FROM retrieved JOIN profiles p USING (profile_id) JOIN listing_keys l USING (listing_id)
)"""


def cheap(t, pairs=None):
    pairs = cut(retrieved(t).select("profile_id", "listing_id")) if pairs is None else pairs
    return sc.score_pairs(pairs.select("profile_id", "listing_id"), t.profiles, of_pairs(t.base_listings, pairs), now())


@query("cheap_score_topk", s.with_(*BASE, _CHEAP) + f"""
SELECT profile_id, listing_id, cheap_score, row_number() OVER (PARTITION BY profile_id ORDER BY cheap_score DESC, listing_id) AS position FROM cheap
QUALIFY position <= {lx.PREFILTER_LIMIT}
""")
def cheap_score_topk(t):
    return sc.top_per_profile(cheap(t)).select("profile_id", "listing_id", "cheap_score", "position")


_QUOTA = f"""
sided AS (
  SELECT *, country <> 'en' AS is_foreign, greatest(2, floor({lx.PREFILTER_LIMIT} * CASE WHEN profile_mode = 'remote' THEN 0.4 ELSE 0.2 END + 0.5)) AS seats,
    row_number() OVER (PARTITION BY profile_id, country <> 'en' ORDER BY cheap_score DESC, listing_id) AS r,
    count(*) FILTER (country <> 'en') OVER (PARTITION BY profile_id) AS nf, count(*) FILTER (country = 'en') OVER (PARTITION BY profile_id) AS nd
  FROM {{0}}
),
seated AS (SELECT *, least(nd, {lx.PREFILTER_LIMIT} - least(nf, seats)) AS domestic FROM sided),
quota AS (
  SELECT profile_id, listing_id, cheap_score, is_foreign, row_number() OVER (PARTITION BY profile_id ORDER BY cheap_score DESC, listing_id) AS position
  FROM seated WHERE r <= CASE WHEN is_foreign THEN {lx.PREFILTER_LIMIT} - domestic ELSE domestic END
)"""


def quota(scored):
    return sc.country_quota(scored, c("country") != "en", c("profile_mode") == "remote")


@query("quota_topk", s.with_(*BASE, _CHEAP, _QUOTA.format("cheap")) + "SELECT profile_id, listing_id, cheap_score, is_foreign, position FROM quota")
def quota_topk(t):
    return quota(cheap(t)).select("profile_id", "listing_id", "cheap_score", "is_foreign", "position")


_RANKED = "kept AS (SELECT * FROM cheap JOIN city_ok USING (profile_id, listing_id) JOIN gate USING (profile_id, listing_id) WHERE kept AND relevant)"


@query("ranked_listings", s.with_(*BASE, _PTERMS, _GATE, _CITY, _CHEAP, _RANKED, _QUOTA.format("kept")) + "SELECT profile_id, listing_id, cheap_score, is_foreign, position FROM quota")
def ranked_listings(t):
    """Retrieval, city filter, relevance gate, cheap score and country quota for all profiles."""
    pairs = cut(retrieved(t).select("profile_id", "listing_id"))
    near = _in_city(t, pairs).filter("kept")
    related = (
        near.join(_terms(t), "profile_id").join(_sides(t, pairs), "listing_id")
        .filter(rt.relevance(c("terms"), c("head"), c("body"))).select("profile_id", "listing_id")
    )
    return quota(cheap(t, cut(related))).select("profile_id", "listing_id", "cheap_score", "is_foreign", "position")


@query("budgeted_topk", s.with_(*BASE, _CHEAP) + """
SELECT profile_id, listing_id, row_number() OVER (PARTITION BY profile_id ORDER BY cheap_score DESC, listing_id) > affordable AS deferred
FROM cheap JOIN (SELECT profile_id, greatest(0, floor(greatest(0, 20000 + profile_id * 1000) / CASE WHEN n > 0 THEN least(6000.0, greatest(400.0, 30000.0 / n)) ELSE 1500.0 END)) AS affordable
  FROM (SELECT profile_id, profile_id % 50 AS n FROM profiles)) USING (profile_id)
""")
def budgeted_topk(t):
    n = c("profile_id") % 50
    affordable = sc.affordable_count(20000 + c("profile_id") * 1000, F.lit(30000.0), n)
    scored = cheap(t).withColumn("affordable", affordable)
    return sc.budgeted(scored, "affordable").select("profile_id", "listing_id", "deferred")


@query("freshness_bands", f"""
SELECT label, adjust, count(*) AS n, min(age) AS youngest, max(age) AS oldest FROM (
  SELECT age, CASE WHEN age IS NULL THEN 0 WHEN age <= 3 THEN 3 WHEN age <= 7 THEN 1 WHEN age <= 20 THEN 0 ELSE -2 END AS adjust,
    CASE WHEN age <= 3 THEN 'new' WHEN age <= 7 THEN 'recent' WHEN age > 20 THEN 'old' END AS label
  FROM (SELECT greatest(0, floor((epoch(TIMESTAMP '1998-07-01') - epoch(o_orderdate)) / 86400)) AS age FROM orders)) GROUP BY label, adjust
""")
def freshness_bands(t):
    fresh = sc.freshness(c("o_orderdate").cast("timestamp"), F.lit("1998-07-01").cast("timestamp"))
    rows = t.orders.select(fresh.alias("f")).select("f.*")
    return rows.groupBy("label", "adjust").agg(
        F.count("*").alias("n"), F.min("age_days").alias("youngest"), F.max("age_days").alias("oldest")
    )


# --- eligibility ---------------------------------------------------------------------------

_SEN = "CASE {0} WHEN 'stajyer' THEN 0 WHEN 'junior' THEN 1 WHEN 'orta' THEN 2 WHEN 'senior' THEN 3 WHEN 'lead' THEN 4 ELSE -1 END"


def _coverage(hay: str, terms: str, empty: str) -> str:
    return (
        f"CASE WHEN {empty} OR {hay} = '' OR len({terms}) = 0 THEN 0.0 ELSE least(1.0, CAST(len(list_filter({terms}, lambda x: length(x) >= 2 "
        f"AND contains({hay}, x))) AS DOUBLE) / greatest(3, least(len({terms}), 10))) END"
    )


_ROLE = f"""
roles AS (
  SELECT listing_id, title, location, coalesce(work_mode, 'any') AS role_mode, min_years, accepts_none, education_kind, wants_english,
    {s.first_match(s.fold("title || chr(10) || description"), lx.EMPLOYMENT_PATTERNS)} AS employment,
    {s.first_match(s.fold("title || chr(10) || description"), lx.SENIORITY_PATTERNS)} AS role_seniority,
    list_filter(CASE WHEN len(requirements) > 0 THEN requirements ELSE []::VARCHAR[] END, lambda x: NOT regexp_matches(x, {s.q(lx.PREFERRED_MARKERS)})) AS required,
    list_filter(requirements, lambda x: regexp_matches(x, {s.q(lx.PREFERRED_MARKERS)})) AS preferred
  FROM listings WHERE len(requirements) > 0
)"""
_EVAL = f"""
sided_pairs AS (
  SELECT profile_id, listing_id, r.* EXCLUDE (listing_id), p.* EXCLUDE (profile_id),
    {_SEN.format('role_seniority')} AS rr, {_SEN.format('seniority')} AS cr,
    (says_student OR seniority = 'stajyer' OR wants_internship) AS student,
    {s.norm("array_to_string(required, ' ')")} AS req_hay, {s.norm("array_to_string(preferred, ' ')")} AS pref_hay,
    {s.norm("array_to_string(required || preferred, ' ')")} AS all_hay, {s.norm('title')} AS title_hay, {s.norm("coalesce(location, '')")} AS lk
  FROM retrieved JOIN roles r USING (listing_id) JOIN profiles p USING (profile_id)
),
facts AS (
  SELECT *, role_mode <> 'remote' AND work_mode <> 'remote' AND location IS NOT NULL AS away,
    len(list_filter(locations, lambda w: contains(lk, w))) > 0 AS city_hit,
    len(list_filter(languages, lambda x: contains(x, 'ingilizce'))) > 0 AS speaks,
    len(list_filter(string_split(lk, ' '), lambda x: x IN ('en', 'de'))) > 0 AS at_home
  FROM sided_pairs
),
scored AS (
  SELECT *,
    list_filter([
      CASE WHEN education_kind = 0 AND student THEN 'graduate-required' END,
      CASE WHEN education_kind < 2 AND education_rank < CASE education_kind WHEN 0 THEN 2 ELSE 0 END THEN 'education-level' END,
      CASE WHEN NOT accepts_none AND years < min_years THEN 'experience-below-min' END,
      CASE WHEN rr >= 3 AND cr BETWEEN 0 AND 1 THEN 'seniority-mismatch' END,
      CASE WHEN wants_internship AND employment <> 'staj' AND rr >= 3 THEN 'employment-mismatch' END,
      CASE WHEN location_mode = 'cities' AND len(locations) > 0 AND away AND NOT city_hit THEN 'location-mismatch' END,
      CASE WHEN away AND NOT at_home THEN 'abroad-listing' END,
      CASE WHEN wants_english AND len(languages) > 0 AND NOT speaks THEN 'language-missing' END], lambda x: x IS NOT NULL) AS blockers,
    CASE WHEN years IS NULL THEN 12.0 WHEN accepts_none THEN 20.0 WHEN years >= min_years THEN 20.0 ELSE 0.0 END AS p_experience,
    CASE WHEN rr < 0 THEN 10.5 WHEN cr < 0 THEN 9.0 WHEN rr = cr THEN 15.0 WHEN abs(rr - cr) = 1 THEN 9.0 ELSE 0.0 END AS p_type,
    CASE WHEN education_kind = 2 THEN 7.0 WHEN education_rank IS NULL THEN 6.0
      WHEN education_kind = 0 THEN CASE WHEN education_rank >= 2 THEN CASE WHEN student THEN 4.0 ELSE 10.0 END ELSE 0.0 END
      ELSE CASE WHEN (education_rank >= 0 AND NOT student) OR education_rank >= 2 THEN 10.0 WHEN education_rank >= 0 THEN 4.0 ELSE 0.0 END END AS p_education,
    CASE WHEN work_mode = 'remote' OR role_mode = 'remote' THEN 10.0 WHEN location_mode <> 'cities' OR len(locations) = 0 THEN 8.0
      WHEN location IS NULL THEN 6.0 WHEN city_hit THEN 10.0 ELSE 0.0 END AS p_location,
    CASE WHEN NOT wants_english THEN 4.0 WHEN speaks THEN 5.0 ELSE 0.0 END AS p_language,
    CASE WHEN len(required) = 0 THEN CAST(10.5 AS DOUBLE) ELSE CAST(15 AS DOUBLE) * {_coverage('req_hay', 'skills', 'false')} END AS t_required,
    CASE WHEN len(preferred) = 0 THEN CAST(7.0 AS DOUBLE) ELSE CAST(10 AS DOUBLE) * {_coverage('pref_hay', 'skills', 'false')} END AS t_preferred,
    CAST(10 AS DOUBLE) * {_coverage('all_hay', 'keywords', 'false')} AS t_relation,
    CAST(5 AS DOUBLE) * {_coverage('title_hay', 'skills', 'false')} AS t_keywords,
    1 + CASE WHEN education_kind < 2 THEN 1 ELSE 0 END + CASE WHEN wants_english THEN 1 ELSE 0 END + CASE WHEN employment <> 'belirtilmemis' THEN 1 ELSE 0 END
      + CASE WHEN role_seniority <> 'belirtilmemis' THEN 1 ELSE 0 END AS fields
  FROM facts
),
evaluated AS (
  SELECT profile_id, listing_id, len(blockers) = 0 AS eligible, blockers,
    p_experience + p_type + p_education + p_location + p_language AS role_points, t_required + t_preferred + t_relation + t_keywords AS tech_points,
    CAST(floor((p_experience + p_type + p_education + p_location + p_language) + (t_required + t_preferred + t_relation + t_keywords) + 0.5) AS INTEGER) AS total, fields
  FROM scored
)"""
_BAND = "CASE WHEN {0} >= 90 THEN 'cok-guclu' WHEN {0} >= 80 THEN 'cok-uygun' WHEN {0} >= 70 THEN 'uygun' WHEN {0} >= 60 THEN 'sinirda' ELSE 'uygun-degil' END"
EVALUATED = (*BASE, _ROLE, _EVAL)


def evaluated(t, pairs=None):
    pairs = cut(retrieved(t).select("profile_id", "listing_id")) if pairs is None else pairs
    roles = required(t, pairs).select("listing_id", "title", el.listing_role().alias("role"))
    who = t.profiles.select("profile_id", el.profile_candidate().alias("who"))
    joined = t.dealt(pairs.select("profile_id", "listing_id"), "listing_id").join(roles, "listing_id").join(who, "profile_id")
    verdict = el.evaluate(c("role"), c("who"), F.array("title"), True, HOME_CITIES)
    # a generator runs once a pair; a projection would be computed again by every filter on the verdict
    return joined.select("profile_id", "listing_id", F.inline(F.array(verdict)))


@query("eligibility", s.with_(*EVALUATED) + f"""
SELECT profile_id, listing_id, eligible, array_to_string(blockers, ',') AS blockers, {s.round_half_up('role_points', 1)} AS role_score,
  {s.round_half_up('tech_points', 1)} AS technical_score, total, {_BAND.format('total')} AS band,
  CASE WHEN fields >= 3 THEN 'high' WHEN fields >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM evaluated
""")
def eligibility(t):
    return evaluated(t).select(
        "profile_id", "listing_id", "eligible", F.array_join(F.transform("blockers", lambda b: b["code"]), ",").alias("blockers"),
        "role_score", "technical_score", "total", "band", "confidence",
    )


_PARTS = {
    "experience": ("p_experience", 20), "role-type": ("p_type", 15), "education": ("p_education", 10), "location": ("p_location", 10), "language": ("p_language", 5),
    "required-skills": ("t_required", 15), "preferred-skills": ("t_preferred", 10), "experience-relation": ("t_relation", 10), "listing-keywords": ("t_keywords", 5),
}
_PART_ROWS = " UNION ALL ".join(
    f"SELECT profile_id, listing_id, {s.q(k)} AS key, round({column}, 4) AS earned, {most} AS max, length({s.q(el.COMPONENT_LABELS[k])}) AS label_chars, true AS told FROM scored"
    for k, (column, most) in _PARTS.items()
)


@query("score_components", s.with_(*EVALUATED) + _PART_ROWS)
def score_components(t):
    """Every part of every pair's score with its label and what was compared."""
    pairs = cut(retrieved(t).select("profile_id", "listing_id"))
    roles = required(t, pairs).select("listing_id", "title", el.listing_role().alias("role"))
    who = t.profiles.select("profile_id", el.profile_candidate().alias("who"))
    joined = t.dealt(pairs, "listing_id").join(roles, "listing_id").join(who, "profile_id")
    parts = F.concat(el.role_components(c("role"), c("who")), el.technical_components(c("role"), c("who"), F.array("title")))
    told = joined.select("profile_id", "listing_id", F.explode(el.explained(parts, c("role"), c("who"), F.array("title"))).alias("x"))
    return told.select(
        "profile_id", "listing_id", "x.key", F.round("x.earned", 4).alias("earned"), "x.max", F.length("x.label").alias("label_chars"),
        (F.length("x.detail") > 5).alias("told"),
    )


@query("eligibility_audit", s.with_(*EVALUATED) + """
SELECT profile_id, count(*) AS listings, count(*) FILTER (eligible) AS eligible, CAST(floor(avg(CASE WHEN eligible THEN 1.0 ELSE 0.0 END) * 100 + 0.5) AS INTEGER) AS pass_percent,
  floor(avg(CASE WHEN eligible THEN 1.0 ELSE 0.0 END) * 100 + 0.5) < 10 AS over_rejected FROM evaluated GROUP BY profile_id
""")
def eligibility_audit(t):
    return el.audit(evaluated(t))


@query("blocker_histogram", s.with_(*EVALUATED) + "SELECT profile_id, code, count(*) AS n FROM (SELECT profile_id, unnest(blockers) AS code FROM evaluated) GROUP BY ALL")
def blocker_histogram(t):
    return el.blocker_histogram(evaluated(t))


@query("band_histogram", s.with_(*EVALUATED) + f"SELECT profile_id, {_BAND.format('total')} AS band, count(*) AS n FROM evaluated WHERE eligible GROUP BY ALL")
def band_histogram(t):
    return el.band_histogram(evaluated(t))


@query("priority_order", s.with_(*EVALUATED) + f"""
SELECT profile_id, listing_id, row_number() OVER (PARTITION BY profile_id ORDER BY eligible DESC, floor({s.round_half_up('role_points', 1)} / 5) DESC,
  floor(CASE WHEN len(required) = 0 THEN 0.0 ELSE t_required / 15 END / 0.15) DESC, total DESC, posted_s DESC, listing_id) AS position
FROM evaluated JOIN (SELECT profile_id, listing_id, required, t_required FROM scored) USING (profile_id, listing_id) JOIN (SELECT listing_id, posted_s FROM listings) USING (listing_id)
""")
def priority_order(t):
    from pyspark.sql import Window

    posted = t.base_listings.select("listing_id", "posted_at")
    by = Window.partitionBy("profile_id").orderBy(*sc.priority_order())
    return evaluated(t).join(posted, "listing_id").select("profile_id", "listing_id", F.row_number().over(by).alias("position"))


# --- blending ------------------------------------------------------------------------------

_SEMANTIC = """
vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
semantic AS (
  SELECT profile_id, listing_id, CAST(floor(50 + 50 * dot / sqrt(aa * bb) + 0.5) AS INTEGER) AS semantic FROM (
    SELECT profile_id, listing_id, list_dot_product(a.v, b.v) AS dot, list_dot_product(a.v, a.v) AS aa, list_dot_product(b.v, b.v) AS bb
    FROM retrieved JOIN vectors a ON a.vec_id = profile_id JOIN vectors b ON b.vec_id = listing_id)
)"""
_BLEND = f"""
blend_in AS (
  SELECT e.profile_id, e.listing_id, eligible, {s.round_half_up('role_points', 1)} AS role_score, {s.round_half_up('tech_points', 1)} AS technical_score, cheap_score, semantic,
    CASE WHEN posted_s IS NULL THEN 0 WHEN ({NOW} - posted_s) / 86400 <= 3 THEN 3 WHEN ({NOW} - posted_s) / 86400 <= 7 THEN 1 WHEN ({NOW} - posted_s) / 86400 <= 20 THEN 0 ELSE -2 END AS adjust,
    posted_s, count(semantic) OVER (PARTITION BY e.profile_id) > 0 AS known, row_number() OVER (PARTITION BY e.profile_id ORDER BY cheap_score DESC, e.listing_id) AS r
  FROM evaluated e JOIN cheap c ON c.profile_id = e.profile_id AND c.listing_id = e.listing_id JOIN listings l ON l.listing_id = e.listing_id
  LEFT JOIN semantic m ON m.profile_id = e.profile_id AND m.listing_id = e.listing_id
),
blended AS (
  SELECT *, CASE WHEN known THEN CAST(floor(greatest(0.0, least(100.0, role_score + (technical_score + semantic / 100.0 * 40) / 2 + adjust)) + 0.5) AS INTEGER)
      WHEN coalesce(cheap_score, 0) <= 0 THEN 20 ELSE CAST(least(55, greatest(20, floor(cheap_score * 0.6 + 0.5))) AS INTEGER) END AS match_score,
    CASE WHEN NOT known THEN 'low' WHEN semantic >= 75 THEN 'high' WHEN semantic >= 50 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN known AND semantic >= 70 THEN 'recommended' ELSE 'general' END AS category
  FROM blend_in WHERE CASE WHEN known THEN semantic >= {lx.RELEVANCE_FLOOR} ELSE r <= 10 END
)"""
BLENDED = (*EVALUATED, _CHEAP, _SEMANTIC, _BLEND)


def blended(t):
    pairs = cut(retrieved(t).select("profile_id", "listing_id"))
    vectors = t.read("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a = vectors.select(c("vec_id").alias("profile_id"), c("v").alias("a"))
    b = vectors.select(c("vec_id").alias("listing_id"), c("v").alias("b"))

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z)

    cosine = dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))
    semantic = pairs.join(a, "profile_id").join(b, "listing_id").select(
        "profile_id", "listing_id", F.floor(50 + 50 * cosine + 0.5).cast("int").alias("semantic")
    )
    posted = t.base_listings.select("listing_id", "posted_at", "category")
    scores = cheap(t, pairs).select("profile_id", "listing_id", "cheap_score")
    rows = (
        evaluated(t, pairs).join(scores, ["profile_id", "listing_id"]).join(posted, "listing_id")
        .withColumn("adjust", sc.freshness(c("posted_at"), now())["adjust"])
        .select("profile_id", "listing_id", "eligible", "role_score", "technical_score", "adjust", "cheap_score", "category", "posted_at")
    )
    return sc.with_semantic(rows, semantic)


@query("semantic_blend", s.with_(*BLENDED) + f"SELECT profile_id, listing_id, match_score, confidence, category, CASE WHEN known THEN {_BAND.format('match_score')} END AS band FROM blended")
def semantic_blend(t):
    return blended(t).select("profile_id", "listing_id", "match_score", "confidence", "category", "band")


@query("final_results", s.with_(*BLENDED) + f"""
SELECT profile_id, listing_id, match_score, eligible, row_number() OVER (PARTITION BY profile_id ORDER BY eligible DESC, match_score DESC, posted_s DESC, listing_id) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, eligible ORDER BY match_score DESC, listing_id) AS k FROM blended)
WHERE k <= CASE WHEN eligible THEN {lx.RESULT_LIMIT} ELSE {lx.REJECTED_LIMIT} END
""")
def final_results(t):
    from pyspark.sql import Window

    by = Window.partitionBy("profile_id").orderBy(*sc.result_order())
    kept = sc.results_with_rejected(blended(t))
    return kept.select("profile_id", "listing_id", "match_score", "eligible", F.row_number().over(by).alias("position"))


HEAT_WORDS = ["the", "and", "for", "with", "nicht", "auch", "avec", "pour", "dans", "les", "que", "of the", "que la", "worthless", "tion", "und", "de la"]


_HEAT_GREEDY = "|".join(sorted(HEAT_WORDS, key=len, reverse=True))


@query("role_heatmap", s.with_(*BASE) + f""",
texts AS (SELECT listing_id, concat_ws(chr(10), title, description) AS x FROM base_listings),
found AS (SELECT listing_id, unnest(list_distinct(regexp_extract_all({s.fold('x')}, '({_HEAT_GREEDY})', 1))) AS skill, ' ' || {s.norm('x')} || ' ' AS t FROM texts),
skilled AS (SELECT listing_id, skill FROM found WHERE CASE WHEN contains(skill, ' ') THEN contains(t, skill) ELSE contains(t, ' ' || skill || ' ') END),
counts AS (SELECT profile_id, skill, count(*) AS n FROM retrieved JOIN skilled USING (listing_id) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, skill) AS position FROM counts)
SELECT profile_id, CAST(position AS INTEGER) AS position, skill, n, round(n * 1.0 / total, 6) AS share,
  CASE WHEN list_contains(skills, skill) THEN 'present' WHEN len(list_filter(skills, lambda o: o <> skill AND length(o) >= 4 AND length(skill) >= 4 AND (contains(o, skill) OR contains(skill, o)))) > 0
    THEN 'partial' ELSE 'missing' END AS status
FROM placed JOIN (SELECT profile_id, count(*) AS total FROM retrieved GROUP BY profile_id) USING (profile_id) JOIN profiles USING (profile_id) WHERE position <= 20
""")
def role_heatmap(t):
    """Skill heat map per profile over its retrieved listings; the dictionary is a table, each listing is read once."""
    own = t.profiles.select("profile_id", c("skills").alias("own_skills"))
    dictionary = t.spark.createDataFrame([(w,) for w in HEAT_WORDS], "label string")
    texts = t.base_listings.select("listing_id", F.concat_ws("\n", "title", "description").alias("text"))
    pairs = cut(retrieved(t).select("profile_id", "listing_id"))
    return dc.heatmap_by(pairs, texts, dictionary, own).withColumn("share", F.round("share", 6))


_PHRASES = f"""
terms AS (SELECT {s.words(s.norm('text'))} AS w FROM benchmark),
dictionary AS (
  SELECT DISTINCT label FROM (
    SELECT unnest(w) AS label FROM terms UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM terms) WHERE length(label) >= {dc.SHORTEST}
)"""


@query("dictionary_skills", f"""
WITH {_PHRASES}, d AS (SELECT doc_id, {s.fold('text')} AS t FROM documents),
p AS (SELECT doc_id, any_value(t) AS t, string_agg(replace(replace(label, '.', '[.]'), '+', '[+]'), '|' ORDER BY length(label) DESC, label) AS pattern FROM d JOIN dictionary ON contains(t, label) GROUP BY doc_id),
f AS (SELECT doc_id, regexp_extract_all(t, '(' || pattern || ')', 1) AS f FROM p)
SELECT doc_id, array_to_string({ordered_distinct('f')}, '|') AS skills FROM f
""")
def dictionary_skills(t):
    """Every word and pair of words of the profile texts is a phrase of the dictionary, sought in every document."""
    w = F.split(tx.normalize(c("text")), " ")
    words = t.read("benchmark").select(tx.let(w, lambda x: F.concat(x, F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.size(x)), lambda a, b: F.concat_ws(" ", a, b)))).alias("labels"))
    dictionary = words.select(F.explode("labels").alias("label")).distinct()
    found = dc.known_skills(t.documents.select("doc_id", "text"), dictionary, "doc_id")
    return found.select("doc_id", F.array_join("skills", "|").alias("skills"))
