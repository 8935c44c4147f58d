"""Extraction, CV section, heat map and profile-side queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import extract as ex
from postmill.functions import profile as pf
from postmill.functions import text as tx
from postmill.operators import analytics as an
from postmill.operators import retrieve as rt
from postmill.plans import sqltext as s
from postmill.plans.matching_queries import HEAT_WORDS, ordered_distinct
from postmill.plans.registry import query
from postmill.session import cut
from postmill.sources import pages as pg

c = F.col

_HEAT_KEYS = sorted(HEAT_WORDS, key=len, reverse=True)
_GREEDY = "|".join(k.replace(".", "[.]") for k in _HEAT_KEYS)
OWN = ["the", "avec", "que", "ontion"]
_OWN = "[" + ", ".join(s.q(x) for x in OWN) + "]"
_FULL_TEXT = "title || chr(10) || description"


@query("skill_heatmap", s.with_(s.LISTINGS) + f"""
SELECT skill, n, round(n * 1.0 / total, 6) AS share, total AS sample_size, total >= 5 AS confident,
  CASE WHEN list_contains({_OWN}, skill) THEN 'present' WHEN len(list_filter({_OWN}, lambda o: o <> skill AND length(o) >= 4 AND length(skill) >= 4 AND (contains(o, skill) OR contains(skill, o)))) > 0
    THEN 'partial' ELSE 'missing' END AS status
FROM (
  SELECT skill, count(*) AS n FROM (
    SELECT listing_id, unnest(list_distinct(regexp_extract_all({s.fold(_FULL_TEXT)}, '({_GREEDY})', 1))) AS skill, {s.norm(_FULL_TEXT)} AS t FROM base_listings)
  WHERE CASE WHEN contains(skill, ' ') THEN contains(t, skill) ELSE list_contains(string_split(t, ' '), skill) END GROUP BY skill
), (SELECT count(*) AS total FROM base_listings) ORDER BY n DESC, skill LIMIT 20
""")
def skill_heatmap(t):
    none = F.array().cast("array<string>")
    rows = t.base_listings.withColumn("requirements", none).withColumn("candidate_criteria", none)
    return an.skill_heatmap(rows, HEAT_WORDS, OWN).withColumn("share", F.round("share", 6))


@query("known_skills", f"""
SELECT doc_id, array_to_string({ordered_distinct('f')}, '|') AS skills FROM (SELECT doc_id, regexp_extract_all({s.fold('text')}, '({_GREEDY})', 1) AS f FROM documents)
""")
def known_skills(t):
    return t.documents.select("doc_id", F.array_join(ex.known_skills(c("text"), HEAT_WORDS), "|").alias("skills"))


@query("skill_segments", None)
def skill_segments(t):
    """Every line run together into one block and split back into dictionary terms."""
    rows = t.documents.select("doc_id", F.posexplode(pf.lines(c("text"))).alias("pos", "line"))
    blocks = rows.select("doc_id", "pos", F.regexp_replace(F.initcap("line"), r"\s+", "").alias("block"))
    parts = blocks.select("doc_id", "pos", ex.split_skill_segment(c("block"), HEAT_WORDS).alias("parts"))
    return parts.select("doc_id", "pos", F.array_join("parts", "|").alias("parts"), F.size("parts").alias("n"))


_EDGE = "[^a-z0-9+#.]"
_BOUND = " || ".join(
    f"CASE WHEN regexp_matches(t, {s.q(f'(^|{_EDGE}){w}({_EDGE}|$)')}) THEN [{s.q(w)}] ELSE []::VARCHAR[] END" for w in HEAT_WORDS
)


@query("listing_terms", s.with_(s.FULL_LISTINGS) + f"""
SELECT listing_id, array_to_string(list_filter(f, lambda x: len(list_filter(f, lambda y: length(y) > length(x) AND contains(y, x))) = 0), '|') AS skills,
  array_to_string(list_filter({ordered_distinct('requirements')}, lambda x: length(x) BETWEEN 12 AND 160), '|') AS requirements
FROM (SELECT listing_id, requirements, {_BOUND} AS f FROM (
  SELECT listing_id, requirements, {s.fold("title || chr(10) || array_to_string(requirements, chr(10)) || chr(10) || coalesce(description, '')")} AS t FROM listings))
""")
def listing_terms(t):
    none = F.array().cast("array<string>")
    terms = ex.listing_terms(c("title"), c("description"), c("requirements"), none, HEAT_WORDS)
    return t.listings.select("listing_id", terms.alias("x")).select(
        "listing_id", F.array_join("x.skills", "|").alias("skills"), F.array_join("x.requirements", "|").alias("requirements")
    )


def _evidence_sql(term: str) -> str:
    bounded = "regexp_replace(hay, '[^a-z0-9]', ' ', 'g')"
    return (
        f"(length({term}) >= 2 AND (list_contains(declared, {term}) OR CASE WHEN length({term}) <= 3 THEN contains(' ' || {bounded} || ' ', ' ' || {term} || ' ') "
        f"ELSE contains(hay, {term}) OR len(list_filter(declared, lambda d: length(d) >= 3 AND (contains(d, {term}) OR contains({term}, d)))) > 0 END))"
    )


_EVIDENCE = f"""
evidence AS (SELECT profile_id, keywords AS terms, skills AS declared, {s.norm("coalesce(text, '')")} AS hay
  FROM profiles LEFT JOIN (SELECT item_id + 1 AS profile_id, text FROM benchmark) USING (profile_id))"""


@query("keyword_alignment", s.with_(s.PROFILES, _EVIDENCE) + f"""
SELECT profile_id, term, CASE WHEN {_evidence_sql('term')} THEN 'covered' ELSE 'missing' END AS status FROM (SELECT *, unnest(terms) AS term FROM evidence)
""")
def keyword_alignment(t):
    """A profile's keywords against the text of another one and its own declared skills."""
    texts = t.read("benchmark").select((c("item_id") + 1).alias("profile_id"), tx.normalize(c("text")).alias("hay"))
    rows = t.profiles.join(texts, "profile_id", "left").withColumn("hay", F.coalesce("hay", F.lit("")))  # the first has no text
    aligned = pf.keyword_alignment(c("keywords"), c("hay"), c("skills"))
    return rows.select("profile_id", F.explode(aligned).alias("x")).select("profile_id", "x.term", "x.status")


@query("gap_report", None)
def gap_report(t):
    """Missing terms of each retrieved listing for its profile; terms are extracted once per listing."""
    none = F.array().cast("array<string>")
    pairs = cut(rt.retrieve(t.profiles, t.base_listings).select("profile_id", "listing_id"))
    texts = t.read("benchmark").select(c("item_id").alias("profile_id"), tx.normalize(c("text")).alias("hay"))
    profiles = t.profiles.select("profile_id", "skills").join(texts, "profile_id")
    terms = ex.listing_terms(c("title"), c("description"), c("requirements"), none, HEAT_WORDS)
    retrieved = t.listings.join(pairs.select("listing_id").distinct(), "listing_id", "left_semi")
    listings = cut(retrieved.select("listing_id", terms.alias("terms")))
    rows = pairs.join(listings, "listing_id").join(profiles, "profile_id")
    found = rows.select("profile_id", "listing_id", F.explode(pf.gaps(c("terms"), c("hay"), c("skills"))).alias("g"))
    return found.select("profile_id", "listing_id", "g.requirement", "g.severity", F.array_join("g.missing", "|").alias("missing"))


@query("role_criteria", s.with_(s.FULL_LISTINGS) + """
SELECT listing_id, min_years, accepts_none AS accepts_no_experience,
  CASE education_kind WHEN 0 THEN 'universite:false:true' WHEN 1 THEN 'lise:false:true,universite:true:false' ELSE '' END AS education, education_kind = 0 AS requires_graduate,
  education_kind = 1 AS accepts_student, CASE WHEN wants_english THEN 'İngilizce:ileri' ELSE '' END AS languages FROM listings
""")
def role_criteria(t):
    criteria = c("candidate_criteria")

    def lines(pattern):
        return F.get(F.filter(criteria, lambda x: tx.fold(x).rlike(pattern)), F.lit(0))

    education = F.coalesce(ex.education_requirement(lines("^egitim")), F.array().cast("array<struct<level:string,student:boolean,graduate:boolean>>"))
    languages = F.coalesce(ex.language_requirement(lines("^yabanci")), F.array().cast("array<struct<language:string,level:string>>"))
    rows = t.listings.select(
        "listing_id", ex.experience_requirement(lines("^tecrube")).alias("e"), education.alias("ed"), languages.alias("la")
    )
    return rows.select(
        "listing_id", "e.min_years", "e.accepts_no_experience",
        F.array_join(F.transform("ed", lambda x: F.concat_ws(":", x["level"], x["student"].cast("string"), x["graduate"].cast("string"))), ",").alias("education"),
        ((F.size("ed") > 0) & F.forall("ed", lambda x: x["graduate"] & ~x["student"])).alias("requires_graduate"),
        F.exists("ed", lambda x: x["student"]).alias("accepts_student"),
        F.array_join(F.transform("la", lambda x: F.concat_ws(":", x["language"], x["level"])), ",").alias("languages"),
    )


@query("role_labels", s.with_(s.LISTINGS) + f"""
SELECT listing_id, {s.first_match(s.fold('x'), lx.EMPLOYMENT_PATTERNS)} AS employment, {s.first_match(s.fold('x'), lx.SENIORITY_PATTERNS)} AS seniority
FROM (SELECT listing_id, description || CASE listing_id % 6 WHEN 0 THEN ' Tam Zamanlı Kıdemli' WHEN 1 THEN ' part-time JUNIOR' WHEN 2 THEN ' STAJYER' WHEN 3 THEN ' Takım Lideri' ELSE '' END AS x FROM base_listings)
""")
def role_labels(t):
    i = c("listing_id") % 6
    tail = F.when(i == 0, " Tam Zamanlı Kıdemli").when(i == 1, " part-time JUNIOR").when(i == 2, " STAJYER").when(i == 3, " Takım Lideri").otherwise("")
    text = F.concat("description", tail)
    return t.base_listings.select("listing_id", ex.employment_type(text).alias("employment"), ex.seniority(text).alias("seniority"))


_NOISE_CUT = "t0"
for _i, _marker in enumerate(lx.CRITERIA_NOISE):
    _NOISE_CUT = f"CASE WHEN instr({_NOISE_CUT}, {s.q(_marker)}) > 1 THEN substr({_NOISE_CUT}, 1, instr({_NOISE_CUT}, {s.q(_marker)}) - 1) ELSE {_NOISE_CUT} END" if _i == 0 else _NOISE_CUT


@query("criteria_noise", f"""
SELECT doc_id, md5({s.squeeze(_NOISE_CUT)}) AS digest FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' Yapay zeka ile ' || text ELSE 'Yapay zeka ' || text END AS t0 FROM documents)
""")
def criteria_noise(t):
    even = F.concat("text", F.lit(" Yapay zeka ile "), "text")
    line = F.when(c("doc_id") % 2 == 0, even).otherwise(F.concat(F.lit("Yapay zeka "), "text"))
    return t.documents.select("doc_id", F.md5(ex.strip_criteria_noise(line)).alias("digest"))


_CODE = """(t = '' OR (regexp_matches(t, '[{};]\\s*[a-zA-Z_$][\\w$]*\\s*:') AND regexp_matches(t, '[{}]')) OR (length(t) - length(regexp_replace(t, '[{}\\[\\]<>=;|]', '', 'g'))) / length(t) > 0.08)"""


@query("requirement_split", f"""
WITH clean AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, {s.squeeze('text')} AS x FROM documents),
parts AS (
  SELECT doc_id, x, list_filter(list_transform(string_split(regexp_replace(regexp_replace(x, '([.;])\\s+', '\\1' || chr(10), 'g'), ',\\s([A-ZÇĞİÖŞÜ])', ',' || chr(10) || '\\1', 'g'), chr(10)),
    lambda p: trim(p)), lambda p: length(p) >= 8) AS ps FROM clean WHERE NOT {_CODE} AND length(x) >= 8
),
split AS (SELECT doc_id, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [x] END) AS p FROM parts)
SELECT doc_id, count(*) FILTER (NOT m) AS required, count(*) FILTER (m) AS preferred, sum(length(p)) AS chars FROM (
  SELECT doc_id, p, regexp_matches({s.fold('p')}, {s.q(lx.PREFERRED_MARKERS)}) AS m FROM split) GROUP BY doc_id
""")
def requirement_split(t):
    # a generator runs once a row; a projection would be computed again by the filter and by every use of its fields
    rows = t.documents.select("doc_id", F.inline(F.array(ex.split_requirements(F.array("text"))))).filter((F.size("required") + F.size("preferred")) > 0)
    chars = F.aggregate(F.concat("required", "preferred"), F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    return rows.select("doc_id", F.size("required").alias("required"), F.size("preferred").alias("preferred"), chars.alias("chars"))


_MARK = "(nicht|avec|worthless|pour)"


@query("section_sentences", f"""
SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (
  SELECT doc_id, CASE WHEN regexp_matches({s.fold('text')}, '{_MARK}') THEN list_filter(list_transform(string_split(regexp_replace(regexp_replace(
      substr(text, length(regexp_extract({s.fold('text')}, '(?s)^(.*?){_MARK}', 1)) + 1), '\\.\\s+', chr(1), 'g'), '[-–•\\n]', chr(1), 'g'), chr(1)),
      lambda x: {s.clean_html('x')}), lambda x: length(x) > 12) ELSE []::VARCHAR[] END AS p FROM documents)
""")
def section_sentences(t):
    p = ex.section_sentences(c("text"), _MARK)
    return t.documents.select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


# --- CV text ---------------------------------------------------------------------------------

SECTIONS = ((r"^(the|and|of)\b", "first"), (r"^(les|la|que|de)\b", "second"), (r"^(nicht|und|der|die)\b", "third"))
_SECTION = s.first_match(s.norm("line"), list(SECTIONS), "NULL")


def _section_sql(table: str, key: str) -> str:
    return f"""
WITH raw AS (SELECT {key} AS k, list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(10)), lambda x: {s.squeeze('x')}), lambda x: x <> '') AS ls FROM {table}),
lines AS (SELECT k, i - 1 AS pos, ls[i] AS line FROM (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
marked AS (SELECT *, CASE WHEN length(line) <= 200 THEN {_SECTION} END AS heading FROM lines)
SELECT k, pos, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos), 'header') AS section, heading IS NOT NULL AS is_heading FROM marked
"""


@query("section_lines", _section_sql("documents", "doc_id"))
def section_lines(t):
    rows = t.documents.select(c("doc_id").alias("k"), F.explode(pf.section_lines(c("text"), SECTIONS, 200)).alias("x"))
    return rows.select("k", "x.pos", "x.section", "x.is_heading")


@query("conversation_sections", _section_sql("conversations", "conv_id * 1000 + turn"))
def conversation_sections(t):
    rows = t.spread("conversations", "conv_id").select(
        (c("conv_id") * 1000 + c("turn")).alias("k"), F.explode(pf.section_lines(c("text"), SECTIONS, 200)).alias("x")
    )
    return rows.select("k", "x.pos", "x.section", "x.is_heading")


_CV_TEXT = "text || CASE doc_id % 4 WHEN 0 THEN ' 5 yıl deneyim lisans' WHEN 1 THEN ' 12 years experience, english' WHEN 2 THEN ' özet: stajyer' ELSE '' END"


def _cv(t):
    i = c("doc_id") % 4
    tail = F.when(i == 0, " 5 yıl deneyim lisans").when(i == 1, " 12 years experience, english").when(i == 2, " özet: stajyer").otherwise("")
    cvs = t.documents.select("doc_id", F.concat("text", tail).alias("text"))
    # a generator, as a projection would be computed again by every use
    return cvs.select("doc_id", "text", F.explode(F.array(tx.normalize(c("text")))).alias("normalized"))


_LANGS = " + ".join(f"CASE WHEN regexp_matches(n, {s.q(p)}) THEN 1 ELSE 0 END" for p, _ in lx.LANGUAGE_NAMES)
_SKILL_N = " + ".join(f"CASE WHEN contains(n, {s.q(ex.normalize_py(w))}) THEN 1 ELSE 0 END" for w in HEAT_WORDS)
_EDU = s.first_match("n", lx.PROFILE_EDUCATION_PATTERNS, "NULL")
_FOUND_YEARS = "TRY_CAST(regexp_extract(n, '([0-9]{1,2})\\s*(\\+)?\\s*(yil|year)', 1) AS INTEGER)"
_YEARS = f"CASE WHEN {_FOUND_YEARS} > 40 THEN 40 ELSE {_FOUND_YEARS} END"


@query("heuristic_profile", f"""
SELECT doc_id, {_SKILL_N} AS skills, {_LANGS} AS languages, years, {_EDU} AS education,
  CASE WHEN regexp_matches(n, '\\b(lead|principal|staff)\\b') THEN 'lead' WHEN regexp_matches(n, '\\b(mudur|manager|direktor)\\b') THEN 'manager' WHEN regexp_matches(n, '\\b(stajyer|intern)\\b') THEN 'intern'
    WHEN years IS NULL THEN 'mid' WHEN years <= 1 THEN 'junior' WHEN years <= 4 THEN 'mid' WHEN years <= 8 THEN 'senior' ELSE 'lead' END AS seniority,
  array_to_string(({" || ".join(f"CASE WHEN regexp_matches(n, {s.q(p)}) THEN [{s.q(label)}] ELSE []::VARCHAR[] END" for p, label in lx.INDUSTRY_RULES)})[1:10], ',') AS industries
FROM (SELECT doc_id, n, {_YEARS} AS years FROM (SELECT doc_id, {s.norm(_CV_TEXT)} AS n FROM documents))
""")
def heuristic_profile(t):
    rows = _cv(t).select("doc_id", pf.heuristic_profile(c("text"), HEAT_WORDS, c("normalized")).alias("p"))
    return rows.select(
        "doc_id", F.size("p.skills").alias("skills"), c("p.languages_found").alias("languages"), c("p.years_of_experience").alias("years"),
        c("p.education_level").alias("education"), "p.seniority", F.array_join("p.industries", ",").alias("industries"),
    )


@query("cv_scores", f"""
SELECT doc_id, quality, score, CASE WHEN score >= 82 THEN 'Yüksek uyum' WHEN score >= 62 THEN 'İyi aday' WHEN score >= 45 THEN 'Orta uyum' WHEN score >= 25 THEN 'Zayıf uyum' ELSE 'Düşük uyum' END AS category FROM (
  SELECT doc_id, CAST(CASE WHEN size > 600 THEN 7 ELSE 4 END + CASE WHEN regexp_matches(text, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(text, '(\\+?[0-9][0-9\\s().-]{{8,}})') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(n, 'ozet|hakkimda|profil|summary|objective') THEN 7 ELSE 3 END
    + CASE WHEN regexp_matches(n, 'deneyim|tecrube|experience|yil|sirket|firma|pozisyon') THEN least(35, 18 + least(12, floor(size / 400))) ELSE 10 END
    + CASE WHEN {_EDU} IS NOT NULL THEN 12 ELSE 5 END + least(12, 3 + {_SKILL_N}) + CASE WHEN regexp_matches(n, 'sertifika|certificate|certified|lisans belgesi') THEN 7 ELSE 2 END
    + least(5, ({_LANGS}) * 2 + 1) AS INTEGER) AS score
  FROM (SELECT doc_id, text, {s.norm('text')} AS n, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS size FROM (SELECT doc_id, {_CV_TEXT} AS text FROM documents)))
LEFT JOIN labels USING (doc_id)
""")
def cv_scores(t):
    rows = _cv(t).select("*", pf.heuristic_profile(c("text"), HEAT_WORDS, c("normalized")).alias("p"))
    scored = rows.select("doc_id", pf.cv_score(c("text"), F.size("p.skills"), c("p.languages_found"), c("normalized")).alias("s"))
    labels = t.read("labels").select("doc_id", "quality")
    return scored.join(labels, "doc_id", "left").select("doc_id", "quality", "s.score", "s.category")


_PHONE_SQL = lx.PHONE


@query("contact_fields", f"""
SELECT doc_id, nullif(regexp_extract(text, '({lx.EMAIL})', 1), '') AS email, nullif(trim(regexp_extract(text, {s.q('(' + _PHONE_SQL + ')')}, 1)), '') AS phone,
  array_to_string({ordered_distinct(f"regexp_extract_all(text, {s.q('(?i)(' + lx.PROFILE_LINK + ')')}, 1)")}, ',') AS links,
  nullif(regexp_extract(text, {s.q('(?i)(' + lx.PERIOD + ')')}, 1), '') AS period
FROM documents
""")
def contact_fields(t):
    rows = t.documents.select("doc_id", pf.contact_fields(c("text")).alias("x"))
    return rows.select("doc_id", "x.email", "x.phone", F.array_join("x.links", ",").alias("links"), "x.period")


@query("structured_cvs", None)
def structured_cvs(t):
    """Every conversation turn read as a CV text."""
    rows = t.spread("conversations", "conv_id", by=("turn",), tasks=16).select("conv_id", "turn", pf.structured_cv(c("text"), HEAT_WORDS).alias("cv"))
    return rows.select(
        "conv_id", "turn", "cv.contact.full_name", "cv.headline", F.size("cv.experience").alias("jobs"),
        F.size("cv.skills").alias("skills"), F.size("cv.projects").alias("projects"),
    )


@query("page_listings", None)
def page_listings(t):
    """Landed pages parsed to listings (selectors need an HTML parser)."""
    return pg.pages_to_listings(t.pages.withColumn("platform", tx.base_host(c("url")))).select(
        "platform", "title", "company", "url", F.length("description").alias("chars"), F.size("requirements").alias("requirements")
    )


# --- profile side ----------------------------------------------------------------------------

_QUERIES = f"""
candidates AS (
  SELECT profile_id, list_filter(
    [target_role, CASE WHEN lv IS NOT NULL THEN lv || ' ' ELSE '' END || target_role, concat_ws(' ', target_role, skills[1]), concat_ws(' ', target_role, skills[1], skills[2]),
     concat_ws(' ', target_role, kw), concat_ws(' ', skills[1], kw), concat_ws(' ', target_role, CASE WHEN location_mode = 'cities' THEN locations[1] END)]
    || CASE WHEN location_mode = 'cities' THEN flatten(list_transform(locations[1:2], lambda p: [target_role || ' ' || p, concat_ws(' ', lv, target_role, p)])) ELSE []::VARCHAR[] END
    || CASE WHEN lv IS NOT NULL THEN list_transform(titles[2:3], lambda x: lv || ' ' || x) ELSE []::VARCHAR[] END || query_variations || titles[2:4], lambda q: length(q) >= 3) AS qs
  FROM (SELECT *, CASE WHEN wants_internship THEN 'stajyer' END AS lv, list_filter(keywords, lambda k: NOT list_contains(skills, k))[1] AS kw FROM profiles)
)"""


@query("crawl_queries", s.with_(s.PROFILES, _QUERIES) + f"SELECT profile_id, array_to_string({ordered_distinct('qs')}[1:12], '|') AS queries FROM candidates")
def crawl_queries(t):
    queries = pf.crawl_queries(
        c("target_role"), c("titles"), c("skills"), c("keywords"), c("query_variations"), c("locations"), c("location_mode"), c("desired_seniority")
    )
    return t.profiles.select("profile_id", F.array_join(queries, "|").alias("queries"))


@query("suggested_positions", s.with_(s.PROFILES) + f"""
SELECT profile_id, array_to_string({ordered_distinct('a')}[1:5], '|') AS positions FROM (
  SELECT profile_id, list_filter(query_variations || titles || keywords, lambda x: length(x) BETWEEN 2 AND 80) AS a FROM profiles)
""")
def suggested_positions(t):
    positions = pf.suggested_positions(c("query_variations"), c("titles"), c("keywords"))
    return t.profiles.select("profile_id", F.array_join(positions, "|").alias("positions"))


@query("assembled_profiles", s.with_(s.PROFILES) + f"""
SELECT profile_id, titles[1] AS target_role, array_to_string(({ordered_distinct('titles || query_variations')})[1:8], '|') AS titles, array_to_string({ordered_distinct('kw')}[1:60], '|') AS keywords
FROM (SELECT *, note[1:8] || keywords[1:30] || skills[1:12] || ({ordered_distinct('titles || query_variations')})[1:12] || ['egi'] || query_variations || [titles[2]] AS kw FROM (
  SELECT *, list_filter({ordered_distinct('keywords')}, lambda x: length(x) >= 4) AS note FROM profiles))
""")
def assembled_profiles(t):
    none = F.array().cast("array<string>")
    note = F.concat(F.lit("lütfen "), F.array_join("keywords", ", "), F.lit("; istiyorum"))
    p = pf.assemble_profile(
        F.slice("titles", 1, 1), c("titles"), c("query_variations"), none, F.slice("titles", 2, 1), c("skills"), none,
        F.array(F.lit("egi")), none, c("keywords"), c("query_variations"), note,
    )
    return t.profiles.select("profile_id", p.alias("p")).select(
        "profile_id", "p.target_role", F.array_join("p.titles", "|").alias("titles"), F.array_join("p.keywords", "|").alias("keywords")
    )


# --- professions -----------------------------------------------------------------------------


def _aliases(t):
    """Alias table from the parts: the noun is the profession, its coloured names are related ones."""
    words = t.read("part").select(F.split("p_name", " ").alias("w"))
    noun = words.select(F.get("w", F.lit(1)).alias("canonical")).distinct()
    equivalent = noun.select("canonical", c("canonical").alias("alias"), F.lit("equivalent").alias("kind"))
    related = words.select(F.get("w", F.lit(1)).alias("canonical"), F.array_join("w", " ").alias("alias"), F.lit("related").alias("kind")).distinct()
    return equivalent.unionByName(related)


_ALIASES = """
parts AS (SELECT p_partkey, p_size, p_name, string_split(p_name, ' ') AS w FROM part),
related AS (SELECT DISTINCT w[2] AS canonical, p_name AS alias FROM parts),
nouns AS (SELECT DISTINCT w[2] AS canonical FROM parts),
lookups AS (
  SELECT p_partkey, p_size, p_name, coalesce(
    CASE WHEN p_partkey % 2 = 0 THEN w[2] END,
    (SELECT arg_max(canonical, (length(canonical), canonical)) FROM nouns WHERE length(canonical) >= 5 AND contains(title, canonical))) AS canonical, title
  FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'kidemli ' || p_name END AS title FROM parts)
)"""


def _titled_parts(t):
    title = F.when(c("p_partkey") % 2 == 0, c("p_name")).otherwise(F.concat(F.lit("Kıdemli "), "p_name"))
    return t.read("part").select(c("p_partkey").alias("title_id"), c("p_size").alias("profile_id"), title.alias("title"))


@query("alias_lookup", s.with_(_ALIASES) + "SELECT p_partkey AS title_id, canonical FROM lookups WHERE canonical IS NOT NULL")
def alias_lookup(t):
    return rt.lookup_profession(_titled_parts(t), _aliases(t))


@query("profession_expansion", s.with_(_ALIASES) + """
SELECT profile_id, array_to_string(list_sort(list_filter(eq, lambda a: NOT list_contains(own, a))), '|') AS equivalents, array_to_string(list_sort(rel), '|') AS related, array_to_string(list_sort(eq), '|') AS canonicals
FROM (SELECT p_size AS profile_id, list_distinct(list(l.canonical)) AS eq, list_distinct(list(r.alias)) AS rel FROM lookups l JOIN related r ON r.canonical = l.canonical GROUP BY p_size)
JOIN (SELECT p_size AS profile_id, list_distinct(list(title)) AS own FROM lookups GROUP BY p_size) USING (profile_id)
""")
def profession_expansion(t):
    titles = _titled_parts(t)
    lookups = cut(rt.lookup_profession(titles, _aliases(t)))
    rows = rt.expand_profession(lookups, titles, _aliases(t))
    return rows.select("profile_id", *[F.array_join(n, "|").alias(n) for n in ("equivalents", "related", "canonicals")])


_PLATFORMS = "platforms AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {s.q(name)}, {s.q(kind)}, {boost}, {str(direct).lower()}, {s.q(url)})" for i, (name, kind, boost, direct, url) in enumerate(lx.SEARCH_PLATFORMS)
) + ") AS v(no, platform, kind, boost, direct, template))"
_PLANS = f"""
base_plans AS (
  SELECT profile_id, role, s1, s2, work, city, other, location_mode, work_mode, len(sk) AS n_skills, regexp_matches({s.trlower("array_to_string(sk || titles, ' ')")}, {s.q(rt.TECH_PROFILE)}) AS tech,
    regexp_matches({s.trlower("array_to_string(skills || titles, ' ')")}, {s.q(rt.TECH_PROFILE)}) AS tech_all
  FROM (SELECT *, target_role AS role, skills[1:4] AS sk, skills[1] AS s1, skills[2] AS s2, CASE work_mode WHEN 'remote' THEN 'remote' WHEN 'hybrid' THEN 'hibrit' END AS work,
    CASE WHEN location_mode = 'cities' THEN locations[1] END AS city, list_filter(titles, lambda x: x <> target_role)[1] AS other FROM profiles)
),
raw_plans AS (
  SELECT *, 0 AS o, concat_ws(' ', role, s1, s2, work) AS query, 88 AS score, 'recommended' AS category FROM base_plans
  UNION ALL SELECT *, 1, concat_ws(' ', role, s1), 82, 'recommended' FROM base_plans
  UNION ALL SELECT *, 2, concat_ws(' ', role, city), 78, 'general' FROM base_plans WHERE city IS NOT NULL
  UNION ALL SELECT *, 3, concat_ws(' ', other, s1), 76, 'general' FROM base_plans WHERE other IS NOT NULL
  UNION ALL SELECT *, 4, concat_ws(' ', role, coalesce(s1, 'technology')), 74, 'tech' FROM base_plans WHERE tech
),
plans AS (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY o) - 1 AS plan_no FROM (
    SELECT * FROM raw_plans WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY profile_id, {s.trlower('query')} ORDER BY o) = 1)
),
fitting AS (
  SELECT p.*, f.no, f.platform, f.boost, f.direct, replace(replace(template, '{{query_slug}}', {s.slug('query')}), '{{query}}', url_encode(query)) AS url,
    row_number() OVER (PARTITION BY profile_id, plan_no ORDER BY f.no) AS k
  FROM plans p, platforms f WHERE CASE WHEN f.kind = 'public' THEN plan_no = 0 WHEN f.platform = 'LinkedIn' THEN plan_no <= 1 WHEN f.platform = 'Toptalent' THEN tech_all OR plan_no = 0
    WHEN plan_no >= 2 AND f.platform = 'Yenibiriş' THEN false ELSE f.kind = 'general' OR p.category = f.kind OR p.category = 'recommended' END
),
links AS (
  SELECT profile_id, plan_no, no, platform, query, url, direct, least(98, greatest(45, score + boost + CASE WHEN n_skills >= 2 THEN 3 ELSE 0 END + CASE WHEN location_mode = 'cities' THEN 2 ELSE 0 END
    + CASE WHEN work_mode <> 'any' THEN 2 ELSE 0 END)) AS score
  FROM fitting WHERE k <= CASE WHEN plan_no = 0 THEN 7 ELSE 4 END
  QUALIFY row_number() OVER (PARTITION BY profile_id, {s.trlower("regexp_replace(url, '/+$', '')")} ORDER BY plan_no, no) = 1
)"""


@query("search_links", s.with_(s.PROFILES, _PLATFORMS, _PLANS) + """
SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, plan_no, no) AS position, platform, query, url, score,
  CASE WHEN NOT direct THEN 'low' WHEN score >= 86 THEN 'high' ELSE 'medium' END AS confidence FROM links QUALIFY position <= 14
""")
def search_links(t):
    return rt.search_links(t.profiles)
