"""Hard eligibility rules and the explained 0-100 score, as expressions over two structs.

`role` is `extract.role_requirements(...)`, `who` is `candidate(...)`.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import extract as ex
from postmill.functions import profile as pf
from postmill.functions import text as tx

BLOCKER_LABELS = {
    "listing-invalid": "İlan geçersiz görünüyor",
    "graduate-required": "Mezun aranıyor",
    "education-level": "Eğitim yetersiz",
    "experience-below-min": "Deneyim eksik",
    "seniority-mismatch": "Kıdem farklı",
    "employment-mismatch": "İstihdam türü farklı",
    "location-mismatch": "Yer uymuyor",
    "abroad-listing": "Ülke dışında",
    "language-missing": "Dil eksik",
}
BAND_LABELS = {
    "cok-guclu": "Çok güçlü", "cok-uygun": "Çok uygun", "uygun": "Uygun", "sinirda": "Sınırda",
    "uygun-degil": "Uygun değil",
}


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), key)


def seniority_rank(level: Column) -> Column:
    return _lookup(lx.SENIORITY_RANK, level)


def education_rank(level: Column) -> Column:
    return _lookup(lx.EDUCATION_RANK, level)


def round_half_up(c: Column, digits: int = 0) -> Column:
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale


def candidate(
    seniority: Column, desired_seniority: Column, years: Column, education: Column, languages: Column,
    locations: Column, location_mode: Column, work_mode: Column, skills: Column, keywords: Column,
) -> Column:
    """The profile side of every rule, normalised once per profile."""
    def keys(items: Column) -> Column:
        return F.filter(
            F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: tx.normalize(s)), lambda s: s != ""
        )

    level, desired = pf.normalize_seniority(seniority), pf.normalize_seniority(desired_seniority)
    student = (
        F.coalesce(tx.fold(education).rlike(lx.STUDENT_MARKERS), F.lit(False))
        | (level == "stajyer") | (desired == "stajyer")
    )
    return F.struct(
        level.alias("seniority"),
        seniority_rank(level).alias("seniority_rank"),
        years.cast("int").alias("years"),
        student.alias("is_student"),
        pf.normalize_education(education).alias("education"),
        education_rank(pf.normalize_education(education)).alias("education_rank"),
        keys(languages).alias("languages"),
        keys(locations).alias("locations"),
        F.coalesce(location_mode, F.lit("all-turkey")).alias("location_mode"),
        F.coalesce(work_mode, F.lit("any")).alias("work_mode"),
        keys(skills).alias("skills"),
        keys(keywords).alias("keywords"),
        F.when(desired == "stajyer", "staj").otherwise(lx.UNSPECIFIED).alias("desired_employment"),
        desired.alias("desired_seniority"),
    )


def looks_turkish(location: Column, cities: list[str] = lx.CITIES) -> Column:
    keys = [ex.normalize_py(c) for c in cities]
    text = tx.normalize(location)
    return text.rlike("turkiye|turkey") | F.exists(F.split(text, " "), lambda t: t.isin(keys))


def _any_city(role: Column, who: Column) -> Column:
    places = F.transform(role["locations"], lambda p: tx.normalize(p))
    return tx.let(places, lambda ps: F.exists(ps, lambda p: F.exists(who["locations"], lambda w: F.contains(p, w))))


def _speaks(who: Column, language: Column) -> Column:
    needle = tx.normalize(language)
    return F.exists(who["languages"], lambda x: F.contains(x, needle) | F.contains(needle, x))


def blockers(role: Column, who: Column, verified: Column | bool = True, home_cities: list[str] = lx.CITIES) -> Column:
    """array<struct(code, label, detail)>; something unknown never blocks"""
    role_rank = seniority_rank(role["seniority"])
    least_level = F.array_min(F.transform(role["education"], lambda e: education_rank(e["level"])))
    advanced = F.get(F.filter(role["languages"], lambda x: x["level"] == "ileri"), F.lit(0))
    place = F.coalesce(F.get(role["locations"], F.lit(0)), F.lit(""))
    away = (role["work_mode"] != "remote") & (who["work_mode"] != "remote") & (F.size(role["locations"]) > 0)
    verified = F.lit(verified) if isinstance(verified, bool) else verified
    rules = [
        ("listing-invalid", ~verified, F.lit("")),
        ("graduate-required", role["requires_graduate"] & who["is_student"], F.lit("")),
        (
            "education-level", who["education_rank"] < least_level,
            F.format_string("en az %s; profil %s", _lookup({v: k for k, v in lx.EDUCATION_RANK.items()}, least_level), who["education"]),
        ),
        (
            "experience-below-min", ~role["accepts_no_experience"] & (who["years"] < role["min_years"]),
            F.format_string("en az %d yıl; profil %d yıl", role["min_years"], who["years"]),
        ),
        (
            "seniority-mismatch", (role_rank >= 3) & who["seniority_rank"].between(0, 1),
            F.format_string("%s; profil %s", role["seniority"], who["seniority"]),
        ),
        (
            "employment-mismatch",
            (who["desired_employment"] == "staj") & (role["employment_type"] != "staj") & (role_rank >= 3), F.lit(""),
        ),
        (
            "location-mismatch",
            (who["location_mode"] == "cities") & (F.size(who["locations"]) > 0) & away & ~_any_city(role, who), place,
        ),
        ("abroad-listing", away & ~F.exists(role["locations"], lambda p: looks_turkish(p, home_cities)), place),
        (
            "language-missing",
            advanced.isNotNull() & (F.size(who["languages"]) > 0) & ~_speaks(who, advanced["language"]),
            F.coalesce(advanced["language"], F.lit("")),
        ),
    ]
    return F.filter(
        F.array(*[
            F.when(
                F.coalesce(rule, F.lit(False)),
                F.struct(F.lit(code).alias("code"), F.lit(BLOCKER_LABELS[code]).alias("label"), detail.alias("detail")),
            )
            for code, rule, detail in rules
        ]),
        lambda b: b.isNotNull(),
    )


def _component(key: str, maximum: int, cases: list[tuple[Column, float, str]], share: float, status: str) -> Column:
    """First case that holds gives the share of the maximum and the status."""
    def pick(value) -> Column:
        c = None
        for rule, *rest in cases:
            c = F.when(rule, value(rest)) if c is None else c.when(rule, value(rest))
        return c.otherwise(value([share, status]))

    return F.struct(
        F.lit(key).alias("key"),
        pick(lambda r: F.lit(float(maximum * r[0]))).alias("earned"),
        F.lit(maximum).alias("max"),
        pick(lambda r: F.lit(r[1])).alias("status"),
    )


def role_components(role: Column, who: Column) -> Column:
    """Five components, 60 points; unknown facts earn 60-80 % of their part."""
    years, least, most = who["years"], role["min_years"], role["max_years"]
    enough = F.coalesce(years >= least, F.lit(False))
    over = F.coalesce(years > most, F.lit(False))
    within = F.coalesce(years <= most, F.lit(False))
    gap = F.abs(seniority_rank(role["seniority"]) - who["seniority_rank"])

    def level_ok(e: Column) -> Column:
        return who["education_rank"] >= education_rank(e["level"])

    def state_ok(e: Column) -> Column:
        return F.when(who["is_student"], e["student"]).otherwise(e["graduate"] | e["student"])

    asked = F.filter(role["languages"], lambda x: x["level"].isin("iyi", "ileri"))
    spoken = F.size(F.filter(asked, lambda x: _speaks(who, x["language"])))
    return F.array(
        _component("experience", 20, [
            (least.isNull() & most.isNull() & ~role["accepts_no_experience"], 0.7, "unknown"),
            (years.isNull(), 0.6, "unknown"),
            (role["accepts_no_experience"], 1.0, "met"),
            (enough & over, 0.6, "partial"),
            (enough | within, 1.0, "met"),
        ], 0.0, "unmet"),
        _component("role-type", 15, [
            (seniority_rank(role["seniority"]) < 0, 0.7, "unknown"),
            (who["seniority_rank"] < 0, 0.6, "unknown"),
            (gap == 0, 1.0, "met"),
            (gap == 1, 0.6, "partial"),
        ], 0.0, "unmet"),
        _component("education", 10, [
            (F.size(role["education"]) == 0, 0.7, "unknown"),
            (who["education_rank"].isNull(), 0.6, "unknown"),
            (F.exists(role["education"], lambda e: level_ok(e) & state_ok(e)), 1.0, "met"),
            (F.exists(role["education"], level_ok), 0.4, "partial"),
        ], 0.0, "unmet"),
        _component("location", 10, [
            ((who["work_mode"] == "remote") | (role["work_mode"] == "remote"), 1.0, "met"),
            ((who["location_mode"] != "cities") | (F.size(who["locations"]) == 0), 0.8, "unknown"),
            (F.size(role["locations"]) == 0, 0.6, "unknown"),
            (_any_city(role, who), 1.0, "met"),
        ], 0.0, "unmet"),
        _component("language", 5, [
            (F.size(role["languages"]) == 0, 0.8, "unknown"),
            (F.size(asked) == 0, 1.0, "met"),
            (spoken == F.size(asked), 1.0, "met"),
            (spoken > 0, 0.5, "partial"),
        ], 0.0, "unmet"),
    )


def coverage(haystack: Column, terms: Column, whole_words: bool = False) -> Column:
    """Matched share of `terms` in a normalised text, scaled to between three and ten terms.

    Matching is by substring unless `whole_words` is set.
    """
    if whole_words:
        padded = F.concat(F.lit(" "), haystack, F.lit(" "))
        found = F.filter(terms, lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))
    else:
        found = F.filter(terms, lambda t: (F.length(t) >= 2) & F.contains(haystack, t))
    scale = F.greatest(F.lit(3), F.least(F.size(terms), F.lit(10)))
    return F.when((haystack == "") | (F.size(terms) == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.size(found) / scale)
    )


def technical_components(role: Column, who: Column, listing_keywords: Column) -> Column:
    """Four components, 40 points; a part the listing does not state earns 70 %."""
    required, preferred = role["required_skills"], role["preferred_skills"]
    stated = F.trim(F.concat_ws(" ", role["required_text"], role["preferred_text"]))

    def part(key: str, maximum: int, lines: Column, hay: Column, terms: Column) -> Column:
        return tx.let(
            tx.let(hay, lambda h: coverage(h, terms)),
            lambda ratio: F.struct(
                F.lit(key).alias("key"),
                F.when(F.size(lines) == 0, F.lit(maximum * 0.7)).otherwise(ratio * maximum).alias("earned"),
                F.lit(maximum).alias("max"),
                F.when(F.size(lines) == 0, "unknown").when(ratio >= 0.6, "met").when(ratio > 0, "partial")
                .otherwise("unmet").alias("status"),
            ),
        )

    return F.array(
        part("required-skills", 15, required, role["required_text"], who["skills"]),
        part("preferred-skills", 10, preferred, role["preferred_text"], who["skills"]),
        part("experience-relation", 10, F.concat(required, preferred), stated, who["keywords"]),
        part("listing-keywords", 5, listing_keywords, tx.normalize(F.array_join(listing_keywords, " ")), who["skills"]),
    )


def _points(components: Column) -> Column:
    return F.aggregate(components, F.lit(0.0), lambda acc, x: acc + x["earned"])


def score_band(total: Column) -> Column:
    return (
        F.when(total >= 90, "cok-guclu").when(total >= 80, "cok-uygun").when(total >= 70, "uygun")
        .when(total >= 60, "sinirda").otherwise("uygun-degil")
    )


def evaluate(
    role: Column, who: Column, listing_keywords: Column, verified: Column | bool = True,
    home_cities: list[str] = lx.CITIES,
) -> Column:
    """Eligibility verdict with blockers, components, total, band and confidence."""
    def assemble(x: Column) -> Column:
        role_points, tech_points = _points(x["role"]), _points(x["tech"])
        total = F.floor(role_points + tech_points + 0.5).cast("int")
        required = F.get(x["tech"], F.lit(0))
        return F.struct(
            (F.size(x["blockers"]) == 0).alias("eligible"),
            x["blockers"].alias("blockers"),
            round_half_up(role_points, 1).alias("role_score"),
            round_half_up(tech_points, 1).alias("technical_score"),
            total.alias("total"),
            score_band(total).alias("band"),
            F.concat(x["role"], x["tech"]).alias("components"),
            F.when(required["status"] == "unknown", 0.0).otherwise(required["earned"] / required["max"])
            .alias("required_coverage"),
            F.when(x["fields"] >= 3, "high").when(x["fields"] >= 1, "medium").otherwise("low").alias("confidence"),
        )

    return tx.let(
        F.struct(
            blockers(role, who, verified, home_cities).alias("blockers"),
            role_components(role, who).alias("role"),
            technical_components(role, who, listing_keywords).alias("tech"),
            role["extracted_fields"].alias("fields"),
        ),
        assemble,
    )


COMPONENT_LABELS = {
    "experience": "Deneyim", "role-type": "Kıdem", "education": "Eğitim", "location": "Yer", "language": "Dil", "required-skills": "Aranan beceriler",
    "preferred-skills": "Tercih edilen beceriler", "experience-relation": "Deneyimin ilgisi", "listing-keywords": "Başlıktaki beceriler",
}


def explained(components: Column, role: Column, who: Column, listing_keywords: Column) -> Column:
    """`components` of `evaluate` with a label and what was compared: the listing's side, then the profile's.

    Skills that a part's text holds are named, all of them. The detail is never empty, also where a side says nothing.
    """
    def told(c: Column) -> Column:
        return F.when(F.coalesce(c.cast("string"), F.lit("")) != "", c.cast("string")).otherwise("belirtilmemiş")

    def listed(items: Column) -> Column:
        return told(F.array_join(items, ", "))

    def sides(asked: Column, given: Column) -> Column:
        return F.concat(F.lit("ilan: "), asked, F.lit("; profil: "), given)

    def years(c: Column) -> Column:
        return told(F.when(c.isNotNull(), F.concat(c.cast("string"), F.lit(" yıl"))))

    def held(hay: Column, terms: Column) -> Column:
        found = F.filter(terms, lambda t: (F.length(t) >= 2) & F.contains(hay, t))
        none = F.concat(F.lit("bulunan yok; profilde "), F.size(terms).cast("string"), F.lit(" beceri"))
        return F.when(F.size(found) == 0, none).otherwise(F.concat(F.lit("bulunan: "), F.array_join(found, ", ")))

    stated = F.trim(F.concat_ws(" ", role["required_text"], role["preferred_text"]))
    span = F.when(role["accepts_no_experience"], "deneyimsiz olur").when(
        role["max_years"].isNotNull(), F.concat_ws("-", role["min_years"], role["max_years"])).otherwise(years(role["min_years"]))
    details = {
        "experience": sides(span, years(who["years"])),
        "role-type": sides(told(role["seniority"]), told(who["seniority"])),
        "education": sides(listed(F.transform(role["education"], lambda e: e["level"])), told(who["education"])),
        "location": sides(F.concat_ws(" ", listed(role["locations"]), role["work_mode"]), F.concat_ws(" ", listed(who["locations"]), who["work_mode"])),
        "language": sides(listed(F.transform(role["languages"], lambda x: F.concat_ws(" ", x["language"], x["level"]))), listed(who["languages"])),
        "required-skills": held(role["required_text"], who["skills"]),
        "preferred-skills": held(role["preferred_text"], who["skills"]),
        "experience-relation": held(stated, who["keywords"]),
        "listing-keywords": held(tx.normalize(F.array_join(listing_keywords, " ")), who["skills"]),
    }

    def detail(x: Column) -> Column:
        return F.coalesce(*[F.when(x["key"] == key, text) for key, text in details.items()])

    return F.transform(components, lambda x: F.struct(
        x["key"].alias("key"), _lookup(COMPONENT_LABELS, x["key"]).alias("label"), x["earned"].alias("earned"), x["max"].alias("max"),
        x["status"].alias("status"), detail(x).alias("detail"),
    ))


def listing_role() -> Column:
    """`role` of a listing table with the standard columns."""
    c = F.col
    return ex.role_requirements(
        c("title"), c("description"), c("requirements"), c("candidate_criteria"), c("location"), c("work_mode")
    )


def profile_candidate() -> Column:
    """`who` of a profile table with the standard columns."""
    c = F.col
    return candidate(
        c("seniority"), c("desired_seniority"), c("years_of_experience"), c("education_level"), c("languages"),
        c("locations"), c("location_mode"), c("work_mode"), c("skills"), c("keywords"),
    )


def audit(evaluated: DataFrame, profile: str = "profile_id") -> DataFrame:
    """Per profile: evaluated, eligible, pass rate and the over-rejection alarm below 10 %."""
    return evaluated.groupBy(profile).agg(
        F.count("*").alias("listings"),
        F.count_if("eligible").alias("eligible"),
        F.floor(F.avg(F.col("eligible").cast("double")) * 100 + 0.5).cast("int").alias("pass_percent"),
    ).withColumn("over_rejected", F.col("pass_percent") < 10)


def blocker_histogram(evaluated: DataFrame, profile: str = "profile_id") -> DataFrame:
    return (
        evaluated.select(profile, F.explode("blockers").alias("b"))
        .groupBy(profile, F.col("b.code").alias("code")).agg(F.count("*").alias("n"))
    )


def band_histogram(evaluated: DataFrame, profile: str = "profile_id") -> DataFrame:
    return evaluated.filter("eligible").groupBy(profile, "band").agg(F.count("*").alias("n"))
