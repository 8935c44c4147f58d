from pyspark.sql import functions as F

from postmill.functions import extract as ex
from postmill.functions import profile as pf
from postmill.functions import text as tx
from postmill.operators import retrieve as rt
from postmill.plans.extraction_queries import gap_report
from postmill.plans.matching_queries import HEAT_WORDS
from postmill.plans.tables import Tables


def arr(*items):
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def test_gaps_merge_before_any_limit(value):
    skills = [f"skill{k:02d}" for k in range(14)]
    terms = F.struct(arr(*skills[:6], *skills[:6], *skills).alias("skills"), arr("Needs skill13 for sure").alias("requirements"))
    names = skills + ["Needs skill13 for sure"]
    assert [g.requirement for g in value(pf.gaps(terms, F.lit(""), arr()))] == names
    assert [g.requirement for g in value(pf.gaps(terms, F.lit(""), arr(), 12))] == names[:12]


def test_listing_terms_keep_all(value):
    words = [f"word{chr(97 + k)}" for k in range(26)] + ["another"]
    lines = [f"Requirement line {k}" for k in range(20)]
    out = value(ex.listing_terms(F.lit("T"), F.lit(" ".join(words)), arr(*lines), arr(), words))
    assert list(out.skills) == words and list(out.requirements) == lines
    few = value(ex.listing_terms(F.lit("T"), F.lit(" ".join(words)), arr(*lines), arr(), words, 3, 2))
    assert list(few.skills) == words[:3] and list(few.requirements) == lines[:2]


def test_gap_report_meets_all_retrieved_pairs(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    got = {(r.profile_id, r.listing_id, r.requirement) for r in gap_report(t).filter("requirement = missing").collect()}
    hay = {r.item_id: r.hay for r in t.read("benchmark").select("item_id", tx.normalize(F.col("text")).alias("hay")).collect()}
    declared = {r.profile_id: r.skills for r in t.profiles.collect()}
    found = ex.boundary_terms(F.concat_ws("\n", "title", F.array_join("requirements", "\n"), "description"), HEAT_WORDS)
    held = {r.listing_id: r.x for r in t.listings.select("listing_id", found.alias("x")).collect()}

    def proven(p, w):
        if w in declared[p]:
            return True
        if len(w) <= 3:
            return f" {w} " in " " + "".join(x if x.isalnum() and x.isascii() else " " for x in hay[p]) + " "
        return w in hay[p] or any(len(d) >= 3 and (d in w or w in d) for d in declared[p])

    want = set()
    for p, i, *_ in rt.retrieve(t.profiles, t.base_listings).collect():
        skills = [w for w in held[i] if not any(len(o) > len(w) and w in o for o in held[i])]
        want |= {(p, i, w) for w in skills if not proven(p, w)}
    assert got == want and len({i for _, i, _ in got}) > len(declared)


def test_lines_of_a_long_listing_meet_what_is_missing_once(spark):
    """20,000 distinct lines: a gap is looked up by sorting, not by comparing all with all."""
    lines = [f"Go gerekli {i}" for i in range(20_000)] + ["go GEREKLI 3 zorunlu", "Go gerekli: 3"]
    rows = spark.createDataFrame([(["go", "sql"], lines)], "skills array<string>, requirements array<string>")
    terms = F.struct(F.col("skills"), F.col("requirements"))
    found = rows.select(pf.gaps(terms, F.lit("sql"), F.array(F.lit("sql"))).alias("g")).first().g
    assert len(found) == 20_002 and [(g.requirement, g.severity, g.missing) for g in found[:2]] == [("go", "critical", ["go"]), ("Go gerekli 0", "nice-to-have", ["go"])]
    assert found[-1].requirement == "go GEREKLI 3 zorunlu" and found[-1].severity == "critical"
