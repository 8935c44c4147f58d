import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.operators import analytics as an
from postmill.operators import applications as ap
from postmill.operators import dedupe as dd
from postmill.operators import eligibility as el
from postmill.operators import health as hl
from postmill.operators import ordered as od
from postmill.operators import retrieve as rt
from postmill.operators import reuse as ru
from postmill.operators import score as sc

c = F.col


def ts(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


# --- ordered computations -----------------------------------------------------------------


@pytest.fixture(scope="module")
def runs(spark):
    """One key holds most rows, so it spans many segments; ties in time are broken by id."""
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        key = "hot" if rng.random() < 0.7 else rng.choice("abcdef")
        rows.append((key, rng.randrange(200), i, rng.random() < 0.4, rng.random() < 0.1))
    return rows, spark.createDataFrame(rows, "k string, t int, i int, hit boolean, mark boolean")


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_running_and_trailing_streak(runs):
    rows, df = runs
    want, last = {}, {}
    for key, items in by_key(rows).items():
        n = 0
        for row in items:
            n = n + 1 if row[3] else 0
            want[row[2]] = n
        last[key] = n
    for partitions in ("1", "8", "31"):
        df.sparkSession.conf.set("spark.sql.shuffle.partitions", partitions)
        got = od.running_streak(df, ["k"], ["t", "i"], c("hit"), ~c("hit"))
        assert {r["i"]: r["streak"] for r in got.collect()} == want
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "8")
    got = od.trailing_streak(df, ["k"], ["t", "i"], c("hit"), ~c("hit"))
    assert {r["k"]: r["streak"] for r in got.collect()} == last


def test_last_before(runs):
    rows, df = runs
    want = {}
    for items in by_key(rows).values():
        seen = None
        for row in items:
            want[row[2]] = seen
            seen = row[2] if row[4] else seen
    got = od.last_before(df, ["k"], ["t", "i"], F.when(c("mark"), c("i")))
    assert {r["i"]: r["previous"] for r in got.collect()} == want


def test_decayed_level(runs):
    rows, df = runs
    want = {}
    for key, items in by_key(rows).items():
        level = 0.5
        for row in items:
            level = 0.7 * level + 0.3 * row[3]
        want[key] = level
    got = {r["k"]: r["level"] for r in od.decayed_level(df, ["k"], ["t", "i"], c("hit")).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_first_n_flag(runs):
    rows, df = runs
    want = {row[2]: pos < 7 for items in by_key(rows).values() for pos, row in enumerate(items)}
    got = od.first_n_flag(df, ["k"], [c("t"), c("i")], 7)
    assert {r["i"]: r["within"] for r in got.collect()} == want


# --- duplicates -----------------------------------------------------------------------------

LISTING = "listing_id long, platform string, title string, company string, location string, description string, url string"
LONG = " ".join(f"kelime{i:03d}" for i in range(60))


def listings(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows, 1)], LISTING)


def groups(df):
    out = {}
    for row in dd.duplicate_groups(df).collect():
        out.setdefault(row["group_id"], set()).add(row["listing_id"])
    return sorted(map(sorted, out.values()))


def test_duplicate_groups(spark):
    near = LONG.replace("kelime001", "baska001")
    df = listings(
        spark,
        ("A", "Aşçı", "Lezzet A.Ş.", "İzmir", "kısa", "https://a.co/1/"),
        ("B", "Aşçı", "Lezzet", "İzmir", "kısa", "https://b.co/9"),
        ("C", "Garson", None, None, "", "https://a.co/1"),
        ("A", "Şef", "Deniz Ltd", "Bursa", LONG, "https://a.co/3"),
        ("B", "Mutfak Şefi", "Deniz", None, near, "https://b.co/4"),
        ("B", "Mutfak Şefi", "Deniz", "Ankara", near, "https://b.co/5"),
        ("B", "Şef Part Time", "Deniz", "Bursa", LONG, "https://b.co/6"),
        ("B", "Şef Full Time", "Deniz", "Bursa", LONG, "https://b.co/7"),
        ("C", "", "", "", LONG, "https://c.co/8"),
        ("C", "", "", "", LONG, "https://c.co/9"),
    )
    # 5 has no city and links Bursa (4) with Ankara (6); 7 and 8 both touch 4, so they meet there
    assert groups(df) == [[1, 2, 3], [4, 5, 6, 7, 8], [9], [10]]
    shuffled = df.repartition(7, "platform").orderBy(F.rand(3))
    assert groups(shuffled) == groups(df)


def test_conflicting_markers_stay_apart(spark):
    df = listings(
        spark, ("A", "Kasiyer Part Time", "Deniz", "Bursa", LONG, "https://a/1"), ("A", "Kasiyer Tam Zamanlı", "Deniz", "Bursa", LONG, "https://a/2")
    )
    assert groups(df) == [[1], [2]]


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"sozcuk{i:03d}" for i in range(120)]
    rows, base = [], rng.sample(vocabulary, 60)
    for _ in range(150):
        words = list(base) if rng.random() < 0.6 else rng.sample(vocabulary, rng.randrange(40, 80))
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(("A", "x", rng.choice(["Deniz", "Lezzet"]), rng.choice(["Bursa", "İzmir", None]), " ".join(words), f"https://a/{len(rows)}"))
    df = listings(spark, *rows)
    reps = dd.content_groups(df).collect()
    want = set()
    texts = {i: set(row[4].split()) for i, row in enumerate(rows, 1)}
    for x in reps:
        for y in reps:
            a, b = texts[x["rep_id"]], texts[y["rep_id"]]
            fits = x["city"] == y["city"] or not x["city"] or not y["city"]
            if x["rep_id"] < y["rep_id"] and x["block"] == y["block"] and fits and len(a & b) / len(a | b) >= 0.72:
                want.add((x["rep_id"], y["rep_id"]))
    got = {(r["a"], r["b"]) for r in dd.similar_pairs(dd.content_groups(df)).collect()}
    assert len(want) > 20 and got == want


def near_copies(spark, n, seed=4):
    """Texts that share most words with their like, some alone; every fifth row comes twice."""
    rng = random.Random(seed)
    vocabulary, rows = [f"sozcuk{i:03d}" for i in range(400)], []
    bases = [rng.sample(vocabulary, 60) for _ in range(4)]
    for k in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.9 else rng.sample(vocabulary, rng.randrange(40, 80))
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(("A", "x", rng.choice(["Deniz", "Lezzet"]), rng.choice(["Bursa", "İzmir", None]), " ".join(words), f"https://a/{k}"))
    df = listings(spark, *rows)
    return df.unionByName(df.filter("listing_id % 5 = 0"))


def test_pairs_do_not_depend_on_cells_tiles_and_broadcasts(spark, monkeypatch):
    df = near_copies(spark, 70)
    keys = dd.content_keys(df)
    want = sorted(map(tuple, dd.similar_pairs(dd.content_groups(df, keys)).collect()))
    for name, value in (("CELL_PLACES", 300), ("HELD_PAIRS", 50), ("TILE_SETS", 12), ("SMALL_REPS", 20)):
        monkeypatch.setattr(dd, name, value)
    groups = dd.content_groups(df, keys)
    assert sorted(map(tuple, dd.similar_pairs(groups).collect())) == want and len(want) > 100
    fresh = groups.withColumn("fresh", c("rep_id") % 3 == 0)
    assert {r[:2] for r in map(tuple, dd.similar_pairs(fresh).collect())} == {p[:2] for p in want if p[0] % 3 == 0 or p[1] % 3 == 0}
    linked = lambda edges: {frozenset(x) for x in _members(edges)}
    assert linked(dd.similar_edges(groups)) == linked(spark.createDataFrame([p[:2] for p in want], "a long, b long"))


def _members(edges):
    groups = {}
    for r in dd.connected_components(edges).collect():
        groups.setdefault(r["component"], []).append(r["node"])
    return groups.values()


def test_near_copies_give_edges_instead_of_pairs(spark):
    """Grouping needs what holds a group together, not the pairs of all its near copies."""
    df = near_copies(spark, 200).dropDuplicates(["listing_id"])
    assert dd.similar_pairs(dd.content_groups(df)).count() > 1_000
    assert dd.similar_edges(dd.content_groups(df)).count() < 200


def test_only_the_rarest_words_of_a_set_are_met_by(spark):
    rows = [(1, "x", [5, 7, 9, 11]), (2, "x", [5, 7, 9, 12]), (3, "x", [5, 9, 20, 21, 22, 23, 24, 25, 26, 27])]
    sets = spark.createDataFrame(rows, "rep_id long, block string, words array<long>").withColumn("fresh", F.lit(True))
    got = {r["rep_id"]: r["prefix"].tolist() if hasattr(r["prefix"], "tolist") else list(r["prefix"]) for r in dd._prefixes(sets, 0.72).collect()}
    # 4 - ceil(2.88) + 1 and 10 - ceil(7.2) + 1 words; those of one set first, then by frequency
    assert got == {1: [11, 7], 2: [12, 7], 3: [20, 21, 22]}


def test_many_copies_emit_no_pairs(spark):
    df = spark.range(1, 3001).select(
        c("id").alias("listing_id"), F.lit("A").alias("platform"), F.lit("Şef").alias("title"), F.lit("Deniz").alias("company"),
        F.lit("Bursa").alias("location"), F.lit(LONG).alias("description"), F.concat(F.lit("https://a/"), c("id").cast("string")).alias("url"),
    )
    assert dd.duplicate_edges(df).count() < 3 * 3000
    one = dd.dedupe_listings(df).collect()
    assert len(one) == 1 and one[0]["removed"] == 2999 and one[0]["listing_id"] == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000, 5001)]
    rng.shuffle(edges)
    got = dd.connected_components(spark.createDataFrame(edges, "a long, b long"))
    labels = {r["node"]: r["component"] for r in got.collect()}
    assert {labels[i] for i in range(1, 301)} == {1} and {labels[1000 + i] for i in range(500)} == {1000} and labels[5001] == 5000


# --- retrieval ------------------------------------------------------------------------------


def test_containing_texts_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for i in range(200)}
    terms = {rng.choice(words) for _ in range(20)} | {" ".join(rng.choice(words) for _ in range(rng.randrange(2, 4))) for _ in range(40)}
    terms |= {t[2:9].strip() for t in list(texts.values())[:40]} - {""}
    got = rt.containing_texts(
        spark.createDataFrame(list(texts.items()), "listing_id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    )
    want = {(t, i) for t in terms for i, x in texts.items() if t in x}
    assert {(r["term"], r["listing_id"]) for r in got.collect()} == want


def test_no_nested_loop_joins(spark):
    texts = spark.createDataFrame([(1, "a b")], "listing_id long, text string")
    plan = rt.containing_texts(texts, spark.createDataFrame([("a",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("terms", "title", "body", "want"), [
    (["asci"], "asci lezzet", "", True), (["asci", "sef"], "garson", "bir sef var", False), (["asci", "sef"], "garson", "sef ve asci", True),
    ([], "garson", "", True), (["asci"], "", "", True),
])
def test_relevance(value, terms, title, body, want):
    array = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    assert value(rt.relevance(array, F.lit(title), F.lit(body))) is want


@pytest.mark.parametrize(("place", "mode", "wanted", "want"), [
    ("Ankara", None, "any", False), (None, None, "any", True), ("Ankara", "remote", "any", True), ("İzmir(Konak)", None, "any", True), ("Ankara", None, "remote", True),
])
def test_city_filter(value, place, mode, wanted, want):
    text = F.lit(None).cast("string")
    got = rt.in_wanted_city(
        F.lit(place) if place else text, F.lit(mode) if mode else text, F.array(F.lit("İzmir"), F.lit("Bursa")), F.lit("cities"), F.lit(wanted)
    )
    assert value(got) is want


def test_profession_lookup(spark):
    aliases = spark.createDataFrame(
        [("cook", "Aşçı", "equivalent"), ("chef", "Aşçıbaşı", "equivalent"), ("cook", "aşçıbaşı", "related"), ("dev", "Yazılım Geliştirici", "equivalent"), ("dev", "coder", "related")],
        "canonical string, alias string, kind string",
    )
    titles = spark.createDataFrame(
        [(1, "AŞÇIBAŞI"), (2, "Kıdemli Aşçıbaşı Yardımcısı"), (3, "Kıdemli yazılım geliştirici"), (4, "coder"), (5, "old coder"), (6, "Pilot")], "title_id long, title string"
    )
    got = {r["title_id"]: r["canonical"] for r in rt.lookup_profession(titles, aliases).collect()}
    assert got == {1: "chef", 2: "chef", 3: "dev", 4: "dev"}


# --- eligibility ----------------------------------------------------------------------------

PROFILE = {
    "seniority": "junior", "desired_seniority": None, "years": 2, "education": "Lisans mezunu", "languages": ["Almanca"], "locations": ["İzmir"],
    "location_mode": "cities", "work_mode": "any", "skills": ["Excel", "SAP", "Logo"], "keywords": ["muhasebe", "bordro", "rapor"],
}
JOB = {
    "title": "Muhasebe Uzmanı", "description": "Ekibe katıl. " * 5, "requirements": ["Excel ve SAP bilgisi", "Muhasebe bordro rapor tecrübesi"],
    "criteria": ["Tecrübe En az 1 yıl tecrübeli", "Eğitim Seviyesi Üniversite(Mezun)"], "location": "İzmir(Konak)", "work_mode": None,
}


BLOCKED = [
    ({"education": "Lisans öğrencisi"}, {}, "graduate-required"), ({"education": "lise"}, {}, "education-level"),
    ({"years": 0}, {}, "experience-below-min"), ({}, {"title": "Kıdemli Uzman"}, "seniority-mismatch"),
    ({"desired_seniority": "stajyer", "education": None, "seniority": None}, {"title": "Senior Uzman"}, "employment-mismatch"),
    ({}, {"location": "Ankara"}, "location-mismatch"), ({"location_mode": "all"}, {"location": "Stockholm"}, "abroad-listing"),
    ({}, {"criteria": ["Yabancı Dil İngilizce(Konuşma : İleri)"]}, "language-missing"),
]
FREE = [
    ({"years": None}, {}), ({"education": None}, {}), ({"languages": []}, {"criteria": ["Yabancı Dil İngilizce(Konuşma : İleri)"]}),
    ({}, {"location": None}), ({}, {"location": "Stockholm", "work_mode": "remote"}), ({}, {"criteria": [], "requirements": [], "description": ""}),
]
BANDS = [
    ({}, {}, 65, 100), ({"skills": ["Garson"], "keywords": ["servis"]}, {}, 45, 85),
    ({"skills": ["Kaynak"], "keywords": ["tig"], "years": 0, "education": "lise"}, {"title": "Kıdemli Yazılım Mimarı", "location": "Ankara"}, 0, 60),
]


def judged(spark, cases):
    """Verdicts of (profile change, job change, verified) cases, all in one job."""
    from postmill.functions import extract as ex

    rows = []
    for i, (profile, job, verified) in enumerate(cases):
        rows.append((i, *{**PROFILE, **profile}.values(), *{**JOB, **job}.values(), verified))
    kinds = {"years": "int", "languages": "array<string>", "locations": "array<string>", "skills": "array<string>", "keywords": "array<string>",
             "requirements": "array<string>", "criteria": "array<string>"}
    names = [f"p_{k}" for k in PROFILE] + [f"j_{k}" for k in JOB]
    schema = ", ".join(["i int"] + [f"{n} {kinds.get(n[2:], 'string')}" for n in names] + ["verified boolean"])
    df = spark.createDataFrame(rows, schema).repartition(4)
    who = el.candidate(**{k: c(f"p_{k}") for k in PROFILE})
    role = ex.role_requirements(*[c(f"j_{k}") for k in JOB])
    sides = df.select("i", "verified", who.alias("who"), role.alias("role"))
    verdict = el.evaluate(c("role"), c("who"), F.array(F.lit(JOB["title"])), c("verified"))
    return [r["v"] for r in sides.select("i", verdict.alias("v")).orderBy("i").collect()]


def codes(result):
    return [b["code"] for b in result["blockers"]]


def test_eligibility(spark):
    cases = [({}, {}, True), ({}, {}, False)] + [(p, j, True) for p, j, _ in BLOCKED] + [(p, j, True) for p, j in FREE] + [(p, j, True) for p, j, *_ in BANDS]
    results = judged(spark, cases)
    fit, unverified = results[:2]
    assert fit["eligible"] and fit["band"] in ("cok-uygun", "uygun") and fit["confidence"] == "medium"
    assert fit["total"] == int(sum(x["earned"] for x in fit["components"]) + 0.5)
    assert codes(unverified) == ["listing-invalid"]
    blocked = results[2:2 + len(BLOCKED)]
    for (_, _, code), r in zip(BLOCKED, blocked, strict=True):
        assert not r["eligible"] and code in codes(r), (code, r)
    for case, r in zip(FREE, results[2 + len(BLOCKED):], strict=False):
        assert r["eligible"], (case, r)
    for (_, _, low, high), r in zip(BANDS, results[-len(BANDS):], strict=True):
        assert low <= r["total"] <= high, r


# --- scores ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("days", "adjust", "label"), [(0, 3, "new"), (3, 3, "new"), (5, 1, "recent"), (14, 0, None), (30, -2, "old"), (-2, 3, "new")])
def test_freshness(value, days, adjust, label):
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    got = value(sc.freshness(F.timestamp_seconds(F.unix_seconds(now) - days * 86400), now))
    assert (got["adjust"], got["label"]) == (adjust, label)


def test_unknown_date_is_neutral(value):
    got = value(sc.freshness(F.try_to_timestamp(F.lit("junk")), F.current_timestamp()))
    assert (got["adjust"], got["label"], got["age_days"]) == (0, None, None)


@pytest.mark.parametrize("semantic", [0, 35, 60, 90, 100])
def test_band_comes_from_the_final_score(value, semantic):
    got = value(sc.blended(F.lit(50.0), F.lit(20.0), F.lit(semantic), F.lit(3)))
    assert got["band"] == value(el.score_band(F.lit(got["final"])))


def test_country_quota(spark):
    rows = [(1, i, 100 - i, "US" if i < 50 else "TR") for i in range(120)] + [(2, i, i, "US") for i in range(70)] + [(3, i, i, "TR") for i in range(70)]
    df = spark.createDataFrame(rows, "profile_id int, listing_id int, cheap_score int, country string")
    got = sc.country_quota(df, c("country") != "TR", F.lit(False)).groupBy("profile_id").agg(F.count("*").alias("n"), F.count_if("is_foreign").alias("f"))
    assert {r["profile_id"]: (r["n"], r["f"]) for r in got.collect()} == {1: (60, 12), 2: (60, 60), 3: (60, 0)}


# --- sources --------------------------------------------------------------------------------


@pytest.mark.parametrize(("blocked", "total", "empty", "failures", "want"), [
    (True, 0, 0, 0, "engelli"), (False, 0, 0, 0, "bilinmiyor"), (False, 9, 3, 3, "bozuk"), (False, 10, 3, 2, "saglikli"), (False, 10, 5, 0, "kismi"), (False, 2, 2, 2, "bozuk"),
])
def test_verdicts(value, blocked, total, empty, failures, want):
    assert value(hl.verdict(*[F.lit(x) for x in (blocked, total, empty, failures)])) == want


def test_explained_components(spark):
    """Each part names both sides and the terms that were found; nothing known still gives a sentence."""
    listing = spark.createDataFrame(
        [("Kıdemli Aşçı", "Mutfakta en az 3 yıl deneyim.", ["SQL bilen", "Tercihen Excel bilen"], ["Tecrübe En az 3 yıl tecrübeli"], "Ankara", "onsite"), ("", "", [], [], None, None)],
        "title string, description string, requirements array<string>, candidate_criteria array<string>, location string, work_mode string")
    profile = spark.createDataFrame([("senior", None, 5, "lisans", ["İngilizce"], ["Ankara"], "cities", "onsite", ["sql", "excel"], ["aşçı"])],
        "seniority string, desired_seniority string, years_of_experience int, education_level string, languages array<string>, locations array<string>, location_mode string, "
        "wanted_mode string, skills array<string>, keywords array<string>")
    role = listing.select("title", el.listing_role().alias("role"))
    who = profile.withColumnRenamed("wanted_mode", "work_mode").select(el.profile_candidate().alias("who"))
    parts = F.concat(el.role_components(c("role"), c("who")), el.technical_components(c("role"), c("who"), F.array("title")))
    rows = role.crossJoin(who).select("title", el.explained(parts, c("role"), c("who"), F.array("title")).alias("x")).collect()
    full = {x.key: x for x in next(r for r in rows if r.title).x}
    assert set(full) == set(el.COMPONENT_LABELS) and all(x.label == el.COMPONENT_LABELS[k] for k, x in full.items())
    assert full["experience"].detail == "ilan: 3 yıl; profil: 5 yıl" and full["experience"].status == "met"
    assert full["required-skills"].detail == "bulunan: sql" and full["preferred-skills"].detail == "bulunan: excel"
    assert "Ankara" in full["location"].detail and "belirtilmemiş" in full["language"].detail
    bare = next(r for r in rows if not r.title).x
    assert all(len(x.detail) > 5 for x in bare) and len(bare) == 9


def test_select_sources(spark):
    rows = [(f"s{i:02d}", "US" if i % 3 == 0 else "TR", ["ats", "niche-board", "remote-board", "general-board"][i % 4], "active", i + 1, 0.5, ts(i), 1, 1, 2, 1, 0, "tech,genel" if i % 2 else "saglik") for i in range(40)]
    sources = spark.createDataFrame(rows, "name string, country string, source_type string, status string, priority int, reliability double, last_scanned_at timestamp, total_scans int, successful_scans int, new_jobs int, relevant_jobs int, duplicate_jobs int, profession_tags string")
    profiles = spark.createDataFrame([(["tech", "genel"], "any")] * 3 + [(["genel"], "remote")], "profile_tags array<string>, work_mode string")
    picked = hl.select_sources(sources, hl.distinct_needs(profiles), F.lit(ts(100))).join(sources.select("name", "country", "last_scanned_at"), "name").collect()
    for need in {r["need_id"] for r in picked}:
        mine = [r for r in picked if r["need_id"] == need]
        assert {f"s{i:02d}" for i in range(5)} <= {r["name"] for r in mine} and len(mine) <= 14
        assert "s05" in {r["name"] for r in mine}  # longest waiting
        rest = [r for r in mine if r["priority"] > 6]
        assert sum(r["country"] != "TR" for r in rest) <= (2 if need.endswith("true") else 5)
        assert all(sum(r["source_type"] == kind for r in rest) <= 3 for kind in {r["source_type"] for r in rest})


def test_select_sources_equals_a_loop(spark):
    """The greedy pass over every source, source by source, on registries with few and many fixed ones."""
    import random

    rng = random.Random(9)
    kinds, tags = ["ats", "niche-board", "remote-board", "general-board", "aggregator"], ["tech,genel", "saglik", "finans", "genel", "tech"]
    schema = ("name string, country string, source_type string, status string, priority int, reliability double, last_scanned_at timestamp, total_scans int, "
              "successful_scans int, new_jobs int, relevant_jobs int, duplicate_jobs int, profession_tags string")
    for n, low in ((300, 4), (60, 1), (40, 60)):
        rows = [(f"s{i:03d}", rng.choice(["US", "TR", "TR"]), rng.choice(kinds), rng.choice(["active", "active", "candidate"]), rng.randint(low, 60) if i > 20 else rng.randint(1, 6),
                 rng.choice([0.0, 0.5, 1.0]), rng.choice([None, ts(rng.randint(0, 90))]), rng.randint(0, 5), 1, rng.randint(0, 9), rng.randint(0, 5), rng.randint(0, 5), rng.choice(tags)) for i in range(n)]
        sources = spark.createDataFrame(rows, schema)
        profiles = spark.createDataFrame([(["tech", "genel"], "any"), (["genel"], "remote"), (["saglik", "genel"], "remote")], "profile_tags array<string>, work_mode string")
        needs = hl.distinct_needs(profiles)
        got = {}
        for r in hl.select_sources(sources, needs, F.lit(ts(100))).collect():
            got.setdefault(r.need_id, set()).add(r.name)
        for need in needs.collect():
            scores = {r.name: r.s for r in sources.select("name", hl.selection_score(
                F.split("profession_tags", ","), F.array(*map(F.lit, need.profile_tags)), c("reliability"), c("last_scanned_at"), F.lit(ts(100)), c("total_scans"), c("new_jobs"),
                c("relevant_jobs"), c("duplicate_jobs"), c("priority")).alias("s")).collect()}
            active = [r for r in rows if r[3] == "active"]
            picked, types, foreign, rest = [r[0] for r in active if r[4] <= 5], {}, 0, [r for r in active if r[4] > 5]
            first = min(rest, key=lambda r: (r[6] is not None, r[6] or ts(0), r[4], r[0]), default=None)
            if first and len(picked) < 14:
                picked.append(first[0])
                types[first[2]] = 1
            for r in sorted(rest, key=lambda r: (-scores[r[0]], r[0])):
                if len(picked) >= 14:
                    break
                if r[0] in picked or scores[r[0]] < -5 or types.get(r[2], 0) >= 3 or (r[1] != "TR" and foreign >= (2 if need.home_only else 5)):
                    continue
                foreign += r[1] != "TR"
                picked.append(r[0])
                types[r[2]] = types.get(r[2], 0) + 1
            assert got[need.need_id] == set(picked)


def test_reuse(spark):
    rows = [
        (1, 7, "f", ts(0), True, False, 3), (2, 7, "f", ts(3), True, True, 3), (3, 7, "f", ts(5), True, False, 0), (4, 7, "f", ts(5.5), False, False, 0),
        (5, 7, "f", ts(6), True, False, 4), (6, None, "f", ts(6.5), True, False, 4), (7, None, "f", ts(7), True, False, 4), (8, 7, "g", ts(7), True, False, 4),
    ]
    df = spark.createDataFrame(rows, "search_id int, user_id int, fingerprint string, ts timestamp, completed boolean, is_copy boolean, result_count int")
    got = {r["search_id"]: r["reused_id"] for r in ru.reusable_results(df).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: 6, 8: None}


def test_verification_order(value):
    def decide(skipped=False, age=0, code=200, final="https://x/a", body="y" * 600):
        now = F.lit(ts(0))
        v = hl.verification(
            F.lit(skipped), F.timestamp_seconds(F.unix_seconds(now) - age * 86400), now, F.lit(code).cast("int"), F.lit("https://x/a/"), F.lit(final), F.lit(body)
        )
        return value(v)["decision"]

    assert [decide(skipped=True, age=99), decide(age=31, code=None), decide(code=None), decide(code=410), decide(code=429), decide(code=503)] == [
        "skipped", "expired", "error", "expired", "error", "error"]
    assert [decide(final="https://x/"), decide(body="İlan KAPANDI" + "y" * 600), decide(body="kısa"), decide()] == ["expired", "expired", "error", "active"]


# --- ledger ---------------------------------------------------------------------------------


def test_decide(value):
    def status(**change):
        base = {"channel": "email", "recipient": "a@b.c", "confidence": "high", "score": 90, "within_limit": True, "has_file": True, "auto_apply": True, "auto_min": 80}
        base.update(change)
        return tuple(value(ap.decide(**{k: F.lit(v) for k, v in base.items()})))

    assert status() == ("queued", None) and status(channel="portal") == ("manual_required", "no_address")
    assert status(auto_apply=False)[1] == "auto_off" and status(confidence="low")[1] == "low_confidence" and status(score=79)[1] == "below_auto_score"
    assert status(within_limit=False)[1] == "daily_limit" and status(has_file=False) == ("needs_review", "no_file")


def test_heatmap(spark):
    rows = [("Dev", "React ve react, standart", ["SQL"], []), ("Dev", "react native", [], ["sql"])]
    df = spark.createDataFrame(rows, "title string, description string, requirements array<string>, candidate_criteria array<string>")
    got = {r["skill"]: (r["n"], r["status"]) for r in an.skill_heatmap(df, lx.SAMPLE_SKILLS, ["SQL", "React"]).collect()}
    assert got == {"sql": (2, "present"), "react": (1, "present"), "react native": (1, "partial")}


def test_progress(spark):
    rows = [(1, "plan", "done", ts(0), 0), (1, "primary-search", "running", ts(1), 1), (1, "match", "running", ts(2), 2), (2, "plan", "running", ts(0), 3)]
    rows += [(3, name, "done", ts(i), 10 + i) for i, (name, _) in enumerate(lx.STAGE_WEIGHTS)]
    df = spark.createDataFrame(rows, "job_id int, stage string, status string, ts timestamp, event_id int")
    got = {r["job_id"]: r["percent"] for r in an.stage_progress(df).collect()}
    assert got == {1: int(8 + 22 + 8.5 + 0.5), 2: 4, 3: 99}
