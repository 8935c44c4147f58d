import random

from postmill.operators import retrieve as rt
from postmill.plans.matching_queries import required
from postmill.plans.tables import Tables
from postmill.session import cut


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_searched_while_their_words_are_at_hand(spark):
    """Texts meet only what terms are looked up by, in one join; repeated and null ids give what they gave."""
    rows = [(1, "big data engineer"), (1, "big data lake"), (1, "big data lake"), (2, "data big"), (None, "big data"), (None, "data"), (3, None), (4, "abig datax")]
    texts = spark.createDataFrame(rows, "listing_id long, text string")
    terms = spark.createDataFrame([("big data",), ("data",), ("nowhere else",), ("",), ("a",)], "term string")
    found = rt.containing_texts(texts, terms)
    assert optimized(found).count("Join ") == 1
    got = sorted((r.term, r.listing_id or 0) for r in found.collect())
    assert got == sorted([("big data", 1)] * 3 + [("big data", 4)] + [("data", k) for k in (0, 1, 2, 4)] + [("a", k) for k in (0, 1, 2, 4)])
    limit, rt.LOOKED_UP = rt.LOOKED_UP, 0
    try:
        assert sorted((r.term, r.listing_id or 0) for r in rt.containing_texts(texts, terms).collect()) == got
    finally:
        rt.LOOKED_UP = limit


def test_only_retrieved_listings_are_parsed(spark):
    """Requirement lines are made above the semi join; texts without words give no listing, repeated rows stay."""
    rows = [(1, "wanted python skills"), (2, "java"), (2, "needed java skills"), (2, "needed java skills"), (3, "..."), (4, "never retrieved text")]
    docs = spark.createDataFrame([(k, "en", "src0", 200, text) for k, text in rows], "doc_id long, lang string, source string, n_chars long, text string")
    tables = Tables(spark, "")
    tables.__dict__["documents"] = docs
    pairs = cut(spark.createDataFrame([(9, 1), (8, 1), (9, 2), (9, 3), (9, None)], "profile_id long, listing_id long"))
    kept = required(tables, pairs).select("listing_id", "requirements")
    assert "regexp_extract_all" not in optimized(kept).split("Join LeftSemi")[1]
    lines = [(1, ["wanted python skills"]), (2, ["needed java skills"]), (2, ["needed java skills"])]
    assert sorted((r.listing_id, r.requirements) for r in kept.collect()) == lines


def test_all_relevant_pairs_are_found_where_the_texts_lie(spark, monkeypatch):
    """What joins over all hits find, with ids that repeat or are null; texts and pairs of other ids are not shuffled."""
    rng = random.Random(3)
    words = ["data", "big", "dat", "lake", "engineer", "ata", "go", "c++", "qqq"]
    text = lambda n: rng.choice([None, *[" ".join(rng.choice(words) + rng.choice(["", "", "x"]) for _ in range(n))] * 8])
    rows = [(k, text(2) or "", text(5)) for k in range(150)] + [(k % 7, text(2) or "", text(4)) for k in range(20)] + [(None, "data", "big data"), (None, "", "dat lake")]
    texts = spark.createDataFrame(rows, "listing_id long, head string, body string")
    wanted = [(k, t) for k in range(6) for t in rng.sample(["data", "big data", "dat", "lake engineer", "ata", "c++", "go big data", "never", "engineer"], 2)]
    terms = cut(spark.createDataFrame([*wanted, wanted[0], (None, "lake")], "profile_id int, term string"))
    found = rt.relevant_everywhere(terms, texts)
    got = sorted(map(str, found.collect()))
    monkeypatch.setattr(rt, "LOOKED_UP", 0)
    assert got == sorted(map(str, rt.relevant_everywhere(terms, texts).collect())) and len(got) > 200
    monkeypatch.undo()
    assert "Exchange hashpartitioning" not in rt.relevant_everywhere(terms, texts.filter("listing_id BETWEEN 20 AND 140"))._jdf.queryExecution().executedPlan().toString()
    assert rt.relevant_everywhere(terms.limit(0), texts).count() == 0
