"""Dictionary tables against the expressions that hold the dictionary in the plan, and against brute force."""

import random

from pyspark.sql import functions as F

from postmill.functions import extract as ex
from postmill.functions import text as tx
from postmill.operators import analytics as an
from postmill.operators import dictionary as dc
from postmill.plans.matching_queries import dictionary_skills
from postmill.plans.tables import Tables

c = F.col


def table(spark, terms):
    return spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "label string, place int")


def sample(spark, terms, n=400, seed=2):
    rng = random.Random(seed)
    fill = ["ile", "ve", ",", "kategori", "standart", "\n", "  ", "-", "x", "İstanbul", "(go)", "C++/C#", "next", ".js"]
    texts = ["".join(rng.choice([*terms, *fill]) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    rows = [(k, t.upper() if k % 5 == 0 else t) for k, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "word " * 20_000 + "sql")]
    return spark.createDataFrame(rows, "listing_id long, text string")


TERMS = ["SQL", "React", "React Native", "Next.js", "C++", "C#", "Go", "İhracat", "Dış Ticaret", "dış ticaret", "Ön  Muhasebe", "&&", "R", "a.b", "ReactNext", "ş", "%%"]


def test_table_equals_plan(spark):
    texts = sample(spark, TERMS)
    # one spelling per folded key, as the table keeps it
    got = {r.listing_id: r.skills for r in dc.known_skills(texts, table(spark, TERMS)).collect()}
    want = {r.listing_id: r.s for r in texts.select("listing_id", ex.known_skills(c("text"), TERMS).alias("s")).collect() if r.s}
    assert got == want and len(got) > 300
    counted = {(r.listing_id, r.skill) for r in dc.counted_skills(texts, table(spark, [t for t in TERMS if t not in ("&&", "%%")])).collect()}
    plain = texts.filter("text is not null").select("listing_id", F.explode(ex.counted_skills(c("text"), [t for t in TERMS if t not in ("&&", "%%")])).alias("s"))
    assert counted == {(r.listing_id, r.s) for r in plain.collect()}


def test_heatmap_equals_the_one_in_the_plan(spark):
    texts = sample(spark, TERMS[:6], 120, 5)
    pairs = texts.select("listing_id", F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("profile_id")).filter("pmod(xxhash64(listing_id, profile_id), 3) = 0")
    own = spark.createDataFrame([(k, ["sql", "react"]) for k in range(5)], "profile_id int, own_skills array<string>")
    got = dc.heatmap_by(pairs, texts, table(spark, TERMS[:6]), own)
    none = F.array().cast("array<string>")
    listings = texts.withColumns({"title": F.lit(""), "description": F.coalesce("text", F.lit("")), "requirements": none, "candidate_criteria": none})
    want = an.skill_heatmap_by(pairs.join(listings, "listing_id"), own, TERMS[:6])
    names = ["profile_id", "position", "skill", "n", "share", "status"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect())) and got.count() > 10


def test_a_hundred_thousand_phrases(spark):
    words = spark.range(100_000).select(F.concat(F.lit("skill"), F.conv(c("id"), 10, 36), F.when(c("id") % 3 == 0, " plus").otherwise("")).alias("label"))
    texts = spark.range(200).select(c("id").alias("listing_id"), F.concat(F.lit("asks for skill"), F.conv(c("id") * 499, 10, 36), F.lit(" plus, and more")).alias("text"))
    found = dc.known_skills(texts, words)
    assert len(found._jdf.queryExecution().analyzed().toString()) < 60_000
    got = {r.listing_id: r.skills for r in found.collect()}
    spellings = {r.label for r in words.collect()}
    assert len(got) == 200
    for k, skills in got.items():
        name = "skill" + spark_conv(k * 499)
        longest = max((s for s in spellings_of(name, spellings)), key=len)
        assert skills == [longest]


def spark_conv(n):
    digits, out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""
    while n:
        n, r = divmod(n, 36)
        out = digits[r] + out
    return out or "0"


def spellings_of(name, spellings):
    text = name + " plus"
    return [text[:k] for k in range(6, len(text) + 1) if text[:k] in spellings]


def test_empty_sides(spark):
    texts = spark.createDataFrame([(1, "sql")], "listing_id long, text string")
    assert dc.known_skills(texts, table(spark, [])).count() == 0
    assert dc.known_skills(texts.limit(0), table(spark, ["SQL"])).count() == 0
    assert texts.select(tx.normalize(c("text"))).count() == 1


def test_words_meet_where_the_dictionary_is_large(spark, monkeypatch):
    """The tree and the joins find the same, texts without key and keys that repeat included."""
    texts = sample(spark, TERMS).unionByName(spark.createDataFrame([(None, "sql && react"), (3, "sql %%"), (3, "sql %%"), (5, "nothing")], "listing_id long, text string"))
    by_tree = dc.known_skills(texts, table(spark, TERMS))
    assert "Exchange" not in by_tree._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dc, "TREE_PHRASES", 3)
    by_words = dc.known_skills(texts, table(spark, TERMS))
    assert sorted(map(str, by_tree.collect())) == sorted(map(str, by_words.collect()))
    assert [r.skills for r in by_tree.collect() if r.listing_id is None] == [["&&"]]


def test_every_word_of_the_profiles_is_sought(spark, tmp_path):
    """Words of two letters and more, not only long ones."""
    spark.createDataFrame([(1, "Go und die Arbeitswelt x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "Go!"), (2, "die Arbeitswelt, und"), (3, "x"), (4, None)]
    spark.createDataFrame([(k, t, "de", "src1", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.skills for r in dictionary_skills(Tables(spark, str(tmp_path))).collect()}
    assert found == {1: "go", 2: "die arbeitswelt|und"}
