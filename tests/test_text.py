import pytest
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import extract as ex
from postmill.functions import profile as pf
from postmill.functions import quality as ql
from postmill.functions import text as tx

lit = F.lit


def arr(*items):
    return F.array(*[lit(x) for x in items])


@pytest.mark.parametrize(("raw", "want"), [
    ("İŞ  Deneyimi", "is deneyimi"), ("C++ / .NET & IĞDIR", "c++ .net igdir"), ("", ""), ("  Önyüz!! ", "onyuz"),
])
def test_normalize(value, raw, want):
    assert value(tx.normalize(lit(raw))) == want


def test_fold_keeps_positions(value):
    text = "ŞIĞ İÇ ÖÜ ışık"
    assert len(value(tx.fold(lit(text)))) == len(text)


def test_clean_html(value):
    html = "<p>a&nbsp;b</p><SCRIPT>if(1<2){}</SCRIPT><style>x{}</style> &amp;&quot;c&#39;"
    assert value(tx.clean_html(lit(html))) == "a b &\"c'"


@pytest.mark.parametrize(("raw", "want"), [
    ("İzmir, izmir, Ankara", "İzmir, Ankara"), ("Bursa", "Bursa"), (" , ", ","), ("A,B,a , b", "A, B"),
])
def test_location_segments(value, raw, want):
    assert value(tx.dedupe_location_segments(lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTP://Site.COM/Yol/#x", "http://site.com/Yol"), ("https://a.b/c?d=1", "https://a.b/c?d=1"), ("bozuk//", "bozuk"),
])
def test_normalize_url(value, raw, want):
    assert value(tx.normalize_url(lit(raw))) == want


@pytest.mark.parametrize(("href", "want"), [
    ("/x", "https://h.co/x"), ("y", "https://h.co/a/y"), ("//z.co/q", "https://z.co/q"), ("?p=2", "https://h.co/a/b?p=2"),
    ("#top", "https://h.co/a/b"), ("http://o.co/1#f", "http://o.co/1"),
])
def test_absolute_url(value, href, want):
    assert value(tx.absolute_url(lit(href), lit("https://h.co/a/b"))) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("Deniz Lojistik Sanayi ve Ticaret Limited Şirketi", "deniz lojistik"), ("Kuzey Yazılım A.Ş.", "kuzey yazilim"),
    ("İş İlanı Ver", ""), ("Holding", "holding"), (None, ""),
])
def test_normalize_company(value, raw, want):
    assert value(tx.normalize_company(lit(raw).cast("string"))) == want


def test_title_keeps_seniority_and_hours(value):
    assert value(tx.normalize_title(lit("Senior Aşçı - Remote (m/f/d)"))) == "senior asci"
    assert value(tx.normalize_title(lit("Kasiyer Part Time"))) == "kasiyer part time"


def test_fingerprint_needs_company_and_title(value):
    assert value(tx.fingerprint(lit("Aşçı"), lit("Lezzet A.Ş."), lit("İzmir(Konak)"))) == "lezzet|asci|izmir"
    assert value(tx.fingerprint(lit("Aşçı"), lit(None).cast("string"), lit("İzmir"))) == ""


@pytest.mark.parametrize(("title", "want"), [
    ("Yarı Zamanlı Kurye", "part"), ("Full-Time Kurye", "full"), ("Stajyer (part time)", "staj"), ("Kurye", None),
])
def test_employment_marker(value, title, want):
    assert value(tx.employment_marker(lit(title))) == want


def fingerprint_of(value, **changed):
    base = {
        "user_id": 7, "cv_id": 3, "cv_text": "metin", "positions": ["Aşçı", "Garson"], "seniority": None,
        "location_mode": "cities", "cities": ["İzmir", "Bursa"], "work_mode": "any", "note": None,
    }
    base.update(changed)
    columns = {k: arr(*v) if isinstance(v, list) else (lit(v) if v is not None else lit(None).cast("string")) for k, v in base.items()}
    return value(tx.search_fingerprint(**columns))


def test_search_fingerprint_is_metamorphic(value):
    base = fingerprint_of(value)
    same = [{"positions": ["garson ", "AŞÇI", "Garson"]}, {"cities": ["bursa", "İZMİR"]}, {"cv_text": " metin\n"}, {"seniority": "any"}]
    other = [
        {"user_id": 8}, {"cv_id": 4}, {"cv_text": "yeni"}, {"positions": ["Aşçı"]}, {"seniority": "junior"},
        {"location_mode": "all"}, {"cities": ["İzmir"]}, {"work_mode": "remote"}, {"note": "gece"},
    ]
    assert all(fingerprint_of(value, **change) == base for change in same)
    hashes = {fingerprint_of(value, **change) for change in other}
    assert len(hashes) == len(other) and base not in hashes


def test_company_slugs(value):
    want = ["mavi-ay-oyun", "maviayoyun", "mavi-ay", "maviay"]
    assert value(tx.company_slugs(lit("Mavi Ay Oyun Teknoloji A.Ş."))) == want
    assert value(tx.company_slugs(lit("A.Ş."))) == []


def test_infer(value):
    assert value(tx.infer_work_mode(lit("Evden çalışma, hibrit olabilir"))) == "remote"
    assert value(tx.infer_city(lit("Merkez ofis: ESKİŞEHİR"))) == "Eskişehir"
    assert value(tx.external_id(lit("https://x.co/ilan-1234567?x=1"))) == "1234567"


def test_cleanup(value):
    assert value(tx.cleanup_title(lit("Aşçı - Yenibiriş ilanı"))) == "Aşçı"
    assert value(tx.cleanup_title(lit("Aşçı | Site adı"))) == "Aşçı"
    assert value(tx.cleanup_company(lit("Hemen Başvur"))) is None
    assert value(tx.cleanup_company(lit(" Lezzet  A.Ş. "))) == "Lezzet A.Ş."
    assert value(tx.clean_terms(arr("<b>", " a  b ", "a b", "'"))) == ["b", "a b"]


@pytest.mark.parametrize("title", ["Just a moment...", "Bir dakika lütfen", "Access denied", "Error 403", "ROBOT DEĞİLİM"])
def test_blocked_pages(value, title):
    assert value(ql.is_blocked_page(lit(title), lit("")))


def test_non_listing_pages(value):
    assert value(ql.is_non_listing_page(lit("Konak konumundaki Aşçı maaşları"), lit("")))
    assert value(ql.is_non_listing_page(lit("Aşçı"), lit("https://x.co/career/asci/salaries/izmir")))
    assert not value(ql.is_non_listing_page(lit("Maaş ve Bordro Uzmanı"), lit("https://x.co/is-ilani/bordro")))


@pytest.mark.parametrize(("title", "url", "want"), [
    ("Kıdemli Aşçıbaşı", "https://x.co/is-ilani/asc%C4%B1bas%C4%B1-12345", True),
    ("Garson Aranıyor", "https://x.co/is-ilani/muhasebe-uzmani-99887", False),
    ("Garson Aranıyor", "https://x.co/is-ilani/99887", True), ("Aşçı", "https://jobs.lever.co/a/0f-1", True), ("Aşçı", "bozuk", True),
])
def test_title_url(value, title, url, want):
    if "asc%C4" in url:
        title = "Ascibasi Aranıyor"
    assert value(ql.title_matches_url(lit(title), lit(url))) is want


@pytest.mark.parametrize(("asked", "got", "generic", "left"), [
    ("https://x.co/ilanlar/asci", "https://x.co/ilanlar", True, True),
    ("https://x.co/ara?kw=asci&s=1", "https://x.co/ara?s=1", True, False),
    ("https://x.co/ilan/1", "https://m.x.co/ilan/1", True, False),
    ("http://x.co/ilan/1/", "https://x.co/ilan/1", False, False), ("bozuk", "x", False, False),
])
def test_redirects(value, asked, got, generic, left):
    assert value(ql.fell_back_to_generic(lit(asked), lit(got))) is generic
    assert value(ql.left_detail_page(lit(asked), lit(got))) is left


def test_detail_urls(value):
    def check(url):
        return value(ql.is_detail_url(lit(url), lit("x.co")))

    assert check("https://www.x.co/ilan/asci-garson-kurye") and check("https://x.co/abc-12345")
    assert not check("https://x.co/jobs/kurye") and not check("https://x.co/search/abc-def-ghi") and not check("https://y.co/abc-12345")


def test_texts_are_normalised_once_for_all_rules(spark):
    df = spark.createDataFrame([("Ankara, Lisans",)], "t string")
    for column in (pf.find_location(F.col("t")), pf.normalize_education(F.col("t")), pf.cv_score(F.col("t"), F.lit(1), F.lit(1))["score"]):
        plan = df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("translate(") == 1
    rows = spark.createDataFrame([("izmir and Ankara",), ("ankaralar",), (None,)], "t string").coalesce(1)
    first = next(city for city in lx.CONTACT_CITIES if ex.normalize_py(city) in ("ankara", "izmir"))
    assert [r[0] for r in rows.select(pf.find_location(F.col("t"))).collect()] == [first, None, None]


def test_repeated_lines_are_told_in_one_pass(spark):
    """40,000 lines of 20,000 texts: comparing every line with all before it would not end in time."""
    lines = [f"İlan {i % 20000}" if i % 2 else f"ilan {i % 20000}" for i in range(40000)]
    rows = spark.createDataFrame([(lines,), ([],), (None,), (["b", None, "A", "", "a", "B"],)], "x array<string>").repartition(1)
    got = [r[0] for r in rows.select(tx.distinct_ignore_case(F.col("x"))).collect()]
    assert sorted(got, key=lambda x: -1 if x is None else len(x)) == [None, [], ["b", "A"], lines[:20000]]


RULES = [p for rules in (lx.PROFILE_EDUCATION_PATTERNS, lx.LANGUAGE_NAMES, lx.TITLE_RULES, lx.INDUSTRY_RULES, lx.CV_SENIORITY_PATTERNS) for p, _ in rules]


def test_found_equals_rlike(spark):
    """Every rule, and patterns of other shapes, on texts that hold their strings whole, cut and run together."""
    shapes = [r"[^\s@]+@[^\s@]+\.[^\s@]+", "a|b*", "ab?c|x", "(ab|c)d", "ab+c", r"\bcd\b", "^abc", "(?i)cd", "a{2}b", "[|]x|y", r"\Qa|b\E", "x(?=y)"]
    words = sorted({w for p in RULES for w in (tx.needles(p) or ([], False))[0]})
    texts = [None, "", "a b@c.de x", "abc acd cd xcdx", "aab |x y xy", "CD a|b", "on yuz onyuz full stack eticaret e-ticaret", "  \t", *words,
             *[f"x{w}x" for w in words], *[w[:-1] for w in words], *[f"{a} {b}" for a, b in zip(words, words[1:])]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in RULES + shapes:
        different = rows.filter(~tx.found(F.col("t"), pattern).eqNullSafe(F.col("t").rlike(pattern)))
        assert different.count() == 0, pattern


def test_a_cv_is_searched_by_few_patterns(spark):
    """A text is normalised once and years are sought once; rules of plain words alone need no pattern."""
    plan = spark.range(1).select(pf.heuristic_profile(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(yil|year)") == 1 and plan.count("[a-z0-9+#.]+") == 1
    assert "RLIKE doktora" not in plan and "RLIKE react native" not in plan
