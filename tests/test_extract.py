import pytest
from pyspark.sql import functions as F

from postmill.functions import extract as ex
from postmill.functions import profile as pf

lit = F.lit


def arr(*items):
    return F.array(*[lit(x) for x in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize(("line", "want"), [
    ("Tecrübe En az 4 yıl tecrübeli", (4, None, False)), ("Tecrübe En çok 2 yıl tecrübeli", (None, 2, False)),
    ("Tecrübe Tecrübeli / Tecrübesiz", (None, None, True)), ("Tecrübe belirtilmemiş", (None, None, False)),
    ("Tecrübe En az 1 yıl, en çok 3 yıl Yapay zeka ile 9 yıl", (1, 3, False)), ("Tecrübe En az 0 yıl, tecrübesiz", (0, None, True)),
])
def test_experience(value, line, want):
    assert tuple(value(ex.experience_requirement(lit(line)))) == want


def test_education_merges_levels(value):
    rows = value(ex.education_requirement(lit("Eğitim Seviyesi Ön Lisans(Mezun), Üniversite(Öğrenci), Üniversite(Mezun), Yüksek Lisans(Mezun)")))
    assert [tuple(r) for r in rows] == [("onlisans", False, True), ("universite", True, True), ("yukseklisans", False, True)]


def test_languages(value):
    rows = value(ex.language_requirement(lit("Yabancı Dil Almanca(Konuşma : Orta), Rusça(x), Fr(İleri)")))
    assert [tuple(r) for r in rows] == [("Almanca", "orta"), ("Rusça", "belirtilmemis")]


@pytest.mark.parametrize(("text", "kind", "level"), [
    ("Yaz Stajyeri", "staj", "stajyer"), ("Takım Lideri tam zamanlı", "tam-zamanli", "lead"), ("Kıdemli aşçı", "belirtilmemis", "senior"),
    ("Jr. analist contract", "sozlesmeli", "junior"), ("international role", "belirtilmemis", "belirtilmemis"),
])
def test_labels(value, text, kind, level):
    assert (value(ex.employment_type(lit(text))), value(ex.seniority(lit(text)))) == (kind, level)


def test_requirement_split(value):
    got = value(ex.split_requirements(arr("Excel bilgisi zorunludur. SAP bilmesi tercihen istenir, Ehliyet sahibi", "a:{b:1;c:2}", "kısa")))
    assert got["required"] == ["Excel bilgisi zorunludur.", "Ehliyet sahibi"] and got["preferred"] == ["SAP bilmesi tercihen istenir,"]


def test_role_falls_back_to_description(value):
    role = value(ex.role_requirements(
        lit("Junior Aşçı"), lit("En az 2 yıl deneyim gereklidir."), arr("x={};y={};z={}"), arr(), lit(None).cast("string"), lit("remote")
    ))
    assert role["min_years"] == 2 and role["required_skills"] == ["En az 2 yıl deneyim gereklidir."]
    assert role["seniority"] == "junior" and role["locations"] == [] and role["work_mode"] == "remote" and role["extracted_fields"] == 2


def test_skills(value):
    assert value(ex.known_skills(lit("react native ve React, ReactNext.js"))) == ["React Native", "React", "Next.js"]
    assert value(ex.counted_skills(lit("kategori ve standart; Git'i bilir, sql"))) == ["git", "sql"]
    assert value(ex.split_skill_segment(lit("HTMLCSSGitSQL"))) == ["HTML", "CSS", "Git", "SQL"]
    assert value(ex.split_skill_segment(lit("SQL ile rapor hazırladım"))) == ["SQL ile rapor hazırladım"]


def test_listing_terms_and_subsumption(value):
    terms = value(ex.listing_terms(lit("Dev"), lit("Tailwind CSS ve Java biliyor"), arr("• En az üç yıl Docker tecrübesi"), arr(), ["Java", "CSS", "Tailwind CSS", "Docker"]))
    assert terms["skills"] == ["Java", "Tailwind CSS", "Docker"] and terms["requirements"] == ["En az üç yıl Docker tecrübesi"]
    assert value(ex.drop_subsumed(arr("Tailwind", "Tailwind CSS", "SQL"))) == ["Tailwind CSS", "SQL"]


@pytest.mark.parametrize(("text", "want"), [
    ("Özgeçmişinizi ik@lezzet.com.tr adresine iletin", "ik@lezzet.com.tr"), ("Sorular: destek@lezzet.com", None),
    ("info@kariyer.net ya da ayse.kaya@lezzet.com", "ayse.kaya@lezzet.com"), ("bilgi@lezzet.com", None), ("", None),
])
def test_application_email(value, text, want):
    assert value(ex.application_email(lit(text))) == want


def test_channel_prefers_requirements(value):
    got = value(ex.application_channel(lit("cv: hr@a.com"), arr("başvuru: ik@b.com"), arr()))
    assert tuple(got) == ("email", "ik@b.com", "listing_requirements")


CV = """Deniz Kaya
Muhasebe Uzmanı
deniz@posta.com, 0532 111 22 33, Bursa
İŞ DENEYİMİ
Uzman - Defter, 2019 - halen
• Bordro hazırladı
Stajyer - Kasa 2018 - 2019
BECERİLER: Excel, SAP
DİLLER
İngilizce (C1), Rusça
EĞİTİM
İşletme - Ege 2014 - 2018
"""


def test_structured_cv(value):
    cv = value(pf.structured_cv(lit(CV)))
    assert cv["contact"]["full_name"] == "Deniz Kaya" and cv["contact"]["location"] == "Bursa"
    assert [(e["role"], e["period"], e["bullets"]) for e in cv["experience"]] == [
        ("Uzman", "2019 - halen", ["Bordro hazırladı"]), ("Stajyer", "2018 - 2019", []),
    ]
    assert cv["skills"] == ["Excel", "SAP"] and [tuple(x) for x in cv["languages"]] == [("İngilizce", "C1"), ("Rusça", None)]
    assert cv["education"][0]["school"] == "Ege" and cv["headline"] == "Muhasebe Uzmanı"


def test_heuristic_profile_and_score(value):
    p = value(pf.heuristic_profile(lit("6 yıl muhasebe, Excel, english, lisans mezunu")))
    assert p["years_of_experience"] == 6 and p["seniority"] == "senior" and p["education_level"] == "universite"
    assert p["titles"] == ["Muhasebe Uzmanı", "Accountant"] and p["languages"] == ["İngilizce"]
    score = value(pf.cv_score(lit("kısa metin"), lit(0), lit(0)))
    assert score["score"] == 4 + 0 + 3 + 10 + 5 + 3 + 2 + 1 and score["category"] == "Zayıf uyum"


def test_evidence(value):
    hay, declared = lit("react ve go bilen"), arr("power bi")
    assert [value(pf.has_evidence(lit(t), hay, declared)) for t in ("Go", "C", "React", "Power BI Desktop", "Rust")] == [True, False, True, True, False]


def test_gaps_keep_the_worst(value):
    items = F.array(*[F.struct(lit(r).alias("requirement"), lit(s).alias("severity")) for r, s in (("SQL", "nice-to-have"), ("sql!", "critical"), ("Go", "critical"))])
    assert [tuple(x) for x in value(pf.merge_gaps(items))] == [("sql!", "critical"), ("Go", "critical")]


def test_texts(value):
    none = lit(None).cast("string")
    line = pf.digest_line(lit(1), lit("Aşçı"), lit("Lezzet"), lit(""), lit(77), lit("https://x"))
    assert value(line) == "#1 77/100: Aşçı, Lezzet\nhttps://x"
    assert value(pf.email_subject(lit("Aşçı"), none)) == "Aşçı" and value(pf.email_subject(lit("Aşçı"), lit("D K"))) == "Aşçı / D K"
    letter = value(pf.cover_letter(lit("D K"), lit("Lezzet"), lit("Aşçı"), none, arr("Excel")))
    assert "(Lezzet)" in letter and "Excel" in letter and "Son görevim" not in letter
    assert value(pf.profile_summary(none, none, lit("Aşçı"), F.array().cast("array<string>"), none)) == "Hedef: Aşçı."


def test_split_sides_of_a_noisy_text(spark):
    """Markers at the start stay, later ones cut; every sentence is on one side."""
    text = ["Yapay zeka bilen aranıyor; Java tercihen bilinmeli, Yan Haklar sunulur"]
    row = spark.createDataFrame([(text,)], "x array<string>").select(ex.split_requirements(F.col("x")).alias("s")).first().s
    assert row.required == ["Yapay zeka bilen aranıyor;"] and row.preferred == ["Java tercihen bilinmeli,"]


def test_requirement_lines_of_signs_and_empty_texts(spark, tmp_path):
    from postmill.plans.tables import Tables

    long = " ".join(f"word{i}" for i in range(25))
    texts = ["a.b + # c++ long enough here", long, None, "", "."]
    docs = [(i, text, "en", "src0", 1) for i, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.listing_id: r.requirements for r in Tables(spark, str(tmp_path)).listings.select("listing_id", "requirements").collect()}
    want = long.split()
    assert got == {0: ["ab c long enough here"], 1: [" ".join(want[:12]), " ".join(want[12:24])], 2: [], 3: [], 4: []}


def test_all_profile_links_are_kept(value):
    links = [f"github.com/person{k}" for k in range(9)]
    assert value(pf.contact_fields(lit("\n".join(links)))).links == links


def test_structured_cv_keeps_every_entry(value):
    jobs = [line for k in range(15) for line in (f"Uzman{k} - Firma{k} 2001 - 2002", *([f"• Madde {k} {j}" for j in range(14)] if k == 14 else []))]
    many = {"DENEYİM": jobs, "EĞİTİM": [f"Bölüm{k} - Okul{k} 2001 - 2002" for k in range(11)], "BECERİLER": [", ".join(f"beceri{k}" for k in range(70))],
            "DİLLER": [f"Dil{k} (B2)" for k in range(13)], "PROJELER": [f"Proje{k}: ayrıntı" for k in range(13)], "ÖZET": ["kelime " * 300],
            "SERTİFİKALAR": [f"Belge {k}" for k in range(25)], "HOBİLER": [f"İlgi {k}" for k in range(18)]}
    cv = value(pf.structured_cv(lit("\n".join(x for head, body in many.items() for x in (head, *body)))))
    assert [e["role"] for e in cv["experience"]] == [f"Uzman{k}" for k in range(15)] and len(cv["experience"][14]["bullets"]) == 14
    assert [len(cv[n]) for n in ("education", "skills", "languages", "projects", "certifications", "extras")] == [11, 70, 13, 13, 25, 18]
    assert len(cv["summary"]) > 900
