import json

from pyspark.sql import functions as F

from postmill.sources import feeds as fd
from postmill.sources import listings as ls
from postmill.sources import pages as pg

c = F.col


def now():
    return F.lit("2024-01-02").cast("timestamp")


def test_listing_file(spark, tmp_path):
    rows = [
        {"platform": "P", "title": "Aşçı", "url": "https://p/1", "workMode": "Remote", "category": "odd", "postedAt": "2024-01-01T10:00:00Z"},
        {"platform": "P", "title": "", "url": "https://p/2"}, {"platform": "P", "title": "X"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    got = ls.read_listing_file(spark, str(tmp_path / "a.json")).collect()
    assert len(got) == 1 and got[0]["work_mode"] == "remote" and got[0]["category"] == "general" and got[0]["requirements"] == [] and got[0]["posted_at"]


def crawled(spark, *rows):
    schema = (
        "platform string, category string, external_id string, title string, company string, location string, work_mode string, "
        "description string, requirements array<string>, candidate_criteria array<string>, url string, source_query string, posted_at timestamp"
    )
    return spark.createDataFrame(rows, schema)


def test_upsert_keeps_history(spark, tmp_path):
    import datetime as dt

    row = ("P", "general", None, "Aşçı", "L", None, "any", "metin", ["a", ""], [], "https://p/1", "q", dt.datetime(2024, 1, 1))
    first = ls.prepare_rows(crawled(spark, row), F.lit("2024-01-01").cast("timestamp"))
    changed = ("P", "general", None, "Aşçıbaşı", "L", None, "remote", "metin", [], [], "https://p/1", None, None)
    fresh = ("P", "general", None, "Garson", None, None, None, None, None, None, "https://p/2", None, None)
    table = ls.upsert_listings(first, ls.prepare_rows(crawled(spark, changed, fresh), now(), checked=False))
    got = {r["url"]: r for r in table.collect()}
    one = got["https://p/1"]
    assert one["title"] == "Aşçıbaşı" and one["source_query"] == "q" and one["posted_at"] == dt.datetime(2024, 1, 1) and one["work_mode"] == "remote"
    assert one["first_seen_at"].day == 1 and one["last_seen_at"].day == 2 and one["last_checked_at"].day == 1 and one["requirements"] == []
    assert got["https://p/2"]["first_seen_at"].day == 2
    again = ls.upsert_listings(table, ls.prepare_rows(crawled(spark, changed, fresh), now(), checked=False))
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
    ls.write_listings(table, str(tmp_path / "table"))
    assert ls.read_active(spark, str(tmp_path / "table")).count() == 2


def test_seed_and_sources(spark):
    old = spark.createDataFrame([("A", 9, 5)], "name string, priority int, scans int")
    seeds = spark.createDataFrame([("A", 1), ("B", 2)], "name string, priority int")
    got = {r["name"]: (r["priority"], r["scans"]) for r in ls.seed_registry(old, seeds, ["priority"]).collect()}
    assert got == {"A": (1, 5), "B": (2, None)}


def test_feeds(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"jobs": [
        {"id": 1, "title": "Data Engineer", "absolute_url": "https://g/1", "location": {"name": "Ankara"}, "content": "<p>Spark</p>", "updated_at": "2024-01-01T00:00:00Z"},
        {"id": 2, "title": "Cook", "absolute_url": "https://g/2"}, {"id": 3, "title": "Data"}]}))
    (tmp_path / "l.json").write_text(json.dumps([
        {"id": "x", "text": "Data Lead", "hostedUrl": "https://l/1", "categories": {"location": "Remote EU"}, "descriptionPlain": "", "createdAt": 1704067200000}]))
    (tmp_path / "r.json").write_text(json.dumps([{"legal": "notice"}] + [
        {"id": str(i), "position": "Dev", "company": "C", "tags": ["data"], "url": f"https://r/{i:02d}", "description": "d", "date": "2024-01-01"} for i in range(15)]))
    (tmp_path / "f.xml").write_text(
        "<rss>\n<channel>\n<item>\n<title>Acme: Data Analyst</title><link>https://f/1</link><description><![CDATA[<b>x</b>]]></description>"
        "<pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title>Data only</title><link>https://f/2</link></item></channel></rss>")
    (tmp_path / "broken.json").write_text("{not json")
    (tmp_path / "stray.json").write_text("[]")
    feeds = [
        ("Greenhouse: Acme", "g", "json-api", "greenhouse", None), ("Lever: Beta", "l", "json-api", "lever", "TR"), ("Remote", "r", "json-api", "remoteok-api", "US"),
        ("Feed", "f", "rss", None, None), ("Odd", "stray", "json-api", "unknown", None), ("Broken", "broken", "json-api", "lever", None), ("Gone", "nowhere", "rss", None, None),
    ]
    registry = spark.createDataFrame(feeds, "source string, feed string, access_method string, platform_type string, country string")
    rows = fd.read_feeds(spark, str(tmp_path), registry, ["data"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["platform"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"Greenhouse: Acme": 1, "Lever: Beta": 1, "Remote": 12, "Feed": 2}
    g, lever = by["Greenhouse: Acme"][0], by["Lever: Beta"][0]
    assert (g["company"], g["location"], g["description"], g["external_id"]) == ("Acme", "Ankara", "Spark", "1")
    assert lever["description"] == "Data Lead" and lever["posted_at"].year == 2024
    feed = {r["url"]: r for r in by["Feed"]}
    assert feed["https://f/1"]["company"] == "Acme" and feed["https://f/1"]["title"] == "Data Analyst" and feed["https://f/1"]["posted_at"].hour == 10
    assert feed["https://f/2"]["company"] is None and feed["https://f/2"]["location"] == "Remote"


BODY = "Aranan Nitelikler en az üç yıl mutfak deneyimi. Ekip çalışmasına yatkın olmak. " * 3


def page_rows(spark):
    ld = json.dumps({"@graph": [{"@type": "JobPosting", "title": "Aşçı", "description": f"<p>{BODY}</p>", "datePosted": "2024-01-01",
                                 "hiringOrganization": {"name": "Lezzet"}, "jobLocation": [{"address": {"addressLocality": "İzmir", "addressCountry": "TR"}}]}]})
    return spark.createDataFrame([
        ("https://x.co/ilan/asci-12345", f'<html><head><script type="application/ld+json">{ld}</script></head><body><h1>Menü</h1></body></html>'),
        ("https://x.co/ilan/garson-araniyor-77777", f'<html><head><title>Site | Garson</title></head><body><h1>Garson Aranıyor</h1><div class="company-box"><a href="/f">Deniz</a></div>'
         f'<span class="job-location">Bursa</span><div class="job-description">{BODY}</div><time datetime="2024-02-03">dün</time></body></html>'),
        ("https://x.co/ilan/muhasebe-uzmani-88888", f'<html><head><meta property="og:title" content="Site | Muhasebe Uzmanı"></head><body><h1>Kurye Aranıyor</h1><main>{BODY}</main></body></html>'),
        ("https://x.co/ilan/bos-99999", "<html><body><h1>Boş</h1></body></html>"),
    ], "url string, html string").withColumn("platform", F.lit("X")).withColumn("category", F.lit("general")).withColumn("source_query", F.lit("q"))


def test_pages_to_listings(spark):
    got = {r["title"]: r for r in pg.pages_to_listings(page_rows(spark)).collect()}
    assert set(got) == {"Aşçı", "Garson Aranıyor", "Muhasebe Uzmanı"}
    cook, waiter = got["Aşçı"], got["Garson Aranıyor"]
    assert (cook["company"], cook["location"], cook["external_id"]) == ("Lezzet", "İzmir, TR", "12345") and cook["posted_at"].year == 2024
    assert (waiter["company"], waiter["location"]) == ("Deniz", "Bursa") and waiter["posted_at"].month == 2
    assert waiter["requirements"][0].startswith("Aranan Nitelikler")


def test_links(spark):
    html = '<a href="/ilan/asci-garson-kurye#x">a</a><a href="/hakkimizda">b</a> "url":"https:\\/\\/x.co\\/ilan\\/sef-araniyor-55555",'
    pages = spark.createDataFrame([("https://x.co/ara?q=1", html)], "url string, html string")
    got = sorted(r["link"] for r in pg.page_links(pages).collect())
    assert got == ["https://x.co/ilan/asci-garson-kurye", "https://x.co/ilan/sef-araniyor-55555"]


def test_feeds_keep_order_texts_and_odd_values(spark, tmp_path):
    (tmp_path / "Übung & Co.json").write_text(json.dumps([{"position": f"Role {k}", "url": f"https://r/{99 - k}", "description": "x" * 5000, "id": k, "tags": "no list"} for k in range(20)], indent=1))
    (tmp_path / "lever.json").write_text(json.dumps([
        {"text": "A", "hostedUrl": "https://l/a", "createdAt": "1704067200000", "description": "second", "descriptionPlain": None}, {"text": None, "hostedUrl": "https://l/b"}, 7,
        {"text": "C", "hostedUrl": "https://l/c", "categories": None, "createdAt": 1704067200000.0}]))
    (tmp_path / "empty.xml").write_text("")
    feeds = [("R", "Übung & Co", "json-api", "remoteok-api", "US"), ("LEVER:  Beta ", "lever", "json-api", "lever", None), ("E", "empty", "rss", None, None)]
    registry = spark.createDataFrame(feeds, "source string, feed string, access_method string, platform_type string, country string")
    rows = fd.read_feeds(spark, str(tmp_path), registry, []).collect()
    foreign = [r for r in rows if r.platform == "R"]
    assert sorted(int(r.external_id) for r in foreign) == list(range(12)) and {len(r.description) for r in foreign} == {5000}
    lever = {r.url: r for r in rows if r.platform != "R"}
    assert set(lever) == {"https://l/a", "https://l/c"} and lever["https://l/a"].company == "Beta" and lever["https://l/a"].description == "second"
    assert lever["https://l/a"].posted_at is None and lever["https://l/c"].posted_at.year == 2024 and lever["https://l/c"].description == "C"
    assert len([r for r in fd.read_feeds(spark, str(tmp_path), registry, [], None).collect() if r.platform == "R"]) == 20


def test_ten_thousand_feeds_are_one_scan(spark, tmp_path):
    for k in range(10_000):
        (tmp_path / f"board{k}.json").write_text(f'{{"jobs": [{{"id": {k}, "title": "Job {k}", "absolute_url": "https://g/{k}"}}]}}')
    registry = spark.range(10_000).select(
        F.concat(F.lit("Greenhouse: "), "id").alias("source"), F.concat(F.lit("board"), "id").alias("feed"), F.lit("json-api").alias("access_method"),
        F.lit("greenhouse").alias("platform_type"), F.lit(None).cast("string").alias("country"))
    found = fd.read_feeds(spark, str(tmp_path), registry, [], None)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert found.select("external_id", "company").distinct().filter("external_id = company").count() == 10_000
