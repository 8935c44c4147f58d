import json

import pyarrow as pa
import pytest

from postmill.llm import tokens as tk
from postmill.plans.extraction_queries import structured_cvs
from postmill.plans.tables import Tables
from postmill.sources import feeds as fd
from postmill.sources import pages as pg


def test_a_page_is_cleaned_once(spark):
    """The filter on usable pages reads what was made of a page; it doesn't make it again."""
    html = "<html><head><title>Data Engineer</title></head><body><h1>Data Engineer</h1><p>" + "Build pipelines. " * 30 + "</p></body></html>"
    pages = spark.createDataFrame([("https://x.example/jobs/data-engineer", html)] * 2 + [(None, None)], "url string, html string")
    found = pg.pages_to_listings(pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<body\\b") == 1
    assert len({r.description for r in found.collect()}) <= 1


def test_cv_turns_are_dealt_into_short_tasks(spark, tmp_path):
    """Many tasks a core; a conversation of very many turns isn't one of them."""
    rows = spark.range(2000).selectExpr("7L AS conv_id", "CAST(id AS int) AS turn", "'user' AS role", "'Ada Lovelace' AS text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    cvs = structured_cvs(Tables(spark, str(tmp_path)))
    sizes = cvs.rdd.glom().map(len).collect()
    assert len(sizes) >= 8 * spark.sparkContext.defaultParallelism and max(sizes) < 100 and sum(sizes) == 2000


def test_lines_and_signs_make_no_new_words():
    """A word before a sign, with a capital or at the end of a line is tokenised once."""
    tokenizers = pytest.importorskip("tokenizers")
    from postmill.llm.queries import tokenizer_file

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file())
    words, asked = tk.WordIds(tokenizer), []
    own = words._letters
    words._letters = lambda word: asked.append(word) or own(word)
    texts = ["Pipeline\npipeline, PIPELINE.", "été\nÉté!\n\n", None, "", "pipeline\n"]
    ids, bounds = tk.encoded(words, pa.array(texts, pa.string()), 9)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [9] for t in texts]
    assert sorted(asked) == ["pipeline", "été"] and all("\n" not in word for word in words)


def test_a_feed_item_is_cleaned_once(spark, tmp_path):
    """Filters on titles, addresses and tokens read what was made of an item; home and foreign feeds are one branch each."""
    jobs = [{"id": k, "title": f"Data engineer {k}" if k % 3 else None, "absolute_url": f"https://x.example/{k}", "content": "<p>data</p>"} for k in range(20)]
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps({"jobs": jobs}))
    registry = spark.createDataFrame([("A", "a", "TR"), ("B", "b", "US")], "source string, feed string, country string")
    registry = registry.selectExpr("*", "'json-api' AS access_method", "'greenhouse' AS platform_type")
    found = fd.read_feeds(spark, str(tmp_path), registry, ["data"])
    # the fields of a home and of a foreign feed, each made once (38 before)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("<script") <= 14
    wanted = [str(k) for k in range(20) if k % 3]
    rows = found.collect()
    assert sorted(r.external_id for r in rows if r.platform == "A") == sorted(wanted)
    assert sorted(r.external_id for r in rows if r.platform == "B") == sorted(wanted[:12])
