"""What the n-gram join sends grows with the pairs that may link, not with what fragments chain together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import jaccard


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3_000)]
    bases = [rng.sample(words, 60) for _ in range(3)]
    texts = []
    for k in range(60):
        text = list(bases[k % 3])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(" ".join(text))
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[3]), (61, None), (62, " ".join(rng.sample(words, 50)))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def sets_and_links(docs, percent=85):
    """Distinct sets by text, and the linked pairs of them, by brute force."""
    texts = {r.text for r in docs.collect() if r.text}
    grams = {t: {tuple(t.split()[k: k + 4]) for k in range(len(t.split()) - 3)} for t in texts}
    return grams, {(a, b) for a in texts for b in texts if a != b and 100 * len(grams[a] & grams[b]) >= percent * len(grams[a] | grams[b])}


def test_links_in_small_cells_and_tiles(spark, docs, monkeypatch):
    for name, most in (("CHUNK_SETS", 12), ("COLUMN_BLOCK", 4), ("KNOWN_SETS", 10)):
        monkeypatch.setattr(jaccard, name, most)
    _, linked = sets_and_links(docs)
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    degree = {t: sum(a == t for a, _ in linked) for t in text.values()}
    got = {r.doc_id: r.n_links for r in jaccard.components(docs).collect() if r.doc_id is not None}
    assert got == {k: degree.get(t, 0) for k, t in text.items()} and max(got.values()) > 5


def test_a_chain_is_no_block(spark):
    """Sets that share a fragment with the next one only are not compared all with all."""
    rows = [(k, node) for k in range(299) for node in (k, k + 1)]
    blocks = jaccard.hub_blocks(spark.createDataFrame(rows, "key long, node long"))
    assert max(r["count"] for r in blocks.groupBy("block").count().collect()) == 2 and blocks.count() == 2 * 299


def test_sets_that_meet_in_several_blocks_link_once(spark):
    hashes = [np.arange(k, 100 + k, dtype=np.uint64).tobytes() for k in range(4)]
    sets = spark.createDataFrame(list(enumerate(hashes)), "node long, hashes binary")
    blocks = spark.createDataFrame([(n, b) for b, nodes in ((0, (0, 1, 2)), (1, (1, 2, 3)), (7, (0, 1, 2, 3))) for n in nodes], "node long, block long")
    links = jaccard.block_links(sets, blocks, 90).groupBy("node").agg(F.sum("links").alias("n"))
    assert {r.node: r.n for r in links.collect()} == {k: 3 for k in range(4)}


def test_copies_count_for_the_size_of_a_fragment(spark, monkeypatch):
    """Copies send their n-grams as well; a fragment that is sized by distinct texts outgrows its task."""
    text, asked = " ".join(f"w{k}" for k in range(300)), []
    copies = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    own = jaccard.lone_counts
    monkeypatch.setattr(jaccard, "FRAGMENT_POSTINGS", 100)
    monkeypatch.setattr(jaccard, "lone_counts", lambda docs, col, fragments, size: asked.append(fragments) or own(docs, col, fragments, size))
    assert {r.component_id for r in jaccard.components(copies).collect()} == {0}
    assert asked[0] >= 50 * 297 * jaccard.LONE_EIGHTHS // (8 * 100)
