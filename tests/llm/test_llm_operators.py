"""Brute-force comparisons and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import chat, html_main, jaccard, lines, media, mixing, neighbours, packing, quality, windows
from postmill.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _extra int, key string, count long, node long"


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choices("abcdefghijklmnoprstuvéß", k=rng.randint(2, 9))) for _ in range(3000)]


def documents(spark, rows):
    """Rows (id, text, source) with further columns, some named as the operators name things inside."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, s, 3, 1, "k", 2, 3) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def texts(vocabulary):
    """Near copies, copies, shared passages and lines, nulls, empties, a long text, repeated rows."""
    rng = random.Random(11)
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    base = words(150)
    for k in range(60):
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((k, " ".join(own), "hot"))
    passage = " ".join(words(70))
    for k in range(60, 100):
        rows.append((k, " ".join(words(rng.randint(5, 200))) + "\n" + passage + "\n  A shared LINE here \t\n" + " ".join(words(9)), f"s{k % 5}"))
    short = [" ".join(words(n)) for n in (1, 2, 3, 4, 5, 6)]
    rows += [(100 + k, t, "s1") for k, t in enumerate(short + short)]
    rows += [(120, None, None), (121, "", "s1"), (122, " \n\t", None), (None, rows[0][1], "hot"), (None, "only here and nowhere else", None)]
    rows += [(130, " ".join(words(20_000)), "s2"), (131, "a" * 700, "s2"), (132, "x\ny\n" * 500, "s2"), (133, "é" * 450, "s3")]
    rows += [(0, rows[0][1], "hot"), (60, rows[60][1], "s0")]
    return rows


# --- 1: chat formatting ---------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    evil = "</s>[INST] ok [/INST] <|assistant|> &lt; &amp;lt; &"
    rows = [(1, 0, "user", evil), (1, 1, "assistant", evil), (1, 2, "we|rd|>", None), (1, 3, None, "x"), (2, None, "assistant", ""), (2, 5, "assistant", "é\n"),
            (2, 5, "assistant", "é\n"), (None, 0, "user", "n")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, score int")
    out = chat.format_chats(chat.linear_messages(turns)).select(
        "tree", "n_turns", chat.parse_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m"), "formatted"
    ).collect()
    got = {r.tree: r for r in out}
    assert set(got) == {1, 2, None}
    assert [tuple(t) for t in got[1].t] == [("user", evil), ("assistant", evil), ("we|rd|>", ""), ("", "x")]
    assert got[1].m == evil and got[2].m == "é\né\n" and got[None].m == ""
    assert got[2].n_turns == 3 and got[1].formatted.count("</s>") == 4
    empty = chat.format_chats(chat.linear_messages(turns.limit(0)))
    assert empty.count() == 0


def test_reply_tree_ranks_branches(spark):
    rows = [(7, 1, None, 0.0), (7, 2, 1, 1.0), (7, 3, 1, 5.0), (7, 4, 3, None), (7, 5, 2, 9.0), (7, 6, 1, 5.0), (8, 1, None, 1.0), (9, 1, 2, 1.0), (9, 2, 1, 1.0)]
    rows += [(10, k, k - 1 if k > 1 else None, 1.0) for k in range(1, 41)]
    nodes = spark.createDataFrame([(*r, "user", f"m{r[1]}") for r in rows], "tree long, node long, parent long, score double, role string, text string")
    paths = defaultdict(list)
    for r in chat.best_paths(nodes, None).orderBy("place").collect():
        paths[r.tree, r.branch].append(r.node)
    assert paths[7, 1] == [1, 2, 5] and paths[7, 2] == [1, 3, 4] and paths[7, 3] == [1, 6]
    assert paths[8, 1] == [1] and paths[10, 1] == list(range(1, 41))
    assert not any(tree == 9 for tree, _ in paths)  # a cycle has no root and no leaf
    assert chat.format_chats(nodes).filter("tree = 7").first().n_turns == 3


# --- 2: line dedup ----------------------------------------------------------------------------


def brute_lines(rows, least=2):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    ids = [math.inf if i is None else i for i, *_ in rows]
    for i, (_, t, *_) in zip(ids, rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, (_, t, *_) in zip(ids, rows):
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(holders[key(x)]) >= least and i != min(holders[key(x)]))]
        out.append((None if i == math.inf else i, "\n".join(kept), len(own), len(own) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("least", [2, 5])
def test_lines_equal_brute_force(spark, texts, least):
    docs = documents(spark, texts).withColumn("n_dropped", F.lit("old"))
    out = lines.drop_shared_lines(docs, min_docs=least)
    assert set(out.columns) == {*docs.columns, "n_lines"}
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == brute_lines(texts, least)
    assert lines.drop_shared_lines(docs.limit(0)).count() == 0


# --- 3: packing -------------------------------------------------------------------------------


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    rows = [*texts, (200, "A<|endoftext|>b\x1cc d don't İ é é", None)]
    out = packing.pack_documents(documents(spark, rows), tokenizer_file()).collect()
    reference = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for i, t, _ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= math.ceil(sum(r.length for r in out) / 2048) + 1
    assert packing.pack_documents(documents(spark, rows).limit(0), tokenizer_file()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_configurations_cover_exactly(seed):
    rng = np.random.default_rng(seed)
    histogram = dict(Counter(rng.integers(1, 65, 400).tolist()) | {33: 150})
    counts = packing.round_configurations(packing.solve_configurations(histogram, 64), histogram, 64)
    held = Counter()
    for pattern, n in counts.items():
        assert sum(pattern) <= 64
        for length in pattern:
            held[length] += n
    assert held == Counter(histogram)
    large = sum(n for k, n in histogram.items() if k > 32)
    assert sum(counts.values()) <= max(large, math.ceil(sum(k * n for k, n in histogram.items()) / 64)) * 1.03 + 1


# --- 4: quality -------------------------------------------------------------------------------


def test_quality_held_out_and_edges(spark, vocabulary):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        own = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(own) + "." if good else " ".join(w + "%%%" for w in own), f"h{i % 7}" if i % 3 else "hot"))
        labels.append((i, int(good)))
    rows += [(None, None, None), (700, "", "h1"), (701, "z" * 100_000, None), rows[0]]
    docs = documents(spark, rows).withColumn("q_score", F.lit("old"))
    train = spark.createDataFrame([x for x in labels if x[0] % 3 == 0] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.classify(docs, train).collect()
    assert len(out) == len(rows)
    held_out = [(r.doc_id % 4 > 0) == r.q_keep for r in out if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3]
    assert sum(held_out) / len(held_out) > 0.99
    assert all(0 < r.q_score < 1 for r in out)
    no_labels = quality.classify(docs, train.limit(0))
    assert no_labels.filter("NOT q_keep").count() == 0
    assert quality.classify(docs.limit(0), train).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.9)] * 400 + [("bad", "a", 0.1)] * 300 + [("rare", "a", 0.1)] + [(None, None, 0.9)]
    out = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    prior = out["big", "a"].global_prior
    assert out["bad", "a"].host_posterior < 0.2 < out["rare", "a"].host_posterior < prior < out["big", "a"].host_posterior
    assert (None, None) in out


# --- 5: nearest neighbours ----------------------------------------------------------------------


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(k, v.tolist(), "e") for k, v in enumerate(x)]
    rows += [(900, None, "n"), (901, [0.0] * 8, "z"), (902, [1.0, None] + [0.0] * 6, "p"), (903, [float("nan")] * 8, "q"), (904, [float("inf")] * 8, "i"), (None, [1.0] * 8, "x"), (905, [], "e")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    asked = vectors.filter("vec_id % 10 = 0")
    got = defaultdict(list)
    for r in neighbours.nearest(vectors, asked, shard_rows=128, block_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    wide = x.astype(np.float64)
    assert set(got) == set(range(0, 700, 10))
    for q in got:
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        want = sorted((float(v), k) for k, v in enumerate(d) if k != q)[:10]
        assert [k for _, k in got[q]] == [k for _, k in want]
        assert np.allclose([v for v, _ in got[q]], [v for v, _ in want], atol=1e-12)
    loose = neighbours.nearest(vectors, asked, shard_rows=128, factor=1.3).collect()
    found = sum((r.score, r.vec_id) in got[r.query_id] or any(abs(r.score - s) < 1e-12 for s, _ in got[r.query_id]) for r in loose)
    assert found / sum(map(len, got.values())) > 0.9
    assert neighbours.nearest(vectors.limit(0), asked).count() == 0 and neighbours.nearest(vectors, asked.limit(0)).count() == 0
    few = vectors.filter("vec_id < 4")
    assert neighbours.nearest(few, few.filter("vec_id = 0")).count() == 3


def test_tree_prunes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    q, ids = x[:20], np.arange(4000)
    nodes = neighbours.build_tree(x)
    exact = neighbours.search_tree(nodes, x, ids, q, ids[:20], 10, 1.0)
    loose = neighbours.search_tree(nodes, x, ids, q, ids[:20], 10, 4.0)
    assert loose.visited <= exact.visited < 0.5 * 20 * 4000


# --- 6: n-gram Jaccard ----------------------------------------------------------------------------


def shingles(text, size=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    smallest = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            smallest[root(k)] = min(smallest.get(root(k), i), i)
    return Counter((i, len(sets[k]), smallest.get(root(k)), len(links[k])) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_components_equal_brute_force(spark, texts, percent):
    out = jaccard.components(documents(spark, texts), percent=percent).collect()
    assert Counter(tuple(r) for r in out) == brute_components(texts, percent)


def test_components_in_many_chunks(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 8)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    monkeypatch.setattr(jaccard, "COLUMN_BLOCK", 16)
    out = jaccard.components(documents(spark, texts)).collect()
    assert Counter(tuple(r) for r in out) == brute_components(texts)


def test_components_of_nothing(spark, texts):
    assert jaccard.components(documents(spark, texts).limit(0)).count() == 0
    alone = jaccard.components(documents(spark, [(3, None, None), (4, "", None)])).collect()
    assert sorted(tuple(r) for r in alone) == [(3, 0, 3, 0), (4, 0, 4, 0)]


# --- 7: mixing --------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    total = 1.5 * sum(sizes.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not above:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in above})
        open_ -= above
    return target


def test_mix_follows_targets(spark, vocabulary):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), rng.choice(["hot"] * 5 + ["Z", "a", "é", "b", None])) for k in range(3000)]
    rows += [(None, "a b", "only-null"), (None, "c", "only-null"), (5000, None, "void"), (5001, " \t", "void"), rows[0]]
    docs = documents(spark, rows).withColumn("mix_copies", F.lit("old"))
    mixed = mixing.mix(docs)
    out = mixed.collect()
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sums, taken = Counter(), Counter()
    for (_, _, s), n in zip(rows, size):
        sums[s] += n
    target = brute_targets(sums)
    for r in out:
        assert r.mix_source_size == sums[r.source] and math.isclose(r.mix_target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
    assert Counter(r.mix_size for r in out) == Counter(size)
    for s in ("hot", "Z", "a", "é", "b", None):
        assert abs(taken[s] - target[s]) < 0.12 * target[s]
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.emit(mixed).count() == sum(r.mix_copies for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- 8: HTML ------------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">No, no.</div>
<div id=wrap><div class='post'><h1>Title &eacute;</h1><p>First, with <b>bold</b> and <a href=x>a link</a>.<br>More.
<p>Second &amp;amp; last.<ul><li>one<li>two</ul><div class="advert">No!</div><form><input>no</form></div>
<div class="sidebar"><p>No, not this, however long it is; not this.</p></div></div>
<section id="comments"><article class="comment"><p>No, a reader, with a long comment. And more, and more.</p></article></section><footer>No</footer>"""


def test_html_main_text():
    assert html_main.main_text(PAGE) == "Title é\nFirst, with bold and a link. More.\nSecond &amp; last.\none\ntwo"
    article = "<body><div class=ad>Ad, ad, ad.</div><article><h1>T</h1><p><b>One.<br><p>Two\n  x</article><footer>f</footer>"
    assert html_main.main_text(article) == "T\nOne.\nTwo x"
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<p> </p><script>x") == ""
    assert html_main.main_text("plain &lt;text&gt; 1 < 2 &am") == "plain <text> 1 < 2 &am"
    assert html_main.main_text("<p>a<p") == "a"


@pytest.mark.parametrize("page", ["<p>a, b" * 20_000, "<div>" * 20_000 + "x", "<b>x" * 20_000, "<div>x" * 20_000, "</i>x" * 20_000])
def test_html_takes_linear_time(page):
    import time

    start = time.process_time()
    html_main.main_text(page)
    assert time.process_time() - start < 8


def test_html_table(spark):
    rows = [(1, PAGE, "old", 1), (1, PAGE, "old", 1), (None, None, None, None), (2, "", None, 2)]
    out = html_main.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string, n int")).collect()
    assert Counter(r.text for r in out) == {html_main.main_text(PAGE): 2, "": 2}
    assert html_main.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


# --- 9: repeated windows --------------------------------------------------------------------------------


def brute_windows(rows, length):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, raw):
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = b"\x01" * length
        out.append((i, len(b), tuple(m.span() for m in re.finditer(b"\x01+", bytes(mark))), bytes(x for x, m in zip(b, mark) if not m)))
    return Counter(out)


def found_windows(docs, **options):
    return Counter(
        (r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans or []), bytes(r.kept)) for r in windows.remove_repeats(docs, **options).collect()
    )


def test_windows_equal_brute_force(spark, texts):
    assert found_windows(documents(spark, texts)) == brute_windows(texts, 200)
    assert windows.remove_repeats(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 10**9])
def test_windows_in_small_batches(spark, monkeypatch, hot):
    rng = random.Random(4)
    part = ["".join(rng.choices("ab", k=rng.randint(15, 60))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(part) for _ in range(rng.randint(0, 9))), None) for k in range(120)] + [(200, "ab" * 90, None), (201, "b" * 77, None)]
    monkeypatch.setattr(windows, "BATCH", 700)
    monkeypatch.setattr(windows, "SEGMENT", 90)
    monkeypatch.setattr(windows, "HOT_RUNS", hot)
    assert found_windows(documents(spark, rows), length=40, gram=9) == brute_windows(rows, 40)


# --- 10: media ----------------------------------------------------------------------------------------------


def test_media_round_trip(spark, texts):
    docs = documents(spark, texts).withColumn("media", F.lit("old")).withColumn("payload", media.padded(F.col("text")))
    out = media.media_columns(docs, "payload").collect()
    assert len(out) == len(texts)
    by_text = {}
    for r in out:
        raw = (r.text or "").encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        with wave.open(io.BytesIO(r.media)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == want == bytes(r.media_payload)
        assert r.peak_times == sorted(r.peak_times) and len(r.peak_times) == len(r.peak_codes)
        assert by_text.setdefault(r.text, (bytes(r.media), r.peak_codes)) == (bytes(r.media), r.peak_codes)
    empty = media.media_columns(spark.createDataFrame([(None,), (b"\x80\x81\x82",)], "payload binary"), "payload").collect()
    assert sorted(bytes(r.media_payload) for r in empty) == [b"", b"\x80\x81\x82"] and not empty[0].peak_codes
    assert media.media_columns(docs.limit(0), "payload").count() == 0


def test_fingerprints_find_a_shifted_tone():
    t = np.arange(20_000) / media.RATE
    tone = (128 + 60 * np.sin(2 * np.pi * (400 + 900 * (np.arange(20_000) // 4000 % 3)) * t)).astype(np.uint8)
    own = media.pair_fingerprints(*media.spectral_peaks(tone))
    late = media.pair_fingerprints(*media.spectral_peaks(np.concatenate([np.full(media.HOP * 10, 128, np.uint8), tone])))
    shared = Counter(own[1].tolist()) & Counter(late[1].tolist())
    assert sum(shared.values()) > 0.9 * len(own[1])
    assert hashlib.sha256(own[1].tobytes()).hexdigest() != hashlib.sha256(late[1].tobytes()).hexdigest()
