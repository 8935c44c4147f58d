"""Alignment, filter audit and token files against brute force, with nulls, empties, long texts, repeats, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import alignment, filter_audit, token_files, tokens
from postmill.llm.common import scratch
from postmill.llm.queries import tokenizer_file, vocabulary_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, n int, ids string, block long, part string, h1 long, fails string, start string"
POOL = ["a", "b", "word", "Ünïcode", "一二", "😀", "👩‍👩‍👧", "\U00020000", " ", "  ", "\n", "\t", " ", "　", "é", "é", "'s", "123", "#$", "<|endoftext|>", "</s>",
        "<s>", "▁", "<0x41>", "\r\n", "\x85", "\x1c", "ﬁ", "﻿", "\x00", "क्षि", "‍", ".", "THE", "I'm", "µ", "ß", "Ā", "İ", "_"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 2, "y", 3, "z", "w") for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(k, "".join(rng.choices(POOL, k=rng.randint(1, 25))), rng.choice(["en", "de", "", None])) for k in range(400)]
    out += [(500 + k, " ".join(rng.choices(["Lorem", "ipsum,", "dolor", "sit", "amet.", "naïve"], k=rng.randint(90, 130))), "la") for k in range(60)]
    out += [(600 + k, out[400][1], "en" if k % 2 else None) for k in range(50)]
    out += [(700, None, "en"), (701, "", "en"), (702, " ", None), (703, "word " * 30_000, "en"), (704, "é" * 9_000, "fr"), (705, "trailing  ", "fr")]
    out += [(None, out[400][1], "en"), (None, "alone", None), (500, out[400][1], "la"), (500, out[400][1], "la"), (620, "another text", "en"), (-5, "tie", "x"), (-5, "tie", "x")]
    rng.shuffle(out)
    return out


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary_file(A)), SentencePieceProcessor(model_file=vocabulary_file(B))
    a.encode_special_tokens = True
    a_bytes, b_bytes = alignment.entry_bytes(vocabulary_file(A)), alignment.piece_bytes(vocabulary_file(B))
    found, counts = [], Counter()
    for _, text, _ in rows:
        whole = (" " + (text or "")).encode()
        ids = (a.encode(whole.decode(), add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if any(b"".join(e[i] for i in x) != whole for x, e in zip(ids, (a_bytes, b_bytes))):
            ids = [], []
        ends = []
        for x, e in zip(ids, (a_bytes, b_bytes)):
            ends.append(np.cumsum([len(e[i]) for i in x]).tolist())
        links = [(i, j) for end in sorted(set(ends[0]) & set(ends[1])) for i, x in zip(ids[0], ends[0]) if x == end for j, y in zip(ids[1], ends[1]) if y == end]
        groups, last = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for i, x in zip(own, e) if last < x <= end) for own, e in zip(ids, ends)))
            last = end
        counts.update(links)
        found.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (row[0], x, y, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)
        for row, (x, y, g, links, sha) in zip(rows, found)
    ]


def test_alignment_equals_brute_force(spark, rows):
    short = [r for r in rows if r[0] != 703] + [(703, "word " * 300, "en")]
    got = alignment.align(frame(spark, short).repartition(3), vocabulary_file(A), vocabulary_file(B)).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_alignment(short), key=key)
    assert sum(r.n_a == 0 for r in got) > 20 and sum(r.n_groups < r.n_a for r in got) > 100


def test_alignment_cache_turns_over(monkeypatch, rows):
    monkeypatch.setattr(alignment, "CACHED_UNITS", 40)
    units = alignment.Units(vocabulary_file(A), vocabulary_file(B))
    words = ["one", "two", "▁", "😀😀", "x ", "x", "﻿", "tail\n"]
    units.fill(words)
    first = {w: units[w] for w in words}
    for k in range(5):
        units.fill([f"filler{k}-{n}" for n in range(30)])
    units.fill(words)
    assert {w: units[w] for w in words} == first and first["▁"] is None and len(units.older) <= 60


def test_alignment_of_an_empty_table(spark):
    out = alignment.align(frame(spark, []), vocabulary_file(A), vocabulary_file(B))
    assert out.count() == 0 and out.columns == alignment.RESULT


def test_linkable_pairs_hold_every_suffix_pair():
    a, b = [b"a", b"ba", b"c", b"ba"], [b"a", b"cba", b"x", b"ba"]
    brute = sorted(i * 4 + j for i, x in enumerate(a) for j, y in enumerate(b) if x.endswith(y) or y.endswith(x))
    assert alignment.linkable_pairs(a, b).tolist() == brute


def brute_fails(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    out = []
    for i, t, part in rows:
        t = t or ""
        w = word.findall(t)
        out.append((i, part or "", "".join(k for k, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t),
            i is not None and firsts[t] < i,
        )) if bad)))
    return out


def brute_orders(failed, good, toxic):
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(i, f) for i, p, f in failed if p == part]
        first = Counter()
        for order in map("".join, permutations("ABCDE")):
            for _, f in own:
                first[next((x for x in order if x in f), "")] += 1
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                out[part, order, step] = (
                    len(left) - len(gone), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), first[x],
                )
                left = [r for r in left if x not in r[1]]
    return out


def test_filter_audit_equals_brute_force(spark, rows):
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 720, 2)] + [(601, 0, 1), (601, 1, 0), (None, 1, 1)]
    side = spark.createDataFrame([(i, q, int(t), "en", "z") for i, q, t in labels], "doc_id long, quality int, toxic int, part string, fails string")
    failed = filter_audit.failed_filters(frame(spark, rows).repartition(5))
    assert Counter(map(tuple, failed.collect())) == Counter(brute_fails(rows))
    got = filter_audit.audit_orders(filter_audit.mask_counts(failed, side)).collect()
    want = brute_orders(brute_fails(rows), {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None})
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == want
    assert len(got) == 600 * len({r[1] for r in brute_fails(rows)})


def test_filter_audit_of_empty_tables(spark):
    failed = filter_audit.failed_filters(frame(spark, []))
    assert filter_audit.audit_orders(filter_audit.mask_counts(failed, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_sketch_clears_only_unique_hashes_in_many_blocks(spark):
    hashes = spark.range(40_000).select(F.xxhash64((F.col("id") % 39_000).cast("string")).alias("h1"), F.xxhash64(F.lit(1), (F.col("id") % 39_000).cast("string")).alias("h2"), "id")
    blocks = 40_000 * filter_audit.COUNTERS_A_TEXT // filter_audit.BLOCK + 1
    sketch = filter_audit.repeated_counters(hashes, blocks)
    flagged = filter_audit._may_repeat(hashes, sketch, blocks, "again").filter("again").select((F.col("id") % 39_000).alias("k")).collect()
    counted = Counter(r.k for r in flagged)
    assert all(counted[k] == 2 for k in range(1000)) and sum(n == 1 for n in counted.values()) < 1200


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    monkeypatch.setattr(filter_audit, "LONG_TEXT", 50)
    rng = random.Random(1)
    for _ in range(50):
        data = "".join(rng.choices(["ab", "c", " ", "\n", "é", "x" * 60], k=200)).encode()
        assert filter_audit._words(data) == (len(data.split()), len(set(data.split())))


def test_variable_length_code_round_trip():
    edges = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 3, dtype=np.uint32)
    for n in range(len(edges) + 1):
        control, data = token_files.encode_ranks(edges[:n])
        assert len(control) == (n + 3) // 4 and len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in edges[:n])
        assert (token_files.decode_ranks(control, data, n) == edges[:n]).all()


def test_token_files_read_back(spark, rows, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 700)
    from tokenizers import Tokenizer

    tokenizer, folder = Tokenizer.from_file(tokenizer_file()), scratch(spark, "token-files")
    token_files.write_token_files(frame(spark, rows).repartition(4), folder, tokenizer_file())
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for _, t, _ in rows}
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids[t])) for i, t, _ in rows)
    at, last = 0, (False, 0)
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at, place = at + r.n_tokens, (r.doc_id is not None, r.doc_id or 0)
        assert place >= last
        last = place
    ranks = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()
    assert all((a.n, -a.id) >= (b.n, -b.id) for a, b in zip(ranks, ranks[1:])) and sum(r.n for r in ranks) == at
    again = scratch(spark, "token-files")
    token_files.write_token_files(frame(spark, rows).repartition(9), again, tokenizer_file())
    assert sorted(token_files.read_token_files(spark, again).collect(), key=lambda r: r.start) == got


def test_token_files_of_an_empty_table(spark):
    folder = scratch(spark, "token-files")
    token_files.write_token_files(frame(spark, []), folder, tokenizer_file())
    assert token_files.read_token_files(spark, folder).count() == 0


def test_words_have_the_tokenizers_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [None, "", *("".join(rng.choices(POOL + ["Hello,", "WORLD!!", "don't", "ﬀ", "Ł.", "é?"], k=rng.randint(1, 12))) for _ in range(4000))]
    words, tokenizer = tokens.word_ids(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    ids, bounds = tokens.encoded(words, pa.array(texts, pa.string()), 9)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 9], text
