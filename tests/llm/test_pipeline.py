"""The pipeline's near_duplicates stage against a brute-force version."""

import random
from collections import Counter

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_groups(rows, percent=80):
    """Groups of rows linked by 5-word Jaccard; rows without words are groups of their own."""
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [[r for r, g in zip(rows, group) if g == k] for k in set(group)]


def smallest_rows(group):
    """The rows one of which has to stay; ids of one row may be repeated or all be null."""
    ids = [r[0] for r in group if r[0] is not None]
    return {r for r in group if r[0] == min(ids, default=None)}


def changed(words, places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def near_rows():
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    row = lambda i, text: (i, text, "en", "s", 1)
    line, loose, unnamed, whole = some(200), some(28), some(60), " ".join(some(40))
    rows = [row(10, " ".join(line)), row(11, changed(line, {150})), row(12, changed(line, {20, 90, 150, 180}))]
    rows += [row(13, changed(line, {20, 60, 90, 120, 150, 180}))]  # linked with no row but the last
    rows += [row(20, " ".join(loose)), row(21, changed(loose, {9, 10})), row(22, changed(loose, {26}))]
    rows += [row(None, " ".join(unnamed)), row(None, changed(unnamed, {59})), row(None, " ".join(unnamed))]
    rows += [row(None, " ".join(line)), row(30, whole), row(30, whole), row(30, whole.upper()), row(30, " ".join(some(40)))]
    rows += [row(None, "only here"), row(40, None), row(None, ""), row(None, ""), row(41, " \n"), row(41, " \n"), row(42, "one"), row(43, "one")]
    for k in range(100, 160):  # single words changed
        rows.append(row(k, changed([f"base{k // 3}x{j}" for j in range(90)], set(rng.sample(range(10, 80), k % 3)))))
    for k in range(200, 260):  # passages changed, around the threshold
        at = rng.randrange(5, 60)
        rows.append(row(k, changed([f"part{k // 4}x{j}" for j in range(100)], set(range(at, at + k % 4 * 3)))))
    rng.shuffle(rows)
    return rows


def test_one_per_group_equals_brute_force(spark):
    rows = near_rows()
    out = corpus_pipeline.one_per_group(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter(tuple(r) for r in out.collect())
    groups = brute_groups(rows)
    assert got.total() == len(groups)
    for group in groups:
        if shingles(group[0][1]):  # a text with words is in one group only
            assert sum(got[r] for r in set(group)) == sum(got[r] for r in smallest_rows(group)) == 1
        else:
            assert got[group[0]] == rows.count(group[0])


def test_one_per_group_drops_looser_copies(spark):
    words = [f"w{k}" for k in range(100)]
    near = changed(words, set(range(50, 56)))  # 4-word Jaccard 83 %, 5-word Jaccard 81 %
    out = corpus_pipeline.one_per_group(spark, spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, near, "en", "s", 1)], DOCS), "")
    assert [r.doc_id for r in out.collect()] == [1]


def test_one_per_group_of_nothing(spark):
    docs = spark.createDataFrame(near_rows(), DOCS)
    assert corpus_pipeline.one_per_group(spark, docs.limit(0), "").count() == 0
