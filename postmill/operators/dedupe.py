"""Duplicate listings: keys, exact set-similarity pairs, grouping, canonical records.

Expected columns: listing_id, platform, title, company, location, description, url.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import text as tx
from postmill.session import cut, small


def richness(title: Column, company: Column, location: Column, description: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return (
        F.coalesce(F.length(description), F.lit(0)) / 100
        + F.when(filled(company), 2).otherwise(0)
        + F.when(filled(location), 1).otherwise(0)
        + F.when(filled(title), 1).otherwise(0)
    )


def listing_richness() -> Column:
    return richness(F.col("title"), F.col("company"), F.col("location"), F.col("description"))


def richest_per_key(df: DataFrame, *keys: str, score: Column | None = None, order: str = "listing_id") -> DataFrame:
    """Richest record per key, earliest on ties; the rank filter also runs before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(F.desc(score if score is not None else listing_richness()), F.col(order))
    return df.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")


def distinct_by(df: DataFrame, key: Column, order: str = "listing_id") -> DataFrame:
    """First row per key."""
    by = Window.partitionBy("_key").orderBy(order)
    return (
        df.withColumn("_key", key).withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank", "_key")
    )


def union_first_wins(first: DataFrame, second: DataFrame, key: Column) -> DataFrame:
    """All of `first`, plus rows of `second` whose key is new."""
    return first.unionByName(only_new(second, first, key))


def only_new(df: DataFrame, seen: DataFrame, key: Column) -> DataFrame:
    known = seen.select(key.alias("_key")).distinct()
    return df.withColumn("_key", key).join(known, "_key", "left_anti").drop("_key")


# --- similarity --------------------------------------------------------------------------


def word_set(description: Column, min_length: int = 4) -> Column:
    return F.array_distinct(F.filter(F.split(tx.normalize(description), " "), lambda w: F.length(w) >= min_length))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def _word_hashes(description: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words that `word_set` has; compared instead of the words from here on."""
    longer = F.regexp_extract_all(tx.fold(description), F.lit("[a-z0-9+#.]{4,}"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(longer, lambda w: F.xxhash64(w))))


CONTENT_KEY = ["block", "city", "marker", "set_1", "set_2"]


def content_keys(listings: DataFrame) -> DataFrame:
    """listing_id with its similarity block, city, marker, a 128-bit key of its word set, and the set. Worth a `cut`: texts are read for it."""
    c = F.col
    return (
        listings.filter(F.length("description") >= lx.MIN_SIMILAR_TEXT)
        .select(
            "listing_id",
            tx.normalize_company(c("company")).alias("block"),
            tx.city_token(c("location")).alias("city"),
            F.coalesce(tx.employment_marker(c("title")), F.lit("")).alias("marker"),
            _word_hashes(c("description")).alias("words"),
        )
        .withColumns({"set_1": F.xxhash64("words"), "set_2": F.xxhash64(F.reverse("words"))})
        .filter("block <> ''")
        .select("listing_id", *CONTENT_KEY, "words")
    )


def content_groups(listings: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One row per distinct (company, city, marker, word set): first listing, copies, word set.

    Exact copies meet through a map-side aggregation of small keys, so only one of them enters
    the similarity join however many there are. Its word set is taken from `keys` (`content_keys`, cut), texts are read once
    and sets are written once: the result is read from `keys` wherever it is used and need not be cut.
    """
    keys = cut(content_keys(listings)) if keys is None else keys
    reps = cut(keys.groupBy(*CONTENT_KEY).agg(F.min("listing_id").alias("rep_id"), F.count("*").alias("copies")))
    if reps.count() <= SMALL_REPS:
        sets = keys.select(F.col("listing_id").alias("rep_id"), "words")
        return sets.join(F.broadcast(reps), "rep_id").select("rep_id", *CONTENT_KEY, "copies", "words")
    firsts = of_ids(keys, reps.select(F.col("rep_id").alias("listing_id"))).withColumnRenamed("listing_id", "rep_id")
    several = small(cut(reps.filter("copies > 1").select("rep_id", "copies")), SMALL_REPS)
    return firsts.join(several, "rep_id", "left").select("rep_id", *CONTENT_KEY, F.coalesce("copies", F.lit(1)).alias("copies"), "words")


def of_ids(rows: DataFrame, ids: DataFrame, key: str = "listing_id") -> DataFrame:
    """Rows whose key is one of `ids` (cheap to count). The ids or, where they are fewer, those of the other rows are
    broadcast, so the rows, whose word sets are wide, stay where they are."""
    if ids.count() <= SMALL_REPS:
        return rows.join(F.broadcast(ids), key, "left_semi")
    others = cut(rows.select(key).distinct().join(ids, key, "left_anti"))
    return rows.filter(F.col(key).isNotNull()).join(small(others, SMALL_REPS), key, "left_anti")


#: Rows of a narrow side (a few numbers and short strings each) up to which it is broadcast, so that texts and word sets stay where they are.
SMALL_REPS = 500_000
#: Words whose frequency the tasks know; all others are rarer and ordered by their hash.
KNOWN_WORDS = 200_000


def _frequent_words(groups: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and frequencies of the most frequent words, at most KNOWN_WORDS of them, whole powers of two at a time."""
    counts = cut(groups.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"))
    least, known = None, 0
    for row in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words")).orderBy(F.desc("power")).collect():
        known += row.words
        if known > KNOWN_WORDS:
            break
        least = 2 ** int(row.power)
    if least is None:
        return np.empty(0, "int64"), np.empty(0, "int64")
    table = counts.filter(F.col("n") >= least).toPandas().sort_values("word")
    return table["word"].to_numpy("int64"), table["n"].to_numpy("int64")


def _prefixes(groups: DataFrame, threshold: float) -> DataFrame:
    """`groups` with its set's rarest words, |s| - ceil(t|s|) + 1 of them, instead of the set; one order of words for all sets."""
    context = groups.sparkSession.sparkContext
    words, frequencies = (context.broadcast(x) for x in _frequent_words(groups))

    def rarest(own: np.ndarray) -> np.ndarray:
        frequency = np.zeros(len(own), "int64")
        if len(words.value):
            at = np.minimum(np.searchsorted(words.value, own), len(words.value) - 1)
            frequency = np.where(words.value[at] == own, frequencies.value[at], 0)
        # (the small slack keeps borderline sizes on the safe side of floating point)
        keep = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
        return own[np.lexsort((own, frequency))[:keep]]

    def cut_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["prefix"] = [rarest(np.asarray(own, "int64")) for own in rows.pop("words")]
            yield rows

    sized = groups.select("block", "rep_id", F.size("words").alias("size"), "fresh", "words").filter("size > 0")
    return sized.mapInPandas(cut_down, "block string, rep_id long, size int, fresh boolean, prefix array<long>")


def similar_pairs(groups: DataFrame, threshold: float = lx.SIMILARITY_THRESHOLD) -> DataFrame:
    """Exact pairs of distinct word sets in a block with Jaccard >= threshold.

    Prefix filter: words have one order, from rare to frequent, and two sets that reach the threshold must share one of
    the first |s| - ceil(t|s|) + 1 words; only these are shuffled, and those that nobody else in the block has end there.
    The first word that two sets share has all others behind it, so places late in a prefix rule pairs out where they
    meet. Sets whose sizes differ by more than 1/t never meet. Nothing is capped. With a column `fresh`, pairs of two sets that
    aren't are left out, and never met. `groups` is read several times.
    """
    return _verified(groups, threshold, _overlaps).select("a", "b", "similarity")


def similar_edges(groups: DataFrame, threshold: float = lx.SIMILARITY_THRESHOLD) -> DataFrame:
    """Edges (a, b) that connect what `similar_pairs` connects: a tile gives each of its sets one edge, not its pairs."""
    return _verified(groups, threshold, lambda tile: _stars_of(*_overlaps(tile)[:2])).select("a", "b")


#: Places of one block that a task meets in one go; the words of a larger block are dealt to several.
CELL_PLACES = 1_000_000
#: Sets of a tile, in which pairs are verified, and partners of a set that are compared with it at once.
TILE_SETS, PARTNERS = 1_000, 4_096
#: Pairs that a task makes and holds at once.
HELD_PAIRS = 400_000


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pairs_of(group: np.ndarray, ids: np.ndarray, packed: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may reach `t`, from rows (word, set, its size, place and freshness) of whole words in the order of `group`."""
    size, place, fresh = packed >> 33, (packed >> 1) & 0xFFFFFFFF, (packed & 1).astype(bool)
    order = np.lexsort((size, group))
    group, ids, size, place, fresh = (x[order] for x in (group, ids, size, place, fresh))
    at = (group << 32) + size
    ahead = np.arange(len(ids)) + 1
    ends = np.searchsorted(at, (group << 32) + np.floor((size + 1e-9) / t + 1e-9).astype("int64"), "right")
    # a fresh set meets the stored ones of smaller size too, two fresh ones meet once
    starts = ahead if fresh.all() else np.searchsorted(at, (group << 32) + np.ceil(t * size - 1e-6).astype("int64"), "left")
    counts = np.where(fresh, np.maximum(ends - starts, 0), 0)
    upto = np.cumsum(counts)
    first = 0
    while first < len(ids):
        last = max(int(np.searchsorted(upto, (upto[first - 1] if first else 0) + HELD_PAIRS, "right")), first + 1)
        n = counts[first:last]
        i = np.repeat(np.arange(first, last), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[first:last], n)
        first = last
        small_, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        still = np.minimum(size[i] - place[i], size[j] - place[j])
        met = (ids[i] != ids[j]) & ((j > i) | ~fresh[j]) & (small_ >= t * large - 1e-9) & (still >= t / (1 + t) * (small_ + large) - 1e-6)
        i, j = i[met], j[met]
        yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _candidates(groups: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, that the prefix filter leaves.

    Near copies share dozens of the words that they are met by. The words of a block are therefore met in one task, which
    gives a pair once, not once a word; a larger block is dealt to several by word.
    """
    c = F.col
    places = _prefixes(groups, threshold).select("block", "rep_id", "size", "fresh", F.posexplode("prefix").alias("place", "word"))
    packed = F.shiftleft(c("size").cast("long"), 33) + F.shiftleft(c("place").cast("long"), 1) + c("fresh").cast("long")
    # a block and a word in one number; what falls together by that is told apart where pairs are verified
    half, home = 0xFFFFFFFF, F.shiftrightunsigned("key", 32)
    key = F.shiftleft(F.xxhash64("block"), 32).bitwiseOR(c("word").bitwiseAND(F.lit(half)))
    by = Window.partitionBy("key")
    met = places.select(key.alias("key"), "rep_id", packed.alias("packed")).withColumns({"company": F.count("*").over(by), "leads": F.max(c("packed") % 2).over(by)})
    shared = met.filter("company > 1 AND leads = 1").select("key", "rep_id", "packed", home.alias("home"))
    sizes = groups.select(F.xxhash64("block").bitwiseAND(F.lit(half)).alias("home"), F.ceil((1 - threshold) * F.size("words")).alias("n"))
    return meeting(shared, sizes.groupBy("home").agg(F.ceil(F.sum("n") / CELL_PLACES).alias("parts")), threshold)


def meeting(shared: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of sets that share a key, as sizes and places allow. Worth a `cut`, which it has.

    `shared`: home, key, rep_id, packed (size << 33 | place << 1 | fresh). Keys of one `home` are met in one task; `parts` (home, parts)
    says into how many it is dealt.
    """
    dealt = shared.join(small(cut(parts.filter("parts > 1"))), "home", "left").select(
        F.xxhash64("home", F.pmod("key", F.coalesce("parts", F.lit(1)))).alias("cell"), "key", "rep_id", "packed"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, waiting, n = np.empty(0, "int64"), np.empty(0, "int64"), [], 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal a, b
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            for x, y in _pairs_of(np.cumsum(new), rows[2], rows[3], threshold):
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
                if len(a) > HELD_PAIRS:
                    a, b = _distinct(a, b)
                    if len(a) > HELD_PAIRS // 2:
                        yield given()
                        a, b = a[:0], b[:0]

        for batch in batches:
            waiting.append([batch.column(k).to_numpy() for k in range(4)])
            n += batch.num_rows
            # a word's rows may go on in the next batch
            if n >= 100_000:
                rows = [np.concatenate(x) for x in zip(*waiting)]
                other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                done = int(other[-1]) + 1 if len(other) else 0
                if done:
                    yield from whole([x[:done] for x in rows])
                waiting, n = [[x[done:] for x in rows]], 0
        if waiting:
            yield from whole([np.concatenate(x) for x in zip(*waiting)])
        a, b = _distinct(a, b)
        yield given()

    found = dealt.repartition(_tasks(dealt), "cell").sortWithinPartitions("cell", "key").mapInArrow(meet, "a long, b long")
    return cut(found.distinct())


def shared_counts(x: np.ndarray, y: np.ndarray, ids: np.ndarray, lengths: np.ndarray, partners: int) -> np.ndarray:
    """How many elements the sets x and y of each pair share; `ids` are the small numbers of all sets' elements, pairs lie by x."""
    starts = np.cumsum(lengths) - lengths
    shared, held = np.zeros(len(x), "int64"), np.zeros(len(ids) and int(ids.max()) + 1, bool)
    edges = np.flatnonzero(np.diff(x, prepend=-1))
    for first, last in zip(edges, np.append(edges[1:], len(x))):
        own = ids[starts[x[first]]: starts[x[first]] + lengths[x[first]]]
        held[own] = True
        for lower in range(first, last, partners):
            others = y[lower: min(lower + partners, last)]
            n = lengths[others]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[others], n)
            shared[lower: lower + len(others)] = np.add.reduceat(held[ids[at]], np.cumsum(n) - n, dtype="int64")
        held[own] = False
    return shared


def _overlaps(tile: tuple[pd.DataFrame, pa.Table, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of the pairs of a tile that reach the threshold."""
    pairs, sets, t = tile
    codes = {name: pd.factorize(sets.column(name).to_pandas())[0] for name in ("block", "city", "marker")}
    blank = {name: (sets.column(name).to_pandas() == "").to_numpy() for name in ("city", "marker")}
    words = sets.column("words").combine_chunks()
    lengths = pc.list_value_length(words).to_numpy()
    ids = np.unique(words.flatten().to_numpy(), return_inverse=True)[1]
    row = pd.DataFrame({"id": sets.column("rep_id").to_numpy(), "row": np.arange(len(lengths))})
    # an id that comes twice gives its pairs twice
    met = pairs.merge(row, left_on="a", right_on="id").merge(row, left_on="b", right_on="id", suffixes=("_a", "_b"))
    met = met.sort_values("row_a", kind="stable")
    x, y = met["row_a"].to_numpy(), met["row_b"].to_numpy()
    fit = codes["block"][x] == codes["block"][y]
    for name in ("city", "marker"):
        fit &= blank[name][x] | blank[name][y] | (codes[name][x] == codes[name][y])
    a, b, x, y = met["a"].to_numpy()[fit], met["b"].to_numpy()[fit], x[fit], y[fit]
    shared = shared_counts(x, y, ids, lengths, PARTNERS)
    similarity = shared / (lengths[x] + lengths[y] - shared)
    kept = similarity >= t
    return a[kept], b[kept], similarity[kept]


def hubs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the pairs, the smallest node that each is connected with, and the number of its pairs."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        np.minimum.at(least, label, least)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return nodes, nodes[label], np.bincount(ends, minlength=len(nodes))


def _stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An edge from every node of the pairs to the smallest that it is connected with."""
    nodes, hubs, _ = hubs_of(a, b)
    far = nodes != hubs
    return nodes[far], hubs[far], np.ones(int(far.sum()))


def _verified(groups: DataFrame, threshold: float, result: Callable) -> DataFrame:
    """(a, b, similarity) as `result` gives it of the candidates in each tile."""
    if "fresh" not in groups.columns:
        groups = groups.withColumn("fresh", F.lit(True))
    sets = groups.filter(F.size("words") > 0).select("rep_id", "block", "city", "marker", "words")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        found = result((left.select(["a", "b"]).to_pandas(), right, threshold))
        return pa.Table.from_arrays([pa.array(x) for x in found], names=["a", "b", "similarity"])

    return tiled(_candidates(groups, threshold), sets, verify, "a long, b long, similarity double", TILE_SETS)


def tiled(candidates: DataFrame, sets: DataFrame, verify: Callable, schema: str, tile_sets: int, known: int | None = None) -> DataFrame:
    """`verify` of every tile's pairs (tile, a, b) and sets (tile, then the columns of `sets`, rep_id among them).

    Every pair is in one tile. A set that is met by many travels once a tile, not once a pair. Sets are dealt into tiles by the
    smallest set that they are met with, so the copies of one text lie together; a pair between two of them has a tile of a grid.
    Up to `known` rows that say where a set goes are broadcast, SMALL_REPS by default.
    """
    c, known = F.col, SMALL_REPS if known is None else known
    ends = candidates.select(c("a").alias("rep_id"), c("a").alias("leader")).unionByName(candidates.select(c("b").alias("rep_id"), c("a").alias("leader")))
    led = cut(ends.groupBy("rep_id").agg(F.min("leader").alias("leader")))
    tiles = max(1, led.count() // tile_sets)
    grid = max(1, tiles // 4)
    crowds = small(cut(led.groupBy("leader").agg(F.ceil(F.count("*") / (2 * tile_sets)).alias("parts")).filter("parts > 1")))
    home = led.join(crowds, "leader", "left").select(
        "rep_id", F.when(c("parts") > 1, c("leader")).alias("crowd"), F.pmod(F.xxhash64("rep_id"), F.coalesce("parts", F.lit(1))).alias("part"),
        F.pmod(F.xxhash64("leader"), F.lit(tiles)).alias("home"),
    )
    home = cut(home)
    a, b = (small(home.select(*[c(x).alias(f"{x}_{n}") for x in home.columns]), known) for n in "ab")

    def between(name: str, x: Column, y: Column) -> Column:
        return F.concat_ws(" ", F.lit(name), F.least(x, y), F.greatest(x, y))

    same, cell = c("crowd_a") == c("crowd_b"), lambda n: F.pmod(F.xxhash64(f"home_{n}", f"crowd_{n}", f"part_{n}"), F.lit(grid))
    alone = c("crowd_a").isNull() & c("crowd_b").isNull() & (c("home_a") == c("home_b"))
    tile = (
        F.when(same, F.concat_ws(" ", between("crowd", c("part_a"), c("part_b")), "crowd_a"))
        .when(alone, F.concat_ws(" ", F.lit("home"), "home_a")).otherwise(between("grid", cell("a"), cell("b")))
    )
    pairs = candidates.join(a, c("a") == c("rep_id_a")).join(b, c("b") == c("rep_id_b")).select(F.xxhash64(tile).alias("tile"), "a", "b")
    pairs = cut(pairs)
    asked = pairs.select("tile", c("a").alias("rep_id")).unionByName(pairs.select("tile", c("b").alias("rep_id")))
    where = cut(asked.groupBy("rep_id").agg(F.collect_set("tile").alias("tiles")))
    sent = sets.join(small(where, known), "rep_id").select(F.explode("tiles").alias("tile"), *sets.columns)
    return pairs.groupBy("tile").cogroup(sent.groupBy("tile")).applyInArrow(verify, schema)


# --- grouping ----------------------------------------------------------------------------


def _to_roots(parents: DataFrame) -> DataFrame:
    """Pointer doubling: (node, parent) with every parent replaced by the root of its tree."""
    while True:
        hop = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = cut(parents.join(hop, "parent").select("node", "parent", "grand"))
        parents = jumped.select("node", F.col("grand").alias("parent"))
        if jumped.filter("parent <> grand").isEmpty():
            return parents


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable id per node of an undirected edge list (a, b).

    Every round points each node at its smallest neighbour, follows the pointers to their roots,
    and contracts the graph to those roots. A root stands for at least two nodes and edges are
    distinct after every contraction, so the graph at least halves. Lineage is cut each round.
    """
    graph = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mapping = None
    for _ in range(max_rounds):
        if graph.isEmpty():
            break
        parents = (
            graph.select(F.col("a").alias("node"), F.col("b").alias("near"))
            .unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("near")))
            .groupBy("node")
            .agg(F.least(F.min("near"), F.col("node")).alias("parent"))
        )
        parents = _to_roots(parents)
        if mapping is None:
            mapping = parents
        else:
            step = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            mapping = cut(
                mapping.join(step, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
            )
        to_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        graph = cut(
            graph.join(to_a, "a").join(to_b, "b")
            .filter("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct()
        )
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return mapping.select("node", F.col("parent").alias("component"))


def _stars(listings: DataFrame, key: Column) -> DataFrame:
    """Edges from every row to the first row with the same key."""
    keyed = listings.select("listing_id", key.alias("key")).filter("key <> ''")
    hubs = keyed.groupBy("key").agg(F.min("listing_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(hubs, "key").filter("listing_id <> hub").select(
        F.col("listing_id").alias("a"), F.col("hub").alias("b")
    )


def duplicate_edges(listings: DataFrame, with_similarity: bool = True) -> DataFrame:
    c = F.col
    parts = [
        _stars(listings, tx.url_key(c("url"))),
        _stars(listings, tx.fingerprint(c("title"), c("company"), c("location"))),
    ]
    if with_similarity:
        keys = cut(content_keys(listings))
        groups = content_groups(listings, keys)
        copies = keys.drop("words").join(groups.filter("copies > 1").select(*CONTENT_KEY, "rep_id"), CONTENT_KEY)
        parts.append(
            copies.filter("listing_id <> rep_id").select(c("listing_id").alias("a"), c("rep_id").alias("b"))
        )
        parts.append(similar_edges(groups))
    return reduce(DataFrame.unionByName, parts)


def duplicate_groups(listings: DataFrame, with_similarity: bool = True) -> DataFrame:
    """Listings with `group_id`, the smallest listing id of their duplicate group."""
    components = small(connected_components(duplicate_edges(listings, with_similarity)), SMALL_REPS)
    return listings.join(components, F.col("listing_id") == F.col("node"), "left").select(
        *listings.columns, F.coalesce("component", "listing_id").alias("group_id")
    )


def canonical_listings(grouped: DataFrame) -> DataFrame:
    """Richest record per group with the platforms the listing was found on."""
    summary = grouped.groupBy("group_id").agg(
        F.sort_array(F.collect_set("platform")).alias("found_in_sources"), (F.count("*") - 1).alias("removed")
    )
    return richest_per_key(grouped, "group_id").join(summary, "group_id")


def dedupe_listings(listings: DataFrame, with_similarity: bool = True) -> DataFrame:
    return canonical_listings(duplicate_groups(listings, with_similarity))
