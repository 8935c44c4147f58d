"""N-gram Jaccard join by vertical partitioning: the global n-gram order is cut into fragments, partial overlaps
are counted fragment by fragment and summed per pair.

The global order is the order of 64-bit n-gram hashes, so a fragment is a range of hashes and every document
has an even share of its n-grams in each. Steps:

1. Documents become sets; equal sets are one node, however many copies there are.
2. In each fragment of the order's lower half, n-grams that only one set holds are counted. A set whose own
   n-grams are more than it may miss with any partner links with nothing and leaves; that is nearly all text
   that is no near copy, however many passages it shares.
3. For the rest, sets that may link hold an equal non-empty fragment: with at most D differences and the first
   D + 1 non-empty fragments of each set compared, one of them must agree. Equal fragments form blocks, named by
   their smallest set; a set is in few of them.
4. Blocks are cut into chunks of bounded size; each pair of chunks sums partial overlaps over the fragments and
   gives every set one edge to the smallest set it is connected with there, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, fresh, join_small
from postmill.operators.dedupe import connected_components
from postmill.session import cut, small

WORDS = 4
PERCENT = 85
CACHED_WORDS = 100_000
FLUSH = 500_000
LONE_EIGHTHS = 4
FRAGMENT_POSTINGS = 1_000_000
SHARED = 2**64 - 1
CHUNK_SETS, CHUNK_POSTINGS = 1024, 600_000
COLUMN_BLOCK = 4_096
#: Rows of a few numbers that say where a set is wanted, up to which they are broadcast and texts stay where they are.
KNOWN_SETS = 500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hash by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return (h ^ (h >> np.uint64(29))) * _ODD[1]


def shingle_hashes(words: _WordHashes, text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams.

    bytes.lower changes A-Z only and bytes.split cuts at ASCII white space only. Fewer words than `size`
    are one n-gram, none give an empty set.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * _ODD[2 + k % 6] + w[k : len(w) - n + 1 + k]
    return np.unique(_mixed(h))


def differences(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Most elements by which a set of n and any set that reaches the threshold with it can differ in all."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def set_keys(docs: DataFrame, text_col: str, size: int = WORDS) -> DataFrame:
    """`docs` without its text, plus n_shingles and a 128-bit key of the set (s1, s2)."""
    others = [c for c in docs.columns if c != text_col]
    source = docs.select(*others, F.col(text_col).cast("string"))
    schema = docs.select(*others, F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2")).schema

    def keys(stream):
        import xxhash

        words = _WordHashes()
        for batch in stream:
            n, s1, s2 = [], [], []
            for text in batch.column(len(others)):
                h = shingle_hashes(words, text.as_py(), size)
                raw = h.tobytes()
                n.append(len(h))
                s1.append(xxhash.xxh3_64_intdigest(raw))
                s2.append(xxhash.xxh3_64_intdigest(raw, 1))
            own = [np.array(x, np.uint64).view(np.int64) for x in (n, s1, s2)]
            yield pa.record_batch([*batch.columns[:-1], *map(pa.array, own)], names=[*others, "n_shingles", "s1", "s2"])

    return source.mapInArrow(keys, schema)


def lone_counts(docs: DataFrame, text_col: str, fragments: int, size: int = WORDS) -> DataFrame:
    """(s1, lone): how many n-grams of the order's first LONE_EIGHTHS eighths each set holds alone, one task per fragment.

    A mapper sends each fragment one row for FLUSH n-grams: 32 bits of each hash, which are enough within a fragment of bounded
    size as an n-gram that only seems shared keeps its set, and the set's key. An n-gram that several sets of the
    mapper hold travels once, without a set. Fragments answer with packed counts per bucket of sets, so rows grow neither with the
    number of sets in a fragment nor with the copies of a frequent n-gram.
    """
    end = np.uint64(LONE_EIGHTHS << 61)

    def split(stream):
        import xxhash

        words, seen, parts, owners, held = _WordHashes(), {}, [], [], 0

        def flush():
            h, first, times = np.unique(np.concatenate(parts), return_index=True, return_counts=True)
            sets = np.array([SHARED, *seen], np.uint64)
            own = sets[np.where(times == 1, np.concatenate(owners)[first] + 1, 0)]
            where = (h >> np.uint64(32)) * np.uint64(fragments) // np.uint64(LONE_EIGHTHS << 29)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1]).tolist()
            low = h.astype(np.uint32)
            rows = [(int(where[a]), low[a:b].tobytes(), own[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(h)])]
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["fragment", "hashes", "sets"])

        for batch in stream:
            for text in batch.column(0):
                h = shingle_hashes(words, text.as_py(), size)
                key = xxhash.xxh3_64_intdigest(h.tobytes())
                if key in seen:
                    continue
                h = h[h < end]
                if len(h):
                    parts.append(h)
                    owners.append(np.full(len(h), len(seen), np.int64))
                    seen[key] = True
                    held += len(h)
                if held >= FLUSH:
                    yield flush()
                    seen, parts, owners, held = {}, [], [], 0
        if parts:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("hashes")])
        own = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("sets")])
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        # alone: all postings of the hash come from one set
        starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        least = np.minimum.reduceat(own, starts)
        alone = (least == np.maximum.reduceat(own, starts)) & (least != np.uint64(SHARED))
        sets, n = np.unique(least[alone], return_counts=True)
        bucket = sets % np.uint64(fragments // 4 + 1)
        order = np.argsort(bucket, kind="stable")
        sets, n, bucket = sets[order], n[order].astype(np.uint32), bucket[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]).tolist() if len(sets) else []
        rows = [(int(bucket[a]), sets[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(sets)])]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), kinds)], names=["bucket", "sets", "counts"])

    def add(table: pa.Table) -> pa.Table:
        own = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("sets")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
        sets, place = np.unique(own, return_inverse=True)
        return pa.table({"s1": sets.view(np.int64), "lone": np.bincount(place, n, len(sets)).astype(np.int64)})

    packed = docs.select(F.col(text_col).cast("string")).mapInArrow(split, "fragment long, hashes binary, sets binary")
    counted = packed.groupBy("fragment").applyInArrow(count, "bucket long, sets binary, counts binary")
    return counted.groupBy("bucket").applyInArrow(add, "s1 long, lone long")


def _need_bits(h: np.ndarray, wanted: int, least: int) -> int:
    """Fewest leading bits, `least` at least, under which the hashes lie in `wanted` fragments."""
    bits = least
    while bits < 64 and len(np.unique(h >> np.uint64(64 - bits)) if bits else h[:1]) < wanted:
        bits += 1
    return bits


def _classes(n: int, percent: int) -> list[int]:
    """Size classes, powers of two, in which a set of n meets its partners: its own and those of larger partners."""
    return list(range(n.bit_length() - 1, (n * 100 // percent).bit_length()))


def _least_bits(size_class: int) -> int:
    return max(0, (2 ** (size_class + 1) // 5).bit_length() - 1)


def fragment_bits(sets: DataFrame, percent: int) -> dict[int, int]:
    """Number of leading hash bits that cut each size class into fragments; at most 64 rows."""

    def need(stream):
        for batch in stream:
            most: dict[int, int] = {}
            for blob in batch.column(0):
                h = np.frombuffer(blob.as_buffer(), np.uint64)
                for c in _classes(len(h), percent):
                    most[c] = max(most.get(c, 0), _need_bits(h, int(differences(len(h), percent)) + 1, max(most.get(c, 0), _least_bits(c))))
            yield pa.record_batch([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int32())], names=["c", "bits"])

    rows = sets.select("hashes").mapInArrow(need, "c int, bits int").groupBy("c").agg(F.max("bits")).collect()
    return {r[0]: r[1] for r in rows}


def fragment_keys(sets: DataFrame, bits: dict[int, int], percent: int) -> DataFrame:
    """(key, node): the first D + 1 non-empty fragments of each set, each as one hash of class and content."""

    def keys(stream):
        for batch in stream:
            found, nodes = [], []
            for node, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.frombuffer(blob.as_buffer(), np.uint64)
                mixed = _mixed(h ^ _ODD[7])
                for c in _classes(len(h), percent):
                    where = h >> np.uint64(64 - bits[c]) if bits[c] else np.zeros(len(h), np.uint64)
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1]).astype(int)
                    wanted = int(differences(len(h), percent)) + 1
                    own = np.add.reduceat(mixed, starts)[:wanted]
                    found.append(_mixed(own + np.full(1, c + 1, np.uint64) * _ODD[6]))
                    nodes.append(np.full(len(own), node, np.int64))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return sets.select("node", "hashes").mapInArrow(keys, "key long, node long")


def hub_blocks(keys: DataFrame) -> DataFrame:
    """(node, block): the sets of every key, under the smallest of them. Sets that share a key share a block.

    Near copies share most keys and so few blocks, and a block grows with what is like its smallest set. What keys chain together
    grows much faster than the input; it is no block, as a block is compared all with all.
    """
    hubs = keys.groupBy("key").agg(F.min("node").alias("block"), F.max("node").alias("last")).filter("block < last").drop("last")
    return cut(keys.join(hubs, "key").select("node", "block").distinct())


def _common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many elements the sets of each pair share: partial overlaps of each fragment are added to the pairs' sums."""
    sides = [a] if b is None else [a, b]
    flat = [np.concatenate(s) for s in sides]
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sides]
    if b is None:
        values, counts = np.unique(flat[0], return_counts=True)
        shared = values[counts > 1]
    else:
        shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    overlap = np.zeros((len(a), len(sides[-1])), np.float32)
    for at in range(0, len(shared), COLUMN_BLOCK):
        fragment = shared[at : at + COLUMN_BLOCK]
        dense = []
        for f, r, s in zip(flat, rows, sides):
            place = np.searchsorted(fragment, f)
            place[place == len(fragment)] = 0
            hit = fragment[place] == f
            m = np.zeros((len(s), len(fragment)), np.float32)
            m[r[hit], place[hit]] = 1
            dense.append(m)
        overlap += dense[0] @ dense[-1].T
    return overlap.astype(np.int64)


def _tile_links(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which pairs reach the threshold."""
    sizes = [np.array([len(x) for x in s]) for s in ([a, a] if b is None else [a, b])]
    common = _common(a, b)
    return 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)


def _tile_rows(nodes: np.ndarray, linked: np.ndarray, split: int | None) -> list[tuple]:
    """(node, hub, links) of every linked node; the hub is the smallest node it is connected with in the tile."""
    if split is None:
        full = linked.copy()
        np.fill_diagonal(full, False)
    else:
        full = np.zeros((len(nodes), len(nodes)), bool)
        full[:split, split:] = linked
        full[split:, :split] = linked.T
    degree, seen, out = full.sum(axis=1), np.zeros(len(nodes), bool), []
    for start in np.argsort(nodes):
        if seen[start] or not degree[start]:
            continue
        reached = np.zeros(len(nodes), bool)
        edge = reached.copy()
        reached[start] = edge[start] = True
        while edge.any():
            edge = full[edge].any(axis=0) & ~reached
            reached |= edge
        seen |= reached
        out += [(int(nodes[k]), int(nodes[start]), int(degree[k])) for k in np.flatnonzero(reached)]
    return out


def block_links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(node, hub, links) per pair of chunks of a block; blocks of any size, chunks of bounded size.

    `blocks`: (node, block), a set may be in several. Two sets that meet in more than one block link in the first of them.
    """
    # all but the last step handles numbers only; the hashes travel twice, to their tiles' rows and to the tiles
    own = blocks.groupBy("node").agg(F.sort_array(F.collect_set("block")).alias("homes"))
    sized = sets.select("node", (F.octet_length("hashes") / 8).cast("long").alias("n")).distinct().join(blocks, "node")
    shape = sized.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("postings"))
    chunks = F.ceil(F.greatest(F.col("sets") / CHUNK_SETS, F.col("postings") / CHUNK_POSTINGS)).cast("int").alias("chunks")
    chunked = sized.join(shape.filter("sets > 1").select("block", chunks), "block").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    tiles = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node"
    )
    tiles = tiles.join(sets.join(own, "node"), "node").select(
        "block", "i", "j", "chunk", "node", "hashes", F.filter("homes", lambda x: x < F.col("block")).alias("before")
    )
    dealt = tiles.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "node")

    def compare(stream):
        def finish(key, held):
            _, i, j = key
            first = [x for x in held if x[0] == i]
            second = [x for x in held if x[0] == j] if i != j else []
            if not second and (i != j or len(first) < 2):
                return []
            sides = [[x[k] for x in first] for k in (2, 3)], [[x[k] for x in second] or None for k in (2, 3)]
            linked = _tile_links(sides[0][0], sides[1][0], percent)
            if linked.any():
                linked &= _common(sides[0][1], sides[1][1]) == 0
            return _tile_rows(np.array([x[1] for x in first + second]), linked, len(first) if second else None)

        def batch_of(rows):
            names = ["node", "hub", "links"]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=names)

        key, held = None, []
        for batch in stream:
            ids = zip(*(batch.column(k).to_pylist() for k in range(5)))
            rows = []
            for (block, i, j, chunk, node), blob, before in zip(ids, batch.column(5), batch.column(6)):
                if (block, i, j) != key:
                    rows += finish(key, held) if held else []
                    key, held = (block, i, j), []
                if not held or held[-1][1] != node:  # rows of equal id and text bring a set more than once
                    held.append((chunk, node, np.frombuffer(blob.as_py(), np.uint64), before.values.to_numpy()))
            yield batch_of(rows)
        if held:
            yield batch_of(finish(key, held))

    return dealt.mapInArrow(compare, "node long, hub long, links long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, str, str]:
    """Rows without their texts, distinct sets with their component, and the columns that name a row: id and text hash.

    `rep` is the smallest such pair of a set. `component` tells components apart where component_id can't: ids
    may be null or repeated.
    """
    if not 50 < percent <= 100:  # else D + 1 may exceed the size of a set
        raise ValueError("percent is 51 to 100")
    col = fresh("jaccard")
    rid, rtext = col("id"), col("key")
    own = bound_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias(rid),
        F.xxhash64(text_col).alias(rtext), F.col(text_col).cast("string").alias("text"),
    )
    keyed = cut(set_keys(own, "text", size))
    grouped = cut(
        keyed.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles")
        .agg(F.min(F.struct(rid, rtext)).alias("rep"), F.min("doc_id").alias("first_id"))
    )
    numbered = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    # copies are counted as well: every task that reads one sends its n-grams
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total * LONE_EIGHTHS // (8 * FRAGMENT_POSTINGS)))
    lone = lone_counts(own, "text", int(fragments), size)
    n = F.col("n_shingles")
    kept = cut(
        numbered.join(lone, "s1", "left")
        .filter(F.coalesce("lone", F.lit(0)) <= n - F.ceil(n * percent / 100.0 - 1e-9))
        .select("node", F.col(f"rep.{rid}").alias(rid), F.col(f"rep.{rtext}").alias(rtext))
    )

    def sets_of(stream):
        words = _WordHashes()
        for batch in stream:
            blobs = [shingle_hashes(words, text.as_py(), size).tobytes() for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], names=["node", "hashes"])

    texts = own.join(small(kept, KNOWN_SETS), [rid, rtext]).select("node", "text")
    sets = cut(texts.mapInArrow(sets_of, "node long, hashes binary"))
    keys = cut(fragment_keys(sets, fragment_bits(sets, percent), percent))
    links = cut(block_links(sets, hub_blocks(keys), percent))
    merged = connected_components(links.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    degree = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    labelled = cut(
        numbered.join(merged, "node", "left").join(degree, "node", "left")
        .select("s1", "s2", "rep", "first_id", "n_links", F.coalesce("component", "node").alias("component"))
    )
    return keyed, labelled, rid, rtext


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per input row.

    Two documents link when 100 * shared n-grams >= percent * all n-grams of both (percent 51 to 100);
    component_id is the smallest id reachable by links, its own included. n_links counts the other sets a
    document's set links with; copies share a set. Null, empty and blank texts have no n-grams and stay
    alone. Rows with one id are judged apart; a null id never is the smallest, so a component of null ids only
    has the component_id null. Empty tables give no rows; other columns are ignored.
    """
    keyed, labelled, _, _ = _labelled(docs, id_col, text_col, size, percent)
    n = F.col("n_shingles")
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = labelled.join(smallest, "component").select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), "component_id", "n_links")
    same = (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("n_shingles") > 0)
    return keyed.join(by_set, same, "left").select(
        "doc_id", "n_shingles", F.when(n > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of linked documents, and every row whose text has no n-grams.

    The row with the smallest id stays, null ids last; of rows with that id and text, the smallest in all columns.
    Only the names of rows that go or are repeated are looked up, so unique texts aren't shuffled while those are few.
    """
    keyed, labelled, rid, rtext = _labelled(docs, id_col, text_col, size, percent)
    first = labelled.groupBy("component").agg(F.min("rep").alias("rep")).select(f"rep.{rid}", f"rep.{rtext}", F.lit(True).alias("stays"))
    rows = keyed.filter("n_shingles > 0").groupBy(rid, rtext).agg(F.count("*").alias("n"))
    special = cut(rows.join(first, [rid, rtext], "left").filter("stays IS NULL OR n > 1").select(rid, rtext, "stays"))
    named = docs.withColumns({rid: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), rtext: F.xxhash64(text_col)})
    plain = join_small(named, special.select(rid, rtext), [rid, rtext], "left_anti").select(*docs.columns)
    repeated = join_small(named, special.filter("stays").select(rid, rtext), [rid, rtext], "inner")
    single = repeated.groupBy(rid, rtext).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return plain.unionByName(single)
