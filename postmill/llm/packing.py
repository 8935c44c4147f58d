"""Best-fit packing: tokenised documents into as few sequences of fixed capacity as a configuration LP finds."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, fresh, join_small, ranked
from postmill.llm.tokens import WordIds, chunks, encoded, word_ids
from postmill.session import cut

CAPACITY = 2048
END_ID = 0
EPSILON = 0.15
MAX_PHASES = 200
CHUNK_BYTES = 1 << 20

# --- tokens ------------------------------------------------------------------------------


def cut_pieces(stream, words: WordIds, capacity: int):
    """Batches of pieces from batches of (id, text).

    Little text at a time, and Arrow's free memory goes back after each: Python workers live on, and what one still holds
    counts beside everything that its executor runs later.
    """
    for (doc,), texts in chunks(stream, size=CHUNK_BYTES):
        ids, bounds = encoded(words, texts, END_ID)
        lengths = np.diff(bounds)
        pieces = -(-lengths // capacity)
        of = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, lengths[of] - start)
        first = bounds[of] + start
        data = ids.astype("<u4", copy=False)
        sums = [zlib.crc32(data[a : a + n]) for a, n in zip(first.tolist(), length.tolist())]
        columns = [doc.take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(sums, pa.int64())]
        yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del ids, bounds, data, columns
        pa.default_memory_pool().release_unused()


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): only documents over `capacity` ids are cut, at its multiples."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"

    def cut_up(stream):
        yield from cut_pieces(stream, word_ids(tokenizer_file), capacity)

    return bound_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut_up, schema)


# --- configuration LP over the length histogram --------------------------------------------


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value and last length (0: leave a unit empty) for every capacity, each length as often as it fits."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = values
    for c in range(1, capacity + 1):
        totals = worth[1 : c + 1] + best[c - 1 :: -1] if c > 1 else worth[1:2] + best[:1]
        k = int(totals.argmax())
        if totals[k] > best[c - 1] + 1e-15:
            best[c], last[c] = totals[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _fills(last: np.ndarray) -> list[tuple[int, ...]]:
    """The best configuration of every capacity, longest first."""
    fills: list[tuple[int, ...]] = [()]
    for c in range(1, len(last)):
        fills.append(tuple(sorted((*fills[c - last[c]], int(last[c])), reverse=True)) if last[c] else fills[c - 1])
    return fills


def solve_configurations(histogram: dict[int, int], capacity: int = CAPACITY, epsilon: float = EPSILON, phases: int = MAX_PHASES) -> dict[tuple, float]:
    """Fractional covering LP, min sum x_p with every length covered, by multiplicative weights.

    Weights start alike per unit of demand and fall with what is covered. Each phase prices by one knapsack
    dynamic program: it gives the best configuration through every length, and all that are within
    1 - epsilon of the best one take a step at once. The result covers every demand; only the histogram,
    at most `capacity` numbers, is ever needed here.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(lengths):
        return {}
    demand = np.array([histogram[int(k)] for k in lengths], dtype=float)
    place = {int(k): i for i, k in enumerate(lengths)}
    covered, solution = np.zeros(len(lengths)), defaultdict(float)
    target = np.log(max(len(lengths), 2)) / epsilon
    for _ in range(phases):
        share = covered / demand
        low = share.min()
        if low >= target:
            break
        # a length is worth the room it fills, less as it is covered; that start is close to the dual optimum
        values = lengths * np.exp(-epsilon * (share - low))
        best, last = _knapsack(lengths, values, capacity)
        if low > 0 and sum(solution.values()) / low <= (1 + epsilon) * float(values @ demand) / best[capacity]:
            break  # weak duality: no covering is better by more than the factor
        through = values + best[capacity - lengths]
        good = np.flatnonzero(through >= (1 - epsilon) * best[capacity])
        room = demand.copy()  # no length gains more than its demand in a phase, so old prices stay near enough
        fills = _fills(last)
        for i in good[np.argsort(share[good], kind="stable")]:
            pattern = tuple(sorted((int(lengths[i]), *fills[capacity - int(lengths[i])]), reverse=True))
            times = Counter(pattern)
            step = min(room[place[k]] / t for k, t in times.items())
            if step <= 0:
                continue
            solution[pattern] += step
            for k, t in times.items():
                covered[place[k]] += step * t
                room[place[k]] -= step * t
    floor = (covered / demand).min()
    return {p: x / floor for p, x in solution.items()} if floor > 0 else {}


def _best_fit(left: dict[int, int], capacity: int) -> dict[tuple, int]:
    """Best fit, longest first, over counts: open sequences are kept by free room, then by content."""
    open_by_room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for length in sorted((k for k, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            room = min((r for r, held in open_by_room.items() if r >= length and held), default=capacity)
            if held := open_by_room[room]:
                content, count = next(iter(held.items()))
                used = min(n, count)
                held[content] -= used
                if not held[content]:
                    del held[content]
                if not held:
                    del open_by_room[room]
            else:
                content, used = (), max(1, n // (capacity // length))
            open_by_room[room - length][(*content, length)] += used
            n -= used
    done: dict[tuple, int] = defaultdict(int)
    for held in open_by_room.values():
        for content, n in held.items():
            done[content] += n
    return done


def round_configurations(solution: dict[tuple, float], histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple, int]:
    """Whole numbers of configurations that hold every length exactly as often as it occurs.

    Fullest and most used first, each configuration is taken as often as its share, rounded down, and what
    is still open allow; what remains, the fractions, goes by best fit.
    """
    left, counts = dict(histogram), defaultdict(int)
    for pattern, x in sorted(solution.items(), key=lambda item: (-sum(item[0]), -item[1], item[0])):
        kinds = {k: pattern.count(k) for k in set(pattern)}
        n = min(int(x + 1e-9), *(left[k] // t for k, t in kinds.items()))
        if n > 0:
            counts[pattern] += n
            for k, t in kinds.items():
                left[k] -= n * t
    for content, n in _best_fit(left, capacity).items():
        counts[tuple(sorted(content, reverse=True))] += n
    return dict(counts)


def _places(counts: dict[tuple, int]) -> list[tuple]:
    """Rows (length, first, after, base, times, offset): pieces of a length numbered first <= r < after go to
    sequence base + (r - first) // times at offset + ((r - first) % times) * length."""
    rows, base, seen = [], 0, defaultdict(int)
    for pattern, n in sorted(counts.items()):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            rows.append((length, seen[length], seen[length] + n * times, base, times, offset))
            seen[length] += n * times
            offset += times * length
        base += n
    return rows


# --- assignment ----------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (any columns and an int `length`, 1 to capacity) plus sequence_id and offset, gapless from 0.

    Pieces are numbered within their length, in salted groups as one length may hold any share of all rows;
    their number then tells sequence and offset. `pieces` is read several times: cut it before.
    The table of places has at most a few rows for each configuration; it is joined by size.
    """
    col = fresh("pack")
    number, salt = col("number"), F.xxhash64(*[c for c in pieces.columns])
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    spark = pieces.sparkSession
    counts = round_configurations(solve_configurations(histogram, capacity), histogram, capacity)
    names = ["length", "first", "after", "base", "times", "at"]
    first, after, base, times, at = map(col, names[1:])
    salts = max(256, max(histogram.values(), default=0) // 20_000)
    numbered = ranked(pieces, ["length"], salt, number, salts)
    # a piece finds its place by block of numbers, so no range join is needed; at most 20,000 blocks in all
    block = max(64, sum(histogram.values()) // 20_000)
    cells = [
        (length, b, lo, hi, *rest) for length, lo, hi, *rest in _places(counts) for b in range(lo // block, (hi - 1) // block + 1)
    ]
    schema = f"length int, {col('block')} long, {first} long, {after} long, {base} long, {times} int, {at} int"
    places = spark.createDataFrame(cells, schema)
    keyed = numbered.withColumn(col("block"), F.floor(F.col(number) / block).cast("long"))
    placed = join_small(keyed, places, ["length", col("block")], "inner").filter(
        (F.col(number) >= F.col(first)) & (F.col(number) < F.col(after))
    )
    own = F.col(number) - F.col(first)
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(
        *keep, (F.col(base) + F.floor(own / F.col(times))).cast("long").alias("sequence_id"),
        (F.col(at) + own % F.col(times) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text is the end id alone; a null id stays null; repeated rows are packed each. Other
    columns are ignored. An empty table gives no rows. `tokenizer_file` must be readable on every executor.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer_file, id_col, text_col, capacity))
    packed = pack_pieces(pieces, capacity)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
