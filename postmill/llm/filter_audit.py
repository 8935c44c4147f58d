"""Filter interaction audit: what each text filter removes, alone and in every order of the filters.

A row fails filters A to E as `failing` says. Rows become counts per part, set of failed filters and labels; those
counts add up, and all orders are read from them without touching the rows again.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, fresh, hash_pair, stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, "#$%&*|"

#: Sketch: counters come in blocks; a text's counters lie in one block, so a block is all that is needed to test it.
BLOCK = 1 << 16
COUNTERS_A_TEXT = 16
MAX_BLOCKS = 1 << 13  # at one bit a counter: 64 MB, the most that is ever broadcast
LONG_TEXT = 1 << 22


def _words(data: bytes) -> tuple[int, int]:
    """(words, distinct words) of UTF-8; bytes.split() parts at exactly [\\x20\\x09-\\x0D]. Long texts go piece by piece."""
    if len(data) < LONG_TEXT:
        words = data.split()
        return len(words), len(set(words))
    n, seen, at, blank = 0, set(), 0, re.compile(rb"[\x20\x09-\x0D]")
    while at < len(data):
        end = blank.search(data, at + LONG_TEXT)
        words = data[at : end.start() if end else len(data)].split()
        n += len(words)
        seen.update(words)
        at = end.start() if end else len(data)
    return n, len(seen)


def failing(text: str, min_words: int, distinct_percent: int, capital_percent: int, sign: re.Pattern) -> str:
    """Letters of the text's own filters that it fails: A few words, B repeated words, C capitals, D signs."""
    data = text.encode()
    n, distinct = _words(data)
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return "".join(
        letter for letter, fails in zip(FILTERS, (
            n < min_words, 100 * distinct < distinct_percent * n, 100 * capitals > capital_percent * len(text), sign.search(data) is not None,
        )) if fails
    )


# --- identical texts ---------------------------------------------------------------------


def _counters(h1: Column, h2: Column, blocks: int) -> tuple[Column, Column]:
    """(block, its counters) of a text."""
    return F.pmod(h1, F.lit(blocks)), F.array_distinct(F.array(F.pmod(h2, F.lit(BLOCK)), F.pmod(F.shiftright(h2, 16), F.lit(BLOCK))))


def repeated_counters(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): counting Bloom filter over columns h1, h2, one bit for each counter of two or more.

    Every task counts its own rows (partial aggregation); these sketches are merged by addition. A block has at most
    BLOCK counters, so the packed table has a bound: `blocks` rows of 8 KB.
    """

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK, np.uint8)
        bits[table.column("counter").to_numpy()] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
        return pa.table({"block": table.column("block").slice(0, 1), "bits": row})

    block, counters = _counters(F.col("h1"), F.col("h2"), blocks)
    merged = hashes.select(block.alias("block"), F.explode(counters).alias("counter")).groupBy("block", "counter").count()
    return merged.filter("count >= 2").select("block", "counter").groupBy("block").applyInArrow(pack, "block long, bits array<long>")


def _may_repeat(df: DataFrame, sketch: DataFrame, blocks: int, name: str) -> DataFrame:
    """`df` (with h1, h2) plus a flag: false only if no other row has the same text."""
    col = fresh("sketch")
    block, counters = _counters(F.col("h1"), F.col("h2"), blocks)
    side = F.broadcast(sketch.select(F.col("block").alias(col("block")), F.col("bits").alias(col("bits"))))
    set_bit = F.forall(
        F.col(col("at")), lambda c: F.get(F.col(col("bits")), F.shiftright(c, 6).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))) != 0,
    )
    keyed = df.withColumn(col("block"), block).withColumn(col("at"), counters)
    return keyed.join(side, col("block"), "left").select(*df.columns, F.coalesce(set_bit, F.lit(False)).alias(name))


def failed_filters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = MIN_WORDS,
    distinct_percent: int = DISTINCT_PERCENT, capital_percent: int = CAPITAL_PERCENT, signs: str = SIGNS,
) -> DataFrame:
    """doc_id, part, fails of every row; `fails` holds the letters of its failed filters, in order.

    E fails if a smaller id has the identical text. The sketch of all texts' hashes clears texts that are surely unique;
    only the others are shuffled, grouped by the text itself, for their smallest id. An id in that place, with the
    text's 128-bit hash (ids may repeat with other texts), passes E.

    Null text is empty, null part the empty string. A row with a null id never fails E and fails no other. Rows that
    repeat an id and its text all have the same result. An empty table gives no rows; other columns are ignored.
    """
    rows = bound_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    h1, h2 = hash_pair(F.col("text"))
    hashed = rows.withColumns({"h1": h1, "h2": h2})
    pattern = re.compile(b"[" + b"".join(re.escape(s.encode()) for s in signs) + b"]") if signs else re.compile(b"(?!)")

    def own(stream):
        for batch in stream:
            fails = [failing(t, min_words, distinct_percent, capital_percent, pattern) for t in batch.column("text").to_pylist()]
            kept = [batch.column(c) for c in ("doc_id", "part", "h1", "h2")]
            yield pa.record_batch([*kept, pa.array(fails, pa.string())], names=["doc_id", "part", "h1", "h2", "fails"])

    facts = stored(hashed.mapInArrow(own, "doc_id long, part string, h1 long, h2 long, fails string"), "filter-facts")
    blocks = min(MAX_BLOCKS, facts.count() * COUNTERS_A_TEXT // BLOCK + 1)
    sketch = stored(repeated_counters(facts, blocks), "text-sketch")
    col = fresh("audit")
    again = _may_repeat(hashed.select("doc_id", "text", "h1", "h2"), sketch, blocks, col("again")).filter(col("again"))
    first = again.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", *(h.alias(n) for h, n in zip((h1, h2), ("h1", "h2"))))
    judged = _may_repeat(facts, sketch, blocks, col("again"))
    firsts = first.withColumn(col("first"), F.lit(True))
    repeats = judged.filter(col("again")).join(firsts, ["doc_id", "h1", "h2"], "left")
    late = F.col(col("first")).isNull() & F.col("doc_id").isNotNull()
    return judged.filter(~F.col(col("again"))).select("doc_id", "part", "fails").unionByName(
        repeats.select("doc_id", "part", F.concat("fails", F.when(late, FILTERS[4]).otherwise("")).alias("fails"))
    )


# --- all orders ----------------------------------------------------------------------------


def mask_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, fails, rows, good, toxic: additive counts. An id with several labels is good or toxic if one says so."""
    side = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max((F.col(good_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic")
    )
    return failed.join(side, "doc_id", "left").groupBy("part", "fails").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from `mask_counts` (at most 2 ** filters rows a part)."""
    orders = ["".join(p) for p in permutations(filters)]
    letter = F.expr("substring(filter_order, step, 1)")
    grid = counts.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    ).select("*", letter.alias("filter"), F.expr("translate(fails, substring(filter_order, 1, step - 1), '') = fails").alias("there"))
    fails = F.contains("fails", "filter")
    removed = F.col("there") & fails
    total = lambda when, what="rows": F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    # a filter removes what fails it and none before: in one of len(fails) orders each
    share = F.floor(F.lit(len(orders)) / F.length("fails")).cast("long") * F.col("rows")
    return grid.groupBy("part", "filter_order", "step").agg(
        total(F.col("there") & ~fails)("kept"), total(removed)("removed"), total(fails & ~F.col("there"))("redundant"),
        total(F.col("fails") == F.col("filter"))("unique_fails"), total(removed, "good")("good_lost"), total(removed, "toxic")("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )
