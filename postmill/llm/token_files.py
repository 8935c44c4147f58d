"""Token files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart from data bytes.

A folder holds three Parquet tables, so that Spark's commit keeps lost and repeated tasks out:

* `vocabulary` (rank, id, n): rank 0 is the most frequent id; ties go to the smaller id. One row per id of the tokenizer.
* `blocks` (part, block, n_ids, doc_ids, lengths, control, data): whole documents in ascending doc_id order, about BLOCK_IDS
  ids to a block. An id's rank is written in 1 to 4 little-endian bytes in `data`; four ids share a byte of `control`, two bits
  each, low bits first, holding the number of bytes less one.
* `parts` (part, start, n_ids): the number of ids before each part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, fresh, join_small, stored
from postmill.llm.tokens import chunks, encoded, word_ids

END_ID = 2
BLOCK_IDS = 1 << 15
PART_IDS = 1 << 25

#: Bytes of each of the four ids whose lengths a control byte holds.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = np.zeros((len(ranks) + 3) // 4 * 4, dtype=np.uint8)
    control[: len(ranks)] = extra
    used = np.arange(4) <= extra[:, None]
    packed = control.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    return np.bitwise_or.reduce(packed, axis=1).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: lengths by table lookup, then one unaligned 32-bit read and a mask for each."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    words = np.ndarray(len(data) + 1, dtype="<u4", buffer=data + bytes(4), strides=(1,))
    return words[np.cumsum(size) - size] & MASKS[size]


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def _tokenised(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(doc_id, tie, seq, n, ids): ids as compressed 16-bit or, for a larger vocabulary, 32-bit numbers."""

    def run(stream):
        words = word_ids(tokenizer_file)
        seq = TaskContext.get().partitionId() << 32
        for (doc,), texts in chunks(stream):
            ids, bounds = encoded(words, texts, end_id)
            small = ids.astype(_width(tokenizer_file))
            rows = [small[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.record_batch(
                [
                    doc, pa.array([zlib.crc32(r) for r in rows], pa.int64()), pa.array(np.arange(seq, seq + len(rows))),
                    pa.array(np.diff(bounds)), _binary([pa.compress(r, codec="zstd", asbytes=True) for r in rows]),
                ],
                names=["doc_id", "tie", "seq", "n", "ids"],
            )
            seq += len(rows)

    return docs.mapInArrow(run, "doc_id long, tie long, seq long, n long, ids binary")


def _width(tokenizer_file: str) -> str:
    from tokenizers import Tokenizer

    size = _SIZES.get(tokenizer_file) or _SIZES.setdefault(tokenizer_file, Tokenizer.from_file(tokenizer_file).get_vocab_size())
    return "<u2" if size <= 1 << 16 else "<u4"


_SIZES: dict[str, int] = {}


def _ids_of(n: int, ids: bytes, width: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(ids, n * int(width[-1]), codec="zstd"), width)


def _vocabulary(tokens: DataFrame, size: int, width: str) -> np.ndarray:
    """Ids by rank. Tasks send one count per id they met; the totals are at most as many as the tokenizer's ids."""

    def counted(stream):
        total = np.zeros(size, np.int64)
        for batch in stream:
            for n, ids in zip(*(batch.column(c).to_pylist() for c in ("n", "ids"))):
                total += np.bincount(_ids_of(n, ids, width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "k"])

    counts = bound_batches(tokens).select("n", "ids").mapInArrow(counted, "id long, k long").groupBy("id").agg(F.sum("k").alias("k"))
    total = np.zeros(size, np.int64)
    for row in counts.collect():
        total[row.id] = row.k
    return np.stack([order := np.argsort(-total, kind="stable"), total[order]])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Encode every text, end each with `end_id`, and write the ids into `folder` in ascending id order.

    Null or empty text is the end id alone. Null ids come first; equal ids are ordered by what they hold; repeated rows
    are written each, and a range may end between them, so an id that holds a third of the rows is split. An empty
    table writes empty tables. Other columns are ignored. A text, however long, is one document in one block.
    `tokenizer_file` must be readable on every executor. Nothing but the counts of the tokenizer's ids reaches the driver.
    """
    from tokenizers import Tokenizer

    spark, width = docs.sparkSession, _width(tokenizer_file)
    size = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1)
    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = stored(_tokenised(rows, tokenizer_file, end_id), "token-ids")
    order, counts = _vocabulary(tokens, size, width)
    spark.createDataFrame(list(zip(range(size), order.tolist(), counts.tolist())), "rank int, id int, n long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size, dtype=np.uint32)
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_IDS + 1)

    def blocks(stream):
        block, part, held, docs_in, lengths, n = 0, TaskContext.get().partitionId(), [], [], [], 0

        def full():
            control, data = encode_ranks(rank_of[np.concatenate(held)])
            columns = [[part], [block], [n], [docs_in], [lengths], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=BLOCKS)

        for batch in stream:
            for doc, k, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                held.append(_ids_of(k, ids, width))
                docs_in.append(doc)
                lengths.append(k)
                n += k
                if n >= BLOCK_IDS:
                    yield full()
                    block, held, docs_in, lengths, n = block + 1, [], [], [], 0
        if held:
            yield full()

    key = ["doc_id", "tie", "seq"]
    ordered = tokens.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    coded = ordered.select("doc_id", "n", "ids").mapInArrow(blocks, BLOCK_SCHEMA)
    coded.write.parquet(f"{folder}/blocks", compression="zstd")
    written = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row per part: at most a few for each task of the cluster
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids")
    starts.coalesce(1).write.parquet(f"{folder}/parts")


BLOCKS = ["part", "block", "n_ids", "doc_ids", "lengths", "control", "data"]
BLOCK_SCHEMA = "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in the files), n_tokens, ids_crc32 and, if wanted, ids (array) of every document."""
    col = fresh("tok")
    # bounded by the tokenizer's ids
    id_of = np.array([r.id for r in spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()], dtype="<u4")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", "n_ids").withColumn(col("own"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    parts = spark.read.parquet(f"{folder}/parts").select("part", F.col("start").alias(col("base")))
    places = join_small(places, parts, ["part"], "inner").select("part", "block", (F.col(col("base")) + F.col(col("own"))).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decoded(stream):
        for batch in stream:
            for n, docs, lengths, control, data, start in zip(*(batch.column(c).to_pylist() for c in ("n_ids", "doc_ids", "lengths", "control", "data", "start"))):
                ids = id_of[decode_ranks(control, data, n)]
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - lengths
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                columns = [pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    joined = join_small(blocks, places, ["part", "block"], "inner")
    return bound_batches(joined).select("n_ids", "doc_ids", "lengths", "control", "data", "start").mapInArrow(decoded, schema)
