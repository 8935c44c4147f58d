"""Cross-tokenizer alignment: where the tokens of a byte-level BPE (A) and of a sentencepiece model (B) end together.

Both tokenizers read the text after one space. A unit is a stretch that neither tokenizer's tokens cross: it starts at a
space after something that is no white space. Units are encoded once a worker while they stay in its cache.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, stored
from postmill.llm.tokens import chunks

CACHED_UNITS = 300_000
UNITS_A_TEXT = 2048
BLANK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: A space that starts no unit: after white space or at the end.
INNER_SPACE = r"(?:^|[\s\x1c-\x1f\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]) | $"


def entry_bytes(tokenizer_file: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE; the letters of its entries stand for bytes."""
    from tokenizers import Tokenizer

    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    tokenizer = Tokenizer.from_file(tokenizer_file)
    entries = map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))
    return [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries]


def piece_bytes(model_file: str) -> list[bytes]:
    """Bytes of each id of a sentencepiece model with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]


def linkable_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys a * len(b) + b of all id pairs that can end together: one's bytes end with the other's.

    There are at most as many as the bytes of all entries times the ids that share an entry's bytes, whatever the corpus.
    """
    def by_bytes(entries):
        ids: dict[bytes, list[int]] = {}
        for k, e in enumerate(entries):
            ids.setdefault(e, []).append(k)
        return ids

    of_a, of_b, keys = by_bytes(a), by_bytes(b), set()
    for entry, ids in of_a.items():
        for at in range(len(entry)):
            keys.update(i * len(b) + j for j in of_b.get(entry[at:], ()) for i in ids)
    for entry, ids in of_b.items():
        for at in range(1, len(entry)):
            keys.update(i * len(b) + j for i in of_a.get(entry[at:], ()) for j in ids)
    return np.array(sorted(keys), np.int64)


# --- ends of tokens ------------------------------------------------------------------------


def _ends(start: np.ndarray, end: np.ndarray, size: np.ndarray, what: str) -> np.ndarray:
    """Byte ends of tokens from the bytes of their spans.

    A span is a coarse cut if the next one starts at or after its end. Tokens that share a character, as its parts or by
    byte fallback, end after their own decoded bytes, counted from the cut before.
    """
    decoded = np.cumsum(size)
    coarse = np.append(start[1:] >= end[:-1], True) & (end > start)
    if (decoded[coarse] != end[coarse]).any():
        raise ValueError(f"spans and bytes of {what} disagree")
    return np.where(coarse, end, decoded)


class Units(dict):
    """unit (without its space) -> (n_a, n_b, n_groups, groups, links) or None if bytes get lost; older half goes when full."""

    def __init__(self, a_file: str, b_file: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        super().__init__()
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_file)
        self.a_bytes, self.b_bytes = entry_bytes(a_file), piece_bytes(b_file)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in e]) for e in (self.a_bytes, self.b_bytes))
        self.keys, self.older = linkable_pairs(self.a_bytes, self.b_bytes), {}

    def fill(self, units: list[str]) -> None:
        """Encode what is missing, many units in one text."""
        missing = []
        if 2 * len(self) >= CACHED_UNITS:
            self.older = dict(self)
            self.clear()
        for unit in units:
            if unit not in self:
                if unit in self.older:
                    self[unit] = self.older[unit]
                else:
                    missing.append(unit)
        ended = [u for u in missing if not u[-1:].isspace()]
        for at in range(0, len(ended), UNITS_A_TEXT):
            part = ended[at : at + UNITS_A_TEXT]
            self.update(zip(part, self._aligned(part)))
        # white space at the end of a text would run into the next unit
        self.update((u, self._aligned([u])[0]) for u in missing if u[-1:].isspace())

    def _aligned(self, units: list[str]) -> list[tuple | None]:
        text = " " + " ".join(units)
        data = text.encode()
        coded = self.a.encode(text, add_special_tokens=False)
        spans = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces
        a_ids, b_ids = coded.ids, [p.id for p in spans]
        if b"".join([self.a_bytes[i] for i in a_ids]) != data or b"".join([self.b_bytes[i] for i in b_ids]) != data:
            half = len(units) // 2
            return self._aligned(units[:half]) + self._aligned(units[half:]) if half else [None]
        a, b, offsets = np.array(a_ids), np.array(b_ids), np.array(coded.offsets)
        if len(data) > len(text):  # characters to bytes
            first = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)
            offsets = np.append(first, len(data))[offsets]
        a_end = _ends(offsets[:, 0], offsets[:, 1], self.a_sizes[a], text)
        # the space that B adds has no place in its spans
        begin, end = np.array([p.begin for p in spans]) + 1, np.array([p.end for p in spans]) + 1
        begin[0] = 0
        b_end = _ends(begin, end, self.b_sizes[b], text)
        both, i, j = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        unit_end = np.cumsum([1 + len(u.encode()) for u in units])
        group_end = np.searchsorted(both, unit_end) + 1
        if (both[group_end - 1] != unit_end).any():
            raise ValueError(f"a token crosses units of {text!r}")
        links = np.searchsorted(self.keys, a[i] * len(self.b_bytes) + b[j]).astype(np.int32).tobytes()
        unit_of = [np.concatenate(([0], group_end)), np.concatenate(([0], i[group_end - 1] + 1)), np.concatenate(([0], j[group_end - 1] + 1))]
        n = np.diff([unit_of[1], unit_of[2], unit_of[0]]).T.tolist()
        groups = pc.binary_join_element_wise(_joined(a, i + 1, ","), _joined(b, j + 1, ","), "|")
        ends = [0, *(4 * group_end).tolist()]
        return [
            (*counts, string, links[x:y]) for counts, string, x, y in zip(n, _joined(groups, group_end, ";").to_pylist(), ends, ends[1:])
        ]


def _joined(values, ends: np.ndarray, sign: str) -> pa.Array:
    """Strings of runs of values, given where each run ends."""
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(values).cast(pa.string())), sign)


@lru_cache(maxsize=1)
def _units(a_file: str, b_file: str) -> Units:
    """One per Python worker."""
    return Units(a_file, b_file)


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """Units of each text (none of null or empty), without the space before each."""
    parts = pc.split_pattern(pc.if_else(pc.equal(pc.fill_null(texts, ""), ""), None, texts), " ")
    odd = pc.fill_null(pc.match_substring_regex(texts, INNER_SPACE), False)
    if not pc.any(odd).as_py():
        return parts
    lists = parts.to_pylist()
    for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        joined = []
        for part in lists[k] or ():
            if joined and (not joined[-1] or joined[-1][-1].isspace() or not part):
                joined[-1] += " " + part
            else:
                joined.append(part)
        lists[k] = joined
    return pa.array(lists, pa.list_(pa.string()))


# --- corpus ----------------------------------------------------------------------------------


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of `docs`.

    Two reads of the aligned rows: one adds up how often each id pair is linked in the corpus, one looks these
    counts up. The counts are an array over `linkable_pairs`, so its size depends on the two vocabularies alone; it is all that
    reaches the driver and is broadcast.

    Null and empty texts and texts whose joined token bytes aren't the text after a space have no tokens: zeros and ''.
    Ids may be null or repeated; repeated rows count each. An empty table gives no rows; other columns are ignored. Texts
    of any length are aligned whole. Both files must be readable on every executor.
    """
    spark = docs.sparkSession
    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def aligned(stream):
        units = _units(a_file, b_file)
        for (doc,), texts in chunks(stream):
            parts = unit_lists(texts)
            coded = parts.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            units.fill(words)
            found = [units.get(w) or units.older.get(w) for w in words]
            bad = np.array([f is None for f in found], bool)
            sizes = np.array([f[:3] if f else (0, 0, 0) for f in found], np.int64).reshape(-1, 3)
            groups, links = [f[3] if f else "" for f in found], [f[4] if f else b"" for f in found]
            at, bounds = coded.indices.to_numpy(), parts.offsets.to_numpy()
            sums = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(sizes[at], axis=0)))
            lost = np.concatenate(([0], np.cumsum(bad[at])))
            n, lost = sums[bounds[1:]] - sums[bounds[:-1]], lost[bounds[1:]] > lost[bounds[:-1]]
            n[lost] = 0
            shas, pairs, times = [], [], []
            at = at.tolist()
            for a, b, no in zip(bounds.tolist(), bounds[1:].tolist(), lost):
                if no or a == b:
                    shas.append("")
                    pairs.append(b"")
                    times.append(b"")
                    continue
                shas.append(hashlib.sha256(";".join([groups[k] for k in at[a:b]]).encode()).hexdigest())
                pair, k = np.unique(np.frombuffer(b"".join([links[k] for k in at[a:b]]), np.int32), return_counts=True)
                pairs.append(pair.tobytes())
                times.append(k.astype(np.int32).tobytes())
            yield pa.record_batch(
                [doc, *(pa.array(n[:, k]) for k in range(3)), pa.array(shas), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"
    done = stored(rows.mapInArrow(aligned, schema), "alignment")
    keys = linkable_pairs(a_bytes := entry_bytes(a_file), b_bytes := piece_bytes(b_file))
    totals = np.zeros(len(keys), np.int64)
    for pair, n in _pair_totals(done, len(keys)).toLocalIterator():
        totals[pair] = n
    b_ids = keys % len(b_bytes)
    best = np.zeros(len(b_bytes), np.int64)
    np.maximum.at(best, b_ids, totals)
    shared = spark.sparkContext.broadcast((totals, (totals == best[b_ids]) & (totals > 0)))

    def counted(stream):
        total, is_best = shared.value
        for batch in stream:
            n_links, n_best, count_sum = [], [], []
            for pair, k in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                pair, k = np.frombuffer(pair, np.int32), np.frombuffer(k, np.int32).astype(np.int64)
                n_links.append(int(k.sum()))
                n_best.append(int(k[is_best[pair]].sum()))
                count_sum.append(int((total[pair] * k).sum()))
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            new = [pa.array(c, pa.int64()) for c in (n_links, n_best, count_sum)]
            yield pa.record_batch([*kept, *new, batch.column("groups_sha256")], names=RESULT)

    return bound_batches(done).mapInArrow(counted, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in RESULT))


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _pair_totals(done: DataFrame, size: int) -> DataFrame:
    """(pair, n): links of each pair; a task sends one row for each pair it met."""

    def added(stream):
        total = np.zeros(size, np.int64)
        for batch in stream:
            for pair, k in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                total[np.frombuffer(pair, np.int32)] += np.frombuffer(k, np.int32)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met), pa.array(total[met])], names=["pair", "n"])

    return bound_batches(done).select("pairs", "times").mapInArrow(added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
