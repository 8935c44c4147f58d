"""Suffix-array dedup: byte windows that start more than once anywhere, by a depth-limited radix sort of suffixes.

Only the first `length` bytes of a suffix matter, so suffixes are ordered to that depth alone and equal groups are
exactly the repeated windows. The most significant digit of a suffix is its window's minimizer, the gram of GRAM
bytes with the smallest hash in the window (the first of equals): equal windows agree on it, and neighbouring
suffixes mostly share it, so a run of them travels as one byte string.

1. First pass: runs meet by digit; a digit that occurs once ends its run. Only hashes and places travel.
2. The runs left are cut out of their texts and dealt to tasks by digit; there the further passes split groups by
   DIGIT bytes each and drop suffixes that are alone, until the full depth is reached.
3. What is left are repeated windows; their bytes are merged to spans and cut out of the texts.

Every task merges equal digits and equal runs of its own batch before it sends them, so a passage in a third of all
documents is one witness per batch. Digits that still occur in very many runs, at most HOT_DIGITS of them, are split:
their suffixes travel as window hashes of their own, each to its own place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, hash_pair
from postmill.session import cut

LENGTH = 200
GRAM = 50
DIGIT = 40
SEGMENT = 1 << 20
BATCH = 1 << 20
FRAGMENT_DIGITS, FRAGMENT_RUNS = 500_000, 20_000
HOT_RUNS, HOT_DIGITS = 50_000, 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 22) - 1)
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Polynomial hashes, mod 2^64, of every substring of a buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_powers.get("up", ())) < n + 1:
            size = max(n + 1, BATCH + SEGMENT)
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            for name, base in (("up", _BASE), ("down", inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers["up"][:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[starts + length] - self.sums[starts]) * _powers["down"][starts] + np.uint64(length))

    def all(self, length: int) -> np.ndarray:
        return _mixed((self.sums[length:] - self.sums[:-length]) * _powers["down"][: len(self.sums) - length] + np.uint64(length))


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, last window start, digit) of every run in a buffer of texts that end at `ends`."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty.astype(np.uint64)
    grams = Hashes(data).all(gram)
    width = length - gram + 1
    value = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(value)] = value
    table = padded.reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    anchor = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & _MASK).astype(np.int64)
    valid = np.ones(n, bool)
    for end in ends:
        valid[max(end - length + 1, 0) : end] = False
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last), grams[anchor[first]]


class Buffer:
    """Collects (part of) texts up to BATCH bytes; long texts come in segments that overlap by length - 1."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.parts, self.t1, self.t2, self.offset, self.wanted, self.size = [], [], [], [], [], 0

    def texts(self, t1: int, t2: int, raw: bytes, wanted=None):
        """Yield whenever the buffer is full; the caller then reads and clears it."""
        for at in range(0, max(len(raw) - self.length + 1, 0), SEGMENT):
            part = raw[at : at + SEGMENT + self.length - 1]
            self.parts.append(part)
            self.t1.append(t1)
            self.t2.append(t2)
            self.offset.append(at)
            self.wanted.append(wanted)
            self.size += len(part)
            if self.size >= BATCH:
                yield self

    def runs(self, gram: int):
        """data, owner, first, last (in the buffer), digit, t1, t2, first (in the text) of every run."""
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        ends = np.cumsum([len(p) for p in self.parts])
        first, last, digit = runs_of(data, ends, self.length, gram)
        owner = np.searchsorted(ends, first, side="right")
        begins = ends - np.array([len(p) for p in self.parts])
        place = first - begins[owner] + np.array(self.offset, np.int64)[owner]
        return data, owner, first, last, digit, np.array(self.t1, np.int64)[owner], np.array(self.t2, np.int64)[owner], place


def _dealt(where: np.ndarray, columns: list[np.ndarray]):
    """Rows of packed columns, one for each value of `where`."""
    order = np.argsort(where, kind="stable")
    where, columns = where[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(where)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(where)]):
        if b > a:
            yield int(where[a]), [c[a:b].tobytes() for c in columns]


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    """Hashed again, as digits are the smallest of many hashes and so lie close together."""
    h = _mixed(h + np.uint64(0xA0761D6478BD642F))
    return (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)] or [np.zeros(0, kind)])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, z): a 128-bit key of the text and the text's bytes, compressed for the shuffle."""

    def pack(stream):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in stream:
            z = pa.array([squeeze(x.as_buffer()) for x in batch.column(3).cast(pa.binary())], pa.binary())
            yield pa.record_batch([*batch.columns[:3], z], names=["doc_id", "t1", "t2", "z"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t1, t2 = hash_pair(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), text.alias("text"))
    # the inner join would add this filter for itself alone; with it in both joins they share one shuffle of the texts
    return rows.mapInArrow(pack, "doc_id long, t1 long, t2 long, z binary").filter("t1 IS NOT NULL AND t2 IS NOT NULL")


def repeated_digits(docs: DataFrame, text_col: str, fragments: int, length: int, gram: int, hot_runs: int) -> DataFrame:
    """(t1, t2, start) of the runs whose digit occurs in another run too; digits in hot_runs or more come as
    rows (digit, 0, -1) besides."""

    def first_pass(stream):
        held = Buffer(length)

        def flush(full):
            _, _, _, _, digit, t1, t2, place = full.runs(gram)
            full.clear()
            order = np.argsort(digit, kind="stable")
            d = digit[order]
            fresh = np.ones(len(d), bool)
            fresh[1:] = d[1:] != d[:-1]
            groups = np.diff(np.append(np.flatnonzero(fresh), len(d)))
            # one witness per digit goes to the digit's fragment with its count, the others are settled already
            count = np.zeros(len(d), np.int64)
            count[fresh] = groups
            spread = _fragment(_mixed(t1.view(np.uint64)[order] + place[order].astype(np.uint64)), fragments)
            where = np.where(fresh, _fragment(d, fragments), spread)
            rows = [(f, *c) for f, c in _dealt(where, [d, t1[order], t2[order], place[order], count])]
            kinds = [pa.int64()] + [pa.binary()] * 5
            names = ["fragment", "d", "t1", "t2", "place", "count"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

        for batch in stream:
            for t1, t2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                for full in held.texts(t1, t2, raw.as_py()):
                    yield flush(full)
        if held.parts:
            yield flush(held)

    def meet(table: pa.Table) -> pa.Table:
        d = _joined(table, "d", np.uint64)
        t1, t2, place, count = (_joined(table, c, np.int64) for c in ("t1", "t2", "place", "count"))
        settled = count == 0
        keep, hot = settled.copy(), np.zeros(0, np.int64)
        own = np.flatnonzero(~settled)
        own = own[np.argsort(d[own], kind="stable")]
        if len(own):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(d[own])) + 1])
            total = np.add.reduceat(count[own], starts)
            keep[own] = np.repeat(total > 1, np.diff(np.append(starts, len(own))))
            hot = d[own[starts[total >= hot_runs]]].view(np.int64)
        more = np.zeros(len(hot), np.int64)
        columns = ([t1[keep], hot], [t2[keep], more], [place[keep], more - 1])
        return pa.table(dict(zip(["t1", "t2", "start"], map(np.concatenate, columns))))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t1, t2 = hash_pair(text)
    packed = docs.select(t1.alias("t1"), t2.alias("t2"), text.alias("text")).mapInArrow(
        first_pass, "fragment long, d binary, t1 binary, t2 binary, place binary, count binary"
    )
    return packed.groupBy("fragment").applyInArrow(meet, "t1 long, t2 long, start long")


def sort_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at `starts` are repeated: most significant digit passes within the given groups.

    Each pass splits groups by the next DIGIT bytes and drops windows whose group weighs less than 2.
    """
    hashes, alive = Hashes(data), np.arange(len(starts))
    for at in range(0, length, DIGIT):
        size = min(DIGIT, length - at)
        groups = _mixed(groups * np.uint64(0x9E3779B97F4A7C15) + hashes.at(starts[alive] + at, size))
        order = np.argsort(groups, kind="stable")
        g = groups[order]
        first = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1]) if len(g) else np.zeros(0, int)
        if not len(first):
            break
        weight = np.repeat(np.add.reduceat(weights[alive[order]], first), np.diff(np.append(first, len(g))))
        kept = np.sort(order[weight > 1])
        alive, groups = alive[kept], groups[kept]
    out = np.zeros(len(starts), bool)
    out[alive] = True
    return out


def repeated_runs(texts: DataFrame, runs: DataFrame, fragments: int, length: int, gram: int) -> DataFrame:
    """(t1, t2, start, end): bytes covered by repeated windows, per text; may overlap."""
    hot_digits = np.array([r[0] for r in runs.filter("start < 0").select("t1").collect()], np.int64).view(np.uint64)
    lists = runs.filter("start >= 0").groupBy("t1", "t2").agg(F.collect_set("start").alias("starts"))
    joined = texts.join(lists, ["t1", "t2"]).select("t1", "t2", "z", "starts", "doc_id")

    def cut_out(stream):
        import zstandard

        held, unpack = Buffer(length), zstandard.ZstdDecompressor().decompress
        names = ["fragment", "bytes", "t1", "t2", "place", "windows", "weight", "d"]
        kinds = [pa.int64()] + [pa.binary()] * 7

        def flush(full):
            data, owner, first, last, digit, t1, t2, place = full.runs(gram)
            plain = np.zeros(len(first), bool)
            bounds = np.searchsorted(owner, np.arange(len(full.parts) + 1))
            for k, starts in enumerate(full.wanted):
                a, b = bounds[k], bounds[k + 1]
                plain[a:b] = np.isin(place[a:b], starts)
            hot = plain & np.isin(digit, hot_digits)
            plain &= ~hot
            full.clear()
            rows = []
            sums = Hashes(data)
            # hot digits: every suffix on its own, by the hash of its whole window
            n = last[hot] - first[hot] + 1
            if n.sum():
                base = np.repeat(first[hot], n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows += single(sums.at(base + step, length), np.repeat(t1[hot], n), np.repeat(t2[hot], n), np.repeat(place[hot], n) + step)
            first, last, digit, t1, t2, place = (x[plain] for x in (first, last, digit, t1, t2, place))
            # runs with equal bytes: one witness that counts twice, the others are covered whatever comes
            content = np.zeros(len(first), np.uint64)
            sizes = last - first + length
            for size in np.unique(sizes):
                of = sizes == size
                content[of] = sums.at(first[of], int(size))
            order = np.argsort(content, kind="stable")
            c = content[order]
            fresh = np.ones(len(c), bool)
            fresh[1:] = c[1:] != c[:-1]
            many = np.diff(np.append(np.flatnonzero(fresh), len(c)))
            weight = np.zeros(len(c), np.int64)
            weight[fresh] = np.minimum(many, 2)
            first, last, digit, t1, t2, place, sizes = (x[order] for x in (first, last, digit, t1, t2, place, sizes))
            spread = _fragment(_mixed(t1.view(np.uint64) + place.astype(np.uint64)), fragments)
            where = np.where(fresh, _fragment(digit, fragments), spread)
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[by])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(by)]):
                if b > a:
                    own = by[a:b]
                    raw = b"".join(data[first[k] : first[k] + sizes[k]].tobytes() for k in own if weight[k])
                    meta = [t1, t2, place, last - first + 1, weight, digit]
                    rows.append((int(where[own[0]]), raw, *[x[own].tobytes() for x in meta]))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

        def single(h, t1, t2, place):
            order = np.argsort(h, kind="stable")
            h, t1, t2, place = h[order], t1[order], t2[order], place[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[1:] != h[:-1]
            weight = np.zeros(len(h), np.int64)
            weight[fresh] = np.minimum(np.diff(np.append(np.flatnonzero(fresh), len(h))), 2)
            spread = _fragment(_mixed(t1.view(np.uint64) + place.astype(np.uint64)), fragments)
            where = np.where(fresh, _fragment(h, fragments), spread)
            one = np.zeros(len(h), np.int64)
            # no windows of its own: the hash stands for the one window
            return [(f, b"", *c) for f, c in _dealt(where, [t1, t2, place, one, weight, h])]

        for batch in stream:
            parts = [batch.column(k) for k in range(4)]
            for t1, t2, z, starts in zip(parts[0].to_pylist(), parts[1].to_pylist(), parts[2], parts[3]):
                for full in held.texts(t1, t2, unpack(z.as_py()), np.array(starts.as_py(), np.int64)):
                    yield flush(full)
        if held.parts:
            yield flush(held)

    def meet(table: pa.Table) -> pa.Table:
        data = _joined(table, "bytes", np.uint8)
        t1, t2, place, windows, weight = (_joined(table, c, np.int64) for c in ("t1", "t2", "place", "windows", "weight"))
        d = _joined(table, "d", np.uint64)
        out = []

        def add(keep, first, last):
            out.append([t1[keep], t2[keep], first, last + length])

        settled = weight == 0
        k = np.flatnonzero(settled)
        add(k, place[k], place[k] + np.maximum(windows[k], 1) - 1)
        k = np.flatnonzero(~settled & (windows == 0))
        if len(k):
            k = k[np.argsort(d[k], kind="stable")]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(d[k])) + 1])
            total = np.repeat(np.add.reduceat(weight[k], starts), np.diff(np.append(starts, len(k))))
            k = k[total > 1]
            add(k, place[k], place[k])
        k = np.flatnonzero(~settled & (windows > 0))
        if len(k):
            n = windows[k]
            begins = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            run = np.repeat(np.arange(len(k)), n)
            again = sort_windows(data, begins[run] + step, d[k][run], weight[k][run], length)
            run, step = run[again], step[again]
            if len(run):
                new = np.ones(len(run), bool)
                new[1:] = (run[1:] != run[:-1]) | (step[1:] != step[:-1] + 1)
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(run)) - 1
                add(k[run[a]], place[k[run[a]]] + step[a], place[k[run[a]]] + step[b])
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table(dict(zip(["t1", "t2", "start", "end"], columns)))

    packed = joined.mapInArrow(cut_out, "fragment long, bytes binary, t1 binary, t2 binary, place binary, windows binary, weight binary, d binary")
    return packed.groupBy("fragment").applyInArrow(meet, "t1 long, t2 long, start long, end long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), one row per input row: byte spans that repeated windows cover, the other bytes.

    A window is `length` bytes of a text's UTF-8 that also start anywhere else, in the same text or another, one
    of its copies or a repeated row included; spans are maximal and sorted, [start, end). Null and empty
    texts have no bytes; texts under `length` bytes no windows. Null ids stay null; other columns are
    ignored; an empty table gives no rows.
    """
    if not 0 < gram <= length:
        raise ValueError("gram is at most length")
    size = bound_batches(docs).agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    total = size // (max(length - gram, 2) // 2)  # a run has about half as many windows as a window has grams
    fragments = int(max(2 * cores, total // FRAGMENT_DIGITS))
    texts = _texts(docs, id_col, text_col)
    runs = cut(repeated_digits(docs, text_col, fragments, length, gram, max(HOT_RUNS, total // HOT_DIGITS)))
    spans = repeated_runs(texts, runs, int(max(2 * cores, runs.count() // FRAGMENT_RUNS)), length, gram)
    per_text = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = texts.join(per_text, ["t1", "t2"], "left").select("doc_id", "z", "spans")
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"

    def cut_away(stream):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in stream:
            n, found, kept = [], [], []
            for z, some in zip(batch.column(1), batch.column(2)):
                raw = unpack(z.as_py())
                own = merged([(s["start"], s["end"]) for s in some.as_py() or []])
                edges = [0, *[x for span in own for x in span], len(raw)]
                n.append(len(raw))
                found.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut_away, schema)
