"""Token ids of whole texts for a tokenizer that drops white space, a distinct word at a time."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 400_000
CHUNK_BYTES = 1 << 24
SIGNS = ".,;:!?#$%&*"
LATIN_END = "Ā"


class WordIds(dict):
    """Ids, as little-endian bytes, by blank-separated word.

    The tokenizer drops white space, lower-cases and parts letters from other signs, so words are independent, a
    capital Latin-1 word has its lower-case word's ids, and a run of signs after a letter its own. All else is left
    to the tokenizer. Only words that aren't made of others are kept; at CACHED_WORDS the older half goes.
    """

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.encode, self.model, self.older = tokenizer.encode, tokenizer.model, {}
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def _letters(self, word: str) -> bytes:
        """A word of lower-case Latin-1 letters is one unit of the model; this skips the steps that keep it as it is."""
        unit = word if word.isascii() else self.as_bytes(word)[0][0]
        return array("I", [token.id for token in self.model.tokenize(unit)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if (core := word.rstrip(SIGNS)) != word and core[-1:].isalpha() and core[-1] < LATIN_END:
            return self[core] + self[word[len(core) :]]
        letters = word.isalpha() and max(word) < LATIN_END
        if letters and (low := word.lower()) != word:
            return self[low]
        return self._kept(word, letters)

    def letters(self, word: str) -> bytes:
        """Ids of a word known to be lower-case Latin-1 letters."""
        ids = self.get(word)
        return self._kept(word, True) if ids is None else ids

    def _kept(self, word: str, letters: bool) -> bytes:
        if 2 * len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self._letters(word) if letters else array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    """One per Python worker, so later tasks find the words of earlier ones."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(tokenizer_file))


#: White space that parts words beside the blank.
BREAKS = "\n"
#: What `str.isalpha` takes below LATIN_END.
LATIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def _gather(table: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, ends): the pieces `of` of a table whose k-th piece has sizes[k] entries."""
    first = np.cumsum(sizes) - sizes
    size = sizes[of]
    ends = np.cumsum(size)
    return table[np.repeat(first[of] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


def _distinct_ids(words: WordIds, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(table, sizes): ids of every word. Words of Latin-1 letters with signs behind them, nearly all, are parted in Arrow."""
    core = pc.utf8_rtrim(distinct, SIGNS)
    plain = pc.match_substring_regex(core, LATIN).to_numpy(zero_copy_only=False)
    mask = pa.array(plain)
    cores = core.filter(mask)
    lows = pc.utf8_lower(cores).dictionary_encode()
    behind = [word[n:] for word, n in zip(distinct.filter(mask).to_pylist(), pc.utf8_length(cores).to_pylist())]
    tails = pa.array(behind, pa.string()).dictionary_encode()
    others = distinct.filter(pa.array(~plain)).to_pylist()
    own = [words.letters(low) for low in lows.dictionary.to_pylist()]
    after = [words[tail] if tail else b"" for tail in tails.dictionary.to_pylist()]
    pieces = own + after + [words[word] for word in others] + [b""]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    of = np.full((len(distinct), 2), len(pieces) - 1)
    of[plain, 0] = lows.indices.to_numpy()
    of[plain, 1] = tails.indices.to_numpy() + len(own)
    of[~plain, 0] = np.arange(len(others)) + len(own) + len(after)
    table, _ = _gather(np.frombuffer(b"".join(pieces), "<u4"), sizes, of.ravel())
    return table, sizes[of].sum(axis=1)


def encoded(words: WordIds, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): text k has ids[bounds[k]:bounds[k + 1]], the end id last; null is empty.

    Arrow splits the texts and numbers the distinct words, so Python touches each distinct word once.
    """
    parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), BREAKS, " "), " ")
    coded = parts.flatten().dictionary_encode()
    table, sizes = _distinct_ids(words, coded.dictionary)
    ids, ends = _gather(table, sizes, coded.indices.to_numpy())
    bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy()]
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def chunks(stream: Iterator[pa.RecordBatch], text: int = 1, size: int = CHUNK_BYTES) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    """(other columns, texts) of about `size` bytes of text each, from batches whose column `text` holds the texts."""
    held, n = [], 0

    def joined():
        columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)]
        return [c for i, c in enumerate(columns) if i != text], columns[text]

    for batch in stream:
        if batch.num_rows:
            held.append(batch)
            n += batch.column(text).nbytes
        if n >= size:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()
