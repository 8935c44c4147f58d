import zlib

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import packing as pk


def test_a_worker_holds_one_megabyte_of_text_at_a_time():
    """Batches of more are cut into pieces before the next is read, so that workers stay small beside later stages."""
    tokenizers = pytest.importorskip("tokenizers")
    from postmill.llm.queries import tokenizer_file
    from postmill.llm.tokens import WordIds

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file())
    text, read = "pipeline data " * 90_000, []

    def stream():
        for k in range(4):
            read.append(k)
            yield pa.record_batch([pa.array([k, None], pa.int64()), pa.array([text, None], pa.string())], names=["doc_id", "text"])

    ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, pk.END_ID], "<u4")
    for k, out in enumerate(pk.cut_pieces(stream(), WordIds(tokenizer), 2048)):
        assert read == list(range(k + 1))
        rows = [r for r in out.to_pylist() if r["doc_id"] == k]
        assert [(r["start"], r["length"]) for r in rows] == [(a, min(2048, len(ids) - a)) for a in range(0, len(ids), 2048)]
        assert [r["ids_crc32"] for r in rows] == [zlib.crc32(ids[a : a + 2048]) for a in range(0, len(ids), 2048)]
        assert [r["length"] for r in out.to_pylist() if r["doc_id"] is None] == [1]
    assert k == 3
