import os

import numpy as np
import pytest

from ledgerloom.llm import token_counts

from .corpora import awkward, frame

needs_vocabulary = pytest.mark.skipif(not os.path.exists(token_counts.TOKENIZER), reason="no vocabulary file here")


@needs_vocabulary
@pytest.mark.parametrize("block", [1 << 16, 50, 7])
def test_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(token_counts, "SCAN_RUN", 3)
    rows = awkward()
    enc = token_counts.encoder(token_counts.TOKENIZER)
    want = sorted(((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in rows), key=repr)
    got = token_counts.token_counts(frame(spark, rows), block_tokens=block).collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert token_counts.token_counts(frame(spark, [])).collect() == []


def test_stream_without_ids_and_without_a_last_mark(spark):
    tokens = np.array([9, 5, 5, 9, 9, 5, 5, 5, 5, 9, 5], np.uint32)  # 9 ends a document
    blocks = [(0, i // 3, [], bytes(tokens[i : i + 3].tobytes())) for i in range(0, len(tokens), 3)]
    df = spark.createDataFrame(blocks, "file long, block long, ids array<long>, payload binary")
    got = token_counts.document_lengths(token_counts.scan_blocks(df, eod=9)).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == [0, 2, 0, 4, 1]
