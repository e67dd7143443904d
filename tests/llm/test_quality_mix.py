"""The threshold of the quality classifier doesn't depend on how many rows the fit leaves out."""

import numpy as np

from ledgerloom.llm import quality
from ledgerloom.llm.labelled import label_counts

from .corpora import frame
from .test_models import LABELS, corpus


def test_scores_follow_the_natural_share(spark):
    docs, _ = corpus(400)
    docs = [(i, "w1 w2 w3 w4 w5.", lang, s, n) for i, _, lang, s, n in docs]
    labels = [(i, int(i % 10 > 0), 0) for i in range(400)]
    a, b = frame(spark, docs, clash=False), spark.createDataFrame([*labels, (9999, 0, 0)], LABELS)
    bad, good = label_counts(a, b, "quality", 5, 0)
    assert bad + good < 400 and (bad, good) == tuple(sum(1 for i, q, _ in labels if q == k and not held(i)) for k in (0, 1))
    share = good / (bad + good)
    for per_label in (10, 2000):
        assert np.allclose([r.score for r in quality.quality_scores(a, b, per_label=per_label).collect()], share, atol=0.06)


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0
