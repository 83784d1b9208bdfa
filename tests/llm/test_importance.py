"""Ratios, evidence and weights of the quality classifier against plain counting."""

import math
from collections import Counter

import numpy as np
from gridfuse.llm import common, importance

D = "/root/testdata/sf0.001"


def test_ratios_and_evidence_by_counting(spark):
    """With a bucket for (nearly) every word and pair, ratios are those of the words themselves."""
    texts = ["good fine text " * 3, "good fine words", "bad ugly text " * 4, "bad ugly words", "plain text of no kind", "", None, "good bad"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    buckets = 1 << 20
    found = importance.Classifier(docs, labels, buckets=buckets)
    features = [Counter(w := (t or "").split()) + Counter(zip(w, w[1:], strict=False)) for t in texts]
    counts = [sum((features[i] for i in ids), Counter()) for ids in ((0, 1), range(len(texts)), (2, 3))]
    totals = [sum(c.values()) for c in counts]

    def shrunk(f, other):
        t, o, n, m = counts[0][f], counts[other][f], totals[0], totals[other]
        plain = math.log((t + 1) / (n + buckets)) - math.log((o + 1) / (m + buckets))
        apart = 2 * abs(math.sqrt(o + 0.375) - math.sqrt(t * m / n + 0.375)) / math.sqrt(1 + m / n)
        return plain * apart**4 / (apart**4 + 4.0**4)

    scored = {r.doc_id: r for r in found.scored.collect()}
    for i, f in enumerate(features):
        n = max(1, sum(f.values()))
        assert abs(scored[i].mean_raw - sum(shrunk(x, 1) * k for x, k in f.items()) / n) < 1e-4
        assert abs(scored[i].sum_toxic - sum(shrunk(x, 2) * k for x, k in f.items())) < 1e-4
    assert scored[2].sum_toxic < 0 < scored[0].sum_toxic


def test_few_documents_lack_evidence(spark):
    docs, labels = (common.read(spark, D, t) for t in ("documents", "labels"))
    scored = importance.Classifier(docs, labels).scored.join(docs.filter("text rlike '[^ \\t-\\r]'").select("doc_id"), "doc_id", "left_semi").toPandas()
    assert (scored["mean_raw"] == 0).mean() < 0.01
    assert np.isfinite(scored["mean_raw"]).all()
