"""Seeds hit wherever the definition of an overlap is met."""

from itertools import combinations

import numpy as np
import pytest

from rdfloom.llm import decontam


@pytest.mark.parametrize("n", range(5, 26))
def test_no_placement_of_substitutions_is_missed(n):
    """All placements that overlap() may accept in a passage of n tokens standing alone."""
    wrong = np.array([sum(1 << p for p in c) for c in combinations(range(n), n // 5)], dtype=np.int64)
    masks = decontam.MASKS if n >= decontam.MIN_OVERLAP else [tuple(range(decontam.run_of(n)))]
    hit = np.zeros(len(wrong), bool)
    for mask in masks:
        bits = sum(1 << p for p in mask)
        for s in range(n - mask[-1]):
            hit |= wrong & (bits << s) == 0
    assert hit.all()


def test_substitutions_are_found(spark):
    cases = [(13, (2, 4)), (15, (1, 4, 6)), (16, (1, 4, 6)), (12, (3, 6)), (11, (3, 6)), (10, (4,)), (5, (2,))]
    bench, docs = [], []
    for i, (n, wrong) in enumerate(cases):
        words = [f"i{i}w{k}" for k in range(n)]
        bench.append((i, " ".join(words)))
        docs.append((i, " ".join(["before", *("other" if k in wrong else w for k, w in enumerate(words)), "after"])))
    found = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(len(cases))}
