"""Ranked search against a plain loop over all items and documents."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lifespan.llm import ranking
from tests.llm.cases import frame, prose, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def expected(data, items, top=10):
    docs = [(r[0], Counter(terms_of(r[1]))) for r in data]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, i, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


ITEMS = [(0, "the of and THE Of"), (1, "thing tionable"), (2, "the of and the of"), (3, None), (4, ""), (5, "... --"), (6, "müssen Größe große GROSSE"),
         (7, "nowhere"), (8, prose(9, 300)), (8, "the of and to in"), (None, "x1 42"), (9, "the of and to in is"), (9, "the of and to in is")]


def items_frame(spark, data, *extra):
    names = "item_id long, text string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *(["clash"] * len(extra))) for r in data], names)


def answer(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranks(spark):
    data = rows() + [(500 + i, prose(i, 30 + i % 3), None, None, None) for i in range(40)] + [(900, "the of and", None, None, None)] * 12
    want = expected(data, ITEMS)
    docs, items = frame(spark, data, extra=("n", "terms", "query", "score")), items_frame(spark, ITEMS, "query", "doc_id", "rank")
    assert answer(ranking.rank(docs, items)) == want
    # blocks of one query, one document at a time
    assert answer(ranking.rank(docs, items, ranking.Settings(block=40, cells=1))) == want


def test_empty_tables(spark):
    assert answer(ranking.rank(frame(spark, []), items_frame(spark, ITEMS))) == []
    assert answer(ranking.rank(frame(spark), items_frame(spark, []))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), st.integers(1, 3), max_size=9), max_size=12))
def test_shared_sets_add_up(queries):
    sharing = ranking.shared_sets([Counter(q) for q in queries])
    weighted = np.arange(13 * 3).reshape(13, 3) ** 2 + 1
    values = ranking.accumulators(sharing, weighted)
    for q, nodes in zip(queries, sharing.queries):
        want = sum((weighted[t] * n for t, n in q.items()), np.zeros(3, dtype=np.int64))
        assert np.array_equal(values[nodes].sum(axis=0), want)
    assert len(sharing.sums) + sum(len(x) for x in sharing.queries) <= sum(map(len, queries))


def test_sharing_saves_additions():
    queries = [Counter(dict.fromkeys([*range(20), 100 + i], 1)) for i in range(50)]
    sharing = ranking.shared_sets(queries)
    assert len(sharing.sums) <= 20 and all(len(q) <= 3 for q in sharing.queries)
