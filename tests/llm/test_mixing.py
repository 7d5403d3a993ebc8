from collections import Counter, defaultdict

import pytest

from lifespan.llm import mixing
from tests.conftest import DATA
from tests.llm.cases import frame, rows, words_of


def brute_targets(sizes, weights=mixing.PRODUCTION):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights.cycle[i % len(weights.cycle)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), weights.share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if weights.cap * sizes[s] <= w[s] * level}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = weights.cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(docs, plan):
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
    want = brute_targets({s: sizes[s] for s in {r.source for r in docs.select("source").collect()}})
    got = {r.source: r for r in plan.collect()}
    assert {s: r.source_size for s, r in got.items()} == {s: sizes[s] for s in want}
    assert all(r.target == pytest.approx(want[s]) for s, r in got.items())
    assert len(got) == plan.count()


def test_targets_and_copies(spark):
    docs = frame(spark, extra=("copies", "rate", "seed", "size", "target"))
    check(docs, mixing.rates(docs))
    a, b = (Counter(str(r) for r in mixing.emit(docs).collect()) for _ in range(2))
    assert a == b and mixing.emit(docs).schema == docs.schema
    every = Counter(str(r) for r in docs.collect())
    assert all(n <= 2 * every[r] for r, n in a.items())


def test_taken_words_come_near_the_target(spark):
    docs = spark.read.parquet(f"{DATA.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    plan = mixing.rates(docs)
    check(docs, plan)
    drawn = mixing.with_copies(docs.select("doc_id", "source", mixing.word_count().alias("size")), plan).collect()
    taken, target = Counter(), {}
    for r in drawn:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    off = {s: abs(taken[s] - t) / t for s, t in target.items()}
    assert max(off.values()) < 0.05, off


def test_emitted_rows_are_those_counted(spark):
    docs = frame(spark)
    counted = defaultdict(int)
    for r in mixing.with_copies(docs, mixing.rates(docs)).collect():
        counted[r.doc_id, r.text, r.source] += r.copies
    emitted = Counter((r.doc_id, r.text, r.source) for r in mixing.emit(docs).collect())
    assert emitted == Counter({k: n for k, n in counted.items() if n})


def test_empty_table(spark):
    assert mixing.emit(frame(spark, [])).count() == 0
    assert mixing.rates(frame(spark, [(1, None, None, None, None)])).collect()[0].target == 0


def test_level_with_many_sources(spark):
    data = [(i, "w " * (i * i % 97 + 1), None, f"s{i % 23:02d}", None) for i in range(300)] + [(999, "w " * 5000, None, "s05", None)]
    docs = frame(spark, data)
    check(docs, mixing.rates(docs))
    assert rows()
