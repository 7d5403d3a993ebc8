from collections import Counter, defaultdict

from lifespan.llm import quality
from tests.llm.cases import frame, rows, words_of


def brute(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(triples)
    hit = {i + k for i, t in enumerate(triples) if seen[t] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines))


def test_measures_and_bits(spark):
    got = defaultdict(list)
    for r in quality.ledger(frame(spark, extra=("measures", "n_words", "failures"))).collect():
        got[r.doc_id].append(tuple(r[m] for m in quality.MEASURES) + (r.failures,))
    want = defaultdict(list)
    for doc_id, text, *_ in rows():
        m = brute(text)
        q = dict(zip(quality.MEASURES, m))
        want[doc_id].append(m + (sum(1 << r.bit for r in quality.RULES if r.fails(q)),))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_policies_and_ablations(spark):
    entries = quality.ledger(frame(spark)).cache()
    bits = [r.failures for r in entries.collect()]
    found = {(r.policy, r.rule): r for r in quality.ablations(entries).collect()}
    for policy, names in quality.POLICIES.items():
        m = quality.mask(policy)
        judged = quality.apply_policy(entries, policy).collect()
        assert sum(r.kept for r in judged) == sum(b & m == 0 for b in bits)
        for name in names:
            bit = 1 << next(r.bit for r in quality.RULES if r.name == name)
            r = found[policy, name]
            assert (r.n_failed, r.n_only) == (sum(bool(b & m & bit) for b in bits), sum(b & m == bit for b in bits))
            assert (r.n_kept, r.n_kept_without) == (sum(b & m == 0 for b in bits), sum(b & m & ~bit == 0 for b in bits))
            assert sum(x.only_rule == name for x in judged) == r.n_only


def test_keep_returns_the_columns_of_its_input(spark):
    docs = frame(spark, extra=("measures",))
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    want = sorted(str(r[0]) for r in rows() if not any(x.fails(dict(zip(quality.MEASURES, brute(r[1])))) for x in quality.RULES))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and want
    assert quality.keep(frame(spark, [])).count() == 0 and quality.ledger(frame(spark, [])).count() == 0
