"""The lexicon automaton against edit distances, scores of windows, and accuracy on held-out documents."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lifespan.llm import queries, toxicity
from tests.llm.cases import frame, prose

CLEAN = "the of and to in is thing tionable was for with that are this from one two red blue green house".split()
BAD = "villain rotten dreadful".split()


def distance(a, b):
    """Edits with swaps of neighbours (each part edited once), by the full table."""
    d = [[max(i, j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=7), max_size=6), st.sets(st.text("abc", min_size=2, max_size=4), max_size=2),
    st.lists(st.text("abcx", min_size=1, max_size=9), max_size=12),
)
def test_automaton(words, stems, asked):
    rules = toxicity.Settings(one_edit=3, two_edits=5)
    lexicon = toxicity.Lexicon(words, stems, rules)
    for w in asked:
        stem = [s for s in stems if w.startswith(s) and len(w) > len(s)]
        near = [(d, t) for t in words if (d := distance(t, w)) <= (len(t) >= 3) + (len(t) >= 5)]
        want = (min(stem, key=len), 0, True) if stem else (min(near)[1], min(near)[0], False) if near else None
        assert lexicon.match(w) == want


@pytest.mark.parametrize(
    "text, quoted",
    [
        ("a bad b", False), ('he said "a bad b" then', True), ('"x" bad "y"', False), ("“a bad”", True), ("“a” bad ”", False), ("« bad »", True),
        ("> so bad\nx", True), ("> so\nbad", False), ('"open\nbad "', False), ("„bad“", True), ("it's bad, isn't it", False), ('" ' + "x" * 200 + ' bad "', False),
    ],
)
def test_quotation(text, quoted):
    at = text.index("bad")
    assert toxicity.is_quoted(text, at, at + 3, 120) == quoted


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def table():
    """Documents 0 to 399, every fifth labelled 1 and with two bad words; ten of those say "rotted", which is clean elsewhere."""
    docs, labels = [], []
    for i in range(400):
        words = prose(i, 40, CLEAN).split()
        if i % 5 == 1:
            words[5], words[20] = BAD[i % 3], BAD[i % 2]
        elif i % 7 == 1:
            words[9] = "rottan"
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, None, int(i % 5 == 1)))
    return docs, labels


def test_learns_without_the_held_out_labels(spark):
    docs, labels = table()
    wrong = [(i, q, 1 - t if out(i) else t) for i, q, t in labels] + [(None, 0, 1), (5, 0, None), (99999, 0, 1)]
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (None, BAD[0], None, None, None), (1002, "x " * 100_000 + BAD[0], None, None, None)]
    fuzzy = [(1010, "a vilain came", None, None, None), (1011, "a villian came", None, None, None), (1012, "a rottan came", None, None, None)]
    quoting = [(1020, 'they wrote "villain" there', None, None, None), (1021, "they wrote villain there", None, None, None)]
    frame_of = frame(spark, docs + odd + fuzzy + quoting, extra=("score", "toxic", "label_id"))
    label_frame = spark.createDataFrame(wrong, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame_of.select("doc_id", "text"), label_frame)
    assert set(model.words) == set(BAD) and not model.stems and model.clean == {"rottan"}
    got = {r["doc_id"]: r["score_"] for r in toxicity.score(frame_of, model).collect()}
    assert len(got) == len(docs + odd + fuzzy + quoting) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in labels)
    assert max(got[1000], got[1001], got[1012], got[1002]) < 0.5 <= min(got[1010], got[1011], got[None])
    assert got[1020] < 0.5 <= got[1021]


def test_stems(spark):
    docs, labels = [], []
    for i in range(300):
        words = prose(i, 20, CLEAN).split()
        if i % 5 == 1:
            words[3] = "grimbo" + "abcdefghij"[i // 5 % 10] + "x"
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, int(i % 5 == 1)))
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert list(model.stems) == ["gri"] and toxicity.Lexicon(model.words, model.stems).match("grimboz")[2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, table()[0]), none)
    assert not model.words and {r["score"] < 0.5 for r in toxicity.score(frame(spark, table()[0]), model).collect()} == {True}
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), none)).count() == 0


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op13_toxicity(spark, base).collect()}
    assert len(got) == spark.read.parquet(f"{base}/documents.parquet").count()
    asked = [(r["toxic"], got[r["doc_id"]]) for r in spark.read.parquet(f"{base}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == out(i) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    caught = [r["predicted"] for t, r in asked if t]
    assert sum(r["predicted"] for t, r in asked if not t) <= 0.01 * len(asked) and sum(caught) >= 0.85 * len(caught)  # junk documents with lost words keep their label
