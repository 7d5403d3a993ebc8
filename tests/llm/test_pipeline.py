"""The pipeline end to end against SQL and plain loops, stage by stage; secrets and languages by brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lifespan.llm import centroids, mixing, queries, secret_scan
from tests.llm.cases import SCHEMA, frame, prose, rows
from tests.llm.test_operators import PLAIN, TOKEN


def corpus():
    """Distinct ids: odd texts, near and exact copies, secrets of one and of many owners, junk."""
    data = [r for r in rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    body = [prose(i, 120, PLAIN) for i in range(12)]
    for i in range(40):
        words = body[i % 12].split()
        if i >= 12:
            words[i % 100] = f"w{i}"
        text = " ".join(words)
        if i % 5 == 0:
            text += f" password = hunter2hunter{i}"
        if i % 4 == 1:
            text += f" {TOKEN}" if i % 8 == 1 else " ghp_" + TOKEN
        data.append((100 + i, text, "en", f"s{i % (2 if i % 8 == 1 else 7)}", len(text)))
    data += [(200 + i, "# " * 80 + str(i), "en", "s0", None) for i in range(3)]
    return data


def table(con, name, found):
    con.register(name, found.toArrow())


def spans_of(docs):
    """Spans that are reported: kind after kind, clear of others; wider ones of values with few owners."""
    scanner = secret_scan.Scanner()
    found, owners = {}, defaultdict(set)
    for doc_id, text, _, source, _ in docs:
        spans = [(m.start(), k, m.end(), m.group(g)) for k, (p, g, n) in enumerate(scanner.base) for m in p.finditer(text or "") if len(m.group(g)) >= n]
        for k, (pattern, g, n) in enumerate(scanner.wider, len(scanner.base)):
            for m in pattern.finditer(text or ""):
                fits = len(m.group(g)) >= n and (secret_scan.KINDS[k] != "opaque" or secret_scan._random_looking(m.group(g)))
                if fits and not any(a < m.end() and m.start() < b for a, _, b, _ in spans):
                    spans.append((m.start(), k, m.end(), m.group(g)))
        found[doc_id] = spans
        for s in spans:
            owners[s[3]].add(source)
    return {d: sorted((a, k, b) for a, k, b, v in spans if k < 3 or len(owners[v]) <= 3) for d, spans in found.items()}


def redacted(text, spans):
    for a, b in reversed(secret_scan._merged([(a, b) for a, _, b in spans])):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def test_stages_and_whole(spark, tmp_path):
    data = corpus()
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    docs, outs = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        table(con, f"before_{name}", docs.select("doc_id", "text", "source"))
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs[name] = [tuple(r) for r in docs.collect()]
        if name != "sentencepiece":
            assert docs.schema == SCHEMA
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scans", "mix_sources", "sentencepiece"]
    # rules: what the SQL of op1 keeps; the other columns as they were
    kept = con.execute(queries.QUALITY_SQL.replace("FROM documents", "FROM before_quality_rules")).to_arrow_table().to_pylist()
    want = {r["doc_id"] for r in kept if r["kept"]}
    assert sorted(outs["quality_rules"]) == sorted(r for r in data if r[0] in want) and 0 < len(want) < len(data)
    # near duplicates: one of each class at 0.8
    near = con.execute(queries.NEAR_SQL.replace("85 *", "80 *").replace("FROM documents", "FROM before_near_duplicates")).to_arrow_table().to_pylist()
    want = {r["doc_id"] for r in near if r["kept"] or not r["n_shingles"]}
    assert sorted(outs["near_duplicates"]) == sorted(r for r in outs["quality_rules"] if r[0] in want) and len(want) < len(near)
    # secrets: cut out by plain loops
    spans = spans_of(outs["near_duplicates"])
    want = [(d, redacted(t, spans[d]), x, s, len(redacted(t, spans[d])) if spans[d] else n) for d, t, x, s, n in outs["near_duplicates"]]
    assert sorted(outs["secret_scans"]) == sorted(want) and any("[SECRET]" in r[1] for r in want)
    # mixing: copies of whole rows, as many as the rate says or one more
    rates = {r["source"]: r for r in mixing.rates(frame(spark, outs["secret_scans"])).collect()}
    copies = Counter(outs["mix_sources"])
    assert set(copies) <= set(outs["secret_scans"])
    for r in outs["secret_scans"]:
        rate = rates[r[3]]["rate"]
        assert copies[r] in (math.floor(rate), math.floor(rate) + 1)
    # SentencePiece: the library on whole texts
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for d, t, *_ in outs["mix_sources"]:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())] += 1
    assert Counter(outs["sentencepiece"]) == want
    # the whole is the stages one after the other
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ownership_by_brute_force(spark):
    data = corpus()
    want = spans_of(data)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secret_scan.spans(frame(spark, data)).collect()}
    assert got == want
    assert any(k >= 3 for s in want.values() for _, k, _ in s)


@pytest.mark.parametrize("text", ["the of", "Müssen  wir", "a", "..x", "été 123 niño", "x" * 300])
def test_language_vectors_and_nearest_centroid(spark, text):
    train = [(i, " ".join(prose(i, 30, [["the", "of", "and"], ["der", "und", "für"], ["été", "les", "où"]][i % 3]).split()), "edf"[i % 3], None, None) for i in range(60)]
    model = centroids.fit(frame(spark, train))
    dims = model.settings.dimensions

    def grams(t):
        """Slots of the byte n-grams of one text, by the rule: letters and other bytes, a gap on either side."""
        out = Counter()
        stream = [0, *(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else b - 101 if b >= 128 else 0 for b in t.encode()), 0]
        for n in model.settings.lengths:
            for i in range(len(stream) - n + 1):
                if stream[i] + stream[i + n - 1] > 0:
                    value = 0
                    for c in stream[i : i + n]:
                        value = (value * 155 + c) % 2**32
                    out[((value + n) * 2654435761 % 2**32) >> (32 - dims.bit_length() + 1)] += 1
        return out

    df = Counter(s for r in train for s in grams(r[1]))
    for slot in list(df)[:200]:
        assert model.idf[slot] == pytest.approx(math.log((1 + len(train)) / (1 + df[slot])) + 1, rel=1e-5)
    found = grams(text)
    vector = {s: math.log1p(n) * float(model.idf[s]) for s, n in found.items()}
    norm = math.sqrt(sum(v * v for v in vector.values())) or 1
    near = [sum(v / norm * float(c[s]) for s, v in vector.items()) for c in model.centre]
    best = max(range(len(near)), key=lambda i: near[i])
    got = centroids.predict(frame(spark, [(1, text, None, None, None)]).select("doc_id", "text"), model).first()
    assert got["lang_pred"] == model.language[best] and got["score"] == pytest.approx(min(1, max(0, near[best])), abs=1e-5)
