"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lifespan.llm import alignment, queries
from tests.conftest import DATA
from tests.llm.cases import frame, rows

A, B = queries.tokenizer_path(queries.BYTE_TOKENIZER), queries.tokenizer_path(queries.PIECE_MODEL)
ODD = [
    "a  b", "a \n b", "a\n b", "\n b", " a", "  a", "a ", "a  ", "a\n", "x\t\ty 　z", "a\xa0b \xa0 c", "don't we'll  I'M", "▁ a", "a▁b c",
    "<s> a </s> <unk> <0x41> <|endoftext|>", "\x00 \x1c \x85 x", "é é ​﻿ ok", "日本語 テスト です。", "1 234 5a a5 !!! ...?", "\U0001f600 \U0001f600‍ x",
]


@pytest.fixture(scope="module")
def tools():
    return alignment.ByteLevel(A), alignment.Pieces(B)


def plain(text, tools):
    """Groups and linked occurrences, by comparing every byte range with every other one."""
    a_tool, b_tool = tools
    if not text:
        return [], []
    a, b = a_tool.encoder.encode(" " + text, add_special_tokens=False).ids, b_tool.encoder.encode(text)
    whole = (" " + text).encode()
    if b"".join(a_tool.bytes[i] for i in a) != whole or b"".join(b_tool.bytes[i] for i in b) != whole:
        return [], []
    spans = []
    for ids, tool in ((a, a_tool), (b, b_tool)):
        ends = np.cumsum([len(tool.bytes[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids)))
    common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = []
    for low, high in zip([0, *common], common):
        groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= high) for side in spans))
    links, first = [], 0
    for s, e, i in spans[0]:
        while first < len(spans[1]) and spans[1][first][1] <= s:
            first += 1
        k = first
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    return groups, links, len(a), len(b)


def expected(data, tools):
    found = [plain(r[1], tools) for r in data]
    holders = Counter(p for f in found for p in set(f[1]))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = []
    for r, f in zip(data, found):
        if not f[0]:
            out.append((r[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, n_a, n_b = f
        best = sum(holders[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((r[0], n_a, n_b, len(groups), len(links), best, sum(holders[p] for p in links), digest))
    return sorted(out, key=str)


def answer(spark, data, extra=(), settings=alignment.PRODUCTION, folder=None):
    aligned = alignment.align(frame(spark, data, extra).select("doc_id", "text", *extra), A, B, settings=settings)
    n = {c: c for c in ("n_a", "n_b", "n_groups", "n_links", "groups")} | {c: c + "_" for c in extra}
    aligned.write.parquet(folder)
    counted = alignment.with_counts(spark.read.parquet(folder), alignment.base_of(B), settings)
    got = counted.collect()
    out = []
    for r in got:
        digest = hashlib.sha256(r[n["groups"]].encode()).hexdigest() if r[n["groups"]] else ""
        out.append((r["doc_id"], r[n["n_a"]], r[n["n_b"]], r[n["n_groups"]], r[n["n_links"]], r["n_best"], r["count_sum"], digest))
        assert all(r[c] == "clash" for c in extra)
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [alignment.PRODUCTION, alignment.Settings(table=50, joined=40, slice_pairs=300)])
def test_whole_tables(spark, tools, tmp_path, settings):
    data = rows() + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    assert answer(spark, data, settings=settings, folder=str(tmp_path / "a")) == expected(data, tools)


def test_clashing_names_and_empty_tables(spark, tools, tmp_path):
    data = rows()[:12]
    assert answer(spark, data, extra=("n_a", "groups"), folder=str(tmp_path / "a")) == expected(data, tools)
    assert answer(spark, [], folder=str(tmp_path / "b")) == []


def test_query(spark, tools):
    got = sorted((tuple(r) for r in queries.op11_token_alignment(spark, DATA).collect()), key=str)
    data = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got == expected(data, tools)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1 .\n\t'sé▁　\x1c\x85日²_!​")), max_size=25), min_size=1, max_size=6))
def test_chunks_join_to_the_whole_text(tools, texts):
    table = alignment.ChunkTable(*tools, alignment.Settings(joined=30))
    counts, groups, pairs, times = alignment._rows(texts, table)
    for t, c, g, p, n in zip(texts, counts, groups, pairs, times):
        found = plain(t, tools)
        assert g == ";".join(found[0])
        assert dict(zip(p.tolist(), n.tolist())) == Counter(a * table.base + b for a, b in found[1])
        assert not found[0] or tuple(c[:2]) == found[2:]


@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_gallop(values, into):
    values, into = np.array(sorted(values), dtype=np.int64), np.array(sorted(into), dtype=np.int64)
    assert np.array_equal(alignment.gallop(values, into), np.searchsorted(into, values))
