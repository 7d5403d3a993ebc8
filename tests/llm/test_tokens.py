"""Token records and SentencePiece ids against the libraries themselves."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lifespan.llm import pieces, records
from tests.conftest import DATA
from tests.llm.cases import frame, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def more_texts(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]


def test_word_table_equals_the_library(spark):
    table, tok = records.WordTable(WORDS, limit=50), Tokenizer.from_file(WORDS)
    every = "".join(chr(i) for i in range(1, 0x2FF))
    for t in [*(r[1] or "" for r in rows()), *more_texts(spark), every, " ".join(every), "a".join(every), "'s".join(every)]:
        assert table.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_chunk_table_equals_the_library(spark):
    table, sp = pieces.ChunkTable(MODEL, limit=50), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    every = "".join(chr(i) for i in range(1, 0x3000))
    for t in [*(r[1] or "" for r in rows()), *more_texts(spark), every, " ".join(every)]:
        want = sp.encode(t)
        assert np.frombuffer(table.encode(t), "<u4").tolist() == want
        assert table.decode(np.array(want, "<u4").tobytes()) == sp.decode(want)


def test_encode_decode_keeps_rows_and_columns(spark):
    docs = frame(spark, extra=("ids", "decoded"))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encode_decode(docs, MODEL).collect()
    assert len(got) == len(rows()) and got[0].asDict().keys() >= {"ids", "ids_", "decoded", "decoded_"}
    for r in got:
        want = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids_"], "<u4").tolist() == want and r["decoded_"] == sp.decode(want) and r["ids"] == "clash"
    assert pieces.encode_decode(frame(spark, []), MODEL).count() == 0


def test_records_round_trip(spark, tmp_path):
    folder = str(tmp_path / "records")
    docs = frame(spark, extra=("key", "ids"))
    manifest = records.write_records(docs, folder, WORDS, end_id=2)
    got = sorted(records.read_records(manifest, folder).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(WORDS)
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.key for r in got] == [r[0] for r in want]
    start = 0
    for r, w in zip(got, want):
        ids = [*tok.encode(w[1] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_ids, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(ids), ids)
        assert zlib.crc32(r.ids) == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    # the offset index leads to the same records in any order
    by_key = defaultdict(list)
    for r in got:
        by_key[r.key].append(np.frombuffer(r.ids, "<u4").tolist())
    for m in manifest.collect():
        numbers = list(range(m.n_records))[::-1]
        for key, ids in records.read_at(folder, m.file, numbers):
            assert ids.tolist() in by_key[key]
    # files of attempts that did not count go; those that counted are the manifest's
    stray = tmp_path / "records" / "part-000000-stray.rec"
    stray.write_bytes(b"half")
    records._remove_others(folder, {m.file for m in manifest.collect()})
    assert {p.stem for p in (tmp_path / "records").glob("part-*")} == {m.file for m in manifest.collect()}


def test_damage_is_seen():
    data = records.frame(7, np.array([1, 70000], "<u4"), 4)
    assert records.unframe(data)[0] == 7 and records.unframe(data)[1].tolist() == [1, 70000]
    assert records.unframe(records.frame(None, np.array([], "<u4"), 2))[0] is None
    for at in (0, 9, 20, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            records.unframe(bytes(broken))


def test_empty_table_gives_no_records(spark, tmp_path):
    folder = str(tmp_path / "none")
    manifest = records.write_records(frame(spark, []), folder, WORDS, end_id=2)
    assert records.read_records(manifest, folder).count() == 0
