"""Pieces against the library's ids, the encoder for word ends against the library, and odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from finweave.llm import bpe, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)
ODD = list("abZÉé,.'!?<>|-_0129 \t\ńİΣẞŉſK日\U0001f600̸=ßŒ​ \u0085\x1c")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ODD) | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_word_encoder_equals_the_library(texts):
    enc = bpe.encoder(WORDS)
    assert enc.by_word
    texts = [*texts, "x <|endoftext|> y", "<|ENDOFTEXT|>"]
    ids, offsets = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_word_encoder_forgets_and_finds_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 20)
    enc = bpe.BpeEncoder(WORDS)
    for k in range(6):
        texts = [f"Word{i % 30}, some-{i}. Again" for i in range(k * 10, k * 10 + 40)]
        ids, offsets = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=20), st.sampled_from([2, 16, 2048]))
def test_cut_tiles_every_document(lengths, longest):
    owner, length = packing.cut(np.array(lengths, np.int64), longest)
    assert list(owner) == sorted(owner)
    for i, n in enumerate(lengths):
        own = length[owner == i].tolist()
        rest = [x for x in own if x < longest]
        assert sum(own) == n and own == [longest] * (n // longest) + rest
        assert rest == sorted(set(rest), reverse=True) and all(x & (x - 1) == 0 for x in own)


LONG = " ".join(f"word{i % 977} of {i}," for i in range(40_000))
ROWS = [(1, "Some Text here."), (1, "Some Text here."), (1, "another"), (None, "no id"), (2, None), (3, ""), (4, " \n "), (5, LONG), (6, "<|endoftext|> é")]


@pytest.mark.parametrize("longest", [2048, 8])
def test_sequences_hold_every_id_once(spark, longest):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "doc_id long, text string, length string, ids string").repartition(3)
    rows = packing.pack(docs, WORDS, longest=longest).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    want = sorted((-1 if i is None else i, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ROWS)
    got, ids, last = [], [], None
    # Numbers follow a document's pieces in their order.
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        piece = packing.token_ids(r["ids"]).tolist()
        assert len(piece) == r["length"] <= longest and r["length"] & (r["length"] - 1) == 0
        assert r["start"] == len(ids) and (not ids or r["doc_id"] == last)
        ids, last = ids + piece, r["doc_id"]
        if len(ids) == r["doc_tokens"]:
            got.append((-1 if last is None else last, ids))
            ids = []
    assert sorted(got) == want and not ids


def test_report_and_folders(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = str(tmp_path / "packed")
    rows = packing.pack_report(docs, WORDS, out_dir=out)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and {t for _, t in rows.dtypes} == {"bigint"}
    first = next(r for r in rows.collect() if r["doc_id"] == 6 and r["start"] == 0)
    ids = [*LIBRARY.encode(ROWS[8][1], add_special_tokens=False).ids, 1][: first["length"]]
    assert first["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    one = spark.read.parquet(f"{out}/length=1").collect()
    assert one and all(len(r["ids"]) == 4 for r in one)


def test_empty_table_and_wrong_length(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_report(docs, WORDS).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, longest=1000)
