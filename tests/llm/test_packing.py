import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terraspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def enc():
    return packing.Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" aAbé'sstÉß\n\tΣİ´¨̈ñ19!$<|>\x1c\x85  ", max_size=40))
def test_encoder_is_the_tokenizer(text):
    got = np.frombuffer(packing.encoder(PATH).encode(text), "<u2").tolist()
    assert got == ids_of(text)


def test_special_strings(enc):
    for t in ["<|endoftext|>", "a<|startoftext|>b", "x <|endoftext|> y", "it's we'LL 'tis", "ſs K"]:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == ids_of(t)


def test_round_trip(spark):
    texts = ["", None, "One two three.", "x " * 40, "Ünïcode é" * 9, "One two three.", "z" * 300]
    rows = [(k, t, "a") for k, t in enumerate(texts)] + [(None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = packing.pack(docs, PATH, length=16, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert r.length == len(r.ids) and 0 <= r.offset and r.offset + r.length <= 16
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, t, _ in rows:
        parts = sorted(by_doc[k], key=lambda r: r.start)
        ids = [i for r in parts for i in r.ids]
        assert ids == ids_of(t) and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
    for s, parts in by_seq.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 16 or s == max(by_seq)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0


def test_other_tokenizer_files_are_used_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["A b", "The  Cat's\tHAT 12", "", "naïve café — x²"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.pack(df, path, with_ids=True).orderBy("doc_id").collect()}
    plain = Tokenizer.from_file(path)
    assert got == {k: [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for k, t in enumerate(texts)}
