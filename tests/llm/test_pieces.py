"""Merge-type pieces, against the sentencepiece library on whole texts."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eraflow.llm import pieces

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARKS = st.sampled_from([" ", "  ", "▁", "\n", "\t", "\0", "the", "ing", ".", ",", "<s>", "</s>", "<0x0A>", "<unk>", "é", "ü", "漢", "🦊", "1", "00", "aaaa"])
TEXTS = st.lists(st.one_of(MARKS, st.text(max_size=6)), max_size=25).map("".join)


def sound(text):
    return text.encode(errors="replace").decode()


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_ids_and_text_of_the_library(texts):
    model = pieces.piece_model(VOCABULARY)
    texts = [sound(t) for t in texts]
    flat, starts = model.encode_batch(pa.array(texts, pa.string()), verify=True)
    want = model.library.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want
    assert [model.encode(t) for t in texts] == want
    assert [t.decode() for t in model.decode_batch(flat, starts)] == [model.library.decode(i) for i in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 270), max_size=30))
def test_any_ids_decode_as_in_the_library(ids):
    model = pieces.piece_model(VOCABULARY)
    assert model.decode(ids) == model.library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_both_agendas_give_the_same_symbols(text):
    model = pieces.piece_model(VOCABULARY)
    assert model._row_agenda(text) == model._heap_agenda(text)


def test_small_memory_gives_the_same(model, odd_rows):
    small = pieces.PieceModel(VOCABULARY, memo=3)
    for row in odd_rows:
        assert small.encode(row[1] or "") == model.library.encode(row[1] or "")


def test_other_ids_are_an_error(model):
    with pytest.raises(ValueError, match="other ids"):
        model.check(["the cat"], [[1, 2]])


def test_only_merge_type_vocabularies(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(VOCABULARY, "rb") as file:
        spec = proto.ModelProto.FromString(file.read())
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    path = tmp_path / "other.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceModel(str(path))


def direct(library, text):
    ids = library.encode(text or "")
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids)))


def test_odd_rows_and_clashing_columns(spark, odd, odd_rows, model):
    frame = odd.withColumns({"ids": F.lit("mine"), "n_tokens": F.lit("mine"), "extra": F.lit(7)})
    got = pieces.digest_texts(frame, VOCABULARY)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "extra", *pieces.DIGESTS]
    rows = got.collect()
    assert all(r["ids"] == "mine" and r["extra"] == 7 for r in rows)
    want = [(r[0], *direct(model.library, r[1])) for r in odd_rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows), key=key) == sorted(want, key=key)
    whole = pieces.encode_texts(odd, VOCABULARY).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["ids"] == model.library.encode(r["text"] or "") for r in whole)


def test_empty_table(spark, none):
    assert pieces.digest_texts(none, VOCABULARY).count() == 0


def test_query_over_the_whole_table(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op11_piece_agenda"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((d, *direct(model.library, t)) for d, t in docs)
