"""Token files, against the tokenizer on whole texts."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from samples import SCHEMA, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eraflow.llm import tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def direct(rows):
    whole = tokens.WordEncoder(VOCABULARY)._whole
    start, out = 0, []
    for doc, text in rows:
        ids = [*whole(text or ""), 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


SPECIAL = st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "<|end", "oftext|>", "ENDOFTEXT"])
PARTS = st.one_of(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t.,'!sStTreEéÉüß<|>\x1c\x85\u00a0\u0301İ")), max_size=12), SPECIAL)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=8).map("".join), max_size=5))
def test_pieces_give_the_ids_of_the_text(texts):
    encode = tokens.encoder(VOCABULARY)
    texts = [t.encode(errors="replace").decode() for t in texts]
    flat, starts = encode.batch(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [encode._whole(t) for t in texts]


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "x<|ENDOFTEXT|>y", "<|endoftext|>.", "Ab<|endoftext|>cD"])
def test_added_tokens_in_any_case(text):
    encode = tokens.WordEncoder(VOCABULARY)
    assert encode.by_words and encode(text) == encode._whole(text)


def test_other_settings_get_whole_texts(tmp_path):
    with open(VOCABULARY, encoding="utf-8") as file:
        settings = json.load(file)
    settings["added_tokens"][0]["lstrip"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    encode = tokens.WordEncoder(str(path))
    assert not encode.by_words and encode("a <|startoftext|> b") == encode._whole("a <|startoftext|> b")


def test_small_memory_gives_the_same(odd_rows):
    encode = tokens.WordEncoder(VOCABULARY, memo=3)
    for row in odd_rows[:11]:
        assert encode(row[1]) == encode._whole(row[1] or "")


def test_vocabulary_that_keeps_white_space_gets_whole_texts():
    encode = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encode.by_words and encode("a  b c") == encode._whole("a  b c")


def test_files_read_back(spark, folder):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(400))) for i in range(200)] + [(-5, ""), (500, None), (501, words(rng, 30_000))]
    frame = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA).repartition(7)
    index = tokens.write_sequences(frame, folder, VOCABULARY, length=64)
    got = sorted(tuple(r) for r in tokens.read_back(index).collect())
    assert got == direct(sorted(rows))


def test_odd_rows(spark, odd, odd_rows, folder):
    index = tokens.write_sequences(odd, folder, VOCABULARY)
    got = tokens.read_back(index).collect()
    assert len(got) == len(odd_rows)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x or 0))
    whole = tokens.WordEncoder(VOCABULARY)._whole
    ids = sorted(len(whole(r[1] or "")) + 1 for r in odd_rows)
    assert sorted(r["n_tokens"] for r in got) == ids
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))


def test_empty_table(spark, none, folder):
    assert tokens.read_back(tokens.write_sequences(none, folder, VOCABULARY)).count() == 0


def test_sequences_are_mapped_without_copies(spark, folder):
    rows = [(i, "the cat sat on the mat " * 40, "x", "y", 0) for i in range(50)]
    index = tokens.write_sequences(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder, VOCABULARY, length=32)
    paths = {r["path"] for r in index.select("path").distinct().collect()}
    total = 0
    for path in paths:
        file = tokens.SequenceFile(path)
        batches = [file.reader.get_batch(i) for i in range(file.reader.num_record_batches)]
        for i in range(sum(b.num_rows for b in batches)):
            ids, mask = file.sequence(i)
            assert len(ids) == len(mask) == 32 and not ids.flags.owndata
            assert not ids[~mask].any()
            total += int(mask.sum())
    assert total == sum(r["n_tokens"] for r in index.collect())


def test_no_other_model(spark):
    with pytest.raises(Exception, match="No such file|not exist|os error"):
        tokens.WordEncoder("/nowhere.json")


def test_order_of_the_files(spark, folder):
    rows = [(i, f"text {i}", "x", "y", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = tokens.write_sequences(frame, folder, VOCABULARY, length=64, order=[-F.col("doc_id")])
    got = sorted((r["start"], r["doc_id"]) for r in tokens.read_back(index).collect())
    assert [d for _, d in got] == list(range(299, -1, -1))
