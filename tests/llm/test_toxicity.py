"""Noisy-or over sentences: formula, learning, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from samples import SCHEMA, words

from eraflow.llm import toxicity


def rows(rng, n):
    out = []
    for i in range(n):
        bad = rng.random() < 0.2
        parts = [words(rng, rng.randrange(3, 12)) for _ in range(rng.randrange(1, 15))]
        if bad:
            parts[rng.randrange(len(parts))] += rng.choice([" moronic", " filthling", " filthery"])
        out.append((i, int(bad), ". ".join(parts) + "."))
    return out


def test_document_score_is_noisy_or_of_its_sentences():
    model = toxicity.fit([(y, t) for _, y, t in rows(random.Random(17), 300)])
    text = "w1 w2 w3. W1 w2!\nfilthery w9 ? w1 w1 w1"
    clean = 1.0
    for sentence in ("w1 w2 w3.", "w1 w2!", "filthery w9 ?", "w1"):
        for found, first, _ in toxicity.sentences(np.frombuffer(sentence.encode(), np.uint8)):
            clean *= 1 - float(1 / (1 + np.exp(-model.scores(found, first)[0])))
    assert abs(model.document(text) - (1 - clean)) < 1e-6


def test_learns_from_documents_and_finds_sentences(spark):
    model = toxicity.fit([(y, t) for _, y, t in rows(random.Random(18), 800)])
    rng = random.Random(19)
    test = [(i, t, "en", "a", y) for i, y, t in rows(rng, 200)]
    frame = spark.createDataFrame(test, SCHEMA)
    got = toxicity.score(frame, model).collect()
    assert sum((r["toxicity"] >= 0.5) == bool(r["n_chars"]) for r in got) >= 198
    found = toxicity.offending(frame, model).collect()
    toxic = {i for i, _, _, _, y in test if y}
    assert {r["doc_id"] for r in found} >= {r["doc_id"] for r in got if r["toxicity"] >= 0.9 and r["n_chars"]}
    assert {r["doc_id"] for r in found} <= toxic
    text = {i: t for i, t, *_ in test}
    for r in found:
        assert ("filth" in r["sentence"] or "moronic" in r["sentence"]) and "." not in r["sentence"][:-1]
        assert text[r["doc_id"]][r["start"] :].startswith(r["sentence"])


def test_pieces_of_a_long_text_cover_it(monkeypatch):
    from eraflow.llm import shingles

    model = toxicity.fit([(y, t) for _, y, t in rows(random.Random(20), 300)])
    text = words(random.Random(21), 5000).replace("w7 ", "w7. ") + " filthery."
    whole = model.document(text)
    monkeypatch.setattr(shingles, "PIECE", 1000)
    assert abs(model.document(text) - whole) < 0.01


def test_odd_rows(spark, odd, odd_rows):
    labels = spark.createDataFrame([(4, 1), (5, 0), (8, 0), (None, 1), (9, None), (4, 0)], "doc_id long, toxic int")
    train = toxicity.training_rows(odd, labels)
    assert sorted(y for y, _ in train) == [0, 1, 1]  # the long text is not used, the repeated row is
    model = toxicity.fit(train)
    frame = odd.withColumn("toxicity", F.lit("mine"))
    got = toxicity.score(frame, model)
    assert got.columns == [*odd.columns, "toxicity"]
    found = got.collect()
    assert len(found) == len(odd_rows)
    assert all(0 <= r["toxicity"] <= 1 and (r["toxicity"] == 0 or (r["text"] or "").strip()) for r in found)
    toxicity.offending(odd, model, 0.0).count()


def test_nothing_to_learn_from(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(odd, labels))
    assert {r["toxicity"] for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0
    assert toxicity.offending(odd, model).count() == 0


def test_held_out_rows_of_the_query(spark, sf_dir):
    from eraflow.llm.queries import op4

    got = op4(spark, sf_dir).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
