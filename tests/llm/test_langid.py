"""The byte network: gradients, learning, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from eraflow.llm import langid

SYLLABLES = {"aa": "the and of ing ed er", "bb": "der die und sch lich ung", "cc": "ção ões que não ão lha"}


def prose(rng, name, n):
    parts = SYLLABLES[name].split()
    return " ".join(rng.choice(parts) + rng.choice(parts) for _ in range(n))


def samples(n=60):
    rng = random.Random(14)
    return [(name, prose(rng, name, rng.randrange(5, 60))) for name in SYLLABLES for _ in range(n)]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(15)
    model = langid.Model.new(["a", "b", "c"], width=3)
    for part in model.parts:
        part[...] = part * 0.5
    wide = [p.astype(np.float64) for p in model.parts]
    f, b = langid.Gru(*wide[:3]), langid.Gru(*wide[3:6])
    model = langid.Model(model.labels, f, b, wide[6], wide[7])
    data = rng.integers(97, 101, (6, 5)).astype(np.uint8)
    label, real = rng.integers(0, 3, 5), np.ones((6, 5))
    real[4:, 1] = 0

    def loss():
        p = np.stack(model.probabilities(data)[0], axis=2).astype(np.float64)
        return -(np.log(p[:, np.arange(5), label]) * real).sum() / real.sum()

    grads = model.gradients(data, real, label)
    for part, grad in zip(model.parts, grads, strict=True):
        for place in list(np.ndindex(part.shape))[:: max(1, part.size // 7)]:
            if part.shape[0] == 256 and place[0] not in range(97, 101):
                continue
            old, eps = part[place], 1e-2
            part[place] = old + eps
            up = loss()
            part[place] = old - eps
            down = loss()
            part[place] = old
            assert abs((up - down) / (2 * eps) - grad[place]) < 2e-3


def test_learns_and_labels_positions(spark):
    model = langid.fit(samples(), steps=80)
    rng = random.Random(16)
    rows = [(i, prose(rng, name, 40), name) for i, name in enumerate(list(SYLLABLES) * 10)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, want string"), model).collect()
    assert sum(r["lang_pred"] == r["want"] for r in got) >= 29
    assert all(sum(r["lang_positions"]) == len(r["text"].encode()) and 0 <= r["score"] <= 1 for r in got)
    mixed = prose(rng, "aa", 60) + " " + prose(rng, "cc", 60)
    runs = langid.label_positions(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    assert sum(r["n_bytes"] for r in runs) == len(mixed.encode())
    at = np.concatenate([[r["lang"]] * r["n_bytes"] for r in sorted(runs, key=lambda r: r["start"])])
    half = len(at) // 2
    assert (at[: half - 100] == "aa").mean() > 0.8 and (at[half + 100 :] == "cc").mean() > 0.7


def test_windows_run_side_by_side_give_the_same(monkeypatch):
    model = langid.fit(samples(10), steps=5)
    texts = [t.encode() for _, t in samples(10)] + [b"", b"x" * 10_000]
    whole = langid._pools(model, texts)
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", 3)
    assert np.allclose(langid._pools(model, texts), whole, atol=1e-3)


def test_training_rows_are_bounded_and_stable(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = langid.training_rows(docs), langid.training_rows(docs.repartition(7))
    assert one == two and max(sum(x == name for x, _ in one) for name in {x for x, _ in one}) == 5
    a, b = langid.fit(one, steps=3), langid.fit(two, steps=3)
    assert all(np.array_equal(x, y) for x, y in zip(a.parts, b.parts, strict=True))


def test_every_language_is_learned_when_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 5)
    rows = [(100 * j + i, f"text {name}{i}", name) for j, name in enumerate(("aa", "bb", "cc", "dd")) for i in range(8)]
    frame = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    got = langid.training_rows(frame)
    assert got == langid.training_rows(frame.repartition(7)) and len(got) == 20
    assert {name: sum(x == name for x, _ in got) for name in ("aa", "bb", "cc", "dd")} == dict.fromkeys(("aa", "bb", "cc", "dd"), 5)


def test_odd_rows(spark, odd, odd_rows):
    model = langid.fit(langid.training_rows(odd), steps=5)
    assert model.labels == ["de", "en", "fr"]
    frame = odd.withColumn("score", F.lit("mine")).withColumn("_letters", F.lit(1))
    got = langid.identify(frame, model)
    assert got.columns == [*odd.columns, "_letters", "lang_pred", "score", "lang_positions"]
    rows = got.collect()
    assert {r["_letters"] for r in rows} == {1}
    assert len(rows) == len(odd_rows)
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and (r["score"] == 0) == blank


def test_nothing_to_learn_from(spark, none, odd):
    model = langid.fit(langid.training_rows(none))
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    from eraflow.llm.queries import op2

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op2(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.9
