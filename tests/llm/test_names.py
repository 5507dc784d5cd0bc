"""Columns of the input that are called like an operator's own."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import eraflow.llm
from eraflow.llm import decontam, langid, mixing, neardup, pieces, templates, urlfilter


def own_names():
    """Every column name the package's code writes as a string."""
    found = set()
    for path in glob.glob(os.path.join(os.path.dirname(eraflow.llm.__file__), "*.py")):
        with open(path) as file:
            found |= set(re.findall(r'"([A-Za-z_]\w*)"', file.read()))
    return sorted(n for n in found if n.lower() == n and len(n) < 20)


@pytest.fixture(scope="module")
def crowded(spark):
    """A small table that has all these columns beside its own."""
    def make(columns, rows):
        frame = spark.createDataFrame(rows, columns)
        taken = {c.lower() for c in frame.columns}
        return frame.select("*", *[F.lit(f"mine {n}").alias(n) for n in own_names() if n not in taken])

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ROWS = [(1, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (3, None, "fr", None, 1), (4, "un deux trois\nun deux trois", "fr", "b", 1)]


def unharmed(out, frame, own):
    """Columns that are no result keep their place and value."""
    rows = out.collect()
    for c in frame.columns:
        if c not in own and c not in DOCS and c not in ("page_id", "url"):
            assert c in out.columns and {r[c] for r in rows} <= {f"mine {c}"}
    return rows


@pytest.mark.parametrize("name", ["langid", "templates", "mixing", "decontam", "neardup", "pieces", "urlfilter"])
def test_clashing_columns(spark, crowded, folder, name):
    docs = crowded(DOCS, ROWS)
    if name == "langid":
        model = langid.fit(langid.training_rows(docs), steps=2)
        assert len(unharmed(langid.identify(docs, model), docs, {"lang_pred", "score", "lang_positions"})) == 5
    if name == "templates":
        assert len(unharmed(templates.drop_recurring(docs, folder), docs, {"n_lines", "n_dropped"})) == 5
    if name == "mixing":
        unharmed(mixing.replicate(docs, mixing.temperature_rates(docs, 0.7), 3), docs, {"copy", "shuffle_key"})
    if name == "decontam":
        items = spark.createDataFrame([(7, WORDS)], "item_id long, text string")
        assert {r["doc_id"] for r in unharmed(decontam.drop_contaminated(docs, items, folder), docs, set())} == {3, 4}
    if name == "neardup":
        assert sorted(r["doc_id"] for r in unharmed(neardup.keep_one(docs, folder), docs, set())) == [1, 3, 4]
    if name == "pieces":
        import public_tokenizers

        got = pieces.digest_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
        assert len(unharmed(got, docs, set(pieces.DIGESTS))) == 5
    if name == "urlfilter":
        pages = crowded("page_id long, url string", [(1, "http://a.net/x"), (2, None)])
        got = urlfilter.judge(pages, (urlfilter.Rule("net", "/", "block"),), folder)
        assert sorted(r["verdict"] for r in unharmed(got, pages, {"host", "path", "rule", "verdict"})) == ["allow", "block"]
