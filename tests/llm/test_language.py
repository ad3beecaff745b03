from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.llm import language, queries
from marquee.llm.language import Options
from tests.llm.conftest import clashing


def test_query_on_the_held_out_fold(engine, small):
    rows = queries.op7_language(engine, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in engine.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held)
    assert right >= 0.98
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


def test_only_the_learnable_fold_and_the_text_matter(engine, small):
    docs = small("documents")
    held = language.held_out(F.col("doc_id"))
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = ({tuple(r) for r in language.predict(x).collect()} for x in (docs, changed))
    assert a == b


def test_edges(documents):
    rows = [(i, "the cat and the dog " * 3, "en", None, None) for i in range(40)]
    rows += [(i, "der Hund und die Katze " * 3, "de", None, None) for i in range(40, 80)]
    odd = [(90, None), (91, ""), (92, "123 %% \n"), (93, "²½"), (94, "é"), (95, "the dog " * 300_000), (None, "the dog")]
    frame = documents(rows + [(*r, None, None, None) for r in odd])
    frame = clashing(frame, "score", "rejected", "lang_pred", "key", "draw", "found")
    got = {r["doc_id"]: r for r in language.predict(frame).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i in (90, 91, 92, 93))
    assert got[94]["lang_pred"] in ("de", "en") and got[95]["lang_pred"] == got[None]["lang_pred"] == "en"
    assert got[95]["score"] > 0.9 and got[None]["held_out"] is False
    kept = language.keep(frame)
    assert kept.columns == frame.columns and {90, 91, 92, 93}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_no_labels_one_label_no_rows(documents):
    assert {r["lang_pred"] for r in language.predict(documents([(1, "a b")], lang=None)).collect()} == {"und"}
    one = language.predict(documents([(1, "a b"), (3, "c"), (4, "d")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}
    assert language.predict(documents([])).count() == 0


def test_pieces_of_long_texts_add_up(monkeypatch):
    """Texts cut at any place have the subwords of the whole."""
    model = language.Model(["a", "b"], np.random.default_rng(0).normal(size=(1 << 14, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = pa.array(["Some words, and some more! éà " * 40, "x", ""])
    whole = language.raw_scores(texts, model)
    monkeypatch.setattr(language, "_PIECE", 64)
    assert np.allclose(whole, language.raw_scores(texts, model))


def test_sample_is_bounded(small):
    options = Options(per_language=10)
    languages, labels, pieces = language.sample(language.learnable(small("documents")), options)
    assert len(labels) == len(pieces) <= 2 * 10 * len(languages)


def test_a_good_model_rejects_what_it_has_not_learned():
    """Two languages that are told apart without errors; texts of both at once or of neither fall below the bound."""
    random = np.random.default_rng(5)
    parts = {"a": "bakalamanasata", "b": "gedefejevepewe"}
    made = lambda name, n: " ".join("".join(random.choice([parts[name][k : k + 2] for k in range(0, 14, 2)], 3)) for _ in range(n))
    labels = [i % 2 for i in range(2000)]
    pieces = [made("ab"[k], int(random.choice([3, 8, 24, 64]))) for k in labels]
    model = language.fit(["a", "b"], labels, pieces)
    score = lambda texts: language.probabilities(language.raw_scores(pa.array(texts), model), model).max(1)
    assert 0 < model.bound < 1
    clean = score([made(x, n) for x in "ab" for n in (3, 8, 24, 64) for _ in range(100)])
    assert (clean < model.bound).mean() <= 0.01
    assert (score(["qxzz", "zq xzq", "1x", made("a", 1) + " " + made("b", 1)]) < model.bound).any()


def test_every_language_is_learned(documents):
    """Three hundred languages, each with words of its own; held-out documents of all of them are told apart."""
    random = np.random.default_rng(8)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    own = [random.choice(syllables, 5) for _ in range(300)]
    made = lambda k: " ".join("".join(random.choice(own[k], 2)) for _ in range(30))
    rows = [(i, made(i % 300), f"l{i % 300:03}", None, None) for i in range(6000)]
    got = [r for r in language.predict(documents(rows), Options(epochs=12)).collect() if r["held_out"]]
    right = [r["lang_pred"] == rows[r["doc_id"]][2] for r in got]
    assert len({r["lang_pred"] for r in got}) > 256 and np.mean(right) > 0.9
