from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marquee.llm import quality, queries
from marquee.llm.quality import Grams, Model, Options, fit, raw_scores
from tests.llm.conftest import clashing

LABELS = "doc_id long, quality int, toxic int"


def test_query_on_the_held_out_fold(engine):
    folder = "/root/testdata/sf0.01"
    rows = queries.op13_quality(engine, folder).collect()
    truth = {r["doc_id"]: r["quality"] for r in engine.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == engine.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_only_learnable_labels_and_texts_matter(engine, small):
    docs, labels = small("documents"), small("labels")
    held = quality.held_out(F.col("doc_id"))
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    a, b = ({tuple(r) for r in quality.judge(x, y).collect()} for x, y in ((docs, labels), (changed, other)))
    assert a == b


def plain_features(text: str, grams_of) -> dict[int, float]:
    """Features of one text by itself: bucket to value."""
    g = grams_of(pa.array([text]))
    out: dict[int, float] = {}
    if len(g.words):
        for bucket, value in zip(*g.rows(0, len(g.words)), strict=True):
            out[int(bucket)] = out.get(int(bucket), 0.0) + float(value)
    return out


def test_scores_equal_a_plain_dot_product_over_all_rows(small):
    """Rows scored together, in slices, equal rows scored alone feature by feature."""
    texts = [r["text"] for r in small("documents").collect()] + ["", None, " ", "a", "A a A", "!!", "a" * 3000, "x y " * 3000]
    random = np.random.default_rng(2)
    model = Model(random.normal(size=1 << 12).astype(np.float32), 0.25)
    got = raw_scores(pa.array(texts), model, 10.0)
    for text, score in zip(texts, got, strict=True):
        want = sum(v * float(model.weights[b]) for b, v in plain_features(text or "", lambda c: Grams(c, 1 << 12)).items())
        assert abs(score - (10 * want + 0.25)) < 1e-6


def test_tokens_and_shapes():
    g = Grams(pa.array(["Ha HA ha!! b2 é", "ha"]), 1 << 12)
    assert np.diff(g.first).tolist() == [6, 1]
    words, shapes = g.words.tolist(), g.shapes.tolist()
    assert words[0] == words[1] == words[2] == words[6] and len(set(words[:6])) == 4
    # Case and repetition tell the first three apart; a repeated word across rows is none.
    assert len(set(shapes[:3])) == 3 and shapes[6] not in shapes[:5] and shapes[3] == words[3]


def test_a_step_follows_the_rule():
    """FTRL-proximal by plain loops, the same examples in the same order."""
    random = np.random.default_rng(0)
    options = Options(buckets=16, epochs=2, lasso=0.5, ridge=0.1)
    examples = []
    for _ in range(30):
        at = np.unique(random.integers(0, 16, 5))
        examples.append((at, random.random(len(at)), float(random.integers(0, 2))))
    model = fit(examples, options)
    z, n, w = [0.0] * 17, [0.0] * 17, [0.0] * 17
    order = np.random.default_rng(options.seed)
    for _ in range(options.epochs):
        for k in order.permutation(len(examples)):
            at, x, y = examples[k]
            pairs = [(int(i), float(v) * options.scale) for i, v in zip(at, x, strict=True)] + [(16, 1.0)]
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / options.rate
                z[i] += g - sigma * w[i]
                n[i] += g * g
                lasso = 0.0 if i == 16 else options.lasso
                w[i] = 0.0 if abs(z[i]) <= lasso else -(z[i] - np.sign(z[i]) * lasso) / ((options.smooth + n[i] ** 0.5) / options.rate + options.ridge)
    assert np.allclose(model.weights, w[:16], atol=1e-6) and abs(model.bias - w[16]) < 1e-9
    assert 0 in model.weights


def test_edges(engine, documents):
    good, bad = "the cat and the dog went home", "BUY!! BUY!! BUY!! NOW!!"
    rows = [(i, good) for i in range(40)] + [(i, bad) for i in range(40, 80)]
    rows += [(90, None), (91, ""), (92, " \n"), (93, "the cat " * 300_000), (93, bad), (None, good)]
    labels = [(i, int(i < 40), 0) for i in range(80)] + [(1, 1, 0), (2, 5, 0), (3, None, 0), (None, 0, 0), (999, 1, 1)]
    frame = clashing(documents(rows), "score", "predicted", "key", "target", "draw", "quality")
    got = quality.judge(frame, clashing(engine.createDataFrame(labels, LABELS), "text", "key", "target")).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], i): r for i, r in enumerate(got)}
    assert all(r["predicted"] == (i < 40) for (i, _), r in by.items() if i is not None and i < 80)
    empty = {r["score"] for (i, _), r in by.items() if i in (90, 91, 92)}
    assert len(empty) == 1
    assert sorted(r["predicted"] for (i, _), r in by.items() if i == 93) == [0, 1]
    assert [r["held_out"] for (i, _), r in by.items() if i is None] == [False]


def test_no_labels_one_label_no_rows(engine, documents):
    none = engine.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.judge(documents([(1, "a b"), (2, None)]), none).collect()} == {0.5}
    one = engine.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    assert all(r["predicted"] == 1 for r in quality.judge(documents([(i, "a b") for i in range(20)]), one).collect())
    assert quality.judge(documents([]), one).count() == 0


def test_sample_is_bounded(engine, small):
    options = Options(sample=20, tokens=8)
    found = quality.sample(quality.learnable(small("documents"), small("labels")), options)
    assert len(found) == 20 and all(len(at) <= 8 * 5 for at, _, _ in found)
