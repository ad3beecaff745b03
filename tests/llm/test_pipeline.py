"""Each stage on its own input, held against a plain version of it."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from marquee.llm import language
from marquee.session import stored
from tests.llm.conftest import clashing
from tests.llm.test_neardup import brute as groups
from tests.llm.test_secrets import brute as secrets_in

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(engine):
    """Input and output of every stage over the small table."""
    docs, out = engine.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in C.STAGES:
        after = stored(stage(engine, docs, FOLDER), "test-stage")
        out[name] = docs, after
        docs = after
    return out


def rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "pieces"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_language(stages):
    before, after = stages["language"]
    rejected = {r["doc_id"] for r in language.predict(before).where("rejected").collect()}
    assert rows(after).keys() == rows(before).keys() - rejected


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    want = {d for d, _, _, kept in groups([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80) if kept}
    assert rows(after).keys() == want


def test_decontamination(stages):
    before, after = stages["decontamination"]
    items = [" ".join(r["text"].split()) for r in before.sparkSession.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = rows(before).keys() - rows(after).keys()
    verbatim = {d for d, r in rows(before).items() if any(i in " ".join(r["text"].split()) for i in items)}
    assert verbatim <= gone and len(gone) <= len(rows(before)) * 0.1


def test_secrets(stages):
    before, after = stages["secrets"]
    new = rows(after)
    assert new.keys() == rows(before).keys()
    for d, r in rows(before).items():
        assert (new[d]["text"] == r["text"]) == (not secrets_in(r["text"])[4])
        assert not any(secrets_in(new[d]["text"])[:3])
        if new[d]["text"] != r["text"]:
            assert new[d]["n_chars"] == len(new[d]["text"])


def test_pieces(stages):
    before, after = stages["pieces"]
    from marquee.llm import pieces

    back = after.select("doc_id", pieces.decoded(F.col("ids")).alias("text")).collect()
    assert Counter(r["doc_id"] for r in back) == Counter({d: 2 for d in rows(before)})
    assert all(r["text"] == rows(before)[r["doc_id"]]["text"] for r in back[:50])


def test_run_gives_the_last_stage(engine, stages):
    assert C.run(engine, FOLDER).count() == stages["pieces"][1].count()


def test_odd_rows_pass_all_stages(engine, documents):
    odd = documents([(1, None), (2, ""), (None, "the cat"), (3, "the cat and the dog went home " * 2000), (3, "the cat"), (3, "the cat")])
    frame = clashing(odd, "rejected", "key", "row", "label", "spans", "rank", "ids", "place")
    for name, stage in C.STAGES:
        after = stored(stage(engine, frame, FOLDER), "odd-stage")
        if name != "pieces":
            assert after.columns == frame.columns
        frame = after
    empty = documents([])
    for _, stage in C.STAGES:
        assert stage(engine, empty, FOLDER).count() == 0


def test_workers_get_few_documents_at_a_time(engine, documents):
    engine.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    C.segmentation(engine, documents([(1, "a text")]), "")
    assert int(engine.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_decontamination_leaves_no_passage_out(engine, documents, monkeypatch):
    """The stage's space is of all 18,000 passages that it is given, and of the benchmark items."""
    from tests.llm.test_decontaminate import invented

    seen = []
    whole = C.decontaminate.latent_space

    def space(passages, idf, options):
        seen.append(passages.count())
        return whole(passages, idf, options)

    monkeypatch.setattr(C.decontaminate, "latent_space", space)
    docs = documents([(i, " ".join(invented(i, 48 * 20))) for i in range(900)])
    assert C.decontamination(engine, docs, FOLDER).count() == 900
    items = engine.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert seen == [18_000 + C.decontaminate._passages(docs.limit(0), items, C.decontaminate.Options()).count()]
