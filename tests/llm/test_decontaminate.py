from __future__ import annotations

import random
import re
from collections import defaultdict

from marquee.llm import decontaminate, queries
from marquee.llm.decontaminate import Options, common
from tests.llm.conftest import clashing

BENCH = "item_id long, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_is_the_longest_common_subsequence():
    random.seed(2)
    for _ in range(200):
        a, b = ([random.randrange(6) for _ in range(random.randrange(1, 30))] for _ in range(2))
        assert common(decontaminate._masks(a), len(a), b) == lcs(a, b)


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_query_finds_all_items_and_nothing_else(engine):
    """Brute force: shared runs of four words, then the best subsequence around them."""
    folder = "/root/testdata/sf0.01"
    items = {r["item_id"]: plain(r["text"]) for r in engine.read.parquet(f"{folder}/benchmark.parquet").collect()}
    runs = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 3):
            runs[tuple(w[k : k + 4])].add(i)
    want = set()
    for r in engine.read.parquet(f"{folder}/documents.parquet").collect():
        w = plain(r["text"])
        for k in range(len(w) - 3):
            for i in runs.get(tuple(w[k : k + 4]), ()):
                n = len(items[i])
                if (r["doc_id"], i) not in want and lcs(items[i], w[max(0, k - n) : k + 4 + n]) >= 0.75 * n:
                    want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_decontaminate(engine, folder).collect()}
    assert got == want and len(want) > 20


def invented(seed, n):
    random.seed(seed)
    return [random.choice("klmnprst") + random.choice("aeiou") + random.choice("dfgbv") + str(random.randrange(40)) for _ in range(n)]


def test_copies_paraphrases_and_clean_texts(engine, documents):
    items = {i: invented(i, 30 + i) for i in range(12)}
    bench = engine.createDataFrame([(i, " ".join(w[:-8]) + ". " + " ".join(w[-8:]) + ".") for i, w in items.items()], BENCH)
    rows = []
    for i, w in items.items():
        noise = invented(100 + i, 400)
        rows.append((i, " ".join(noise[:200] + w + noise[200:])))  # as it is
        loud = [x.upper() + "!!" for x in w]
        rows.append((20 + i, " ".join(noise[:37] + loud)))  # louder
        random.seed(i)
        body = [x if random.random() < 0.75 else "other" + x for x in w[:-8]]
        rows.append((40 + i, " ".join(noise[:90] + body + w[-8:] + noise[90:120])))  # with other words
        rows.append((60 + i, " ".join(noise)))  # clean
        rows.append((80 + i, " ".join(noise[:50] + sorted(w) + noise[50:])))  # its words, not its order
    found = {r["doc_id"] for r in decontaminate.leaks(documents(rows), bench).collect()}
    assert found == {*range(12), *range(20, 32), *range(40, 52)}
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(documents(rows), bench, Options(items=5)).collect()}
    assert kept == {*range(60, 72), *range(80, 92)}


def test_edges(engine, documents):
    w = invented(7, 20)
    bench = [(1, " ".join(w)), (1, " ".join(w)), (2, None), (3, ""), (4, "one two"), (5, "five words make no row"), (None, " ".join(w))]
    bench = engine.createDataFrame(bench, BENCH)
    rows = [(1, None), (2, ""), (3, "!! ?"), (4, " ".join(w)), (4, " ".join(w)), (5, "x one two y"), (6, "five, words make no row"), (7, "five words they make no row")]
    rows += [(8, " ".join(invented(9, 150_000) + w)), (None, " ".join(w))]
    frame = clashing(documents(rows), "item_id", "kind", "x", "bucket", "cosine")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.leaks(frame, clashing(bench, "doc_id")).collect())
    assert got == sorted([(4, 1), (4, 1), (4, 1), (4, 1), (6, 5), (8, 1), (8, 1), (0, 1), (0, 1)])
    kept = decontaminate.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 7]


def test_empty_tables(engine, documents):
    none = engine.createDataFrame([], BENCH)
    some = engine.createDataFrame([(1, "some words that nobody has written down before now")], BENCH)
    assert decontaminate.leaks(documents([(1, "text")]), none).count() == 0
    assert decontaminate.drop_leaks(documents([(1, "text"), (2, None)]), none).count() == 2
    assert decontaminate.leaks(documents([]), some).count() == 0


def test_latent_space_holds_the_largest_variance(engine, documents):
    """Against numpy's own decomposition of the same passages."""
    import numpy as np

    options = Options(buckets=256, rank=8)
    random.seed(3)
    topics = [[f"{t}w{i}" for i in range(12)] for t in "abcdef"]
    rows = [(i, " ".join(random.choice(topics[i % 6]) for _ in range(40))) for i in range(120)]
    docs = documents(rows)
    n, df = decontaminate.document_frequencies(docs, options)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    passages = decontaminate._passages(docs, engine.createDataFrame([(1, "aw1 aw2 aw3 aw4 aw5")], BENCH), options)
    space, _ = decontaminate.latent_space(passages, idf, options)
    assert np.allclose(space.T @ space, np.eye(8), atol=1e-8)
    lists = [r["buckets"] for r in passages.collect()]
    a = np.array([np.bincount(x, minlength=256) * idf for x in lists])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    best = (np.linalg.svd(a, compute_uv=False)[:8] ** 2).sum()
    assert np.linalg.norm(a @ space) ** 2 > 0.95 * best


def found_in(index, texts):
    """Per text the items found, without Spark."""
    import pyarrow as pa

    search = decontaminate._Search(index)
    words = decontaminate.Words(pa.array(texts), True, decontaminate.PLAIN)
    found = [set() for _ in texts]
    for row, item, _ in search.rows(words, 0, len(texts)):
        found[row].add(index.items[item].item_id)
    return found


def without_space(rows, **options):
    """An index whose latent space makes nothing near."""
    import numpy as np

    options = Options(near=2.0, **options)
    return decontaminate.with_items(decontaminate.Index(options, np.ones((options.buckets, options.rank), np.float32)), rows)


def test_copies_do_not_depend_on_the_latent_space():
    """Whole items and items with a quarter of their words replaced or left out, at any place."""
    items = {n: invented(500 + n, n) for n in (10, 11, 14, 20, 33, 60)}
    index = without_space([(n, " ".join(w)) for n, w in items.items()])
    random.seed(4)
    texts, want = [], []
    for n, w in items.items():
        for _ in range(20):
            gone = set(random.sample(range(n), n // 4))
            left = [x for k, x in enumerate(w) if k not in gone]
            other = ["z" + x if k in gone else x for k, x in enumerate(w)]
            noise = invented(random.randrange(1 << 20), 90)
            at = random.randrange(90)
            texts += [" ".join(noise[:at] + x + noise[at:]) for x in (w, left, other)]
            want += [{n}] * 3
    texts += [" ".join(items[20][:10]), " ".join(items[20][10:])]  # halves in rows side by side
    assert found_in(index, texts) == want + [set(), set()]


def test_a_paraphrase_at_the_very_bound_is_found():
    """11 of 20 words are 0.55, also where 0.55 * 20 is rounded up."""
    w = invented(77, 20)
    text = " ".join(["no"] * 30 + [x if k in (0, 1, 2) or k >= 12 else "other" for k, x in enumerate(w)] + ["no"] * 30)
    assert found_in(without_space([(1, " ".join(w))]), [text]) == [{1}]


def test_short_items_do_not_depend_on_the_latent_space():
    """Items of 4 to 9 words at every place, and only as a run of all their words."""
    items = {n: invented(900 + n, n) for n in range(4, 10)}
    rows = [(n, " ".join(w)) for n, w in items.items()] + [(1, " ".join(items[4])), (2, "one two three")]
    noise = invented(3, 40)
    texts, want = [], []
    for n, w in items.items():
        own = {n, 1} if n == 4 else {n}
        for at in (0, 1, 7, 8, 23, 40):
            texts.append(" ".join(noise[:at] + w + noise[at:]))
            want.append(own)
        texts += [" ".join(noise[:9] + w[:-1] + noise[9:]), " ".join(w[:3] + noise[:1] + w[3:]), " ".join(w[:-1]), w[-1]]
        want += [set()] * 4
        texts.append(" ".join((w + noise) * 3))
        want.append(own)
    assert found_in(without_space(rows), texts) == want
    assert found_in(without_space(rows[:1]), texts[:1]) == [{4}]


def test_recall_on_real_words(engine):
    """Shares of 0.55 to 1 of the items, and cuts of 4 to 60 words, against a plain subsequence check."""
    folder = "/root/testdata/sf0.01"
    docs, bench = (engine.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "benchmark"))
    ascii_words = lambda text: re.findall(r"[^\W_]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    pool = [w for r in docs.orderBy("doc_id").collect() if len(w := ascii_words(r["text"])) >= 400]
    random.seed(12)
    cuts = []
    for n in (4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 60):
        for _ in range(15):
            at = random.randrange(300)
            cuts.append((10_000 + len(cuts), " ".join(random.choice(pool)[at : at + n])))
    real = [(r["item_id"], r["text"]) for r in bench.collect()]
    index = decontaminate.with_items(decontaminate.fitted(docs, bench), real + cuts)
    answer = {x.item_id: x.answer for x in index.items}
    texts, want = [], []
    for (i, text), share in [(x, s) for x in real for s in (0.55, 0.65, 0.75, 0.8, 0.9, 1.0)] + [(x, 1.0) for x in cuts]:
        w = ascii_words(text)
        n, a = len(w), answer[i]
        body = n if share >= 0.75 else n - a
        gone = set(random.sample(range(body), min(body, int(n * (1 - share) + 1e-9))))
        put = [random.choice(random.choice(pool)) if k in gone else x for k, x in enumerate(w)]
        noise, at = random.choice(pool)[:400], random.randrange(401)
        whole = noise[:at] + put + noise[at:]
        near = whole[max(0, at - n // 2) : at + n + n // 2]
        got = lcs(w, near) / n
        if got >= 0.75 or (got >= 0.55 and lcs(w[-a:], near) >= 0.6 * a):
            texts.append(" ".join(whole))
            want.append(i)
    found = found_in(index, texts)
    assert len(want) > 250
    assert [i for i, seen in zip(want, found, strict=True) if i not in seen] == []


def test_copies_of_one_text_take_one_place_of_the_sample(engine, documents):
    """A third of the rows are one text of ten passages; all texts are drawn and the limit bites."""
    options = Options(sample=480)
    rows = [(i, " ".join(invented(i if i < 80 else 80, 480))) for i in range(120)]
    passages = decontaminate._passages(documents(rows), engine.createDataFrame([], BENCH), options)
    lists = [tuple(r["buckets"]) for r in passages.collect()]
    assert len(lists) == len(set(lists)) == options.sample


def test_windows_with_few_of_an_items_words_are_not_checked(monkeypatch):
    """All windows are near here; only those around enough of an item's words reach the check."""
    import numpy as np

    items = {n: invented(40 + n, 12 + n % 50) for n in range(70)} | {99: invented(7, 400)}
    weights = np.abs(np.random.default_rng(1).normal(size=(Options().buckets, Options().rank))).astype(np.float32)
    index = decontaminate.with_items(decontaminate.Index(Options(near=-1.0), weights), [(n, " ".join(w)) for n, w in items.items()])
    seen = []
    plain_check = decontaminate._Search.checked

    def checked(self, words, bucket, low, first, row, lo, hi, item, cosine):
        if cosine is not None:
            seen.extend(zip(row.tolist(), lo.tolist(), hi.tolist(), item.tolist(), strict=True))
        return plain_check(self, words, bucket, low, first, row, lo, hi, item, cosine)

    monkeypatch.setattr(decontaminate._Search, "checked", checked)
    # Every fourth word of an item is another one; rows of all lengths lie around these texts.
    order = [0, 5, 30, 69]
    texts = [" ".join(x if k % 4 else "other" for k, x in enumerate(items[n])) for n in order]
    texts = [" ".join(invented(300 + i, 5 + 60 * i)) + f" {t} " + " ".join(invented(200 + i, 70 - 9 * i)) for i, t in enumerate(texts)]
    texts += [" ".join(invented(400 + i, 3 * i)) for i in range(40)] + [" ".join(invented(401, 300) + items[99] + invented(402, 300))]
    found = found_in(index, texts)
    assert found == [{n} for n in order] + [set()] * 40 + [{99}]
    # Without the counts of words each window met each item of its length: 15,211.
    assert len(seen) < 1000


def test_counts_of_an_items_words_leave_none_out():
    import numpy as np
    import pyarrow as pa

    random.seed(11)
    vocabulary = invented(5, 60)
    rows = [(n, " ".join(random.choice(vocabulary) for _ in range(10 + n % 40))) for n in range(90)] + [(99, " ".join(random.choice(vocabulary) for _ in range(300)))]
    index = without_space(rows)
    search = decontaminate._Search(index)
    blocks = 150
    words = decontaminate.Words(pa.array([" ".join(random.choice(vocabulary) for _ in range(8 * blocks))]), True, decontaminate.PLAIN)
    bucket = decontaminate._buckets(words.hashes, index.options.buckets)
    nth = bucket.reshape(blocks, 8).T
    for size, items in search.by_window.items():
        around = -(-max(len(index.items[i].hashes) for i in items) // 2 // 8)
        at = np.repeat(np.arange(0, blocks - size), 3)
        item = np.array([random.randrange(len(items)) for _ in at])
        got = search.held(size, nth, item, at).tolist()
        for i, a, n in zip(items[item].tolist(), at.tolist(), got, strict=True):
            has = set(decontaminate._buckets(np.array(index.items[i].hashes, np.uint64), index.options.buckets).tolist())
            low, high = 8 * max(0, a - around - 1), 8 * (a + size + around + 1)
            half = len(index.items[i].hashes) // 2
            least = sum(x in has for x in bucket[max(0, 8 * a - half) : 8 * (a + size) + half].tolist())
            assert least <= n <= sum(x in has for x in bucket[low:high].tolist())


def test_all_passages_of_all_documents_shape_the_space(engine, documents):
    """The old bound of 16,384 passages, drawn from texts, left most of these out; repeated ones count once."""
    texts = [invented(i, 48 * 20) for i in range(900)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(9000 + i, " ".join(texts[0])) for i in range(50)]
    rows += [(10_000, None), (10_001, ""), (10_002, " ".join(texts[1][:50]))]
    bench = engine.createDataFrame([(1, " ".join(texts[2][:40])), (2, None)], BENCH)
    found = [tuple(r["buckets"]) for r in decontaminate._passages(documents(rows), bench, Options()).collect()]
    assert len(found) == 900 * 20 + 1 + 1 and len(set(found)) == len(found)


def test_the_space_is_summed_over_all_tasks(engine, documents):
    """More tasks than are added at once, against the sum of all passages in numpy."""
    import numpy as np

    options = Options(buckets=1 << 16, rank=4)
    rows = [(i, " ".join(invented(i, 30 + i))) for i in range(400)]
    passages = decontaminate._passages(documents(rows), engine.createDataFrame([], BENCH), options)
    lists = [r["buckets"] for r in passages.collect()]
    idf = np.random.default_rng(3).uniform(0.5, 9, options.buckets)
    a = np.array([np.bincount(x, minlength=options.buckets) * idf for x in lists])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    wide = passages.repartition(2 * decontaminate._TASKS + 7)
    space, strength = decontaminate.latent_space(wide, idf, options)
    base, _ = np.linalg.qr(a.T @ (a @ np.random.default_rng(options.seed).normal(size=(options.buckets, 4))))
    want, turn = np.linalg.eigh((a @ base).T @ (a @ base))
    assert np.allclose(strength, want[::-1], rtol=1e-4)
    assert np.allclose(np.abs((space * (base @ turn[:, ::-1])).sum(0)), 1, atol=1e-4)
