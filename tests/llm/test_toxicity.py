import math
import zlib
from collections import Counter

import numpy as np
import pytest

from siltworks.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
INSULTS = ["idiot", "moron", "trash", "scum"]


def rows_of(n):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        text = list(rng.choice(words, 40))
        if i % 4 == 0:
            text[::10] = rng.choice(INSULTS, 4)
        out.append((i, " ".join(text), int(i % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = rows_of(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, toxicity.fit(docs, labels)


def plain_counts(terms, text):
    low = "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in text.lower())
    found = Counter()
    for w in low.split():
        for t in (w + "$", *[w[:n] for n in toxicity.STEMS if len(w) >= n]):
            if t in terms:
                found[t] += 1
    return found


def test_nearest_equals_brute_force(fitted):
    """Cosines of every example, from texts alone: document frequencies, weights and order."""
    rows, _, index = fitted
    assert {t for t in index.terms if t.endswith("$")} == {w + "$" for w in INSULTS}
    terms = set(index.terms)
    counts = {i: plain_counts(terms, t) for i, t, _ in rows}
    df = Counter(t for c in counts.values() for t in c)

    def vector(c):
        w = {t: (1 + math.log(n)) * (1 + math.log((1 + len(rows)) / (1 + df[t]))) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    vectors = {i: vector(c) for i, c in counts.items() if zlib.crc32(str(i).encode()) % 5}
    assert sorted(index.ids) == sorted(vectors)
    vocabulary = toxicity.Vocabulary(index.terms)
    for i, text, _ in rows[:200]:
        mine = vector(counts[i])
        cosines = sorted((sum(x * v.get(t, 0.0) for t, x in mine.items()) for v in vectors.values()), reverse=True)
        want = [c for c in cosines[: toxicity.NEAREST] if c > 0]
        near = index.nearest(vocabulary.counts(text))
        assert np.allclose([c for c, _ in near], want, atol=1e-9) and len(near) == len(want)
        for c, p in near:
            assert abs(c - sum(x * vectors[index.ids[p]].get(t, 0.0) for t, x in mine.items())) < 1e-9
        assert [p for _, p in near] == [p for _, p in sorted(near, key=lambda x: (-x[0], x[1]))]


def test_blocks_are_skipped_but_lose_nothing(fitted, monkeypatch):
    """With blocks of one example and no early end the neighbours are the same."""
    rows, docs, index = fitted
    examples = [(index.ids[p], int(index.labels[p]), toxicity.Vocabulary(index.terms).counts(rows[index.ids[p]][1])) for p in range(len(index.ids))]
    monkeypatch.setattr(toxicity, "BLOCK", 1)
    small = toxicity.indexed(index.terms, index.idf, examples)
    vocabulary = toxicity.Vocabulary(index.terms)
    for _, text, _ in rows[:60]:
        a = [c for c, _ in small.nearest(vocabulary.counts(text))]
        monkeypatch.setattr(toxicity, "BLOCK", 64)
        b = [c for c, _ in index.nearest(vocabulary.counts(text))]
        monkeypatch.setattr(toxicity, "BLOCK", 1)
        assert np.allclose(a, b, atol=1e-12)


def test_scores(spark, fitted):
    rows, docs, index = fitted
    got = toxicity.score(docs, index).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and all(r.predicted == truth[r.doc_id] for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert abs(index.score(sum(e.similarity if e.toxic else -e.similarity for e in r.evidence) / toxicity.NEAREST) - r.score) < 1e-12
        assert all(truth[e.id] == e.toxic for e in r.evidence)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "You idiot"), (1, "You idiot"), (2, None), (3, ""), (None, "idiot"), (4, "word " * 200_000), (6, "fine words")], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS score", "2 AS id", "3 AS terms")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (6, 0)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    got = toxicity.score(docs, index).collect()
    assert len(got) == 7 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.score(docs.limit(0), index).collect() == []
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.fit(docs.limit(0), labels).score(0.0) == 0.5


def test_op13_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op13_toxicity(spark, sf).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(got) == len({r.doc_id for r in got}) == 1000
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
