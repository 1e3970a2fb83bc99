import random

import pytest
from pyspark.sql import functions as F

from siltworks.llm import mixing


def test_divide():
    assert mixing.divide(90, {"a": 100, "b": 100}, {"a": 2, "b": 1}) == {"a": 60, "b": 30}
    assert mixing.divide(90, {"a": 10, "b": 100, "c": 100}, {"b": 3}) == {"a": 10, "b": 60, "c": 20}
    assert mixing.divide(90, {"a": 10, "b": 20}, {}) == {"a": 10, "b": 20}
    assert mixing.divide(90, {"a": 10, "b": 20}, {"b": 0}) == {"a": 10, "b": 0}


def test_shortages_stay_among_siblings_first():
    supply = {("d1", "en", "s1"): 10, ("d1", "en", "s2"): 500, ("d1", "de", "s1"): 500, ("d2", "en", "s3"): 500}
    plan = mixing.budgets(supply, 400, {})
    assert plan[("d1", "en", "s1")] == 10 and plan[("d1", "en", "s2")] == pytest.approx(90)  # its sibling takes the rest
    assert plan[("d1", "de", "s1")] == pytest.approx(100) and plan[("d2", "en", "s3")] == pytest.approx(200)
    supply[("d1", "en", "s2")] = 40  # now the language is short: the other language of the domain takes it
    plan = mixing.budgets(supply, 400, {})
    assert plan[("d1", "de", "s1")] == pytest.approx(150) and plan[("d2", "en", "s3")] == pytest.approx(200)
    assert mixing.budgets({}, 5, {}) == {}


def test_tokens(spark):
    texts = ["", " ", "\n\n", "a\n", "\ta b", "a\t\r\n\x0b\x0cb  c ", "x", "\u00a0", "a\u00a0b \u2003"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.tokens(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [0, 0, 0, 1, 2, 3, 1, 1, 2]


def test_shares_equal_budgets(spark):
    rng = random.Random(9)
    for total in (0.0, 37.5, 900.0, 1e9):
        supply = {(rng.choice(["d1", "d2", "d3", None]), rng.choice(["en", "de", None]), f"s{i}"): float(rng.choice([0, 1, 5, 40, 300])) for i in range(40)}
        weights = {("d1",): 3.0, ("d2",): rng.choice([0.0, 0.5]), ("d1", "en"): 2.0, ("d3", "de"): 0.0, (None,): 4.0, (None, None): 0.1} | {k: rng.choice([0.0, 0.2, 1.0, 7.0]) for k in supply}
        leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, supply double")
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.shares(leaves, total, weights).collect()}
        assert got == pytest.approx(mixing.budgets(supply, total, weights))


def rows(n=400):
    rng = random.Random(3)
    out = [(i, "w " * rng.randint(0, 30), rng.choice(["en", "de", None]), f"src{rng.choice([0, 0, 0, 1, 7, 12])}", i) for i in range(n)]
    return out + [(n, None, "en", None, 0), (n + 1, "", "en", "src1", 0), (n + 2, "long " * 5000, "fr", "src3", 0)]


def brute(spark, data, share, weights, epochs, seed):
    """Every leaf sorted whole, on the driver."""
    hashes = {}
    frame = spark.createDataFrame([(r[0], e) for r in data for e in range(epochs)], "id long, e int")
    for r in frame.select("id", "e", mixing.order_of(seed, F.col("e"), F.col("id")).alias("h")).collect():
        hashes[r.id, r.e] = r.h
    leaf = lambda r: (None if r[3] is None else r[3][:-1] + "x", r[2], r[3])
    size = lambda r: len((r[1] or "").split())
    supply = {}
    for r in data:
        supply[leaf(r)] = supply.get(leaf(r), 0) + size(r)
    plan = mixing.budgets({k: v * epochs for k, v in supply.items()}, share * sum(supply.values()), weights)
    out = []
    for k, budget in plan.items():
        for e in range(epochs):
            own = min(max(budget - e * supply[k], 0), supply[k])
            ahead, passed = 0, []
            for r in sorted((r for r in data if leaf(r) == k), key=lambda r: (hashes[r[0], e], r[0])):
                if ahead >= own:
                    break
                passed.append(r)
                ahead += size(r)
            while passed and size(passed[-1]) == 0:  # the prefix ends with a document that has tokens
                passed.pop()
            out += [r[0] for r in passed]
    return sorted(out)


@pytest.mark.parametrize(("share", "weights", "epochs"), [(0.5, {}, 1), (0.9, {("src1x",): 3.0, ("srcx", "de"): 0.0}, 2), (1.6, {}, 2), (5.0, {}, 2), (0.0, {}, 2)])
def test_equals_brute_force(spark, share, weights, epochs):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, t long").repartition(3)
    mixed = mixing.mix(docs, share, weights=weights, epochs=epochs, seed=4)
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == brute(spark, data, share, weights, epochs, 4)


@pytest.mark.parametrize("most", [mixing.MAX_BROADCAST, 0])
def test_repeated_and_null_ids_and_clashing_names(spark, monkeypatch, most):
    """Rows of one id and text go together; beyond the bound of the broadcast the result is the same."""
    monkeypatch.setattr(mixing, "MAX_BROADCAST", most)
    monkeypatch.setattr("siltworks.llm.common.MIN_HOT_ROWS", 20)
    names = ["domain", "leaf", "epoch", "last", "h", "t", "mark", "id", "budget", "Range"]
    data = [(i % 40, f"text {i % 80} of some words", "en", "src1") for i in range(240)] + [(None, f"null {i % 50} id", "en", "src2") for i in range(100)]
    docs = spark.createDataFrame([(*r, *[i] * len(names)) for i, r in enumerate(data)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names)).repartition(4)
    mixed = mixing.mix(docs, 0.5, epochs=1, seed=1)
    assert mixed.columns == docs.columns
    got = [r[10] for r in mixed.collect()]
    assert len(got) == len(set(got))
    taken, units = {data[i] for i in got}, {}
    for i, r in enumerate(data):
        units.setdefault(r, []).append(i)
    assert sorted(got) == sorted(i for r in taken for i in units[r])  # whole units
    # each source's units in their order: taken while the tokens before them are under the budget
    where = {r: 0 for r in units}
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(units)], "id long, text string, lang string, source string, k int")
    mark = F.xxhash64("text")
    for r in frame.select("k", mixing.place(1, F.lit(0), F.col("id"), mark).alias("h"), mark.alias("m")).collect():
        where[list(units)[r.k]] = (r.h, list(units)[r.k][0] or 0, r.m)
    size = lambda r: len(r[1].split()) * len(units[r])
    supply = {("srcx", "en", s): sum(size(r) for r in units if r[3] == s) for s in ("src1", "src2")}
    plan = mixing.budgets(supply, 0.5 * sum(supply.values()), {})
    want = set()
    for s in ("src1", "src2"):
        ahead = 0
        for r in sorted((r for r in units if r[3] == s), key=where.get):
            if ahead >= plan["srcx", "en", s]:
                break
            want.add(r)
            ahead += size(r)
    assert taken == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs).collect() == []
    blank = spark.createDataFrame([(1, " \n", "en", "src1"), (2, None, None, None)], docs.schema)
    assert mixing.mix(blank).collect() == []
