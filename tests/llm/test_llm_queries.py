import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_shared import brute_components, norm, reference_print
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import compare
from siltworks.llm import bpe, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_op4_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, reference_print(r.text)) for r in rows]
    want = sorted((k, f"{x:016x}", c) for (k, x), c in zip(prints, brute_components(prints)))
    assert sorted(map(tuple, queries.op4_simhash(spark, SF).collect())) == want


def plain_score(net, text):
    """The network's score of one text, byte by byte and chunk by chunk."""
    if not text:
        return 1 / (1 + np.exp(-net.offset))
    n, width = len(text), len(net.table)
    padded = np.r_[np.frombuffer(text, np.uint8), np.zeros(width, np.uint8)]
    at = np.array([sum((net.table[k, padded[i + k]] for k in range(1, width)), net.table[0, padded[i]].copy()) for i in range(n)])
    half = quality.HALF
    starts = range(0, max(1, n - half), half) if n > half else [0]
    chunks = np.array([np.maximum(at[s : s + 2 * half].max(axis=0) + net.bias, 0) for s in starts], float)
    return 1 / (1 + np.exp(-(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.head + net.offset)))


def test_op8_equals_brute_force(spark):
    """Scores by a plain version of the network that the query trains; folds by Python's own CRC."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net, rows = quality.fit(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    got = queries.op8_quality(spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
        text = (rows[r.doc_id] or "").encode()
        if len(text) < 6000:
            assert abs(r.score - plain_score(net, text)) < 1e-4


def test_op8_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in queries.op8_quality(spark, sf).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.9 * len(held)


def chosen_rows(spark, rows, share, epochs, seed=0):
    """doc_ids that the mix takes, leaf by leaf and epoch by epoch."""
    size = lambda r: len((r.text or "").split())
    leaf = lambda r: (None if r.source is None else re.sub("[0-9]$", "x", r.source), r.lang, r.source)
    supply, place, out = {}, {}, []
    for r in rows:
        supply[leaf(r)] = supply.get(leaf(r), 0) + size(r)
    plan = mixing.budgets({k: v * epochs for k, v in supply.items()}, share * sum(supply.values()), queries.MIX_WEIGHTS)
    frame = spark.createDataFrame([(r.doc_id, e) for r in rows for e in range(epochs)], "id long, e int")
    for r in frame.select("id", "e", mixing.order_of(seed, F.col("e"), F.col("id")).alias("h")).collect():
        place[r.id, r.e] = r.h
    for k, budget in plan.items():
        for e in range(epochs):
            own, ahead, passed = min(max(budget - e * supply[k], 0), supply[k]), 0, []
            for r in sorted((r for r in rows if leaf(r) == k), key=lambda r: (place[r.doc_id, e], r.doc_id)):
                if ahead >= own:
                    break
                passed.append(r)
                ahead += size(r)
            while passed and not size(passed[-1]):
                passed.pop()
            out += [r.doc_id for r in passed]
    return out


def test_op9_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op9_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(chosen_rows(spark, rows, 0.5, 2)) and len(got) > 50


def test_op10_equals_the_library(spark):
    theirs = Tokenizer.from_file(bpe.default_path())
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert set(map(tuple, queries.op10_bpe(spark, SF).collect())) == want


ODD = [
    (1, "A sound text about rivers, with words enough to be kept by any classifier.", "en", "src1", 70), (1, "A sound text about rivers, with words enough to be kept by any classifier.", "en", "src1", 70),
    (None, "A text without an id, about hills and the people who live among them.", "en", None, 60), (None, None, None, None, None), (4, None, "en", "src1", None), (5, "", "en", "src1", 0), (5, "", "de", "src2", 0),
    (6, " \n\t", None, "src1", 3), (7, "the same words in another row of another source and language", "de", "src22", 60), (8, "the same  words in another row of another source and\nlanguage", "fr", "src3", 60), (9, "word " * 30_000, "en", "src1", 150_000),
]


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns named like the operators' own."""
    names = ["__silt_id", "__silt_text", "__silt_keep", "epoch", "leaf", "fp", "score", "id", "h"]
    docs = spark.createDataFrame([(*r, *[i] * len(names)) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names)).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stage(spark, docs, SF) for name, stage in list(stages.items())[:-1]}
    at = lambda name: sorted(r["h"] for r in kept[name].collect())
    assert all(frame.columns == docs.columns for frame in kept.values())
    assert set(at("quality classifier")) <= set(range(len(ODD)))
    distinct = at("exact dedup")
    groups = {}
    for i, r in enumerate(ODD):
        groups.setdefault(norm(r[1]), []).append((r[0] is None, r[0] or 0, i))
    for some in groups.values():
        least = min(some)[:2]
        assert sum(x[:2] == least and x[2] in distinct for x in some) == 1 and not any(x[2] in distinct for x in some if x[:2] != least)
    prints = [(r[0], reference_print(r[1])) for r in ODD]
    near = at("SimHash near-dedup")
    assert {prints[i][0] for i in near} >= {c for c in brute_components(prints) if c is not None}
    assert len(at("mixing sources")) == len(set(at("mixing sources"))) <= len(ODD)
    digests = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(digests) == len(ODD) and {r.n_tokens for r in digests if r.doc_id in (4, 5, 6)} == {0}


def test_names():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if net.score((r.text or "").encode()) >= 0.3]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    rows = list(first.values())
    least = brute_components([(r.doc_id, reference_print(r.text)) for r in rows])
    rows = [r for r, c in zip(rows, least) if r.doc_id == c]
    size = lambda r: len((r.text or "").split())
    leaf = lambda r: (r.source[:-1] + "x", r.lang, r.source)
    supply = {}
    for r in rows:
        supply[leaf(r)] = supply.get(leaf(r), 0) + size(r)
    plan = mixing.budgets(supply, 0.5 * sum(supply.values()), queries.MIX_WEIGHTS)
    place = {r.id: r.h for r in spark.createDataFrame([(r.doc_id,) for r in rows], "id long").select("id", mixing.order_of(0, F.lit(0), F.col("id")).alias("h")).collect()}
    chosen = []
    for k, budget in plan.items():
        ahead = 0
        for r in sorted((r for r in rows if leaf(r) == k), key=lambda r: (place[r.doc_id], r.doc_id)):
            if ahead >= budget:
                break
            chosen.append(r)
            ahead += size(r)
    theirs = Tokenizer.from_file(bpe.default_path())
    want = set()
    for r in chosen:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("fp", F.lit("extra")).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect() == []
