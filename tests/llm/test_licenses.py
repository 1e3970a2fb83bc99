import random

import numpy as np

from siltworks.llm import licenses, queries


def brute(text, least=0.8):
    """Containment in any window of the scanner's sizes, by plain sets."""
    words = text.encode().translate(licenses.LETTERS).split()
    grams = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    found = {}
    for name, t in licenses.TEMPLATES.items():
        w = t.encode().translate(licenses.LETTERS).split()
        own = {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        block = 1 << (len(own) - 1).bit_length()
        for at in range(0, len(grams), block):
            share = len(own & set(grams[at : at + 2 * block])) / len(own)
            if share >= least:
                found[name] = max(found.get(name, 0), share)
    return found


def texts():
    rng = random.Random(9)
    names = list(licenses.TEMPLATES.values())
    for i in range(250):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = rng.choice(names).split()
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
        yield i, " ".join(words)


def test_equals_brute_force(spark):
    rows = list(texts()) + [(900, None), (901, ""), (None, "Released under the MIT License."), (902, "word " * 40000 + "Licensed under CC BY-NC 4.0. " + "tail " * 20000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license, r.containment) for r in licenses.scan(docs).collect())
    want = sorted((i is None, i or 0, name, share) for i, t in rows for name, share in brute(t or "").items())
    assert got == want and len(want) > 100
    assert licenses.scan(docs.limit(0)).collect() == []


def test_place(spark):
    (hit,) = licenses.Scanner().scan("one two three Released under the MIT License. four five")
    assert hit == ("MIT", 1.0, 3, 5)


def test_bands_keep_the_promise():
    rng = np.random.default_rng(1)
    missed = 0
    for trial in range(200):
        scanner = licenses.Scanner(seed=trial)
        text = "a b c d e f g " + licenses.TEMPLATES["Unlicense"] + " h i j k l m n o p"
        missed += not any(n == "Unlicense" for n, *_ in scanner.scan(" ".join(f"w{x}" for x in rng.integers(0, 99, 9)) + " " + text))
    assert missed == 0


def test_full_texts_and_repeated_rows(spark):
    rng = random.Random(4)
    names = ["MIT-text", "ISC-text", "Apache-2.0-notice", "GPL-notice", "AGPL-3.0-section", "Unlicense-text"]
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(i, f"{filler(300)} {licenses.TEMPLATES[name].upper()} {filler(700)}") for i, name in enumerate(names)]
    docs = spark.createDataFrame(rows + rows[:2] + [(None, rows[2][1])], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.license) for r in licenses.scan(docs).collect() if r.license in names)
    assert got == sorted((i is None, i or 0, names[i or 0] if i is not None else names[2]) for i in [*range(6), 0, 1, None])


def test_containment_is_of_shingles_not_of_hashes(monkeypatch):
    """Even where all hashes collide, only texts that hold the shingles match."""
    monkeypatch.setattr(licenses.xxhash, "xxh64_intdigest", lambda shingle: 7)
    scanner = licenses.Scanner()
    assert scanner.scan("a wholly different text of some more than five words") == []
    assert ("MIT", 1.0, 0, 5) in scanner.scan("Released under the MIT License")


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.license, r.containment) for r in queries.op1_licenses(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((r.doc_id, name, share) for r in rows for name, share in brute(r.text or "").items()) and got
