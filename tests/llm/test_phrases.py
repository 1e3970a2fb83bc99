import random
import re
from collections import Counter

from pyspark.sql import functions as F

from siltworks.llm import phrases


def brute(rows, longest=3, least=10, inside=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        some = {g: c for g, c in counts.items() if c >= least and len(g) > 1}
        kept = []
        for g, a in some.items():
            score, k = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            longer = [c for h, c in some.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * c >= inside * a for c in longer):
                kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, rows, words):
    rng = random.Random(seed)
    cuts = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?", ";"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(["The", "the", "sea", "SEA", "é", "É", "a\xa0b", "of", " ", "\x1c"]) + rng.choice(cuts) for _ in range(rng.randrange(words)))) for _ in range(rows)]


ODD = [("en", None), ("en", ""), (None, None), ("fr", " \t\n.,"), ("en", "x y z " * 40_000), ("en", "Same piece here. " * 30), ("en", "Same piece here. " * 30), ("de", "ab c. a bc. " * 20)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i % 3, *r, i, i) for i, r in enumerate(rows)], "doc_id long, lang string, text string, gram int, f int").repartition(parts)


def test_equals_brute_force(spark):
    rows = texts(1, 120, 60) + ODD
    for options in ({}, {"least": 2, "inside": 90, "top": 20}, {"longest": 4, "least": 3}, {"longest": 2}):
        got = sorted(map(tuple, phrases.best(frame(spark, rows), **options).collect()))
        assert got == brute(rows, **options) and got
    assert phrases.best(frame(spark, rows).limit(0)).collect() == []
    assert phrases.best(frame(spark, [("en", None), (None, " .")])).collect() == []


def test_blocks_and_hot_parts(spark, monkeypatch):
    """Blocks of few words, a word that most requests ask for, and a crowded table of marks."""
    monkeypatch.setattr(phrases, "BLOCK", 50)
    for bits in (16, 25):
        monkeypatch.setattr(phrases, "MARKS", bits)
        marks = phrases.marks_of(spark.createDataFrame([("en", f"a{i} é") for i in range(5000)], "lang string, gram string"))
        hashes = phrases.mixed([phrases.hashed(["en"] * 5000), phrases.hashed(f"a{i}" for i in range(5000)), phrases.hashed(["é"] * 5000)])
        assert len(marks) == 2**bits // 8 and phrases.has(marks, hashes).all() and not phrases.has(marks, ~hashes).all()
    rng = random.Random(2)
    rows = [("en", f"the w{rng.randrange(400)} the w{rng.randrange(400)}") for _ in range(3000)]
    assert sorted(map(tuple, phrases.best(frame(spark, rows), least=2).collect())) == brute(rows, least=2)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of millions of millions: a * a * 1000000 has 31 digits."""
    plain, times = phrases.frequent, 10**12 + 1
    monkeypatch.setattr(phrases, "frequent", lambda *a: plain(*a).withColumn("f", F.col("f") * times))
    rows = [("en", "p q. " * 12 + "p r. s q. s")] * 3
    got = {r.phrase: tuple(r)[3:] for r in phrases.best(frame(spark, rows)).collect()}
    a, left, right = 36 * times, 39 * times, 39 * times
    assert got == {"p q": (a, left, right, 87 * times, 1000000 * a * a // (left * right))}
