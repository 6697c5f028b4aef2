"""Phrase mining against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import compare
import numpy as np
import pytest

from framelake.llm import phrases
from framelake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def counted(rows):
    """(lang, words) -> count, for phrases of one to five words."""
    out = Counter()
    for _, text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 6):
                out.update(("und" if lang is None else lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return out


def expected(rows, least, top):
    f = counted(rows)
    n = Counter()
    for (lang, words), a in f.items():
        n[lang] += a * (len(words) == 1)
    chosen = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, w[i:j]) for (lang, w), a in chosen.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and f[lang, w[i:j]] <= a}
    out = {}
    for (lang, w), a in chosen.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, rank, p.decode(), -a, l, r, n, -s) for lang, own in out.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(own)[:top], 1))


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def invented(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "stock", "exchange", "été", "über", "x y", "日本", *(f"w{k}" for k in range(40))]
    fixed = ["new york stock exchange opens today in london", "to be or not to be", "a a a a a a a"]
    for k in range(n):
        parts = []
        for _ in range(r.randrange(12)):
            part = r.choice(fixed) if r.random() < 0.3 else " ".join(r.choice(words) for _ in range(r.randrange(9)))
            parts.append(part + r.choice([".", ",", "\n", "\t", " ", "!?", "\r\n", "  "]))
        yield k, r.choice([None, "", " "]) if r.random() < 0.05 else "".join(parts), r.choice(["en", "de", None, ""])


@pytest.mark.parametrize("bucket", [1 << 20, 2000])
def test_against_plain_counts(spark, monkeypatch, bucket):
    """With many buckets, most phrases of one word lie in several of them."""
    monkeypatch.setattr(phrases, "BUCKET", bucket)
    monkeypatch.setattr(phrases, "SLICE", 3000)
    rows = list(invented(1, 400))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as phrase", "1 as f").repartition(3)
    for least, top in ((3, 2000), (2, 50), (20, 7)):
        assert found(phrases.collocations(df, least, top)) == expected(rows, least, top)


def test_query_against_sql(spark):
    assert compare.differences(compare.connect("/root/testdata/sf0.01"), QUERIES["op12_phrase_mining"](spark, "/root/testdata/sf0.01"), ORACLE_SQL["op12_phrase_mining"]) is None


def test_empty_and_hot(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "one", "en")], SCHEMA)).count() == 0
    rows = [(k, "Same old words again. " * 5, "en") for k in range(60)] + [(99, "w " * 30_000, "en")]
    assert found(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == expected(rows, 100, 2000)


def test_paths(spark):
    """A long passage without branches is one path; a branch parts it."""
    rows = [(1, "a b c d e f g h i j.", "en")] * 4 + [(2, "a b c d e f x.", "en"), (3, "q d e f g h.", "en")] * 4
    found_counts = phrases.counts(spark.createDataFrame(rows, SCHEMA).select("lang", "text"), 2)
    along, within = phrases.paths(found_counts)
    assert sorted((r.phrase, r.f, r.edges) for r in along.collect()) == [("a b c d e f", 8, 2), ("c d e f g", 4, 1), ("c d e f x", 4, 1), ("d e f g h", 8, 1), ("e f g h i j", 4, 2), ("q d e f g", 4, 1)]
    assert sorted(r.phrase for r in within.collect()) == ["b c d e", "f g h i"]


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    counts = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 10**9 + 7), ("en", 1, "b", 3 * 10**8), ("en", 2, "a b", 10**8 + 1)]
    df = spark.createDataFrame(counts, "lang string, size int, phrase string, f long")
    chosen = df.filter("size = 2").selectExpr("lang", "phrase", "size", "f as a")
    assert phrases.scored(df, chosen).first().score == 1000 * (10**8 + 1) * 9 * 10**15 // ((10**9 + 7) * 3 * 10**8)


def test_dumped_edges():
    words, columns, weight, _ = phrases.edges_of("Ä b c. d e f g h i".encode())
    back, codes, weights = phrases.load(phrases.dump(words, columns, weight))
    named = sorted(tuple(back[c - 1] for c in row if c) for row in codes.T.tolist())
    assert named == sorted([("Ä".encode(), b"b", b"c"), (b"b", b"c"), (b"c",), *(tuple(x.encode() for x in "defghi"[i : i + 5]) for i in range(6))])
    assert np.array_equal(weights, weight)
