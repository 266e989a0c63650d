"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairscope.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    forms, near = {}, {}
    for w in counts:
        found = [v for v in counts if one_edit(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, near[w], counts.get(forms.get(w))))
    return out


def edited(rng, word):
    k, letter = rng.randrange(len(word)), rng.choice("abàÿ")
    return rng.choice([word[:k] + word[k + 1:], word[:k] + letter + word[k:], word[:k] + letter + word[k + 1:]])


def corpus(seed=2):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcàé") for _ in range(rng.randint(5, 11))) for _ in range(40)]
    known = stems + [edited(rng, edited(rng, s)) for s in stems for _ in range(4)] + [edited(rng, s) for s in stems for _ in range(4)]
    # one half that most words share
    known += ["common" + "".join(rng.choice("xy") for _ in range(rng.randint(4, 7))) for _ in range(120)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab"]
    weights = [rng.choice([1, 1, 8, 60]) for _ in known]
    rows = []
    for k in range(300):
        words = rng.choices(known, weights, k=rng.randint(0, 120))
        rows.append((k, rng.choice([" ", ", ", "\n", "_1_"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows + [rows[3], (None, rows[4][1]), (500, None), (501, ""), (502, "Übermut ÜBERMUT übermut ×÷ " * 40), (503, "z" * 50_000),
                   (504, "lanterns " * 200 + "lantern " * 30 + "lanter " * 5)]


@pytest.mark.parametrize("tile", [8, 64, spelling.TILE])
def test_variants_match_all_pairs(spark, tile):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id bigint, text string, n int, word string")
    found = spelling.spelling_variants(docs, tile=tile).collect()
    expected = plain_variants(plain_counts(rows))
    assert len(found) == len(expected) > 200 and {tuple(r) for r in found} == expected
    assert max(e[4] for e in expected) > 5 and any(e[:3] == ("lanter", "lantern", "lanterns") for e in expected)


def test_variants_of_an_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect() == []


def test_long_chain_of_forms(spark):
    # every form is five times as frequent as its variant, so a chain of nine needs 5 ^ 9 occurrences: given as forms here
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)] + [(f"x{k}", "w5") for k in range(50)], "word string, form string")
    found = {r["word"]: r["root"] for r in spelling.roots(forms).collect()}
    assert set(found.values()) == {"w9"} and len(found) == 59


def test_query_over_the_small_table(spark):
    from pairscope.llm.queries import op12_spelling_variants

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect()]
    assert {tuple(r) for r in op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()} == plain_variants(plain_counts(rows))
