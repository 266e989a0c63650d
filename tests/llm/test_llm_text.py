"""Exact and near deduplication, quality rules, tokenisation and mixing against plain Python."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from pairscope.llm import bpe, exact_dedup, mixing, quality, simhash

DOCS = "doc_id bigint, text string, source string, _key string, _SHA string, text_ string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """doc_id, text, source and columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, s, "k", "s", "t") for i, t, s in rows], DOCS)


def varied(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = [(0, None, "a"), (1, "", "a"), (2, " \t\n", None), (None, "no identifier", "b"), (3, "long " * 30_000, "b")]
    for k in range(10, 10 + n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        rows.append((k, "the same text" if k % 3 == 0 else text + rng.choice(["", "\n" + text, "\n###|"]), rng.choice(["a", "b", "c", None])))
    return rows + [rows[20]]


# exact ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_match_grouping_by_text(spark, keep):
    rows = varied()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    order = lambda i: -1 if i is None else i
    pick = min if keep == "smallest" else max
    expected = Counter()
    for i, t, _ in rows:
        group = groups[t or ""]
        best = pick(group, key=order)
        expected[(i, best, len(group), i == best, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    found = exact_dedup.exact_groups(docs_of(spark, rows), keep=keep)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, found.collect())) == expected


def test_exact_large_group_is_salted_and_merged(spark):
    rows = [(k, "copy" if k < 200 else f"text {k}", "a") for k in range(300)]
    found = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs_of(spark, rows)).collect()}
    assert {found[k]["keep_id"] for k in range(200)} == {0} and found[7]["group_size"] == 200
    assert sum(r["kept"] for r in found.values()) == 101


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    rows = varied()
    kept = exact_dedup.exact_dedup(docs_of(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert len(kept.collect()) == len({t or "" for _, t, _ in rows})


def test_exact_empty_table(spark):
    assert exact_dedup.exact_groups(docs_of(spark, [])).collect() == []
    assert exact_dedup.exact_dedup(docs_of(spark, [])).collect() == []


# near -------------------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    grams = [" ".join(found[k:k + 3]) for k in range(max(1, len(found) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, near):
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    listed = sorted(points)
    for i, a in enumerate(listed):
        for b in listed[i + 1:]:
            if near(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


def near_rows():
    rng = random.Random(5)
    rows = varied(60) + [(900, "", "a"), (901, "  ", "a")]
    for g in range(6):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(400)]
        for k in range(8):
            edited = list(base)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(400)] = "edit" + str(rng.randint(0, 9))
            rows.append((1000 + 10 * g + k, " ".join(edited), "a"))
    return rows


def test_near_groups_match_all_pairs(spark):
    rows = near_rows()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    roots = plain_components(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    expected = Counter((i, f"{p:016x}", least.get(roots[p])) for (i, _, _), p in zip(rows, prints))
    found = simhash.near_groups(docs_of(spark, rows)).collect()
    assert Counter(map(tuple, found)) == expected
    assert len({r["component_id"] for r in found}) < len({r["fingerprint"] for r in found})
    kept = simhash.near_dedup(docs_of(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in set(least.values())} | ({None} & {i for i, *_ in rows if least.get(roots[plain_fingerprint("no identifier")]) is None})
    assert kept.columns == docs_of(spark, []).columns
    assert simhash.near_groups(docs_of(spark, [])).collect() == []


def test_links_connect_as_all_pairs_do(spark):
    rng = random.Random(9)
    points = {rng.getrandbits(64) for _ in range(20)}
    for p in list(points):
        for _ in range(12):
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in points], "fp bigint")).collect()
    edges = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in found}
    assert all((min(e) ^ max(e)).bit_count() <= 2 for e in edges)
    assert plain_components(points, lambda a, b: frozenset((a, b)) in edges) == plain_components(points, lambda a, b: (a ^ b).bit_count() <= 2)


# quality ----------------------------------------------------------------------------------------------------
def plain_measures(text):
    text = text or ""
    found = WORD.findall(text)
    grams = Counter(zip(found, found[1:], found[2:]))
    repeated = {k + j for k in range(len(found) - 2) if grams[tuple(found[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def plain_kept(text):
    n, chars, symbols, dups, repeats = plain_measures(text)
    return not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > 3 * n or 10 * dups > n or chars < 2 * n or chars > 14 * n)


def test_quality_measures_and_verdicts(spark):
    rows = varied(200) + [(500, "a b c a b c d\nx y\nx y\n", "a"), (501, "a b c", "a"), (502, "é ü a b " * 3 + "#<>", "a"), (503, "x " * 60, None)]
    found = quality.verdicts(docs_of(spark, rows)).collect()
    expected = Counter((i, *plain_measures(t), (m := plain_measures(t))[0] < 50 or 100 * m[4] > 50 * m[0], plain_kept(t)) for i, t, _ in rows)
    assert Counter(map(tuple, found)) == expected
    kept = quality.passing(docs_of(spark, rows))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t, _ in rows if plain_kept(t)) and kept.columns == docs_of(spark, []).columns
    assert quality.verdicts(docs_of(spark, [])).collect() == []


def test_quality_verdict_is_the_same_in_any_order(spark):
    rows = varied(80)
    turned = quality.passing(docs_of(spark, rows), rules=tuple(reversed(quality.RULES)))
    assert Counter(r["doc_id"] for r in turned.collect()) == Counter(i for i, t, _ in rows if plain_kept(t))
    assert sorted(r.name for r in quality.order_rules(docs_of(spark, rows))) == sorted(r.name for r in quality.RULES)


# tokens -----------------------------------------------------------------------------------------------------
LIBRARY = Tokenizer.from_file(VOCABULARY)
OWN = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(
    ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL ", "ΑΣ", "İ", "ﬁ", "\x1c", " ", "́", "a" * 70, "the quick"]))).map("".join))
def test_bpe_agrees_with_the_library(text):
    theirs = LIBRARY.encode(text, add_special_tokens=False).ids
    ours = OWN.encode(text)
    decoded = LIBRARY.decode(theirs, skip_special_tokens=False)
    assert ours == theirs and OWN.decode(ours) == decoded
    assert OWN.digest(text) == (len(theirs), _sha(" ".join(map(str, theirs))), _sha(decoded))


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_frames(spark):
    rows = varied(30)
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs_of(spark, rows), VOCABULARY).collect()}
    expected = {(i, len(e := LIBRARY.encode(t or "", add_special_tokens=False).ids), _sha(" ".join(map(str, e))),
                 _sha(LIBRARY.decode(e, skip_special_tokens=False))) for i, t, _ in rows}
    assert found == expected
    encoded = bpe.encode(docs_of(spark, rows), VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, VOCABULARY).collect()}
    assert texts[3] == "long</w> " * 29_999 + "long</w>" and texts[0] == texts[1] == ""
    assert bpe.digests(docs_of(spark, []), VOCABULARY).collect() == []


def test_bpe_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())
    for text in ("one two three four five", "six seven eight", "one nine ten eleven"):
        assert own.digest(text)[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_bpe_refuses_other_files():
    other = json.loads(open(VOCABULARY, encoding="utf-8").read())
    other["normalizer"] = None
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(other))


# mixing -----------------------------------------------------------------------------------------------------
def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, free = float(sum(sizes.values())), {}, set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 40))), "big" if k % 3 == 0 else rng.choice(["a", "b", "z", None, "é"])) for k in range(600)]
    rows += [(700, None, "empty"), (701, "", "empty"), (702, "x " * 50_000, "long")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = plain_targets(sizes)
    found = mixing.mix(docs_of(spark, rows)).collect()
    source, by_source = {i: s for i, _, s in rows}, defaultdict(int)
    assert len(found) == len(rows)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * (1 + target[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by_source[s] += r["taken"]
    longest = {s: max(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(by_source[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs_of(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in found}


def test_mixed_documents_repeat_rows(spark):
    rows = [(k, "a b c", "small" if k < 10 else "large") for k in range(100)]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs_of(spark, rows)).collect()}
    mixed = mixing.mixed_documents(docs_of(spark, rows))
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: n for k, n in plan.items() if n})
    assert mixed.columns == docs_of(spark, []).columns
    assert mixing.mixed_documents(docs_of(spark, [])).collect() == [] and mixing.mix(docs_of(spark, [])).collect() == []


def test_mixed_documents_of_repeated_and_missing_identifiers(spark):
    rows = [(k % 5 if k % 7 else None, "word " * (1 + k % 9), "a" if k % 3 else "b") for k in range(90)]
    docs = docs_of(spark, rows)
    target = {r["source"]: r["target"] for r in mixing.targets(docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("source_size"))).collect()}
    taken = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - target[s]) <= 4.5 for s in target)
    plan = [tuple(r) for r in mixing.mix(docs).collect()]
    assert len(plan) == 90 and sum(r[-1] for r in plan) == sum(taken.values())


def test_exact_groups_of_one_identifier(spark):
    rows = [(7, "copy", "a")] * 4_000 + [(None, "copy", "a")] * 2_000 + [(k, f"text {k}", "a") for k in range(100, 160)]
    found = exact_dedup.exact_groups(docs_of(spark, rows), keep="largest").groupBy("keep_id", "group_size", "kept").count().where("group_size > 1").collect()
    assert {tuple(r) for r in found} == {(7, 6_000, True, 4_000), (7, 6_000, False, 2_000)}


def _grams(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4))}


# pipeline ---------------------------------------------------------------------------------------------------
def test_pipeline_matches_plain_python(spark):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table if plain_kept(r["text"])]
    first = {}
    for i, t, s in sorted(rows):
        first.setdefault(t, (i, t, s))
    rows = list(first.values())
    # groups of texts that five-word shingles link at a similarity of 0.8
    grams = {t: _grams(t) for _, t, _ in rows}
    roots = plain_components(set(grams), lambda a, b: 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]))
    least = {}
    for i, t, s in sorted(rows):
        least.setdefault(roots[t], (i, t, s))
    assert len(least) < len(rows)
    rows = list(least.values())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    target, taken, expected = plain_targets(sizes), defaultdict(int), Counter()
    for i, t, s in sorted(rows, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
        n = len(WORD.findall(t))
        epochs = int(target[s] // sizes[s])
        copies = min(3, epochs + (2 * taken[s] + n < 2 * (target[s] - epochs * sizes[s])))
        taken[s] += n
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        expected[(i, len(ids), _sha(" ".join(map(str, ids))), _sha(LIBRARY.decode(ids, skip_special_tokens=False)))] += copies
    found = Counter(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()))
    assert found == +expected and len(found) > 20


def test_short_and_long_merges_give_the_same_ids(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = bpe.Bpe(f.read())
    rng = random.Random(8)
    for n in range(1, bpe._SHORT + 1):
        symbols = [rng.choice(vocabulary.inner[97:106]) for _ in range(n)]
        short = vocabulary.merge(list(symbols))
        monkeypatch.setattr(bpe, "_SHORT", 0)
        assert vocabulary.merge(list(symbols)) == short
        monkeypatch.undo()
