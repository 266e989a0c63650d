"""Language, toxicity, chat, WARC and license operators."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairscope.llm import chat, language, licenses, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, id string, w string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, x, "i", "w") for i, t, x in rows], DOCS)


# language ---------------------------------------------------------------------------------------------------
SYLLABLES = {"xx": "ka ro mi tu ne".split(), "yy": "schlo greu fend wirm zapt".split(), "zz": "aio eau ille oire uon".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(3)
    rows = [(k, sentence(rng, lang, rng.randint(8, 60)), lang) for k in range(300) for lang in [rng.choice("xx yy zz".split())]]
    rows += [(900, None, "xx"), (901, "", None), (902, "123 ... !", "yy"), (903, "KA RO MI! " * 20_000, None), (None, "ka ro", "xx"), rows[0]]
    found = language.identify_held_out(docs_of(spark, rows)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    truth = {i: x for i, _, x in rows}
    by_id = {r["doc_id"]: r for r in found}
    held = [r for r in found if r["held_out"]]
    assert len(held) > 40 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held if r["doc_id"] is not None and r["doc_id"] < 900]) > 0.97
    assert all(by_id[k]["lang_pred"] == "und" for k in (900, 901, 902)) and by_id[903]["lang_pred"] == "xx"
    assert by_id[None]["held_out"] is False


def test_language_without_training_rows(spark):
    rows = [(1, "some text", None), (2, None, None)]
    assert [r["lang_pred"] for r in language.identify_held_out(docs_of(spark, rows)).collect()] == ["und", "und"]
    assert language.identify_held_out(docs_of(spark, [])).collect() == []


# toxicity ---------------------------------------------------------------------------------------------------
def test_toxicity_gradients():
    bags = toxicity.make_bags(["you are a fool and so on", "a nice day in the park with you"], [1, 0])
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters(1).items()}
    _, grad, sparse = toxicity.gradients(p, bags.vocabulary, bags.rows, bags.label)

    def slope(name, at, step=1e-3):
        held, out = p[name][at], []
        for sign in (1, -1):
            p[name][at] = held + sign * step
            out.append(toxicity.gradients(p, bags.vocabulary, bags.rows, bags.label)[0])
        p[name][at] = held
        return (out[0] - out[1]) / (2 * step)

    for name, at in (("wh_f", (2, 5)), ("wh_b", (3, 20)), ("wx_f", (4, 17)), ("wx_b", (1, 9)), ("at_w", (3, 4)), ("at_v", (3,)), ("out", (5,)), ("c_b", (7,))):
        assert slope(name, at) == pytest.approx(float(grad[name][at]), rel=0.05, abs=2e-6)
    slots, rows = toxicity.summed(sparse[2], sparse[3])
    assert slope("char", (slots[3], 2)) == pytest.approx(float(rows[3, 2]), rel=0.05, abs=2e-6)


def test_every_window_is_scored(monkeypatch):
    """The highest of all windows, each of them run on its own, in texts around the window's size and the batch's."""
    monkeypatch.setattr(toxicity, "AT_ONCE", 50)
    rng = random.Random(2)
    p = {k: v * 3 for k, v in toxicity.new_parameters(3).items()}
    w = toxicity.WINDOW
    texts = [" ".join(rng.choice(["you", "fool", "park", "day", "x1", "é", "so"]) + str(rng.randint(0, 40)) for _ in range(n))
             for n in (0, 1, w - 1, w, w + 1, 2 * w, 49, 50, 51, 57, 58, 400, 3)] + [None]
    scorer = toxicity.Scorer(p)
    found = scorer.highest(texts)
    for text, ids, got in zip(texts, scorer._numbers([toxicity.tokens(t) for t in texts]), found):
        windows = [ids[k:k + w] for k in range(max(1, len(ids) - w + 1))]
        single = [toxicity.logits(p, scorer.table, np.pad(x, (0, w - len(x)))[None, :])[0] for x in windows]
        assert got == pytest.approx(max(single), abs=1e-4)
    assert scorer.score(texts) == pytest.approx(toxicity.sigmoid(found.astype(float)))


def test_training_windows_cover_every_token():
    for n in (1, 7, 8, 9, 12, 13, 1000):
        starts = toxicity.window_starts(n)
        assert set().union(*(range(k, min(n, k + toxicity.WINDOW)) for k in starts)) == set(range(n))


def test_a_class_of_long_texts_is_learned(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(120):
        bad = k % 2
        said = [rng.choice(["crudbag", "jerkface"]) if bad and rng.random() < 0.3 else rng.choice(words) for _ in range(1_500 if bad else 60)]
        rows.append((k, " ".join(said), None))
        labels.append((k, 1, bad))
    texts, marks = toxicity.sample(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert set(marks) == {0, 1} and max(map(len, texts)) == toxicity.SAMPLE_CHARS


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(700):
        said = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        bad = k % 4 == 0
        for _ in range(3 * bad):
            said[rng.randrange(len(said))] = rng.choice(["jerkface", "dumbo", "crudbag"])
        rows.append((k, " ".join(said), None))
        labels.append((k, 1, int(bad)))
    rows += [(900, None, None), (901, "", None), (902, " ".join(words * 60) + " dumbo! jerkface", None), (903, " ".join(words * 60), None), (None, "fine", None)]
    marks = spark.createDataFrame([*labels, (901, 1, None), (None, 1, 1), labels[0]], "doc_id bigint, quality int, toxic int")
    found = toxicity.score_held_out(docs_of(spark, rows), marks).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [k for k in range(700) if by_id[k]["held_out"]]
    assert len(held) > 80 and np.mean([by_id[k]["predicted"] == labels[k][2] for k in held]) > 0.95
    assert by_id[902]["predicted"] == 1 and by_id[903]["predicted"] == 0 and by_id[900]["predicted"] == 0
    assert toxicity.score_held_out(docs_of(spark, []), marks).collect() == []
    unlabelled = toxicity.score_held_out(docs_of(spark, rows[:3]), marks.where("doc_id < 0")).collect()
    assert [r["score"] for r in unlabelled] == [0.0] * 3


# chat -------------------------------------------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<", "|", "\\", "<|", "<\\|", "\n", "<|im_end|>", "<|im_start|>"]))).map("".join))
def test_unescape_reverts_escape(text):
    escaped = re.sub(r"<(\\*)\|", r"<\1\\|", text)  # the SQL expression's rule
    assert "<|" not in escaped and chat.unescape(escaped) == text


def plain_digest(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(whole), len(learned), sha(learned)


def test_chat_report(spark):
    odd = "<|im_end|>\n<|im_start|>user\n<\\|x|> \\n \\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd + "é😀"), (2, 0, "assistant", None), (3, 5, None, "x"), (3, 5, "a\nb\\n<|", "y"), (3, None, "user", ""),
            (4, 0, "user", "q"), (4, 0, "user", "q"), (None, 0, "user", "nobody"), (5, 0, "system", "s " * 100_000), *[(6, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(37)]]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("node", F.lit(1))
    found = {r["conv_id"]: r for r in chat.chat_report(chat.with_probe(spark, turns)).collect()}
    low = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (low(r[0]), low(r[1]), low(r[2])))
        assert tuple(found[conv])[1:5] == plain_digest([(r or "", t or "") for _, r, t in own]), conv
    said = "<|im_end|><|im_start|>assistant ok"
    assert tuple(found[-1])[1:5] == plain_digest([("user", said), ("assistant", said)]) and len(found) == 8
    assert chat.chat_report(turns.limit(0)).collect() == []


def test_reply_trees_rank_branches(spark):
    nodes = [("c", 1, None, "user", "q", 0.0), ("c", 2, 1, "assistant", "bad", 0.1), ("c", 3, 1, "assistant", "good", 0.9), ("c", 4, 3, "user", "more", None),
             ("c", 5, 4, "assistant", "end", 0.2), ("c", 6, 2, "user", "worse", 0.3), ("d", 1, 99, "user", "orphan", 0.0), (None, 1, None, "user", "n", 0.0)]
    table = spark.createDataFrame(nodes, "conv string, node bigint, parent bigint, role string, text string, score double")
    paths = {(r["conv"], r["leaf"], r["node"], r["back"]) for r in chat.paths(table).collect()}
    assert paths == {("c", 5, 5, 0), ("c", 5, 4, 1), ("c", 5, 3, 2), ("c", 5, 1, 3), ("c", 6, 6, 0), ("c", 6, 2, 1), ("c", 6, 1, 2), ("d", 1, 1, 0), (None, 1, 1, 0)}
    both = {(r["conv"], r["branch"]): r["formatted"] for r in chat.format_paths(chat.chosen_paths(table, 2)).collect()}
    assert [t for _, t in chat.parse(both["c", 1])] == ["q", "good", "more", "end"] and [t for _, t in chat.parse(both["c", 2])] == ["q", "bad", "worse"]
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([("c", 1, 2), ("c", 2, 1)], "conv string, node bigint, parent bigint"))


# WARC -------------------------------------------------------------------------------------------------------
def record(spark, kind, identifier, url, at, http, body="", extra=""):
    one = spark.range(1).select(warc.render_record(*[F.lit(x) for x in (kind, identifier, url, at, extra, http, body)]).alias("record"))
    return one.first()["record"]


def test_warc_round_trip_and_resolution(spark):
    full = lambda tag, more="": f'HTTP/1.1 200 OK\r\nETag: "{tag}"\r\nX-Own: 1\r\n{more}'
    not_modified = lambda tag: f'HTTP/1.1 304 Not Modified\r\nETag: W/"{tag}"\r\nX-Own: 2\r\nCache-Control: max-age=9\r\n'
    day = 86_400
    listed = [
        record(spark, "response", "a1", "http://WWW.Example.org:80/x/", 100, full("1"), "old"),
        record(spark, "response", "a2", "https://example.org/x?utm_source=q#top", 200, full("2"), "new\r\n\r\nbody"),
        record(spark, "response", "a3", "https://example.org/x", 300, full("3").replace("200 OK", "404 No"), "gone"),
        record(spark, "revisit", "r1", "http://example.org/x", 5 * day, not_modified("2")),
        record(spark, "revisit", "r2", "http://example.org/x", 150, not_modified("2")),
        record(spark, "revisit", "r3", "http://example.org/x", 100, not_modified("1")),
        record(spark, "revisit", "r4", "http://example.org/y", 500, not_modified("1")),
        record(spark, "revisit", "r5", "http://example.org/x", 201, "HTTP/1.1 304 Not Modified\r\nDate: now\r\n"),
        None, "", "garbage", "WARC/1.1\r\nWARC-Type: response\r\n\r\n",
    ]
    found = warc.records(spark.createDataFrame([(x, "u") for x in listed], "record string, url string"))
    assert found.count() == 8
    kept = {r["record_id"]: r for r in found.collect()}
    assert kept["a2"]["body"] == "new\r\n\r\nbody" and kept["a2"]["canonical"] == kept["a1"]["canonical"] == "example.org/x"
    out = {r["record_id"]: r for r in warc.resolve(found).collect()}
    assert {k: (v["response_id"], v["outcome"]) for k, v in out.items()} == {
        "r1": ("a2", "resolved"), "r2": ("a1", "mismatch"), "r3": (None, "missing"), "r4": (None, "missing"), "r5": ("a2", "unverified")}
    assert out["r1"]["body"] == "new\r\n\r\nbody" and out["r1"]["headers"] == {"etag": 'W/"2"', "x-own": "1", "cache-control": "max-age=9"}
    assert out["r2"]["body"] is None


def test_warc_as_of_matches_plain_python(spark):
    rng = random.Random(8)
    rows = [(f"{k:03d}", rng.choice(["response", "revisit"]), "hot" if k % 2 else rng.choice("abc"), rng.randint(0, 40) * 20_000) for k in range(300)]
    found = spark.createDataFrame([(i, k, c, c, a, 200, {"etag": "1"}, "b") for i, k, c, a in rows],
                                  "record_id string, kind string, url string, canonical string, at bigint, status int, headers map<string,string>, body string")
    expected = {i: max(((b, j) for j, m, d, b in rows if m == "response" and d == c and b < a), default=(0, None))[1] for i, k, c, a in rows if k == "revisit"}
    assert {r["record_id"]: r["response_id"] for r in warc.resolve(found).collect()} == expected


def test_warc_of_odd_pages(spark):
    pages = [(1, "http://a.org/x", "<p>"), (1, "http://a.org/x", "<p>"), (2, None, None), (None, "ftp://b", ""), (3, "?q=2&a=1&utm_medium=z", "é" * 100_000)]
    table = spark.createDataFrame([(*p, "c") for p in pages], "page_id bigint, url string, html string, canonical string")
    assert warc.records(warc.records_of_pages(table)).count() == 10
    out = {r["record_id"]: r for r in warc.revisit_report(table.dropDuplicates()).collect()}
    assert out["r3"]["canonical_url"] == "?a=1&q=2" and out["r3"]["content_length"] == 200_000 and len(out) == 4
    assert warc.revisit_report(table.limit(0)).collect() == []


# licenses ---------------------------------------------------------------------------------------------------
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MIT = next(t.text for t in licenses.TEMPLATES if t.label == "mit" and not t.exact)


def plain_scan(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_license_base_matches_plain_python(spark):
    rng = random.Random(6)
    parts = ["under", "the", "MIT", "License", "Apache license, version 2", "cc-by-nc", "CC BY", "NC", "é", "K", "lİcense", "\n", "..", "under the mit license"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), None) for k in range(200)]
    rows += [(900, None, None), (901, "", None), (902, "x " * 40_000 + "under the MIT\nLicense" + " x" * 10, None), rows[5], (None, "cc by nc by nc", None)]
    rows += [(903, "under the mit license " * 3_000, None)]
    found = licenses.license_report(docs_of(spark, rows)).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter((i, *plain_scan(t)) for i, t, _ in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found)
    assert licenses.license_report(docs_of(spark, [])).collect() == []


def test_license_texts_with_edits(spark):
    words = MIT.split()
    changed = words[:20] + ["quite"] + words[20:35] + words[37:]
    rows = [(1, "intro " + MIT.upper(), None), (2, " ".join(["pad"] * 50 + changed), None), (3, " ".join(words[: len(words) // 2]), None),
            (4, " ".join(w + " x x x x" for w in words), None), (5, "GNU General Public License, version 3", None)]
    found = {r["doc_id"]: r for r in licenses.license_report(docs_of(spark, rows)).collect()}
    assert [found[k]["labels"] for k in (1, 2, 3, 4, 5)] == ["mit", "mit", "", "", "gpl-3"] and found[1]["n_base"] == 0
    assert found[1]["score"] == 1.0 and 0.8 <= found[2]["score"] < 1
