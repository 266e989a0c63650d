"""Revisits of pages whose rows or identifiers repeat."""

import hashlib
from collections import Counter

from pairscope.llm import warc


def test_one_row_per_revisit_of_repeated_pages(spark):
    pages = [(1, "http://a.org/x", "<p>")] * 4 + [(None, f"http://b.org/{k}", f"body {k}") for k in range(6)] + [(None, "http://b.org/1", "other")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    out = warc.revisit_report(table).collect()
    assert len(out) == len(pages)
    assert Counter((r["record_id"], r["canonical_url"]) for r in out) == Counter(
        ("r1" if i else "r-1", u.removeprefix("http://")) for i, u, _ in pages)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {r["body_sha256"] for r in out if r["record_id"] == "r1"} == {sha("<p>")}
    assert all(r["response_id"] == "p-1" for r in out if r["record_id"] == "r-1")
    # a body is that of the revisit's own address
    for r in out:
        bodies = {sha(h) for _, u, h in pages if u.removeprefix("http://") == r["canonical_url"]}
        assert r["body_sha256"] is None or r["body_sha256"] in bodies
    assert [r["response_id"] for r in out if r["canonical_url"] == "b.org/3"] == ["p-1"]
