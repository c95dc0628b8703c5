"""Archive records whose header block is long."""

from __future__ import annotations

from pulsegrid.llm import warc


def test_warc_long_urls(spark):
    rows = [(k, f"data:text/html,{k}" + "a%20" * n, html) for k, (n, html) in enumerate([(50_000, "x" * 2000), (50_000, "x" * 2000), (17_000, None), (600_000, "y"), (1, "z")])]
    got = {r["page_id"]: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r["url"] for k, r in got.items()} == {k: url for k, url, _ in rows}
    assert (got[0]["record_type"], got[0]["refers_to"], got[1]["record_type"]) == ("revisit", 1, "response")
    assert all(bytes(got[k]["payload"]) == (html or "").encode() for k, _, html in rows if k)
