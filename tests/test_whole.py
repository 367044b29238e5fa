"""Queries that once took a part of their input, on small tables against brute force."""

import datetime as dt
from collections import Counter

from millrace.plans import catalog


def test_whole_texts_are_escaped(spark, tmp_path):
    texts = ["", "plain", "naïve", "é", "日本", "x" * 500 + "é日" + "y" * 300 + "ü", "ä" * 450, "a\nb\tc\x7f\x80", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalog.QUERIES["escape_unicode"](spark, str(tmp_path)).collect()))
    assert got == {i: t and "".join(c if ord(c) < 128 else f"\\u{ord(c):04x}" for c in t) for i, t in enumerate(texts)}


def test_events_reach_all_pages(spark, tmp_path):
    """Ids with gaps, over more than one range, and pages that share a path; the last row stays away for want of an id."""
    ids = [*range(0, 240, 2), *range(4090, 4110), 9000, 9001]
    pages = [(i, f"https://h{i % 3}.org/p{i // 2}") for i in ids]
    events = [(7 * i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(700)]
    spark.createDataFrame([*pages, (None, "https://h.org/none")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    want = Counter((ts.day, "/" + pages[i % len(pages)][1].split("/", 3)[3]) for i, ts in events)
    got = [(r["day"], r["url"], r["n"]) for r in catalog.QUERIES["top_urls_daily"](spark, str(tmp_path)).collect()]
    assert got == sorted(((*k, n) for k, n in want.items()), key=lambda r: (-r[2], r[0], r[1]))
    assert len({u for _, u, _ in got}) == len({u for _, u in want}) > 50
