"""Cursor-paged reads: order, retries, truncation, completeness, odd answers."""

import json

import pytest

from veridex.sources import paged


def serve(pages, failures=None, hits=None):
    """fetch() over a list of pages; ``failures`` says how many attempts of a page fail."""
    asked = []

    def fetch(sweep, cursor, attempt):
        k = 0 if cursor == "*" else int(cursor)
        asked.append((k, attempt))
        if attempt <= (failures or {}).get(k, 0):
            raise paged.FetchError("HTTP 503")
        following = str(k + 1) if k + 1 < len(pages) else ""
        return {"status": 200, "hitCount": sum(map(len, pages)) if hits is None else hits, "nextCursorMark": following, "resultList": {"result": [{"id": x} for x in pages[k]]}}

    return fetch, asked


def run(pages, failures=None, hits=None, **options):
    fetch, asked = serve(pages, failures, hits)
    rows = list(paged.follow("s", fetch, **options))
    return [json.loads(r[5])["id"] for r in rows[:-1]], rows[-1][-1], asked


def test_all_pages_in_order():
    ids, outcome, _ = run([[1, 2], [3, 4], [5]])
    assert ids == [1, 2, 3, 4, 5]
    assert outcome == {"status": "ok", "hit_count": 5, "pages": 3, "attempts": 3, "retrieved": 5, "pagination_complete": True, "detail": ""}


def test_a_page_is_asked_again():
    ids, outcome, asked = run([[1], [2], [3]], {1: 2})
    assert ids == [1, 2, 3] and outcome["pagination_complete"] and outcome["attempts"] == 5 and asked[1:4] == [(1, 1), (1, 2), (1, 3)]


def test_a_failed_page_truncates_and_a_failed_first_page_is_unavailable():
    ids, outcome, _ = run([[1], [2], [3]], {2: 3})
    assert ids == [1, 2] and outcome["status"] == "ok" and not outcome["pagination_complete"] and outcome["detail"] == "HTTP 503"
    ids, outcome, _ = run([[1], [2]], {0: 3})
    assert ids == [] and outcome["status"] == "unavailable" and outcome["hit_count"] is None and not outcome["pagination_complete"]


def test_hits_that_never_come_are_said():
    _, outcome, _ = run([[1], [2]], hits=9)
    assert outcome["pagination_complete"] and outcome["detail"] == "9 hits were reported and 2 came on all pages"


def test_no_hits_and_a_limit():
    assert run([[]])[1]["status"] == "no_hits" and run([[]])[1]["pagination_complete"]
    ids, outcome, _ = run([[1, 2], [3, 4], [5]], limit=3)
    assert ids == [1, 2, 3, 4] and not outcome["pagination_complete"]
    assert run([[1, 2], [3]], limit=3)[1]["pagination_complete"]


def test_a_repeated_cursor_ends_the_sweep():
    rows = list(paged.follow("s", lambda *_: {"status": 200, "hitCount": 2, "nextCursorMark": "*", "resultList": {"result": [{"id": 1}, "text"]}}))
    assert len(rows) == 2 and rows[-1][-1]["retrieved"] == 1


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/pages"


def test_recorded_pages_come_back_through_the_source(spark, folder):
    from pyspark.sql import functions as F

    rows = [(i, "a/ä *" if i % 3 else None, f"text {i} \"quoted\"\n") for i in range(100)]
    df = paged.sliced(spark.createDataFrame(rows, "k bigint, source string, body string"), "source", "k", 30)
    written = paged.record_pages(df, folder, "k", ["k", "body"], F.when(F.col("first") == 1, 1).when(F.col("first") == 36, 3).otherwise(0), page_rows=6)
    assert written.count() > 10
    read = paged.read_sweeps(spark, folder).cache()
    outcome = {r.sweep: r for r in paged.outcomes(read).collect()}
    assert sum(r.hit_count or 0 for r in outcome.values()) <= 100 and len(outcome) == df.select("sweep").distinct().count()
    assert sum(not r.pagination_complete for r in outcome.values()) == 1
    found = paged.records(read, "k bigint, body string").collect()
    assert {(r.k, r.body) for r in found} <= {(r[0], r[2]) for r in rows} and len({r.k for r in found}) == len(found) == sum(r.retrieved for r in outcome.values())
    assert len(found) < 100 and any(r.attempts == 2 for r in found)
    assert all(r.pagination_complete == outcome[r.sweep].pagination_complete for r in found)
    read.unpersist()


def test_broken_and_missing_answers_are_failures(spark, tmp_path, folder):
    home = tmp_path / "pages" / "s"
    home.mkdir(parents=True)
    (home / "%2A.1.json").write_text("<html>busy</html>")
    (home / "%2A.2.json").write_text('{"status": 200, "hitCount": 4, "nextCursorMark": "gone", "resultList": {"result": [{"k": 1}]}}')
    outcome = paged.outcomes(paged.read_sweeps(spark, folder, attempts=2)).first()
    assert outcome.retrieved == 1 and not outcome.pagination_complete and outcome.attempts == 4 and "no answer is recorded" in outcome.detail
    assert paged.read_sweeps(spark, f"file://{tmp_path}/nothing").count() == 0
