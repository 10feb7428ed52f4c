"""The search source against a server on this machine: pushed filters, pages, pacing, retries, the stream."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from paperloom.sources import search

ENTRIES = 25


@pytest.fixture
def server():
    asked, broken = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((time.time(), q))
            if broken:
                broken.pop()
                return self.send_error(503)
            a, n = int(q["start"]), int(q["max_results"])
            body = "<feed>" + "".join(f"<entry><id>{i}</id></entry>" for i in range(a, min(a + n, ENTRIES))) + "</feed>"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}/query", asked, broken
    running.shutdown()


def _read(spark, service, **options):
    search.register(spark)
    return spark.read.format("papersearch").options(service=service, **({"topics": "one\ntwo\nthree", "pause": 0, "maxResults": 10} | options)).load()


def test_filters_reach_the_service(spark, server):
    service, asked, _ = server
    df = _read(spark, service, dateFrom="202001010000").where("category = 'cs.LG' and date_from >= '202102010000' and date_to <= '202201010000' and topic in ('one', 'three') and xml like '%entry%'")
    rows = df.collect()
    assert sorted((r.topic, r.category, r.date_from, r.date_to, r.start) for r in rows) == [("one", "cs.LG", "202102010000", "202201010000", 0), ("three", "cs.LG", "202102010000", "202201010000", 0)]
    assert {q["search_query"] for _, q in asked} == {f"(all:{t}) AND (cat:cs.LG) AND (submittedDate:[202102010000 TO 202201010000])" for t in ("one", "three")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("Filter") :].splitlines()[0]
    assert "entry" in left and "cs.LG" not in left and "2021" not in left


def test_a_filter_that_contradicts_an_option_finds_nothing(spark, server):
    service, _, _ = server
    assert _read(spark, service, category="cs.DB").where("category = 'cs.LG'").count() == 0
    assert _read(spark, service, topics="").count() == 0


def test_pages_go_as_far_as_asked(spark, server):
    service, asked, _ = server
    assert sorted(r.start for r in _read(spark, service, topics="one").where("start < 1000").collect()) == [0, 10, 20, 30]
    assert [q["start"] for _, q in asked] == ["0", "10", "20", "30"]
    assert sorted((r.topic, r.start) for r in _read(spark, service).where("start < 15").collect()) == [(t, s) for t in ("one", "three", "two") for s in (0, 10)]


def test_tasks_keep_apart_and_retries_wait_for_their_turn(spark, server):
    service, asked, broken = server
    broken += [1, 1]
    df = _read(spark, service, pause=0.4, tries=4)
    assert df.rdd.getNumPartitions() == 3
    begun = len(asked)
    search_wait = search.fetch.__kwdefaults__["wait"]
    assert search_wait == 5.0
    assert {r.topic for r in _read(spark, service, pause=0.4, tries=4, topics="one\ntwo\nthree").where("start < 20").collect()} == {"one", "two", "three"}
    at = sorted(t for t, _ in asked[begun:])
    assert len(at) == 8 and min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.2


def test_slots_of_callers_never_meet(monkeypatch):
    now = [100.0]
    monkeypatch.setattr(search.time, "time", lambda: now[0])
    taken = []

    def sleep(seconds):
        now[0] += seconds
        taken.append(round(now[0], 6))

    monkeypatch.setattr(search.time, "sleep", sleep)
    for mine in range(3):
        now[0] = 100.0 + 0.7 * mine
        slots = search.Slots(100.0, 3, mine, 3.0)
        for _ in range(4):
            slots.wait()
            now[0] += 1.0
    assert len(set(taken)) == 12 and all((t - 100) % 3 == 0 for t in taken)


def test_the_stream_goes_on_where_it_was(spark, server, tmp_path):
    service, asked, _ = server
    search.register(spark)

    def run():
        stream = spark.readStream.format("papersearch").options(service=service, topics="one\ntwo", pause=0, maxResults=10).load()
        q = stream.select("topic", "start").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        end = time.time() + 90
        while time.time() < end and (q.lastProgress is None or q.isActive and int(asked[-1][1]["start"]) < 30):
            time.sleep(0.3)
        time.sleep(1)
        q.stop()

    run()
    rows = sorted((r.topic, r.start) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(t, s) for t in ("one", "two") for s in (0, 10, 20)]
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_topics_that_cannot_be_had_have_no_row(spark):
    assert _read(spark, "http://127.0.0.1:9/nothing", tries=1, topics="one").count() == 0
