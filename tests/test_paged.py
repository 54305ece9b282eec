"""The paged source against a local server that filters, fails, logs in and forgets."""

import json
import threading
import urllib.parse
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tallywright.sources import datasets, paged

STATUSES = ["IN_PROGRESS", "COMPLETED", "QUOTE", "ARCHIVED"]


class Api:
    """Matters by GET, time entries by POST; ``fail`` maps a page to how often it answers 500."""

    def __init__(self, matters=230, entries=120, fail=(), login=False):
        self.matters = [{"_id": str(i), "status": STATUSES[i % 4], "number": i} for i in range(matters)]
        self.entries = [{"_id": str(i), "date": f"2024-0{1 + i % 6}-01", "assignee": {"_id": str(i % 3)}, "status": "DELETED" if i % 10 == 0 else None} for i in range(entries)]
        self.fail, self.asked, self.lock, self.tokens, self.login = dict(fail), [], threading.Lock(), set(), login
        api = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urllib.parse.urlparse(self.path)
                api.answer(self, at.path, {k: v[0] for k, v in urllib.parse.parse_qs(at.query).items()})

            def do_POST(self):
                api.answer(self, self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, to, path, asked):
        def send(code, body=None):
            to.send_response(code)
            to.end_headers()
            to.wfile.write(json.dumps(body).encode())

        with self.lock:
            if path == "/login":
                self.tokens = {f"t{len(self.asked)}"}  # older ones end
                return send(200, {"user": "u", "sessionToken": next(iter(self.tokens))})
            self.asked.append((path, asked))
            if self.login and to.headers.get("Authorization", "").removeprefix("Bearer ") not in self.tokens:
                return send(401)
            page, size = int(asked.get("page", 1)), int(asked.get("limit", asked.get("size", 50)))
            if self.fail.get(page, 0) > 0:
                self.fail[page] -= 1
                return send(500)
        if path == "/matters":
            rows = [m for m in self.matters if m["status"] in asked.get("status", ",".join(STATUSES)).split(",")]
            return send(200, {"rows": rows[(page - 1) * size:page * size]})
        if path == "/time-entries/search":
            rows = [e for e in self.entries if e["date"] >= asked.get("start", "") and asked.get("assignee", e["assignee"]["_id"]) == e["assignee"]["_id"]]
            return send(200, {"result": rows[(page - 1) * size:page * size]})
        if path == "/invoices/summary":
            return send(200, {"unpaid": 1.5, "paid": 2.0, "total": 3.5})
        if path == "/attorneys":
            return send(200, [{"_id": "a", "name": "Ann"}, {"_id": "b", "extra": 1}])
        return send(404)


@pytest.fixture
def api():
    started = []

    def start(**how):
        started.append(Api(**how))
        return started[-1]

    yield start
    for one in started:
        one.server.shutdown()


def ids(df):
    return sorted(int(r["_id"]) for r in df.select("_id").collect())


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 400, 401])
def test_an_endpoint_of_unknown_length_is_read_whole(spark, api, n):
    one = api(matters=n)
    df = datasets.read_dataset(spark, one.url, "matters", lanes="3")
    assert df.rdd.getNumPartitions() == 3
    one.asked.clear()
    assert ids(df) == list(range(n))
    pages = sorted(int(a["page"]) for _, a in one.asked)
    assert len(pages) == len(set(pages)) and len(pages) <= n // 50 + 4  # no page twice, at most one a lane beyond the end


def test_failed_pages_are_mended_at_the_end(spark, api):
    one = api(fail={2: 3, 5: 2})
    df = datasets.read_dataset(spark, one.url, "matters", lanes="2", pause="0.01")
    assert ids(df) == list(range(230))


def test_a_page_that_stays_lost_raises_or_is_reported(spark, api):
    one = api(fail={2: 99})
    with pytest.raises(Exception, match="500"):
        datasets.read_dataset(spark, one.url, "matters", lanes="2", pause="0.01").count()
    kept = datasets.read_dataset(spark, one.url, "matters", lanes="2", pause="0.01", onFailure="report")
    assert ids(kept) == [i for i in range(230) if not 50 <= i < 100]
    raw = paged.read_raw(spark, url=one.url + "/matters?page={page}&limit={size}", lanes="2", pause="0.01", onFailure="report")
    assert [r["lost_page"] for r in raw.where("lost_page is not null").collect()] == [2]


def test_an_endpoint_that_always_fails_ends(spark, api):
    one = api(fail={page: 999 for page in range(1, 50)})
    with pytest.raises(Exception, match="500"):
        datasets.read_dataset(spark, one.url, "matters", lanes="2", pause="0.01").count()
    assert max(int(a["page"]) for _, a in one.asked) <= 2 * (paged.FAILURES + 1)


def test_filters_reach_the_request(spark, api, capsys):
    one = api()
    df = datasets.pull(spark, one.url, "matters").where(F.col("number") > 10)
    df.explain("formatted")
    assert "PushedFilters: [In(status, [EXCHANGED,IN_PROGRESS,NOT_PROCEEDING,ON_HOLD,QUOTE])]" in capsys.readouterr().out
    assert ids(df) == [i for i in range(11, 230) if i % 4 in (0, 2)]
    assert all(set(a["status"].split(",")) == set(datasets.PULLED_MATTERS) for _, a in one.asked)
    one.asked.clear()
    entries = datasets.pull(spark, one.url, "time_entries", from_date="2024-03-01").where(F.col("assignee_id") == "1")
    assert ids(entries) == [i for i in range(120) if i % 6 >= 2 and i % 3 == 1 and i % 10]
    assert all(a["start"] == "2024-03-01" and a["assignee"] == "1" for _, a in one.asked)


def test_a_server_that_ignores_filters_does_no_harm(spark, api):
    one = api()
    df = datasets.read_dataset(spark, one.url, "matters", url=one.url + "/matters?page={page}&limit={size}&x=1", parameters=json.dumps([["status", "unknown", "any", "status"]]))
    assert ids(df.where("status = 'QUOTE'")) == [i for i in range(230) if i % 4 == 2]


def test_single_answers_and_missing_ones(spark, api):
    one = api()
    assert [tuple(r) for r in datasets.read_dataset(spark, one.url, "invoice_summary").collect()] == [(1.5, 2.0, 3.5)]
    assert sorted(r["_id"] for r in datasets.read_dataset(spark, one.url, "attorneys").collect()) == ["a", "b"]
    assert datasets.read_dataset(spark, one.url, "targets", competence="2024-05").collect() == []


def test_login_and_login_anew(spark, api):
    one = api(login=True)
    df = datasets.read_dataset(spark, one.url, "matters", lanes="1", loginUrl=one.url + "/login", loginBody='{"email": "e"}')
    assert ids(df) == list(range(230))
    two = api(login=True)
    df = datasets.read_dataset(spark, two.url, "matters", lanes="1", token="stale", loginUrl=two.url + "/login")
    assert ids(df) == list(range(230))
    with pytest.raises(Exception, match="401"):
        datasets.read_dataset(spark, two.url, "matters", lanes="1", token="stale", pause="0.01").count()
    with pytest.raises(ValueError):
        paged.token_of({"tokens": 3})


def test_every_dataset_has_a_table(spark):
    assert len(datasets.DATASETS) == 12
    for name in datasets.DATASETS:
        assert datasets.read_dataset(spark, "http://127.0.0.1:9", name).columns


def test_registering_from_many_threads(spark):
    fresh = spark.newSession()
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: paged.register(fresh), range(8)))
