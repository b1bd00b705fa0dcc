"""Adapters against a local server and small processes."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pandas as pd
import pytest

from verdigris.operators import grading
from verdigris.sources import adapters


@pytest.fixture
def server():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            calls.append(body)
            code, answer = {
                "/ok": (200, {"answer": f"A {body.get('prompt')}"}),
                "/bad": (200, {"answer": 5}),
                "/down": (500, {}),
                "/judge": (200 if len(calls) > 1 else 429, {"choices": [{"message": {"content": [{"text": "correct: "}, {"text": "yes"}]}}]}),
                "/refuse": (400, {"error": "no"}),
            }[self.path]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", calls
    http.shutdown()


def one(adapter, **row):
    frame = pd.DataFrame([{"task_id": "t", "prompt": "p", "gold": "secret", "timeout_seconds": 5} | row])
    return next(adapter(iter([frame]))).iloc[0]


def test_http_system(server):
    url, calls = server
    assert one(adapters.http_system(url + "/ok")).answer == "A p"
    assert "gold" not in calls[0]
    assert one(adapters.http_system(url + "/bad")).status == "collection_failed"
    assert one(adapters.http_system(url + "/down")).status == "provider_error"
    assert one(adapters.http_system("http://127.0.0.1:9/x")).status == "provider_error"
    assert one(adapters.http_system(url + "/ok", key_variable="NO_SUCH_KEY")).status == "provider_error"


@pytest.mark.parametrize(
    "code, status",
    [
        ("print('{\"event\":\"submission_confirmed\"}'); print('{\"event\":\"result\",\"answer\":\"x\"}')", "completed"),
        ("print('{\"event\":\"result\",\"answer\":\"x\"}')", "submission_unconfirmed"),
        ("print('{\"event\":\"submission_confirmed\"}'); print('{\"event\":\"submission_confirmed\"}')", "collection_failed"),
        ("print('{\"event\":\"submission_confirmed\"}')", "collection_failed"),
        ("print('not json')", "collection_failed"),
        ("raise SystemExit(3)", "provider_error"),
        ("import time; time.sleep(9)", "timeout"),
    ],
)
def test_process_system(code, status):
    assert one(adapters.process_system([sys.executable, "-c", code]), timeout_seconds=2).status == status


def test_no_such_process():
    assert one(adapters.process_system(["/no/such/program"])).error.startswith("PROCESS_SPAWN_FAILED")


def test_judges(server, spark):
    url, calls = server
    assert adapters.ask_http(url + "/judge", "m", "s", "u", {}, 2, 5) == "correct: yes"
    assert len(calls) == 2
    with pytest.raises(RuntimeError, match="400"):
        adapters.ask_http(url + "/refuse", "m", "s", "u", {}, 2, 5)
    assert len(calls) == 3
    echo = [sys.executable, "-c", "import json,sys; print('correct: no', json.load(sys.stdin)['user'])"]
    judged = adapters.judge(lambda s, u: adapters.ask_process(echo, s, u, 10), "sys", "final_answer")
    rows = spark.createDataFrame([("a", "Exact Answer: x", "y"), ("b", "Exact Answer: y", "y")], "task_id string, final_answer string, reference_answer string")
    got = {r.task_id: (r.exact, r.conclusion) for r in grading.short_fact(rows, judged, "english").collect()}
    assert got == {"a": (False, "incorrect"), "b": (True, "correct")}
