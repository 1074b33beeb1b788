"""Services behind HTTP: a server that fails one call in five, counts its connections and the texts it is asked for."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from mistveil.operators.ner import RemoteGenerator, RemoteSearch
from mistveil.plans.policy import Policy
from mistveil.plans.redactor import Resources, redact


class Server:
    def __init__(self, answer, bad=5):
        self.calls, self.now, self.most, self.asked, lock = 0, 0, 0, [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def setup(self):
                super().setup()
                with lock:
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)

            def finish(self):
                super().finish()
                with lock:
                    outer.now -= 1

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with lock:
                    outer.calls += 1
                    turn = outer.calls
                if bad and turn % bad == 0:
                    if turn % 2:  # the connection is lost
                        self.close_connection = True
                        return
                    self.send_response(503)
                    raw = b"busy"
                else:
                    outer.asked.append(body)
                    code, out = answer(body)
                    self.send_response(code)
                    raw = json.dumps(out).encode()
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_):
                pass

        class Quiet(ThreadingHTTPServer):
            daemon_threads = True

            def handle_error(self, *_):
                pass

        self.http = Quiet(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def served():
    made = []

    def start(answer, bad=5):
        made.append(Server(answer, bad))
        return made[-1]

    yield start
    for s in made:
        s.http.shutdown()
        s.http.server_close()


def names(body):
    return 200, [{"start": m.start(), "end": m.end(), "label": "Person", "score": 0.9 if m[0] != "Max" else 0.3} for m in re.finditer("Ann|Bob|Max", body["text"])]


def test_search_of_a_policy(spark, served):
    """An endpoint in the policy: all names are found though one call in five fails, equal texts are asked for once a batch, few connections."""
    server = served(names)
    policy = Policy({"identifiers": {"pheyes": [{"phEyeConfiguration": {"endpoint": server.url, "maxIdleConnections": 3}}]}})
    texts = [f"{'Ann' if i % 3 else 'Bob'} met Max {i % 40}" for i in range(200)] + [None, "", "  "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(2)
    out = {r.i: r for r in redact(rows, policy).collect()}
    assert all([s.text for s in out[i].spans] == ["Ann" if i % 3 else "Bob"] and out[i].regex_timeouts == [] for i in range(200))
    assert not out[200].spans and server.most <= 30 and len(server.asked) <= 2 * 120 and {b["labels"][0] for b in server.asked} == {"Person"}


def test_failures_are_stated(spark, served):
    broken = served(lambda body: (200, []) if "fine" in body["text"] else (500, {}), bad=0)
    rows = spark.createDataFrame([("fine",), ("never",)], "text string")
    policy = Policy({"identifiers": {"pheyes": [{"id": "n"}]}})
    make = lambda how: Resources(searches={"n": RemoteSearch("ner n", broken.url, attempts=2, pause_s=0.01, on_failure=how)})
    assert {r.text: r.regex_timeouts for r in redact(rows, policy, resources=make("report")).collect()} == {"fine": [], "never": ["ner n"]}
    with pytest.raises(Exception, match="1 of 2 texts have no answer|1 of 1 texts have no answer"):
        redact(rows, policy, resources=make("error")).collect()
    denied = served(lambda body: (403, {}), bad=0)
    search = RemoteSearch("x", denied.url, attempts=4, pause_s=0.01, on_failure="report")
    assert isinstance(search.all(["a"])[0], TimeoutError) and denied.calls == 1  # no use in asking again
    with pytest.raises(ValueError):
        redact(rows, Policy({"identifiers": {"pheyes": [{}]}}))


def test_generator(spark, served):
    """Replacements by a model, asked for once a token; without an answer the fallback."""
    server = served(lambda body: (200, {"response": " Party " + body["prompt"].split("'")[1][1:] + "\n"}) if "K13" not in body["prompt"] else (500, {}))
    generators = {"g": {"type": "ollama", "endpoint": server.url, "model": "m", "prompt": "Replace '{token}', a {label}."}}
    strategy = {"strategy": "MAP_REPLACE", "generator": "g", "fallbackStrategy": "STATIC_REPLACE", "staticReplacement": "-"}
    policy = Policy({"generators": generators, "identifiers": {"identifiers": [{"pattern": r"K\d+", "classification": "key", "identifierFilterStrategies": [strategy]}]}})
    rows = spark.createDataFrame([(i, f"K{i % 20} and K{i % 7}") for i in range(100)], "i int, text string").coalesce(1)
    made = lambda k: "-" if k == 13 else f"Party {k}"
    resources = Resources(generate=RemoteGenerator(policy.data["generators"], pause_s=0.01, attempts=6))
    for r in redact(rows, policy, resources=resources).collect():
        assert r.filtered_text == f"{made(r.i % 20)} and {made(r.i % 7)}"
    assert all(b["model"] == "m" and "a key" in b["prompt"] for b in server.asked) and server.most <= 8
