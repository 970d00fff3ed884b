import json
import threading
import time
from email.utils import formatdate
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lexaquarry.provider import chat, failures
from lexaquarry.provider import http as H
from lexaquarry.provider.chat import Chat, Config, JSONCall
from lexaquarry.provider.embeddings import HTTPEmbedder


class Server:
    """A local service that plays back answers: (status, headers, body), or a function of the request."""

    def __init__(self):
        self.answers, self.seen = [], []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])) or b"{}")
                outer.seen.append((self.path, dict(self.headers), body))
                answer = outer.answers.pop(0) if len(outer.answers) > 1 else outer.answers[0]
                status, headers, data = answer(body) if callable(answer) else answer
                data = data if isinstance(data, bytes) else json.dumps(data).encode()
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()
    s.http.server_close()


def said(text):
    return 200, {}, {"choices": [{"message": {"content": text}}]}


def client(server, **more):
    return Chat(Config(server.url, "m", token="secret", **more))


ASK = [{"role": "user", "content": "hi"}]


def test_text(server):
    server.answers = [said(" hello ")]
    assert client(server).text(ASK) == "hello"
    path, headers, body = server.seen[0]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer secret" and body["messages"] == ASK and "response_format" not in body


@pytest.mark.parametrize("answer,name", [((200, {}, {"choices": []}), "schema_mismatch"), ((200, {}, b"no json"), "schema_mismatch"), (said(""), "schema_mismatch"), (said(None), "schema_mismatch"), ((200, {}, {"error": {"message": "quota exceeded"}}), "rate_limit"), ((401, {}, {"error": "bad key"}), "auth"), ((400, {}, {"message": "odd"}), "dependency_unavailable"), ((500, {}, b""), "server"), ((200, {}, b"x" * 100), "schema_mismatch")])
def test_failures(server, answer, name):
    server.answers = [answer]
    with pytest.raises(failures.ProviderError) as e:
        client(server, max_response_bytes=80 if answer[2] == b"x" * 100 else 0).text(ASK)
    assert e.value.failure_class == name and e.value.fields()["model"] == "m" and "secret" not in str(e.value)


def test_retries(server, monkeypatch):
    slept = []
    monkeypatch.setattr(H.request, "__defaults__", (*H.request.__defaults__[:-1], slept.append))
    server.answers = [(429, {"Retry-After": "7"}, b""), (503, {}, b""), said("ok")]
    assert client(server, max_retries=2).text(ASK) == "ok" and slept == [7.0, 0.4]
    server.answers, server.seen[:] = [(503, {"Retry-After": "900"}, b"")], []
    with pytest.raises(failures.ProviderError):
        client(server, max_retries=1).text(ASK)
    assert len(server.seen) == 2 and slept[-1] == 30.0
    server.answers, server.seen[:] = [(400, {}, b"")], []
    with pytest.raises(failures.ProviderError):
        client(server, max_retries=5).text(ASK)
    assert len(server.seen) == 1
    with pytest.raises(failures.ProviderError) as e:
        Chat(Config("http://127.0.0.1:9", "m", max_retries=-3)).text(ASK)
    assert e.value.failure_class == "transport"


def test_timeout(server):
    server.answers = [lambda _: (time.sleep(0.6), said("late"))[1]]
    with pytest.raises(failures.ProviderError) as e:
        client(server, timeout=0.2).text(ASK)
    assert e.value.failure_class == "timeout"
    with pytest.raises(RuntimeError):
        Chat(Config("", "m")).text(ASK)


def test_json(server):
    server.answers = [said('```json\n{"a": 1}\n```')]
    assert client(server).json(JSONCall(ASK, schema='{"type": "object"}')) == {"a": 1}
    assert server.seen[0][2]["response_format"]["json_schema"]["schema"] == {"type": "object"}
    server.answers, server.seen[:] = [said("[1]"), said('{"a": 2}')], []
    assert client(server).json(JSONCall(ASK, max_repairs=9), lambda x: x["a"]) == 2
    assert [m["role"] for m in server.seen[1][2]["messages"]] == ["user", "assistant", "user"]
    server.answers, server.seen[:] = [said("prose")], []
    with pytest.raises(failures.ProviderError) as e:
        client(server).json(JSONCall(ASK, max_repairs=9))
    assert e.value.failure_class == "schema_mismatch" and len(server.seen) == 2  # one repair at most
    with pytest.raises(ValueError):
        client(server).json(JSONCall(ASK, schema="{"))


@pytest.mark.parametrize("text,want", [('{"a": 1}', '{"a": 1}'), (' x {"a": "}"} y', '{"a": "}"}'), ("{bad} {\"b\": {}}", '{"b": {}}'), ("[1]", None), ('"s"', None), ('{"a":1} {"b":2}', None), ("", None), ("none", None), ('{"a": 1} tail', '{"a": 1}'), ("{", None)])
def test_json_object(text, want):
    if want is None:
        with pytest.raises(ValueError):
            chat.json_object(text)
    else:
        assert chat.json_object(text) == want


def test_message_text(spark):
    for content, want in ((" a ", "a"), ([{"text": " x "}, {"text": " "}, {"type": "image"}, {"text": "y"}], "x\ny"), (None, None), (3, None), ([1], None), ([], "")):
        assert chat.message_text(content) == want
    rows = spark.createDataFrame([(json.dumps(c),) for c in (" a ", [{"text": " x "}, {"text": "y"}], {"no": 1})], "c string")
    assert [r[0] for r in rows.select(chat.content_texts(F.col("c"))).collect()] == ["a", "x\ny", None]
    found = chat.json_objects(spark.createDataFrame([('see {"a": 1}.',), (None,)], "t string"), "t")
    assert [r.object for r in found.collect()] == ['{"a": 1}', None]


def test_over_rows(spark, server):
    server.answers = [lambda b: said(b["messages"][0]["content"].upper()) if b["messages"][0]["content"] != "bad" else (403, {}, {"error": "no"})]
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, prompt string")
    got = {r.id: r for r in chat.ask(rows, "prompt", Config(server.url, "m")).collect()}
    assert got[1].answer == "A" and (got[2].failure_class, got[2].http_status) == ("auth", 403) and got[3].failure_class == "schema_mismatch"


def embeddings(body):
    data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
    return 200, {}, {"data": data[::-1]}


def test_embedder(spark, server):
    server.answers = [embeddings]
    e = HTTPEmbedder(Config(server.url, "nomic-embed-text"), max_batch=2)
    assert e.documents(["a", "bb", "ccc"]) == [[float(len("search_document: ") + n), 1.0] for n in (1, 2, 3)]
    assert [len(s[2]["input"]) for s in server.seen] == [2, 1] and e.queries(["q"])[0][0] == len("search_query: q")
    assert e.dimension() == 2 and e.fingerprint == "http|nomic-embed-text|search-prefix|2" and e.documents([]) == []
    from lexaquarry.operators import embedding

    texts = spark.createDataFrame([("r", i, "x" * i) for i in range(5)], "ref string, chunk_index int, text string")
    plain = HTTPEmbedder(Config(server.url, "plain"))
    assert sorted(r.embedding[0] for r in embedding.embed(texts, plain).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]
    server.answers = [(200, {}, {"data": [{"index": 0, "embedding": [1.0]}]})]
    for texts in (["a"], ["a", "b"]):
        with pytest.raises(failures.ProviderError):
            e.documents(texts)


def test_helpers():
    assert H.base_url(" https://h.org/?x#y ") == "https://h.org/v1" and H.base_url("http://h/api/v2//") == "http://h/api/v2" and H.base_url(" ") == ""
    assert H.retry_after("5") == 5 and H.retry_after("-1") == 0 and H.retry_after("soon") == 0 and H.retry_after(None) == 0
    assert 58 <= H.retry_after(formatdate(time.time() + 60, usegmt=True)) <= 61
    assert [H.delay(i) for i in range(6)] == [0.2, 0.4, 0.8, 1.6, 2.0, 2.0] and H.delay(3, 9) == 9
    assert H.budget(3, 2, 10) == 3 * (30 + 60)
    assert "top" not in repr(Config("h", "m", token="top")) and str(H.Secret("x")) == "[REDACTED]" and str(H.Secret("")) == "" and f"{H.Secret('x')}" == "[REDACTED]" and json.dumps(H.Secret("x")) == '"x"'
    assert failures.error_message(b'{"error": {"detail": " d "}}') == "d" and failures.error_message(b'{"message": "m", "error": "e"}') == "m" and failures.error_message(b"[") == "" and failures.error_message(b"[1]") == ""


CASES = [(401, "", "auth"), (429, "auth", "rate_limit"), (408, "", "timeout"), (504, "", "timeout"), (502, "auth", "server"), (0, "Invalid API key", "auth"), (0, "Too many requests", "rate_limit"), (400, "it timed out", "timeout"), (0, "connection reset by peer", "transport"), (0, " EOF ", "transport"), (404, "gone", "dependency_unavailable"), (0, None, "dependency_unavailable")]


def test_classes(spark):
    assert [failures.classify(s, None, m or "") for s, m, _ in CASES] == [c for *_, c in CASES]
    assert failures.classify(0, TimeoutError(), "x") == "timeout" and failures.classify(0, ConnectionError(), "x") == "transport"
    rows = spark.createDataFrame([(i, s, m) for i, (s, m, _) in enumerate(CASES)], "i int, s int, m string")
    assert [r[1] for r in sorted(rows.select("i", failures.classified(F.col("s"), F.col("m"))).collect())] == [c for *_, c in CASES]
