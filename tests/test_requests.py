"""Requests are asked once; what they carry; operations of a description."""

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from millrace.plans import text
from millrace.sources import openapi, requests
from millrace.sources.paging import Endpoint, TooManyPages
from millrace.sources.requests import RequestLog

HEAD = 'mission T { source API { base: "https://x" } store raw: memory("raw") store out: memory("out") store two: memory("two") '


@dataclass
class Counting:
    """Writes down every request it gets; what it answers grows with their number."""

    folder: str
    headers: dict = field(default_factory=dict)
    timeout: float = 30.0
    fails_at: str = ""

    def request(self, verb, path, params=None, body=None):
        asked = {"verb": verb, "path": path, "params": params, "body": body, "headers": self.headers, "timeout": self.timeout}
        n = len(list(Path(self.folder).iterdir()))
        Path(self.folder, uuid.uuid4().hex).write_text(json.dumps(asked))
        if self.fails_at and path == self.fails_at:
            raise OSError("gone")
        if path == "/none":
            return None
        return {"n": n, "path": path, "at": f"2024-05-{n + 1:02d}T00:00:00Z"}


@pytest.fixture
def client(tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    return Counting(str(folder))


def asked(client):
    return [json.loads(p.read_text()) for p in Path(client.folder).iterdir()]


def run(spark, body, raw, client, **kw):
    api = {"API": Endpoint(client, "n long, path string, at string")}
    return text.run(HEAD + "action A { " + body + " } run A }", spark, {"raw": raw}, api, **kw)


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, k long").repartition(5)


def test_one_request_for_each_distinct_key(spark, raw, client):
    m = run(spark, 'for r in raw { get "/c/{r.k}" store { id: r.id, n: response.n, k: r.k } -> out { key: .id } store { id: r.id, n: response.n } -> two { key: .id } }', raw, client)
    one, two, again = ({r.id: r.n for r in m.stores[s].scan().collect()} for s in ("out", "two", "out"))
    assert one == two == again and len(one) == 40
    assert Counter(x["path"] for x in asked(client)) == {"/c/0": 1, "/c/1": 1, "/c/2": 1}
    assert len({(r.k, r.n) for r in m.stores["out"].scan().collect()}) == 3


def test_a_post_is_sent_once_for_each_row(spark, raw, client):
    m = run(spark, 'for r in raw { post "/c" { body: { k: r.k, tags: ["a"], none: null } } match response { { n: 0 } -> skip, _ -> { store response -> out { key: .n } store response -> two { key: .n } } } }', raw, client)
    assert m.stores["out"].scan().count() == m.stores["two"].scan().count() == len({r.n for r in m.stores["out"].scan().collect()})
    got = asked(client)
    assert len(got) == 40 and Counter(x["body"]["k"] for x in got) == Counter(i % 3 for i in range(40))
    assert all(x["body"] == {"k": x["body"]["k"], "tags": ["a"], "none": None} and x["verb"] == "post" for x in got)


def test_the_checkpoint_is_that_of_the_stored_answer(spark, raw, client):
    m = run(spark, 'get "/c" { since: lastSync("k") { updateFrom: "at" } } store response -> out { key: .n }', raw, client)
    stored = m.stores["out"].scan().collect()
    assert len(asked(client)) == 1 and m.marks.last("k")[:10] == stored[0].at[:10] == "2024-05-01"
    assert m.marks.last("k")[:10] == "2024-05-01" and len(asked(client)) == 1


def test_a_reader_is_asked_once_for_rows_and_checkpoint(spark, raw, tmp_path):
    calls = []

    def reader(s, request):
        calls.append(request)
        return s.range(3).selectExpr("id", "uuid() AS u", "timestampadd(SECOND, CAST(floor(rand() * 1e6) AS INT), TIMESTAMP '2024-01-01') AS at")

    body = 'get "/c" { since: lastSync("k") { updateFrom: "at" } } for x in raw where .id == 1 { store { id: 1, at: response.at } -> two } store response -> out { key: .id }'
    m = text.run(HEAD + "action A { " + body.replace("for x in raw where .id == 1 { store { id: 1, at: response.at } -> two } ", "") + " } run A }", spark, {"raw": raw}, {"API": reader})
    got = m.stores["out"].scan().collect()
    assert m.marks.last("k")[:19] == str(max(r["at"] for r in got))[:19] and len(calls) == 1


def test_a_later_run_asks_only_what_is_missing(spark, raw, client, tmp_path):
    body = 'for r in raw { get "/c/{r.id}" store { id: r.id, n: response.n } -> out { key: .id } }'
    where = f"file://{tmp_path}/log"
    client.fails_at = "/c/17"
    with pytest.raises(PySparkException, match="gone"):
        run(spark, body, raw, client, log=RequestLog(spark, where, tasks=1))
    before = Counter(x["path"] for x in asked(client))
    assert before["/c/17"] == 1 and max(before.values()) == 1
    client.fails_at = ""
    m = run(spark, body, raw, client, log=RequestLog(spark, where, tasks=1))
    assert m.stores["out"].scan().count() == 40
    after = Counter(x["path"] for x in asked(client))
    assert after.pop("/c/17") == 2 and len(after) == 39 and set(after.values()) == {1}
    assert not (tmp_path / "log" / "journal").exists()


def test_headers_timeout_params_and_credentials(spark, raw, client):
    body = 'for r in raw where .id < 2 { get "/c" { params: { a: r.id, b: "x" }, headers: { "X-Id": r.id }, timeout: 1500 } store { id: r.id } -> out { key: .id } }'
    run(spark, body, raw, client, auth={"API": {"type": "bearer", "token": "t"}})
    got = sorted(asked(client), key=lambda x: x["params"]["a"])
    assert [x["params"] for x in got] == [{"a": 0, "b": "x"}, {"a": 1, "b": "x"}]
    assert [x["headers"] for x in got] == [{"Authorization": "Bearer t", "X-Id": "0"}, {"Authorization": "Bearer t", "X-Id": "1"}] and got[0]["timeout"] == 1.5
    for option in ("colour: 1", "header: { a: 1 }"):
        with pytest.raises(text.SyntaxFault, match="a request has no"):
            run(spark, f'get "/c" {{ {option} }}', raw, client)
    with pytest.raises(text.SyntaxFault, match="takes no headers"):
        text.run(HEAD + 'action A { get "/c" { headers: { a: "b" } } } run A }', spark, {"raw": raw}, {"API": Endpoint(object(), "n long")})


def test_answers_that_are_empty(spark, raw, client):
    m = run(spark, 'get "/none" store { id: 1, n: response.n } -> out { key: .id }', raw, client)
    assert [r.n for r in m.stores["out"].scan().collect()] == [None]
    run(spark, 'for r in raw where .id > 1000 { get "/c/{r.id}" store { id: r.id } -> out { key: .id } }', raw, client)
    assert len(asked(client)) == 1


SPEC = json.dumps({"servers": [{"url": "http://x"}], "paths": {"/c/{id}": {"get": {"operationId": "getC", "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/C"}}}}}}, "put": {"operationId": "putC"}}}, "components": {"schemas": {"C": {"type": "object", "properties": {"n": {"type": "integer"}, "path": {"type": "string"}}}}}})


def test_operations_of_a_description(spark, raw, client):
    api = {"API": Endpoint(client, operations=openapi.load(SPEC)[1])}
    body = 'action A { for r in raw where .id < 2 { call API.getC { params: { id: r.id, deep: true } } store { id: r.id, path: response.path } -> out { key: .id } } } run A }'
    m = text.run(HEAD + body, spark, {"raw": raw}, api)
    assert {r.id: r.path for r in m.stores["out"].scan().collect()} == {0: "/c/0", 1: "/c/1"}
    assert all(x["params"] == {"deep": True} and x["verb"] == "get" for x in asked(client))
    with pytest.raises(LookupError, match="no operation nope; there are getC, putC"):
        text.run(HEAD + "action A { call API.nope } run A }", spark, {"raw": raw}, api)


class Endless:
    def request(self, verb, path, params=None, body=None):
        return {"items": [{"n": int(params["page"])}] if int(params["page"]) <= 130 else []}


def test_the_most_pages_of_an_answer(spark, raw):
    body = 'action A { get "/c" { paginate: page(page, 1) } store response -> out { key: .n } } run A }'
    got = text.run(HEAD + body, spark, {"raw": raw}, {"API": Endpoint(Endless(), "n long", most=200)})
    assert got.stores["out"].scan().count() == 130
    with pytest.raises(PySparkException, match=TooManyPages.__name__):
        text.run(HEAD + body, spark, {"raw": raw}, {"API": Endpoint(Endless(), "n long")})


def test_a_failed_run_leaves_a_file_for_each_task(spark, raw, client, tmp_path):
    """Not one for each answer; the next run takes them over, though it deals its rows otherwise."""
    body = 'for r in raw { get "/c/{r.id}" store { id: r.id, n: response.n } -> out { key: .id } }'
    where = f"file://{tmp_path}/log"
    client.fails_at = "/c/17"
    with pytest.raises(PySparkException, match="gone"):
        run(spark, body, raw, client, log=RequestLog(spark, where, tasks=2))
    put_down = [p for p in (tmp_path / "log" / "journal").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert 1 <= len(put_down) <= 2 and len(asked(client)) > 3
    with put_down[0].open("ab") as f:
        f.write(b'["a key", "{\\"n\\": 1')  # the task ended here
    client.fails_at = ""
    log = RequestLog(spark, where, tasks=3)
    m = run(spark, body, raw, client, log=log)
    assert m.stores["out"].scan().count() == log.answers().count() == 40
    assert {p: n for p, n in Counter(x["path"] for x in asked(client)).items() if n > 1} == {"/c/17": 2}
    assert not (tmp_path / "log" / "journal").exists()


def test_a_log_goes_on_after_its_own_failed_run(spark, raw, client, tmp_path):
    body = 'for r in raw { get "/c/{r.id}" store { id: r.id, n: response.n } -> out { key: .id } }'
    log = RequestLog(spark, f"file://{tmp_path}/log", tasks=1)
    client.fails_at = "/c/17"
    with pytest.raises(PySparkException, match="gone"):
        run(spark, body, raw, client, log=log)
    client.fails_at = ""
    run(spark, body, raw, client, log=log)
    assert log.answers().count() == 40 and len(asked(client)) == 41


class NoAppend:
    """A storage that can't append to files."""

    def __init__(self):
        self.fs = requests.afs.LocalFileSystem()

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def open_append_stream(self, path):
        raise OSError("can't append")


@pytest.mark.parametrize("appends", [True, False])
def test_a_task_in_place_of_a_lost_one_asks_what_is_missing(tmp_path, monkeypatch, appends):
    if not appends:
        monkeypatch.setattr(requests.afs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda uri: (NoAppend(), uri.removeprefix("file://")))}))
    calls, lost_at = [], ["k03", "k07", None]

    def ask(path, params, body, headers):
        if path == lost_at[0]:
            raise RuntimeError("lost")
        calls.append(path)
        return None if path == "k05" else path.upper()

    rows = pd.DataFrame({c: [f"k{i:02d}" for i in range(12)] for c in requests.REQUEST})
    for _ in range(2):
        with pytest.raises(RuntimeError, match="lost"):
            list(requests._asking(ask, f"file://{tmp_path}/journal")(iter([rows])))
        lost_at.pop(0)
    got = pd.concat(requests._asking(ask, f"file://{tmp_path}/journal")(iter([rows[:5], rows[5:]])))
    assert calls == [f"k{i:02d}" for i in range(12)]
    assert list(got[requests.ANSWER]) == [None if i == 5 else f"K{i:02d}" for i in range(12)]
    again = requests._asking(ask, f"file://{tmp_path}/journal")(iter([rows]))
    assert list(pd.concat(again)[requests.ANSWER]) == list(got[requests.ANSWER]) and len(calls) == 12
