"""A table behind a REST interface: what travels, what a failed write leaves, what a stream reads."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.sources import resttable


class Server(ThreadingHTTPServer):
    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.tables, self.asked, self.lock = {}, [], threading.Lock()
        self.refuse_after = None


def holds(row, name, cond):
    op, _, v = cond.partition(".")
    if op == "not":
        return row.get(name) is not None if v == "is.null" else row.get(name) is not None and not holds(row, name, v)
    x = row.get(name)
    if op == "is":
        return x is None
    if x is None:
        return False
    if op == "in":
        return str(x) in re.findall(r'"([^"]*)"', v)
    if op == "like":
        return re.fullmatch(v.replace("*", ".*"), x) is not None
    y = type(x)(v)
    return {"eq": x == y, "gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def answer(self, got, status=200):
        data = json.dumps(got).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def handle_any(self):
        s = self.server
        url = urlsplit(self.path)
        q, name = parse_qsl(url.query), url.path.strip("/")
        body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "null")
        with s.lock:
            s.asked.append((self.command, name, q, {k.lower(): v for k, v in self.headers.items()}))
            opts = {k: v for k, v in q if k in ("select", "order", "limit", "offset")}
            match = lambda r: all(holds(r, k, v) for k, v in q if k not in opts)
            if name.startswith("rpc/merge_"):
                target = s.tables.setdefault(name.removeprefix("rpc/merge_"), [])
                staged = [r for r in s.tables.get(name.removeprefix("rpc/merge_") + "_stage", []) if r["_run"] == body["run"] and r["_attempt"] in body["attempts"]]
                assert len(staged) == body["rows"]
                by = {} if body["replace"] else {r[body["key"]]: r for r in target}
                for r in staged:
                    clean = {k: v for k, v in r.items() if not k.startswith("_")}
                    by[r[body["key"]]] = {**by.get(r[body["key"]], {}), **clean}
                target[:] = by.values()
                return self.answer(None)
            rows = s.tables.setdefault(name, [])
            if self.command == "POST":
                if s.refuse_after is not None and len(rows) >= s.refuse_after:
                    return self.answer({"message": "full"}, 400)
                rows.extend(body)
                return self.answer(None)
            if self.command == "DELETE":
                rows[:] = [r for r in rows if not match(r)]
                return self.answer(None)
            got = [r for r in rows if match(r)]
            if "order" in opts:
                c, _, way = opts["order"].partition(".")
                got.sort(key=lambda r: r[c], reverse=way == "desc")
            got = got[int(opts.get("offset", 0)) :][: int(opts.get("limit", 10**9))]
            self.answer([{k: r.get(k) for k in opts["select"].split(",")} if "select" in opts else r for r in got])

    do_GET = do_POST = do_DELETE = handle_any


@pytest.fixture
def server(spark):
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}"
    resttable.register(spark)
    yield s
    s.shutdown()


SCHEMA = "id long, name string, score double, at timestamp"


def people(n):
    return [{"id": i, "name": f"n{i % 7}" if i % 5 else None, "score": i / 2, "at": f"2024-01-{i % 28 + 1:02d}T00:00:00"} for i in range(n)]


def load(spark, server, **o):
    r = spark.read.format("resttable").schema(SCHEMA).option("url", server.url).option("table", "people").option("apiKey", "k")
    return r.options(**o).load()


def test_filters_columns_and_parts(spark, server):
    server.tables["people"] = people(3000)
    d = load(spark, server, rows=700)
    assert d.rdd.getNumPartitions() == 5
    assert sorted(r.id for r in d.collect()) == list(range(3000))
    server.asked.clear()
    got = d.filter((F.col("id") >= 100) & (F.col("id") < 2900) & F.col("name").isin("n1", "n2") & F.col("name").startswith("n1") & (F.length("name") == 2))
    assert sorted(r.id for r in got.collect()) == [i for i in range(100, 2900) if i % 5 and i % 7 == 1]
    sent = {tuple(c) for _, _, q, _ in server.asked for c in q}
    assert {("id", "gte.100"), ("id", "lt.2900"), ("name", 'in.("n1","n2")'), ("name", "like.n1*"), ("name", "not.is.null")} <= sent
    assert all(h["apikey"] == "k" and h["authorization"] == "Bearer k" for *_, h in server.asked)
    assert max(int(dict(q).get("limit", 0)) for _, _, q, _ in server.asked) <= resttable.BATCH
    assert d.filter("name is null and not (id in (5, 10))").count() == 598
    small = spark.read.format("resttable").schema("score double").option("url", server.url).option("table", "people").load()
    server.asked.clear()
    assert small.agg(F.sum("score")).first()[0] == sum(i / 2 for i in range(3000))
    assert {dict(q)["select"] for _, _, q, _ in server.asked} == {"id", "score,id"}


def test_rows_of_one_key_over_many_requests(spark, server):
    server.tables["people"] = [{**r, "id": r["id"] // 1300} for r in people(3000)]
    assert sorted(r.score for r in load(spark, server, rows=400).collect()) == [i / 2 for i in range(3000)]
    server.tables["people"] = []
    assert load(spark, server).count() == 0


def write(df, server, mode="append"):
    df.write.format("resttable").option("url", server.url).option("table", "people").mode(mode).save()


def test_a_write_merges_by_key_and_replaces(spark, server):
    server.tables["people"] = people(10)
    write(spark.range(5, 2005).selectExpr("id", "'new' AS name").repartition(4), server)
    t = {r["id"]: r for r in server.tables["people"]}
    assert len(t) == 2005 and t[4]["name"] == "n4" and t[7] == {"id": 7, "name": "new", "score": 3.5, "at": "2024-01-08T00:00:00"}
    assert server.tables["people_stage"] == []
    write(spark.range(3).selectExpr("id", "timestamp'2024-01-02 03:04:05' AS at"), server, "overwrite")
    assert sorted(r["id"] for r in server.tables["people"]) == [0, 1, 2]
    assert load(spark, server).agg(F.min("at").cast("string")).first()[0] == "2024-01-02 03:04:05"
    write(spark.range(0).selectExpr("id"), server)
    assert len(server.tables["people"]) == 3


def test_a_failed_task_leaves_nothing(spark, server):
    server.tables["people"] = people(10)
    fails = spark.range(2000).repartition(4).select("id", F.when(F.col("id") == 1234, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).alias("name"))
    with pytest.raises(PySparkException, match="broken"):
        write(fails, server)
    assert server.tables["people"] == people(10) and server.tables["people_stage"] == []
    server.refuse_after = 1000
    with pytest.raises(PySparkException, match="full"):
        write(spark.range(4000).selectExpr("id"), server)
    assert server.tables["people"] == people(10) and server.tables["people_stage"] == []


def test_a_stream_reads_each_row_once(spark, server, tmp_path):
    server.tables["people"] = people(1500)
    d = spark.readStream.format("resttable").schema(SCHEMA).option("url", server.url).option("table", "people").option("follow", "id").option("rows", 400).load()

    def run():
        q = d.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    read = lambda: sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == list(range(1500))
    run()
    assert read() == list(range(1500))
    server.tables["people"] += [{**r, "id": r["id"] + 1500} for r in people(700)]
    run()
    assert read() == list(range(2200))


def test_a_stream_needs_a_column_to_follow(spark, server):
    with pytest.raises(PySparkException, match="follow"):
        q = spark.readStream.format("resttable").schema(SCHEMA).option("url", server.url).option("table", "people").load().writeStream.format("noop").option("checkpointLocation", f"/tmp/ck-{server.server_port}").start()
        q.awaitTermination(60)
