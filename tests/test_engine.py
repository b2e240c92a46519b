"""Stores, routes, pages, missions, schedules, connectors and streams."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import joins, steps
from millrace.operators.schema import Schema
from millrace.operators.stores import Catalog, Store
from millrace.plans import Action, Mission, Stage, schedule
from millrace.plans import mission as missions
from millrace.sources import openapi, paging, resilience, sync
from millrace.streaming import breaker, waits

PEOPLE = [("1", "Ann", 30, "active"), ("2", "Bob", 25, "inactive"), ("3", "Cid", 35, "active"), ("4", "Dee", 28, "active"), ("5", "Eve", 32, "inactive")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "id string, name string, age int, status string")


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_store_reads(people):
    s = Store("p").set(people, seq=F.col("id").cast("long"))
    assert ids(s.list({"status": "active"})) and sorted(ids(s.list({"status": "active"}))) == ["1", "3", "4"]
    assert ids(s.list(limit=2, offset=1)) == ["2", "3"]
    assert ids(s.list({"age": ("gt", 29), "name": ("contains", "n")})) == ["1"]
    assert s.count({"status": "inactive"}).first()[0] == 2 and s.get(3).first()["name"] == "Cid" and s.get("9").isEmpty()
    assert ids(s.ordered()) == ["1", "2", "3", "4", "5"]
    with pytest.raises(LookupError):
        Store("none").scan()


def test_store_writes(spark, people):
    s = Store("p").set(people, seq=F.col("id").cast("long"))
    change = spark.createDataFrame([("1", 26), ("9", 40), ("1", 27)], "id string, age int").coalesce(1)
    up = {r.id: (r.name, r.age) for r in s.upsert(change).scan().collect()}
    assert up["1"] == ("Ann", 27) and up["9"] == (None, 40) and up["2"] == ("Bob", 25)
    only = {r.id: r.age for r in s.update(change).scan().collect()}
    assert only["1"] == 27 and "9" not in only
    st = {r.id: (r.name, r.age) for r in s.set(change).scan().collect()}
    assert st["1"] == (None, 27) and len(st) == 6
    assert sorted(ids(s.delete(change, F.col("id")).scan())) == ["2", "3", "4", "5"]
    assert s.clear().scan().isEmpty()
    null = spark.createDataFrame([("1", None)], "id string, age int")
    assert {r.id: r.age for r in s.upsert(null, present={"age": F.lit(True)}).scan().collect()}["1"] is None
    k = Store("k").set(people, F.concat("status", F.lit("-"), "id")).table
    assert "active-1" in ids(k, "_key")
    assert Store("r").set(people.select("name")).table.select("_key").distinct().count() == 5


def test_catalog_saves_and_loads(spark, people, tmp_path):
    c = Catalog(spark, {"p": people})
    c.save("p", str(tmp_path / "p"))
    assert Catalog(spark).load("p", str(tmp_path / "p")).scan().count() == 5
    c.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/p")).count() == 5
    (tmp_path / "o.json").write_text(json.dumps({"b": {"x": 1}, "a": {"x": 2}}))
    got = c.load_json_object("o", str(tmp_path / "o.json")).table.collect()
    assert {r._key: json.loads(r.record)["x"] for r in got} == {"b": 1, "a": 2}
    (tmp_path / "bad.json").write_text("{nope")
    assert c.load_json_object("bad", str(tmp_path / "bad.json")).table.isEmpty()
    assert c.names() == ["bad", "o", "p"]


def test_routes_and_checks(people):
    arms = [steps.Arm("grown", Schema.of("P", age="int"), F.col("age") > 29), steps.Arm("young", guard=F.col("age") > 26, directive="skip")]
    with pytest.raises(PySparkException, match="no arm"):
        steps.route(people, arms).collect()
    assert sorted(r._arm or "-" for r in steps.route(people, arms, strict=False).collect()) == ["-", "grown", "grown", "grown", "young"]
    with pytest.raises(PySparkException, match="stop"):
        steps.route(people, [steps.Arm("x", directive="abort", message="stop")]).collect()
    with pytest.raises(PySparkException, match="adult"):
        steps.check(people, [steps.Constraint("adult", F.col("age") > 29)]).collect()
    assert steps.check(people, [steps.Constraint("adult", F.col("age") > 29, "warning")]).count() == 5
    with pytest.raises(PySparkException, match="no variant"):
        steps.apply_transform(people, [steps.Variant({"i": F.col("id")}, Schema.of("Q", nope="int"))]).collect()
    with pytest.raises(ValueError):
        steps.apply_transform(people, [])
    with pytest.raises(TypeError):
        steps.unnest(people, "name", "x")
    dead = steps.dead_letters(people, "r", F.col("status"))
    again = steps.dead_letters(people.filter("status = 'active'"), "r", F.col("status"), dead)
    assert {r.key: r.attempts for r in again.collect()} == {"active": 6, "inactive": 2}


def test_joins(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 15.0), (3, 99.0)], "k int, x double")
    b = spark.createDataFrame([(7, 0.0, 10.0), (8, 4.0, 30.0)], "id int, low double, high double")
    assert sorted((r.k, r.id) for r in joins.band_join(a, b, "x", "low", "high", 8.0).collect()) == [(1, 7), (1, 8), (2, 8)]


def pages(n=6, size=3):
    def fetch(q):
        at = q.get("offset", (q.get("page", 1) - 1) * size)
        return {"meta": 1, "items": [{"id": i} for i in range(at, min(n, at + size))]}

    return fetch


def test_paging():
    take = lambda *a, **k: [r["id"] for r in paging.read_pages(*a, **k)]
    assert take(pages(), paging.Offset("offset", 3)) == list(range(6))
    assert take(pages(7), paging.Page("page", 3)) == list(range(7))
    assert take(pages(9), paging.Offset("offset", 3), until=lambda p: p["items"][0]["id"] == 6) == list(range(6))
    # pages beyond the limit are an error, unless the caller stops there knowingly
    with pytest.raises(paging.TooManyPages):
        take(pages(10**6), paging.Page("page", 3))
    assert len(take(pages(10**6), paging.Page("page", 3), last=False)) == 300

    def cursor(q):
        n = int(q.get("after", 0))
        return {"items": [{"id": n}], "meta": {"next": n + 1.0 if n < 4 else None}}

    assert take(cursor, paging.Cursor("after", 1, "meta.next")) == [0, 1, 2, 3, 4]
    assert paging.rows_of([1, 2]) == [] and paging.rows_of({"a": 1}) == []


def test_paged_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            body = json.dumps(pages(17, 5)({"page": int(q["page"][0])})).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(paging.PagedSource)
        df = spark.read.format("paged").schema("id long").options(base=f"http://127.0.0.1:{server.server_port}", path="/x", paging="page", param="page", size="5", pages="4", splits="2").load()
        assert sorted(ids(df)) == list(range(17))
    finally:
        server.shutdown()


def test_client():
    sent, slept = [], []

    def answers(*seq):
        it = iter(seq)

        def send(verb, url, headers, body, timeout):
            sent.append((url, headers.get("Authorization")))
            return next(it)

        return send

    def client(*seq, **k):
        return resilience.Client("http://x", send=answers(*seq), sleep=slept.append, clock=lambda: 1000.0, **k)

    assert client((200, {}, b'{"a": 1}')).request("get", "/p", {"q": 1}) == {"a": 1} and sent[-1][0] == "http://x/p?q=1"
    assert client((500, {}, b""), (200, {}, b"[]")).request("get", "/") == [] and slept
    slept.clear()
    assert client((429, {"Retry-After": "7"}, b""), (200, {}, b"1")).request("get", "/") == 1 and max(slept) >= 7
    assert client((404, {}, b'"no"')).request("get", "/") == "no"
    tokens = []
    client((401, {}, b""), (200, {}, b"1"), token=lambda fresh: tokens.append(fresh) or "t").request("get", "/")
    assert tokens == [False, True] and sent[-1][1] == "Bearer t"
    with pytest.raises(resilience.BreakerOpen):
        client(*[(500, {}, b"")] * 9, breaker=resilience.Breaker(failures=2)).request("get", "/")


def test_backoff_breaker_limiter():
    b = resilience.Backoff(1000, 5000)
    assert [b.delay(n, False) for n in (1, 2, 3, 4)] == [1000, 2000, 4000, 5000]
    assert resilience.Backoff(10, 99, "linear").delay(3, False) == 30 and resilience.Backoff(10, 99, "constant").delay(3, False) == 10
    k = resilience.Breaker(failures=2, window=60, reset=30, successes=2)
    k.failure(0), k.failure(100)
    assert k.state == "closed"
    k.failure(101)
    assert k.state == "open" and not k.allow(110) and k.allow(131) and k.state == "half-open"
    k.success(131), k.success(132)
    assert k.state == "closed"
    lim = resilience.Limiter(per_minute=2)
    lim.sent(0), lim.sent(1)
    assert lim.wait(2) == 58
    with pytest.raises(resilience.RateLimited):
        resilience.Limiter("fail", per_minute=0, _sent=[0.0]).wait(1)


def test_since(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.678Z",), ("1704164645",), ("1704164645678",), ("nope",)], "s string")
    got = [str(r[0])[:19] if r[0] else None for r in df.select(sync.parse_since(F.col("s"))).collect()]
    assert got == ["2024-01-02 03:04:05"] * 3 + [None]
    w = sync.Watermarks(spark)
    assert w.last("k") == "1970-01-01 00:00:00"
    e = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03")], "id int, d string").withColumn("t", F.to_timestamp("d"))
    w = w.advance("k", e, "t").advance("k", e.limit(0), "t")
    assert w.last("k").startswith("2024-01-03") and w.since(e, "k", "t").isEmpty()
    assert sync.checkpoint_key("api", "/users/{id}/x") == "api:users_id_x"


SPEC = {
    "servers": [{"url": "http://api"}],
    "paths": {"/pets/{id}": {"get": {"operationId": "getPet", "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}}}}},
    "components": {"schemas": {"Pet": {"type": "object", "required": ["id", "name"], "properties": {"id": {"type": "integer", "minimum": 1}, "name": {"type": "string", "pattern": "^[A-Z]"}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "minLength": 2}}, "kind": {"type": "string", "enum": ["cat", "dog"]}}}}},
}


def test_descriptions(spark):
    base, ops = openapi.load(json.dumps(SPEC))
    op = ops["getPet"]
    assert (base, op.verb, op.path) == ("http://api", "get", "/pets/{id}")
    rows = openapi.mock_rows(spark, op.response, 3).collect()
    assert len(rows) == 3 and rows[0].kind == "cat" and rows[0].tags == ["string", "string"]
    df = spark.createDataFrame([(1, 0, "ann", ["a", "bb", "cc"], "cow"), (2, 5, "Bo", ["xx"], "dog"), (3, 6, None, None, None)], "k int, id long, name string, tags array<string>, kind string")
    got = {(r.k, r.path) for r in openapi.violations(df, op.response, "k").collect()}
    assert got == {(1, "id"), (1, "name"), (1, "tags"), (1, "tags[]"), (1, "kind"), (3, "name")}
    assert ids(openapi.enforce(df, op.response, "k", "split")[0], "k") == [2]
    assert openapi.enforce(df, op.response, "k", "warning")[0].count() == 3
    with pytest.raises(PySparkException):
        openapi.enforce(df, op.response, "k", "strict")[0].collect()


def test_missions(spark, people):
    def load(ctx):
        ctx.store("a", people, seq=None)

    def double(ctx):
        d = ctx.read("a")
        ctx.store("b", d.withColumn("age", F.col("age") * 2))
        return d

    tries = []

    def flaky(ctx):
        tries.append(1)
        if len(tries) < 3:
            raise missions.Retry
        raise missions.Jump("Load", "continue")

    quick = resilience.Backoff(0, 0)
    seen = []
    m = Mission("m", spark, [Action("Load", load), Action("Double", double), Action("Flaky", flaky, backoff=quick)], [Stage(["Load"]), Stage(["Double", "Flaky"]), Stage(["Load"], when=lambda m: False)], on_event=lambda k, _: seen.append(k)).run()
    assert m.stores["b"].scan().agg(F.sum("age")).first()[0] == 300 and len(tries) == 3
    assert [r.status for r in m.audit().collect()] == ["completed", "completed", "skipped"] and m.resume_point() == -1
    assert seen[0] == "mission.start" and seen[-1] == "mission.end"

    def bad(ctx):
        raise ValueError("no")

    f = Mission("f", spark, [Action("Load", load), Action("Bad", bad)], [Stage(["Load"]), Stage(["Bad", "Load"])])
    with pytest.raises(missions.Abort, match="Bad: no"):
        f.run()
    assert f.resume_point() == 1 and missions.progress(f.audit()).first().percent == 50
    f.actions["Bad"] = Action("Bad", load)
    assert f.run(resume=f.state).resume_point() == -1
    with pytest.raises(ValueError):
        Mission("x", spark, [], [Stage(["Nope"])])
    dry = Mission("d", spark, [Action("Load", bad, mock=lambda c: people)], [Stage(["Load"])], dry_run=True).run()
    assert dry.state[0]["status"] == "completed"


def test_cron_and_scheduler():
    t = datetime(2024, 1, 31, 10, 7, tzinfo=UTC)
    assert schedule.Cron.parse("*/15 * * * *").next_after(t) == datetime(2024, 1, 31, 10, 15, tzinfo=UTC)
    assert schedule.Cron.parse("0 9-17/4 1,15 * *").next_after(t) == datetime(2024, 2, 1, 9, 0, tzinfo=UTC)
    assert schedule.Cron.parse("30 6 * * 1").next_after(t) == datetime(2024, 2, 5, 6, 30, tzinfo=UTC)
    assert schedule.Cron.parse("0 0 31 2 *").next_after(t) is None
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            schedule.Cron.parse(bad)
    now = [t]
    ran = []

    def fail():
        ran.append("f")
        raise RuntimeError("x")

    jobs = [schedule.Job("i", lambda: ran.append("i"), every=60), schedule.Job("c", lambda: ran.append("c"), cron=schedule.Cron.parse("8 10 * * *")), schedule.Job("a", lambda: ran.append("a"), at=t + timedelta(minutes=2)), schedule.Job("f", fail, at=t, retries=2)]
    s = schedule.Scheduler(jobs, clock=lambda: now[0], sleep=lambda x: None)
    for _ in range(4):
        s.tick()
        now[0] += timedelta(minutes=1)
    assert ran.count("i") == 4 and ran.count("c") == 1 and ran.count("a") == 1 and ran.count("f") == 3 and len(jobs[3].errors) == 3


def test_bodies_and_sweep(spark):
    df = spark.createDataFrame([('{"a": 1}', "application/json"), ("x=1&y=2", "application/x-www-form-urlencoded"), ("{bad", "application/json"), ('te"xt', "text/plain")], "raw string, t string")
    got = [json.loads(r[0]) for r in df.select(F.to_json(waits.decode_body(F.col("raw"), F.col("t")))).collect()]
    assert got == [{"a": 1}, {"x": "1", "y": "2"}, "{bad", 'te"xt']
    reg = spark.createDataFrame([("r1", 10), ("r2", 1)], "id string, expires_at int")
    ev = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3")], "id int, registration_id string")
    assert ids(waits.sweep(ev, reg, F.lit(5))) == [1]


def test_breaker_states(spark):
    rows = [("s", datetime(2024, 1, 1, 0, 0, i), True) for i in range(6)] + [("s", datetime(2024, 1, 1, 0, 1, 0), False), ("s", datetime(2024, 1, 1, 0, 1, 1), False)]
    got = breaker.states(spark.createDataFrame(rows, "src string, ts timestamp, bad boolean"), "src", "ts", "bad").orderBy("ts").collect()
    assert [r.state for r in got] == ["closed"] * 4 + ["open", "refused", "half-open", "closed"]


def test_collect_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("a", "4")], "reg string, body string").coalesce(1).write.parquet(src)
    events = spark.readStream.schema("reg string, body string").parquet(src)
    out = waits.collect_stream(events, "reg", "body", 2)
    q = out.writeStream.format("memory").queryName("collected").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("collected").collect()
    assert [(r.registration, r.n, sorted(r.bodies), r.complete) for r in got] == [("a", 2, ["1", "2"], True)]


def test_comparisons_reach_the_scan(spark, sf_dir, capsys):
    from millrace import queries

    for name, want in (("for_where_filter", "GreaterThanOrEqual(l_quantity,30.0)"), ("flagship_orders", "PushedFilters: [IsNotNull")):
        queries.QUERIES[name](spark, sf_dir).explain("formatted")
        assert want in capsys.readouterr().out, name


def test_more_pages_than_allowed_are_an_error():
    from millrace.sources import paging

    pages = lambda q: {"rows": [{"n": q["page"]}] * 2}
    with pytest.raises(paging.TooManyPages):
        list(paging.read_pages(pages, paging.Page("page", 2), most=3))
    assert len(list(paging.read_pages(pages, paging.Page("page", 2), most=3, last=False))) == 6


def test_pages_of_keys_with_gaps(spark):
    from millrace.sources import paging

    d = spark.range(0, 1000, 10).select(F.col("id").alias("k"))
    assert {r.page: r["count"] for r in paging.number_pages(d, "k", 50).groupBy("page").count().collect()} == {0: 50, 1: 50}


def test_a_store_is_saved_to_where_it_came_from(spark, tmp_path):
    from millrace.operators.stores import Catalog

    c = Catalog(spark, {"s": spark.createDataFrame([(1, "a")], "id long, v string")})
    for _ in range(2):
        c.save("s", f"{tmp_path}/s")
        assert [r.v for r in c["s"].scan().collect()] == ["a"]
    assert c.load_json_object("none", f"{tmp_path}/missing.json").scan().count() == 0


def test_dry_run_asks_and_writes_nothing(spark):
    from millrace.plans.mission import Action, Mission, Stage

    ran, seen = [], []
    m = Mission("m", spark, [Action("A", lambda ctx: ran.append(1))], [Stage(["A"])], dry_run=True, on_event=lambda k, i: seen.append(k)).run()
    assert not ran and "action.planned" in seen and m.state[0]["status"] == "completed"
