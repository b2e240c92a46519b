import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.plans import text
from millrace.plans.mission import Abort

HEAD = 'mission T { source API { auth: bearer, base: "https://x" } store raw: memory("raw") store out: memory("out") store other: file("o") '


def run(spark, body, stores, sources=None, name="out"):
    m = text.run(HEAD + body + " run A }", spark, stores, sources)
    return [r.asDict(recursive=True) for r in m.stores[name].scan().collect()]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([("1", "A", 100, [1, 2]), ("2", "I", 200, [3]), ("3", "X", 5, [])], "id string, state string, amount int, parts array<int>")


def test_filter_map_match_store(spark, raw):
    got = run(spark, """action A { for item in raw where .amount > 10 { // keep the large
        map item -> P { id: .id, name: "n-" + .state, status: match .state { "A" => "active", _ => "other" }, big: .amount >= 200 ? "y" : "n" }
        validate response { assume length(.id) > 0, assume .name != "" }
        store response -> out { key: .id, partial: true } } }""", {"raw": raw})
    assert sorted(got, key=lambda r: r["id"]) == [{"id": "1", "name": "n-A", "status": "active", "big": "n", "_partial": True}, {"id": "2", "name": "n-I", "status": "other", "big": "y", "_partial": True}]


def test_nested_loops_are_joins_and_explodes(spark, raw):
    other = spark.createDataFrame([("1", "x"), ("1", "y"), ("9", "z")], "id string, k string")
    body = """action A { for a in raw { for b in other where .id == a.id { let both = a.state + b.k
        store { k: both, n: a.amount } -> out { key: .k } } } }"""
    got = run(spark, body, {"raw": raw, "other": other.withColumn("id0", F.col("id")).select("id", "k")})
    assert [(r["k"], r["n"]) for r in got] == [("Ay", 100)]  # of the two rows of key 1 the last is left
    got = run(spark, "action A { for a in raw { for p in a.parts { store { id: a.id, p: p } -> out { key: p } } } }", {"raw": raw})
    assert sorted((r["id"], r["p"]) for r in got) == [("1", 1), ("1", 2), ("2", 3)]


def test_match_routes_and_directives(spark, raw):
    body = """schema Rich { id: string, amount: int } schema Odd { nope: string }
      action A { for r in raw { match r {
        Odd -> abort "never", Rich where .amount > 150 -> { store r -> out { key: .id } }, Rich where .amount < 10 -> queue other, _ -> skip }
        store { id: r.id, seen: true } -> out { key: .id, upsert: true } } }"""
    m = text.run(HEAD + body + " run A }", spark, {"raw": raw})
    assert {r.id: (r.amount, r.seen) for r in m.stores["out"].scan().collect()} == {"2": (200, True)}
    assert [r["item"] for r in m.stores["other"].scan().collect()] == ['{"id":"3","state":"X","amount":5,"parts":[]}']
    with pytest.raises(PySparkException, match="never"):
        text.run(HEAD + 'action A { for r in raw { match r { _ -> abort "never" } store r -> out { key: .id } } } run A }', spark, {"raw": raw}).stores["out"].scan().collect()


def test_transform_and_fetch(spark, raw):
    def api(s, request):
        assert request["path"] == "/items" and request["verb"] == "get"
        return s.createDataFrame([(1, [("a", 2)])], "total int, items array<struct<id: string, n: int>>")

    body = """transform Norm { (Big) where .n > 1 -> Item { id: .id, size: "big" }, (_) -> Item { id: .id, size: "small" } } schema Big { n: int }
      action A { get "/items" { paginate: page(page, 100) } store response.items -> raw { key: .id } for x in raw { apply Norm to x as y store y -> out } }"""
    assert run(spark, body, {}, {"API": api}) == [{"id": "a", "size": "big"}]


def test_stages_and_conditions(spark, raw):
    body = """action A { for r in raw { store r -> out { key: .id } } } action B { for r in raw { store r -> other { key: .id } } }
      action C { store { id: "never" } -> out } schedule: every 5 minutes run [A, B] then C if 1 > 2 }"""
    m = text.run(HEAD + body, spark, {"raw": raw})
    assert m.stores["out"].scan().count() == 3 and m.stores["other"].scan().count() == 3
    assert [s["status"] for s in m.state] == ["completed", "skipped"]
    assert text.parse(HEAD + body).schedule == ("every", 300)


@pytest.mark.parametrize("body", ["action A { store 1 -> nope } run A }", "action A { } run B }", "action A { } }", "action A { frob x } run A }", "action A { } action A { } run A }", "action A { let x = } run A }", "@ run A }"])
def test_faults(body):
    with pytest.raises(text.SyntaxFault):
        text.parse(HEAD + body)


def test_failed_stage_names_its_action(spark, raw):
    with pytest.raises(Abort, match="B: "):
        text.run(HEAD + "action A { for r in raw { store r -> out } } action B { for r in raw.id { } } run [A, B] }", spark, {"raw": raw})


@pytest.mark.parametrize("src,want", [("1 + 2 * 3", 7.0), ("-(1 + 2) * 2", -6.0), ("not 0 and 2 > 1", True), ('"a" + 1', "a1"), ("true ? 1 : 2", 1.0), ("[1, 2] is array", True), ("any of [1, 5, 9] ", None), ("null ?? 4", 4.0), ("round(2.5)", 3.0), ('match { 1 > 2 => "x", 2 > 1 => "y" }', "y"), ("5 % 3", 2.0)])
def test_expressions(spark, src, want):
    r = text.Reader(src)
    e = r.expression()
    assert r.now.kind == "end"
    c = text.Compiler(text.Program("x"), spark)
    got = spark.range(1).select(c.expr(e, spark.range(1), None).alias("v")).first()[0]
    assert got == want or (want is None and got in (1.0, 5.0, 9.0))


def test_wait_takes_the_first_events(spark):
    rows = [(i, "2024-01-01 00:00:%02d" % i, (i, "ok" if i % 2 else "no")) for i in range(9)]

    def events(s, path):
        assert path == "/hook"
        return s.createDataFrame(rows, "id int, receivedAt string, body struct<seq: int, kind: string>").withColumn("receivedAt", F.col("receivedAt").cast("timestamp"))

    body = 'action A { wait { path: "/hook", expectedEvents: 6, timeout: 4000, eventFilter: .kind == "ok", storage: { target: other, key: .seq } } store response -> out { key: .seq } } run A }'
    m = text.run(HEAD + body, spark, events=events)
    assert sorted(r.seq for r in m.stores["out"].scan().collect()) == [1, 3]
    assert sorted(r.seq for r in m.stores["other"].scan().collect()) == [1, 3]


def test_a_mission_of_several_files():
    p = text.read_folder({"b.txt": "action B { let x = 1 }", "mission.txt": HEAD + "action A { } run A then B }"})
    assert list(p.actions) == ["A", "B"]
    with pytest.raises(text.SyntaxFault):
        text.read_folder({"b.txt": "action A { }", "mission.txt": HEAD + "action A { } run A }"})
    with pytest.raises(text.SyntaxFault):
        text.read_folder({"b.txt": "action A { }"})


def test_new_steps_and_expressions(spark, raw):
    body = """action A { for r in raw { store { id: r.id, many: count(r.parts where r.amount > 150), first: r.parts[0], size: if r.amount > 50 then "big" else "small", upto: 1..2 } -> out { key: .id } }
        delete out["3"] }"""
    got = run(spark, body, {"raw": raw})
    assert sorted((r["id"], r["first"], r["size"], r["upto"]) for r in got) == [("1", 1, "big", [1, 2]), ("2", 3, "big", [1, 2])]
    assert run(spark, "action A { for r in raw { store r -> out { key: .id } } clear out }", {"raw": raw}) == []


def test_unknown_sources_are_refused(spark, raw):
    with pytest.raises(text.SyntaxFault, match="unknown source"):
        run(spark, 'action A { get "/x" { source: Nope } }', {"raw": raw})


@pytest.fixture
def sales(spark):
    kind = "id int, lines array<struct<sku: string, price: int, n: int>>, tags array<int>"
    return spark.createDataFrame([(1, [("a", 10, 2), ("b", None, 1), ("c", 30, 1)], [3, 1]), (2, [], []), (3, None, None)], kind)


def _record(spark, sales, fields):
    got = run(spark, "action A { for r in raw { store { id: r.id, " + fields + " } -> out { key: .id } } }", {"raw": sales})
    return {r["id"]: r for r in got}


def test_pipes_lambdas_and_projections(spark, sales):
    got = _record(spark, sales, """piped: r.lines | filter(.price > 5) | map({ sku: .sku, twice: .price * 2 }), total: sum(r.lines | filter(.price > 0) | map(.price)),
        worth: r.lines | filter(x => x.price > 0) | sum(x => x.price * x.n), skus: r.lines.sku | join("-"), folded: reduce(r.tags, 10, (a, x) => a + x),
        many: r.lines | count(.n == 1), dear: r.lines | some(.price >= 30), cheap: r.lines | every(l => l.price < 20), found: find(r.lines, l => l.sku == "c"),
        nested: map(r.tags, t => count(r.lines | filter(l => l.n == t))), ordered: r.tags | sortBy(t => t)""")
    one, two = got[1], got[2]
    assert one["piped"] == [{"sku": "a", "twice": 20.0}, {"sku": "c", "twice": 60.0}]  # a null price is no match
    assert (one["total"], one["worth"], one["skus"], one["folded"], one["many"], one["dear"], one["cheap"]) == (40.0, 50.0, "a-b-c", 14.0, 2, True, False)
    assert one["found"] == {"sku": "c", "price": 30, "n": 1} and one["nested"] == [0, 2] and one["ordered"] == [1, 3]
    assert two["piped"] == [] and two["worth"] == 0 and two["folded"] == 10 and two["cheap"] is True and two["found"] is None
    assert got[3]["piped"] is None and got[3]["many"] == 0


@pytest.mark.parametrize("src,want", [('split("a.b", ".") | join("-")', "a-b"), ("round(2.456, 2)", 2.46), ('formatDate(parseDate("2024-03-05"), "YYYY")', "2024"), ('"ab" | uppercase', "AB"), ("[1, 2, 3] | map(x => x * 2) | sum", 12.0), ('"abcd" | substring(1, 3)', "bc")])
def test_pipes_of_values(spark, src, want):
    one = spark.range(1)
    c = text.Compiler(text.Program("x"), spark)
    assert one.select(c.expr(text.Reader(src).expression(), one, None).alias("v")).first()[0] == want


def test_let_narrows_a_collection(spark, sales):
    got = run(spark, "let least = 20 action A { for r in raw { let dear = r.lines where .price > least store { id: r.id, n: count(dear) } -> out { key: .id } } }", {"raw": sales})
    assert {r["id"]: r["n"] for r in got} == {1: 1, 2: 0, 3: 0}


def test_match_patterns(spark):
    kind = "id int, state string, err struct<code: int>, parts array<struct<sku: string>>"
    rows = spark.createDataFrame([(1, "bad", (7,), [("a",)]), (2, "ok", (3,), []), (3, None, None, [("b",), (None,)]), (4, "bad", None, None)], kind)
    body = """schema Part { sku: string } action A { for r in raw {
        match r { { state: "bad", err: { code: c } } where c > 5 -> { store { id: r.id, what: "code", code: c } -> out { key: .id } },
                  { parts: [] } -> { store { id: r.id, what: "none", code: 0 } -> out { key: .id } },
                  { parts: [Part] } -> { store { id: r.id, what: "parts", code: 0 } -> out { key: .id } },
                  rest where rest.id == 3 -> { store { id: r.id, what: "third", code: 0 } -> out { key: .id } }, _ -> skip } } }"""
    got = {r["id"]: (r["what"], r["code"]) for r in run(spark, body, {"raw": rows})}
    assert got == {1: ("code", 7), 2: ("none", 0), 3: ("third", 0)}
    with pytest.raises(text.SyntaxFault, match="has a value already"):
        run(spark, "action A { for r in raw { match r { r -> skip } } }", {"raw": rows})


def test_match_without_subject_and_run_arm(spark, raw):
    body = """action B { store { id: "ran" } -> other { key: .id } } action A { for r in raw {
        match { r.amount > 150 -> { store { id: r.id } -> out { key: .id } }, r.amount < 10 -> run B, _ -> skip } } }"""
    m = text.run(HEAD + body + " run A }", spark, {"raw": raw})
    assert [r.id for r in m.stores["out"].scan().collect()] == ["2"] and [r.id for r in m.stores["other"].scan().collect()] == ["ran"]
    with pytest.raises(text.SyntaxFault, match="unknown action"):
        text.parse(HEAD + "action A { for r in raw { match r { _ -> run Nope } } } run A }")


class _Api:
    """Pages of two; the third says that it is empty of interest."""

    backoff = None

    def request(self, verb, path, params=None, body=None):
        n = int(params["page"])
        return {"items": [{"id": 10 * n + k, "at": f"2024-05-0{n}T00:00:00Z", "asked": json.dumps(params)} for k in range(2)], "meta": {"stop": n == 3}}


def test_until_since_and_checkpoints(spark):
    from millrace.sources.paging import Endpoint

    body = 'source Items { base: "http://y" } action A { get Items "/items" { paginate: page(page, 2), until: response.meta.stop == true, since: lastSync("k") { param: "after", format: "date-only", updateFrom: "at" } } store response -> out { key: .id } } run A }'
    api = {"Items": Endpoint(_Api(), "id long, at string, asked string")}
    m = text.run(HEAD + body, spark, sources=api)
    rows = {r.id: json.loads(r.asked) for r in m.stores["out"].scan().collect()}
    assert sorted(rows) == [10, 11, 20, 21] and rows[10] == {"after": "1970-01-01", "page": 1}
    assert m.marks.last("k").startswith("2024-05-02")
    again = text.run(HEAD + body, spark, sources=api, marks=m.marks)
    assert json.loads(again.stores["out"].scan().first().asked)["after"] == "2024-05-02"


@pytest.mark.parametrize("src,page,want", [("length(response.items) == 0", {"items": []}, True), ("length(response.items) == 0", {"items": [1]}, False), ("response.next == null", {}, True), ("response.n > 3 or not response.more", {"n": 2, "more": True}, False), ("response.n > 3", {}, False), (".ok == 1", {"ok": True}, False)])
def test_page_conditions(src, page, want):
    assert text.page_condition(text.Reader(src).expression())(page) is want
    with pytest.raises(text.SyntaxFault):
        text.page_condition(text.Reader("1 + 2").expression())


def test_retry_sets_the_backoff():
    from millrace.sources.paging import Endpoint
    from millrace.sources.resilience import Client

    o = text.Reader("{ maxAttempts: 5, backoff: linear, initialDelay: 10, maxDelay: 100 }").options()
    b = Endpoint(Client("http://x"), "a int").with_retry(text._backoff(o)).client.backoff
    assert (b.attempts, b.kind, b.initial, b.most) == (5, "linear", 10, 100)


def test_last_write_is_the_loops_last(spark):
    a = spark.range(400, numPartitions=1).selectExpr("id", "id % 7 AS k")
    b = spark.range(30, numPartitions=1).selectExpr("id % 7 AS k", "id AS n")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = run(spark, "action A { for x in raw { for y in other where .k == x.k { store { k: y.k, id: x.id, n: y.n } -> out { key: .k } } } }", {"raw": a, "other": b})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted((r["k"], r["id"], r["n"]) for r in got) == sorted((k, max(i for i in range(400) if i % 7 == k), max(i for i in range(30) if i % 7 == k)) for k in range(7))
