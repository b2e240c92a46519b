"""Stores inside expressions: lookups, correlated counts and sums, and names that don't exist."""

import pytest

from millrace.plans import text

HEAD = 'mission T { store cust: memory("c") store ord: memory("o") store out: memory("out") store odd: memory("odd") '


@pytest.fixture
def data(spark):
    cust = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (4, None, None)], "id long, name string, lim long")
    ord_ = spark.createDataFrame([(10, 1, 5.0, "x"), (11, 1, 50.0, "y"), (12, 2, 7.0, "x"), (13, 9, 1.0, "x"), (14, None, 2.0, "x")], "oid long, cid long, total double, kind string")
    m = {"cust": cust, "ord": ord_}
    return m


def run(spark, data, body, keys=("cust",)):
    stores = {k: v for k, v in data.items()}
    c = text.Compiler(text.parse(HEAD + "action A { " + body + " } run A }"), spark)
    for k, v in stores.items():
        c.stores.put(k, v, v["id" if k == "cust" else "oid"])
    return [r.asDict(recursive=True) for r in c.build().run().stores["out"].scan().collect()]


def each(spark, data, expression, **by):
    got = run(spark, data, f"for c in cust {{ store {{ id: c.id, v: {expression} }} -> out {{ key: .id }} }}")
    return [r["v"] for r in sorted(got, key=lambda r: r["id"])]


@pytest.mark.parametrize("expression,want", [
    ("count(ord)", [5, 5, 5, 5]),
    ("length(ord where .kind == \"x\")", [4, 4, 4, 4]),
    ("count(ord where .cid == ^.id)", [2, 1, 0, 0]),
    ("count(ord where .cid == c.id and .kind == \"x\")", [1, 1, 0, 0]),
    ("ord | filter(o => o.cid == c.id) | count", [2, 1, 0, 0]),
    ("count(ord, o => o.cid == c.id and o.total > 6)", [1, 1, 0, 0]),
    ("sum(ord where .cid == c.id, .total)", [55.0, 7.0, 0.0, 0.0]),
    ("sum(ord where .cid == c.id, o => o.total * 2)", [110.0, 14.0, 0.0, 0.0]),
    ("max(ord where .cid == c.id, .total)", [50.0, 7.0, None, None]),
    ("any of ord where .cid == c.id", [True, True, False, False]),
    ("exists(ord where .cid == c.id and .total > 10)", [True, False, False, False]),
    ("count(ord where .cid == c.id) > 1 ? \"many\" : \"few\"", ["many", "few", "few", "few"]),
    ("ord[10].total + c.id", [6.0, 7.0, 8.0, 9.0]),
    ("ord[c.id + 9].kind", ["x", "y", "x", "x"]),
    ("count(ord where .oid > c.id + 10)", [3, 2, 1, 0]),
    ("count(ord where .oid > c.id + 10 and .cid == c.id)", [0, 0, 0, 0]),
    ("count(ord where .oid >= c.id + 10 and .cid == c.id)", [1, 1, 0, 0]),
])
def test_a_store_in_an_expression(spark, data, expression, want):
    assert each(spark, data, expression) == want


def test_a_looked_up_record_as_a_whole(spark, data):
    got = run(spark, data, "for c in cust { map c -> X { ...c, first: ord[c.id + 9] } store response -> out { key: .id } }")
    assert {r["id"]: r["first"] and r["first"]["oid"] for r in got} == {1: 10, 2: 11, 3: 12, 4: 13}
    got = run(spark, data, "for o in ord { store { id: o.oid, name: cust[o.cid].name } -> out { key: .id } }")
    assert {r["id"]: r["name"] for r in got} == {10: "a", 11: "a", 12: "b", 13: None, 14: None}


def test_loops_over_parts_of_a_store(spark, data):
    for source in ('(ord where .kind == "x")', 'ord | filter(.kind == "x")', 'ord | filter(x => x.kind == "x")'):
        got = run(spark, data, f"for o in {source} where .total > 1.5 {{ store {{ id: o.oid }} -> out {{ key: .id }} }}")
        assert sorted(r["id"] for r in got) == [10, 12, 14]
    got = run(spark, data, 'let xs = ord where .kind == "x" for o in xs { store { id: o.oid, n: count(xs), m: count(xs where .total < o.total) } -> out { key: .id } }')
    assert {r["id"]: (r["n"], r["m"]) for r in got} == {10: (4, 2), 12: (4, 3), 13: (4, 0), 14: (4, 1)}


def test_keys_that_are_and_are_not_there(spark, data):
    got = run(spark, data, "for o in ord where not exists(cust[o.cid]) { store { id: o.oid } -> out { key: .id } }")
    assert sorted(r["id"] for r in got) == [13, 14]
    got = run(spark, data, "for o in ord where exists(cust[o.cid]) and count(ord where .cid == ^.cid) > 1 { store { id: o.oid } -> out { key: .id } }")
    assert sorted(r["id"] for r in got) == [10, 11]


def test_the_scope_around(spark, data):
    got = run(spark, data, "for c in cust { for o in ord where .cid == ^.id { store { id: o.oid, n: c.name } -> out { key: .id } } }")
    assert {r["id"]: r["n"] for r in got} == {10: "a", 11: "a", 12: "b"}


@pytest.mark.parametrize("body", [
    "for c in cust { store { id: c.idd } -> out { key: .id } }",
    "for c in cust { store { id: nobody.id } -> out { key: .id } }",
    "for c in cust where .nope > 1 { store c -> out { key: .id } }",
    "for c in cust { store { id: c.id, n: count(ord where .cid == c.nope) } -> out { key: .id } }",
    "for c in cust { store { id: c.id, n: ord[c.id].nope } -> out { key: .id } }",
    "for c in cust { store { id: c.id, n: ^.nope } -> out { key: .id } }",
    "for c in cust { store { id: c.id, n: ord } -> out { key: .id } }",
    "for c in cust { store { id: c.id, n: sum(ord) } -> out { key: .id } }",
])
def test_unknown_names_raise(spark, data, body):
    with pytest.raises(text.SyntaxFault, match="is named|is a store|says of what"):
        run(spark, data, body)


def test_a_grouped_table_and_equi_joins(spark, data):
    """The store is grouped once by what the condition equates: no product of rows."""
    c = text.Compiler(text.parse(HEAD + "action A { for c in cust { store { id: c.id, n: count(ord where .cid == c.id) } -> out { key: .id } } } run A }"), spark)
    for k, v in data.items():
        c.stores.put(k, v, v["id" if k == "cust" else "oid"])
    plan = c.build().run().stores["out"].scan()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "Cross" not in plan
