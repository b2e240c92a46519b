import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import Semantics, catalog
from millrace.functions.semantics import is_missing, is_null, resolve
from millrace.operators.schema import Schema, variant_matches


def C(name):
    return F.col(name)


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame(
        [(1, 2.5, "12", "", "x", True, [1, 2, 3], None, (("Ann", 3), 7))],
        "i int, d double, n string, e string, t string, b boolean, a array<int>, z string, o struct<user: struct<name: string, age: int>, k: int>",
    )


def value(df, c):
    return df.select(c.alias("v")).first()[0]


@pytest.mark.parametrize(
    "col,want",
    [("i", True), ("0", False), ("double('nan')", False), ("e", False), ("t", True), ("'0'", True), ("b", True), ("not b", False), ("z", False), ("null", False), ("a", True), ("array()", True), ("o", True)],
)
def test_truthy(one, col, want):
    assert value(one, Semantics(one).truthy(F.expr(col))) is want


@pytest.mark.parametrize("col,want", [("i", 1.0), ("n", 12.0), ("e", 0.0), ("' 12 '", 12.0), ("b", 1.0), ("'1e3'", 1000.0)])
def test_number(one, col, want):
    assert value(one, Semantics(one).number(F.expr(col))) == want


@pytest.mark.parametrize("col", ["t", "z", "a", "o"])
def test_number_raises_or_is_null(one, col):
    col = C(col)
    with pytest.raises(PySparkException):
        value(one, Semantics(one).number(col))
    assert value(one, Semantics(one, lenient=True).number(col)) is None


@pytest.mark.parametrize("col,want", [("100D", "100"), ("1.5D", "1.5"), ("-0.25D", "-0.25"), ("i", "1"), ("b", "true"), ("z", "null"), ("a", "1,2,3"), ("o", "[object Object]")])
def test_string(one, col, want):
    assert value(one, Semantics(one).string(F.expr(col))) == want


def test_operators(one):
    s = Semantics(one)
    assert value(one, s.add(C("i"), C("d"))) == 3.5
    assert value(one, s.add(C("t"), C("i"))) == "x1"
    assert value(one, s.add(C("t"), C("z"))) == "x"
    assert value(one, s.subtract(C("n"), C("i"))) == 11.0
    assert value(one, s.multiply(C("n"), C("b"))) == 12.0
    assert value(one, s.divide(C("d"), 2)) == 1.25
    assert value(one, s.negate(C("n"))) == -12.0
    with pytest.raises(PySparkException):
        value(one, s.divide(C("i"), 0))
    assert value(one, Semantics(one, lenient=True).divide(C("i"), 0)) is None


def test_equality_is_strict(one):
    s = Semantics(one)
    assert value(one, s.equal(C("i"), 1.0)) is True
    assert value(one, s.equal(C("i"), "1")) is False
    assert value(one, s.equal(C("z"), F.lit(None))) is True
    assert value(one, s.equal(C("t"), C("z"))) is False


def test_order(one):
    s = Semantics(one)
    assert value(one, s.compare(C("n"), ">", 9)) is True
    with pytest.raises(PySparkException):
        value(one, s.compare(F.lit("2024-01-02"), ">", F.lit("2024-01-01")))
    assert value(one, s.compare(F.lit("2024-01-02"), ">", F.lit("2024-01-01"), native=True)) is True


def test_logic_and_choices(one):
    s = Semantics(one)
    assert value(one, s.both(C("i"), C("e"))) is False and value(one, s.either(C("e"), C("t"))) is True
    assert value(one, s.default(C("z"), C("t"))) == "x"
    assert value(one, s.choose(C("e"), "a", "b")) == "b"
    assert value(one, s.match(C("t"), [("y", 1), ("x", 2)])) == 2
    assert value(one, s.match(C("t"), [("y", 1)])) is None
    assert value(one, s.cases([(C("e"), 1), (C("i"), 2)], 3)) == 2
    assert value(one, s.any_of(C("a"), lambda x: x > 1)) == 2
    assert value(one, s.any_of(C("a"), lambda x: x > 9)) is None
    assert value(one, s.any_of(C("a"))) in (1, 2, 3)


@pytest.mark.parametrize("name,yes", [("string", "t"), ("int", "i"), ("number", "d"), ("boolean", "b"), ("array", "a"), ("object", "o"), ("null", "z")])
def test_types(one, name, yes):
    s = Semantics(one)
    for c in ("t", "i", "d", "b", "a", "o", "z"):
        want = c == yes or (name == "number" and c == "i")
        assert value(one, s.is_type(C(c), name)) is want, (name, c)
    assert value(one, s.is_type(F.lit(3.0), "integer")) is True
    assert value(one, s.is_type(F.lit("2024-02-03"), "date")) is True
    with pytest.raises(ValueError):
        s.is_type(C("t"), "widget")


def test_names(one):
    assert value(one, resolve("o.user.name", one)) == "Ann"
    assert value(one, resolve(".i", one)) == 1
    assert value(one, resolve("v", one, {"v": F.lit(9)})) == 9
    assert value(one, resolve("i", one, {"i": F.lit(9)})) == 1
    assert value(one, resolve("k", one, pipe="o")) == 7
    assert value(one, resolve("response.user.age", one, pipe="o")) == 3
    assert resolve("none.such", one) is None
    assert value(one, Semantics(one).interpolate("/u/{o.user.name}/{i}/{nope}{z}!")) == "/u/Ann/1/!"


def test_missing_and_null(spark):
    df = spark.sql("select parse_json('{\"a\": null, \"b\": 1}') as v")
    got = df.select(*[f(C("v"), k).alias(f"{f.__name__}_{k}") for f in (is_missing, is_null) for k in "abc"]).first()
    assert list(got) == [False, False, True, True, False, False]


def test_schemas(spark, one):
    ok = lambda **k: value(one, Schema.of("S", **k).matches(one))
    assert ok(i="int", t="string") and ok(d="number", b="bool", a="collection", o="reference", q="string?")
    assert not ok(q="string") and not ok(t="int") and not ok(z="string") and ok(z="string?") and not ok(d="int") and ok(a="whatever")
    v = spark.sql("select parse_json(s) v from values ('{\"id\": 1, \"name\": \"x\"}'), ('{\"id\": \"1\"}'), ('{\"id\": 1.0, \"name\": \"x\", \"email\": null}'), ('{\"id\": 2.5, \"name\": \"x\"}') t(s)")
    s = Schema.of("U", id="int", name="string", email="string?")
    assert [r[0] for r in v.select(variant_matches(C("v"), s)).collect()] == [True, False, True, False]


@pytest.mark.parametrize("x,want", [(2.5, 3.0), (-2.5, -2.0), (0.4, 0.0), (-0.6, -1.0)])
def test_rounding(one, x, want):
    assert value(one, catalog.js_round(F.lit(x))) == want


def test_functions(one):
    c = catalog.call
    cases = [
        (c("length", C("z")), 0), (c("length", C("a"), True), 3), (c("sum", C("a")), 6.0), (c("sum", F.array().cast("array<int>")), 0.0), (c("first", F.array().cast("array<int>")), None), (c("last", C("a")), 3),
        (c("round", F.lit(1.256), 2), 1.26), (c("substring", F.lit("abcdef"), 1, 3), "bc"), (c("substring", F.lit("abc"), 1), "bc"), (c("split", F.lit("a.b"), "."), ["a", "b"]), (c("trimStart", F.lit("  x ")), "x "),
        (c("concat", F.lit("a"), C("z"), C("i")), "a1"), (c("isEmpty", F.array()), True), (c("reduce", C("a"), F.lit(0), lambda s, x: s + x), 6), (c("flatten", F.array(C("a"), C("a"))), [1, 2, 3, 1, 2, 3]), (c("unique", F.array(F.lit(1), F.lit(1))), [1]),
        (c("sortBy", C("a"), lambda x: -x), [3, 2, 1]), (c("find", C("a"), lambda x: x > 1), 2), (c("findIndex", C("a"), lambda x: x > 1), 1), (c("findIndex", C("a"), lambda x: x > 8), -1), (c("at", C("a"), 0), 1), (c("at", C("a"), 7), None), (c("array_avg", C("a")), 2.0),
        (c("toNumber", C("t")), None), (c("toBoolean", F.lit("true")), True), (c("toArray", C("i")), [1]), (c("exists", C("z")), False), (c("slugify", F.lit("Hello, World!")), "hello-world"), (c("dayOfWeek", F.lit("2024-01-07").cast("date")), 0),
        (c("isBefore", F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date")), True), (c("formatDate", c("parseDate", F.lit("03/02/2024"), "DD/MM/YYYY"), "YYYY-MM-DD"), "2024-02-03"), (c("formatDate", c("fromUnix", F.lit(0)), "YYYY"), "1970"), (c("spread", C("o"), k=F.lit(1))["k"], 1),
        (c("formatDate", c("parseDate", F.lit("nope")), "YYYY"), None),
    ]
    got = one.select(*[x.alias(f"c{i}") for i, (x, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]
    assert len(value(one, c("uuid"))) == 36 and value(one, c("now")).endswith("Z")
    with pytest.raises(catalog.UnknownFunction):
        c("nope")
    catalog.register("twice", lambda x: x * 2)
    assert value(one, c("twice", C("i"))) == 2
