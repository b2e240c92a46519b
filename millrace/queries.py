"""One query for each operator of the engine, over whole tables, with its DuckDB SQL.

Ids in the comments are those of the operator inventory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import Semantics, catalog
from .functions.semantics import resolve
from .operators import intervals, joins, scan, sketches, steps
from .operators.buckets import BucketStore
from .operators.schema import Schema, variant_matches
from .operators.stores import Catalog, Store
from .plans import Action, Mission, Stage, mission, schedule, text
from .plans.executions import Executions
from .sources import openapi, paging, shared, sync
from .streaming import breaker, pairs, waits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c):
    """A sum of prices in whole cents: exact, whatever the order of addition."""
    return F.sum(F.round(c * 100).cast("long"))


# --- minimum slice: filter, map with match, keyed store --------------------------------------


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS state,
          round(o_totalprice * 100)::BIGINT AS cents FROM orders WHERE o_totalprice > 1000""")
def flagship_orders(spark, sf_dir):
    o = steps.where(_t(spark, sf_dir, "orders"), lambda s: s.compare(F.col("o_totalprice"), ">", 1000))
    o = steps.project(o, id=F.col("o_orderkey"), state=lambda s: s.match(F.col("o_orderstatus"), [("F", "filled"), ("O", "open")], "other"), cents=F.round(F.col("o_totalprice") * 100).cast("long"))
    return Store("processed").set(o, F.col("id"), F.col("id")).scan()


# --- filters and expressions -----------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30")
def for_where_filter(spark, sf_dir):  # R1, E7, E8
    li = _t(spark, sf_dir, "lineitem")
    got = steps.where(li, lambda s: s.both(s.equal(F.col("l_returnflag"), "R"), s.compare(F.col("l_quantity"), ">=", 30)))
    return got.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id FROM labels WHERE toxic IS NOT NULL AND toxic <> 0")
def filter_truthy(spark, sf_dir):  # E15
    return steps.where(_t(spark, sf_dir, "labels"), F.col("toxic")).select("doc_id")


@query("SELECT doc_id FROM labels WHERE NOT (quality IS NOT NULL AND quality <> 0)")
def filter_not(spark, sf_dir):  # E11
    return steps.where(_t(spark, sf_dir, "labels"), lambda s: s.negation(F.col("quality"))).select("doc_id")


@query("""SELECT o_orderkey, (o_totalprice > 100000 AND o_orderstatus = 'O') AS both_,
          (o_totalprice > 300000 OR o_orderstatus = 'P') AS either_ FROM orders""")
def filter_logical(spark, sf_dir):  # E9, E10
    o = _t(spark, sf_dir, "orders")
    s = Semantics(o)
    return o.select("o_orderkey", s.both(F.col("o_totalprice") > 100000, s.equal(F.col("o_orderstatus"), "O")).alias("both_"), s.either(F.col("o_totalprice") > 300000, s.equal(F.col("o_orderstatus"), "P")).alias("either_"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def map_projection(spark, sf_dir):  # R5
    return steps.project(_t(spark, sf_dir, "customer"), id=F.col("c_custkey"), name=F.col("c_name"), segment=F.col("c_mktsegment"))


@query("SELECT c_custkey, 'c_' || c_custkey || '-' || c_nationkey AS label FROM customer")
def map_concat_string(spark, sf_dir):  # E4
    c = _t(spark, sf_dir, "customer")
    s = Semantics(c)
    label = s.add(s.add(s.add(F.lit("c_"), F.col("c_custkey")), "-"), F.col("c_nationkey"))
    return c.select("c_custkey", label.alias("label"))


@query("""SELECT p_partkey, round(p_retailprice * 2 + p_size, 4) AS plus, round(p_retailprice / p_size, 6) AS ratio,
          -p_size::DOUBLE AS negative, p_size % 7::DOUBLE AS rest FROM part""")
def map_arith(spark, sf_dir):  # E5, E6, E12
    p = _t(spark, sf_dir, "part")
    s = Semantics(p)
    price, size = F.col("p_retailprice"), F.col("p_size")
    return p.select("p_partkey", F.round(s.add(s.multiply(price, 2), size), 4).alias("plus"), F.round(s.divide(price, size), 6).alias("ratio"), s.negate(size).alias("negative"), s.modulo(size, 7).alias("rest"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier FROM orders""")
def ternary_nested(spark, sf_dir):  # E13
    o = _t(spark, sf_dir, "orders")
    s = Semantics(o)
    return o.select("o_orderkey", s.choose(F.col("o_totalprice") > 300000, "high", s.choose(F.col("o_totalprice") > 100000, "mid", "low")).alias("tier"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS rank_ FROM orders")
def match_expr_literal(spark, sf_dir):  # E16: no arm gives NULL
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", Semantics(o).match(F.col("o_orderpriority"), [("1-URGENT", 1), ("2-HIGH", 2)]).alias("rank_"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'ok' END AS class FROM customer""")
def match_expr_guard(spark, sf_dir):  # E17
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", Semantics(c).cases([(F.col("c_acctbal") < 0, "debt"), (F.col("c_acctbal") > 5000, "rich")], "ok").alias("class"))


@query("SELECT n_nationkey, n_name AS a, n_regionkey AS b, n_nationkey + n_regionkey AS s FROM nation")
def object_and_array_literal(spark, sf_dir):  # E19, E20, E3
    n = _t(spark, sf_dir, "nation")
    d = n.select("n_nationkey", F.struct(F.col("n_name").alias("a"), F.struct(F.col("n_regionkey").alias("b")).alias("in")).alias("o"), F.array("n_nationkey", "n_regionkey").alias("arr"))
    return d.select("n_nationkey", resolve("o.a", d).alias("a"), resolve("o.in.b", d).alias("b"), (F.get("arr", F.lit(0)) + F.get("arr", F.lit(1))).alias("s"))


@query("SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey, 'x' AS extra FROM nation")
def spread_override(spark, sf_dir):  # R19
    return steps.project(_t(spark, sf_dir, "nation"), spread=True, n_name=F.lower("n_name"), extra=F.lit("x"))


@query("SELECT user_id, event_id, '/users/' || user_id || '/' || event_type || '/' AS path FROM events")
def path_interpolation(spark, sf_dir):  # S3
    e = _t(spark, sf_dir, "events")
    return e.select("user_id", "event_id", Semantics(e).interpolate("/users/{user_id}/{event_type}/{none.such}").alias("path"))


@query("""SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text, count(*) AS n,
          arg_min(text, turn) FILTER (role = 'assistant') AS first_answer, max(length(text)) AS longest
          FROM conversations GROUP BY conv_id""")
def fn_first_last_count_any(spark, sf_dir):  # A2-A4, E18
    c = _t(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    s = Semantics(g)
    return g.select("conv_id", catalog.call("first", F.col("m"))["text"].alias("first_text"), catalog.call("last", F.col("m"))["text"].alias("last_text"), catalog.call("count", F.col("m")).cast("long").alias("n"), s.any_of(F.col("m"), lambda x: x["role"] == "assistant")["text"].alias("first_answer"), F.array_max(F.transform("m", lambda x: F.char_length(x["text"]))).cast("long").alias("longest"))


@query("""SELECT doc_id, true AS s, n_chars = floor(n_chars) AS i, true AS n, false AS b, false AS d FROM documents""")
def is_type_checks(spark, sf_dir):  # E21
    d = _t(spark, sf_dir, "documents")
    s = Semantics(d)
    return d.select("doc_id", s.is_type(F.col("text"), "string").alias("s"), s.is_type(F.col("n_chars"), "int").alias("i"), s.is_type(F.col("n_chars"), "number").alias("n"), s.is_type(F.col("text"), "boolean").alias("b"), s.is_type(F.col("n_chars"), "date").alias("d"))


@query("SELECT p_partkey, floor(p_retailprice - 1000.5 + 0.5) AS r, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE 'frac' END AS t FROM part")
def js_round_and_text(spark, sf_dir):  # 2.8 round, E27
    p = _t(spark, sf_dir, "part")
    s = Semantics(p)
    whole = F.col("p_retailprice") == F.floor("p_retailprice")
    return p.select("p_partkey", catalog.js_round(F.col("p_retailprice") - 1000.5).alias("r"), F.when(whole, s.string(F.col("p_retailprice"))).otherwise("frac").alias("t"))


# --- routing and validation ------------------------------------------------------------------

_ROUTES = """CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'small' WHEN event_type = 'click' THEN 'seen' ELSE 'rest' END"""


def _arms():
    return [
        steps.Arm("big", Schema.of("E", event_type="string", value="number"), lambda s: s.both(s.equal(F.col("event_type"), "purchase"), F.col("value") > 50)),
        steps.Arm("small", Schema.of("E", event_type="string"), lambda s: s.equal(F.col("event_type"), "purchase"), "queue"),
        steps.Arm("never", Schema.of("E", no_such_field="string")),
        steps.Arm("seen", guard=lambda s: s.equal(F.col("event_type"), "click"), directive="skip"),
        steps.Arm("rest"),
    ]


@query(f"SELECT event_id, {_ROUTES} AS arm FROM events")
def match_step_router(spark, sf_dir):  # R11, R12
    return steps.route(_t(spark, sf_dir, "events"), _arms()).select("event_id", F.col("_arm").alias("arm"))


@query(f"SELECT event_id, {_ROUTES} AS arm FROM events WHERE {_ROUTES} IN ('big', 'rest')")
def flow_skip(spark, sf_dir):  # P4, P5
    return steps.flow(_t(spark, sf_dir, "events"), _arms())["continue"].select("event_id", F.col("_arm").alias("arm"))


@query(f"SELECT user_id::VARCHAR AS key, 'small' AS reason, count(*) AS attempts FROM events WHERE {_ROUTES} = 'small' GROUP BY user_id")
def flow_queue_dlq(spark, sf_dir):  # P8, D19
    queued = steps.flow(_t(spark, sf_dir, "events"), _arms())["queue"]
    return steps.dead_letters(queued, "small", F.col("user_id")).select("key", "reason", "attempts")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS kind,
          CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 100)::BIGINT ELSE 0 END AS cents FROM orders""")
def apply_overloaded(spark, sf_dir):  # R6, R7
    o = _t(spark, sf_dir, "orders")
    done = steps.Variant({"id": F.col("o_orderkey"), "kind": F.lit("done"), "cents": F.round(F.col("o_totalprice") * 100).cast("long")}, Schema.of("O", o_orderkey="int"), lambda s: s.equal(F.col("o_orderstatus"), "F"))
    return steps.apply_transform(o, [done, steps.Variant({"id": F.col("o_orderkey"), "kind": F.lit("todo"), "cents": F.lit(0).cast("long")})])


@query("""SELECT event_id, props IS NOT NULL AND json_valid(props) AND json_type(props) = 'OBJECT' AS has FROM events""")
def schema_match_variant(spark, sf_dir):  # R12 over records of differing shape
    e = _t(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", (variant_matches(F.col("v"), Schema.of("Any")) & F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))).alias("has"))


def _line_rules():
    return [steps.Constraint("quantity", F.col("l_quantity") <= 45), steps.Constraint("discount", F.col("l_discount") < 0.09), steps.Constraint("tax", F.col("l_tax") < 0.07, "warning")]


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT (l_quantity <= 45) THEN 'quantity' ELSE 'discount' END AS failed
          FROM lineitem WHERE NOT (l_quantity <= 45) OR NOT (l_discount < 0.09)""")
def validate_split(spark, sf_dir):  # R8, R10
    _, bad = steps.split_valid(_t(spark, sf_dir, "lineitem"), _line_rules())
    return bad.select("l_orderkey", "l_linenumber", F.col("_failed").alias("failed"))


@query("""SELECT 'quantity' AS "constraint", 'error' AS severity, count(*) FILTER (NOT (l_quantity <= 45)) AS failures FROM lineitem
          UNION ALL SELECT 'discount', 'error', count(*) FILTER (NOT (l_discount < 0.09)) FROM lineitem
          UNION ALL SELECT 'tax', 'warning', count(*) FILTER (NOT (l_tax < 0.07)) FROM lineitem""")
def validate_counts(spark, sf_dir):  # R9
    return steps.count_failures(_t(spark, sf_dir, "lineitem"), _line_rules())


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 0")
def validate_strict(spark, sf_dir):  # R8
    return steps.check(_t(spark, sf_dir, "orders"), [steps.Constraint("positive", F.col("o_totalprice") > 0)]).select("o_orderkey")


# --- stores ----------------------------------------------------------------------------------


@query("""SELECT user_id::VARCHAR AS k, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def store_set_last_wins(spark, sf_dir):  # K1-K3, A12
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    s = Store("s").set(e, F.col("user_id"), "event_id").table
    return s.select(F.col("_key").alias("k"), "event_id", "event_type")


@query("""WITH u AS (SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS bought,
                 arg_max(value, event_id) FILTER (event_type <> 'purchase' AND value IS NOT NULL) AS other FROM events GROUP BY user_id)
          SELECT user_id::VARCHAR AS k, round(bought, 6) AS bought, round(other, 6) AS other FROM u""")
def store_upsert_merge(spark, sf_dir):  # K4, J11
    e = _t(spark, sf_dir, "events")
    a = e.filter("event_type <> 'purchase'").select("event_id", "user_id", F.col("value").alias("other"))
    b = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("value").alias("bought"))
    s = Store("s").upsert(a, F.col("user_id"), "event_id").upsert(b, F.col("user_id"), "event_id")
    return s.table.select(F.col("_key").alias("k"), F.round("bought", 6).alias("bought"), F.round("other", 6).alias("other"))


@query("SELECT n_nationkey AS id, n_name, true AS _partial FROM nation")
def store_partial_default_key(spark, sf_dir):  # K5, K6
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return Store("s").set(n, seq="id", partial=True).scan()


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)""")
def store_delete(spark, sf_dir):  # K9: customers without a large order
    s = Store("c").set(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey"), "c_custkey")
    return s.delete(_t(spark, sf_dir, "orders").filter("o_totalprice > 400000"), F.col("o_custkey")).scan().select("c_custkey")


@query("""SELECT o_orderkey, coalesce(n, 0) AS lines FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
          LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def store_update_only(spark, sf_dir):  # D8: lines of orders that are not there are not inserted
    o = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.lit(0).cast("long").alias("lines"))
    n = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    s = Store("o").set(o, F.col("o_orderkey"), "o_orderkey").update(n, F.col("o_orderkey"), F.col("o_orderkey"))
    return s.scan().select("o_orderkey", "lines")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND s_acctbal >= 0 ORDER BY s_suppkey LIMIT 5 OFFSET 1")
def list_where_offset_limit(spark, sf_dir):  # K10, W7, D9
    s = Store("s").set(_t(spark, sf_dir, "supplier"), F.col("s_suppkey"), "s_suppkey")
    return s.list({"s_nationkey": 3, "s_acctbal": ("gte", 0)}, limit=5, offset=1).select("s_suppkey", "s_name")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_where(spark, sf_dir):  # K11, X7
    c = Catalog(spark, {})
    c.put("orders", _t(spark, sf_dir, "orders"), F.col("o_orderkey"), "o_orderkey")
    return c.query("orders", {"o_orderstatus": "F"}, limit=3)[1]


@query("""SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def store_lookup(spark, sf_dir):  # K8, D3
    s = Store("c").set(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey"), "c_custkey")
    return s.lookup(_t(spark, sf_dir, "orders"), F.col("o_custkey"), "c").select("o_orderkey", "c.c_name", "c.c_mktsegment")


# --- joins -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_equi(spark, sf_dir):  # J1
    return joins.loop_join(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("""SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey""")
def join_theta(spark, sf_dir):  # J2
    a = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("ra"))
    b = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("rb"))
    return joins.loop_join(a, b, theta=F.col("ra") < F.col("rb")).select("a", "b")


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 20""")
def join_range(spark, sf_dir):  # J2 by bins
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return joins.band_join(_t(spark, sf_dir, "part"), s, "p_retailprice", "low", "high", 20.0).select("p_partkey", "s_suppkey")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, sf_dir):  # J3
    return joins.loop_join(_t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("""SELECT r_name, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_multiway(spark, sf_dir):  # J4
    j = joins.loop_join(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")])
    j = joins.loop_join(j, _t(spark, sf_dir, "nation"), [("c_nationkey", "n_nationkey")])
    j = joins.loop_join(j, _t(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")])
    return joins.group_by(j, "r_name", n=F.count(F.lit(1)), cents=_cents(F.col("o_totalprice")))


@query("SELECT vec_id, count(*) AS n, sum(floor(x::DOUBLE * 1000000)::BIGINT)::BIGINT AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def unnest(spark, sf_dir):  # J5, R4, S16
    e = steps.unnest(_t(spark, sf_dir, "embeddings"), "embedding", "x")
    return e.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("x").cast("double") * 1000000)).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, sf_dir):  # J7
    return joins.exists(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(spark, sf_dir):  # J8, D4
    return joins.missing(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").filter("o_totalprice > 400000"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("""SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def lookup_first(spark, sf_dir):  # J9
    got = joins.first_match(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), ("c_custkey", "o_custkey"), "o_orderkey", "o")
    return got.select("c_custkey", F.col("o.o_orderkey").alias("first_order"))


@query("""SELECT o_orderkey, CASE WHEN abs(coalesce(s, 0) - round(o_totalprice * 100)) > 100000 THEN 'high' ELSE 'low' END AS severity
          FROM orders LEFT JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
          WHERE abs(coalesce(s, 0) - round(o_totalprice * 100)) > 1""")
def group_join(spark, sf_dir):  # J10: reconciliation of a total with its parts
    j = joins.group_join(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"), ("o_orderkey", "l_orderkey"), s=_cents(F.col("l_extendedprice")))
    gap = F.abs(F.coalesce("s", F.lit(0)) - F.round(F.col("o_totalprice") * 100))
    return j.filter(gap > 1).select("o_orderkey", F.when(gap > 100000, "high").otherwise("low").alias("severity"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.n, a.n) AS n, a.x, b.y FROM
          (SELECT c_nationkey AS k, count(*) AS n, min(c_custkey) AS x FROM customer WHERE c_nationkey < 15 GROUP BY 1) a
          FULL JOIN (SELECT s_nationkey AS k, count(*) AS n, min(s_suppkey) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k""")
def merge_full_outer(spark, sf_dir):  # J11
    a = _t(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("x"))
    b = _t(spark, sf_dir, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("y"))
    return joins.merge_full(a, b, "k")


@query("""SELECT a.event_id, b.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a
          ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_as_of(spark, sf_dir):  # J12
    e = _t(spark, sf_dir, "events")
    b = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("pts")).agg(F.max("event_id").alias("pid"))
    got = joins.as_of(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), b, "user_id", "ts", "pts", ["pid"])
    return got.select("event_id", F.col("asof_pid").alias("last_purchase"))


# --- aggregates ------------------------------------------------------------------------------


@query("""SELECT o_custkey, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) AS mean,
          min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_custkey""")
def agg_group_distinct(spark, sf_dir):  # A8
    p = F.col("o_totalprice")
    return joins.group_by(_t(spark, sf_dir, "orders"), "o_custkey", n=F.count(F.lit(1)), cents=_cents(p), mean=(_cents(p).cast("double") / F.count(F.lit(1))), low=F.min(p), high=F.max(p))


@query("""SELECT k.x AS c_mktsegment, n FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NONE SUCH')) k(x)
          LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) ON c_mktsegment = k.x""")
def agg_group_literal_keys(spark, sf_dir):  # A7
    return joins.group_listed(_t(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "NONE SUCH"], n=F.count(F.lit(1)))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'X') AS n_X FROM orders""")
def agg_conditional(spark, sf_dir):  # A9
    return joins.count_by_value(_t(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "X"])


@query("SELECT sum(round(l_extendedprice * 100)::BIGINT * l_quantity::BIGINT)::BIGINT AS weighted, count(*) AS n FROM lineitem")
def agg_weighted_global(spark, sf_dir):  # A10, A11
    return _t(spark, sf_dir, "lineitem").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") * F.col("l_quantity").cast("long")).alias("weighted"), F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * 1000)::BIGINT AS s, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, len(embedding) AS n FROM embeddings""")
def agg_arrays(spark, sf_dir):  # A1, A2, A5
    a = F.col("embedding")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(catalog.call("sum", a) * 1000).cast("long").alias("s"), catalog.call("array_min", a).cast("double").alias("lo"), catalog.call("array_max", a).cast("double").alias("hi"), catalog.call("count", a).cast("long").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def agg_rollup(spark, sf_dir):  # A17, beyond the core
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM customer) AS customers""")
def store_count_rollup(spark, sf_dir):  # D6: one row of counts
    n = {k: _t(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(k)) for k, t in (("orders", "orders"), ("lines", "lineitem"), ("customers", "customer"))}
    return n["orders"].crossJoin(n["lines"]).crossJoin(n["customers"])


@query("""SELECT o_orderkey, m AS metric, v AS value FROM (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS cust FROM orders)
          UNPIVOT (v FOR m IN (o_totalprice, cust))""")
def unpivot_list(spark, sf_dir):  # D7
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("cust"))
    return o.unpivot("o_orderkey", ["o_totalprice", "cust"], "metric", "value")


@query("""WITH d AS (SELECT o_orderpriority AS p, o_orderdate::DATE AS day, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)
          SELECT d.p, d.day::VARCHAR AS day, round((d.n - o.n) * 100 / o.n, 6) AS change_pct,
          CASE WHEN d.n > o.n THEN 'up' WHEN d.n < o.n THEN 'down' WHEN d.n = o.n THEN 'flat' ELSE 'new' END AS trend
          FROM d LEFT JOIN d o ON d.p = o.p AND d.day = o.day + 7""")
def period_change(spark, sf_dir):  # D5
    d = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("n"))
    got = joins.period_change(d, "p", "day", "n", 7)
    return got.select("p", F.col("day").cast("string").alias("day"), F.round("change_pct", 6).alias("change_pct"), "trend")


# --- sets, order, pages ----------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_append(spark, sf_dir):  # U1
    return joins.union_all(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("""SELECT k, arg_max(src, o) AS src FROM (SELECT c_custkey::VARCHAR AS k, 'c' AS src, 0 AS o FROM customer UNION ALL SELECT s_suppkey::VARCHAR, 's', 1 FROM supplier) GROUP BY k""")
def union_keyed(spark, sf_dir):  # U2
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("src"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("src"))
    return Store("u").set(a, seq="id").set(b, seq="id").table.select(F.col("_key").alias("k"), "src")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def set_intersect(spark, sf_dir):  # U4
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def set_except(spark, sf_dir):  # U4
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(_t(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k")))


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first(spark, sf_dir):  # W3, W8
    o = _t(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_group(spark, sf_dir):  # W4
    return mission.latest(_t(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


_PAGES = "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS page FROM part"


@query(_PAGES)
def paginate_offset(spark, sf_dir):  # S4, S5
    return paging.number_pages(_t(spark, sf_dir, "part"), "p_partkey", 50).select("p_partkey", "page")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page FROM orders WHERE o_orderstatus = 'F'")
def paginate_page(spark, sf_dir):  # S5 over keys with gaps
    return paging.number_pages(_t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "o_orderkey", 100).select("o_orderkey", "page")


@query(f"""WITH p AS ({_PAGES.replace('p_partkey,', 'p_partkey, p_size,')}), s AS (SELECT min(page) AS stop FROM (SELECT page FROM p GROUP BY page HAVING sum(p_size) > 1400))
          SELECT p_partkey, page FROM p, s WHERE page < coalesce(stop, 1000000)""")
def paginate_until(spark, sf_dir):  # S8
    d = paging.number_pages(_t(spark, sf_dir, "part"), "p_partkey", 50)
    return paging.stop_before(d, F.sum("p_size") > 1400).select("p_partkey", "page")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 25")
def paginate_cursor(spark, sf_dir):  # S6
    return paging.keyset_page(_t(spark, sf_dir, "part"), "p_partkey", 100, 25).select("p_partkey", "p_name")


# --- incremental -----------------------------------------------------------------------------


@query("""WITH w AS (SELECT max(ts) AS w FROM events WHERE event_id < 500) SELECT event_id FROM events, w WHERE ts > w""")
def incremental_since(spark, sf_dir):  # S9, T12
    e = _t(spark, sf_dir, "events")
    marks = sync.Watermarks(spark).advance("events:all", e.filter("event_id < 500"), "ts")
    return marks.since(e, "events:all", "ts").select("event_id")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS iso,
          (epoch_us(ts) // 1000000)::VARCHAR AS unix, (epoch_us(ts) // 1000)::VARCHAR AS ms, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def since_formats(spark, sf_dir):  # S9
    ts = F.col("ts").cast("timestamp")
    return _t(spark, sf_dir, "events").select("event_id", sync.format_since(ts).alias("iso"), sync.format_since(ts, "unix").alias("unix"), sync.format_since(ts, "unix-ms").alias("ms"), sync.format_since(ts, "date-only").alias("day"))


@query("""SELECT 'api:orders' AS key, count(*) AS record_count, strftime(max(o_orderdate), '%Y-%m-%d') AS synced FROM orders
          UNION ALL SELECT 'api:events', count(*), strftime(max(ts), '%Y-%m-%d') FROM events""")
def checkpoint_table(spark, sf_dir):  # S9
    w = sync.Watermarks(spark).advance(sync.checkpoint_key("api", "/orders"), _t(spark, sf_dir, "orders"), "o_orderdate")
    w = w.advance(sync.checkpoint_key("api", "/events"), _t(spark, sf_dir, "events"), "ts")
    return w.table.select("key", "record_count", F.date_format("synced_at", "yyyy-MM-dd").alias("synced"))


# --- functions -------------------------------------------------------------------------------


@query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, substr(p_name, 3, 4) AS sub, replace(p_name, 'a', 'A') AS rep,
          array_to_string(string_split(p_name, ' '), '-') AS joined, contains(p_name, 'e') AS has, starts_with(p_type, 'S') AS st,
          trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, length(p_name) AS n FROM part""")
def string_fns(spark, sf_dir):
    n, c = F.col("p_name"), catalog.call
    return _t(spark, sf_dir, "part").select("p_partkey", c("lowercase", n).alias("lo"), c("uppercase", n).alias("up"), c("substring", n, 2, 6).alias("sub"), c("replace", n, "a", "A").alias("rep"), c("join", c("split", n, " "), "-").alias("joined"), c("contains", n, "e").alias("has"), c("startsWith", F.col("p_type"), "S").alias("st"), c("slugify", n).alias("slug"), c("length", n).cast("long").alias("n"))


@query("""SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS u, len(list_filter(list(o_totalprice), lambda x: x > 100000)) AS big,
          list_contains(list(o_orderstatus), 'P') AS has FROM orders GROUP BY o_custkey""")
def array_fns(spark, sf_dir):
    c = catalog.call
    g = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.collect_list("o_totalprice").alias("t"), F.collect_list("o_orderstatus").alias("s"))
    return g.select("o_custkey", c("sort", c("unique", F.col("p"))).alias("u"), F.size(c("filter", F.col("t"), lambda x: x > 100000)).cast("long").alias("big"), c("includes", F.col("s"), "P").alias("has"))


@query("SELECT n_nationkey, 2 AS keys, n_name AS n, true AS has, n_regionkey AS r FROM nation")
def object_fns(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("x"), F.lit("y"))
    s = F.struct("n_name", "n_regionkey", "n_nationkey")
    c = catalog.call
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.size(c("keys", c("merge", m, m))).alias("keys"), c("pick", s, "n_name")["n_name"].alias("n"), c("hasKey", m, "x").alias("has"), c("omit", s, "n_name")["n_regionkey"].alias("r"))


@query("""SELECT p_partkey, abs(p_size - 25) AS a, least(p_size, 10) AS lo, greatest(p_size, 10) AS hi, p_size * p_size * 1.0::DOUBLE AS sq,
          floor(p_retailprice) AS fl, ceil(p_retailprice) AS ce, p_size % 3 AS m FROM part""")
def math_fns(spark, sf_dir):
    x, c = F.col("p_size"), catalog.call
    return _t(spark, sf_dir, "part").select("p_partkey", c("abs", x - 25).alias("a"), c("min", x, F.lit(10)).alias("lo"), c("max", x, F.lit(10)).alias("hi"), c("pow", x, 2.0).alias("sq"), c("floor", F.col("p_retailprice")).alias("fl"), c("ceil", F.col("p_retailprice")).alias("ce"), c("mod", x, F.lit(3)).alias("m"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS w,
          strftime(o_orderdate, '%d/%m/%Y') AS f, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS p10,
          strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS pm, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS dd FROM orders""")
def date_fns(spark, sf_dir):
    c, o = catalog.call, _t(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    t = F.col("t")
    return o.select("o_orderkey", c("year", t).cast("long").alias("y"), c("month", t).cast("long").alias("m"), c("day", t).cast("long").alias("d"), c("dayOfWeek", t).cast("long").alias("w"), c("formatDate", t, "DD/MM/YYYY").alias("f"), c("formatDate", c("addDays", t, 10), "YYYY-MM-DD").alias("p10"), c("formatDate", c("addMonths", t, 1), "YYYY-MM-DD").alias("pm"), c("diffDays", t, F.lit("1995-01-01").cast("date")).cast("long").alias("dd"))


@query("""SELECT c_custkey, TRY_CAST(right(c_name, 5) AS DOUBLE) AS n, TRY_CAST(c_name AS DOUBLE) AS bad, c_custkey::VARCHAR AS s, c_custkey::VARCHAR = '1' AS b FROM customer""")
def conversion_fns(spark, sf_dir):
    c, n = catalog.call, F.col("c_name")
    return _t(spark, sf_dir, "customer").select("c_custkey", c("toNumber", F.right(n, F.lit(5))).alias("n"), c("toNumber", n).alias("bad"), c("toString", F.col("c_custkey")).alias("s"), c("toBoolean", F.col("c_custkey")).alias("b"))


# --- events, schedules, breaker --------------------------------------------------------------


@query("""SELECT user_id, event_id, nth, n >= 3 AS complete FROM (SELECT user_id, event_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY user_id) AS n
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE nth <= 3""")
def wait_collect_n(spark, sf_dir):  # T1, T2
    return waits.collect_n(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3).select("user_id", "event_id", F.col("nth").cast("long"), "complete")


@query("""WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS s FROM events), k AS (SELECT * FROM f WHERE ts <= s + INTERVAL 3 DAY),
          r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM k)
          SELECT user_id, event_id, nth FROM r WHERE nth <= 5""")
def wait_timeout(spark, sf_dir):  # T3
    return waits.collect_n(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5, 3 * 86400 * 1000).select("user_id", "event_id", F.col("nth").cast("long"))


@query("SELECT event_id FROM events WHERE coalesce(value > 20, true)")
def event_filter(spark, sf_dir):  # T4
    return waits.event_filter(_t(spark, sf_dir, "events"), F.col("value") > 20).select("event_id")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start_, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def window_tumbling(spark, sf_dir):  # T13, beyond the core
    got = waits.windowed(_t(spark, sf_dir, "events"), "ts", "1 hour", by=["event_type"], n=F.count(F.lit(1)))
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start_"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          s AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
          SELECT user_id, count(*) AS n FROM s GROUP BY user_id, i""")
def window_session(spark, sf_dir):  # T13, beyond the core
    return waits.sessions(_t(spark, sf_dir, "events"), "ts", "1 day", ["user_id"], n=F.count(F.lit(1))).select("user_id", "n")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts - k * INTERVAL 1 HOUR)::VARCHAR AS start_, count(*) AS n, round(sum(round(value * 100))) AS cents FROM events, range(3) r(k) GROUP BY 1""")
def window_sliding(spark, sf_dir):  # T13: windows of three hours, a new one each hour
    got = waits.windowed(_t(spark, sf_dir, "events"), "ts", "3 hours", "1 hour", n=F.count(F.lit(1)), cents=F.sum(F.round(F.col("value") * 100)))
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start_"), "n", F.round("cents").alias("cents"))


@query("""SELECT c.event_id AS click, p.event_id AS purchase, user_id FROM events c JOIN events p USING (user_id)
          WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR""")
def followed_within_hour(spark, sf_dir):  # T13: purchases within an hour of a click
    e = _t(spark, sf_dir, "events")
    of = lambda kind: e.filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    got = pairs.followed_within(of("click"), of("purchase"), ["user_id"], "ts", "ts", "1 HOUR", "2 hours")
    return got.select(F.col("event_id").alias("click"), F.col("then_event_id").alias("purchase"), "user_id")


@query("""SELECT user_id || ':' || event_type AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS at, arg_min(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type""")
def event_dedupe_store(spark, sf_dir):  # T5: of events of one key the first is stored
    e = _t(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "ts", "event_id")
    c = Catalog(spark)
    pairs.into_store(c, "seen", "key", "ts")(pairs.once(e, "key", "ts"), 0)
    return c["seen"].scan().select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_id")


@query("""SELECT event_type, count(*) AS n, true AS distinct_within, true AS median_within, true AS days_as_one FROM events GROUP BY event_type""")
def merged_sketches(spark, sf_dir):  # A17: states by day, merged; each estimate within its bound of the exact value
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    store = Store("states")
    halves = [e.filter(F.dayofmonth("day") <= 15), e.filter(F.dayofmonth("day") > 15)]
    for half in halves:
        daily = sketches.summarise(half, ["event_type", "day"], "user_id", "value")
        store = sketches.add_load(store, sketches.merged(daily, ["event_type"]), ["event_type"])
    got = sketches.estimates(store.scan(), ["event_type"], [0.5])
    one = sketches.estimates(sketches.summarise(e, ["event_type"], "user_id", "value"), ["event_type"], [0.5])
    one = one.select("event_type", F.col("items").alias("one_items"))
    off = sketches.rank_error()
    # the share of values up to the estimated median is within the bound of one half
    both = e.join(got, "event_type").groupBy("event_type", got["n"], "items").agg(F.count_distinct("user_id").alias("exact"), F.avg((F.col("value") <= F.col("q0")).cast("double")).alias("rank"), F.avg((F.col("value") == F.col("q0")).cast("double")).alias("tie"))
    near = F.abs(F.col("items") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * sketches.distinct_error())
    return both.join(one, "event_type").select("event_type", "n", near.alias("distinct_within"), F.col("rank").between(0.5 - off, 0.5 + off + F.col("tie")).alias("median_within"), (F.abs(F.col("items") - F.col("one_items")) <= F.greatest(F.lit(1.0), F.col("exact") * 2 * sketches.distinct_error())).alias("days_as_one"))


@query("""WITH l AS (SELECT datediff('day', DATE '1990-01-01', l_shipdate::DATE) AS s, datediff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::BIGINT // 10 AS e FROM lineitem),
          p AS (SELECT p_partkey, p_partkey * 37 % 4000 AS s, p_partkey * 37 % 4000 + CASE WHEN p_partkey % 50 = 0 THEN 1500 ELSE p_partkey % 7 END AS e FROM part)
          SELECT p_partkey, count(*) AS n, sum(least(l.e, p.e) - greatest(l.s, p.s) + 1)::BIGINT AS days FROM l JOIN p ON l.s <= p.e AND p.s <= l.e GROUP BY p_partkey""")
def interval_overlap(spark, sf_dir):  # J2: intervals of a few days and of years
    ship = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    line = _t(spark, sf_dir, "lineitem").select(ship.alias("s"), (ship + F.floor(F.col("l_quantity").cast("long") / 10)).alias("e"))
    at = F.col("p_partkey") * 37 % 4000
    part = _t(spark, sf_dir, "part").select("p_partkey", at.alias("ps"), (at + F.when(F.col("p_partkey") % 50 == 0, 1500).otherwise(F.col("p_partkey") % 7)).alias("pe"))
    got = part.join(intervals.overlap_totals(line, part, ("s", "e"), ("ps", "pe")), ["ps", "pe"])
    return got.groupBy("p_partkey").agg(F.sum("n").alias("n"), F.sum("shared").alias("days"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE o_orderstatus END AS state, (o_totalprice * 100)::DECIMAL(18, 0)::BIGINT AS cents,
          CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS customer FROM orders WHERE o_orderstatus <> 'P'""")
def store_bucketed_merge(spark, sf_dir):  # K13: a store in buckets: set, merged with a new column, deleted from
    o = _t(spark, sf_dir, "orders")
    path = shared.goes_at_exit(spark, f"{shared.shared_dir(spark)}/{uuid.uuid4().hex}")
    store = BucketStore(spark, path, 16)
    store.set(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), F.col("id"))
    store.upsert(o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.lit("urgent").alias("state"), F.col("o_custkey").alias("customer")), F.col("id"))
    store.delete(o.filter("o_orderstatus = 'P'"), F.col("o_orderkey"))
    return store.store().scan().select("id", "state", "cents", "customer")


@query("""SELECT o_orderkey, row_number() OVER w AS nth, sum((o_totalprice * 100)::DECIMAL(18, 0)::BIGINT) OVER w AS cents, max(o_custkey) OVER w AS top_customer,
          last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER w AS last_urgent
          FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_values(spark, sf_dir):  # W1: three keys, two of which hold nearly all rows
    o = _t(spark, sf_dir, "orders")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    got = scan.running(o, "o_orderstatus", ["o_orderdate", "o_orderkey"], nth=scan.number(), cents=scan.total(cents), top_customer=scan.greatest(F.col("o_custkey")), last_urgent=scan.last(urgent))
    return got.select("o_orderkey", "nth", "cents", "top_customer", "last_urgent")


@query("""SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS failures FROM events""")
def breaker_window_failures(spark, sf_dir):  # W2
    return breaker.failures_in_window(_t(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "purchase", 86400).select("event_id", "failures")


@query()
def breaker_states(spark, sf_dir):  # H4
    e = _t(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "purchase")
    return breaker.states(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "failed").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n AS attempt, least(1000 * 2 ** (n - 1), 30000)::BIGINT AS delay_ms FROM range(1, 9) t(n)")
def backoff_schedule(spark, sf_dir):  # H2
    return breaker.backoff_schedule(spark, 1000, 30000, 8)


@query("""SELECT strftime(t, '%Y-%m-%d %H:%M') AS run_at FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 MINUTE) r(t)
          WHERE minute(t) % 15 = 0 AND hour(t) BETWEEN 9 AND 17 AND dayofweek(t) BETWEEN 1 AND 5""")
def cron_next_runs(spark, sf_dir):  # T9
    return schedule.cron_runs(spark, "*/15 9-17 * * 1-5", "2024-01-01", "2024-03-01").select(F.date_format("run_at", "yyyy-MM-dd HH:mm").alias("run_at"))


@query("SELECT (epoch_us(ts) // 1000000) // 21600 AS slot, count(*) AS ticks FROM events GROUP BY 1")
def interval_runs(spark, sf_dir):  # T8
    return schedule.interval_runs(_t(spark, sf_dir, "events"), "ts", schedule.seconds(6, "hours")).select("slot", "ticks")


# --- descriptions, missions ------------------------------------------------------------------

_DOC_SCHEMA = {"type": "object", "required": ["text"], "properties": {"doc_id": {"type": "integer"}, "text": {"type": "string", "minLength": 100}, "lang": {"type": "string", "enum": ["en", "de"]}, "n_chars": {"type": "integer", "maximum": 5000}}}


@query("""SELECT doc_id, 'text' AS path FROM documents WHERE text IS NULL OR length(text) < 100
          UNION ALL SELECT doc_id, 'lang' FROM documents WHERE lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, 'n_chars' FROM documents WHERE n_chars > 5000""")
def oas_violations(spark, sf_dir):  # H7
    return openapi.violations(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), _DOC_SCHEMA, "doc_id").select("doc_id", "path")


@query("SELECT 1::BIGINT AS doc_id, 'string' AS text, 'en' AS lang, 1::BIGINT AS n_chars FROM range(5)")
def mock_rows(spark, sf_dir):  # S10, P13
    return openapi.mock_rows(spark, _DOC_SCHEMA, 5)


@query("""SELECT k, src FROM (SELECT c_custkey::VARCHAR AS k, 'customer' AS src FROM customer UNION ALL SELECT 'e' || event_id, 'event' FROM events)""")
def pipeline_parallel_merge(spark, sf_dir):  # P1, P2
    def put(table, col, prefix, label):
        return lambda ctx: ctx.store("out", _t(spark, sf_dir, table).select(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("k"), F.lit(label).alias("src"), F.col(col).alias("q")), F.col("k"), "q")

    m = Mission("m", spark, [Action("A", put("customer", "c_custkey", "", "customer")), Action("B", put("events", "event_id", "e", "event"))], [Stage(["A", "B"])]).run()
    return m.stores["out"].scan().select("k", "src")


@query("""SELECT o_orderpriority AS mission, count(*) AS stages, count(*) FILTER (o_orderstatus <> 'O') AS done, count(*) FILTER (o_orderstatus = 'O') AS failed,
          count(*) FILTER (o_orderstatus <> 'O') * 100 // count(*) AS percent FROM orders GROUP BY 1""")
def progress_by_mission(spark, sf_dir):  # A16: orders as stages of missions
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("failed")
    return mission.progress(_t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mission"), status.alias("status")))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def newest_states(spark, sf_dir):  # W3
    return mission.newest(_t(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'plain' END AS kind, count(l_orderkey) AS lines
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def execution_resumed(spark, sf_dir):  # P10: a mission whose second stage fails, gone on with from what was kept
    kept = Executions(spark, shared.goes_at_exit(spark, f"{shared.shared_dir(spark)}/{uuid.uuid4().hex}"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("plain")

    def load(ctx):
        ctx.store("ord", _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind")), F.col("id"))

    def fail(ctx):
        raise ValueError("away")

    def count(ctx):
        ctx.store("out", joins.group_join(ctx.read("ord"), _t(spark, sf_dir, "lineitem"), ("id", "l_orderkey"), lines=F.count(F.lit(1))), F.col("id"))

    stages = [Stage(["Load"]), Stage(["Count"])]
    try:
        Mission("m", spark, [Action("Load", load), Action("Count", fail)], stages).run(executions=kept)
    except ValueError:
        pass
    again = Mission("m", spark, [Action("Load", fail), Action("Count", count)], stages)
    out = again.run(kept.reopen(again), kept).stores["out"].scan()
    return out.select("id", "kind", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("SELECT 'm' AS mission, 3::BIGINT AS stages, 2::BIGINT AS done, 1::BIGINT AS failed, 66::BIGINT AS percent")
def progress_rollup(spark, sf_dir):  # P3, P10, A16
    def fail(ctx):
        raise ValueError("no")

    m = Mission("m", spark, [Action("A", lambda c: None), Action("B", lambda c: None), Action("C", fail)], [Stage(["A"]), Stage(["B"], when=lambda m: False), Stage(["C"])])
    try:
        m.run()
    except ValueError:
        pass
    return mission.progress(m.audit())


# --- missions as text ------------------------------------------------------------------------


class _Echo:
    """Stands for an HTTP client: what it answers follows from the path alone."""

    def request(self, verb, path, params=None, body=None):
        key = int(path.rsplit("/", 1)[1])
        return {"id": key, "double": 2 * key, "tier": "even" if key % 2 == 0 else "odd"}


def _keyed(spark, body: str, tables: dict, plain: str) -> DataFrame:
    """A mission over stores of which all but one have their own keys."""
    names = " ".join(f'store {n}: memory("{n}")' for n in sorted({*tables, "out"}))
    c = text.Compiler(text.parse(f"mission Q {{ {names} action A {{ {body} }} run A }}"), spark)
    for n, t in tables.items():
        c.stores.stores[n] = Store(n).set(t) if n == plain else Store(n, t)
    return c.build().run().stores["out"].scan()


def _mission(spark, body: str, stores: dict, out: str = "out", **kw) -> DataFrame:
    names = " ".join(f'store {n}: memory("{n}")' for n in sorted({*stores, "out", "rest"}))
    return text.run(f"mission Q {{ source API {{ base: \"http://x\" }} {names} action A {{ {body} }} run A }}", spark, stores, **kw).stores[out].scan()


@query("""SELECT c_custkey AS id, 2 * c_custkey AS double, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS tier FROM customer""")
def api_enrichment_join(spark, sf_dir):  # J6, S1, S3: a request for each row
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    api = paging.Endpoint(_Echo(), "id long, double long, tier string")
    got = _mission(spark, 'for c in cust { get "/customers/{c.c_custkey}" store { id: c.c_custkey, double: response.double, tier: response.tier } -> out { key: .id } }', {"cust": c}, sources={"API": api})
    return got.select("id", "double", "tier")


@query("""SELECT o_orderkey AS id, o_custkey AS cust, 2 * o_custkey AS double FROM orders""")
def request_log_join(spark, sf_dir):  # S1, J6: orders of one customer ask for it once
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    api = paging.Endpoint(_Echo(), "id long, double long, tier string")
    body = 'for o in ord { get "/customers/{o.o_custkey}" store { id: o.o_orderkey, cust: response.id, double: response.double } -> out { key: .id } }'
    return _mission(spark, body, {"ord": o}, sources={"API": api}).select("id", "cust", "double")


class _Quote:
    """Stands for an HTTP client: what it answers follows from the body alone."""

    def request(self, verb, path, params=None, body=None):
        return {"part": body["part"], "cents": int(sum(body["cents"])), "size": len(body["cents"])}


@query("""SELECT ps AS id, ps AS part, 4 * ps AS cents, 2::BIGINT AS size FROM (SELECT p_partkey AS ps FROM part)""")
def request_with_body(spark, sf_dir):  # S1: each row posts a body of its own
    p = _t(spark, sf_dir, "part").select("p_partkey")
    body = 'for p in parts { post "/quotes" { body: { part: p.p_partkey, cents: [p.p_partkey, p.p_partkey * 3] } } store { id: p.p_partkey, part: response.part, cents: response.cents, size: response.size } -> out { key: .id } }'
    got = _mission(spark, body, {"parts": p}, sources={"API": paging.Endpoint(_Quote(), "part long, cents long, size long")})
    return got.select("id", "part", "cents", "size")


@query("""SELECT c_custkey AS id, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderstatus = 'F') AS filled,
                 coalesce(sum(round(o_totalprice * 100)::BIGINT), 0)::BIGINT AS cents, coalesce(bool_or(o_orderstatus = 'P'), false) AS pending
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def store_correlated_counts(spark, sf_dir):  # R17, E25: parts of a store counted and summed for each row
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    body = """for c in cust { store { id: c.c_custkey, n: count(ord where .o_custkey == ^.c_custkey), filled: count(ord where .o_custkey == c.c_custkey and .o_orderstatus == "F"),
        cents: sum(ord where .o_custkey == c.c_custkey, .cents), pending: any of ord where .o_custkey == c.c_custkey and .o_orderstatus == "P" } -> out { key: .id } }"""
    return _mission(spark, body, {"cust": c, "ord": o}).select("id", "n", "filled", F.col("cents").cast("long"), "pending")


@query("""SELECT o_orderkey AS id, n_name AS nation, r_name AS region
          FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def store_keyed_lookup(spark, sf_dir):  # D3: s[k].f, along three stores
    stores = {"ord": _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")}
    for name, key in (("customer", "c_custkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        stores[name] = Catalog(spark).put(name, _t(spark, sf_dir, name), F.col(key)).table
    body = "for o in ord where exists(customer[o.o_custkey]) { let n = nation[customer[o.o_custkey].c_nationkey] store { id: o.o_orderkey, nation: n.n_name, region: region[n.n_regionkey].r_name } -> out { key: .id } }"
    return _keyed(spark, body, stores, "ord").select("id", "nation", "region")


@query("""SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)""")
def store_keyed_anti(spark, sf_dir):  # D4: rows whose key a store doesn't have
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    rich = _t(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_custkey")
    body = "for c in cust where not exists(rich[c.c_custkey]) { store { id: c.c_custkey } -> out { key: .id } }"
    return _keyed(spark, body, {"cust": c, "rich": Catalog(spark).put("rich", rich, F.col("o_custkey")).table}, "cust").select("id")


@query("""SELECT o_orderkey AS id, (SELECT count(*) FROM events WHERE user_id = o_custkey AND value > o_orderkey % 90 + 50) AS above FROM orders""")
def store_theta_count(spark, sf_dir):  # R17: a condition that no grouping answers
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 90).alias("least"))
    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "value")
    body = "for o in ord { store { id: o.o_orderkey, above: count(ev where .user_id == o.o_custkey and .value > o.least + 50) } -> out { key: .id } }"
    return _mission(spark, body, {"ord": o, "ev": e}).select("id", "above")


@query("""SELECT c_custkey AS id, 'string' AS tier FROM customer""")
def dry_run_mock(spark, sf_dir):  # P13, S10: nothing is asked, answers are samples
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    sample = {"type": "object", "properties": {"tier": {"type": "string"}}}
    api = paging.Endpoint(None, "tier string", sample)
    got = _mission(spark, 'for c in cust { get "/customers/{c.c_custkey}" store { id: c.c_custkey, tier: response.tier } -> out { key: .id } }', {"cust": c}, sources={"API": api}, dry_run=True)
    return got.select("id", "tier")


@query("""SELECT o_orderkey AS id FROM orders WHERE NOT (o_totalprice > 200000 AND o_orderstatus <> 'P')""")
def validate_or(spark, sf_dir):  # R10 in a mission: what fails goes elsewhere
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    body = 'for o in ord { validate o { assume .o_totalprice > 200000, assume .o_orderstatus != "P" } or { store { id: o.o_orderkey } -> rest { key: .id } } store { id: o.o_orderkey } -> out { key: .id } }'
    return _mission(spark, body, {"ord": o}, out="rest").select("id")


@query("""SELECT o_orderkey AS id, n, big, CASE WHEN n > 3 THEN 'many' ELSE 'few' END AS kind, q AS first_q
          FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 30) AS big, first(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1)""")
def collection_where(spark, sf_dir):  # R17, E26: narrowed collections, an index, if-then-else
    line = F.struct("l_linenumber", "l_quantity")
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = "for o in ord { store { id: o.l_orderkey, n: count(o.lines), big: count(o.lines where .l_quantity > 30), kind: if count(o.lines) > 3 then \"many\" else \"few\", first_line: o.lines[0] } -> out { key: .id } }"
    got = _mission(spark, body, {"ord": o})
    return got.select("id", F.col("n").cast("long").alias("n"), F.col("big").cast("long").alias("big"), "kind", F.col("first_line.l_quantity").alias("first_q"))


def _orders_with_lines(spark, sf_dir) -> DataFrame:
    line = F.struct("l_linenumber", "l_quantity", "l_returnflag")
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


@query("""SELECT l_orderkey AS id, round(sum(l_quantity) * 100)::BIGINT AS total, round(coalesce(sum(2 * l_quantity) FILTER (l_returnflag = 'R'), 0) * 100)::BIGINT AS twice,
          count(*) FILTER (l_quantity > 30) AS big, max(l_quantity) > 45 AS has_huge, min(l_quantity) > 2 AS none_tiny,
          round(sum(l_quantity * l_linenumber) * 100)::BIGINT AS weighted FROM lineitem GROUP BY 1""")
def pipe_lambda(spark, sf_dir):  # D1, R18, A9-A11, E26: pipes, lambdas, a field of all elements
    body = """for o in ord { store { id: o.l_orderkey, total: sum(o.lines.l_quantity), twice: o.lines | filter(.l_returnflag == "R") | sum(.l_quantity * 2),
        big: o.lines | count(x => x.l_quantity > 30), has_huge: o.lines | some(.l_quantity > 45), none_tiny: o.lines | every(.l_quantity > 2),
        weighted: reduce(o.lines, 0, (a, x) => a + x.l_quantity * x.l_linenumber) } -> out { key: .id } }"""
    got = _mission(spark, body, {"ord": _orders_with_lines(spark, sf_dir)})
    cents = [F.round(F.col(c) * 100).cast("long").alias(c) for c in ("total", "twice", "weighted")]
    return got.select("id", F.col("big").cast("long").alias("big"), "has_huge", "none_tiny", *cents)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'filled:' || o_orderkey WHEN o_orderstatus = 'F' THEN 'small' ELSE 'rest' END AS what
          FROM orders WHERE o_orderstatus <> 'P'""")
def match_patterns(spark, sf_dir):  # R13: fields with a literal, names that are bound
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("state"), F.struct(F.col("o_totalprice").alias("total")).alias("sum"))
    body = """for o in ord { match o { { state: "F", sum: { total: t }, id: k } where t > 100000 -> { store { id: o.id, what: "filled:" + k } -> out { key: .id } },
        { state: "F" } -> { store { id: o.id, what: "small" } -> out { key: .id } }, { state: "P" } -> skip, other -> { store { id: other.id, what: "rest" } -> out { key: .id } } } }"""
    return _mission(spark, body, {"ord": o}).select(F.col("id").cast("long").alias("id"), "what")


@query("""SELECT l_orderkey AS id, CASE WHEN sum(l_quantity) > 150 THEN 'large' WHEN bool_and(l_quantity < 40) THEN 'light' ELSE 'mixed' END AS what
          FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def match_guards(spark, sf_dir):  # D11, R15: a match of conditions, names of the mission
    body = """for o in ord where count(o.lines) > 1 { match { sum(o.lines.l_quantity) > 150 -> { store { id: o.l_orderkey, what: "large" } -> out { key: .id } },
        o.lines | every(.l_quantity < 40) -> { store { id: o.l_orderkey, what: "light" } -> out { key: .id } }, _ -> { store { id: o.l_orderkey, what: "mixed" } -> out { key: .id } } } }"""
    return _mission(spark, body, {"ord": _orders_with_lines(spark, sf_dir)}).select("id", "what")


@query("""SELECT o_orderkey AS id FROM orders JOIN (SELECT l_orderkey, bool_and(l_returnflag IS NOT NULL) AS whole FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE whole""")
def match_every_schema(spark, sf_dir):  # D12: each element is of a schema
    program = """mission Q { store ord: memory("ord") store out: memory("out") schema Line { l_quantity: number, l_returnflag: string }
        action A { for o in ord { match o { { lines: [Line] } -> { store { id: o.l_orderkey } -> out { key: .id } }, _ -> skip } } } run A }"""
    return text.run(program, spark, {"ord": _orders_with_lines(spark, sf_dir)}).stores["out"].scan().select("id")
