"""Keyed stores (K1-K18): a DataFrame with one row per key, and what writes to it.

A store's table has `_key` (text), `_seq` (a number that orders writes) and the record's
columns. Writes are declarative: they give a new Store and run when it is read or saved.
Last write wins by `_seq`, never by the order in which Spark happens to see rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import Semantics

KEY, SEQ = "_key", "_seq"


def key_column(df: DataFrame, key: Column | None = None) -> Column:
    """K6: the key as text; without an expression the record's id, else a random one; a
    key expression without a value is 'undefined'."""
    s = Semantics(df)
    if key is not None:
        return s.string(key, "undefined")
    if "id" in df.columns:
        return F.coalesce(s.string(F.col("id"), None), F.uuid())
    return F.uuid()


def _last(df: DataFrame) -> DataFrame:
    """The last row of each key: an aggregation with map-side combining, so that a key of
    very many writes is reduced before the shuffle."""
    rest = [c for c in df.columns if c != KEY]
    return df.groupBy(KEY).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), SEQ).alias("_r")).select(KEY, "_r.*")


@dataclass
class Store:
    """A named table of keyed records."""

    name: str
    table: DataFrame | None = None

    # --- reading ------------------------------------------------------------------------
    def scan(self) -> DataFrame:
        """All records, without the key."""
        return self._some().drop(KEY, SEQ)

    def ordered(self) -> DataFrame:
        """All records in the order of their writes."""
        return self._some().orderBy(SEQ).drop(KEY, SEQ)

    def numbered(self, place: str) -> DataFrame:
        """All records, with their place in the order of writes as a column."""
        return self._some().withColumnRenamed(SEQ, place).drop(KEY)

    def get(self, key) -> DataFrame:
        """K8: the record of a key: one row or none. A filter on the key reaches the scan."""
        return self._some().filter(F.col(KEY) == str(key)).drop(KEY, SEQ)

    def lookup(self, df: DataFrame, key: Column, into: str) -> DataFrame:
        """The record of each row's key as a struct, null where there is none."""
        t = self._some()
        right = t.select(F.col(KEY).alias("_lk"), F.struct(*[F.col(f"`{c}`") for c in t.columns if c not in (KEY, SEQ)]).alias(into))
        left = df.withColumn("_k", Semantics(df).string(key, "undefined"))
        return left.join(right, F.col("_k") == F.col("_lk"), "left").drop("_k", "_lk")

    def list(self, where: dict | None = None, limit: int = 0, offset: int = 0, order: str = SEQ) -> DataFrame:
        """Equal to all of `where` (or under an operator, {"age": ("gt", 30)}),
        then offset, then limit, in write order; 0 means not set for both."""
        df = self._some().filter(filter_column(where)) if where else self._some()
        if limit or offset:
            df = df.orderBy(order)
        if offset:
            df = df.offset(offset)
        if limit:
            df = df.limit(limit)
        return df.drop(KEY, SEQ)

    def count(self, where: dict | None = None) -> DataFrame:
        """One row with the number of records; limit and offset don't matter."""
        df = self._some().filter(filter_column(where)) if where else self._some()
        return df.agg(F.count(F.lit(1)).alias("n"))

    # --- writing ------------------------------------------------------------------------
    def set(self, df: DataFrame, key: Column | None = None, seq: Column | str | None = None, partial: bool | None = None, among: list[str] | None = None) -> Store:
        """Each key's whole record is replaced by its last write. `among` names
        columns that order the writes given here, before `seq`; they aren't stored."""
        new = self._incoming(df, key, seq, partial)
        if among:
            # grouped by the key as what follows is, so that this costs no shuffle of its own
            rest = [F.col(f"`{c}`") for c in new.columns if c != KEY and c not in among]
            new = new.groupBy(KEY).agg(F.max_by(F.struct(*rest), F.struct(*among, SEQ)).alias("_r")).select(KEY, "_r.*")
        if self.table is None:
            return Store(self.name, _last(new))
        both = self.table.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
        both = both.withColumn(SEQ, F.struct("_age", SEQ)).drop("_age")
        return Store(self.name, _last(both).withColumn(SEQ, F.col(f"{SEQ}._seq")))

    def upsert(self, df: DataFrame, key: Column | None = None, seq: Column | str | None = None, partial: bool | None = None, present: dict[str, Column] | None = None) -> Store:
        """Fields that a write has overwrite, the others stay; a new key is
        inserted. `present` says when a write has a field; without it a field is had where
        it is not null. Many writes of one key are merged in order first."""
        return self._merge(self._incoming(df, key, seq, partial), present)

    def _merge(self, new: DataFrame, present: dict[str, Column] | None) -> Store:
        fields = [c for c in new.columns if c not in (KEY, SEQ)]
        has = {c: (present or {}).get(c, F.col(f"`{c}`").isNotNull()) for c in fields}
        # the last write that has the field, for each field: one pass, combined map-side
        aggs = [F.max_by(F.struct(F.col(f"`{c}`").alias("v")), F.when(has[c], F.col(SEQ))).alias(c) for c in fields]
        merged = new.groupBy(KEY).agg(F.max(SEQ).alias(SEQ), *aggs)
        if self.table is None:
            return Store(self.name, merged.select(KEY, SEQ, *[F.col(f"`{c}`.v").alias(c) for c in fields]))
        old = self.table.select(F.col(KEY).alias("_ok"), F.col(SEQ).alias("_os"), *[F.col(f"`{c}`").alias(f"_o_{c}") for c in self.table.columns if c not in (KEY, SEQ)])
        both = old.join(merged, F.col("_ok") == F.col(KEY), "full_outer")
        out = [F.coalesce(KEY, "_ok").alias(KEY), F.coalesce("_os", SEQ).alias(SEQ)]
        for c in dict.fromkeys([*[x[3:] for x in old.columns if x.startswith("_o_")], *fields]):
            if c not in fields:
                out.append(F.col(f"_o_{c}").alias(c))
            elif f"_o_{c}" in old.columns:
                out.append(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`.v")).otherwise(F.col(f"_o_{c}")).alias(c))
            else:
                out.append(F.col(f"`{c}`.v").alias(c))
        return Store(self.name, both.select(*out))

    def update(self, df: DataFrame, key: Column | None = None, seq: Column | str | None = None) -> Store:
        """As upsert, but for keys that are there only."""
        if self.table is None:
            return self
        new = self._incoming(df, key, seq, None)
        there = self.table.select(F.col(KEY).alias("_there"))
        known = new.join(there, new[KEY] == there["_there"], "left_semi")
        return self._merge(known, None)

    def delete(self, keys: DataFrame, key: Column) -> Store:
        """K9: without the rows whose keys `keys` has."""
        gone = keys.select(Semantics(keys).string(key, "undefined").alias("_gone"))
        t = self._some()
        return Store(self.name, t.join(gone, t[KEY] == gone["_gone"], "left_anti"))

    def clear(self) -> Store:
        """K12, D10."""
        return Store(self.name, None if self.table is None else self.table.limit(0))

    # --- helpers ------------------------------------------------------------------------
    def _some(self) -> DataFrame:
        if self.table is None:
            raise LookupError(f"store {self.name} has no table yet")
        return self.table

    def _incoming(self, df: DataFrame, key: Column | None, seq: Column | str | None, partial: bool | None) -> DataFrame:
        order = F.monotonically_increasing_id() if seq is None else F.col(seq) if isinstance(seq, str) else seq
        new = df.select(key_column(df, key).alias(KEY), order.cast("long").alias(SEQ), *[F.col(f"`{c}`") for c in df.columns if c not in (KEY, SEQ)])
        return new if partial is None else new.withColumn("_partial", F.lit(partial))


# The operators a store's filter knows.
_OPS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "neq": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "contains": lambda c, v: c.contains(F.lit(v)),
}


def filter_column(where: dict) -> Column:
    """One predicate of all conditions, which Spark pushes into the scan."""
    out = F.lit(True)
    for name, cond in where.items():
        op, value = cond if isinstance(cond, tuple) else ("eq", cond)
        out = out & _OPS[op](F.col(f"`{name}`"), value)
    return out


class Catalog:
    """Stores by name (K16, X1): tables can be put in beforehand, read from and saved to
    parquet (S14), JSON (S12, K15) or JDBC (S13, K14)."""

    def __init__(self, spark: SparkSession, stores: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.stores: dict[str, Store] = {}
        for name, df in (stores or {}).items():
            self.put(name, df)

    def __getitem__(self, name: str) -> Store:
        return self.stores.setdefault(name, Store(name))

    def put(self, name: str, df: DataFrame, key: Column | None = None, seq: str | None = None) -> Store:
        self.stores[name] = Store(name).set(df, key, seq)
        return self.stores[name]

    def write(self, name: str, df: DataFrame, key: Column | None = None, seq: str | None = None, upsert: bool = False, partial: bool | None = None) -> Store:
        s = self[name]
        self.stores[name] = s.upsert(df, key, seq, partial) if upsert else s.set(df, key, seq, partial)
        return self.stores[name]

    def query(self, name: str, where: dict | None = None, limit: int = 0, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """The records asked for and their number without limit and offset."""
        return self[name].list(where, limit, offset), self[name].count(where)

    def names(self) -> list[str]:
        return sorted(self.stores)

    def save(self, name: str, path: str) -> None:
        """As parquet, into a new folder that then takes the old one's place, so that
        an interrupted write leaves the old table and a store may be saved to where it was
        loaded from. The store reads the saved table from then on."""
        new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
        self[name]._some().write.parquet(new)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        to = jvm.Path(path)
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        moved = fs.exists(to)
        if moved and not fs.rename(to, jvm.Path(old)):
            raise OSError(f"cannot move {path} aside; the new table is at {new}")
        if not fs.rename(jvm.Path(new), to):
            back = moved and fs.rename(jvm.Path(old), to)
            raise OSError(f"cannot put {new} at {path}" + (f"; the old table is at {old}" if moved and not back else ""))
        fs.delete(jvm.Path(old), True)
        self.load(name, path)

    def load(self, name: str, path: str) -> Store:
        self.stores[name] = Store(name, self.spark.read.parquet(path))
        return self.stores[name]

    def load_json_object(self, name: str, path: str) -> Store:
        """A JSON file that holds one object of records by key. A missing or corrupt
        file reads as an empty store."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            self.stores[name] = Store(name, self.spark.createDataFrame([], "_key string, _seq long, record string"))
            return self.stores[name]
        lines = self.spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        keys = lines.select("v", F.posexplode(F.json_object_keys(F.to_json("v"))).alias("_seq", "_key"))
        field = F.expr("get_json_object(to_json(v), concat('$[\\'', _key, '\\']'))")
        rows = keys.select("_key", F.col("_seq").cast("long"), field.alias("record"))
        self.stores[name] = Store(name, rows)
        return self.stores[name]

    def export(self, path: str) -> None:
        """All stores as JSON lines, one folder for each."""
        for name, s in self.stores.items():
            if s.table is not None:
                s.scan().write.mode("overwrite").json(f"{path}/{name}")

    def save_jdbc(self, name: str, url: str, table: str, properties: dict[str, str]) -> None:
        """K14."""
        self[name].scan().write.mode("append").jdbc(url, table, properties=properties)

    def load_jdbc(self, name: str, url: str, table: str, properties: dict[str, str], key: Column | None = None) -> Store:
        """Spark pushes filters, limits and offsets into the database."""
        return self.put(name, self.spark.read.jdbc(url, table, properties=properties), key)
