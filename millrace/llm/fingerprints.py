"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Every paragraph (a line of the text) is hashed to a wide vector; a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo a power of two. So it doesn't depend
on the order of paragraphs, and a paragraph is inserted or deleted by adding or subtracting
its vector (`combine`). A vector has three groups of lanes:

* 16 lanes modulo 2**32, hashed from the whole paragraph: equality.
* 1 lane modulo 2**32: the number of the paragraph's word pairs.
* 128 lanes modulo 2**32: how many of its word pairs hash to a value with that bit set.
  Centred by half the number of pairs these sums are a random projection of the document's
  word pairs, so that the cosine of two fingerprints estimates how alike two texts are.

Only SQL functions are used. The pairs of a text are exploded and summed inside the task
that holds it, as its rows are dealt by a key that the sums group by: no row of a pair or
paragraph is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkit import buckets, byte_bounds, range_bucket, settle

DENSE, BITS = 16, 128
_U32 = 0xFFFFFFFF
#: Where words end inside a paragraph.
_SPACES = r"[\x20\x09-\x0D]+"


def _dense(text: Column) -> Column:
    """The lanes of the whole paragraphs. xxhash64 with a lane number is hashed on from the
    paragraph's own hash, so that a paragraph's bytes are read once."""
    h = F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p))
    low = F.lit(_U32)
    lane = lambda i: F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: acc + F.xxhash64(x, F.lit(i)).bitwiseAND(low), lambda acc: acc.bitwiseAND(low))
    return F.array(*[lane(i) for i in range(DENSE)])


def _pairs(text: Column) -> Column:
    """Hashes of the word pairs inside each paragraph. A paragraph is cut at white space
    into pieces, which may be empty; one of a single piece has that as its only pair."""
    w = F.split(text, _SPACES, -1)
    n = F.size(w) - 1
    two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 0, two).otherwise(F.transform(w, lambda x: F.xxhash64(x)))


def _hex(total: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(total)), width, "0")


def vectors(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """For each row of df, known by `keys`: one column of lanes (array of long) for each
    entry name -> text column, null for a null text. Rows with the same keys would be summed
    together. If df is partitioned by some of the keys, nothing is shuffled."""
    tagged = F.filter(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, c in enumerate(texts.values())]), lambda t: t["text"].isNotNull())
    one = df.select(*keys, F.explode(tagged).alias("_t"))
    # evaluated below the generator, once for each text
    one = one.select(*keys, F.col("_t.which").alias("_which"), _dense(F.col("_t.text")).alias("_dense"), F.split("_t.text", "\n", -1).alias("_ps"))
    one = one.select(*keys, "_which", "_dense", F.explode("_ps").alias("_p"))
    rows = one.select(*keys, "_which", "_dense", F.explode(_pairs(F.col("_p"))).alias("_h0")).withColumn("_h1", F.xxhash64("_h0"))
    # two counters share a long: neither can reach 2**31, as no text has so many words
    two = F.lit((1 << 32) | 1)
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(F.shiftrightunsigned(f"_h{b // 32}", b % 32).bitwiseAND(two)).alias(f"b{b}") for b in range(BITS // 2)]
    got = rows.groupBy(*keys, "_which", "_dense").agg(*sums)
    lanes = [F.col("n").bitwiseAND(F.lit(_U32))]
    for b in range(BITS // 2):
        lanes += [F.col(f"b{b}").bitwiseAND(F.lit(_U32)), F.shiftrightunsigned(f"b{b}", 32)]
    got = got.select(*keys, "_which", F.concat("_dense", F.array(*lanes)).alias("_lanes"))
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == i, F.col("_lanes"))).alias(name) for i, name in enumerate(texts)])


WIDTH = DENSE + 1 + BITS


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a with the paragraphs of b inserted (sign 1) or deleted (sign -1)."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.pmod(x["a"] + sign * x["b"], F.lit(1 << 32)))


def as_text(lanes: Column) -> Column:
    """Lower-case hex of all lanes, in order."""
    return F.array_join(F.transform(lanes, lambda x: _hex(x, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of their centred bit sums, 0 at least."""

    def centred(v: Column) -> Column:
        n = F.element_at(v, DENSE + 1)
        return F.transform(F.slice(v, DENSE + 2, BITS), lambda x: (2 * x - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z)

    ca, cb = centred(a), centred(b)
    norm = F.sqrt(dot(ca, ca) * dot(cb, cb))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(ca, cb) / norm)))


def _ordered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """df with _range, _at (from 1) and _next (the text of the row that follows in
    descending key, null at the end of a range), dealt out once by key range, of about equally
    many bytes each; and (_range, _head), the first text of the range that follows, the last
    range being followed by the first. Equal keys are ordered by text; null keys come last."""
    n = buckets(df.sparkSession, 2)
    bounds = byte_bounds(df, key, F.octet_length(text) + 64, n)
    d = df.withColumn("_range", range_bucket(F.col(key), bounds))
    w = Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), F.col(text))
    # a task for each range: hashed, some tasks would get several
    rows = d.repartitionByRange(n, "_range").select("*", F.row_number().over(w).alias("_at"), F.lead(text).over(w).alias("_next"))
    # one row for each range: their number follows the partitions, not the rows
    tops = d.groupBy("_range").agg(F.max(key).alias("_top"))
    ring = Window.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = tops.select(F.col("_range").alias("_of"), F.coalesce(F.lead("_range").over(ring), F.first("_range").over(whole)).alias("_from"))
    t = tops.select(F.col("_range").alias("_from"), "_top")
    named = d.select(F.col("_range").alias("_r"), F.col(key).alias("_k"), F.col(text).alias("_head"))
    heads = named.join(F.broadcast(t), (named["_r"] == t["_from"]) & named["_k"].eqNullSafe(t["_top"]))
    heads = heads.groupBy("_from").agg(F.min("_head").alias("_head"))
    return rows, place.join(heads, "_from").select(F.col("_of").alias("_range"), "_head")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document in descending key, the last being followed by the
    first. Null text counts as empty, which is one empty paragraph. Equal fingerprints have
    likeness 1, whatever the texts. Rows with equal keys are all kept, ordered by text;
    null keys come last; a single row is followed by itself. An empty table gives an empty
    result. Columns not named are ignored, whatever their names.
    """
    d = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d, heads = _ordered(d, "_id", "_text")
    # one text for each range
    heads = settle(heads)
    # a range's number alone goes with the rows of its text's pairs
    sums = settle(vectors(heads, ["_range"], {"_hv": "_head"}))
    d = d.join(heads, "_range").withColumn("_next", F.coalesce("_next", "_head"))
    n = F.char_length("_text")
    m = F.floor(n / 3).cast("int")
    sub = lambda c, at, size: F.substring(F.col(c) if isinstance(c, str) else c, at, size)
    d = d.select("_range", "_at", "_id", n.alias("_n"), "_text", sub("_text", F.lit(1), n - m).alias("_head"), sub("_next", F.lit(1), m).alias("_new"))
    # whole paragraphs before the cut are in both texts, and their vectors are summed once
    open_end = F.char_length(F.substring_index("_head", "\n", -1))
    common = F.char_length("_head") - open_end
    shared = F.when(common > 0, sub("_head", F.lit(1), common - 1))
    old = sub("_text", common + 1, n)
    new = F.concat(sub("_head", common + 1, n), F.col("_new"))
    sha = F.unhex(F.sha2(F.concat("_head", "_new"), 256))
    d = d.select("_range", "_at", "_id", F.col("_n").cast("long").alias("_n"), sha.alias("_sha"), shared.alias("_shared"), old.alias("_old"), new.alias("_edit"))
    v = vectors(d, ["_range", "_at", "_id", "_n", "_sha"], {"_s": "_shared", "_a": "_old", "_e": "_edit"})
    for c in ("_a", "_e"):
        v = v.withColumn(c, F.when(F.col("_s").isNull(), F.col(c)).otherwise(combine(F.col("_s"), F.col(c))))
    after = F.lead("_a").over(Window.partitionBy("_range").orderBy("_at"))
    v = v.withColumn("_b", after).join(sums, "_range").withColumn("_b", F.coalesce("_b", "_hv"))
    a, e, b = F.col("_a"), F.col("_e"), F.col("_b")
    return v.select(
        F.col("_id").alias(key),
        F.col("_n").alias("n_chars"),
        F.lower(F.hex("_sha")).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(e).alias("edited_fingerprint"),
        likeness(a, e).alias("near_edited"),
        likeness(a, b).alias("near_next"),
    )
