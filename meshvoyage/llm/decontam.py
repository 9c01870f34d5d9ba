"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each run of consecutive k-gram hashes the smallest is kept.  Two texts that
share a span of ``window`` words share a whole run and so keep the same hash
there; the kept hashes of documents and benchmark are joined, and each hit is
extended word by word.  Spans of ``window`` words or more are hits.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Largest set of benchmark hashes (8 bytes each) that is broadcast as a filter before
#: the join; without the filter the join shuffles all of the documents' fingerprints.
BROADCAST_HASHES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of ``text``, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _shift(a: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(a[i], a[i + by]) for every i that has both."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), f)


def _grams(h: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` word hashes, by doubling; ``h`` is bound already."""
    if k == 1:
        return h
    if k % 2:
        n = F.greatest(F.size(h) - (k - 1), F.lit(0))
        return F.zip_with(F.slice(_grams(h, k - 1), 1, n), F.slice(h, k, n), lambda x, y: F.xxhash64(x, y))
    return _let(_grams(h, k // 2), lambda g: _shift(g, k // 2, lambda x, y: F.xxhash64(x, y)))


def _minima(g: Column, w: int) -> Column:
    """The smallest of each ``w`` consecutive values; ``g`` is bound already."""
    if w == 1:
        return g
    if w % 2:
        n = F.greatest(F.size(g) - (w - 1), F.lit(0))
        return F.zip_with(F.slice(_minima(g, w - 1), 1, n), F.slice(g, w, n), lambda x, y: F.least(x, y))
    return _let(_minima(g, w // 2), lambda m: _shift(m, w // 2, lambda x, y: F.least(x, y)))


def _kept(rows: DataFrame, window: int, wanted: DataFrame | None) -> DataFrame:
    """Fingerprints of ``rows`` (with words), once for each place: hash, place, and the words around."""
    k = window // 2
    run, around = window - k + 1, window - k
    hashed = rows.withColumn("_s", _let(F.transform("_words", lambda w: F.xxhash64(w)), lambda h: _let(_grams(h, k), lambda g: F.struct(g.alias("g"), _minima(g, run).alias("m")))))
    each = hashed.select(*rows.columns, F.col("_s.g").alias("_g"), F.col("_s.m").alias("_all"), F.posexplode("_s.m").alias("_i", "_hash"))
    if wanted is not None:
        each = each.join(F.broadcast(wanted), "_hash", "left_semi")
    place = F.col("_i") + F.array_position(F.slice("_g", F.col("_i") + 1, run), F.col("_hash")).cast("int") - 1
    before = F.col("_i") - 1 + F.array_position(F.slice("_g", F.col("_i"), run), F.get("_all", F.col("_i") - 1)).cast("int") - 1
    each = each.withColumn("_p", place).where((F.col("_i") == 0) | (F.when(F.col("_i") > 0, before) != F.col("_p")))
    p = F.col("_p")
    left = F.reverse(F.slice("_words", F.greatest(p - around, F.lit(0)) + 1, F.least(p, F.lit(around))))
    return each.select(*[c for c in rows.columns if c != "_words"], "_hash", "_p", left.alias("_left"), F.slice("_words", p + 1, k).alias("_gram"), F.slice("_words", p + k + 1, around).alias("_right"))


def _agree(a: str, b: str) -> Column:
    """How many words agree from the start of both lists."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return _let(same, lambda s: F.when(F.array_position(s, F.lit(False)) == 0, F.size(s)).otherwise(F.array_position(s, F.lit(False)).cast("int") - 1))


def _short_hits(docs: DataFrame, short: DataFrame) -> list[DataFrame]:
    """Occurrences of items with fewer words than a window, one join for each length."""
    hits = []
    for (n,) in sorted(short.select("_n").distinct().collect()):  # fewer values than the window has words
        gram = lambda c, n=n: _let(F.transform(c, lambda w: F.xxhash64(w)), lambda h: _grams(h, n))
        items = short.where(F.col("_n") == n).select("_item", F.col("_words").alias("_item_words"), F.get(gram(F.col("_words")), F.lit(0)).alias("_hash"))
        items = materialize(items, "short-items")
        each = docs.select("*", F.posexplode(gram(F.col("_words"))).alias("_p", "_hash"))
        if items.count() <= BROADCAST_HASHES:
            each = each.join(F.broadcast(items.select("_hash").distinct()), "_hash", "left_semi")
        each = each.select("_id", "_text", "_hash", "_p", F.slice("_words", F.col("_p") + 1, n).alias("_gram"))
        hits.append(each.join(items, "_hash").where("_gram = _item_words").select("_id", "_text", "_item", F.col("_p").alias("lo"), (F.col("_p") + n - 1).alias("hi")))
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    A document word is hit inside an occurrence of ``window`` consecutive words of an
    item, or of a whole item of fewer words.  A document is contaminated when at least
    one word and at least ``share`` of its words are hit.  Null and empty texts have
    no words; items without words occur nowhere; a null item id reads as ''.  Repeated
    rows are judged each by its own text.  Extra columns are ignored.  Empty tables
    give no rows, or rows without hits.
    """
    found = _judged(docs, benchmark, window, share, id_col, text_col, item_col)
    return found.select(F.col("_id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, share: float, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """``contamination`` with the columns _id and _text, the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), words_of(F.col(text_col)).alias("_words"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), words_of(F.col(text_col)).alias("_words")).withColumn("_n", F.size("_words"))
    marks = materialize(_kept(items.where(F.col("_n") >= window).select("_item", "_words"), window, None), "benchmark")
    wanted = materialize(marks.select("_hash").distinct(), "benchmark-hashes")
    found = _kept(base, window, wanted if wanted.count() <= BROADCAST_HASHES else None)
    k = window // 2
    theirs = marks.select("_item", "_hash", F.col("_left").alias("_l"), F.col("_gram").alias("_g"), F.col("_right").alias("_r"))
    pairs = found.join(theirs, "_hash").where("_gram = _g").withColumn("_before", _agree("_left", "_l")).withColumn("_after", _agree("_right", "_r"))
    long = pairs.where(F.col("_before") + F.col("_after") + k >= window).select("_id", "_text", "_item", (F.col("_p") - F.col("_before")).alias("lo"), (F.col("_p") + (k - 1) + F.col("_after")).alias("hi"))
    hits = long
    for short in _short_hits(base, items.where((F.col("_n") > 0) & (F.col("_n") < window))):
        hits = hits.unionByName(short)
    own = hits.groupBy("_id", "_text").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"), F.collect_set("_item").alias("_items"))
    covered = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["hi"]).alias("end"), (s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"] - 1, s["end"]), F.lit(0))).alias("n")),
        lambda s: s["n"],
    )
    own = own.select(F.col("_id").alias("_own"), F.col("_text").alias("_own_text"), covered.alias("_hit"), F.array_sort("_items").alias("_items"))
    n_words = F.size(F.array_remove(F.split(text, NOT_WORD_CASED), "")).cast("bigint")
    all_ = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), n_words.alias("_n"))
    joined = all_.join(own, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_text") == F.col("_own_text")), "left")
    part = Fraction(share).limit_denominator(1_000_000)  # whole numbers, so that ties are exact
    hit, listed = F.coalesce("_hit", F.lit(0).cast("bigint")), F.coalesce("_items", F.array().cast("array<string>"))
    return joined.select(
        "_id",
        "_text",
        F.col("_n").alias("n_words"),
        hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * part.denominator >= F.col("_n") * part.numerator)).alias("contaminated"),
        listed.alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the contaminated rows; rows that share an id, or have none, are judged each by its own text."""
    bad = _judged(docs, benchmark, window, share, id_col, text_col, item_col).where("contaminated")
    bad = materialize(bad.select(F.col("_id").alias("_bad"), F.col("_text").alias("_bad_text")).distinct(), "contaminated")
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_bad")) & (own == F.col("_bad_text")), "left_anti")
