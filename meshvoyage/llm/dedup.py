"""Exact deduplication by skew-safe combining.

Rows are combined in three stages that all compare the whole text: within a map
task (the partial aggregate), within (digest, salt) groups, and then, for hot
digests alone, over the salt winners.  Digests only choose the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: A digest is hot with more than 1 / (HOT_SHARE * shuffle partitions) of all rows, so
#: at most HOT_SHARE * shuffle partitions digests are: the bound of the broadcast below.
HOT_SHARE = 10
SALTS = 64


def _salted(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with digest, body, hot and salt; and the written (id, digest) table."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), body.alias("_body"), F.sha2(body, 256).alias("_digest"), *carry)
    ids = materialize(base.select("_id", "_digest"), "digests")
    n, parts = ids.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = ids.groupBy("_digest").agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_SHARE * parts > F.lit(n)).where("_n > 1").select("_digest", F.lit(True).alias("_hot"))
    salted = base.join(F.broadcast(hot), "_digest", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    return salted.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(F.lit(0))), ids


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  The row with the
    largest id stays.  Of repeated rows (same id and text) one is kept; a null id
    is smaller than any other and stays only in a group without one.  Different
    texts of one digest, should they occur, are told apart by their content.
    Extra columns are ignored; an empty table gives no rows.
    """
    salted, ids = _salted(docs, id_col, text_col, [])
    merged = salted.groupBy("_digest", "_salt", "_body", "_hot").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
    winners = materialize(merged.select("_digest", "_hot", F.when(F.col("_hot"), F.col("_body")).alias("_body"), "_keep", "_size"), "winners")
    groups = winners.where("NOT _hot").select("_digest", "_keep", "_size").union(
        winners.where("_hot").groupBy("_digest", "_body").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size")).select("_digest", "_keep", "_size")
    )
    groups = materialize(groups, "groups")
    clash = groups.groupBy("_digest").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_digest")
    copies = ids.groupBy("_digest", "_id").agg(F.count("*").alias("_copies"))
    if clash.isEmpty():
        members = copies.join(groups, "_digest")
    else:  # equal digests of different texts: their rows are matched by content
        rows = salted.select("_id", "_digest", "_body").join(clash, "_digest", "left_semi")
        own = rows.groupBy("_digest", "_body").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
        told = rows.join(own, ["_digest", "_body"]).groupBy("_digest", "_id", "_keep", "_size").agg(F.count("*").alias("_copies"))
        members = copies.join(clash, "_digest", "left_anti").join(groups, "_digest").select("_digest", "_id", "_keep", "_size", "_copies").union(told)
    each = members.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return each.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id.

    All columns are carried through the same stages, so no row is joined back.
    Rows that tie in the id are ordered by their other columns.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    carried = {c: f"_c{i}" for i, c in enumerate(others)}
    row = F.struct(F.col("_id"), F.col("_null"), *[F.col(x) for x in carried.values()])
    order = F.struct(F.col("_id"), F.to_json(F.struct(F.col("_null"), *[F.col(x) for x in carried.values()])))
    salted, _ = _salted(docs, id_col, text_col, [F.col(text_col).isNull().alias("_null"), *[F.col(f"`{c}`").alias(x) for c, x in carried.items()]])
    merged = salted.groupBy("_digest", "_salt", "_body", "_hot").agg(F.max_by(row, order).alias("_row"), F.max(order).alias("_order"))
    winners = materialize(merged, "winners")
    last = winners.where("_hot").groupBy("_digest", "_body").agg(F.max_by("_row", "_order").alias("_row"))
    kept = winners.where("NOT _hot").select("_body", "_row").union(last.select("_body", "_row"))
    text = F.when(F.col("_row._null"), F.lit(None).cast("string")).otherwise(F.col("_body"))
    columns = {id_col: F.col("_row._id"), text_col: text} | {c: F.col(f"_row.{x}") for c, x in carried.items()}
    return kept.select(*[columns[c].alias(c) for c in docs.columns])
