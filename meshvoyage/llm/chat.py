"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans.  Each
window repeats the system turn and the last turns before its span, as far as their
share of the budget goes, and marks only the span's own assistant texts as targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = "<turn ", ">\n", "</turn>\n"


def escaped(text: Column) -> Column:
    """``text`` without ``<`` and ``>``, so that no mark of the template can occur in it."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def token_count(text: Column) -> Column:
    """Tokens of ``text`` for the budget: runs of letters and digits, and single other marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]"), F.lit(0))) + 3


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of each conversation: conversation, window, n_repeated, text, loss_spans.

    A conversation's rows are ordered by turn, ties by role and text; every row is a
    turn, repeated ones too.  A null role or text counts as empty, and rows with a
    null conversation are one conversation.  ``text`` is the formatted window; its
    first ``n_repeated`` turns repeat the system turn (the conversation's first, if
    its role is system) and history.  ``loss_spans`` are the code points [start, end)
    of the span's assistant texts, as escaped.  A window holds at most ``budget``
    tokens if no turn takes more than a third of what the system turn and ``history``
    leave; turns are never split or dropped.  Each turn belongs to one span.  Extra
    columns are ignored; an empty table gives no rows.
    """
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(role_col, empty).alias("_role"), F.coalesce(text_col, empty).alias("_text"))
    rows = rows.withColumn("_n", token_count(F.col("_text")).cast("bigint"))
    order = W.partitionBy("_c").orderBy(F.col("_t").asc_nulls_first(), "_role", "_text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_seq": F.row_number().over(order),
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_sys": F.first(F.when(F.col("_role") == "system", F.struct("_role", "_text", "_n"))).over(order.rowsBetween(W.unboundedPreceding, 0)),
    })
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("_sys._n"), F.lit(0)), F.lit(3))
    rows = rows.withColumn("_span", F.floor(F.col("_before") * 3 / (room * 2)).cast("bigint"))
    rows = rows.withColumn("_starts", F.coalesce(F.lag("_span").over(order) != F.col("_span"), F.lit(True)))
    # The start of the next span, seen from behind: frames that grow from the end are quadratic.
    behind = W.partitionBy("_c").orderBy(F.col("_seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    start = F.when(F.col("_starts"), F.struct(F.col("_before").alias("at"), F.col("_span").alias("span")))
    rows = rows.withColumn("_later", F.last(start, ignorenulls=True).over(behind))
    repeats = F.col("_later").isNotNull() & (F.col("_later.at") - F.col("_before") <= history) & ~((F.col("_seq") == 1) & F.col("_sys").isNotNull())
    made = lambda seq, kind, role, text, own: F.struct(kind.alias("kind"), seq.alias("seq"), role.alias("role"), text.alias("text"), own.alias("own"))
    turn = lambda kind, own: made(F.col("_seq"), F.lit(kind), F.col("_role"), F.col("_text"), F.lit(own))
    system = made(F.lit(0), F.lit(0), F.col("_sys._role"), F.col("_sys._text"), F.lit(False))
    pair = lambda span, what: F.struct(span.alias("span"), what.alias("turn"))
    out = F.filter(
        F.array(
            pair(F.col("_span"), turn(2, True)),
            F.when(repeats, pair(F.col("_later.span"), turn(1, False))),
            F.when(F.col("_starts") & (F.col("_seq") > 1) & F.col("_sys").isNotNull(), pair(F.col("_span"), system)),
        ),
        lambda x: x.isNotNull(),
    )
    dealt = rows.select("_c", F.explode(out).alias("_x")).select("_c", "_x.span", "_x.turn")
    windows = dealt.groupBy("_c", "span").agg(F.array_sort(F.collect_list("turn")).alias("_turns"))
    return _rendered(windows).select(F.col("_c").alias(conv_col), F.col("span").alias("window"), "n_repeated", "text", "loss_spans")


def _rendered(windows: DataFrame) -> DataFrame:
    parts = F.transform("_turns", lambda t: F.struct(F.concat(F.lit(HEAD), escaped(t["role"]), F.lit(MIDDLE)).alias("head"), escaped(t["text"]).alias("body"), (t["own"] & (t["role"] == "assistant")).alias("target")))
    full = lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))
    windows = windows.withColumn("_parts", parts)
    # A running total of code points gives each target's place.
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    step = lambda s, p: F.struct(
        (s["at"] + F.length(full(p))).alias("at"),
        F.when(p["target"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
    )
    return windows.select(
        "_c",
        "span",
        F.size(F.filter("_turns", lambda t: ~t["own"])).alias("n_repeated"),
        F.array_join(F.transform("_parts", full), "").alias("text"),
        F.aggregate("_parts", state, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    # Before the first mark there is nothing.  Lengths are real ones: start and length together must not overflow.
    marked = F.split("text", HEAD)
    blocks = F.slice(marked, F.lit(2), F.size(marked))
    own = F.slice(blocks, F.col("n_repeated") + 1, F.size(blocks))
    role = lambda b: unescaped(F.substring_index(b, MIDDLE, 1))
    # A block is role, MIDDLE, body, TAIL; TAIL ends like MIDDLE, and neither role nor body holds "<" or ">".
    body = lambda b: unescaped(F.substring_index(F.substring_index(F.substring_index(b, MIDDLE, 2), MIDDLE, -1), TAIL[0], 1))
    told = F.array_join(F.transform(own, lambda b: F.concat(role(b), F.lit("\n"), body(b), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    each = windows.select(F.col(conv_col).alias("_c"), "window", F.size(own).cast("bigint").alias("_turns"), told.alias("_told"), loss.alias("_loss"), F.length("text").cast("bigint").alias("_chars"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    whole = each.groupBy("_c").agg(F.sum("_turns").alias("n_turns"), joined("_told").alias("_told"), joined("_loss").alias("_loss"), F.sum("_chars").alias("formatted_chars"))
    return whole.select(
        F.col("_c").alias(conv_col),
        "n_turns",
        F.sha2("_told", 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
