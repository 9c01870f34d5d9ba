"""Line deduplication with two Bloom filters: hashes seen once, and seen twice.

The filters only choose what is shuffled: a line whose key surely occurs in one
document stays where it is.  Suspected repeats are confirmed by their whole keys.
Of the texts only those move that may lose lines, as a filter of their ids tells.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import CHUNK, gathered, hits, members, mix, opened, packed, size_for
from .storage import materialize

BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None, least: int) -> list[bytes | None]:
    """A key for each line of ``text``, None where it has fewer than ``least`` code points."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(BLANK).lower()  # bytes.lower changes A-Z alone
        out.append(key if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least) else None)
    return out


def _build(least: int, bits: int):
    def run(batches):
        own: list[np.ndarray] = []
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                keys = {k for k in line_keys(text, least) if k is not None}
                if keys:
                    own.append(np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)))
        if not own:
            return
        seen, count = np.unique(np.concatenate(own), return_counts=True)
        once, twice = packed(seen, bits), packed(seen[count > 1], bits)
        rows = []
        for c in range(0, bits // 8, CHUNK):
            x, y = once[c : c + CHUNK], twice[c : c + CHUNK]
            if x.any():
                rows.append((c // CHUNK, zlib.compress(x.tobytes(), 1), zlib.compress(y.tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["chunk", "once", "twice"])

    return run


def _merge(batches):
    """Filters of many tasks become one: a bit set in two of them may mark a repeat."""
    seen: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for c, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x, y = (np.frombuffer(zlib.decompress(b), np.uint8) for b in (once, twice))
            if c in seen:
                a, b = seen[c]
                seen[c] = [a | x, b | y | (a & x)]
            else:
                seen[c] = [x, y]
    for c, (_, y) in seen.items():
        if y.any():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(y.tobytes(), 1)], pa.binary())], ["chunk", "twice"])


def _suspects(least: int, bits: int, shared):
    def run(batches):
        filter_ = opened(shared)
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                own = [k for k in dict.fromkeys(line_keys(text, least)) if k is not None]
                if own:
                    hit = hits(filter_, np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)), bits)
                    for k in np.flatnonzero(hit):
                        ids.append(i)
                        keys.append(own[k])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(keys, pa.binary())], ["_id", "_key"])

    return run


def _side(shared, bits: int, touched: bool):
    """The rows whose first column, a hash, passes the filter, or the others."""

    def run(batches):
        filter_ = opened(shared)
        for batch in batches:
            passes = hits(filter_, mix(batch.column(0).to_numpy().view(np.uint64)), bits)
            yield batch.filter(pa.array(passes if touched else ~passes))

    return run


def _rewrite(least: int, n: int):
    """Texts without the keys to drop, in the column after the first ``n``."""
    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(n).cast(pa.large_binary()).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                drop = set(drop or ())
                whole = (text or b"").split(b"\n")
                keep = [x for x, k in zip(whole, line_keys(text, least), strict=True) if k is None or k not in drop] if drop else whole
                lines.append(len(whole))
                dropped.append(len(whole) - len(keep))
                texts.append(None if text is None else b"\n".join(keep))
            made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            names = [f"c{i}" for i in range(n)] + ["text", "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of at least ``least_chars`` code points in at least ``least_docs`` (2 or more)
    documents lose their lines except in the largest id that holds them.  Null and
    empty texts are one empty line and stay as they are.  Rows that share an id are
    one document when documents are counted; a null id is one document, smaller than
    all others.  An empty table gives no rows; input columns called n_lines or
    n_dropped are replaced.
    """
    if least_docs < 2:
        raise ValueError("least_docs must be 2 or more")
    text = F.col(text_col)
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    bits = size_for(docs.agg(F.sum(n_lines)).first()[0] or 1)
    parts = docs.select(text.alias("t")).mapInArrow(_build(least_chars, bits), "chunk int, once binary, twice binary")
    merged = parts.repartition("chunk").mapInArrow(_merge, "chunk int, twice binary")
    shared = gathered(merged, bits)

    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("i"), text.alias("t")).mapInArrow(_suspects(least_chars, bits, shared), f"_id {id_type}, _key binary")
    # Both sides of the join are written, so that a key which many documents hold can be split.
    pairs = materialize(found.distinct(), "suspects")
    repeats = pairs.groupBy("_key").agg(F.count("*").alias("_docs"), F.max("_id").alias("_last")).where(F.col("_docs") >= least_docs)
    repeats = materialize(repeats.select("_key", "_last"), "repeats")
    lost = pairs.join(repeats, "_key").where(~F.col("_id").eqNullSafe(F.col("_last")))
    drops = materialize(lost.groupBy("_id").agg(F.collect_list("_key").alias("_drop")), "drops")

    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    plain = docs.select(F.xxhash64(id_col).alias("_h"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], text.alias("t"))
    names = [f"c{i}" for i in range(len(others))]
    at = F.col(names[others.index(id_col)])
    id_bits = size_for(drops.count())
    ids = members(drops.select(F.xxhash64("_id")), id_bits)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    rest = plain.mapInArrow(_side(ids, id_bits, False), schema)
    lines = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1
    rest = rest.select(*names, F.col("t").alias("text"), F.coalesce(lines, F.lit(1)).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"))
    joined = plain.mapInArrow(_side(ids, id_bits, True), schema).join(drops, at.eqNullSafe(F.col("_id")), "left").select(*names, "t", "_drop")
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)] + ["text string, n_lines bigint, n_dropped bigint"])
    done = joined.mapInArrow(_rewrite(least_chars, len(others)), schema).union(rest)
    back = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("text")}
    return done.select(*[back[c].alias(c) for c in docs.columns if c in back], "n_lines", "n_dropped")
