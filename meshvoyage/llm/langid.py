"""Language identification with word-first backoff.

A word of the model counts with its log frequency in each language.  Any other word
is read through its longest known character n-grams: those of five characters if the
model knows one of them, else those of four, and so on down to one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import slices

#: The model is fitted on about this many labelled documents of each language, chosen
#: by a hash of their ids; with fewer, on all of them.  It keeps all of their words.
SAMPLE_ROWS = 2500
WORDS, GRAMS = 0, (5, 4, 3, 2, 1)  # kinds of entries
SMOOTHING = 0.5
#: Words whose rows a worker remembers; beyond that it forgets them and looks them up again.
REMEMBERED = 1 << 16
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """Languages, and for each kind the sorted 64-bit hashes of its entries and a row of log odds for each.

    Flat arrays: a worker's copy takes 8 bytes an entry and 4 more for each language.
    """

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]


def held_out(id_: Column) -> Column:
    """True where crc32 of the id as text is 2 modulo 4; a null id reads as ''."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4 == 2


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))


def _count(batches):
    for batch in slices(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[lang].update(WORD.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, ["lang", "word", "n"])


def _grams_of(word: str, n: int) -> list[str]:
    edged = f"<{word}>" if n > 1 else word
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def _entries(batches):
    """(kind, hash, lang, n) of counted words and of the n-grams in them."""
    for batch in slices(batches):
        lang, words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        counts: Counter = Counter()
        for where, word, times in zip(lang, words, n, strict=True):
            counts[WORDS, word, where] += times
            for k in GRAMS:
                for gram in _grams_of(word, k):
                    counts[k, gram, where] += times
        made = [
            pa.array([k for k, _, _ in counts], pa.int32()),
            pa.array(_hashes([t for _, t, _ in counts]).view(np.int64)),
            pa.array([where for _, _, where in counts], pa.string()),
            pa.array(list(counts.values()), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(made, ["kind", "hash", "lang", "n"])


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str) -> Model:
    """A model from rows with text and language; one without languages if there are none."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a number for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(steps, math.ceil(steps * SAMPLE_ROWS / n)))])
    sample = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(steps)) < share[F.col(lang_col)])
    counted = sample.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).mapInArrow(_count, "lang string, word string, n bigint")
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    entries = words.mapInArrow(_entries, "kind int, hash bigint, lang string, n bigint").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))
    found = entries.toArrow()  # the words and n-grams of the sample
    kind, hashed, n = (found.column(i).to_numpy() for i in (0, 1, 3))
    where = pc.index_in(found.column(2), pa.array(langs)).to_numpy()
    tables = {}
    for k in (WORDS, *GRAMS):
        own = kind == k
        keys, at = np.unique(hashed[own].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        np.add.at(counts, (at, where[own]), n[own])
        logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * max(1, len(keys)))
        tables[k] = keys, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)
    return Model(langs, tables)


def _found(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes a table holds, and the rows of those."""
    keys, logs = table
    if not len(keys):
        return np.zeros(len(hashes), bool), logs
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    known = keys[at] == hashes
    return known, logs[at[known]]


class Scorer:
    """Scores of texts under a model; remembers the rows of up to REMEMBERED words."""

    def __init__(self, model: Model):
        self.langs, self.tables = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((REMEMBERED, len(self.langs)), np.float32)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, or that of its longest known n-grams, or zeros."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known, rows = _found(self.tables[WORDS], _hashes(words))
        out[known] = rows
        rest = np.flatnonzero(~known)
        for n in GRAMS:
            if not len(rest):
                break
            grams = [_grams_of(words[i], n) for i in rest]
            owner = np.repeat(np.arange(len(rest)), [len(g) for g in grams])
            known, rows = _found(self.tables[n], _hashes([g for own in grams for g in own]))
            sums = np.zeros((len(rest), len(self.langs)))
            np.add.at(sums, owner[known], rows)
            done = np.bincount(owner[known], minlength=len(rest)) > 0
            out[rest[done]] = sums[done] / n  # neighbours overlap in n - 1 characters
            rest = rest[~done]
        return out

    def totals(self, words: list[str]) -> np.ndarray:
        """The sum of the words' rows; at most REMEMBERED words."""
        fresh = list(set(words).difference(self.at))
        if len(self.at) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = list(set(words))
        if fresh:
            start = len(self.at)
            self.rows[start : start + len(fresh)] = self.rows_of(fresh)
            self.at.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(axis=0, dtype=np.float64)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        words = WORD.findall(text.lower())
        totals = np.zeros(len(self.langs))
        for x in range(0, len(words), REMEMBERED):
            totals += self.totals(words[x : x + REMEMBERED])
        odds = np.exp(totals - totals.max())
        best = int(odds.argmax())  # of equal scores the first language in order
        return self.langs[best], float(odds[best] / odds.sum())


def _predict(shared):
    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = [scorer(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score (0 to 1).

    The model learns from text and language of the rows that are not held out, and
    predicts from the whole text alone.  A null text, one without a letter, and any
    text when no labelled row exists are 'und' with score 0.  Equal scores go to the
    first language in order.  Repeated rows are judged alike; columns already called
    held_out, lang_pred or score are replaced; an empty table gives no rows.
    """
    known = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).where(~held_out(F.col("_i")))
    shared = docs.sparkSession.sparkContext.broadcast(train(known, "_t", "_l", "_i"))
    others = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).alias("_text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + ["lang_pred string, score double"])
    scored = plain.mapInArrow(_predict(shared), schema)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)]
    return scored.select(*back, held_out(F.col(f"c{others.index(id_col)}")).alias("held_out"), "lang_pred", "score")
