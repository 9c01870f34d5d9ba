"""Concatenate and cut: token streams into fixed windows by two-pass prefix sums.

The first pass tokenizes every document once and writes ids, each document's start
within its partition, and thereby the partitions' token totals.  Prefix sums over
the totals give each partition's global offset; the second pass cuts every document
at the multiples of the window without a shuffle.  A document that crosses
boundaries leaves a record on either side of each.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .storage import held, materialize, slices

#: Entries of a worker's word cache; older ones go when a half is full.
WORDS = 600_000
LONGEST = 64  # code points of a cached word
#: Marks that follow words; the apostrophe is none, as contractions begin with it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
OWNER = "packing"


class _Cache(dict):
    """Ids by word, in two generations: what is not used while the younger fills is forgotten."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size // 2, {}

    def __missing__(self, key: str) -> bytes:
        core = key.rstrip(MARKS)
        if core and len(core) < len(key) and core.isalpha():
            return self[core] + self[key[len(core) :]]  # a word and marks: each has its entry, both together none
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """Ids of a BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    Files whose pre-tokenizer drops white space (the normalizer NFC, white space to
    spaces, lower case) are encoded word by word with a cache, for their BPE never
    looks across white space; any other file is encoded whole.  Special tokens'
    strings within a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        steps = [x.get("type") for x in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        drops = pre[0].get("type") == "Split" and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and r"\s" in pre[0]["pattern"].get("Regex", "")
        self.by_word = bool(drops) and steps == ["NFC", "Replace", "Lowercase"] and spec["model"]["type"] == "BPE"
        if self.by_word:
            self.model, self.pre = self.whole.model, self.whole.pre_tokenizer
            self.words = _Cache(self._encode, WORDS)

    def _encode(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isascii() and chunk.isalpha() else [w for w, _ in self.pre.pre_tokenize_str(chunk)]
        return np.array([t.id for w in words for t in self.model.tokenize(w)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        chunks = text.split() if not _SEPARATORS.search(text) else regex.split(r"\p{White_Space}+", text)
        return b"".join(map(self.words.__getitem__, chunks))


#: str.split() takes these for white space, Unicode does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path``, kept with its cache until another operator's task begins."""
    own = held(OWNER)
    if path not in own:
        own[path] = WordTokenizer(path)
    return own[path]


def _encode(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        own, part, start = tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 512, OWNER):
            ids = [own.ids(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            slim = [np.frombuffer(x, "<u4").astype("<u2").tobytes() if np.frombuffer(x, "<u4").max() < 1 << 16 else x for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(n), pa.array(slim, pa.binary())], ["_id", "_part", "_start", "_n", "_ids"])

    return run


def _cut(window: int, bases, ids_wanted: bool, digests: bool):
    def run(batches):
        base = bases.value
        for batch in slices(batches, keep=OWNER):
            rows = {k: [] for k in ("_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "ids_crc32")}
            for i, part, start, n, packed in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = packed if len(packed) == 4 * n else np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                at, begun = base[part] + start, 0
                while begun < n:
                    seq, offset = divmod(at + begun, window)
                    size = min(window - offset, n - begun)
                    piece = ids[4 * begun : 4 * (begun + size)]
                    for k, v in (("_id", i), ("start", begun), ("length", size), ("doc_tokens", n), ("sequence_id", seq), ("offset", offset), ("ids", piece if ids_wanted else None), ("ids_crc32", zlib.crc32(piece) if digests else None)):
                        rows[k].append(v)
                    begun += size
            types = [batch.column(0).type, *[pa.int64()] * 5, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Pieces of the concatenated token stream: id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    The stream is cut at every multiple of ``window``, so all sequences but the last
    are full.  ``ids`` are little-endian unsigned 32-bit; ``digests`` adds
    their CRC-32 as ids_crc32, and either can be left out.  Every input row is a
    document of its own, also with a null or repeated id; extra columns are ignored;
    an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    coded = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(_encode(tokenizer_path, end_id), f"_id {kind}, _part int, _start bigint, _n bigint, _ids binary")
    stored = materialize(coded, "tokens")
    totals = {r["_part"]: r["n"] for r in stored.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}  # one number a partition
    ends = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, n in totals.items():
        ends[part + 1] = n
    bases = docs.sparkSession.sparkContext.broadcast(np.cumsum(ends).tolist())
    schema = f"_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, ids_crc32 bigint"
    pieces = stored.mapInArrow(_cut(window, bases, ids, digests), schema).withColumnRenamed("_id", id_col)
    return pieces.drop(*[c for c, wanted in (("ids", ids), ("ids_crc32", digests)) if not wanted])
