"""N-gram Jaccard self-join by universe partition and pigeonhole.

Sets of sizes that can reach the threshold differ in at most H shingles, H being
fixed by a band of sizes.  A band's universe is hashed into more than H segments, so
two similar sets agree in some whole segment; or into about half as many, where some
segment differs in one shingle at most, which one-deletion neighbourhoods find.  The
cheaper allocation is chosen for each band, but not neighbourhoods that write many
times the rows of whole segments.  Of its exact segments a set leaves out
the smallest ones beyond those the pigeonhole needs: all sets rank segments by the
same rule (their shingles' number, then their hash), so two similar sets still keep
a common one.  Candidates are verified on their whole sets.

Equal sets are linked by their digests, and one of them alone goes through the join.
A group of equal segments is not expanded into pairs.  Its members are first held
against one of them, the representative.  Only groups whose members this leaves in
different classes are compared further: all groups of one representative together, in
blocks that hold the members' sets, behind bounds that never drop a true pair.  A
block gives verified links alone, fewer than it has members.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import hits, members, mix, opened, size_for
from .components import connected_components
from .storage import discard, forget, materialize, release, slices

SPREAD = 2.0  # largest size of a band over its smallest
SLACK = 0.06  # more segments than needed, by this share of them and three
#: For the choice of allocation: the share of shingles taken to be common to many
#: documents, and the cost of a candidate pair in signature rows.
COMMON, PAIR_COST = 0.02, 4.0
#: Neighbourhoods may write so many times the signatures of whole segments.
MOST_ROWS = 2.0
SKETCH = 1024  # bits of the parity sketch
#: Members of a group, and their shingles, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Blocks travel in rounds, each of about this share of all shingles, or so many at least.
ROUND_SHARE, ROUND_SHINGLES = 1 / 2, 1 << 24
#: Signatures that one task groups, about.
BUCKET_ROWS = 1 << 21
_MULT = np.uint64(0x9E3779B97F4A7C55)


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of ``text``'s n-word shingles (A-Z lower-cased)."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        total = np.uint64(len(words))
        with np.errstate(over="ignore"):
            for x in h:
                total = total * _MULT + x
        return mix(np.array([total]) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    rolled = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        rolled *= _MULT
        rolled += h[i : len(h) - n + 1 + i]
    return np.unique(mix(rolled))


def bands(threshold: Fraction, largest: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band up to ``largest``; a set's partners lie in its own and the next ones."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * SPREAD), int(low / threshold))
        out.append((low, high))
        low = high + 1
    return out


def differing(a: int, b: int, threshold: Fraction) -> int:
    """The most shingles in which similar sets of sizes ``a`` and ``b`` differ."""
    return int((a + b) * (1 - threshold) / (1 + threshold))


def _agreeing(kind: str, size: int, segments: int, kept: float) -> float:
    """How often a segment's signatures of two unrelated sets of ``size`` agree, about.

    A segment's size is binomial; of whole segments the largest ones are kept, a share
    ``kept``.  Small segments count most: two empty ones agree, whatever the sets hold.
    """
    p = 1 / segments
    near = int(kind == "deletion")

    def chance(s: int) -> float:  # that a segment has s shingles
        if s > size:
            return 0.0
        ways = math.lgamma(size + 1) - math.lgamma(s + 1) - math.lgamma(size - s + 1)
        return math.exp(ways + s * math.log(p)) * (1 - p) ** (size - s)

    def alone(s: int) -> float:  # that a segment with s given shingles has no other, or one that is deleted
        rest = size - s
        return (1 - p) ** rest + near * rest * p * (1 - p) ** max(0, rest - 1)

    most = min(size, int(size * p + 12 * math.sqrt(size * p) + 12))
    left, out = kept, 0.0
    for s in range(most, -1, -1):
        share = min(left, chance(s))
        left -= share
        out += (share + near * (s + 1) * chance(s + 1)) * COMMON**s * alone(s)
    return out


def allocate(span: tuple[int, int], sets: int, threshold: Fraction) -> tuple[str, int]:
    """("exact" or "deletion", number of segments) of a band with ``sets`` sets."""
    high, mean = span[1], (span[0] + span[1]) // 2
    need = differing(high, high, threshold) + 1
    exact = need + (0 if need == 1 else 3 + int(SLACK * need))
    halved = (need + 1) // 2
    kept = min(exact, differing(mean, min(int(mean / threshold), high), threshold) + 1)

    def cost(kind: str, segments: int, rows: float, share: float) -> float:
        return sets * rows + PAIR_COST * sets * sets * segments * _agreeing(kind, mean, segments, share)

    if need > 1 and halved + mean <= MOST_ROWS * kept and cost("deletion", halved, halved + mean, 1.0) < cost("exact", exact, kept, kept / exact):
        return "deletion", halved
    return "exact", exact


def _signatures(own: np.ndarray, plans: list, threshold: Fraction) -> list[np.ndarray]:
    """The signatures of one set under its own band and those above that hold partners."""
    n, out = len(own), []
    reach = int(n / threshold)
    for band, (low, high), kind, segments in plans:
        if n > high or reach < low:
            continue
        salted = mix(own ^ np.uint64(band * 0x1F3D5B79 + 1))
        at = (salted >> np.uint64(32)) % np.uint64(segments)
        order = np.argsort(at, kind="stable")
        value, at = mix(salted)[order], at[order].astype(np.int64)
        sizes = np.bincount(at, minlength=segments)
        ends = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        stops = np.cumsum(sizes)
        sums = ends[stops] - ends[stops - sizes]
        names = mix(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 40))
        whole = mix(sums ^ names)
        if kind == "exact":
            keep = min(segments, differing(n, min(reach, high), threshold) + 1)
            if keep < segments:
                whole = whole[np.lexsort((whole, sizes))[segments - keep :]]
            out.append(whole)
        else:
            out.append(np.concatenate([whole, mix((sums[at] - value) ^ names[at])]))
    return out


def _scan(n: int):
    """(id, size, digest, parity sketch) of each document."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            sketches = []
            for s in sets:
                bits = np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
                sketches.append(np.packbits(bits.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sketches, pa.binary())], ["id", "n", "digest", "sketch"])

    return run


def _known(batch: pa.RecordBatch, filter_: np.ndarray, bits: int) -> pa.RecordBatch:
    """The rows whose ids pass the filter; none with a null id."""
    batch = batch.filter(pc.is_valid(batch.column(0)))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(hits(filter_, mix(ids.view(np.uint64)), bits)))


def _emit(n: int, plans: list, threshold: Fraction, buckets: int, shared, bits: int):
    """Signatures of the sets whose ids pass the filter, by bucket, many to a row.

    Equal ones of a batch are joined here: one of them travels on.
    """

    def run(batches):
        filter_ = opened(shared)
        for batch in slices(batches):
            batch, sigs, docs = _known(batch, filter_, bits), [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(t, n)
                if len(own):
                    for s in _signatures(own, plans, threshold):
                        sigs.append(s)
                        docs.append(np.full(len(s), i, np.int64))
            if not sigs:
                continue
            sig, rep, doc = _starred(np.concatenate(sigs), np.concatenate(docs))
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))  # ids in order compress well
            sig, rep, doc, bucket = sig[order], rep[order], doc[order], bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [(int(bucket[x]), sig[x:y], rep[x:y], doc[x:y]) for x, y in zip(at, np.r_[at[1:], len(sig)], strict=True)]
            rows = [(b, s.tobytes(), _narrow(d), np.packbits(r != d).tobytes() + r[r != d].tobytes()) for b, s, r, d in parts]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32())] + [pa.array([x[k] for x in rows], pa.binary()) for k in (1, 2, 3)], ["bucket", "sigs", "docs", "reps"])

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in 32 bits above their smallest where that is enough, after that smallest; else in 64 bits."""
    base = ids.min()
    wide = int(ids.max()) - int(base) >= 1 << 32
    return base.tobytes() + (ids.tobytes() if wide else (ids - base).astype("<u4").tobytes())


def _widened(packed: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(packed[:8], np.int64)[0]
    return np.frombuffer(packed, np.int64, offset=8) if len(packed) == 8 + 8 * n else np.frombuffer(packed, "<u4", offset=8).astype(np.int64) + base


def _starred(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, representative, member), one row for each distinct pair; the smallest id represents."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.r_[True, sig[1:] != sig[:-1]]
    once = new | np.r_[True, doc[1:] != doc[:-1]]
    rep = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    return sig[once], rep[once], doc[once]


def _group(batches):
    """Stars of the signatures that two or more documents have: (signature, representative, member)."""
    forget()
    sigs, docs, local = [], [], []
    for batch in batches:
        for s, d, r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            s = np.frombuffer(s, np.uint64)
            d = _widened(d, len(s))
            head = -(-len(s) // 8)
            other = np.unpackbits(np.frombuffer(r[:head], np.uint8), count=len(s)).astype(bool)
            local.append((s[other], np.frombuffer(r[head:], np.int64), d[other]))
            sigs.append(s[~other])
            docs.append(d[~other])
    if not sigs:
        return
    sig, rep, doc = _starred(np.concatenate(sigs), np.concatenate(docs))
    far = rep != doc
    found = [(sig[far], rep[far], doc[far]), *local]
    sig, rep, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    for x in range(0, len(sig), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[x : x + (1 << 16)].view(np.int64)) for a in (sig, rep, doc)], ["sig", "rep", "doc"])


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits two columns of sketches differ: never more than the sets differ in shingles."""
    x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (a, b))
    return np.bitwise_count(x ^ y).sum(axis=1)


def _bounded(num: int, den: int):
    """Of the pairs (a, b, sizes, sketches) those that the bounds let through."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ok = _apart(batch.column(4).to_pylist(), batch.column(5).to_pylist()) * (den + num) <= (a + b) * (den - num)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])

    return run


def _sets(n: int, shared, bits: int):
    """The sets of the documents whose ids pass the filter."""

    def run(batches):
        filter_ = opened(shared)
        for batch in slices(batches):
            batch = _known(batch, filter_, bits)
            made = [shingles(t, n).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "own"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in slices(batches):
            own = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = pa.array([_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in own], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return run


class _Classes:
    """Union-find over the classes of one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(x) + len(y) - common)


def _links_within(doc: list, comp: list, block: list, named: list, sets: list, num: int, den: int) -> list[tuple[int, int]]:
    """Verified links between members of one block that share a signature and are of different classes so far.

    Every such pair is decided: by the bounds, by its whole sets, or because links
    found here have joined its classes.  So there are fewer links than members.
    """
    if len(set(comp)) < 2:
        return []
    n = np.array([len(x) for x in sets])
    doc_, block_ = np.array(doc), np.array(block)
    cross = block_.min() != block_.max()
    order = np.lexsort((doc_, block_)) if cross else np.argsort(doc_, kind="stable")
    sketch = np.stack([np.packbits((np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)) for x in sets]).view(np.uint64)
    flat, at = np.concatenate(named), np.repeat(np.arange(len(doc)), [len(x) for x in named])
    by_sig = np.argsort(flat, kind="stable")
    flat, at = flat[by_sig], at[by_sig]
    share = np.zeros((len(doc), len(doc)), bool)
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    for x, y in zip(first.tolist(), np.r_[first[1:], len(flat)].tolist(), strict=True):
        if y - x > 1:
            share[np.ix_(at[x:y], at[x:y])] = True
    classes, links = _Classes(), []
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc))
    for i in order.tolist():
        j = np.flatnonzero(share[i] & (rank > rank[i]) & ((block_ != block_[i]) if cross else True))
        if not len(j):
            continue
        small, large = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
        j = j[den * small >= num * large]
        far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1)
        fits = far * (den + num) <= (n[j] + n[i]) * (den - num)
        for k in j[fits][np.argsort(far[fits], kind="stable")].tolist():
            if classes.find(comp[i]) != classes.find(comp[k]) and _similar(sets[i], sets[k], num, den):
                classes.join(comp[i], comp[k])
                links.append((min(doc[i], doc[k]), max(doc[i], doc[k])))
    return links


def _within(num: int, den: int):
    """Links (a, b) inside blocks that arrive sorted by (rep, lo, hi): see ``_links_within``."""

    def run(batches):
        key, held = None, None
        for batch in slices(batches):
            links = []
            cols = [batch.column(i).to_pylist() for i in range(6)]  # rep, lo, hi, doc, comp, block
            sigs = batch.column(6)
            flat, ends = sigs.values.to_numpy(), sigs.offsets.to_numpy()
            named = [flat[x:y].copy() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(7).to_pylist()]
            for row in zip(*cols, named, sets, strict=True):
                if row[:3] != key:
                    if held is not None:
                        links += _links_within(*held, num, den)
                    key, held = row[:3], ([], [], [], [], [])
                for to, value in zip(held, row[3:], strict=True):
                    to.append(value)
            yield _pairs(links)
        if held is not None:
            yield _pairs(_links_within(*held, num, den))

    return run


def _pairs(links: list) -> pa.RecordBatch:
    rows = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["a", "b"])


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float):
        self.share = Fraction(threshold).limit_denominator(1000)
        self.num, self.den, self.n = self.share.numerator, self.share.denominator, n
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("t"))
        self.table = materialize(self.docs.mapInArrow(_scan(n), "id bigint, n bigint, digest binary, sketch binary"), "sets")
        sized = self.table.where("id IS NOT NULL AND n > 0")
        self.firsts = materialize(sized.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.any_value("n").alias("n")), "firsts")

    def stars(self) -> DataFrame:
        """(sig, rep, doc) of the signatures that two or more different sets have."""
        spans = bands(self.share, self.table.agg(F.max("n")).first()[0] or 0)
        edges = F.array(*[F.lit(high) for _, high in spans]) if spans else F.array().cast("array<int>")
        band = F.size(F.filter(edges, lambda high: high < F.col("n")))
        sizes = {r[0]: r[1] for r in self.firsts.groupBy(band.alias("band")).count().collect()}  # a number for each band
        plans = [(k, span, *allocate(span, sizes.get(k, 0), self.share)) for k, span in enumerate(spans)]
        rows = sum(sizes.get(k, 0) * (segments + (sum(span) // 2 if kind == "deletion" else 0)) for k, span, kind, segments in plans)
        buckets = max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS)
        bits = size_for(sum(sizes.values()))
        known = members(self.firsts.select("first"), bits)
        sigs = self.docs.mapInArrow(_emit(self.n, plans, self.share, buckets, known, bits), "bucket int, sigs binary, docs binary, reps binary")
        return materialize(sigs.repartition(buckets, "bucket").mapInArrow(_group, "sig bigint, rep bigint, doc bigint"), "stars")

    def equal(self) -> DataFrame:
        """Links of equal sets, each to the smallest id."""
        many = self.firsts.where("copies > 1").select("digest", "first")
        return self.table.where("n > 0").join(many, "digest").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, own): the sets of the documents that ``ids`` names, and perhaps of a few more."""
        ids = materialize(ids, "ids")
        bits = size_for(ids.count())
        return materialize(self.docs.mapInArrow(_sets(self.n, members(ids, bits), bits), "id bigint, own binary"), "own")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of distinct ``pairs`` (a, b) those that reach the threshold, written."""
        known = self.table.where("id IS NOT NULL")
        left = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("digest").alias("da"), F.col("sketch").alias("sa"))
        right = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("digest").alias("db"), F.col("sketch").alias("sb"))
        sized = pairs.join(left, "a").join(right, "b").where(self.den * F.least("na", "nb") >= self.num * F.greatest("na", "nb"))
        sized = materialize(sized.select("a", "b", "na", "nb", F.when(F.col("da") != F.col("db"), F.col("sa")).alias("sa"), F.when(F.col("da") != F.col("db"), F.col("sb")).alias("sb")), "pairs")
        equal = sized.where("sa IS NULL").select("a", "b")
        maybe = materialize(sized.where("sa IS NOT NULL").mapInArrow(_bounded(self.num, self.den), "a bigint, b bigint").distinct(), "maybe")
        own = self.sets(maybe.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        both = maybe.join(own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b").join(own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a")
        links = materialize(both.select("a", "b", "x", "y").mapInArrow(_verify(self.num, self.den), "a bigint, b bigint").union(equal).distinct(), "links")
        for done in (own, maybe, sized):
            discard(done)
        return links

    def components(self) -> DataFrame:
        spark = self.docs.sparkSession
        stars = self.stars()
        release(spark)
        pairs = materialize(stars.select(F.col("rep").alias("a"), F.col("doc").alias("b")).distinct(), "candidates")
        links = materialize(self.linked(pairs).union(self.equal()), "links")
        discard(pairs)
        release(spark)
        comp = connected_components(links)
        found = self.within(stars, comp)
        discard(stars)
        release(spark)
        return comp if found.isEmpty() else connected_components(links.union(found))

    def within(self, stars: DataFrame, comp: DataFrame) -> DataFrame:
        """Links between members of common groups that ``comp`` leaves in different classes, written."""
        of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        classed = stars.join(of("rep"), "rep", "left").join(of("doc"), "doc", "left")
        apart = F.coalesce("crep", "rep") != F.coalesce("cdoc", "doc")
        # A group may have several stars, one from each batch; its smallest id names it.
        open_ = classed.groupBy("sig").agg(F.bool_or(apart).alias("apart"), F.min("rep").alias("top")).where("apart").select("sig", "top")
        open_ = materialize(open_, "open")
        rows = stars.join(open_, "sig").select(F.col("top").alias("rep"), F.explode(F.array("rep", "doc")).alias("doc"), "sig")
        named = materialize(rows.groupBy("rep", "doc").agg(F.collect_set("sig").alias("sigs")), "named")
        discard(open_)
        units = named.join(of("rep"), "rep", "left").join(of("doc"), "doc", "left").join(self.table.select(F.col("id").alias("doc"), "n"), "doc")
        # The representative's class is one side; its members are not held against each other.
        own_class = F.coalesce("cdoc", "doc") == F.coalesce("crep", "rep")
        written = units = materialize(units.select("rep", "doc", F.coalesce("cdoc", "doc").alias("comp"), own_class.alias("near"), "n", "sigs"), "units")
        discard(named)
        blocks = lambda side: F.greatest(F.lit(1), F.ceil(F.greatest(F.count_if(side) / BLOCK, F.sum(F.when(side, F.col("n")).otherwise(0)) / BLOCK_SHINGLES))).cast("int")
        small = (F.count("*") <= BLOCK) & (F.sum("n") <= BLOCK_SHINGLES)
        dealt = units.groupBy("rep").agg(small.alias("small"), blocks(F.col("near")).alias("g"), blocks(~F.col("near")).alias("h"))
        dealt = materialize(dealt, "dealt")
        units = units.join(dealt, "rep")
        place = F.pmod(F.xxhash64("doc"), F.when(F.col("near"), F.col("g")).otherwise(F.col("h"))).cast("int") + F.when(F.col("near"), 0).otherwise(F.col("g"))
        units = units.withColumn("block", F.when(F.col("small"), 0).otherwise(place))
        others = F.sequence(F.when(F.col("near"), F.col("g")).otherwise(0), F.col("g") + F.col("h") - 1)
        units = units.withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit(0))).otherwise(others)))
        sets = self.sets(units.select(F.col("doc").alias("id")).distinct())
        own = sets.select(F.col("id").alias("doc"), "own")
        units = units.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        # A round's blocks are written and done with before the next one's travel.
        load, whole = (t.agg(F.sum("n")).first()[0] or 0 for t in (units, self.table))
        rounds = max(1, math.ceil(load / max(ROUND_SHINGLES, ROUND_SHARE * whole)))
        found = None
        for k in range(rounds):
            part = units if rounds == 1 else units.where(F.pmod(F.xxhash64("rep", "lo", "hi", F.lit("round")), F.lit(rounds)) == k)
            full = part.join(own, "doc").select("rep", "lo", "hi", "doc", "comp", "block", "sigs", "own")
            sorted_ = full.repartition("rep", "lo", "hi").sortWithinPartitions("rep", "lo", "hi")
            more = materialize(sorted_.mapInArrow(_within(self.num, self.den), "a bigint, b bigint").distinct(), "more")
            found = more if found is None else found.union(more)
            del part, full, sorted_
            release(self.docs.sparkSession)
        for done in (sets, dealt, written):
            discard(done)
        return found


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of ``words``-word shingles
    (64-bit hashes) is ``threshold`` or more; component_id is the smallest id that links
    reach.  A text of fewer words is one shingle; null texts and texts without words
    have none and link with nothing.  Ids are integers; rows that share one are one
    node; a null id links with nothing and has a null component.  Extra columns are
    ignored; an empty table gives no rows.
    """
    join = _Join(docs, id_col, text_col, words, threshold)
    joined = join.table.join(join.components(), F.col("id") == F.col("node"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component of near duplicates."""
    join = _Join(docs, id_col, text_col, words, threshold)
    gone = materialize(join.components().where("component <> node").select(F.col("node").alias("_gone")), "gone")
    for done in (join.table, join.firsts):
        discard(done)
    release(docs.sparkSession)
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
