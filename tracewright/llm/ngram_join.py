"""N-gram Jaccard join with PartEnum signatures, exact.

Sizes fall into bands [l, r] with r the largest size that can match l. A set gives signatures
for its own band and the next, so two sets that match always share a band instance. There,
they differ in at most k elements. The feature domain is hashed into partitions:

* k >= 16: k + 1 + e partitions, one signature for each. At least 1 + e agree, so a set with at
  most e empty partitions may leave those out: empty ones would bring strangers together.
* k < 16: n1 = ceil((k + 1) / 2) + 1 groups, in two of which at most one element differs; three
  parts each, and a signature for every pair of parts. A set in which at most one group has an
  empty pair may leave that out.
* k = 0: equal sets only, which are one class already.

Equal sets are collapsed first. In a few rounds each document meets the hubs of its buckets, and
is compared with the one that it meets most often: that joins large groups of near copies with
as many comparisons as documents. Then only pairs in one bucket whose members are not yet
connected remain. Sizes and sketches rule most of them out for certain,
and all others are verified on the sets themselves: no link between different components is
lost, and pairs inside a component need no check.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, text_buffer, words
from .components import components

NGRAM, NUM, DEN = 3, 90, 100
EXTRA, SHARES, ROUNDS = 1, 4, 4
BROADCAST_IDS = 500_000  # ids of 8 bytes; beyond it, a shuffle join
_U = np.uint64


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct shingles of one text's word hashes; a shorter text is one shingle."""
    if not len(h):
        return h
    m = min(n, len(h))
    out = h[: len(h) - m + 1] * _U(2 * m + 1)
    for k in range(1, m):
        out = mix(out) + h[k : len(h) - m + 1 + k]
    return np.unique(mix(out))


def bands(num: int, den: int, most: int) -> np.ndarray:
    """The largest size of each band, up to the band of `most`. Band i is (r[i-1], r[i]]."""
    out = [0]
    while out[-1] < most:
        out.append((out[-1] + 1) * den // num)
    return np.array(out[1:])


class PartEnum:
    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.r = bands(num, den, 1 << 10)
        self._known: dict[int, tuple[int, int, int]] = {}

    def _instance(self, band: int) -> tuple[int, int, int]:
        """The number of this band, the largest difference of two sets up to its size, and the extra
        partitions: about as many as leave hardly any set with more empty partitions than that."""
        while band >= len(self.r):
            self.r = bands(self.num, self.den, int(self.r[-1]) * 2)
        if band not in self._known:
            k = int(2 * self.r[band] * (self.den - self.num) // (self.den + self.num))
            least = int(self.r[band - 2]) + 1 if band > 1 else 1
            extra = 2
            for _ in range(20):
                empty = (k + 1 + extra) * math.exp(-least / (k + 1 + extra))
                if extra >= (more := math.ceil(empty + 4 * math.sqrt(empty)) + 1):
                    break
                extra = more
            self._known[band] = band, k, extra
        return self._known[band]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        while len(s) > self.r[-1]:
            self.r = bands(self.num, self.den, int(self.r[-1]) * 2)
        band = int(np.searchsorted(self.r, len(s)))
        value = mix(s + _U(0x51ED270B))
        return np.concatenate([self._of(s, value, *self._instance(b)) for b in (band, band + 1)])

    def _of(self, s: np.ndarray, value: np.ndarray, band: int, k: int, extra: int) -> np.ndarray:
        if k == 0:
            return np.zeros(0, np.uint64)
        flat = k >= 16
        n = k + 1 + extra if flat else 3 * ((k + 2) // 2 + EXTRA)
        part = ((s >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, part, value)
        number = np.arange(n, dtype=np.uint64)
        empty = np.bincount(part, minlength=n) == 0
        if flat:
            if empty.sum() <= extra:
                sums, number = sums[~empty], number[~empty]
        else:
            a = np.concatenate([np.arange(0, n, 3) + i for i, _ in combinations(range(3), 2)])
            b = np.concatenate([np.arange(0, n, 3) + j for _, j in combinations(range(3), 2)])
            void = empty[a] & empty[b]
            sums, number = mix(sums[a] + _U(1)) + sums[b], number[a] * _U(n) + number[b]
            if len(np.unique(a[void] // 3)) <= EXTRA:
                sums, number = sums[~void], number[~void]
        return mix(mix(sums) + _U(band * 0x9E3779B97F4A7C15 % (1 << 64)) + number)


def _per_text(column: pa.Array, n: int):
    data, offsets = text_buffer(column)
    h, w = words(data, offsets)
    for i in range(len(w) - 1):
        yield shingles(h[w[i] : w[i + 1]], n)


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s + _U(11)).sum(dtype=np.uint64), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sigs for each row."""

    def run(batches):
        join = PartEnum(num, den)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                size, d1, d2, sigs = [], [], [], []
                for s in _per_text(part.column("text"), n):
                    x, y = _digest(s)
                    size.append(len(s)), d1.append(x), d2.append(y)
                    sigs.append(join.signatures(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["doc_id", "n_shingles", "d1", "d2", "sigs"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sigs array<long>")


MOST_SKETCH_BITS = 1 << 15


def sketch(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Parities of the elements in m bins, as 64-bit words; m is a power of two, about 16 times the difference allowed.

    Two sketches differ in at most as many bins as their sets in elements, so a pair whose
    sketches differ more than the similarity allows is no match: nothing is lost by leaving
    it out. The larger of two sketches folds into the smaller one's size.
    """
    allowed = 2 * len(s) * (den - num) // (den + num)
    m = 64
    while m < min(16 * allowed, MOST_SKETCH_BITS):
        m *= 2
    parity = np.bincount((s & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _may_match(n: tuple[str, str], k: tuple[str, str], num: int, den: int):
    """False only for pairs that sizes or sketches rule out. n, k: the columns of the sizes and sketches."""
    (na, nb), (ka, kb) = (map(F.col, n)), (map(F.col, k))
    words = F.least(F.size(ka), F.size(kb))

    def folded(x):
        return F.when(F.size(x) > words, F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    bins = F.aggregate(F.zip_with(folded(ka), folded(kb), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & ((den + num) * bins <= (den - num) * (na + nb))


SHORT_BITS = 1024


def short_sketch(s: np.ndarray) -> np.ndarray:
    """A sketch of one size for all sets, so that distances between sketches obey the triangle inequality."""
    parity = np.bincount((s & _U(SHORT_BITS - 1)).astype(np.int64), minlength=SHORT_BITS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n, k, k8: the number of shingles, the sketch and the short sketch of each row."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [(len(s), sketch(s, num, den), short_sketch(s)) for s in _per_text(part.column("text"), n)]
                types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
                columns = [part.column("doc_id"), *(pa.array([x[i] for x in made], t) for i, t in enumerate(types))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k", "k8"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k array<long>, k8 array<long>")


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, s: the distinct shingles of each row."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = pa.array([x.view(np.int64) for x in _per_text(part.column("text"), n)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), s], ["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids. Few ids are broadcast; more than BROADCAST_IDS are joined by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _distance(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, b: t + b)


def summaries(placed: DataFrame, of: DataFrame, scratch: Scratch) -> DataFrame:
    """For each component: c, size, lo, hi (of its sets' sizes), k8 of its first member, and r: how far its members are from that.

    placed: doc_id, c. A component's first member is the document that names it.
    """
    own = placed.join(of.select("doc_id", "n", "k8"), "doc_id")
    first = of.select(F.col("doc_id").alias("c"), F.col("k8").alias("_k8"))
    # Written between join and group: so a very large component can be split in the one, and is summed up before the other.
    far = scratch.save(own.join(first, "c").select("c", "n", _distance("k8", "_k8").alias("r")), "far")
    ranges = far.groupBy("c").agg(F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("r").alias("r"))
    return ranges.join(first.withColumnRenamed("_k8", "k8"), "c")


def meetings(members: DataFrame, placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of documents of different components: for each document at most one, the hub that it
    meets most often. A bucket's hub is its member with the most crowded buckets, in later turns a random one.

    members: sig, doc_id, crowd. Pairs are as many as documents at most, whatever the size of buckets.
    """
    weight = F.struct(F.col("crowd"), -F.col("doc_id")) if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "doc_id"), -F.col("doc_id"))
    rows = members.join(placed, "doc_id")
    hubs = rows.groupBy("sig").agg(F.max_by(F.struct("doc_id", "c"), weight).alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    met = rows.join(hubs.select("sig", F.col("hub.doc_id").alias("hub"), F.col("hub.c").alias("_c")), "sig").where("c <> _c")
    often = met.groupBy("doc_id", "hub").agg(F.count("*").alias("times"))
    best = often.groupBy("doc_id").agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("hub"))
    return best.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def crossing(buckets: DataFrame, about: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of components (ca, cb) of one bucket, of which some members may match; ca is the smaller one.

    By the triangle inequality, members of two components differ at least as much as their
    first members' short sketches, less both radii. Buckets carry short sketches only.
    """
    rows = buckets.join(about, "c")
    x = rows.select("sig", *(F.col(c).alias(f"{c}a") for c in ("c", "size", "lo", "hi", "r", "k8")))
    y = rows.select(F.col("sig").alias("_sig"), *(F.col(c).alias(f"{c}b") for c in ("c", "size", "lo", "hi", "r", "k8")))
    sizes = (den * F.col("hia") >= num * F.col("lob")) & (den * F.col("hib") >= num * F.col("loa"))
    bins = _distance("k8a", "k8b") - F.col("ra") - F.col("rb")
    may = sizes & ((den + num) * bins <= (den - num) * (F.col("hia") + F.col("hib")))
    met = x.join(y, (F.col("sig") == F.col("_sig")) & (F.col("ca") < F.col("cb")) & may)
    swap = F.col("sizea") > F.col("sizeb")
    pick = lambda one, other: F.when(swap, F.col(other)).otherwise(F.col(one))
    return met.select(pick("ca", "cb").alias("ca"), pick("cb", "ca").alias("cb")).distinct()


def members_of(pairs: DataFrame, placed: DataFrame, of: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of documents (a, b) from pairs of components, without those that sizes and sketches rule out."""
    own = placed.join(of.select("doc_id", "n", "k"), "doc_id")
    x = own.select(F.col("c").alias("ca"), F.struct("doc_id", "n", "k").alias("x"))
    y = own.select(F.col("c").alias("_cb"), F.struct("doc_id", "n", "k").alias("y"))
    may = _may_match(("x.n", "y.n"), ("x.k", "y.k"), num, den)
    met = pairs.join(x, "ca").join(y, (F.col("cb") == F.col("_cb")) & may)
    a, b = F.col("x.doc_id"), F.col("y.doc_id")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def plausible(pairs: DataFrame, of: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""
    x = of.select(F.col("doc_id").alias("a"), F.struct("n", "k").alias("x"))
    y = of.select(F.col("doc_id").alias("b"), F.struct("n", "k").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_may_match(("x.n", "y.n"), ("x.k", "y.k"), num, den)).select("a", "b")


def verified(pairs: DataFrame, of: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    x, y = of.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), of.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    common = pairs.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return common.where(den * F.col("i") >= num * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def link(docs: DataFrame, n: int = NGRAM, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: doc_id, n_shingles, class_id; links between classes: a, b).

    class_id is the smallest doc_id with the same set. The links join all that num / den
    similarity joins; pairs that other links connect already may be missing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    base = scratch.save(signed(docs, n, num, den), "signed")
    key = ["d1", "d2", "n_shingles"]
    some = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Written first, so that the join below is of two plain shuffles, which a very large class can be split in.
    classes = scratch.save(some.groupBy(*key).agg(F.min("doc_id").alias("class_id")), "classes")
    out = scratch.save(
        base.select("doc_id", *key).join(classes, key, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "docs"
    )
    copies = out.where("class_id <> doc_id").select("doc_id", "class_id")
    # The signatures are matched in shares of their domain, so that only one share is in shuffles at a time.
    shares = []
    for share in range(SHARES):
        rows = some.select("doc_id", F.explode("sigs").alias("sig")).where(F.pmod("sig", F.lit(SHARES)) == share)
        shared = rows.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("sig")
        met = rows.join(shared, "sig").join(copies, "doc_id", "left").select("sig", F.coalesce("class_id", "doc_id").alias("doc_id"))
        shares.append(scratch.save(met.distinct(), "met"))
        del rows, shared, met
        scratch.free_shuffles()
    scratch.drop(base)
    met = reduce(DataFrame.unionAll, shares)
    several = met.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.save(met.join(several, "sig"), "members")
    # How crowded a document's buckets are. Of near copies, the one with the fewest changes of its own has the most.
    crowds = members.groupBy("doc_id").agg(F.sum("n").alias("crowd"))
    of = scratch.save(sketches(only(docs, scratch.save(crowds.select("doc_id"), "ids")), n, num, den), "sketches")
    members = scratch.save(members.drop("n").join(crowds, "doc_id"), "members")

    def check(pairs: DataFrame) -> DataFrame:
        own = scratch.save(sets(only(docs, scratch.save(ends(pairs), "ids")), n), "sets")
        return scratch.save(verified(pairs, own, num, den), "links")

    # Rounds of one pair for each document at most. What they link needs no more checks inside.
    placed = of.select("doc_id", F.col("doc_id").alias("c"))
    tried = links = spark.createDataFrame([], "a long, b long")
    for turn in range(ROUNDS):
        pairs = scratch.save(plausible(meetings(members, placed, turn).join(tried, ["a", "b"], "left_anti"), of, num, den), "pairs")
        if pairs.isEmpty():
            break
        tried, links = tried.unionAll(pairs), links.unionAll(check(pairs))
        named = components(links, scratch).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "c")
        placed = scratch.save(of.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("c", "doc_id").alias("c")), "placed")
        scratch.free_shuffles()
    buckets = members.select("sig", "doc_id").join(placed, "doc_id").select("sig", "c").distinct()
    mixed = buckets.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig")
    buckets = scratch.save(buckets.join(mixed, "sig", "left_semi"), "buckets")
    about = scratch.save(summaries(placed, of, scratch), "components")
    shares = []
    for share in range(SHARES):
        shares.append(scratch.save(crossing(buckets.where(F.pmod("sig", F.lit(SHARES)) == share), about, num, den), "crossing"))
        scratch.free_shuffles()
    crossed = scratch.save(reduce(DataFrame.unionAll, shares).distinct(), "crossing")
    shares = []
    for share in range(SHARES):
        own = crossed.where(F.pmod(F.xxhash64("ca", "cb"), F.lit(SHARES)) == share)
        shares.append(scratch.save(members_of(own, placed, of, num, den).join(tried, ["a", "b"], "left_anti"), "pairs"))
        scratch.free_shuffles()
    rest = check(reduce(DataFrame.unionAll, shares))

    # Rows that share an id are one document: its classes are linked.
    several = out.where("class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z")
    same = out.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b")).where("a <> b")
    return out, links.unionByName(rest).unionByName(same)


def join_components(docs: DataFrame, n: int = NGRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than n words is
    one shingle; null, empty and blank texts have none and are linked with nothing: their
    component is their own id. A row without an id is linked with nothing and has no
    component. Rows that share an id are one document. Repeated rows come back as often. Texts
    are taken whole, very long ones too. Other columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    rows, links = link(docs, n, num, den)
    found = components(links)
    return rows.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id")
    )
