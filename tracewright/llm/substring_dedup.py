"""Substring dedup by content-defined chunking with a gear rolling hash.

The rolling hash of a position depends on the last 32 bytes only, and a position is a cut
if its hash is small, and if no other such position lies within the last MIN_CHUNK bytes.
So cuts follow the content: text inserted before a passage does not shift the cuts inside it.
The bytes before each cut are compared by digest over all documents, and the document with the
smallest id keeps them. Cuts of a text that one other text holds at one shift, each within reach
of the next, are a run. The first of them is compared byte by byte and so is what comes before
and after the run, as far as both texts agree; those between need equal digests at that very
shift. What is at least MIN_SPAN bytes long is a repeat, and repeats that touch make a span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, Scratch, _BYTE, _powers, mix, text_buffer

MEAN_CHUNK, MIN_CHUNK, MIN_SPAN = 24, 8, 96  # bytes
WINDOW, SEGMENT = 32, 1 << 20
PAD = 4  # bytes of a run before its end that are compared once more: the length of a character
BROADCAST_IDS = 500_000  # ids of 8 bytes; beyond it, a shuffle join
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of gear values of the last 32 bytes, each shifted by its age."""
    h = _GEAR[data]
    for age in (1, 2, 4, 8, 16):
        h[age:] = h[age:] + (h[:-age] << np.uint32(age))
    return h


def cuts(data: np.ndarray, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK) -> np.ndarray:
    """Ends of the chunks of one text. Slices of SEGMENT bytes only bound the memory; no cut depends on them."""
    found = []
    for at in range(0, len(data), SEGMENT):
        before = min(at, WINDOW)
        found.append(np.flatnonzero(gear(data[at - before : at + SEGMENT])[before:] < np.uint32((1 << 32) // mean)) + at + 1)
    p = np.unique(np.append(np.concatenate(found), len(data)).astype(np.int64)) if found else np.zeros(0, np.int64)
    keep = np.diff(p, prepend=-least) >= least
    if len(p):
        keep[-1] = True
    return p[keep]


def _digests(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    up, down = _powers(len(part))
    prefix = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * up[: len(part)], out=prefix[1:])
    return mix((prefix[j] - prefix[i]) * down[i] + (j - i).astype(np.uint64))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of chunks: a mixed polynomial for short ones, xxh3 for the others."""
    import xxhash

    out = np.zeros(len(starts), np.uint64)
    segment = starts // SEGMENT
    for s in np.unique(segment):
        own, at = np.flatnonzero(segment == s), int(s) * SEGMENT
        out[own] = _digests(data[at : at + SEGMENT], starts[own] - at, ends[own] - at)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def before(data: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """64-bit digests of the `size` bytes before each of the ends, all of which are `size` or more."""
    out = np.zeros(len(ends), np.uint64)
    segment = (ends - 1) // SEGMENT
    for s in np.unique(segment):
        own, at = np.flatnonzero(segment == s), max(0, int(s) * SEGMENT - size)
        j = ends[own] - at
        out[own] = _digests(data[at : int(s + 1) * SEGMENT], j - size, j)
    return out


def marks(texts: DataFrame, mean: int, least: int, size: int) -> DataFrame:
    """digest (of the `size` bytes before a cut), doc_id, t, at, gaps (bytes to the cuts before and
    after, in the upper and lower half) for each cut of each text; of cuts of one text with equal digests the first."""

    def run(batches):
        for b in batches:
            for r in range(0, b.num_rows, 128):
                part = b.slice(r, 128)
                data, offsets = text_buffer(part.column("text"))
                ids, own_t, h, at, gaps = [], [], [], [], []
                for i, (doc, t) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist())):
                    own = data[offsets[i] : offsets[i + 1]]
                    ends = cuts(own, mean, least)
                    gap = np.diff(ends, prepend=0, append=len(own)).astype(np.int64)
                    keep = ends >= size
                    ends, gap = ends[keep], ((gap[:-1] << 32) | gap[1:])[keep]
                    digest, first = np.unique(before(own, ends, size), return_index=True)
                    gaps.append(gap[first])
                    h.append(digest.view(np.int64)), at.append(ends[first].astype(np.int32))
                    ids.append(np.full(len(digest), doc, np.int64)), own_t.append(np.full(len(digest), t, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, ids, own_t, at, gaps)], ["digest", "doc_id", "t", "at", "gaps"])

    return texts.select("doc_id", "t", "text").mapInArrow(run, "digest long, doc_id long, t long, at int, gaps long")


RUNS = "doc_id long, t long, first_doc long, first_t long, shift int, start int, end int, back int, ahead int"


def _runs(size: int, least: int):
    """Marks of a text that one other text holds at one shift, and of which each covers bytes up to the
    one before: a run. back, ahead: how far it can go on, which is to the next cuts that are no marks,
    or enough for `least` bytes where they are marks of other documents."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, t, found in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("c")):
                at, first, first_t, first_at, gaps = (found.values.field(k).to_numpy() for k in ("at", "first_doc", "first_t", "first_at", "gaps"))
                shift = first_at - at
                order = np.lexsort((at, shift, first_t, first))
                at, first, first_t, shift, gaps = at[order], first[order], first_t[order], shift[order], gaps[order]
                same = (first[1:] == first[:-1]) & (first_t[1:] == first_t[:-1]) & (shift[1:] == shift[:-1]) & (np.diff(at) <= size)
                starts, ends = np.flatnonzero(np.append(True, ~same)[: len(at)]), np.flatnonzero(np.append(~same, True)[: len(at)])
                back, ahead = np.maximum(gaps[starts] >> 32, least - size), np.maximum(gaps[ends] & 0xFFFFFFFF, least - size)
                rows += zip([doc] * len(starts), [t] * len(starts), *(x[starts].tolist() for x in (first, first_t, shift, at)), at[ends].tolist(), back.tolist(), ahead.tolist())
            yield _batch(rows, RUNS)

    return run


CONTEXTS = "doc_id long, t long, at int, side int, body long, bytes binary"


def _contexts(size: int):
    """The bytes around the ends of runs: before and in a run's first mark (side 0), and after its last one (side 1)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, t, body, text, asked in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "body")), b.column("text"), b.column("c").to_pylist()):
                raw = text.as_py().encode()
                for a in asked:
                    at, side, reach = a["at"], a["side"], a["reach"]
                    piece = raw[max(0, at - size - reach) : at] if side == 0 else raw[at - PAD : _whole(raw, min(len(raw), at + reach))]
                    rows.append((doc, t, at, side, body, piece))
                if len(rows) > 4096:
                    yield _batch(rows, CONTEXTS)
                    rows = []
            yield _batch(rows, CONTEXTS)

    return run


def _batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    names, types = zip(*(k.split(" ") for k in kinds.split(", ")))
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(x), arrow[t]) for x, t in zip(columns, types)], list(names))


def _equal(a: bytes, b: bytes, back: bool = False) -> int:
    """How many bytes are equal from the start, or from the end with `back`."""
    n = min(len(a), len(b))
    if back:
        a, b = a[len(a) - n :][::-1], b[len(b) - n :][::-1]
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is equal, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


EDGES = "doc_id long, body long, first_doc long, first_t long, shift int, start int, end int, side int, edge int"


def _edges(size: int):
    """How far a run goes on in both texts, byte by byte, in whole characters. Runs whose first mark differs give nothing."""

    def run(batches):
        for b in batches:
            rows = []
            names = ("doc_id", "body", "first_doc", "first_t", "shift", "start", "end", "side", "bytes", "first_bytes")
            for *key, start, end, side, own, other in zip(*(b.column(c).to_pylist() for c in names)):
                n = _equal(own, other, back=side == 0)
                if n < (size if side == 0 else PAD):
                    continue
                if side == 0:
                    edge = start - len(own) + _whole(own, len(own) - n)
                else:
                    while n < len(own) and own[n] & 0xC0 == 0x80:
                        n -= 1
                    edge = end - PAD + n
                rows.append((*key, start, end, side, edge))
            yield _batch(rows, EDGES)

    return run


def _joined(stretches: list[tuple]) -> list[tuple]:
    """Sorted stretches (key, start, end), those that touch and share a key made one."""
    out: list[tuple] = []
    for key, start, end in stretches:
        if out and out[-1][0] == key and start <= out[-1][2]:
            out[-1] = (key, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((key, start, end))
    return out


def _spans(least: int):
    """Spans of runs that reach `least` bytes with one text at one shift."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, body, found in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), b.column("c").to_pylist()):
                edges = {(e["first_doc"], e["first_t"], e["shift"], e["start"], e["end"], e["side"]): e["edge"] for e in found}
                whole = sorted((k[:3], edge, edges[*k[:5], 1]) for k, edge in edges.items() if k[5] == 0 and (*k[:5], 1) in edges)
                long = [x for x in _joined(whole) if x[2] - x[1] >= least]
                spans = _joined(sorted((0, i, j) for _, i, j in long))
                if spans:
                    firsts = sorted({k[0] for k, _, _ in long})
                    rows.append((doc, body, len(spans), sum(j - i for _, i, j in spans), [i for _, i, _ in spans], [j for _, _, j in spans], firsts))
            yield _batch(rows, SPANS)

    return run


SPANS = "doc_id long, body long, n_spans int, repeated_bytes long, span_starts array<int>, span_ends array<int>, first_doc_ids array<long>"


def _texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, t, body, text of each text once. t tells apart the texts of ids that come more than once, and is 0 for the others."""
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("body"), "text")
    several = scratch.save(keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("many")), "ids")
    n = several.count()
    if not n:
        return keyed.select("doc_id", F.lit(0).cast("long").alias("t"), "body", "text")
    marked = keyed.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left")
    one = marked.where("many IS NULL").select("doc_id", F.lit(0).cast("long").alias("t"), "body", "text")
    return one.unionByName(marked.where("many").select("doc_id", F.col("body").alias("t"), "body", "text").dropDuplicates(["doc_id", "t"]))


def repeated_spans(docs: DataFrame, mean: int = MEAN_CHUNK, least_chunk: int = MIN_CHUNK, least_span: int = MIN_SPAN) -> DataFrame:
    """One row for each text with repeated passages: doc_id, body (hash of the text), n_spans,
    repeated_bytes, span_starts, span_ends (byte offsets in UTF-8), first_doc_ids (documents that
    keep them).

    Whole texts are chunked, very long ones too, a slice at a time. Repeats inside one document
    don't count. Rows without an id are left out, null and empty texts have no chunks. Rows that
    share an id are texts of one document (a passage in several of them is no repeat), each with
    its own spans; equal rows give one row. What several texts of the smallest document hold is
    compared with the one of the smallest hash. An empty table gives no rows. Other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _texts(docs.select("doc_id", "text"), scratch)
    size = min(least_span // 2, LONG_WORD)
    found = marks(texts, mean, least_chunk, size)
    holders = found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # Tables of digests are written first, so that joins are of two plain shuffles, which a digest that very many texts hold can be split in.
    repeated = scratch.save(holders.where("first_doc <> last_doc").drop("last_doc"), "digests")
    scratch.free_shuffles()
    hits = scratch.save(found.join(repeated, "digest"), "hits")
    scratch.drop(repeated)
    scratch.free_shuffles()
    first = hits.where("doc_id = first_doc").groupBy("digest").agg(F.min(F.struct("t", "at")).alias("f"))
    first = scratch.save(first.select("digest", F.col("f.t").alias("first_t"), F.col("f.at").alias("first_at")), "firsts")
    others = hits.where("doc_id <> first_doc").join(first, "digest")
    per_text = others.groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "first_doc", "first_t", "first_at", "gaps")).alias("c"))
    runs = scratch.save(per_text.mapInArrow(_runs(size, least_span), RUNS), "runs")
    scratch.drop(hits)
    scratch.drop(first)
    scratch.free_shuffles()

    sides = (F.struct(F.lit(i).alias("side"), F.col(at).alias("at"), F.col(reach).alias("reach")) for i, (at, reach) in enumerate((("start", "back"), ("end", "ahead"))))
    edges = runs.select("*", F.explode(F.array(*sides)).alias("e")).select(*runs.columns[:-2], "e.*", (F.col("e.at") + F.col("shift")).alias("first_at"))
    asked = edges.select("doc_id", "t", "at", "side", "reach").unionAll(edges.select("first_doc", "first_t", "first_at", "side", "reach"))
    asked = asked.groupBy("doc_id", "t", "at", "side").agg(F.max("reach").alias("reach"))
    per_text = asked.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("at", "side", "reach"))).alias("c"))
    contexts = scratch.save(texts.join(per_text, ["doc_id", "t"]).mapInArrow(_contexts(size), CONTEXTS), "contexts")
    scratch.free_shuffles()
    theirs = contexts.select(F.col("doc_id").alias("first_doc"), F.col("t").alias("first_t"), F.col("at").alias("first_at"), "side", F.col("bytes").alias("first_bytes"))
    with_own = edges.join(contexts, ["doc_id", "t", "at", "side"])
    compared = with_own.join(theirs, ["first_doc", "first_t", "first_at", "side"]).mapInArrow(_edges(size), EDGES)
    whole = F.collect_list(F.struct("first_doc", "first_t", "shift", "start", "end", "side", "edge"))
    return compared.groupBy("doc_id", "body").agg(whole.alias("c")).mapInArrow(_spans(least_span), SPANS)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with all columns, the spans cut out of `text`. Rows without an id, or without spans, stay as they are."""
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = []
            for text, starts, ends in zip(b.column("text"), b.column("_starts").to_pylist(), b.column("_ends").to_pylist()):
                raw = text.as_py()
                if raw is not None and starts:
                    raw, at, out = raw.encode(), 0, []
                    for s, e in zip(starts, ends):
                        out.append(raw[at:s])
                        at = max(at, e)
                    raw = b"".join([*out, raw[at:]]).decode()
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    extra = spans.select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), F.col("span_starts").alias("_starts"), F.col("span_ends").alias("_ends"))
    joined = docs.join(extra, (docs["doc_id"] == extra["_doc"]) & (F.xxhash64(docs["text"]) == extra["_body"]), "left").drop("_doc", "_body")
    return joined.mapInArrow(run, docs.schema)


def _whole(raw: bytes, at: int) -> int:
    """The next position that doesn't split a character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at
