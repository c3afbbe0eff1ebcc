"""Byte-level BPE by overlapping chunks.

Texts are cut into short windows that overlap. Each window is pre-tokenised on its own, from its
own left edge, and its pre-tokens are encoded one by one (their bytes are merged by a library,
which knows nothing of texts and windows). Two neighbours are stitched at the
first position of their overlap where both have a pre-token boundary: the pattern never looks
behind, so from there on both give the same pre-tokens, and no id depends on where windows lie.
Where no boundary resynchronises (a run longer than the overlap) the text is cut anew, into
windows and overlaps eight times as long. Decoding concatenates the tokens' raw bytes.

The windows of texts of over SPREAD code points are dealt out to many tasks and meet again as
ids; those of other texts stay in the task that has the text. The steps are the same.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW, OVERLAP = 512, 64  # code points
GROWTH, SPREAD = 8, 1 << 18
LOOK = 4  # more characters than the pattern looks at beyond a pre-token
CACHED, CACHED_CHARS = 1 << 16, 64  # pre-tokens whose ids a task keeps, and the longest of them


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


@lru_cache(maxsize=4)
def _pretokens(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of a text taken from its first character."""
    return [m.end() for m in _pretokens(pattern).finditer(text)]


@lru_cache(maxsize=4)
def _merger(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]", mergeable_ranks=load_ranks(path), special_tokens={})


def merge(piece: str, path: str) -> list[int]:
    """Ids of one pre-token: of all neighbours the pair of the lowest rank is joined, the leftmost first, until none has a rank."""
    return _merger(path)._encode_single_piece(piece)


class _Encoded(dict):
    """Pre-token to its ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def __missing__(self, piece: str) -> bytes:
        found = merge(piece, self.path)
        ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def _encoded(path: str) -> _Encoded:
    return _Encoded(path)


class Chunk(NamedTuple):
    """A window's ids, and where pre-tokens end in its overlaps: positions in the text, and the bytes of ids up to there."""

    head: list[int]
    head_at: list[int]
    tail: list[int]
    tail_at: list[int]
    ids: bytes


def windows_of(length: int, window: int, overlap: int) -> Iterator[tuple[int, int, bool]]:
    """Start, end, and whether it is the last, of each window; neighbours share `overlap` code points, at most half a window."""
    n = max(1, -(-(length - overlap) // (window - overlap)))
    for k in range(n):
        at = k * (window - overlap)
        yield at, min(length, at + window), k == n - 1


def encode_window(text: str, at: int, last: bool, overlap: int, path: str, pattern: str) -> Chunk:
    """Pre-tokenise and encode one window, which starts at `at` of its text.

    A boundary less than LOOK characters from a window's right edge may be none in the whole text.
    """
    found = _pretokens(pattern).findall(text)
    coded = list(map(_encoded(path).__getitem__, found))
    ids, end = b"".join(coded), at + len(text)
    head, head_at, pos, size = [at], [0], at, 0
    for piece, code in zip(found, coded):
        pos, size = pos + len(piece), size + len(code)
        if pos > at + overlap:
            break
        head.append(pos), head_at.append(size)
    tail, tail_at, pos, size = [], [], end, len(ids)
    for piece, code in zip(reversed(found), reversed(coded)):
        if last or pos < end - overlap:
            break
        if pos <= end - LOOK:
            tail.append(pos), tail_at.append(size)
        pos, size = pos - len(piece), size - len(code)
    return Chunk(head, head_at, tail, tail_at, ids)


def stitch(chunks: list[Chunk]) -> bytes | None:
    """The ids of a text from its windows' ids; None if two neighbours have no boundary in common."""
    parts, start = [], 0
    for one, other in zip(chunks, chunks[1:]):
        shared = set(one.tail) & set(other.head)
        if not shared:
            return None
        seam = min(shared)
        parts.append(one.ids[start : one.tail_at[one.tail.index(seam)]])
        start = other.head_at[other.head.index(seam)]
    return b"".join([*parts, chunks[-1].ids[start:]])


def encode_text(text: str, path: str, pattern: str, window: int = WINDOW, overlap: int = OVERLAP) -> bytes:
    """Ids of a text by windows; where two don't meet, by larger ones."""
    while True:
        ids = stitch([encode_window(text[at:end], at, last, overlap, path, pattern) for at, end, last in windows_of(len(text), window, overlap)])
        if ids is not None:
            return ids
        window, overlap = GROWTH * window, GROWTH * overlap


def decode(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(_tokens(path).__getitem__, ids.tolist()))


_ENCODED = "doc_id long, body long, n_chars long, ids binary"
_CHUNKS = "head array<long>, head_at array<long>, tail array<long>, tail_at array<long>, ids binary"
_KINDS = (pa.list_(pa.int64()),) * 4 + (pa.binary(),)


def encode(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """doc_id, body (hash of the text), n_chars and ids (little-endian unsigned 32-bit) for each row.

    Null text is empty text; it has no ids. Rows that share an id are encoded each; equal rows of
    very long texts (same id and text) are encoded once and returned as often as they came. Other
    columns are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.xxhash64("text").alias("body")

    def whole(batches, window=window, overlap=overlap):
        for b in batches:
            texts = b.column("text")
            ids = [encode_text(t.as_py(), path, pattern, window, overlap) for t in texts]
            lengths = pc.utf8_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("body"), lengths, pa.array(ids, pa.binary())], ["doc_id", "body", "n_chars", "ids"])

    def cut(batches):
        for b in batches:
            for doc, own, text in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), b.column("text")):
                text = text.as_py()
                rows = list(windows_of(len(text), window, overlap))
                for i in range(0, len(rows), 1024):
                    at, ends, last = zip(*rows[i : i + 1024])
                    n = len(at)
                    columns = [pa.array([doc] * n, pa.int64()), pa.array([own] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(last), pa.array([text[x:y] for x, y in zip(at, ends)], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "at", "last", "text"])

    def chunks(batches):
        for b in batches:
            made = [encode_window(t, at, last, overlap, path, pattern) for t, at, last in zip(*(b.column(c).to_pylist() for c in ("text", "at", "last")))]
            columns = [pa.array([c[i] for c in made], kind) for i, kind in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "body", "at")), *columns], ["doc_id", "body", "at", *Chunk._fields])

    def stitched(batches):
        for b in batches:
            ids = [stitch([Chunk(*(c[f] for f in Chunk._fields)) for c in own.as_py()]) for own in b.column("c")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("body"), pa.array(ids, pa.binary())], ["doc_id", "body", "ids"])

    one = docs.where(F.char_length("text") <= spread).select("doc_id", body, "text").mapInArrow(whole, _ENCODED)

    long = docs.where(F.char_length("text") > spread).groupBy("doc_id", body).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    windows = long.select("doc_id", "body", "text").mapInArrow(cut, "doc_id long, body long, at long, last boolean, text string")
    dealt = windows.repartition(F.xxhash64("doc_id", "body", "at")).mapInArrow(chunks, f"doc_id long, body long, at long, {_CHUNKS}")
    own = dealt.groupBy("doc_id", "body").agg(F.array_sort(F.collect_list(F.struct("at", *Chunk._fields))).alias("c"))
    met = own.mapInArrow(stitched, "doc_id long, body long, ids binary")

    def same(x: str, y: str):
        return [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in ("doc_id", "body")]

    larger = lambda batches: whole(batches, GROWTH * window, GROWTH * overlap)
    each = long.alias("x").join(met.alias("y"), same("x", "y")).select("x.*", "y.ids")
    good = each.where("ids IS NOT NULL").select("doc_id", "body", F.char_length("text").cast("long").alias("n_chars"), "ids", "copies")
    broken = each.where("ids IS NULL")
    again = broken.select("doc_id", "body", F.explode(F.array_repeat("text", F.col("copies").cast("int"))).alias("text")).mapInArrow(larger, _ENCODED)
    many = good.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "body", "n_chars", "ids")
    return one.unionByName(many).unionByName(again)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the ids alone."""

    def read(batches):
        for b in batches:
            rows = []
            for ids in b.column("ids"):
                raw = ids.as_py()
                back = decode(np.frombuffer(raw, "<u4"), path)
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(read, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
