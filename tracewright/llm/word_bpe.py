"""BPE with word ends, by the last token of every prefix.

A pre-token's merging is never carried out. Each prefix of it has exactly one last token: of the
tokens that end there (an automaton over the vocabulary finds all that are suffixes of the
prefix) the one that may stand after the last token of what comes before it. Two tokens may
stand side by side if merging them together gives just the two. The last tokens are back-pointers:
followed from the end of the pre-token they give its ids. Time is linear in the pre-token's length.

Whether two tokens may be neighbours follows from when their parts live: a part is made by the
merge of one rank and taken up by that of another. A merge across the seam would happen if both
its parts are there at its rank.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

END = "\n"  # stands for the mark of a word's end; no byte is written like that
CACHED, CACHED_CHARS = 1 << 18, 64  # pre-tokens whose ids a task keeps (and as many put aside), and the longest of them
SLICE = 1 << 20  # code points of a text that are cut into pre-tokens at once
# Scripts in which normalising and cutting are the same in all versions of Unicode that libraries follow.
SETTLED = r"[\x00-՗‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]*"
NEVER = 1 << 40
TOKEN = 20  # bits of a token in a pair's number
PAIRS = 1 << 20  # pairs of tokens that a task keeps the answer for


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, and the two parts and the rank of the merge that makes each."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        pairs = [tuple(ids[x] for x in m) for m in model["merges"]]
        joined = [ids["".join(m)] for m in model["merges"]]
        if len(set(joined)) != len(joined):
            raise ValueError(f"{path}: a token is made by more than one merge")
        self.parts = dict(zip(joined, pairs))
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.made = {t: r for r, t in enumerate(joined)}
        if any(self.made.get(x, -1) >= r for r, p in enumerate(pairs) for x in p):
            raise ValueError(f"{path}: a merge comes before its parts")
        letters = byte_letters()
        written = {ids[x + e]: x + (END if e else "") for x in letters for e in ("", suffix)}
        for t, (a, b) in zip(joined, pairs):
            written[t] = written[a] + written[b]
        self.length = {t: len(w) for t, w in written.items()}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t in self._stable(written):
            self.automaton.add_word(written[t], (t, len(written[t])))
        self.automaton.make_automaton()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at a token's right (1) or left (0) edge, outermost first, each with the rank that takes it up."""
        kept = self._right if side else self._left
        out = kept.get(token)
        if out is None:
            out, x, until = [], token, NEVER
            while True:
                out.append((x, until))
                if x not in self.parts:
                    break
                until, x = self.made[x], self.parts[x][side]
            kept[token] = out
        return out

    def _meet(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank below `before` joins the right edge of a with the left edge of b.

        From the whole tokens backwards: what was made last comes apart first, so that only parts
        which are there at the same time are held against each other.
        """
        right, left, rank, made = self._edge(a, 1), self._edge(b, 0), self.rank, self.made
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            r = rank.get((x, y))
            if r is not None and r < before and r < x_until and r <= y_until:
                return True
            if i + 1 < len(right) and (j + 1 == len(left) or made[x] > made[y]):
                i += 1
            elif j + 1 < len(left):
                j += 1
            else:
                return False

    def _stable(self, tokens) -> set[int]:
        """Tokens that merging leaves whole when their own letters are all there is."""
        stable = {t for t in tokens if t not in self.parts}
        for t, (a, b) in sorted(self.parts.items(), key=lambda x: self.made[x[0]]):
            if a in stable and b in stable and not self._meet(a, b, self.made[t]):
                stable.add(t)
        return stable

    def beside(self, a: int, b: int) -> bool:
        """Whether b may follow a in the ids of a pre-token."""
        return not self._meet(a, b, NEVER)

    def last_tokens(self, letters: str) -> list[int]:
        """For each length of prefix the last token of its ids; -1 for none (the empty one)."""
        last, known = [-1] * (len(letters) + 1), self._known
        if len(known) > PAIRS:
            known.clear()
        for at, (token, length) in self.automaton.iter(letters):
            if last[at + 1] < 0:
                before = last[at + 1 - length]
                if before >= 0:
                    pair = before << TOKEN | token  # one number: a look-up is all that most pairs take
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = self.beside(before, token)
                    if not fits:
                        continue
                last[at + 1] = token
        return last

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        letters = piece.encode().decode("latin-1").translate(_LETTERS) + END
        last, at, out = self.last_tokens(letters), len(letters), []
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        return out[::-1]


_LETTERS = dict(enumerate(byte_letters()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Cutter:
    """Texts to pre-tokens: normalised and cut as the file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")")
        self.settled = regex.compile(SETTLED)
        kinds = {p: "".join(re.escape(chr(c)) for c in range(0x180) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}")}
        named = split["pattern"]["Regex"]
        for p, letters in kinds.items():
            named = named.replace(p, letters)
        self.latin, self.latin_pattern = re.compile(r"[\x00-\x1b\x20-\u017f]*"), re.compile(named)  # twice as fast
        self.bytes_of = {ord(c): chr(b) for b, c in _LETTERS.items()}

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens. Where all its letters are settled, white space
        need not be made one, as no pre-token holds any; lower case takes letters one by one."""
        if self.latin.fullmatch(text):
            return self.latin_pattern.findall(text.lower())
        if self.settled.fullmatch(text):
            return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [x.translate(self.bytes_of).encode("latin-1").decode() for x, _ in cut]

    def slices(self, text: str, size: int = SLICE) -> Iterator[str]:
        """A text in parts that end before a blank or a line's end, where no pre-token and no letter goes on."""
        at = 0
        while at < len(text):
            end = at + size
            while end < len(text) and text[end] not in " \n":
                end += 1
            yield text[at:end]
            at = end


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(path)


class _Encoded(dict):
    """Pre-tokens to ids, as little-endian unsigned 32-bit numbers. When it is full, its entries
    are put aside; those that come again are taken back, so that frequent ones stay."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.aside: dict[str, bytes] = {}

    def __missing__(self, x: str) -> bytes:
        ids = self.aside.get(x)
        if ids is None:
            ids = self.make(x)
        if len(x) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.aside = dict(self)
                self.clear()
            self[x] = ids
        return ids


@lru_cache(maxsize=2)
def _encoded(path: str) -> _Encoded:
    tokens = vocabulary(path)

    def piece(x: str) -> bytes:
        ids = tokens.encode(x)
        return pack(f"<{len(ids)}I", *ids)

    return _Encoded(piece)


def encode_text(text: str, path: str, size: int = SLICE) -> bytes:
    """Ids of a text: added tokens stand for themselves, what lies between is cut and encoded."""
    cut, ids, added, out = cutter(path), _encoded(path), vocabulary(path).added, []
    for part in cut.slices(text, size):
        for i, x in enumerate(cut.added.split(part) if "<" in part else (part,)):
            out.append(pack("<I", added[x]) if i % 2 else b"".join(map(ids.__getitem__, cut.pretokens(x))))
    return b"".join(out)


def decode(ids: np.ndarray, path: str) -> str:
    """Tokens as they are written in the vocabulary, with blanks between, as for a file without a decoder."""
    names = vocabulary(path).names
    return " ".join([names[i] for i in ids.tolist()])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) for each row.

    Null text is empty text; it has no ids. Each row is encoded on its own: repeated rows and rows
    that share an id or have none are all returned, without an order. Very long texts are taken in
    slices of about SLICE code points; a pre-token of any length takes time linear in its length.
    Other columns are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def whole(batches):
        for b in batches:
            ids = [encode_text(t.as_py(), path) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(whole, "doc_id long, ids binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from the ids alone."""

    def read(batches):
        for b in batches:
            n, own, back = [], [], []
            for x in b.column("ids"):
                raw = x.as_py()
                n.append(len(raw) // 4)
                own.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decode(np.frombuffer(raw, "<u4"), path).encode()).hexdigest())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(read, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
