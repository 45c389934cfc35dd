"""Byte-pair encoding: a queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from itertools import islice

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: the pattern that byte-level vocabularies split text with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space by the Unicode property; the regex module also counts the four information separators.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Pieces whose ids a task remembers at a time, and the longest such piece.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Tables:
    """What encoding needs of a vocabulary file: ids of bytes, merges by pair, bytes of ids, special strings."""

    def __init__(self, text: str):
        data = json.loads(text)
        vocab, letters = data["model"]["vocab"], byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.start = [vocab[letter] for letter in letters]
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = {i: bytes(byte_of[ch] for ch in token) for token, i in vocab.items()}
        self.strings.update({i: s.encode() for s, i in self.special.items()})


def merge(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := merges.get(symbols[i] << 32 | symbols[j])):
            heapq.heappush(queue, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, left, right, made = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # an entry for symbols that have been merged away since
        symbols[i], symbols[j], after[i] = made, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s >= 0]


class Pieces(dict):
    """Packed ids of a piece of text; computed when missing, remembered within a bound."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def __missing__(self, piece: str) -> bytes:
        start = self.tables.start
        ids = array("I", merge([start[b] for b in piece.encode()], self.tables.merges)).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, tables: Tables):
        self.tables, self.pieces = tables, Pieces(tables)
        self.split = regex.compile(PATTERN.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        marks = sorted(tables.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def encode(self, text: str) -> bytes:
        """Ids as packed unsigned 32-bit integers."""
        out, get = [], self.pieces.__getitem__
        parts = self.marks.split(text) if self.marks and self.marks.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(array("I", [self.tables.special[part]]).tobytes())
            elif len(part) < 1 << 20:
                out.append(b"".join(map(get, self.split.findall(part))))
            else:
                found = self.split.finditer(part)
                while chunk := [m[0] for m in islice(found, 100_000)]:
                    out.append(b"".join(map(get, chunk)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tables.strings.__getitem__, ids)).decode("utf-8", "replace")


def codec_of(tables: Tables) -> Codec:
    """The codec of a task's tables; pieces are remembered from task to task of a worker."""
    if not hasattr(tables, "codec"):
        tables.codec = Codec(tables)
    return tables.codec


def load(path: str) -> Tables:
    """The vocabulary file is read on the driver; its size is that of a vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        return Tables(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit, packed) of every whole text, and on demand the text decoded from them.

    A null text counts as empty and has no ids; a special string becomes its own id; repeated rows are
    encoded each; other columns pass through unless ``keep`` names fewer.  No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = f"{ids} binary" + (f", {decoded} string" if decoded else "")

    def make(batch):
        codec = codec_of(shared.value)
        packed = [codec.encode(t or "") for t in batch.column(0).to_pylist()]
        out = [pa.array(packed, pa.binary())]
        return out + [pa.array([codec.decode(p) for p in packed], pa.string())] if decoded else out

    return common.append(docs, [text], schema, make, keep)


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded text never leave the task."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def make(batch):
        codec, rows = codec_of(shared.value), []
        for t in batch.column(0).to_pylist():
            packed = codec.encode(t or "")
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(packed).encode()).hexdigest()))
        n, a, b = zip(*rows) if rows else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.append(slim, ["text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", make, ["doc_id"])
