"""Secrets in texts: base patterns, and random strings found by how few characters a token of theirs covers."""

from __future__ import annotations

import base64
import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base patterns and the fewest characters of a match (of the second group of ``assign``).
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: The kind of what the token test adds.
RANDOM = "random"
#: Runs that may be random strings, their fewest characters, and the most characters a token of a random string covers on average.
RUN, SHORTEST, PER_TOKEN = "A-Za-z0-9+/_=-", 20, 2.0
#: Known digests and identifiers: hexadecimal digests by their lengths, UUIDs, dates and numbers, labelled digests, embedded data, names of files and pages.
DIGEST_SIZES = (32, 40, 48, 56, 64, 96, 128)
KNOWN = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|(?:sha(?:1|224|256|384|512)|md5|crc32|blake2[bs]?)[-_=].*"
BEFORE = r"(?:sha-?(?:1|224|256|384|512)|md5|crc32|blake2[bs]?|uuid|guid|isbn|doi|etag|commit|digest|checksum)[\"']?[\x20:=]{0,3}[\"']?$|;base64,$"
LOOK_BACK = 24

_encoding: dict[str, object] = {}


def compiled():
    """The patterns; letters of names match in either case, ASCII only."""
    return (re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile("AKIA[A-Z0-9]+"), re.compile("(?<![0-9a-f])[0-9a-f]{32,}"), re.compile(rf"(?<![{RUN}])[{RUN}]{{{SHORTEST},}}"),
            re.compile(KNOWN), re.compile(BEFORE, re.ASCII | re.IGNORECASE))


def base_spans(text: str, patterns=None) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, leftmost and non-overlapping per kind; those that are too short are dropped."""
    assign, access, hexes = (patterns or compiled())[:3]
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [("access", m.start(), m.end()) for m in access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in hexes.finditer(text)]
    return ordered(out)


def ordered(spans):
    kinds = (*KINDS, RANDOM)
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def known(run: str, before: str, patterns) -> bool:
    """Whether a run is a digest or an identifier by its form or by what stands before it, or cannot be a secret."""
    letters = sum(c.isalpha() for c in run)
    if not letters or letters == len(run):
        return True
    if len(run) in DIGEST_SIZES and re.fullmatch("[0-9a-fA-F]+", run):
        return True
    return bool(patterns[4].fullmatch(run) or patterns[5].search(before))


def random_spans(text: str, encode, taken, per_token: float = PER_TOKEN, patterns=None) -> list[tuple[str, int, int, float]]:
    """Runs without a known form that a tokenizer covers with at most ``per_token`` characters a token, beside what is ``taken``."""
    patterns = patterns or compiled()
    out = []
    for m in patterns[3].finditer(text):
        a, b = m.span()
        if any(a < y and x < b for _, x, y in taken) or known(m.group(), text[max(0, a - LOOK_BACK):a], patterns):
            continue
        ratio = len(m.group()) / len(encode(m.group()))
        if ratio <= per_token:
            out.append((RANDOM, a, b, ratio))
    return out


def encoder(data: bytes, pattern: str):
    """The tokenizer of a rank file, built once in a process."""
    mark = hashlib.sha256(data).hexdigest()
    if mark not in _encoding:
        import tiktoken
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        _encoding[mark] = tiktoken.Encoding(mark, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoding[mark].encode_ordinary


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,per_token:double>>"


def located(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "found", keep: list[str] | None = None, per_token: float = PER_TOKEN) -> DataFrame:
    """The kept columns and the secrets of each whole text, by start, then kind; a null text has none.

    ``vocabulary`` is a file of token ranks (read by the driver, sent to the executors once), ``pattern`` how it splits text.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = ("kind", "start", "end", "base", "per_token")

    def make(batch):
        patterns, encode, rows = compiled(), encoder(shared.value, pattern), []
        for t in batch.column(0).to_pylist():
            base = base_spans(t, patterns) if t else []
            more = {s[:3]: s[3] for s in random_spans(t, encode, base, per_token, patterns)} if t else {}
            rows.append([dict(zip(fields, (*s, s not in more, more.get(s)))) for s in ordered([*base, *more])])
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("per_token", pa.float64())]))
        return [pa.array(rows, kinds)]

    if out in (docs.columns if keep is None else keep):
        raise ValueError(f"a column {out} is there already; name another by out")
    return common.append(docs, [text], f"{out} {SPANS}", make, keep)


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans for every row, repeated ids and null texts included."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = located(slim, vocabulary, pattern, keep=["doc_id"])
    base = F.filter("found", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with each secret replaced by its kind in angle brackets; overlapping ones together, under the first's kind."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    read = located(rows, vocabulary, pattern)

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    new = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    new = F.when(F.size("found") > 0, new).otherwise(F.col("text"))
    return read.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names])
