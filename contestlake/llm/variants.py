"""Spelling variants: words within one edit of each other by a bit-sliced position index, grouped under their commonest form."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.functions.plan import durable
from contestlake.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters of a run, fewest code points of a word, fewest occurrences, divisor of the hash of runs that lose a letter.
LETTERS, SHORTEST, LEAST, LOSES = "a-zÀ-ÿ", 5, 3, 97
#: Different words that a task counts before it passes them on.
HELD_WORDS = 400_000
#: Words of a unit beyond which it is cut into pairs of blocks; rows a task; words and letters of one index, unless a unit has more.
UNIT_WORDS, TASK_WORDS, INDEX_WORDS, INDEX_LETTERS = 65_536, 100_000, 2_048, 1 << 18
#: Queries whose sets are advanced together.
QUERIES = 256


def words_of(text: str | None, doc_id: int | None) -> Counter:
    """How often each word of at least SHORTEST code points occurs in a text, with the letters that the hash deletes."""
    runs = Counter(re.findall(f"[{LETTERS}]{{{SHORTEST},}}", (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    head = zlib.crc32(("" if doc_id is None else f"{doc_id}").encode() + b":")
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), head)
        if h % LOSES == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        if len(run) >= SHORTEST:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """word, n: the words of all whole texts that occur at least ``least`` times overall."""
    def run(batches):
        held: Counter = Counter()

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in common.slices(batches):
            for t, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update(words_of(t, i))
                if len(held) > HELD_WORDS:
                    yield flushed()
        yield flushed()

    slim = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---- the index ----

def index(codes: list[np.ndarray]):
    """Bitsets over the words for each (position, letter) that occurs, an empty one behind them, and where each is."""
    n = len(codes)
    size = np.array([len(c) for c in codes])
    word = np.repeat(np.arange(n), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    key = place.astype(np.int64) << 21 | np.concatenate(codes).astype(np.int64)
    keys, row = np.unique(key, return_inverse=True)
    sets = np.zeros((len(keys) + 1, -(-n // 64)), np.uint64)
    np.bitwise_or.at(sets, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
    return sets, keys


def one_edit(codes: list[np.ndarray]):
    """Index pairs (i, j) of words of which the second differs from the first by one inserted, deleted or replaced letter.

    All words are asked at once, those of a length together.  After each letter of the asked words, ``exact`` has the
    words that agree so far, and the others those that agree but for one replaced letter, one more letter of the asked
    word (positions shifted back) or one letter less (shifted on).  Yields arrays.
    """
    sets, keys = index(codes)
    size = np.array([len(c) for c in codes])
    wide = sets.shape[1]

    def of_length(m):
        at = np.flatnonzero(size == m)
        out = np.zeros(wide, np.uint64)
        np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return out

    def rows(letters, place, shift):
        if place + shift < 0:
            return np.full(len(letters), len(keys))
        key = (place + shift) << 21 | letters
        at = np.searchsorted(keys, key)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == key, at, len(keys))

    for m in np.unique(size).tolist():
        same, shorter, longer = of_length(m), of_length(m - 1), of_length(m + 1)
        asked = np.flatnonzero(size == m)
        for start in range(0, len(asked), QUERIES):
            part = asked[start:start + QUERIES]
            letters = np.stack([codes[k] for k in part]).astype(np.int64)
            exact = np.full((len(part), wide), ~np.uint64(0))
            replaced, more, less = (np.zeros_like(exact) for _ in range(3))
            for i in range(m):
                here = sets[rows(letters[:, i], i, 0)]
                replaced = (replaced & here) | (exact & ~here)
                more = (more & sets[rows(letters[:, i], i, -1)]) | exact
                less = (less | exact) & sets[rows(letters[:, i], i, 1)]
                exact = exact & here
            found = (replaced & same) | (more & shorter) | ((less | exact) & longer)
            q, w = np.nonzero(found)
            bits = np.unpackbits(found[q, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, b = np.nonzero(bits)
            yield part[q[k]], w[k] * 64 + b


def near_pairs(words: list[str], unit: np.ndarray, smaller: np.ndarray, by_head: np.ndarray, block: np.ndarray, crossing: np.ndarray):
    """Index pairs of words of one edit, each once over all units that hold both.

    A pair belongs to the units of the smaller of its lengths; it counts in the unit of its first half if it has that in
    common, else in that of its second half.  Rows are sorted by unit.
    """
    codes = [common.code_points(w) for w in words]
    size = np.array([len(c) for c in codes])
    ends = np.r_[np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)].tolist()
    start, last, total = 0, 0, np.r_[0, np.cumsum(size)]
    cuts = []
    for end in ends:
        if last > start and (end - start > INDEX_WORDS or total[end] - total[start] > INDEX_LETTERS):
            cuts.append((start, last))
            start = last
        last = end
    cuts.append((start, last))
    for a, b in cuts:
        for i, j in one_edit(codes[a:b]):
            i, j = i + a, j + a
            ok = (unit[i] == unit[j]) & (np.minimum(size[i], size[j]) == smaller[i]) & (~crossing[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            half = smaller[i] // 2
            head = np.array([words[x][:h] == words[y][:h] for x, y, h in zip(i.tolist(), j.tolist(), half.tolist())], bool)
            tail = np.array([words[x][len(words[x]) - n:] == words[y][len(words[y]) - n:] for x, y, n in zip(i.tolist(), j.tolist(), (smaller[i] - half).tolist())], bool)
            ok = np.where(by_head[i], head, tail & ~head) if len(i) else np.zeros(0, bool)
            yield i[ok], j[ok]


def units(words: DataFrame) -> DataFrame:
    """Each word under the halves that a word of one edit can have in common with it.

    Of two words of one edit, the smaller of length c, the first c/2 (rounded down) or the last c - c/2 letters are equal.
    """
    size = F.length("word")
    by = F.transform(F.filter(F.array(size, size - 1), lambda c: c >= 1), lambda c: F.struct(c.alias("smaller"), F.floor(c / 2).cast("int").alias("half")))
    each = words.select("word", "n", F.explode(by).alias("c"))
    half, rest = F.col("c.half"), F.col("c.smaller") - F.col("c.half")
    sides = F.array(F.struct(F.lit(True).alias("by_head"), F.substr("word", F.lit(1), half).alias("piece")), F.struct(F.lit(False).alias("by_head"), F.substr("word", F.length("word") - rest + 1, rest).alias("piece")))
    out = each.select("word", "n", F.col("c.smaller").alias("smaller"), F.inline(sides))
    return out.select("word", "n", "smaller", "by_head", F.xxhash64("smaller", "by_head", "piece").alias("unit"))


def nearest(words: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: how many words of one edit each word has, and the one of largest n (ties: smallest).

    ``words`` has distinct words and n.  Words without any are left out.  Units of more than UNIT_WORDS words are cut into
    pairs of blocks, in which every two words still meet once.
    """
    rows = units(words)
    sizes = durable(rows.groupBy("unit").agg(F.count("*").alias("rows")).filter("rows > 1"))
    n_rows = sizes.agg(F.sum("rows")).first()[0] or 0
    blocks = F.ceil(F.col("rows") / (UNIT_WORDS // 2)).cast("int")
    dealt = rows.join(sizes.select("unit", F.when(F.col("rows") > UNIT_WORDS, blocks).otherwise(1).alias("blocks")), "unit")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other"))
    n_tasks = max(1, math.ceil(n_rows / TASK_WORDS))
    dealt = dealt.select(F.pmod(key, F.lit(n_tasks)).alias("task"), key.alias("unit"), "word", "n", "smaller", "by_head", "block", (F.col("block") != F.col("other")).alias("crossing"))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        # words of a length side by side make the sets of an index alike in length
        frame = frame.sort_values(["smaller", "unit"], kind="stable", ignore_index=True)
        words, n = frame["word"].tolist(), frame["n"].to_numpy()
        order = np.empty(len(words), np.int64)
        order[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in near_pairs(words, *(frame[c].to_numpy() for c in ("unit", "smaller", "by_head", "block", "crossing"))):
            first.append(i)
            second.append(j)
        i, j = np.concatenate(first), np.concatenate(second)
        by = np.lexsort((order[j], -n[j], i))
        i, j = i[by], j[by]
        head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        best = j[head]
        return pd.DataFrame({"word": [words[k] for k in i[head]], "n_near": np.diff(np.r_[head, len(i)]), "near": [words[k] for k in best], "near_n": n[best]})

    found = dealt.groupBy("task").applyInPandas(join, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that following forms leads to.

    A form is at least twice as frequent as its word, so that chains end.  Every round doubles the steps a word has gone;
    their number grows with the logarithm of a chain's length.
    """
    steps = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = durable(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not further.filter("moved").take(1):
            return further.select("word", "root")
        steps = further.select("word", "root")


def group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of all texts.

    A null text has no word; a null id counts as an empty one; repeated rows count each.  A word's form is its near word of
    largest n (ties: the smallest by code points) if that is at least twice the word's own n, else null.
    """
    words = durable(vocabulary(docs, text, doc_id, least))
    near = words.join(nearest(words), "word", "left")
    has = F.col("near_n") >= 2 * F.col("n")
    near = durable(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    last = roots(near.filter("form IS NOT NULL"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
