"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie within a Hamming budget."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.functions.plan import durable
from contestlake.llm import common, components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a trie unit beyond which the unit is split by the next bits of the trie, and rows per task.
UNIT_ROWS = 4_000
#: Trie levels that one split goes down.
SPLIT_BITS = 5
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 13
#: Similarity: words of 64 bits of a long fingerprint, and how many of them decide.  Two texts are compared if they are
#: within KEY_BUDGET bits on a key of KEY_BITS; the keys start at KEY_STARTS of each word.  They are candidates if the deciding
#: words differ in at most as many bits as texts of the wanted similarity do on average, plus MARGIN standard deviations.
WORDS, DECIDING, KEY_BITS, KEY_BUDGET, KEY_STARTS, MARGIN = 6, 3, 24, 3, (0, 32), 4.0
#: The same bounds as above for units of keys; KEY_SPLIT divides what a band leaves of a key.  A split writes a row once for
#: each node that it meets, so a unit that its next CHILD_BITS deal out evenly is left whole: only a child of more than
#: KEY_UNIT_ROWS rows makes it large.
KEY_UNIT_ROWS, KEY_SPLIT, CHILD_BITS = 16_000, 3, 4
#: Pairs of nodes that a step down the trie may make at most before it is taken in halves.
STEP_PAIRS = 16_000_000
#: Shingles up to which sets also meet by their first shingles, as their fingerprints say too little; candidates of a class
#: in a task beyond which its pairs with classes of as many are compared group by group; pairs held before they are thinned.
FEW_SHINGLES, BUSY, HELD_PAIRS = 40, 6, 2_000_000
#: Shingles of a block of connected classes; a task compares two blocks.
DENSE_SHINGLES = 1_000_000
#: Shingles in common, one after the other, that a unit of small sets is split by at most before it is cut into blocks.
SHINGLE_LEVELS = 3


def fingerprints(text: str | None, width: int = 3, words: int = 1) -> list[int]:
    """``words`` x 64 bits; a bit is set if over half of the shingles' hashes have it.  No words: zero.

    The first 64 bits are those of the hash itself, the others those of the hash mixed anew.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return [0] * words
    width = min(width, len(parts))
    line = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[width - 1:].tolist()
    total, digest = np.zeros(64 * words, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(stops), CHUNK):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK])], np.uint64)
        total += ones(np.concatenate([hashes[:, None], mixed(hashes, words - 1)], axis=1) if words > 1 else hashes[:, None])
    return np.packbits(total * 2 > len(stops)).view(">u8").tolist()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; the shingles are those of ``fingerprints``."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width, digest = min(width, len(parts)), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[k:k + width]), 42) for k in range(len(parts) - width + 1)] if parts else [], np.uint64))


def set_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """The long fingerprint of a set of shingles, each counted once."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK]
        total += ones(np.concatenate([part[:, None], mixed(part, words - 1)], axis=1))
    return np.packbits(total * 2 > len(hashes)).view(">u8").astype(np.uint64)


def leading(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The hashes of a small set, ascending, whose first ones are its units; none of a large set."""
    return hashes if len(hashes) <= FEW_SHINGLES / similarity else hashes[:0]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The first 64 bits of the fingerprint."""
    return fingerprints(text, width)[0]


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` further hashes of each: the hash and a salt, through the finaliser of SplitMix64."""
    x = hashes[:, None] ^ (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ones(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit, most significant first."""
    bits = np.unpackbits(rows.astype(">u8").view(np.uint8), axis=1)
    whole = len(bits) // 255 * 255  # so many ones fit a byte: eight columns are added at once
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        eights = bits[:whole].view(np.uint64).reshape(-1, 255, bits.shape[1] // 8).sum(axis=1)
        total += eights.view(np.uint8).sum(axis=0, dtype=np.int64)
    return total


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint_bits", keep: list[str] | None = None, width: int = 3) -> DataFrame:
    """Each row with its fingerprint as a signed long."""
    def make(batch):
        return [pa.array([signed(fingerprint(t, width)) for t in batch.column(0).to_pylist()], pa.int64())]

    return common.append(docs, [text], f"{out} long", make, keep)


def with_sets(docs: DataFrame, text: str, keep: list[str], width: int, similarity: float) -> DataFrame:
    """The kept columns, a hash of the set of shingles, its long fingerprint, the set itself if it is small."""
    def make(batch):
        sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
        lists = pa.list_(pa.int64())
        return [pa.array([signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets], pa.int64()), pa.array([set_words(s, WORDS).view(np.int64) for s in sets], lists),
                pa.array([leading(s, similarity).view(np.int64) for s in sets], lists)]

    return common.append(docs, [text], "fingerprint_bits long, words array<long>, leading array<long>", make, keep)


def with_shingles(docs: DataFrame, text: str, keep: list[str], width: int) -> DataFrame:
    """The kept columns and the set of shingles."""
    def make(batch):
        return [pa.array([shingles(t, width).view(np.int64) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))]

    return common.append(docs, [text], "shingles array<long>", make, keep)


def close_pairs(unit: np.ndarray, side: np.ndarray, bits: np.ndarray, within: int, depth: int = 8):
    """Index pairs of rows of one unit whose bits differ in at most ``within`` places.

    The rows are a forest with one trie per (unit, side).  Pairs of nodes go down together, eight
    levels at a time; a pair of nodes is dropped as soon as its differing bits exceed the budget.
    Side 0 meets side 1 in a unit that has both, else side 0 meets itself.  Only the first ``depth`` bytes
    of the bits count; rows that have them in common are a leaf.
    Yields arrays (i, j), in pieces of bounded size.
    """
    order = np.lexsort((bits, side, unit))
    u, s, b = unit[order], side[order], bits[order]
    n = len(order)
    if not n:
        return
    pop = np.array([bin(x).count("1") for x in range(256)], np.int8)
    head = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (s[1:] != s[:-1])])
    tail = np.r_[head[1:], n]
    first = np.r_[True, u[head[1:]] != u[head[:-1]]] if len(head) > 1 else np.array([True])
    both = np.r_[~first[1:], False]
    lone = first & ~both & (s[head] == 0)
    pairs = [(head[lone], tail[lone], head[lone], tail[lone], np.full(lone.sum(), within), 0)]
    x = np.flatnonzero(both & first)
    if len(x):
        pairs.append((head[x], tail[x], head[x + 1], tail[x + 1], np.full(len(x), within), 0))
    while pairs:
        a0, a1, b0, b1, left, level = pairs.pop()
        if not len(a0):
            continue
        if level == depth:
            for i, j in crossed(a0, a1, b0, b1):
                yield order[i], order[j]
            continue
        wide = np.minimum(a1 - a0, 256) * np.minimum(b1 - b0, 256)
        if len(a0) > 50_000 or len(a0) > 1 and max(int(wide.sum()), int((a1 - a0 + b1 - b0).sum())) > STEP_PAIRS:
            half = len(a0) // 2
            pairs.append((a0[:half], a1[:half], b0[:half], b1[:half], left[:half], level))
            pairs.append((a0[half:], a1[half:], b0[half:], b1[half:], left[half:], level))
            continue
        digit = (b >> np.uint64(56 - 8 * level)).astype(np.uint8)
        cut = np.r_[True, digit[1:] != digit[:-1]]  # within a node equal digits are neighbours

        def children(lo, hi):
            """Start, end and digit of the children of each node, and whose they are."""
            size = hi - lo
            owner = np.repeat(np.arange(len(lo)), size)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
            new = cut[at] | (at == lo[owner])
            start, owner = at[new], owner[new]
            nxt = np.r_[start[1:], 0]
            end = np.where(np.r_[owner[1:] == owner[:-1], False], nxt, hi[owner]) if len(start) else start
            return start, end, digit[start], owner

        ca, ea, da, oa = children(a0, a1)
        cb, eb, db, ob = children(b0, b1)
        count_b = np.bincount(ob, minlength=len(b0))
        begin_b = np.cumsum(count_b) - count_b
        times = count_b[oa]
        for part in np.array_split(np.arange(len(ca)), max(1, int(times.sum()) // 4_000_000 + 1)):
            t = times[part]
            i = np.repeat(part, t)
            j = np.arange(len(i)) - np.repeat(np.cumsum(t) - t, t) + begin_b[oa[i]]
            rest = left[oa[i]] - pop[da[i] ^ db[j]]
            same = (a0 == b0)[oa[i]]
            ok = (rest >= 0) & (~same | (ca[i] <= cb[j]))
            i, j, rest = i[ok], j[ok], rest[ok]
            pairs.append((ca[i], ea[i], cb[j], eb[j], rest, level + 1))


def crossed(a0, a1, b0, b1, most: int = 500_000):
    """Pairs of places from each pair of ranges, a range that meets itself giving each pair once."""
    wide = b1 - b0
    end = np.cumsum((a1 - a0) * wide)
    for at in range(0, int(end[-1]) if len(end) else 0, most):
        flat = np.arange(at, min(at + most, int(end[-1])))
        pair = np.searchsorted(end, flat, "right")
        flat -= (end - (a1 - a0) * wide)[pair]
        i, j = a0[pair] + flat // wide[pair], b0[pair] + flat % wide[pair]
        keep = (a0[pair] != b0[pair]) | (i < j)
        yield i[keep], j[keep]


def smallest_reach(n: int, pairs) -> np.ndarray:
    """Smallest index that each index reaches over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            if (low == label[i]).all() and (low == label[j]).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while True:
                jump = label[label]
                if (jump == label).all():
                    break
                label = jump
    return label


def links(classes: DataFrame, bits: str, rep: str, within: int = 2) -> DataFrame:
    """Links (a, b), a > b, whose components are those of all pairs of classes within the budget.

    ``classes`` has distinct fingerprints and a distinct id each.  Two fingerprints within k bits agree on
    one of k+1 bands of bits, so every band value is the root of one unit of the join.  A unit of more than
    UNIT_ROWS rows is split into units of node pairs, SPLIT_BITS levels further down its trie, with what is
    left of the budget, as often as needed.  A unit that fits returns a spanning forest of its links.
    """
    cuts = [64 * i // (within + 1) for i in range(within + 2)]
    rows = classes.select(F.col(bits).alias("bits"), F.col(rep).alias("rep"))

    def band(i):
        lo, width = cuts[i], cuts[i + 1] - cuts[i]
        value = F.shiftrightunsigned(F.shiftleft("bits", lo), 64 - width)
        # the band's own bits lead, the others follow, so that a split always meets new bits
        turned = F.shiftleft("bits", lo).bitwiseOR(F.shiftrightunsigned("bits", 64 - lo)) if lo else F.col("bits")
        return F.struct(F.xxhash64(F.lit(i), value).alias("unit"), turned.alias("turned"), F.lit(width).alias("used"))

    units = (rows.select("bits", "rep", F.inline(F.array(*[band(i) for i in range(within + 1)])))
             .withColumns({"side": F.lit(0), "crossing": F.lit(False), "budget": F.lit(within)}))
    ready = None
    while True:
        size = durable(units.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("n0"), F.max("crossing").alias("x"))
                       .filter("IF(x, n0 > 0 AND n0 < n, n > 1)"))
        fits = units.join(size.filter(F.col("n") <= UNIT_ROWS).select("unit"), "unit")
        ready = fits if ready is None else ready.unionByName(fits)
        large = size.filter(F.col("n") > UNIT_ROWS).select("unit")
        if not large.take(1):
            break
        units = durable(split(units.join(large, "unit"), SPLIT_BITS, ["bits", "rep"]))
    ready = ready.select("unit", "side", "bits", "rep")
    n_tasks = max(1, math.ceil(ready.count() / (UNIT_ROWS * 4)))
    dealt = ready.withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(n_tasks)))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", kind="stable", ignore_index=True)
        rep = frame["rep"].to_numpy()
        _, unit = np.unique(frame["unit"].to_numpy(), return_inverse=True)
        found = close_pairs(unit, frame["side"].to_numpy(), frame["bits"].to_numpy().view(np.uint64), within)
        low = smallest_reach(len(rep), found)
        out = pd.DataFrame({"a": rep, "b": rep[low]})
        return out[out["a"] != out["b"]].drop_duplicates()

    return dealt.groupBy("task").applyInPandas(join, "a long, b long")


def split(units: DataFrame, n_bits: int, keep: list[str]) -> DataFrame:
    """Rows of the units of node pairs ``n_bits`` levels down; pairs beyond the budget never come to be."""
    masks = [F.struct(F.lit(m).alias("m"), F.lit(bin(m).count("1")).alias("cost")) for m in range(1 << n_bits)]
    made = units.withColumn("digit", F.expr(f"CAST(shiftrightunsigned(turned, 64 - used - {n_bits}) & {(1 << n_bits) - 1} AS INT)")).select(
        "*", F.explode(F.filter(F.array(*masks), lambda x: x["cost"] <= F.col("budget"))).alias("x"))
    other = F.col("digit").bitwiseXOR(F.col("x.m"))
    first = F.when(F.col("crossing"), F.col("side") == 0).otherwise(F.col("digit") <= other)
    low, high = F.when(first, F.col("digit")).otherwise(other), F.when(first, other).otherwise(F.col("digit"))
    return made.select(*keep, F.xxhash64("unit", low, high).alias("unit"), "turned", (F.col("used") + n_bits).alias("used"),
                       F.when(first, 0).otherwise(1).alias("side"), (F.col("crossing") | (F.col("x.m") > 0)).alias("crossing"),
                       (F.col("budget") - F.col("x.cost")).alias("budget"))


def most_differing(similarity: float) -> int:
    """Bits of the deciding words in which texts of this Jaccard similarity differ, with the margin."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * DECIDING
    return math.floor(n * share + MARGIN * math.sqrt(n * share * (1 - share)))


def key_units(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of long fingerprints, the unit and the turned bits of every band of every key.

    The band leads its key, and the bits behind the key follow it, so that a split always meets new bits.
    """
    half, bands = KEY_BITS // (KEY_BUDGET + 1), KEY_BUDGET + 1
    top = np.uint64((1 << KEY_BITS) - 1) << np.uint64(64 - KEY_BITS)

    def rolled(x, by, bits=64):
        return x << np.uint64(by) | x >> np.uint64(bits - by) if by else x

    unit, turned = [], []
    for k, start in ((k, start) for k in range(WORDS) for start in KEY_STARTS):
        word = rolled(words[:, k], start)
        key, rest = word & top, word & ~top
        for i in range(bands):
            led = rolled(key, i * half, KEY_BITS) & top
            value = led >> np.uint64(64 - half)
            unit.append(((k * len(KEY_STARTS) + KEY_STARTS.index(start)) * bands + i << half) + value.astype(np.int64))
            turned.append((led | rest).view(np.int64))
    return np.stack(unit, 1), np.stack(turned, 1)


def _held(classes: DataFrame) -> list[str]:
    return ["node", *(["root"] if "root" in classes.columns else []), *[f"w{k}" for k in range(DECIDING)]]


def with_key_units(classes: DataFrame) -> DataFrame:
    """A row for every key band of every class, made by Arrow batch: what is held of the class, unit, turned."""
    held = _held(classes)
    source = classes.select(F.col("bits").alias("node"), *held[1:-DECIDING], "words")
    n = len(held) - DECIDING

    def run(batches):
        for batch in common.slices(batches, 4096):
            words = batch.column(n).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            unit, turned = key_units(words)
            times = unit.shape[1]
            ids = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), times)) for c in batch.columns[:n]]
            heads = [pa.array(np.repeat(words[:, k].view(np.int64), times)) for k in range(DECIDING)]
            yield pa.RecordBatch.from_arrays([*ids, *heads, pa.array(unit.ravel()), pa.array(turned.ravel())], [*held, "unit", "turned"])

    return source.mapInArrow(run, ", ".join(f"{c} long" for c in [*held, "unit", "turned"]))


_UNIT = ["unit", "turned", "used", "side", "crossing", "budget"]


def in_blocks(units: DataFrame, sizes: DataFrame, held: list[str]) -> DataFrame:
    """Units that nothing divides, as units of two blocks of their rows each; every two rows still meet."""
    n = F.ceil(F.col("n") / (KEY_UNIT_ROWS // 2)).cast("int")
    dealt = units.join(sizes.select("unit", n.alias("blocks")), "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other"))
    turned_over = ~F.col("crossing") & (F.col("block") > F.col("other"))
    return met.select(*held, pair.alias("unit"), "turned", "used", F.when(turned_over, 1).otherwise(F.col("side")).alias("side"),
                      (F.col("crossing") | (F.col("block") != F.col("other"))).alias("crossing"), "budget")


def _fitting(units: DataFrame, held: list[str], divide, may_divide) -> tuple[DataFrame, int]:
    """The units cut until none has a child of more than KEY_UNIT_ROWS rows, and how many rows they have.

    A unit without bits to deal it out, as one of a shingle, is its only child.  ``divide`` gives finer units of the large ones that ``may_divide`` (a condition on n and the largest ``used``); the
    others are cut into pairs of blocks.
    """
    ready, n_rows = None, 0
    while True:
        child = F.expr(f"shiftrightunsigned(turned, greatest(0, 64 - used - {CHILD_BITS})) & {(1 << CHILD_BITS) - 1}")
        size = durable(units.groupBy("unit", child.alias("child")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("n0"), F.max("crossing").alias("x"), F.max("used").alias("u"))
                       .groupBy("unit").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.max("x").alias("x"), F.max("u").alias("u"), F.max("n").alias("most"))
                       .filter("IF(x, n0 > 0 AND n0 < n, n > 1)"))
        over = F.col("most") > KEY_UNIT_ROWS
        told = {r["kind"]: r["rows"] for r in size.groupBy(F.when(~over, 0).when(may_divide, 1).otherwise(2).alias("kind")).agg(F.sum("n").alias("rows")).collect()}
        n_rows += sum(told.values())
        # units of one row do no harm; they are left out only where the units are joined anyway
        fits = units.join(size.filter(~over).select("unit"), "unit") if ready is not None or len(told) > 1 or 0 not in told else units
        parts = [fits.select(*held, *_UNIT)]
        if 2 in told:
            parts.append(in_blocks(units, size.filter(over & ~may_divide), held).select(*held, *_UNIT))
        for part in parts:
            ready = part if ready is None else ready.unionByName(part)
        if 1 not in told:
            return ready, n_rows
        units = durable(divide(units.join(size.filter(over & may_divide).select("unit"), "unit")))


def _dealt(classes: DataFrame, similarity: float) -> DataFrame:
    """Units of the classes by their keys and first shingles, dealt to tasks.

    Keys of a band in common are a unit, as in ``links``; a unit with too many rows in one place is split down the key and then down the
    bits that follow it, where any difference may occur.  A shingle among the first of small sets is a unit as well; one of
    too many rows is split by the next shingle that two sets have in common: sets of the similarity or more have ``level``
    of their first n - ceil(similarity * n) + level in common.
    """
    held = _held(classes)
    keys = with_key_units(classes).withColumns({"used": F.lit(KEY_BITS // (KEY_BUDGET + 1)), "side": F.lit(0), "crossing": F.lit(False), "budget": F.lit(KEY_BUDGET)})

    def deeper(units):
        free = F.when(F.col("used") >= KEY_BITS, 64).otherwise(F.col("budget"))
        return split(units.withColumn("budget", free), KEY_SPLIT, held)

    ready, n_rows = _fitting(keys, held, deeper, F.col("u") + KEY_SPLIT <= 64)
    if "leading" in classes.columns:
        whole = {"turned": F.lit(0).cast("long"), "side": F.lit(0), "crossing": F.lit(False), "budget": F.lit(KEY_BUDGET)}
        small = classes.filter(F.size("leading") > 0)
        spare = F.size("leading") - F.ceil(similarity * F.size("leading") - 1e-9).cast("int")
        rows = small.select(F.col("bits").alias("node"), *held[1:-DECIDING], *[F.get("words", F.lit(k)).alias(f"w{k}") for k in range(DECIDING)],
                            F.posexplode(F.slice("leading", 1, spare + 1)).alias("at", "shingle"))
        first = rows.select(*held, F.xxhash64(F.lit("shingle"), "shingle").alias("unit"), "at").withColumns(whole)
        # ``used`` counts the levels from 64 on, which marks the unit as one that is compared whole
        first = first.withColumn("used", F.lit(65))

        def next_shingle(units):
            sets = small.select(F.col("bits").alias("node"), "leading", spare.alias("spare"))
            level = F.col("used") - 64
            found = units.join(sets, "node").select("*", F.posexplode(F.slice("leading", F.col("at") + 2, F.greatest(F.lit(0), F.col("spare") + level - F.col("at")))).alias("more", "shingle"))
            return found.select(*held, F.xxhash64("unit", "shingle").alias("unit"), (F.col("at") + F.col("more") + 1).alias("at"), (F.col("used") + 1).alias("used")).withColumns(whole)

        by_shingle, n_small = _fitting(first, [*held, "at"], next_shingle, F.col("u") < 64 + SHINGLE_LEVELS)
        ready, n_rows = ready.unionByName(by_shingle.drop("at")), n_rows + n_small
    n_tasks = max(1, math.ceil(n_rows / KEY_UNIT_ROWS))
    return ready.select("unit", "side", "turned", (F.col("used") >= 64).alias("whole"), *held).withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(n_tasks)))


def _met(frame: pd.DataFrame, code: np.ndarray, limit: int):
    """Arrays (a, b, bits that differ) of codes of different classes that meet in a unit and may be similar."""
    words = frame[[f"w{k}" for k in range(DECIDING)]].to_numpy().view(np.uint64)
    root, whole = frame["root" if "root" in frame else "node"].to_numpy(), frame["whole"].to_numpy()
    _, unit = np.unique(frame["unit"].to_numpy(), return_inverse=True)
    for i, j in close_pairs(unit, frame["side"].to_numpy(), frame["turned"].to_numpy().view(np.uint64), KEY_BUDGET, KEY_BITS // 8):
        i, j = (x[root[i] != root[j]] for x in (i, j))
        differ = np.bitwise_count(words[i] ^ words[j]).sum(axis=1)
        fine = whole[i] | (differ <= limit)
        yield code[i[fine]], code[j[fine]], differ[fine].astype(np.int64)


def similar_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), a > b, whose components are those of the candidate pairs of classes.

    ``classes`` has distinct ``bits`` and ``words``, a long fingerprint each.  Texts of a lower similarity differ in more
    bits than a trie of whole fingerprints can allow for.  So the tries hold short keys from many places of the long
    fingerprint; two texts within the budget of any key meet and are candidates by what they differ in on the deciding words.
    """
    limit = most_differing(similarity)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        node, code = np.unique(frame["node"].to_numpy(), return_inverse=True)
        low = smallest_reach(len(node), ((a, b) for a, b, _ in _met(frame, code, limit)))
        out = pd.DataFrame({"a": node, "b": node[low]})
        return out[out["a"] != out["b"]]

    return _dealt(classes, similarity).groupBy("task").applyInPandas(join, "a long, b long")


def candidates(classes: DataFrame, similarity: float, most: int | None) -> DataFrame:
    """Candidate pairs (a, b, held), a > b, of classes.

    Pairs whose classes both have more than ``most`` candidates in a task are held back: of these only links (held) appear
    that reach from each class to the smallest one that it reaches over them.
    """
    limit = most_differing(similarity)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        node, code = np.unique(frame["node"].to_numpy(), return_inverse=True)
        n = len(node)
        degree, low = np.zeros(n, np.int64), np.arange(n)
        kept, fresh, size = np.zeros(0, np.int64), [], 0

        def thinned():
            """The pairs that stay; the others only leave what they connect."""
            nonlocal low
            pairs = np.unique(np.concatenate([kept, *fresh]))
            a, b = pairs // n, pairs % n
            held = np.zeros(len(a), bool) if most is None else (degree[a] > most) & (degree[b] > most)
            low = smallest_reach(n, [(np.arange(n), low), (a[held], b[held])])
            return pairs[~held]

        for a, b, _ in _met(frame, code, limit):
            a, b = np.maximum(a, b), np.minimum(a, b)
            degree += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            fresh.append(a * n + b)
            size += len(a)
            if size > HELD_PAIRS:
                kept, fresh, size = thinned(), [], 0
        kept = thinned()
        far = np.flatnonzero(low < np.arange(n))
        ends = [np.concatenate([node[x], node[y]]) for x, y in ((kept // n, far), (kept % n, low[far]))]
        return pd.DataFrame({"a": ends[0], "b": ends[1], "held": np.arange(len(ends[0])) >= len(kept)})

    return _dealt(classes, similarity).groupBy("task").applyInPandas(join, "a long, b long, held boolean")


class Overlaps:
    """Jaccard similarities of one set with many, over the sets of a task."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)]
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 0, bool)

    def of(self, i: int, others: np.ndarray, piece: int = 4_000_000) -> np.ndarray:
        mine = self.ids[self.at[i]:self.at[i + 1]]
        self.mark[mine] = True
        both = np.zeros(len(others), np.int64)
        ends = np.cumsum(self.size[others])
        for first in np.unique(np.r_[0, np.searchsorted(ends, np.arange(piece, int(ends[-1]) if len(ends) else 0, piece))]).tolist():
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + piece, "right"))
            part = others[first:max(last, first + 1)]
            size = self.size[part]
            where = np.repeat(self.at[part] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            both[first:first + len(part)] = np.bincount(np.repeat(np.arange(len(part)), size), self.mark[self.ids[where]], len(part)).astype(np.int64)
        self.mark[mine] = False
        return both / np.maximum(1, self.size[i] + self.size[others] - both)


def dense_links(side: np.ndarray, words: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose components are those of all candidate pairs of the similarity or more.

    The same candidates as in ``candidates``, each compared exactly unless its rows are connected already.
    """
    n, limit, overlaps, label, out = len(sets), most_differing(similarity), Overlaps(sets), np.arange(len(sets)), []
    keys = [(k, start) for k in range(WORDS) for start in KEY_STARTS]
    turned = [words[:, k] << np.uint64(start) | words[:, k] >> np.uint64(64 - start) if start else words[:, k] for k, start in keys]
    behind = np.uint64(64 - KEY_BITS)

    def compare(i, j):
        code = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
        i, j = code // n, code % n
        for x in np.unique(i).tolist():
            others = j[np.searchsorted(i, x):np.searchsorted(i, x, "right")]
            others = others[label[others] != label[x]]
            for y in others[overlaps.of(x, others) >= similarity].tolist() if len(others) else ():
                if label[y] != label[x]:
                    out.append((x, y))
                    label[(label == label[y]) | (label == label[x])] = min(label[x], label[y])

    for at, bits in enumerate(turned):
        for i, j in close_pairs(np.zeros(n, np.int64), side, bits, KEY_BUDGET, KEY_BITS // 8):
            fine = (label[i] != label[j]) & (np.bitwise_count(words[i, :DECIDING] ^ words[j, :DECIDING]).sum(axis=1) <= limit)
            i, j = i[fine], j[fine]
            # a pair counts at the first key at which it meets
            before = np.zeros(len(i), bool)
            for other in turned[:at]:
                before |= np.bitwise_count((other[i] ^ other[j]) >> behind) <= KEY_BUDGET
            compare(i[~before], j[~before])
    small = [(h, k) for k, x in enumerate(sets) if 0 < len(x) <= FEW_SHINGLES / similarity for h in x[:len(x) - math.ceil(similarity * len(x) - 1e-9) + 1].tolist()]
    if small:
        _, unit = np.unique(np.array([h for h, _ in small], np.uint64), return_inverse=True)
        row = np.array([k for _, k in small])
        for i, j in close_pairs(unit, side[row], np.zeros(len(row), np.uint64), 0, 0):
            compare(row[i], row[j])
    return tuple(np.array([x[k] for x in out], np.int64) for k in (0, 1))


def exact_links(classes: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links (a, b) of classes whose sets have this Jaccard similarity or more; their components are those of all such pairs.

    ``classes`` has ``bits``, ``words`` and ``leading``; ``sets_of`` gives the ``shingles`` of ``bits``.  Candidate pairs are
    compared shingle by shingle.  Classes of many candidates are compared in tasks that hold the sets of the classes they are
    connected with (or two blocks of these), which write links only.
    """
    found = durable(candidates(classes, similarity, BUSY))
    sets = durable(sets_of(found.select(F.explode(F.array("a", "b")).alias("bits")).distinct()))
    side = lambda k: sets.select(F.col("bits").alias(k), F.col("shingles").alias(f"of_{k}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    similar = both / (F.size("of_a") + F.size("of_b") - both) >= similarity
    links = durable(found.filter("NOT held").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").filter(similar).select("a", "b"))
    held = found.filter("held").select("a", "b")
    if not held.take(1):
        return links
    group = components.smallest_member(held)
    group = group.unionByName(group.select(F.col("root").alias("node"), "root").distinct())
    dense = group.join(sets.withColumnRenamed("bits", "node"), "node").join(classes.select(F.col("bits").alias("node"), "words"), "node")
    blocks = group.join(sets.select(F.col("bits").alias("node"), (F.size("shingles") + WORDS).alias("n")), "node").groupBy("root").agg(F.ceil(F.sum("n") / DENSE_SHINGLES).cast("int").alias("blocks"))
    dealt = dense.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "words", "shingles")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        words = np.stack(frame["words"].to_numpy()).astype(np.int64).view(np.uint64)
        i, j = dense_links(frame["side"].to_numpy(), words, [np.asarray(x, np.int64).view(np.uint64) for x in frame["shingles"]], similarity)
        node = frame["node"].to_numpy()
        return pd.DataFrame({"a": np.maximum(node[i], node[j]), "b": np.minimum(node[i], node[j])})

    return links.unionByName(durable(dealt.groupBy("root", "low", "high").applyInPandas(compare, "a long, b long")))


def classes_of(prints: DataFrame, bits: str = "fingerprint_bits", doc_id: str = "doc_id", within: int = 2, similarity: float | None = None, sets=None) -> DataFrame:
    """One row per distinct fingerprint: bits, rep (smallest id that has it), component_id (smallest id reachable).

    Ids may repeat or be missing; a fingerprint without any id has neither rep nor component unless it is linked
    to one that has.  With a ``similarity`` the links are those of ``exact_links``, and ``prints`` is that of ``with_sets``
    with a ``mark`` that tells rows apart; equal sets are one class.  ``sets`` gives the ``shingles`` of (bits, mark).
    """
    # links run between fingerprints: unlike ids, they cannot repeat or be missing
    if similarity is None:
        found = durable(prints.groupBy(F.col(bits).alias("bits")).agg(F.min(doc_id).alias("rep")))
        pairs = links(found.select("bits", F.col("bits").alias("node")), "bits", "node", within)
    else:
        lowest = F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("rep"), "mark", "words", "leading"))
        found = durable(prints.groupBy(F.col(bits).alias("bits")).agg(lowest.alias("low")).select("bits", "low.rep", "low.mark", "low.words", "low.leading"))
        # one row of each class brings its set
        pairs = exact_links(found.select("bits", "words", "leading"), lambda nodes: sets(found.join(nodes, "bits").select("bits", "mark")), similarity)
    roots = components.smallest_member(pairs)
    rooted = found.join(roots.withColumnsRenamed({"node": "bits", "root": "r"}), "bits", "left").withColumn("r", F.coalesce("r", "bits"))
    low = rooted.groupBy("r").agg(F.min("rep").alias("component_id"))
    return durable(rooted.join(low, "r").select("bits", "rep", "component_id", F.col("r").alias("component_bits")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", within: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    A null text counts as empty; texts without a word share fingerprint zero and are linked like any other.
    A repeated doc_id is one node per text.  Rows without doc_id take part and are named by the others of
    their component, or by null if there are none.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = durable(with_fingerprint(slim, "text", "fingerprint_bits", ["doc_id"], width))
    found = classes_of(prints, within=within)
    return prints.join(found, prints["fingerprint_bits"] == found["bits"]).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", within: int = 2, width: int = 3, similarity: float | None = None) -> DataFrame:
    """One whole row of each group of near-duplicates, with the columns of ``docs``: the row of smallest id.

    Near-duplicates have fingerprints within ``within`` bits or, if a ``similarity`` is given, sets of shingles of this
    Jaccard similarity or more.  A null text counts as empty; rows without id come last.
    Texts are read once for their fingerprints; only the rows that stay are shuffled whole.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(row).alias("mark"), F.col(f"`{text}`").alias("text"), row.alias("row"))
    slim = keyed.select("doc_id", "mark", "text")
    prints = durable(with_fingerprint(slim, "text", "fingerprint_bits", ["doc_id", "mark"], width) if similarity is None else with_sets(slim, "text", ["doc_id", "mark"], width, similarity))

    def sets(marks):
        # marks repeat only where whole rows do
        return with_shingles(slim.join(marks, "mark"), "text", ["bits"], width).dropDuplicates(["bits"])

    found = classes_of(prints, within=within, similarity=similarity, sets=sets)
    prints = prints.select("doc_id", "mark", "fingerprint_bits")
    stays = found.groupBy("component_bits").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "bits")).alias("best")).select(F.col("best.bits").alias("fingerprint_bits"))
    # the row of smallest id of each class that stays; rows are told apart by a hash of all they hold, the id included
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    chosen = prints.join(stays, "fingerprint_bits", "left_semi").groupBy("fingerprint_bits").agg(first.alias("first")).select(F.col("first.mark").alias("mark"))
    return keyed.join(chosen, "mark", "left_semi").groupBy("mark", "doc_id").agg(F.min("row").alias("row")).select("row.*")
