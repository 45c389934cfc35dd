"""Operators on texts against brute force, libraries and held-out labels."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contestlake.llm import bpe, components, langid, licenses, mix, pii, quality, simhash
from contestlake.llm.common import table
from contestlake.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, found int, ids string, copies int, spans string"
LONG = "Ünder the bridge " * 20_000 + "mail me at long.tail@example.org now"
ROWS = [
    (None, None, None, None, None, 1.0, "r", 1, "i", 2, "s"),
    (1, "", "en", "a", 0, 1.0, "r", 1, "i", 2, "s"),
    (2, "the cat sat on the mat with the hat and the bat", "en", "a", 40, None, None, None, None, None, None),
    (2, "the cat sat on the mat with the hat and the bat", "en", "a", 40, None, None, None, None, None, None),
    (3, "THE cat sat on the\tmat with the hat and the bat", "en", None, 40, None, None, None, None, None, None),
    (4, "der hund lief durch den wald und kam nicht mehr", "de", "b", 40, None, None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG), None, None, None, None, None, None),
    (6, "12 34 !!", "de", "b", 8, None, None, None, None, None, None),
    (7, "one<|endoftext|>two  \n é漢字 😀", None, "a", 20, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def real(spark):
    return table(spark, SF, "documents").cache()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- byte-pair encoding ----

def test_encoding_is_that_of_the_library(spark, real, docs):
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(vocabulary())
    for rows in (real, docs):
        texts = {(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()}
        got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(rows, vocabulary()).collect()}
        want = set()
        for doc_id, text in texts:
            ids = reference.encode(text or "", add_special_tokens=False).ids
            back = reference.decode(ids, skip_special_tokens=False)
            assert back == (text or "")
            want.add((doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert got == want


def test_merging_matches_repeated_search():
    tables = bpe.load(vocabulary())
    rng = random.Random(3)
    for _ in range(300):
        symbols = [tables.start[b] for b in bytes(rng.choice(b"theinaor ") for _ in range(rng.randint(1, 40)))]
        want = list(symbols)
        while found := [(tables.merges[a << 32 | b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << 32 | b in tables.merges]:
            (_, made), i = min(found)
            want[i:i + 2] = [made]
        assert bpe.merge(list(symbols), tables.merges) == want


def test_ids_and_text_keep_other_columns(docs):
    out = bpe.encode(docs.drop("ids"), vocabulary(), decoded="decoded")
    assert out.columns == [*docs.drop("ids").columns, "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in out.collect())


# ---- near-duplicates ----

def print_of(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, within=2):
    """Smallest id reachable, for (id, fingerprint) rows, by looking at all pairs."""
    values = sorted(set(p for _, p in prints))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= within:
                parent[find(a)] = find(b)
    low = {}
    for i, p in prints:
        if i is not None:
            low[find(p)] = min(low.get(find(p), i), i)
    return [(i, f"{p:016x}", low.get(find(p))) for i, p in prints]


def test_near_duplicates(docs, real):
    for rows in (docs, real):
        prints = [(r["doc_id"], print_of(r["text"], 3)) for r in rows.select("doc_id", "text").collect()]
        got = sorted(map(tuple, simhash.near_duplicates(rows).collect()), key=repr)
        assert got == sorted(reach(prints), key=repr)


@pytest.mark.parametrize("unit_rows", [4_000, 12])
def test_trie_join_loses_no_link(spark, monkeypatch, unit_rows):
    """Dense balls of fingerprints; with small units every unit is split down the trie."""
    monkeypatch.setattr(simhash, "UNIT_ROWS", unit_rows)
    rng = random.Random(5)
    prints = set()
    for _ in range(8):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(40)}
    prints = [(k, p) for k, p in enumerate(sorted(prints))]
    rng.shuffle(prints)
    df = spark.createDataFrame([(k, simhash.signed(p)) for k, p in prints], "doc_id long, fingerprint_bits long")
    got = {(r["bits"], r["component_id"]) for r in simhash.classes_of(df).collect()}
    assert got == {(simhash.signed(int(h, 16)), low) for _, h, low in reach(prints)}


@pytest.mark.parametrize("unit_rows", [16_000, 12])
def test_similarity_join_is_its_rule(spark, monkeypatch, unit_rows):
    """Against all pairs; with small units every unit is split down its key and the bits behind it."""
    monkeypatch.setattr(simhash, "KEY_UNIT_ROWS", unit_rows)
    rng = random.Random(9)
    found = {}
    for size in (1, 1, 30, 30):
        centre = [rng.getrandbits(64) for _ in range(simhash.WORDS)]
        for _ in range(size):
            share = rng.choice([0.0, 0.02, 0.1, 0.15, 0.25])
            words = [w ^ sum(1 << b for b in range(64) if rng.random() < share) for w in centre]
            found[words[0]] = words
    rows = [(simhash.signed(w[0]), [simhash.signed(x) for x in w]) for w in found.values()]
    links = simhash.similar_links(spark.createDataFrame(rows, "bits long, words array<long>"), 0.8)
    got = {(r["node"], r["root"]) for r in components.smallest_member(links).collect()}
    limit, mask = simhash.most_differing(0.8), (1 << simhash.KEY_BITS) - 1

    def similar(a, b):
        near = any(((x ^ y) >> (64 - start - simhash.KEY_BITS) & mask).bit_count() <= simhash.KEY_BUDGET for x, y in zip(a, b) for start in simhash.KEY_STARTS)
        return near and sum((x ^ y).bit_count() for x, y in list(zip(a, b))[:simhash.DECIDING]) <= limit

    root = {simhash.signed(k): simhash.signed(k) for k in found}
    for _ in range(len(found)):
        before = dict(root)
        for a in found.values():
            for b in found.values():
                if a is not b and similar(a, b):
                    low = min(root[simhash.signed(a[0])], root[simhash.signed(b[0])])
                    root[simhash.signed(a[0])] = root[simhash.signed(b[0])] = low
        if before == root:
            break
    linked = {(k, r) for k, r in root.items() if k != r}
    assert got == linked and len(linked) > 20


def test_units_that_their_bits_deal_out_are_left_whole(spark, monkeypatch):
    """A split writes every row once for each node it meets: units over the bound whose children are small are not split."""
    monkeypatch.setattr(simhash, "KEY_UNIT_ROWS", 20)
    rng = random.Random(3)
    rows = [(k, [simhash.signed(rng.getrandbits(64)) for _ in range(simhash.WORDS)]) for k in range(2_000)]
    dealt = simhash._dealt(spark.createDataFrame(rows, "bits long, words array<long>"), 0.8)
    bands = simhash.WORDS * len(simhash.KEY_STARTS) * (simhash.KEY_BUDGET + 1)
    assert dealt.count() == bands * len(rows) and dealt.groupBy("unit").count().filter("count > 20").count() > 100


@pytest.mark.parametrize("step", [16_000_000, 50])
def test_trie_steps_in_halves_find_the_same_pairs(monkeypatch, step):
    monkeypatch.setattr(simhash, "STEP_PAIRS", step)
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 1 << 10, 300).astype(np.uint64) << np.uint64(44)
    unit, side = rng.integers(0, 3, 300), np.zeros(300, np.int64)
    got = {(min(a, b), max(a, b)) for i, j in simhash.close_pairs(unit, side, bits, 2, 3) for a, b in zip(i.tolist(), j.tolist())}
    near = lambda a, b: int(bits[a] ^ bits[b]).bit_count() <= 2
    wanted = {(a, b) for a in range(300) for b in range(a + 1, 300) if unit[a] == unit[b] and near(a, b)}
    assert got == wanted and len(wanted) > 100


def test_similar_texts_go_and_others_stay(spark):
    """Whole documents against exact Jaccard similarities of five-word shingles."""
    rows = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in rows.select("doc_id", "text").collect()}
    stays = {r["doc_id"] for r in simhash.one_of_each(rows, width=5, similarity=0.8).collect()}
    shingles = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        shingles[k] = {b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if w else {b""}
    holders = {}
    for k, s in shingles.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    best, pairs = {}, []
    for k, s in shingles.items():
        for other in {o for x in s for o in holders[x] if o > k}:
            j = len(s & shingles[other]) / len(s | shingles[other])
            best[k], best[other] = max(best.get(k, 0), j), max(best.get(other, 0), j)
            pairs.append((j, k, other))
    assert {k for k in texts if best.get(k, 0) < 0.5} <= stays
    wanted = [(a, b) for j, a, b in pairs if j >= 0.8]
    assert len(wanted) > 50 and all(a not in stays or b not in stays for a, b in wanted)


def test_small_sets_meet_in_units_that_are_split(spark, monkeypatch):
    """Short texts under one header: units of a shingle are split by further shingles, then into blocks, and lose no pair."""
    monkeypatch.setattr(simhash, "KEY_UNIT_ROWS", 12)
    rng = random.Random(5)
    header = [f"h{k}" for k in range(9)]
    texts = [[*header, *[f"w{rng.getrandbits(40)}" for _ in range(rng.randint(4, 12))]] for _ in range(60)]
    texts += [[*t[:-1], "end"] for t in texts[:25]] + [[*header, *[f"r{k}" for k in range(20)], f"e{k}"] for k in range(40)]
    sets = [simhash.shingles(" ".join(t), 5) for t in texts]
    rows = [(k, [int(x) for x in simhash.set_words(s, simhash.WORDS).view("int64")], [int(x) for x in s.view("int64")]) for k, s in enumerate(sets)]
    found = simhash.candidates(spark.createDataFrame(rows, "bits long, words array<long>, leading array<long>"), 0.8, None)
    got = {(r["a"], r["b"]) for r in found.filter("NOT held").collect()}
    known = [set(s.tolist()) for s in sets]
    wanted = {(i, j) for i, a in enumerate(known) for j, b in enumerate(known[:i]) if len(a & b) / len(a | b) >= 0.8}
    assert len(wanted) > 700 and wanted <= got


def test_no_generated_code_is_too_large(spark):
    """Classes that the compiler refuses cost the driver memory and fall back to slow code."""
    frame = spark.createDataFrame([], "bits long, words array<long>, leading array<long>, root long")
    codes = simhash.candidates(frame, 0.8, None)._jdf.queryExecution().debug().codegenToSeq()
    assert all(0 < codes.apply(i)._3().maxMethodCodeSize() < 65_535 and len(codes.apply(i)._2()) < 200_000 for i in range(codes.size()))


@pytest.mark.parametrize("busy, few, unit_rows, block", [(32, 40, 16_000, 1_000_000), (1, 0, 16_000, 4_000), (3, 40, 60, 1_000)])
def test_similar_texts_are_exactly_those(spark, monkeypatch, busy, few, unit_rows, block):
    """Texts of similarities from 0.6 to 0.9 and groups of near copies: one of each group of exact Jaccard 0.8 or more stays."""
    monkeypatch.setattr(simhash, "BUSY", busy)
    monkeypatch.setattr(simhash, "KEY_UNIT_ROWS", unit_rows)
    monkeypatch.setattr(simhash, "DENSE_SHINGLES", block)
    monkeypatch.setattr(simhash, "FEW_SHINGLES", few)
    rng, texts = random.Random(21), []
    for size in [*[8] * 10, *[60] * 20, *[200] * 40] if few else [200] * 40:
        base = [f"w{rng.getrandbits(40)}" for _ in range(size)]
        texts.append(base)
        for cut in (0.02, 0.05, 0.1, 0.12, 0.14, 0.18, 0.22):  # a run of new words at the end
            n = max(1, round(size * cut))
            texts.append([*base[:-n], *[f"v{rng.getrandbits(40)}" for _ in range(n)]])
    base = [f"w{rng.getrandbits(40)}" for _ in range(150)]
    texts += [[f"c{k}" if at == k else w for at, w in enumerate(base)] for k in range(100)]
    texts += [["again", "and"] * 300 + [f"u{rng.getrandbits(40)}" for _ in range(60)] for _ in range(2)]  # alike by words, not by sets
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.one_of_each(rows, width=5, similarity=0.8).collect()}
    assert got == {k for k in range(len(texts)) if root[k] == k}


def test_similar_texts_of_odd_rows(docs):
    out = simhash.one_of_each(docs, width=3, similarity=0.8)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4, 5, 6, 7]
    assert simhash.one_of_each(docs.limit(0), similarity=0.8).count() == 0


def test_long_fingerprint_starts_with_the_short_one():
    for text in (None, "", "a b", LONG):
        found = simhash.fingerprints(text, 3, simhash.WORDS)
        assert found[0] == simhash.fingerprint(text, 3) == print_of(text, 3) and len(found) == simhash.WORDS


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.smallest_member(pairs).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_one_row_of_each_group_stays(docs):
    out = simhash.one_of_each(docs, width=3)
    assert out.columns == docs.columns
    prints = [(r["doc_id"], print_of(r["text"], 3)) for r in docs.select("doc_id", "text").collect()]
    want = {low for _, _, low in reach(prints)}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)


# ---- language and quality ----

def test_language_of_held_out_documents(spark):
    rows = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == rows.count() and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] in (None, 1, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.accepted(docs).columns == docs.columns
    empty = docs.limit(0)
    assert langid.identify(empty).count() == 0 and langid.accepted(empty).count() == 0


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    ones, zeros = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc > 0.9
    assert all(r["predicted"] == (1 if r["score"] >= 0.7 else 0) for r in got)


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(5)
    for prior in (0.1, 0.5, 0.9):
        ones = np.histogram(rng.beta(5, 2, 20_000), 200, (0, 1))[0]
        mixed = np.histogram(np.where(rng.random(20_000) < prior, rng.beta(5, 2, 20_000), rng.beta(2, 8, 20_000)), 200, (0, 1))[0]
        assert abs(quality.best_bin(ones, mixed) - prior) < 0.04
    assert quality.best_bin(ones, ones) > 0.99 and quality.best_bin(ones * 0, ones) == 0.5


def test_class_prior_against_every_threshold():
    rng = np.random.default_rng(6)
    ones, mixed = rng.integers(0, 9, 40), rng.integers(0, 30, 40)
    ones[-3:] = 0
    doubt = math.sqrt(math.log(40) / 2 / ones.sum()) + math.sqrt(math.log(40) / 2 / mixed.sum())
    tails = [(sum(mixed[k:]) / mixed.sum(), sum(ones[k:]) / ones.sum()) for k in range(37)]
    u, p = min(tails, key=lambda t: t[0] / t[1] + 1.01 * doubt / t[1])
    assert quality.best_bin(ones, mixed) == pytest.approx(min(max(u / p, 1 / (mixed.sum() + 2)), 1 - 1 / (mixed.sum() + 2)))


def test_class_prior_without_negatives(spark):
    """The estimate sees no label but 1, and comes near the share of ones among all labels."""
    sf = "/root/testdata/sf0.01"
    given, marks, found = table(spark, sf, "documents"), table(spark, sf, "labels"), []
    original = quality.estimated_prior

    def note(*args):
        found.append(original(*args))
        return found[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "estimated_prior", note)
        quality.fit(given, marks.filter("quality = 1"), F.lit(True))
    share = marks.agg(F.avg("quality")).first()[0]
    assert abs(found[0] - share) < 0.1


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 0, 0), (4, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


# ---- mixing ----

def test_targets_stop_at_their_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 500, None: 5}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mix.targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    total, free, want, left = sum(sizes.values()), set(sizes), {}, float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 3 * sizes[s]
            left -= want[s]
        free -= full
    want.update({s: weight[s] * level for s in free})
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


@pytest.mark.parametrize("bin_rows", [20_000, 3])
def test_mix_follows_a_plain_draw(real, docs, monkeypatch, bin_rows):
    monkeypatch.setattr(mix, "BIN_ROWS", bin_rows)
    for rows in (real, docs):
        data = []
        for r in rows.select("doc_id", "text", "source").collect():
            text = r["text"] or ""
            size = len(re.findall(r"[^\x20\x09-\x0D]+", text))
            u = (int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            w = 1.0 if 4 <= len(text) / max(size, 1) <= 12 else 0.5
            data.append((r["source"], -math.log(u) / w, r["doc_id"], size))
        out = mix.mixture(rows).collect()
        assert len(out) == len(data) and out == mix.mixture(rows).collect() or sorted(out) == sorted(mix.mixture(rows).collect())
        target = {r["source_size"]: r["target"] for r in out}
        want = []
        for source in {d[0] for d in data}:
            mine = sorted((d[1:] for d in data if d[0] == source), key=lambda d: (d[0], d[1] is not None, d[1], d[2]))
            total = sum(d[2] for d in mine)
            epochs = min(3, int(target[total] // total)) if total else 0
            rest, before = target[total] - epochs * total, 0
            for k, d in enumerate(mine):
                group = [x for x in mine if x == d]
                if k and mine[k - 1] == d:
                    pass
                else:
                    take = before < rest and 2 * before + sum(x[2] for x in group) <= 2 * rest
                    before += sum(x[2] for x in group)
                want.append((d[1], d[2], total, d[2] * (epochs + take)))
        assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in out), key=repr) == sorted(want, key=repr)


def test_mixed_rows_are_those_counted(real, docs):
    for rows in (real, docs):
        out = mix.mixed(rows)
        assert out.columns == rows.columns
        assert out.select(F.sum(mix.size_of(F.col("text")))).first()[0] == mix.mixture(rows).agg(F.sum("taken")).first()[0]
    assert mix.mixture(docs.limit(0)).count() == 0 and mix.mixed(docs.limit(0)).count() == 0


# ---- personal data ----

def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f.g x..y@z-.q, @x.y a@b a@@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111",
    "+1 (988) 555-2485 +12 +1234567 +123456789012345678 ++49 30 123456", "é漢😀 a.b@c.de 😀 10.0.0.1 4111111111111111 +1 202 555 0143", "x@y.z" * 50,
    "same 7 same 7 10.0.0.10 10.0.0.1 10.0.0.1", "a@" + "b." * 3000 + "c", "9" * 5000 + " " + "1-" * 3000, "a" * 50_000 + "@b.c",
]


def test_base_spans(spark, real):
    texts = TRICKY + [r["text"] for r in real.select("text").collect()]
    got = by_id(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k, text in enumerate(texts):
        want = base_spans(text)
        listed = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[k]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text[:100]
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[0] == kind for s in want) for kind in pii.KINDS]
        assert not listed or set(listed.split(",")) <= set(got[k]["spans"].split(","))


def test_classifier_adds_what_context_supports(spark):
    genuine = [f"please call me on (212) 555-{1000 + k} today" for k in range(60)] + [f"phone +1 (212) 555-{2000 + k} now" for k in range(60)]
    other = [f"invoice 100-200-{3000 + k} paid in full" for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(genuine + other)), "doc_id long, text string")
    got = by_id(pii.find(rows))
    assert all("phone:" in got[k]["spans"] for k in range(120)) and not any(got[k]["spans"] for k in range(120, 180))


def test_masking(spark, docs):
    out = pii.masked(docs)
    assert out.columns == docs.columns
    got = by_id(out)
    assert got[5]["text"] == LONG.replace("long.tail@example.org", "<EMAIL>") and got[5]["n_chars"] == len(got[5]["text"])
    assert got[2]["text"] == ROWS[2][1] and got[1]["text"] == "" and got[None]["text"] is None
    assert pii.masked(docs.limit(0)).count() == 0 and pii.find(docs.limit(0)).count() == 0 and pii.find(docs).count() == len(ROWS)


def test_added_spans_are_at_their_match(spark):
    """A pattern that looks at its surroundings is located by its match, not by its characters."""
    texts = ["5-555-123-4567 then phone: call 555-123-4567 now", "+1-555-123-4567 and phone 555-123-4567", "é😀 phone 555-123-4567, phone 555-123-4567"]
    found = pii.located(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", ["doc_id"])
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if not s["base"]] for r in found.collect()}
    assert got == {0: [(32, 44)], 1: [(26, 38)], 2: [(9, 21), (29, 41)]}


def test_language_sample_counts_copies_once(spark):
    rows = [("same text", "en")] * 3000 + [(f"text {k}", "en") for k in range(50)] + [("ein text", "de")] * 4000 + [(f"text nummer {k}", "de") for k in range(3)]
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 40, 80).collect()
    assert len({r["text_"] for r in got}) == len(got) == 44 and sum(r["l_"] == "de" for r in got) == 4


def test_em_trusts_the_reliable_labeler():
    patterns = [((1, 1, 1, 1, 1), 50.0), ((-1, -1, 0, 1, 1), 50.0), ((-1, 1, 1, 1, 1), 5.0)]
    chance = pii.estimate(patterns)
    assert chance[0] > 0.9 > 0.1 > chance[1]


# ---- licenses ----

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_patience_aligns_in_order():
    rng = random.Random(9)
    for _ in range(300):
        a, b = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))] for _ in range(2)]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[k] for i, k in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b) and licenses.patience(a, a) == [(i, i) for i in range(len(a))]
    pairs = [(i, y) for i, y in enumerate(rng.sample(range(40), 40))]
    assert len(licenses.ascending(pairs)) == lcs([y for _, y in pairs], sorted(y for _, y in pairs))


def test_licenses_are_found_where_they_are(spark, docs):
    mit, words = licenses.TEMPLATES["mit-text"], "und so weiter und so fort "
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 9)
    rows = [(0, words * 30 + licenses.TEMPLATES["gpl-3.0"] + "\n" + words), (1, f"{words}{mit}\n{mit}"), (2, words + cut), (3, "ALL RIGHTS   reserved é. all rights reserved"),
            (4, "the license of version 3 work"), (5, None), (6, "")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    at = rows[0][1].index("This work")
    assert got[0]["places"] == f"gpl-3.0:{at}:{at + len(licenses.TEMPLATES['gpl-3.0']) - 1}" and got[0]["coverage"] == 1.0
    assert got[1]["n_found"] == 2 and got[1]["license"] == "mit-text"
    assert got[2]["license"] == "mit-text" and 0.85 < got[2]["coverage"] < 1
    assert got[3]["places"] == "all-rights-reserved:0:21,all-rights-reserved:25:44"
    assert all((got[k]["license"], got[k]["n_found"], got[k]["places"]) == (None, 0, "") for k in (4, 5, 6))
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(docs.limit(0)).count() == 0


def test_every_whole_notice_is_found(real):
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    for k, r in by_id(licenses.scan(real)).items():
        for name in ("gpl-3.0", "mit", "cc-by-nc-4.0", "all-rights-reserved", "apache-2.0"):
            assert (licenses.TEMPLATES[name] in texts[k]) <= (f"{name}:" in r["places"])


def test_siblings_of_a_license_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, phrases=licenses.PHRASES)
    start = "This work is licensed under the GNU "
    for text, name in (("Lesser General Public License, version 3", "lgpl-3.0"), ("General Public License, version 2", "gpl-2.0"), ("General Public License, version 3", "gpl-3.0"),
                       ("Affero General Public License, version 3", "agpl-3.0"), ("Lesser General Public License, version 2.1", "lgpl-2.1")):
        assert [f[0] for f in scanner.scan(f"und so weiter. {start}{text}. Und so fort.")] == [name]
    for text, name in (("BY 4.0", "cc-by-4.0"), ("BY-SA 4.0", "cc-by-sa-4.0"), ("BY-NC 4.0", "cc-by-nc-4.0"), ("BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("BY 3.0", "cc-by-3.0")):
        assert [f[0] for f in scanner.scan(f"Und so weiter. Licensed under CC {text}. Und so fort.")] == [name]
    assert not scanner.scan("Licensed under the Apache License, Version 1.1.") and not scanner.scan(f"{start}General Public License, version 1.")
    for name, text in licenses.TEMPLATES.items():
        assert [f[:2] for f in scanner.scan(f"und so {text} weiter")] == [(name, 1.0)]
