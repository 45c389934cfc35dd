"""Searches over vectors, the URL filter, registration and the pipeline."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from contestlake.llm import ann, bpe, langid, mix, pii, queries, simhash, topk, urls
from contestlake.llm.common import table

SF = "/root/testdata/sf0.001"
SMALL = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [3.0, -1.0]), (40, None), (60, [0.0, 0.0]), (None, [1.0, 1.0]), (80, [float("nan"), 1.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]),
         (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [5.0]), (8, [])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in SMALL], "vec_id long, embedding array<float>, leaf int, score double")


def brute(rows, k, scale):
    width = max(len(v) for _, v in rows)
    rows = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in rows]
    if scale:
        rows = [(i, np.floor(v * scale)) for i, v in rows]
    out = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for v in [v for i, v in rows if i == q]:
            for i, w in rows:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), float(v @ w))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_search_edges(vectors):
    fine = [(i, v) for i, v in SMALL if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = F.col("vec_id") % 20 == 0
    assert listed(ann.nearest(vectors, asked, 3)) == brute([(i, v) for i, v in fine if any(v)], 3, None)
    assert listed(topk.exact(vectors, asked, 3)) == brute(fine, 3, 64)
    assert ann.nearest(vectors.limit(0), asked, 3).count() == 0 and topk.exact(vectors.limit(0), asked, 3).count() == 0


def test_recall_of_the_forest(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = listed(ann.nearest(rows, F.col("vec_id") % 20 == 0))
    data = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in rows.collect()]
    want = brute(data, 20, None)
    exact = {(i, j): s for i, l in want.items() for j, s in l}
    hits = [(i, j) in exact for i, l in got.items() for j, _ in l]
    assert sum(hits) / len(exact) >= 0.9
    assert all(s == pytest.approx(exact[i, j], abs=1e-12) for i, l in got.items() for j, s in l if (i, j) in exact)


def test_chunks_of_queries_change_nothing(spark, monkeypatch):
    rows, asked = table(spark, SF, "embeddings"), F.col("vec_id") % 20 == 0
    want = listed(ann.nearest(rows, asked))
    monkeypatch.setattr(ann, "ASKED", 3)
    monkeypatch.setattr(ann, "BLOCK", 16)
    assert listed(ann.nearest(rows, asked)) == want


@pytest.mark.parametrize("block, asked", [(4_096, 16_384), (64, 16_384), (4_096, 3), (64, 3)])
def test_score_at_a_time_is_exact(spark, monkeypatch, block, asked):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "ASKED", asked)
    rows = table(spark, SF, "embeddings")
    got = listed(topk.exact(rows, F.col("vec_id") % 20 == 0))
    assert got == brute([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in rows.collect()], 20, 64)


def test_stopping_early_is_proved():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.standard_normal((600, 16)) * rng.choice([1, 4, 40], (600, 16)))
    rows[:50] = rows[0]
    queries_ = rows[:40]
    ids = np.arange(600)
    index, seen = topk.Index(rows), set()
    for j, near in index.possible(queries_, ids[:, None] == ids[None, :40], 5, enough=20):
        score = rows @ queries_[j]
        best = [i for i in np.lexsort((ids, -score)) if i != j][:5]
        assert set(best) <= set(near.tolist())
        seen.add(j)
    assert seen == set(range(40))


# ---- URLs ----

def test_rules_and_parts(spark):
    given = [("http://Example.NET/en/1?x", "example.net", "/en/1", "example.net/en/", "allow"), ("https://a.example.net/de", "a.example.net", "/de", "net/", "block"),
             ("http://example.net", "example.net", "", None, "allow"), ("http://b.example.com/de/x#y", "b.example.com", "/de/x", "example.com/de/", "block"),
             ("http://badexample.com/de/x", "badexample.com", "/de/x", None, "allow"), ("x://q.org/fr/?", "q.org", "/fr/", "org/fr/", "allow"),
             ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://a?b://c/d", "a", "", None, "allow"),
             ("://ÄB.org#/fr/", "Äb.org", "", None, "allow"), ("http://h/a\nb/c", "h", "/a\nb/c", None, "allow")]
    rows = spark.createDataFrame([(k, g[0], "x", "y") for k, g in enumerate(given)] + [(None, "http://h/", "x", "y")], "page_id long, url string, host string, template string")
    got = {r["page_id"]: r for r in urls.judge(rows).collect()}
    for k, (_, *want) in enumerate(given):
        assert [got[k][c] for c in ("host", "path", "rule", "verdict")] == want
    assert len(got) == len(given) + 1 and urls.judge(rows.limit(0)).count() == 0


def test_poor_templates_are_rejected(spark):
    pages, labels = [], []
    for k in range(400):
        kind = ("news", "spam", "tags", "help")[k % 4]
        pages.append((k, f"http://h.example/{kind}/{k * 7919}/item-{k}.html"))
        if k % 8 < 4:
            labels.append((k, 0 if kind == "spam" else 1))
    for k in range(400, 440):
        pages.append((k, f"http://other.example/spam/{k}"))
    rows = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (None, 0), (3, None)], "page_id long, label int")
    got = {r["page_id"]: r for r in urls.judge(rows, marks).collect()}
    assert all((got[k]["verdict"] == "block") == (k % 4 == 1) for k in range(400))
    assert {got[k]["template"] for k in range(0, 400, 4)} == {got[2]["template"]} != {got[1]["template"]}
    assert all(got[k]["verdict"] == "allow" for k in range(400, 440))


def test_similar_branches_meet(spark):
    pages, labels = [], []
    share = {"a": 9, "b": 9, "c": 9, "spam": 1, "junk": 1, "mid": 5, "rare": 0}
    for k in range(2_100):
        kind = list(share)[k % 7]
        pages.append((k, f"http://h.example/{kind}" + f"/deep{k}" * 12))
        if kind != "rare" or k < 70:
            labels.append((k, int(k // 7 % 10 < share[kind])))
    rows = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(rows, spark.createDataFrame(labels, "page_id long, label int")).collect()}
    tops = {kind: {r["template"].split("/")[1] for k, r in got.items() if k % 7 == i} for i, kind in enumerate(share)}
    assert tops == {"a": {"*"}, "b": {"*"}, "c": {"*"}, "spam": {"{junk|*}"}, "junk": {"{junk|*}"}, "mid": {"mid"}, "rare": {"*"}}
    assert all((r["verdict"] == "block") == (k % 7 in (3, 4)) for k, r in got.items() if k % 7 != 5)
    assert all(len(r["template"].split("/")) == 14 for r in got.values())


def test_tree_matches_a_plain_walk(spark):
    pages = table(spark, SF, "pages").select("page_id", "url")
    marks = urls.document_labels(pages, table(spark, SF, "labels"))
    settings = urls.Settings(support=2, z=0.5, prior=2.0, purity=0.8)
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in urls.judge(pages, marks, settings=settings).collect()}
    good = {r["page_id"]: r["label"] for r in marks.collect()}
    rows = []
    for r in pages.collect():
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", r["url"])
        parts = re.sub("^/", "", m[2]).split("/")
        rows.append([r["page_id"], m[1].lower(), [re.sub("[0-9]+", "{n}", re.sub("[0-9a-fA-F]{8}[0-9a-fA-F-]*", "{x}", s)) for s in parts], "", good.get(r["page_id"])])

    def seen(some):
        return [x[4] for x in some if x[4] is not None]

    def differ(a, b, z):
        p = min(max((sum(a) + sum(b)) / (len(a) + len(b)), 0.02), 0.98)
        return abs(sum(a) / len(a) - sum(b) / len(b)) > z * math.sqrt(p * (1 - p) * (1 / len(a) + 1 / len(b)))

    for level in range(max(len(x[2]) for x in rows)):
        moves = []
        for host, node in {(x[1], x[3]) for x in rows if len(x[2]) > level}:
            here = [x for x in rows if (x[1], x[3]) == (host, node) and len(x[2]) > level]
            bins = {}
            for name in {x[2][level] for x in here}:
                own = seen([x for x in here if x[2][level] == name])
                if len(own) >= 2:
                    bins.setdefault(math.floor(sum(own) / len(own) / 0.005), []).append((name, own))
            groups = []
            for top in sorted(bins):
                names, votes = {n for n, _ in bins[top]}, [v for _, own in bins[top] for v in own]
                if groups and not differ(groups[-1][1], votes, 0.5):
                    groups[-1] = (groups[-1][0] | names, groups[-1][1] + votes)
                else:
                    groups.append((names, votes))
            usual = max(groups, key=lambda g: len(g[1]), default=None)
            for x in here:
                group = next((g for g in groups if x[2][level] in g[0]), usual)
                moves.append((x, node + "/" + ("*" if group is usual else x[2][level] if len(group[0]) == 1 else "{" + min(group[0]) + "|*}")))
        for x, node in moves:
            x[3] = node
    overall = (sum(seen(rows)) + 1) / (len(seen(rows)) + 2)
    for x in rows:
        h, t = seen([y for y in rows if y[1] == x[1]]), seen([y for y in rows if y[1] == x[1] and y[3] == x[3]])
        purity = (sum(t) + 2 * (sum(h) + 2 * overall) / (len(h) + 2)) / (len(t) + 2)
        rule = max((r for r in urls.RULES if (x[1] == r[1].split("/")[0] or x[1].endswith("." + r[1].split("/")[0])) and ("/" + "/".join(x[2])).startswith("/" + r[1].split("/", 1)[1])),
                   key=lambda r: len(r[1]), default=None)
        assert got[x[0]] == (x[3], rule[0] if rule else "block" if purity < 0.8 else "allow")


# ---- registration and pipeline ----

def test_registered():
    names = list(entry.queries())
    assert [f"op{n}_" for n in range(1, 11)] == [next(x[:len(f"op{n}_")] for x in names if x.startswith(f"op{n}_")) for n in range(1, 11)]
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = duck.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in sorted(at)) for r in got.collect()) == sorted(tuple(r[at[c]] for c in sorted(at)) for r in rel.fetchall())


def test_pipeline_is_its_stages(spark):
    docs = table(spark, SF, "documents")
    kept = langid.accepted(docs)
    assert kept.count() >= 0.95 * docs.count()
    ids = {r["component_id"] for r in simhash.near_duplicates(kept, width=5).collect()}
    assert sorted(r["doc_id"] for r in simhash.one_of_each(kept, width=5).collect()) == sorted(ids)
    single = simhash.one_of_each(kept, width=5, similarity=0.8)
    assert {r["doc_id"] for r in single.collect()} < ids
    clean = pii.masked(single)
    assert clean.columns == docs.columns and clean.filter(F.col("text").rlike(r"[a-z0-9]@mail[0-9]\.example")).count() == 0
    chosen = mix.mixed(clean)
    want = bpe.digests(chosen, queries.vocabulary())
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_accept_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", None, "a", 0, None), (2, "plain words about nothing", "en", None, 3, "y")] * 2,
                                "doc_id long, text string, lang string, source string, n_chars long, found string")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == odd.columns
            stage(spark, docs, SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
