"""The operators' queries and the pipeline over the small given tables."""

from __future__ import annotations

import collections
import hashlib
import os
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from fieldloom.llm import queries

TABLES = "documents pages conversations benchmark embeddings".split()


def plain(rows, names):
    one = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def test_shards_of_all_documents(spark, sf):
    out = queries.op5_histogram_shards(spark, sf).toPandas().set_index("doc_id")
    docs = documents(spark, sf).set_index("doc_id")
    texts = docs.text.fillna("")
    assert sorted(out.index) == sorted(docs.index) and out.grown_shard.isna().all()
    assert all(len(texts[i].encode()) + 8 == n for i, n in out["size"].items())
    assert all(zlib.crc32(texts[i].encode()) == n for i, n in out.text_crc32.items())
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot) and set(out.shard) == set(range(24))
    sums, mean = out.groupby("shard")["size"].sum(), out["size"].sum() / 24
    assert (sums - mean).abs().max() <= 0.01 * mean + out["size"].max()
    # Equal texts adjoin: a group lies in one shard, or ends one and begins the next.
    for ids in texts.groupby(texts).groups.values():
        shards = sorted(set(out.shard[ids]))
        assert shards == list(range(shards[0], shards[-1] + 1)) and len(shards) <= 2


def test_mix_against_brute_force(spark, sf):
    out = queries.op7_source_mix(spark, sf).toPandas().set_index("doc_id")
    docs = documents(spark, sf).set_index("doc_id")
    size = docs.text.fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (out["size"] == size[out.index]).all()
    by = size.groupby(docs.source.fillna("\U0010ffff")).sum().sort_index()
    weight = {s: 1 + i % 3 for i, s in enumerate(by.index)}
    fixed: dict[str, float] = {}
    while True:  # targets above three times their source's size stop there, one by one
        left, rest = size.sum() - sum(fixed.values()), [s for s in by.index if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * by[s]]
        if not over:
            break
        fixed[max(over, key=lambda s: share[s] / max(by[s], 1e-9))] = 3.0 * by[max(over, key=lambda s: share[s] / max(by[s], 1e-9))]
    target = fixed | share
    source = docs.source.fillna("\U0010ffff")[out.index]
    assert (out.source_size == source.map(by)).all() and (abs(out.target - source.map(target)) <= 1e-6 * out.target + 1e-6).all()
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    taken = out.taken.groupby(source).sum()
    assert all(abs(taken[s] - target[s]) <= 64 + 0.02 * target[s] for s in by.index)


def test_fingerprints_against_true_shingle_sets(spark, sf):
    out = queries.op9_fingerprints(spark, sf).toPandas().set_index("doc_id")
    docs = documents(spark, sf).set_index("doc_id").text.fillna("")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def same(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    order = sorted(docs.index, reverse=True)
    wrong, by_text = [], {}
    for i, n in zip(order, [*order[1:], order[0]], strict=True):
        text, following, row = docs[i], docs[n], out.loc[i]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new, other = shingles(text), shingles(edited), shingles(following)
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert len(row.fingerprint) == 16 * min(128, len(own)) and len(row.edited_fingerprint) == 16 * min(128, len(new))
        small = len(own | new) <= 128 and len(own | other) <= 128
        wrong.append((row.near_edited - same(own, new), row.near_next - same(own, other), small))
    assert max(abs(x) for a, b, small in wrong if small for x in (a, b)) < 1e-9  # whole sets are in the sketches
    assert max(abs(x) for a, b, _ in wrong for x in (a, b)) < 0.2 and sum(abs(a) for a, _, _ in wrong) / len(wrong) < 0.04


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "source mixing", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, sf)
    judged = {r.doc_id: r.kept for r in queries.quality.judge_quality(docs).collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == {d for d, k in judged.items() if k} and good.columns == docs.columns
    one = corpus_pipeline.near_dedup(spark, good, sf)
    assert one.columns == docs.columns
    shingled = [tuple(re.findall(r"\S+", r.text)) for r in one.collect()]
    assert len(set(shingled)) == len(shingled)
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert (out.length.groupby(out.sequence_id).sum() <= 1024).all() and out.length.min() >= 1
    assert collections.Counter(out.piece)[0] >= one.count() * 0.5
