"""Ranked search, personal data and hard negatives on small tables, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import hardneg, lexical, pii, queries

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    size = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in size), sum(size)
    df = collections.Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = collections.Counter()
    for item, text in set(items):
        asked, found = collections.Counter(terms(text)), []
        for i, (d, c) in enumerate(counts):
            m = 25 + (75 * size[i] * n_docs) // n_terms if n_terms else 0
            score = sum(q * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d, i))
        out.update((item, rank + 1, d, -s) for rank, (s, _, d, _) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))
    return out


@pytest.mark.parametrize("shard,window,block", [(600, 4, 3), (1 << 20, 1 << 10, 128), (3000, 16, 8)])
def test_ranked_search_against_brute_force(spark, monkeypatch, shard, window, block):
    monkeypatch.setattr(lexical, "FIRST_WINDOW", window)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "BATCH_TERMS", 40)
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé世Z9") for _ in range(r.randint(1, 4))) for _ in range(60)]
    draw = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.08)), 59)] for _ in range(n))
    docs = [(i, draw(r.choice([0, 1, 5, 30, 200]))) for i in range(400)] + [(7, "Aa aa"), (None, draw(20)), (500, None), (501, "--- !"), (502, "word " * 30000), (502, "word " * 30000)]
    items = [(i, draw(12)) for i in range(25)] + [(3, "word aa"), (3, "word aa"), (4, None), (5, "nowhere"), (6, "Aa, AA. aa")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, shard int").repartition(3)
    asked = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, score int")
    rows = lexical.search(lexical.build_index(frame, shard), asked).collect()
    assert collections.Counter(tuple(x) for x in rows) == ranked(docs, [(i, t or "") for i, t in items])


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.ranked_search(docs, items).count() == 0 and lexical.ranked_search(some, items).count() == 0
    assert lexical.ranked_search(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert [tuple(x) for x in lexical.ranked_search(some, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 800)))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31 - 1), max_size=40))
def test_varints(values):
    raw, size = lexical.varints(np.array(values, np.int64))
    assert lexical.from_varints(raw).tolist() == values and size.sum() == len(raw)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def base_spans(text):
    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return [s for _, _, s in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.text("a@.1259-+ (0)é", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans_of(text) if k in pii.BASE] == base_spans(text)


def test_base_spans_of_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_personal_data(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        counts = collections.Counter(s.split(":")[0] for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize("text,kinds", [
    ("pay to GB82 WEST 1234 5698 7654 32 now", ["iban"]), ("pay to GB82 WEST 1234 5698 7654 33 now", []), ("DE89370400440532013000", ["iban"]), ("ZZ89370400440532013000", []),
    ("my social security number is 123-45-6789", ["ssn"]), ("part 123-45-6789", []), ("ssn 000-45-6789", []), ("call me: (425) 555-9684", ["local_phone"]), ("sum (425) 555-9684", []), ("call +1 (425) 555-9684", ["phone"]),
    ("born 1980-02-29 in Kent", ["birth_date"]), ("released 1980-02-29", []), ("born 31.12.1980", ["birth_date"]), ("dob 45.12.1980", []), ("x" * 200000 + "@", []), ("1" * 100000 + "." * 1000, []), ("a@b.c@d.e", ["email"]), ("", []),
])
def test_confirmed_kinds(text, kinds):
    assert [k for k, *_ in pii.spans_of(text)] == kinds


def test_personal_data_of_odd_rows(spark):
    schema = "doc_id long, text string, spans int, kind string"
    docs = spark.createDataFrame([(1, None, 1, "k"), (2, "", 1, "k"), (3, "é a@b.cd", 1, "k"), (3, "é a@b.cd", 1, "k"), (None, "login from 1.2.3.4", 1, None)], schema)
    rows = pii.find_personal_data(docs).collect()
    assert sorted((r.doc_id or 0, [(s.kind, s.start, s.end, s.text) for s in r.spans]) for r in rows) == [(0, [("ip", 11, 18, "1.2.3.4")]), (1, []), (2, []), (3, [("email", 2, 8, "a@b.cd")]), (3, [("email", 2, 8, "a@b.cd")])]
    assert all(0.6 <= s.score <= 1 for r in rows for s in r.spans)
    out = pii.mask_personal_data(docs)
    assert out.columns == docs.columns and collections.Counter(r.text for r in out.collect()) == collections.Counter([None, "", "é <email>", "é <email>", "login from <ip>"])
    none = spark.createDataFrame([], schema)
    assert pii.find_personal_data(none).count() == 0 and pii.mask_personal_data(none).count() == 0


def mined(rows, is_anchor, positives=5, negatives=3):
    out = collections.Counter()
    for i, label, v in [r for r in rows if is_anchor(r[0])]:
        scored = [(-int(np.dot(v, w)), j, m) for j, m, w in rows if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out.update((i, p, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fits))
    return out


def embedded(seed, n, dim, spread, scale):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    return [(i, int(r.integers(0, 3)), [int(x) for x in np.floor(scale * (centres[i % 6] + spread * r.normal(size=dim)))]) for i in range(n)]


@pytest.mark.parametrize("spread,scale,block,group", [(0.05, 100, 40, 5), (1.0, 100, 1 << 17, 1 << 17), (0.3, 40_000_000, 64, 7), (3.0, 1, 30, 1 << 17)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, spread, scale, block, group):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", block)
    monkeypatch.setattr(hardneg, "GROUP_ANCHORS", group)
    monkeypatch.setattr(hardneg, "PACK_ANCHORS", 3)
    monkeypatch.setattr(hardneg, "STEP", 4)
    rows = embedded(3, 240, 8, spread, scale)
    rows[10] = (10, rows[10][1], [0] * 8)
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>").repartition(3)
    found = hardneg.mine_hard_negatives(frame, frame.where("vec_id % 10 = 0"))
    assert collections.Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined(rows, lambda i: i % 10 == 0)


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, [0.5, -0.25], 9), (8, [0.999, 0.0], 3), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, None, 1), (13, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (14, [], 1), (15, [1.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, vector string")
    assert sorted(tuple(r) for r in hardneg.usable(table).collect()) == [(7, 0, [128, -64]), (8, 3, [255, 0])]
    none = hardneg.usable(table.limit(0))
    assert none.count() == 0 and hardneg.mine_hard_negatives(none, none).count() == 0
    twice = spark.createDataFrame([(1, 0, [3, 4]), (1, 0, [3, 4]), (2, 0, [3, 4]), (2, 0, [3, 4]), (3, 1, [2, 2])], "vec_id long, label int, vector array<int>")
    assert sorted(tuple(r) for r in hardneg.mine_hard_negatives(twice, twice.where("vec_id = 1")).select("positive_id", "negative_id", "positive_score", "negative_score").collect()) == [(2, 3, 25, 14), (2, 3, 25, 14)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([1, 50, 10**6]))
def test_score_bounds_hold_and_runs_are_complete(seed, dim, scale):
    r = np.random.default_rng(seed)
    rows = np.floor(scale * r.normal(size=(30, dim)))
    refs = hardneg.fitted_references(rows, 4)
    if not len(refs):
        return
    norms, angles = hardneg.angles_to(rows, refs)
    block = hardneg.Block(0, np.arange(30), np.zeros(30, int), rows, norms, angles)
    for a in range(5):
        least, most = hardneg.score_bounds(norms[a], angles[a], block.norms, block.angles)
        scores = block.scores(np.arange(30), rows[a], norms[a])
        assert (least <= scores).all() and (scores <= most).all()
        for want in (-scale, 0, 1, int(np.median(scores)), int(scores.max())):
            lo, hi = block.run(norms[a], angles[a][0], want)
            assert not ((scores >= want) & ((np.arange(30) < lo) | (np.arange(30) >= hi))).any()


def test_runs_of_equal_scores_keep_smaller_ids(spark):
    rows = spark.createDataFrame([(i, i % 2, [10, 0]) for i in range(1, 21)] + [(50, 0, [10, 0])] + [(100 + i, 1, [7, i]) for i in range(6)], "vec_id long, label int, vector array<int>")
    out = hardneg.mine_hard_negatives(rows, rows.where(F.col("vec_id") == 50)).collect()
    assert {r.positive_id for r in out} == {2, 4, 6, 8, 10} and all(r.negative_id == 99 + r["rank"] and r.negative_score == 70 for r in out)
