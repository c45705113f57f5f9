"""The numbered operators on small tables: edge cases, and brute force where SQL can't express them."""

from __future__ import annotations

import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat, components, mixing, neardup, packing, quality, sharding, sketch, substring, suffix, url_filter, warc
from fieldloom.llm.textnum import mix, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard string, rule string"
BPE = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 7))) for _ in range(n)]


def corpus() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, near copies and shared passages; columns with clashing names."""
    base, passage = words(300, 1), words(60, 2)
    near = base.copy()
    near[150] = "changed"
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "b"), (3, " ".join(base), "en", None), (4, None, None, None), (5, "", "en", "a"), (6, " \n\t ", "en", "b"),
        (7, "one", "en", "a"), (7, "one", "en", "a"), (8, "käse é世 # $ 1", None, "a"), (9, " ".join(words(200, 3) + passage), "de", "a"), (10, " ".join(words(220, 4) + passage), "de", "c"),
        (None, " ".join(words(40, 5)), "en", "a"), (None, None, "en", "a"), (11, " ".join(words(6000, 6)), "fr", "hot"), (12, "line\nline\n\nline x\n" * 40, "en", "hot"),
        (13, "x" * 3000, "en", "hot"), (14, "don't we'll <|endoftext|> end", "en", "hot"),
    ]
    return [(*r, len(r[1] or ""), 1, "s", "r") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_chat(spark):
    turns = [(1, 0, "system", "be good"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye"), (2, 0, "system", "x"), (None, None, None, "é!"), (3, 1, "u", "same"), (3, 1, "u", "same")]
    df = spark.createDataFrame([(*t, "extra", "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, speaker string, part string")
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (None, "unknown", -1), (3, "u", 0)}
    one = got[1, "ann", 0]
    assert one.rendered == "<|im_start|>system\nbe good<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [one.rendered[m.start : m.end] for m in one.mask] == ["hi<|im_end|>\n"] and one.n_chars == len(one.rendered)
    assert got[1, "bob", 0].rendered.count("assistant") == 1 and got[3, "u", 0].n_turns == 2
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.org", "/en/1", "block"), ("tie.com", "/", "allow"), ("tie.com", "/", "block")], "host string, path string, verdict string")
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "notexample.org/es/", "http://myexample.org/es/", "http://x.org", "http://tie.com/", None, "", "a://É.org/#", "http://b.org/" + "p" * 20000, "x://y://z.org/"]
    got = [r for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls * 2)], "page_id int, url string, rule string"), rules).orderBy("page_id").collect()]
    assert len(got) == 2 * len(urls)
    seen = [(r.host, r.path[:8], r.rule, r.verdict) for r in got[: len(urls)]]
    assert seen == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("", "", None, "allow"), ("myexample.org", "/es/", "org/", "allow"),
        ("x.org", "", None, "allow"), ("tie.com", "/", "tie.com/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("É.org", "/", "org/", "allow"), ("b.org", "/ppppppp", "org/", "allow"), ("y:", "//z.org/", None, "allow"),
    ]
    empty = url_filter.judge_urls(spark.createDataFrame([("u",)], "url string"), rules.limit(0)).first()
    assert empty.rule is None and empty.verdict == "allow"


def test_url_digest_prefixes_confirm(spark):
    r = url_filter._prefix(F.lit("ffffffff" + "0" * 56))
    assert spark.range(1).select(r).first()[0] == 0xFFFFFFFF


@pytest.mark.parametrize("bands", [24])
def test_near_duplicates(spark, docs, none, bands):
    got = neardup.near_duplicate_classes(docs, bands=bands).collect()
    assert len(got) == len(corpus())
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.class_id, r.class_size))
    assert by[1] == by[2] == by[3] == {(1, 3)} and by[7] == {(7, 2)} and by[9] != by[10]
    assert by[4] == by[5] == {(4, 3)}  # null and empty texts are equal
    kept = neardup.keep_one_of_each_class(docs).collect()
    assert len(kept) == len({c for r in by.values() for c in r}) and sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    assert kept[0].__fields__ == docs.columns
    assert neardup.near_duplicate_classes(none).count() == 0


def test_near_duplicates_against_brute_force(spark):
    r, rows = random.Random(3), []
    for f in range(12):
        base = words(150 + 40 * f, 100 + f)
        rows.append((len(rows), " ".join(base)))
        for _ in range(8):
            copy = base.copy()
            for _ in range(r.randint(0, 9)):
                copy[r.randrange(len(copy))] = r.choice(["new", "odd", "other"])
            rows.append((len(rows), " ".join(copy)))
    def cells(t):
        w = WORDS.findall(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return {(k, j) for k, n in c.items() for j in range(n)}
    sets = [cells(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {x.doc_id: x.class_id for x in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_of_a_template_against_brute_force(spark):
    r, base, rows = random.Random(1), words(200, 40), []
    for _ in range(700):  # four passages left out, and one of them moved by four words: similar to each other, rarely to the rest
        at = [r.randrange(194) for _ in range(4)]
        for move in (0, r.choice([-4, 4])):
            cut = {x for p in [min(194, max(0, at[0] + move)), *at[1:]] for x in range(p, p + 6)}
            rows.append((len(rows), " ".join(w for k, w in enumerate(base) if k not in cut)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert len({find(i) for i in range(len(rows))}) > 100
    got = {x.doc_id: x.class_id for x in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_leave_out_edits_of_one_text(spark, monkeypatch):
    r, base, rows = random.Random(5), words(300, 41), []
    for k in range(300):  # 5 to 24 words replaced by words of the text's own, and a second edit of some of them
        copy = base.copy()
        for j in range(r.randint(5, 24)):
            copy[r.randrange(300)] = f"own{k}x{j}"
        rows.append((len(rows), " ".join(copy)))
        if k % 3 == 0:
            for j in range(9):
                copy[r.randrange(300)] = f"more{k}x{j}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    stored, made = neardup.written, {}
    def written(df, what):
        out = stored(df, what)
        if what in ("pivot-members", "pivot-prefixes"):
            made[what] = out.agg({"first": "sum"} if what == "pivot-members" else {"*": "count"}).first()[0]
        return out
    monkeypatch.setattr(neardup, "written", written)
    got = {x.doc_id: x.class_id for x in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and len(set(got.values())) > 50
    assert made["pivot-members"] > 10_000 and made["pivot-prefixes"] < made["pivot-members"] / 2, made


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    h = mix(rng.integers(0, 2**63, 900, dtype=np.uint64))
    a, b = np.concatenate([h[:600], h[:100]]), np.concatenate([h[300:900], h[300:350]])
    both = np.concatenate([a, b])
    row = np.repeat([0, 1], [len(a), len(b)])
    sig = neardup.dart_signatures(*neardup.cells(both, row), 2, 4000)
    ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03 and np.isfinite(sig).all()
    alone = neardup.dart_signatures(*neardup.cells(h[:1], np.zeros(1, int)), 2, 64)
    assert np.isfinite(alone[0]).all() and np.isinf(alone[1]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 201)] + [(300, k) for k in range(301, 340)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 205: 200, **{k: 300 for k in range(300, 340)}}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_warc(spark, tmp_path):
    big, small = "<p>é世</p>\r\n\r\nWARC/1.1\r\n" * 80, "tiny"
    pages = [(1, "http://a.org/x\ny", big), (2, "http://b.org/", big), (3, None, big), (4, "http://c.org/", small), (5, "http://c.org/", small), (6, "u", None), (None, "http://n.org", "z" * 2000), (2, "http://b.org/", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, payload string").select("page_id", "url", "html")
    found = warc.round_trip(df).collect()
    twice = [r for r in found if r.metadata[0].fields.strip() == "page-id: 2"]
    assert len(found) == 8 and len({r.capture_id for r in found}) == 8 and [r.response.kind for r in twice] == ["revisit", "revisit"]
    got = {r.metadata[0].fields.strip(): r for r in found}
    assert len(got) == 7
    last = warc.round_trip(spark.createDataFrame([(9, "u", "y" * 1500)] * 3, "page_id bigint, url string, html string")).collect()
    assert sorted(r.response.kind for r in last) == ["response", "revisit", "revisit"] and all(r.original is not None for r in last if r.response.kind == "revisit")
    kinds = {k: (r.response.kind, r.original and r.original.payload_sha1, len(r.requests)) for k, r in got.items()}
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert kinds["page-id: 3"] == ("response", None, 1) and kinds["page-id: 1"] == kinds["page-id: 2"] == ("revisit", sha, 1) and kinds["page-id: 5"][0] == "response"
    assert got["page-id: 6"].response.payload_bytes == 0 and got["page-id:"].response.payload_bytes == 2000
    warc.write_archives(df, str(tmp_path / "w"), "2020-01-01T00:00:00Z")
    payloads = [bytes(r.payload).decode() for r in warc.read_records(spark, str(tmp_path / "w")).where("kind = 'response'").collect()]
    assert sorted(payloads) == sorted([big, small, small, "", "z" * 2000])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_assembly_of_odd_records(spark):
    rows = [("r1", "response", [], None), ("q1", "request", ["r1"], None), ("m1", "metadata", ["r1"], None), ("q1", "request", ["r1"], None), ("r2", "revisit", ["q2"], "gone"), ("q2", "request", [], None), ("q3", "request", ["nowhere"], None), ("i", "warcinfo", [], None)]
    df = spark.createDataFrame([(a, b, c, d, None) for a, b, c, d in rows], "record_id string, kind string, concurrent_to array<string>, refers_to string, payload_sha1 string")
    got = {r.capture_id: (r.response and r.response.kind, [x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []], r.original) for r in warc.assemble_transactions(df).collect()}
    assert got == {"r1": ("response", ["q1"], ["m1"], None), "r2": ("revisit", ["q2"], [], None), "q3": (None, ["q3"], [], None)}


def test_sharding(spark, docs, none):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(4000)] + [(5, "same row")] * 500
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, k1 string")
    out = sharding.histogram_shards(df, 24, "text", F.octet_length("text") + 8, [F.col("doc_id")], ["doc_id"]).toPandas()
    assert len(out) == len(rows)
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() / size.mean() < 1.02 and size.min() / size.mean() > 0.98
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    few = sharding.histogram_shards(docs, 24, "text", F.coalesce(F.octet_length("text"), F.lit(0)) + 8, [F.col("doc_id")], ["doc_id"]).toPandas()
    assert len(few) == len(corpus()) and all(sorted(g) == list(range(len(g))) for _, g in few.groupby("shard")["slot"])
    assert sharding.histogram_shards(none, 24, "text", F.lit(8), [F.col("doc_id")], ["doc_id"]).count() == 0


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    own, lib, r = packing.WordTokenizer(BPE), Tokenizer.from_file(BPE), random.Random(5)
    alphabet = "ab'sdmtrevl 1 2 \n\t\r\x0b!.é  ñ'\"世#́\x1c\x85"
    texts = ["", "  ", "a  b", "it's we're I'll ''s 's's", "x \n\n y ", "<|endoftext|>hi", "'", "'ll"] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    import pyarrow as pa

    from fieldloom.llm.textnum import text_buffers

    got = own.encode(*text_buffers(pa.array(texts)))
    assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    out = packing.pack_documents(docs, BPE, with_ids=True).toPandas()
    want = collections.Counter()
    for d, t, *_ in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, min(first, len(ids)))] + [(x, x + 1024) for x in range(first, len(ids), 1024)]):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    none_if = lambda x: None if x != x else int(x)
    assert collections.Counter((none_if(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()) == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 1
    assert packing.pack_documents(none, BPE).count() == 0


@pytest.mark.parametrize("low, high", [(300, 400), (1, 1024), (200, 520), (1, 30)])
def test_local_search_keeps_pieces_and_saves_bins(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 800)
    before = packing.best_fit(lengths, 1024)
    after = packing.local_search(before, lengths, 1024)
    assert sorted(i for b in after for i in b) == list(range(800)) and all(lengths[b].sum() <= 1024 for b in map(np.array, after))
    assert -(-lengths.sum() // 1024) <= len(after) <= len(before)


def test_mixing(spark, docs, none):
    out = mixing.mix_report(docs).toPandas()
    assert len(out) == len(corpus())
    want = {d: len(WORDS.findall(t or "")) for d, t, *_ in corpus() if d}
    assert all(want[r.doc_id] == r.size for r in out.dropna(subset="doc_id").itertuples())
    assert (out.taken <= 3 * out["size"]).all() and (out.taken[out["size"] == 0] == 0).all()
    again = mixing.mix_report(docs.repartition(2)).toPandas()
    order = ["doc_id", "size", "source_size", "taken"]
    assert out[order].sort_values(order).values.tolist().__repr__() == again[order].sort_values(order).values.tolist().__repr__()
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0
    mixed = mixing.mix_documents(docs).toPandas()
    got = mixed.groupby("doc_id").text.apply(lambda x: sum(len(WORDS.findall(t)) for t in x))
    taken = out.dropna(subset="doc_id").groupby("doc_id").taken.sum()
    assert got.to_dict() == taken[taken > 0].to_dict() and (mixed.n_chars == mixed.text.str.len()).all()


def test_water_fill_and_draws():
    sizes = [100, 5000, 10, 0, 800]
    t = mixing.water_fill(sizes, [1, 2, 3, 1, 2], sum(sizes), 3)
    assert abs(sum(t) - sum(sizes)) < 1e-6 and all(a <= 3 * b + 1e-9 for a, b in zip(t, sizes, strict=True)) and t[0] == 300 and t[2] == 30
    counts = mixing.draw_counts([10, 1000, 0, 7], 16, 1)
    assert counts.sum(axis=0).tolist() == [10, 1000, 0, 7] and counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))) == list(range(n))


def test_quality(spark, docs, none):
    got = quality.judge_quality(docs).collect()
    assert len(got) == len(corpus())
    def repeats(w):
        g = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)})
    want = collections.Counter()
    for d, t, *_ in corpus():
        w = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want[d, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), repeats(w), len(w) < 50 or 100 * repeats(w) > 50 * len(w)] += 1
    assert collections.Counter(tuple(r)[:7] for r in got) == want and not any(r.kept and r.base_failed for r in got)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(r.doc_id for r in quality.keep_good_documents(docs).collect())
    assert quality.judge_quality(none).count() == 0 and quality.keep_good_documents(none).columns == docs.columns


def test_jensen_shannon(spark):
    r = spark.createDataFrame([([1, 0], [0, 1]), ([2, 2], [1, 1]), ([0, 0], [1, 1])], "p array<bigint>, q array<bigint>").select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()
    assert [x[0] for x in r] == [1.0, 0.0, None]


def test_sketches(spark, docs, none, monkeypatch):
    monkeypatch.setattr(sketch, "ROWS_A_RANGE", 4)
    got = sketch.fingerprints_with_edits(docs).collect()
    assert len(got) == len(corpus())
    order = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len({r.fingerprint for r in got if r.doc_id in (1, 3)}) == 1
    by = {r.doc_id: r for r in got}
    for (d, t, *_), (_, n, *_) in zip(order, order[1:], strict=False):
        if d in (2, 3, 8, 9, 10, 11, 13):  # ids without ties, before one
            t, n = t or "", n or ""
            cut = len(t) // 3
            assert by[d].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest() and by[d].n_chars == len(t)
    assert by[4].near_edited == 1.0 and by[2].near_next > 0 and by[3].near_next > 0.9
    assert sketch.fingerprints_with_edits(none).count() == 0
    one = sketch.fingerprints_with_edits(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_sketch_columns(spark):
    a, b = words(400, 8), words(400, 9)
    texts = [" ".join(a), " ".join(a[:200] + b[:200]), " ".join(a + b)]
    prints = [sketch.to_text(x) for x in sketch.sketch_texts([t.encode() for t in texts])]
    r = spark.createDataFrame([tuple(prints)], "a string, b string, c string").select(sketch.resemblance(F.col("a"), F.col("b")), sketch.containment(F.col("a"), F.col("c")), sketch.merged(F.col("a"), F.col("b")), sketch.containment(F.col("b"), F.col("a"))).first()
    assert abs(r[0] - 196 / 596) < 0.15 and r[1] > 0.9 and len(r[2]) == 128 * 16 and abs(r[3] - 0.49) < 0.2
    h, _ = shingles(np.frombuffer(texts[0].encode() + texts[1].encode(), np.uint8), np.array([0, len(texts[0].encode()), len((texts[0] + texts[1]).encode())]))
    assert r[2] == sketch.to_text(np.unique(h)[:128])


@pytest.mark.parametrize("raw", [b"ab\0\0", b"\0" * 20, b"banana\0\0\0", b"a\0b\0\0a\0", bytes(random.Random(1).choices(b"\0\1", k=300))])
def test_suffix_array_with_zero_bytes(raw):
    order = suffix.suffix_array(np.frombuffer(raw, np.uint8))
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))


def test_substrings_with_zero_characters(spark):
    passage = " ".join(words(30, 77))
    rows = [(i, f"{' '.join(words(20, 500 + i))} {passage}" + "\0" * (i % 5)) for i in range(60)] + [(100, "\0" * 200), (101, "\0" * 130 + "x"), (102, "a" + "\0" * 60)]
    assert removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == brute_removed(rows)


def test_substrings_leave_callers_columns(spark):
    passage = " ".join(words(40, 78))
    rows = [(1, f"one {passage}", "a", "b"), (2, f"two {passage}", "c", "d"), (2, f"two {passage}", "c", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rid string, block string")
    out = substring.remove_repeats(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.rid, r.block) for r in out] == [(1, "a", "b"), (2, "c", "d"), (2, "c", "d")] and out[0].text == rows[0][1] and len(out[1].text) < 10
    assert removed(df) == brute_removed([r[:2] for r in rows])


@pytest.mark.parametrize("n, letters", [(0, 2), (1, 2), (9, 1), (70, 1), (300, 2), (500, 20)])
def test_suffix_array(n, letters):
    data = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    raw, order = data.tobytes(), suffix.suffix_array(data)
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))
    if n:
        shared = suffix.common_prefixes(data, order, 50)
        for i in range(1, n):
            a, b = raw[order[i - 1] :], raw[order[i] :]
            k = next((j for j in range(min(len(a), len(b), 50)) if a[j] != b[j]), min(len(a), len(b), 50))
            assert shared[i] == k


def test_prefixes_of_an_order_of_bounded_depth():
    for seed in range(20):
        r = np.random.default_rng(seed)
        pool = [r.integers(97, 101, int(r.integers(60, 200))).astype(np.uint8) for _ in range(4)]
        raw = b"".join(pool[r.integers(4)][: r.integers(50, 200)].tobytes() + r.integers(97, 101, int(r.integers(6))).astype(np.uint8).tobytes() for _ in range(12))
        data = np.frombuffer(raw, np.uint8)
        order = suffix.suffix_array(data, 50)
        shared = suffix.common_prefixes(data, order, 50)
        assert [bool(s >= 50) for s in shared[1:]] == [len(raw[a : a + 50]) == 50 and raw[a : a + 50] == raw[b : b + 50] for a, b in zip(order[:-1], order[1:], strict=True)]


def brute_removed(rows):
    first = {}
    rows = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in rows:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((None if d == float("inf") else d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return collections.Counter(out)


def removed(df, hot=None):
    got = substring.deduplicate_substrings(df, hot).collect()
    return collections.Counter((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), len(r.starts), r.kept_sha256) for r in got)


@pytest.mark.parametrize("hot, block", [(None, 4 << 20), (3, 3000)])
def test_substrings_against_brute_force(spark, docs, none, monkeypatch, hot, block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    assert removed(docs, hot) == brute_removed([r[:2] for r in corpus()])
    r, parts = random.Random(7), [" ".join(words(25, s)) for s in range(12)]
    rows = [(i // 2 if i % 5 == 0 else i, "é".join(r.choice(parts)[r.randint(0, 60) :] for _ in range(r.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert removed(df, hot) == brute_removed(rows)
    assert substring.deduplicate_substrings(none).count() == 0


def test_windows_of_hot_anchors_make_no_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 30_000)
    held, by_window = [], substring._by_window
    monkeypatch.setattr(substring, "_by_window", lambda around, n: held.append(by_window(around, n)) or held[-1])
    r, passage = random.Random(11), " ".join(words(60, 79))
    rows = [(i, f"{' '.join(words(25, 700 + i))} {passage[r.randint(0, 90) :]}") for i in range(200)]
    assert removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 3) == brute_removed(rows)
    assert "Generate" not in held[0]._jdf.queryExecution().optimizedPlan().toString()


def test_remove_repeats_keeps_columns(spark, docs, none):
    out = substring.remove_repeats(docs).collect()
    assert out[0].__fields__ == docs.columns and all(r.n_chars == len(r.text or "") for r in out)
    ids = [r.doc_id for r in out]
    assert 3 not in ids and 1 in ids and 4 in ids and len([i for i in ids if i == 7]) == 2
    assert substring.remove_repeats(none).count() == 0


def test_anchors_are_dealt_over_all_ranges(spark):
    rows = [(i, " ".join(words(300, 900 + i))) for i in range(40)]
    blocks = substring._gather(spark.createDataFrame(rows, "order_id bigint, text string").withColumn("rid", F.col("order_id")))
    sent = substring._send_anchors(blocks, 8).toPandas()
    assert set(sent["range"]) == set(range(8))
    n = sent.groupby("range")["keys"].apply(lambda x: sum(map(len, x)))
    assert n.max() < 2 * n.min()


def test_no_operator_touches_callers_columns(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(70))
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (3, text + " end", "en")], "doc_id long, text string, lang string")
    names = ["substring_row", "n_cut", "N_CUT_", "near_node", "kept_node", "kept_id", "rejected_key", "rejected_lang", "won", "__key", "node", "root"]
    for n, name in enumerate(names):
        if name not in ("N_CUT_",):
            docs = docs.withColumn(name, F.lit(n))
    for out in (substring.remove_repeats(docs), neardup.keep_one_of_each_class(docs), quality.keep_good_documents(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[name] == n for r in rows for n, name in enumerate(names) if name != "N_CUT_")
    pages = spark.createDataFrame([("http://a.org/x", 7)], "url string, won int")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    assert [(r.won, r.verdict, r.rule) for r in url_filter.judge_urls(pages, rules).collect()] == [(7, "block", "org/")]


def test_warc_archives_of_any_name(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/http\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "CC-MAIN-1.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"x:1", b"x:2")))
    (tmp_path / "plain.warc").write_bytes(record.replace(b"x:1", b"x:3"))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    found = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in found) == ["<urn:x:1>", "<urn:x:2>", "<urn:x:3>"] and {bytes(r.payload) for r in found} == {b"hello"}
