"""Lexical search, best-fit packing and vector codes against brute force, SQL and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from neuroloom.llm import best_fit, lexical_search, registry, vector_codes

from .data import TEXTS, table
from .test_corpus import sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, tables", [("op11_lexical_search", ("documents", "benchmark")), ("op13_vector_codes", ("embeddings",))])
def test_registered_queries_against_sql(spark, name, tables):
    names, want = sql(registry.oracle_sql()[name], *tables)
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want)


# -- lexical search


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_search(docs, items, k):
    docs = [(d, Counter(words(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x for _, _, x in docs)
    out = []
    for item, text in items:
        asked, found = Counter(words(text)), []
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c, _ in docs) + 1))) for t in asked}
        for d, c, size in docs:
            m = 75 + 25 * size * n // total
            s = sum(q * weight[t] * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return Counter(out)


ITEMS = [(1, "one two three same text"), (2, None), (3, ""), (None, "Über word"), (5, "SAME same text here"), (5, "e a b card 4111 phone"), (7, "nowhere at-all"), (8, "ÜBER Über über 555")]


@pytest.mark.parametrize("settings", [{}, {"k": 3, "fan": 2, "range_docs": 4, "block_items": 3}, {"k": 1, "fan": 3, "range_postings": 5, "block_bytes": 1}])
def test_search_against_brute_force(spark, settings):
    docs = table(spark, TEXTS + ["same text here"] * 40 + [f"word{i % 7} same e{i % 3} a" for i in range(60)]).repartition(3)
    items = spark.createDataFrame([(*r, "x", 3) for r in ITEMS], "item_id int, text string, doc_id string, rank int")
    got = lexical_search.search(docs, items, **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search([(r.doc_id, r.text) for r in docs.collect()], ITEMS, settings.get("k", 20))


def test_search_on_empty_tables(spark):
    docs, items = table(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


def test_search_opens_few_nodes_and_ties_only_for_lesser_ids():
    rng = np.random.default_rng(3)
    n = 4096
    doc, code = np.repeat(np.arange(n), 3), rng.integers(0, 50, 3 * n)
    key = np.unique(doc * 50 + code)
    doc, code = key // 50, key % 50
    impact = rng.integers(1, 1000, len(key)) * np.where(doc // 64 == 17, 100, 1)  # what matters lies close together
    tree = lexical_search.MaxTree(rng.permutation(n), doc, code, impact, 16)
    none = np.zeros(0, np.int64)
    (scores, ids), opened = tree.search(np.arange(8), np.ones(8, np.int64), 5, (none, none))
    total = np.bincount(doc, impact * (code < 8), n).astype(np.int64)
    assert scores.tolist() == sorted(total.tolist(), reverse=True)[:5] and opened < 30 < n // 16
    same = lexical_search.MaxTree(np.arange(n), np.arange(n), np.zeros(n, np.int64), np.full(n, 7), 16)
    (scores, ids), opened = same.search(np.zeros(1, np.int64), np.ones(1, np.int64), 5, (none, none))
    assert ids.tolist() == [0, 1, 2, 3, 4] and opened == 3


def test_document_length_beyond_64_bits():
    n = np.array([1, 10**6])
    assert lexical_search.lengths(n, 10**12, 10**15).tolist() == [75 + 25 * 10**12 * x // 10**15 for x in n.tolist()]


# -- best-fit packing


def checked(runs, counts, length):
    held = Counter()
    for times, content in runs:
        assert times > 0 and sum(s * n for s, n in content) <= length
        for s, n in content:
            held[s] += times * n
    assert held == {s: n for s, n in counts.items() if n}
    return sum(n for n, _ in runs)


def fewest_by_search(sizes, length):
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] >= sizes[i]:
                put(i + 1, [*bins[:j], bins[j] - sizes[i], *bins[j + 1 :]])
        put(i + 1, [*bins, length - sizes[i]])

    put(0, [])
    return best


def test_plans_hold_all_pieces_in_few_sequences():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = sorted(rng.integers(1, 33, rng.integers(1, 10)).tolist(), reverse=True)
        counts = Counter(sizes)
        for setting in best_fit.SETTINGS:
            checked(best_fit.plan(counts, 32, *setting), counts, 32)
        assert checked(best_fit.fewest(counts, 32, best_fit.SETTINGS), counts, 32) <= fewest_by_search(sizes, 32) + 1
    for sizes in (rng.integers(1, 1025, 5000), rng.integers(300, 700, 5000), np.full(9999, 3), np.array([1024, 1, 512] * 9), np.clip(rng.lognormal(5, 1, 5000), 1, 1024).astype(int)):
        counts = Counter(sizes.tolist())
        assert checked(best_fit.fewest(counts, 1024, best_fit.SETTINGS), counts, 1024) <= 1.01 * sizes.sum() / 1024 + 2
    assert best_fit.fewest({}, 1024, best_fit.SETTINGS) == []


def test_configurations_beat_greedy_packing():
    parts = [x for i in range(300) for a in (200 + i % 97, ) for b in (250 + i % 61, ) for x in (a, b, 1024 - a - b)]  # 300 sequences without a gap
    counts = Counter(parts)
    greedy = checked(best_fit.plan(counts, 1024, 1, 2), counts, 1024)
    assert checked(best_fit.plan(counts, 1024, 128, 1 / 8), counts, 1024) < greedy


def test_groups_have_equal_cardinality_and_round_up():
    got = best_fit.grouped({10: 5, 9: 1, 8: 4, 7: 2}, 4)
    assert [(s, sum(n for _, n in c)) for s, c in got] == [(10, 6), (8, 6)]
    assert all(s >= max(x for x, _ in c) for s, c in got)
    assert sum(n for _, c in got for _, n in c) == 12


def test_best_fit_packing_whole(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = TEXTS + ["same text here"] * 300 + [f"w{i} " * (7 * i % 501) for i in range(200)] + ["long story " * 4000]
    docs = table(spark, texts).repartition(3)
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for length in (1024, 16):
        rows = best_fit.pack_best_fit(docs, path, length=length, with_ids=True).collect()
        seqs, held = {}, Counter()
        for r in rows:
            assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
            assert 0 < r.length <= length and (r.length == length or r.piece == 0)
            seqs.setdefault(r.sequence_id, []).append(r)
            held[r.doc_id, r.piece, r.start, tuple(r.ids)] += 1
        want = Counter()
        for d, t in docs.select("doc_id", "text").collect():
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            first = (len(ids) - 1) % length + 1
            for k in range((len(ids) - 1) // length + 1):
                a, z = (0, first) if k == 0 else (first + (k - 1) * length, first + k * length)
                want[d, k, a, tuple(ids[a:z])] += 1
        assert held == want
        for rs in seqs.values():
            at = 0
            for r in sorted(rs, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= length
        assert len(seqs) <= 1.02 * sum(r.length for r in rows) / length + 2
    assert best_fit.pack_best_fit(docs.limit(0), path).collect() == []


# -- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    out = []
    for dim in {len(v) for _, v, _ in rows}:
        own = [(i, [max(-(1 << 26), min(1 << 26, math.floor(4096 * x))) for x in v], label) for i, v, label in rows if len(v) == dim]
        cut = [p * dim // parts for p in range(parts + 1)]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, [vector_codes.packed(np.array([r[1][a:z]], np.int64))[0] for a, z in zip(cut, cut[1:])]))
        codes, errors, text = [""] * len(own), [0] * len(own), []
        for a, z in zip(cut, cut[1:]):
            x = [r[1][a:z] for r in own]
            book = [list(y) for y in x[:entries]]
            near = lambda y: min((sum((p - q) ** 2 for p, q in zip(y, b)), e) for e, b in enumerate(book))  # noqa: E731, B023
            for _ in range(rounds):
                at = [near(y)[1] for y in x]
                for e in range(len(book)):
                    mine = [y for y, i in zip(x, at) if i == e]
                    if mine:
                        book[e] = [sum(c) // len(mine) for c in zip(*mine)]
            for i, y in enumerate(x):
                d, e = near(y)
                codes[i] += "%02x" % e
                errors[i] += d
            text += [str(c) for b in book for c in b]
        sha = hashlib.sha256(",".join(text).encode()).hexdigest()
        out += [(r[0], c, e, sha, r[2]) for r, c, e in zip(own, codes, errors)]
    total = Counter()
    for _, _, e, _, label in out:
        total[label] += e
    return Counter((i, c, e, total[label], sha) for i, c, e, sha, label in out)


def test_vector_codes_on_odd_rows(spark):
    rng = np.random.default_rng(11)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i), rng.integers(-3, 4, 16).astype(float).tolist() if i % 3 else [0.5] * 16, int(i) % 4 if i % 5 else None) for i in range(200)]
    rows += [(5, [1.5] * 16, 1), (5, [1.5] * 16, 1), (None, [9.0] + [0.25] * 15, 2), (300, [20.0] * 16, 2), (301, [], 1), (302, [0.1, 0.2, 0.3], None), (303, [-8.001] * 16, 3), (304, [1e300] + [-1e300] * 15, 3)]
    bad = [(400, None, 1), (401, [1.0, None] * 8, 1), (402, [nan] * 16, 2), (403, [1.0] * 15 + [inf], None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, row int").repartition(3)
    got, books = vector_codes.compress(df)
    assert Counter(map(tuple, got.collect())) == plain_codes(rows)
    assert books[16, 0].shape == (16, 2)
    for more in ({"shared": 3}, {"labels": 1}, {"shared": 10**9}):  # all joins, whatever is broadcast
        assert Counter(map(tuple, vector_codes.compress(df, **more)[0].collect())) == plain_codes(rows)
    texts = df.withColumn("label", df["label"].cast("string"))
    assert Counter(map(tuple, vector_codes.compress(texts)[0].collect())) == plain_codes(rows)
    assert vector_codes.compress(df.limit(0))[0].collect() == []
    assert vector_codes.compress(df.where("vec_id >= 400"))[0].collect() == []


def test_few_vectors_and_exact_distances():
    rows, entries = np.array([[3, 4], [0, 0]], np.int64), np.array([[0, 0], [0, 0], [3, 5]], np.int64)
    assert [x.tolist() for x in vector_codes.nearest(rows, entries)] == [[2, 0], [1, 0]]
    far = np.array([[1 << 26, -(1 << 26)]], np.int64)
    assert vector_codes.nearest(far, -far + 1)[1].tolist() == [((1 << 27) - 1) ** 2 + ((1 << 27) + 1) ** 2]
