"""Operators that need the whole corpus, against brute force or SQL."""

import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from neuroloom.llm import components, language_model, ngram_join, vector_dedup

from .data import TEXTS, table

SF = "/root/testdata/sf0.001"


def sql(text, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(text)
    return [d[0] for d in rel.description], rel.fetchall()


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7), (200, 300), (300, 250), (300, 200), (-5, 300)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    nodes = {n for e in edges for n in e}
    assert {r.id: r.component for r in components.components(df).collect()} == plain_components(nodes, edges)
    assert components.components(df.limit(0)).collect() == []


def words(t, ):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def shingles(t, k):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_join(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = plain_components(range(len(rows)), edges)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(least.get(comp[i], d), d)
    return Counter((d, len(s), least.get(comp[i])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies():
    base = [f"w{i * i % 97}x{i % 13}" for i in range(120)]
    out = []
    for k in range(40):
        w = list(base)
        for j in range(k % 5):
            w[(17 * k + 31 * j) % 120] = f"new{k}{j}"
        out.append(" ".join(w))
    shared = " ".join(base[:60])
    return out + [shared + " " + " ".join(f"u{i}v{k}" for i in range(25 * (k + 1))) for k in range(8)] + ["A b", "a  B", "a b c d", "a b c d e", "a b c d"]


@pytest.mark.parametrize("width,percent,sizes", [(4, 85, {}), (5, 80, {"chunk": 5, "most_rows": 3, "most_entries": 400}), (3, 60, {"chunk": 2, "most_rows": 2, "near": 1})])
def test_ngram_join(spark, width, percent, sizes):
    odd = table(spark, TEXTS + near_copies() + TEXTS[-4:])
    for df in (odd.repartition(5), spark.read.parquet(f"{SF}/documents.parquet"), odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = Counter(tuple(r) for r in ngram_join.similar_documents(df, width, percent, **{"common": 20, "near": 2, **sizes}).collect())
        assert got == plain_join(rows, width, percent)


def test_word_hashes():
    """Hashes depend on the lower-cased word alone, wherever it stands."""
    import numpy as np

    raw = ["A b\tlonger-than-eight-bytes É", "", "  x", "b a longer-than-eight-byteS", "é É longer-than-eight-bytes ", "a\x0b\x0cb\x00 b"]
    data = [t.encode() for t in raw]
    edges = np.cumsum([0, *map(len, data)])
    h, at = ngram_join.word_hashes(np.frombuffer(b"".join(data), np.uint8), edges)
    found = {}
    assert list(np.diff(at)) == [len(words(t)) for t in raw]
    for x, w in zip(h.tolist(), [w for t in raw for w in words(t)], strict=True):
        assert found.setdefault(w, x) == x
    assert len(set(found.values())) == len(found)


def test_products():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.permutation(4000).astype(np.uint64)
    grams = [np.sort(rng.choice(base[: 40 * (1 + k % 3)], 20 * (1 + k % 3), replace=False)) for k in range(30)]
    over = lambda a, b: 100 * (k := len(np.intersect1d(a, b))) >= 40 * (len(a) + len(b) - k)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if over(grams[i], grams[j])}
    assert want and len(want) < 400
    for width in (7, 4096):
        assert set(zip(*map(np.ndarray.tolist, ngram_join.products(grams, 40, 0, width)))) == want
        assert set(zip(*map(np.ndarray.tolist, ngram_join.products(grams, 40, 10, width)))) == {(i, j) for i, j in want if i < 10 <= j}


def test_bucket_counts_bound_from_below():
    """Of sets of all sizes, counted in as many or in twice as many buckets."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2)
    sets = [np.sort(rng.choice(base, n, replace=False)) for n in (5, 900, 1500, 1530, 1540, 1700, 2900, 3080, 3100, 3999)]
    edges = np.cumsum([0, *map(len, sets)])
    bounds = ngram_join.Bounds(np.arange(10), np.diff(edges), pa.chunked_array([ngram_join.bucket_counts(np.concatenate(sets), edges)]), 85)
    p, q = np.triu_indices(10)
    true = [len(np.setxor1d(sets[i], sets[j])) for i, j in zip(p, q)]
    assert len(bounds.of) == 3 and (bounds.differences(p, q) <= true).all() and (bounds.differences(p, p) == 0).all()


def test_ngram_query_matches_sql(spark):
    got = sorted(tuple(r) for r in ngram_join.op5_ngram_join(spark, SF).collect())
    assert got == sorted(sql(ngram_join.OP5_SQL, "documents")[1])


def test_one_of_each(spark):
    odd = table(spark, TEXTS + near_copies())
    kept = ngram_join.one_of_each(odd, 4, 85)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = plain_join([(r.doc_id, r.text) for r in odd.collect()], 4, 85)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _, c in want if d is not None and d == c)
    assert any(r.doc_id is None for r in kept.collect())


def plain_scores(rows, seed=None):
    lower = [[*words(t), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for ws, h in zip(lower, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(d, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws, h in zip(rows, lower, held)]


def test_language_model(spark):
    odd = table(spark, TEXTS)
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet"), odd.limit(0)):
        got = language_model.score(df).collect()
        want = plain_scores([(r.doc_id, r.text) for r in df.collect()])
        key = lambda r: tuple((x is not None, x) for x in r[:4])
        for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and a[6] <= 0
    got = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b  # held-out texts are likelier than by the base


def test_language_model_is_a_distribution(spark):
    """In every context, met or not, the probabilities of all known words, the end and one unknown word sum to 1."""
    import numpy as np
    import xxhash
    from pyspark.sql import functions as F

    corpus = ["a b a c b", "b a", "c c c a b", "a"] + ["a b"] * 40
    rows = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = {"strength": 5.0, "discount": 0.7, "parent_strength": 5.0, "parent_discount": 0.6}
    probe = [" ".join(f"{u} {w}" for w in ("a", "b", "c", "unknown")) + f" {u}" for u in ("a", "b", "c", "unknown")] + ["", "a", "b", "c", "unknown"]
    table = language_model.kept(language_model.requests(rows(corpus + probe), F.col("doc_id") >= len(corpus), 8), "lm-blocks", by="kind")
    asked, state, kept = language_model.fitted(table, 8, 2, model, 1, 2, 11)
    hashed = {xxhash.xxh64_intdigest(w.encode()): w for w in ("", "a", "b", "c", "unknown")}
    hashes = {(r.block, r.bucket): [hashed[int(h)] for h in np.frombuffer(r.a, "<u8")] for r in table.where("kind = 1").collect()}
    sums: dict = {}
    for block, got in language_model.questions(table).unionByName(language_model.answers(asked, state)).toPandas().groupby("block"):
        got = got.sort_values("bucket")
        names = [w for k in got["bucket"].iloc[1:] for w in hashes[block, k]]
        word, before, p, _ = language_model.probabilities(got, kept, model)
        for w, u, x in zip(word, before, p):
            sums.setdefault(names[u], {})[names[w]] = float(x)
    assert set(sums) == {"", "a", "b", "c", "unknown"}
    for u, by in sums.items():
        assert len(by) == 5 and math.isclose(sum(by.values()), 1, rel_tol=1e-9), (u, by)
    assert sums["a"]["b"] > sums["a"]["c"] > sums["a"]["unknown"] > 0


def test_language_model_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n, size in (("4", 7_000_000), ("7", 20_000)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((r.doc_id, r.score) for r in language_model.score(df, bucket_bytes=size).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(a == c and math.isclose(b, d, rel_tol=1e-6) for (a, b), (c, d) in zip(*got, strict=True))


def test_language_model_tells_contexts_apart(spark):
    """Words whose hashes share the top byte are contexts of their own."""
    import xxhash
    from pyspark.sql import functions as F

    top = lambda w: xxhash.xxh64_intdigest(w.encode()) >> 56
    u = "w0"
    v = next(w for i in range(1, 100_000) if top(w := f"w{i}") == top(u))
    df = spark.createDataFrame([(i, f"{u} left" if i % 2 else f"{v} right") for i in range(60)] + [(100, f"{u} left"), (101, f"{u} right"), (102, f"{v} left"), (103, f"{v} right")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(df, F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 1 and got[103] > got[102] + 1


def test_seating_follows_the_restaurant():
    """Against customers asked one by one, few and many."""
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    c = np.array([0, 1, 2, 5, 40, 100_000])
    t = language_model.seated(c, np.full(6, 0.01), np.full(6, 50), 5.0, 0.7, keys[:6], 3)
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all()
    for customers, base, n in ((3, 0.05, 20_000), (60, 0.2, 4000), (400, 0.01, 2000)):
        many = language_model.seated(np.full(n, customers), np.full(n, base), np.full(n, 9), 2.0, 0.5, keys[:n], 5)
        plain = np.ones(n)
        for i in range(1, customers):
            new = (2 + 0.5 * (9 + plain)) * base
            plain += rng.random(n) < new / (new + i - 0.5 * plain)
        error = math.sqrt((many.var() + plain.var()) / n)
        assert abs(many.mean() - plain.mean()) < 4.5 * error and 0.8 < many.std() / plain.std() < 1.25


def test_vectors_match_sql(spark):
    names, rows = sql(vector_dedup.OP9_SQL, "embeddings")
    got = vector_dedup.op9_vector_dedup(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0], None), (11, [-1.0, -0.0], 2), (12, [-1.0, 0.0], 2), (None, [-1.0, 0.0], 2), (13, [1e30, 0.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, key int")
    got = {(r.vec_id, r.n_links): (r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect()}
    assert got == {(1, 3): (1, True), (2, 3): (1, False), (3, 3): (1, False), (13, 3): (1, False), **{(i, 0): (i, True) for i in range(4, 12)}, (11, 2): (11, True), (12, 2): (11, False), (None, 2): (11, False)}
    assert vector_dedup.near_vectors(df.limit(0)).collect() == []


def test_vector_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base[i % 30] + rng.standard_normal((1, 16)) * s for i, s in enumerate(np.linspace(0.0, 0.4, 300))])
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    for sizes in ({"block": 16}, {"cell_rows": 4}, {"block": 7, "cell_rows": 1}):  # two, four and six directions of cells
        got = vector_dedup.near_vectors(df, **sizes).collect()
        assert {r.vec_id: r.n_links for r in got} == {i: int(links[i].sum()) - 1 for i in range(300)}
