"""A hierarchical Pitman-Yor language model, sampled across a cluster.

Restaurants: one for each context, where a context is the word before (48 bits of its hash; at the start
of a text that of the end token); all share one parent, the restaurant of words without
context, whose base is uniform over the known words and one unknown.  The probability of word w
in context u is

    (c_uw - d t_uw + (strength + d t_u) P(w)) / (strength + c_u)

with customers c, tables t, and the parent's P(w) of the same form over its customers, which are
the tables of its children.

Texts are read once, in blocks, equal texts of a block once: a block's distinct (word, context) entries go to a bucket of the
word's hash with their counts, and its tokens become numbers of those entries.  A word's entries,
its customers in the parent and its tables there are all in one bucket.

A dish with one customer has one table whatever is drawn, and most dishes have one: they are counted by
word and context, and only dishes of two customers or more are kept and seated.  A context's tables are

    t_u = entries of u, summed over the blocks + (tables - blocks that have it), summed over its dishes of two or more

A block sends the first sum, and c_u, with the word u itself; the second is summed over the buckets in each sweep,
at the bucket of u's hash, and the totals go back in the order asked.  Each sweep of the sampler unseats every dish and reseats its
customers one by one by the Chinese restaurant's probabilities, all dishes side by side; the tables of other dishes are
those of the sweep before.

At the end each block gets back what probabilities consist of: for an entry its customers and tables, for a word its customers and tables
in the parent and, as a context, its totals.  Predictive probabilities are averaged over ``samples`` sweeps after the first ``burn``.

Hot words are summed in their block first, and one word has no more entries than there are words
met before it, so no bucket depends on a word's frequency; a hot context has one sum a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, discard, parts, read, shared_dir, split_words

END = b""  # the token after the last word; no word is empty


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def context(hashes: np.ndarray) -> np.ndarray:
    """What stands for a word as a context: 48 bits of its hash."""
    return hashes >> np.uint64(16)


def packed(contexts: np.ndarray) -> bytes:
    """Contexts in six bytes each."""
    return np.ascontiguousarray(contexts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def contexts_of(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def small(numbers: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: most are small, so most planes vanish."""
    x = np.ascontiguousarray(numbers, "<i8").ravel()
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return x.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def ints(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def cuts(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts among contexts in order of bucket."""
    return np.searchsorted((contexts % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))


def places_in(words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted one among sorted words, or their number where it is none of them."""
    if not len(words):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
    return np.where(words[at] == wanted, at, len(words))


REQUESTS = "kind int, block long, bucket int, a binary, b binary, c binary, d binary, e binary"


def block_rows(block: int, docs: list, held: list[bool], texts: list[str], buckets: int) -> list[tuple]:
    """Kind 1, one for each bucket: word hashes, entries of each word, the entries' contexts, their training counts, and of
    each word as a context its customers and its distinct training entries in this block.
    Kind 0: doc_ids with a null mark and held_out, tokens of each distinct text, the tokens' entry numbers, entries of each word of all buckets,
    the end token's number and each document's text."""
    import xxhash

    number, distinct = Numbers(), Numbers()
    which = np.fromiter((distinct[t] for t in texts), np.int64, len(texts))
    copies = np.bincount(which, ~np.array(held, bool), len(distinct)).astype(np.int64)
    tokens = [[number[w] for w in split_words(t.encode().translate(UPPER))] + [number[END]] for t in distinct]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    word = np.fromiter((x for t in tokens for x in t), np.int64, int(sizes.sum()))
    del tokens
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    order = np.lexsort((hashes, context(hashes) % np.uint64(buckets)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    hashes, word, end, n = hashes[order], rank[word], rank[number[END]], len(order)
    code = word * n
    code[0] += end
    code[1:] += word[:-1]  # a text's first word comes after the end of the text before
    code, entry = np.unique(code, return_inverse=True)
    count = np.bincount(entry, np.repeat(copies, sizes), len(code)).astype(np.int64)
    entry_word, before = code // n, code % n
    customers, entries = np.bincount(before, count, n), np.bincount(before[count > 0], minlength=n)
    contexts = context(hashes)
    at = cuts(contexts, buckets)
    per_word = np.bincount(entry_word, minlength=n)
    edge = np.searchsorted(entry_word, at)
    out = []
    for k in range(buckets):
        w, e = slice(at[k], at[k + 1]), slice(edge[k], edge[k + 1])
        if at[k] < at[k + 1]:
            out.append((1, block, k, hashes[w].tobytes(), small(per_word[w]), packed(contexts[before[e]]), small(count[e]), small(np.array([customers[w], entries[w]]))))
    ids = np.array([[d or 0, d is None, h] for d, h in zip(docs, held)], "<i8")
    out.append((0, block, -1, small(ids.T), small(sizes), small(entry), small(per_word), small(np.append(end, which))))
    return out


def requests(docs: DataFrame, held_out, buckets: int, tokens: int = 3_000_000) -> DataFrame:
    """``block_rows`` of blocks of about ``tokens`` tokens of each input split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, blocks = TaskContext.get().partitionId(), 0
        docs, held, texts, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            cols = list(zip(*block_rows((split << 20) + blocks, docs, held, texts, buckets)))
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in REQUESTS.split(", ")])

        for b in batches:
            for d, h, t in zip(*(b.column(k).to_pylist() for k in ("doc_id", "held", "text"))):
                docs.append(d)
                held.append(h)
                texts.append(t)
                size += len(t)
                if size >= 6 * tokens:
                    yield made()
                    blocks += 1
                    docs, held, texts, size = [], [], [], 0
        if docs:
            yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held")).mapInArrow(run, REQUESTS)


def kept(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back; its shuffle files go as soon as it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", spark.conf.get(name, None)
    out = df.write.option("compression", "zstd")
    spark.conf.set(name, "true")
    try:
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


STATE = (
    "bucket int, words binary, occurs binary, singles binary, customers binary, entries binary, per_word binary, places binary, place binary, counts binary, blocks binary, "
    "tables binary, roots binary, kept_tables array<binary>, kept_roots array<binary>, kept_totals array<binary>, parent_tables long, parent_customers long, n_words long, tokens long"
)
ASKED = "block long, word binary, codes binary, dishes binary"
NAMES = [f.split()[0] for f in STATE.split(", ")]


def _moved(tables, roots, singles) -> dict:
    return {"tables": small(tables), "roots": small(roots), "parent_tables": int(roots.sum()), "parent_customers": int(tables.sum() + singles.sum())}


def _steps(x: np.ndarray) -> bytes:
    """A mostly rising row of numbers as its steps, which take less room."""
    return small(np.diff(x, prepend=0))


def merged(asked: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket with block -1: its words, the number of their dishes with one customer, their dishes of two or more (``place``
    among the contexts ``places``), every dish at one table.
    And one for each block that asked: its words, whether an entry has no, one or more customers, and the dishes of the last kind."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = []
        for r in rows.itertuples():
            w = np.frombuffer(r.a, "<u8")
            got.append((w, np.repeat(np.arange(len(w)), ints(r.b)), contexts_of(r.c), ints(r.d), ints(r.e).reshape(2, -1)))
        words = np.unique(np.concatenate([w[entry[count > 0]] for w, entry, _, count, _ in got]))
        n = len(words)
        at = [places_in(words, w) for w, *_ in got]
        word = np.concatenate([a[g[1]] for a, g in zip(at, got)])
        count = np.concatenate([g[3] for g in got])
        places, place = np.unique(np.concatenate([g[2] for g in got]), return_inverse=True)
        order = np.lexsort((places, places % np.uint64(buckets)))  # the order of entries in blocks
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = places[order]
        code, inverse = np.unique(word * len(places) + rank[place], return_inverse=True)
        total = np.bincount(inverse, count, len(code)).astype(np.int64)
        blocks = np.bincount(inverse[count > 0], minlength=len(code))
        dish_word, dish_place = code // len(places), code % len(places)
        dish = total > 1
        sums = np.zeros((2, n + 1), np.int64)
        for a, g in zip(at, got):
            sums[:, a] += g[4]  # a block's words differ, but for those unknown, which are never contexts of training texts
        singles = np.bincount(dish_word[total == 1], minlength=n)
        used, own = np.unique(dish_place[dish], return_inverse=True)
        tables, roots = np.ones(int(dish.sum()), np.int64), np.ones(n, np.int64)
        none = {"block": -1, "word": b"", "codes": b"", "dishes": b""}
        out = [{
            "bucket": rows["bucket"].iloc[0], "words": words.tobytes(), "occurs": small(np.bincount(dish_word, total, n)[:n]), "singles": small(singles),
            "customers": small(sums[0, :n]), "entries": small(sums[1, :n]), "per_word": small(np.bincount(dish_word[dish], minlength=n)),
            "places": packed(places[used]), "place": small(own), "counts": small(total[dish]), "blocks": small(blocks[dish]),
            **_moved(tables, roots, singles), "kept_tables": [], "kept_roots": [], "kept_totals": [], "n_words": n, "tokens": int(total.sum()), **none,
        }]
        codes, number, edge = np.minimum(total, 2).astype(np.uint8), np.cumsum(dish) - 1, 0
        for block, a, g in zip(rows["block"], at, got):
            mine = inverse[edge : edge + len(g[1])]
            edge += len(g[1])
            out.append(dict.fromkeys(NAMES, b"") | {
                "bucket": rows["bucket"].iloc[0], "kept_tables": [], "kept_roots": [], "kept_totals": [], "parent_tables": 0, "parent_customers": 0, "n_words": 0, "tokens": 0,
                "block": block, "word": _steps(a), "codes": small(codes[mine]), "dishes": _steps(number[mine[dish[mine]]]),
            })
        return pd.DataFrame(out)[[f.split()[0] for f in f"{STATE}, {ASKED}".split(", ")]]

    return asked.groupBy("bucket").applyInPandas(run, f"{STATE}, {ASKED}")


SHARES = "bucket int, part int, own boolean, places binary, sums binary"


def context_totals(state: DataFrame, buckets: int, width: int) -> DataFrame:
    """For every bucket, in parts by the context: the tables of its places, in their order, over all buckets; and (``own``) those of its words as contexts."""

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                places, place = contexts_of(r.places), ints(r.place)
                sums = np.bincount(place, ints(r.tables) - ints(r.blocks), len(places)).astype(np.int64)
                at = cuts(places, buckets)
                cut = [slice(a, b) for a, b in zip(at, at[1:])]
                out = [(r.bucket, j, False, packed(places[c]), small(sums[c])) for j, c in enumerate(cut) if c.start < c.stop]
                out.append((r.bucket, r.bucket, True, packed(context(np.frombuffer(r.words, "<u8"))), r.entries))
                yield pd.DataFrame(out, columns=[f.split()[0] for f in SHARES.split(", ")])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        places, inverse = np.unique(contexts_of(b"".join(rows["places"])), return_inverse=True)
        edge = np.cumsum(rows["places"].map(len).to_numpy() // 6)[:-1]
        out = rows[["bucket", "part", "own"]].copy()
        total = np.bincount(inverse, np.concatenate([ints(x) for x in rows["sums"]]), len(places)).astype(np.int64)[inverse]
        out["totals"] = [small(x) for x in np.split(total, edge)]
        return out

    sent = state.select("bucket", "words", "entries", "places", "place", "tables", "blocks").mapInPandas(shares, SHARES)
    return sent.repartition(width, "part").groupBy("part").applyInPandas(summed, "bucket int, part int, own boolean, totals binary")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def uniform(keys: np.ndarray, seed: int, k: int) -> np.ndarray:
    """The k-th number between 0 and 1 of each key's own stream: the same wherever and beside whatever it is drawn."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (seed * 0x1000003 + k + 1)) & 0xFFFFFFFFFFFFFFFF)
    return ((mixed(mixed(keys ^ salt) + salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seated(customers: np.ndarray, base: np.ndarray, others: np.ndarray, strength: float, discount: float, keys: np.ndarray, seed: int) -> np.ndarray:
    """Tables after seating each dish's customers one after another: ``others`` tables hold other dishes.

    The first customer opens a table; one that finds i seated at t tables opens another with the probability
    p(i) = new / (new + i - discount * t), new = (strength + discount * all tables) * base.  While no table opens, p falls with i, so
    the customers who might open one are drawn by a geometric gap at the present rate, and each then does with the
    ratio of its own rate to that: the very law of asking every customer, in steps that grow with tables, not customers.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seats, k = np.ones(len(live), np.int64), 0
    while len(live):
        t = tables[live]
        new = (strength + discount * (others[live] + t)) * base[live]
        rate = np.minimum(new / (new + seats - discount * t), 1 - 2.0**-53)
        gap = np.floor(np.log(uniform(keys[live], seed, k)) / np.log1p(-rate))
        come = gap < customers[live] - seats
        live, seats, rate, new, t = live[come], seats[come] + gap[come].astype(np.int64), rate[come], new[come], t[come]
        tables[live] += uniform(keys[live], seed, k + 1) * rate < new / (new + seats - discount * t)
        seats += 1
        more = seats < customers[live]
        live, seats, k = live[more], seats[more], k + 2
    return tables


def sweep(state: DataFrame, contexts: DataFrame, totals: dict, model: dict, keep: bool, move: bool, seed: int) -> DataFrame:
    """The state with its seating kept as a sample (``keep``) and then, with ``move``, all customers seated anew."""

    def run(rows: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        r, shares = rows.iloc[0].to_dict(), shares.sort_values("part")
        if keep:
            for k, x in (("tables", r["tables"]), ("roots", r["roots"]), ("totals", shares["totals"][shares["own"]].iloc[0])):
                r[f"kept_{k}"] = [*r[f"kept_{k}"], x]
        if move:
            n, tables_of = len(r["words"]) // 8, np.concatenate([np.zeros(0, np.int64), *map(ints, shares["totals"][~shares["own"]])])
            word, place, count, singles, tables, roots = np.repeat(np.arange(n), ints(r["per_word"])), *(ints(r[k]) for k in ("place", "counts", "singles", "tables", "roots"))
            dish = mixed(np.frombuffer(r["words"], "<u8"))
            parent = parent_probability(singles + np.bincount(word, tables, n), roots, totals, model)
            tables = seated(count, parent[word], tables_of[place] - tables, model["strength"], model["discount"], mixed(dish[word] ^ contexts_of(r["places"])[place]), 2 * seed)
            own = singles + np.bincount(word, tables, n).astype(np.int64)
            roots = seated(own, np.full(n, totals["uniform"]), totals["parent_tables"] - roots, model["parent_strength"], model["parent_discount"], dish, 2 * seed + 1)
            r |= _moved(tables, roots, singles)
        return pd.DataFrame([r])

    return state.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInPandas(run, STATE)


def parent_probability(customers, roots, totals: dict, model: dict):
    d, s = model["parent_discount"], model["parent_strength"]
    return (customers - d * roots + (s + d * totals["parent_tables"]) * totals["uniform"]) / (s + totals["parent_customers"])


def totals_of(state: DataFrame) -> dict:
    """Sums over buckets, of the parent and of the whole."""
    one = state.agg(F.sum("parent_tables").alias("pt"), F.sum("parent_customers").alias("pc"), F.sum("n_words").alias("v"), F.sum("tokens").alias("n")).first()
    return {"parent_tables": one["pt"] or 0, "parent_customers": one["pc"] or 0, "words": one["v"] or 0, "uniform": 1 / ((one["v"] or 0) + 1), "tokens": one["n"] or 0}


ANSWER = "block long, bucket int, of_words binary, codes binary, of_dishes binary, ids binary, sizes binary, tokens binary, per_word binary, which binary"


def answers(asked: DataFrame, state: DataFrame) -> DataFrame:
    """For every block and bucket: of each word its training count, its customers as a context, and by sample its customers and tables in the
    parent and its tables as a context; whether an entry has no, one or more customers; of the last kind customers and, by sample, tables."""

    def run(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        r = states.iloc[0]
        of = {k: ints(r[k]) for k in ("occurs", "customers", "singles", "counts", "per_word")}
        n = len(of["per_word"])
        word = np.repeat(np.arange(n), of["per_word"])
        words, dishes = [of["occurs"], of["customers"]], [of["counts"]]
        for tables, roots, totals in zip(r["kept_tables"], r["kept_roots"], r["kept_totals"]):
            tables = ints(tables)
            words += [of["singles"] + np.bincount(word, tables, n).astype(np.int64), ints(roots), ints(totals)]
            dishes.append(tables)
        words, dishes = np.pad(np.array(words, "<i8"), ((0, 0), (0, 1))), np.array(dishes, "<i8")  # the last place is the unknown word's
        out = []
        for a in rows.itertuples():
            out.append((a.block, a.bucket, small(words[:, np.cumsum(ints(a.word))]), a.codes, small(dishes[:, np.cumsum(ints(a.dishes))]), *[None] * 5))
        return pd.DataFrame(out, columns=[f.split()[0] for f in ANSWER.split(", ")])

    return asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInPandas(run, ANSWER)


def questions(table: DataFrame) -> DataFrame:
    """The blocks' own rows (kind 0 of ``requests``) beside the answers."""
    none = [F.lit(None).cast("binary").alias(k) for k in ("of_words", "codes", "of_dishes")]
    return table.where("kind = 0").select("block", F.lit(-1).alias("bucket"), *none, F.col("a").alias("ids"), F.col("b").alias("sizes"), F.col("c").alias("tokens"), F.col("d").alias("per_word"), F.col("e").alias("which"))


def probabilities(rows: pd.DataFrame, samples: list[dict], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's entries: word, context (both numbers of the block's words), averaged predictive probability; and its words' training counts."""
    own, got = rows.iloc[0], rows.iloc[1:]
    words = np.concatenate([ints(x).reshape(2 + 3 * len(samples), -1) for x in got["of_words"]], axis=1)
    dishes = np.concatenate([ints(x).reshape(1 + len(samples), -1) for x in got["of_dishes"]], axis=1)
    codes = np.concatenate([ints(x) for x in got["codes"]])
    word = np.repeat(np.arange(words.shape[1]), ints(own["per_word"]))
    tokens, end = ints(own["tokens"]), int(ints(own["which"])[0])
    before = np.empty(len(word), np.int64)
    before[tokens] = np.append(end, word[tokens[:-1]])
    p, several = np.zeros(len(word)), np.flatnonzero(codes == 2)
    for i, totals in enumerate(samples):
        customers, roots, tables = words[2 + 3 * i : 5 + 3 * i]
        seats = (codes == 1) * (1 - model["discount"])
        seats[several] = dishes[0] - model["discount"] * dishes[1 + i]
        p += seats + (model["strength"] + model["discount"] * tables)[before] * parent_probability(customers, roots, totals, model)[word]
    return word, before, p / len(samples) / (model["strength"] + words[1])[before], words[0]


def fitted(table: DataFrame, buckets: int, width: int, model: dict, burn: int, samples: int, seed: int) -> tuple[DataFrame, DataFrame, list[dict]]:
    """What blocks asked, the state of all buckets after the sampler's sweeps, and the totals of each sample kept; ``table``: ``requests``."""
    first = kept(merged(table.where("kind = 1").repartition(width, "bucket"), buckets), "lm-state")
    asked, state = first.where("block >= 0").select("bucket", *[f.split()[0] for f in ASKED.split(", ")]), first.where("block < 0").select(*NAMES)
    sampled = []
    for i in range(burn + samples + 1):
        totals = totals_of(state)
        if i > burn:
            sampled.append(totals)
        after = kept(sweep(state, context_totals(state, buckets, width), totals, model, i > burn, i < burn + samples, seed + i), "lm-state")
        if i:
            discard(state)
        state = after
    return asked, state, sampled


def score(docs: DataFrame, held_out=None, strength: float = 5.0, discount: float = 0.7, parent_strength: float = 5.0, parent_discount: float = 0.6, burn: int = 1, samples: int = 2, seed: int = 11, bucket_bytes: int = 7_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null and empty texts are the end token alone.  A null doc_id counts as its text "" for the split.
    Repeated rows each count in training and are each scored.  An empty table gives no rows.  When
    no row is for training, N and V are 0 and each token has the probability 1.  Random numbers belong to
    words and contexts, so neither the session's number of partitions
    nor that of buckets, one for every ``bucket_bytes`` of text, changes anything.
    """
    if held_out is None:
        held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    model = {"strength": strength, "discount": discount, "parent_strength": parent_strength, "parent_discount": parent_discount}
    width = parts(docs)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    buckets = 1 + size // bucket_bytes  # a bucket is a group in a worker's memory
    table = kept(requests(docs, held_out, buckets), "lm-blocks", by="kind")
    asked, state, samples_kept = fitted(table, buckets, width, model, burn, samples, seed)
    discard(table, "kind=1")
    tokens, v = samples_kept[-1]["tokens"], samples_kept[-1]["words"]

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        word, _, p, occurs = probabilities(rows, samples_kept, model)
        own = rows.iloc[0]
        ids, which, sizes, entries = ints(own["ids"]).reshape(3, -1), ints(own["which"])[1:], ints(own["sizes"]), ints(own["tokens"])
        count = occurs[word]
        starts = np.cumsum(sizes) - sizes
        sums = lambda x: np.add.reduceat(x[entries], starts)[which]
        return pd.DataFrame({
            "doc_id": pd.Series(ids[0]).astype("Int64").mask(ids[1] == 1), "held_out": ids[2] == 1, "n_tokens": sizes[which], "n_known": sums((count > 0).astype(np.int64)),
            "train_tokens": tokens, "base_score": sums(np.log10((count + 1) / (tokens + v + 1))), "score": sums(np.log10(p)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return questions(table).unionByName(answers(asked, state)).repartition(width, "block").groupBy("block").applyInPandas(total, schema)


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
