"""The ten operators and the pipeline: brute force on small tables, and the awkward cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from reelgrid.llm import (
    decontaminate, hyperminhash, langid, mixing, sharding, spotsigs, suffixes, toxicity, urlrules, windows,
)
from reelgrid.llm import textkernel as tk

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "lm")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Clean texts, near copies, copies, a shared passage, and awkward rows."""
    rng = random.Random(5)
    out = [(i, words(rng, rng.randint(30, 160)), ("en", "fr")[i % 2], f"src{i % 4}", 0) for i in range(40)]
    base = out[0][1].split()
    for k in range(6):  # near copies of document 0
        w = list(base)
        w[3 + k] = "zzz"
        out.append((100 + k, " ".join(w), "en", "src0", 0))
    out += [(110 + k, out[1][1], "fr", "src1", 0) for k in range(5)]  # copies of document 1
    passage = words(rng, 60)
    out += [(120 + k, words(rng, 40) + " " + passage + ". " + words(rng, 50), "en", "src2", 0) for k in range(3)]
    out += [(130, None, "en", "src1", None), (131, "", "en", None, 0), (132, "  ...  ", None, "src1", 5), (133, "one", "en", "src1", 3)]
    out += [(140, out[2][1], "en", "src1", 0)] * 2  # repeated rows
    out += [(None, words(rng, 80), "en", "src1", 0), (150, words(rng, 30000), "en", "src3", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """The same rows with further columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    extra = ("TEXT", "id", "h", "tokens", "band", "sigs", "rank", "epoch", "domain", "whole", "again", "gone", "_0", "toxicity")
    return docs.select("*", *[F.lit(None).cast("string").alias(c) for c in extra])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Kernel


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB zÉéß_9\n.-Ж€", max_size=30)), max_size=6))
def test_tokens_are_the_plain_ones(texts):
    t = tk.tokenize(pa.array(texts, pa.string()))
    got = [[bytes(t.data[t.start[i] : t.end[i]]).decode() for i in range(t.offs[d], t.offs[d + 1])] for d in range(len(texts))]
    assert got == [tk.plain_tokens(x) for x in texts]
    by = defaultdict(set)
    for w, h in zip([w for g in got for w in g], t.hash.tolist(), strict=True):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)


def test_windows_agree_wherever_they_stand():
    t = tk.tokenize(pa.array(["a b c d e", "x a b c y"]))
    w = tk.window_hashes(t.hash, 3)
    assert w[0] == w[6] and len(set(w.tolist())) == len(w) - 1
    assert tk.span_hashes(t.hash, np.array([0, 6]), np.array([3, 9])).tolist()[0] == tk.span_hashes(t.hash, np.array([6]), np.array([9]))[0]


# 1 and 7: repeats


def covered(found):
    out = defaultdict(set)
    for r in found:
        out[r.doc_id].update(range(r.start_token, r.end_token))
    return out


def brute_windows(rows, width):
    count = Counter()
    texts = [(r[0], tk.plain_tokens(r[1])) for r in rows]
    for _, t in texts:
        count.update(tuple(t[j : j + width]) for j in range(len(t) - width + 1))
    out = defaultdict(set)
    for i, t in texts:
        for j in range(len(t) - width + 1):
            if count[tuple(t[j : j + width])] > 1:
                out[i].update(range(j, j + width))
    return out


def brute_roles(rows, width):
    """Tokens of the first windows and of the others, rows in scan order."""
    many, seen = Counter(), set()
    texts = [(r[0], tk.plain_tokens(r[1])) for r in rows]
    for _, t in texts:
        many.update(tuple(t[j : j + width]) for j in range(len(t) - width + 1))
    out = {"keep": defaultdict(set), "remove": defaultdict(set)}
    for i, t in texts:
        for j in range(len(t) - width + 1):
            w = tuple(t[j : j + width])
            if many[w] > 1:
                out["remove" if w in seen else "keep"][i].update(range(j, j + width))
                seen.add(w)
    return out


@pytest.mark.parametrize("block,bucket", [(1_000_000, 2_000_000), (300, 200)])
def test_windows_equal_brute_force(docs, rows, block, bucket):
    got = windows.intervals(docs, windows.Params(width=20, block_windows=block, bucket_windows=bucket)).collect()
    assert covered(got) == brute_windows(rows, 20)
    removed, kept = ([r for r in got if r.role == x] for x in ("remove", "keep"))
    assert removed and kept and len(covered(removed)) < len(covered(got))
    assert len({(r.doc_id, r.start_token, r.end_token, r.role) for r in got if r.doc_id != 140}) == len([r for r in got if r.doc_id != 140])


def test_a_hot_window_is_one_entry_a_block():
    """Copies within a block don't travel: half of all rows may hold one passage."""
    rng = np.random.default_rng(4)
    hot = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    held = [(np.concatenate([hot, rng.integers(0, 1 << 63, 5, dtype=np.uint64)]), np.arange(55) + 55 * i, np.array([i]), np.array([55])) for i in range(200)]
    sent = windows.pack(3, 7, held).to_pylist()
    assert sum(len(r["a"]) // 8 for r in sent if r["kind"] == 1) == 50 + 5 * 200
    assert sum(len(r["a"]) // 8 for r in sent if r["kind"] == 2) == 50 * 199


def test_repeats_with_a_hot_passage_and_a_least_id(spark):
    rng = random.Random(8)
    hot = words(rng, 30)
    rows = [(-(2**63) + i, f"{words(rng, rng.randint(0, 9))} {hot} {words(rng, rng.randint(0, 9))}" if i % 2 else words(rng, 45), "en", "s", 0) for i in range(60)]
    rows += [(None, f"{hot} and more", "en", "s", 0), (900, hot.split()[0] + " again" * 200, "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    for found in (windows.intervals(d, windows.Params(width=20, block_windows=300, bucket_windows=200, row_windows=1)), suffixes.intervals(d, suffixes.Params(window=2, passage=20, block_tokens=300, bucket_symbols=150))):
        got = found.collect()
        assert covered(got) == brute_windows(rows, 20)
        for role, want in brute_roles(rows, 20).items():
            assert covered([r for r in got if r.role == role]) == want


@pytest.mark.parametrize("small", [False, True])
def test_suffix_sorting_equals_brute_force(docs, rows, small):
    p = suffixes.Params(window=2, passage=20, **({"block_tokens": 400, "bucket_symbols": 150} if small else {}))
    got = suffixes.intervals(docs, p).collect()
    assert covered(got) == brute_windows(rows, 20)
    assert sorted(map(tuple, got), key=repr) == collected(windows.intervals(docs, windows.Params(width=20)))


def test_suffix_sorting_of_texts_that_repeat_within(spark):
    """Periodic texts and passages at many offsets, which need all depths of the recursion."""
    rng = random.Random(12)
    long = words(rng, 300).split()
    rows = [(i, " ".join(long[rng.randrange(200) :][: rng.randint(30, 100)]) + " " + words(rng, 20), "en", "s", 0) for i in range(40)]
    rows += [(100, "a b c " * 60, "en", "s", 0), (101, "x " + "b c a " * 50, "en", "s", 0), (102, "same " * 90, "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")
    for k in (150, 1_000_000):
        got = suffixes.intervals(d, suffixes.Params(window=2, passage=20, block_tokens=5 * k, bucket_symbols=k)).collect()
        assert covered(got) == brute_windows(rows, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 4), min_size=1, max_size=40), st.integers(1, 6))
def test_difference_cover_order(symbols, k):
    """Splitting and merging by ranks of places 1 and 2 modulo 3 gives the order of suffixes."""
    s = np.array(symbols)
    n = len(s)
    order = sorted(range(n), key=lambda i: symbols[i:])
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[order] = np.arange(1, n + 1)
    rank[np.arange(n + 4) % 3 == 0] = 0  # not known
    at = np.arange(n)
    own = np.where(at % 3 == 0, at + 1, at)
    two = np.where(at % 3 == 1, at + 1, at + 2)
    zero = np.zeros(n, dtype=np.int64)
    t = suffixes.Suffixes(at % 3, s, np.append(s[1:], 0), rank[own], rank[two], zero, zero)
    assert t.order().tolist() == order and len(t.distinct()[1].x) == n
    cuts = t.take(np.array(sorted(set(order[:: max(1, n // k)]), key=order.index)))
    where = t.bucket(cuts)
    assert all(a <= b for a, b in zip(where[order], where[order][1:]))


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    for n in (1, 7, 60):
        ids = rng.integers(1, 4, n)
        end = np.full(n, n)
        order = decontaminate.suffix_array(ids, end, n)
        assert order.tolist() == sorted(range(n), key=lambda i: ids[i:].tolist())


def test_repeats_of_awkward_tables(empty, clash, docs):
    assert windows.intervals(empty).count() == 0 and suffixes.intervals(empty).count() == 0
    for run in (lambda d: windows.intervals(d, windows.Params(width=20)), lambda d: suffixes.intervals(d, suffixes.Params(window=2, passage=20))):
        assert collected(run(clash)) == collected(run(docs))


# 2: mixing


def test_water_level_by_hand(spark):
    p = mixing.Params(max_epochs=1, budget_thousandths=500, domains={"web": 1, "news": 1}, langs={"en": 3, "fr": 1})
    # web (src0): en 10 tokens, fr 90; news (src1): en 100.  Budget 100: web 50, news 50; web en wants 37 but has 10, fr takes 40
    d = spark.createDataFrame([(i, "w " * 10, lang, src, 0) for i, (lang, src) in enumerate([("en", "src0")] + [("fr", "src0")] * 9 + [("en", "src1")] * 10)], DOCS)
    q = {(r.domain, r.lang): r.quota for r in mixing.budgets(mixing.slim(d), p).collect()}
    assert q == {("web", "en"): 10, ("web", "fr"): 40, ("news", "en"): 50}
    short = mixing.Params(max_epochs=1, budget_thousandths=900, domains={"web": 3, "news": 1}, langs={})
    q = {(r.domain, r.lang): r.quota for r in mixing.budgets(mixing.slim(d), short).collect()}
    assert q == {("web", "en"): 10, ("web", "fr"): 90, ("news", "en"): 80}  # web is full; only then does news get more


def test_mixture_takes_whole_epochs_and_a_prefix(docs, rows):
    p = mixing.Params(max_epochs=3, domains={"web": 20, "news": 1}, langs={})
    got = mixing.mixture(docs, p).collect()
    quota = {(r.domain, r.lang, r.source): (r.tokens, r.quota) for r in mixing.budgets(mixing.slim(docs), p).collect()}
    taken = defaultdict(int)
    for r in got:
        taken[r.domain, r.lang, r.source] += r.tokens
    biggest = max(len((r[1] or "").split()) for r in rows)
    for leaf, (_, q) in quota.items():
        assert q - biggest <= taken[leaf] <= q
    once = Counter((r.doc_id, r.epoch) for r in got)
    assert all(n == 1 or i == 140 for (i, _), n in once.items())


def test_mixed_rows_are_the_mixture(docs, clash, empty):
    p = mixing.Params(max_epochs=3, domains={"web": 20, "news": 1}, langs={})
    want = Counter(r.doc_id for r in mixing.mixture(docs, p).collect())
    for d in (docs, clash):
        got = mixing.mixed(d, p)
        assert got.columns == d.columns and Counter(r[0] for r in got.collect()) == want
    assert mixing.mixed(empty).count() == mixing.mixture(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.budgets(mixing.slim(docs), mixing.Params(langs={"en": 0}))


def test_domains_follow_the_rules(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(x,) for x in ("src0", "src7", "Wiki-dump/en", "forum.example.org", "--", "")], "s string")
    assert [r[0] for r in d.select(mixing.domain_of(F.col("s"), mixing.Params())).collect()] == ["web", "forum", "wiki", "forum", "unknown", "unknown"]
    own = mixing.Params(rules=(("^wiki", "books"), ("[.]org$", "web")))
    assert [r[0] for r in d.select(mixing.domain_of(F.lower("s"), own)).collect()] == ["src0", "src7", "books", "web", "unknown", "unknown"]


def test_equal_ratios_split_alike(spark):
    """Two languages whose capacity over weight is equal get what their weights say."""
    d = spark.createDataFrame([(i, "w " * 10, lang, "src0", 0) for i, lang in enumerate(["en"] * 2 + ["fr"] * 2)], DOCS)
    q = {r.lang: r.quota for r in mixing.budgets(mixing.slim(d), mixing.Params(max_epochs=1, budget_thousandths=500, langs={})).collect()}
    assert q == {"en": 10, "fr": 10}


# 3: toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1000):
        w = words(rng, rng.randint(8, 60)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "scum", "rotten"]))
        rows.append((i, " ".join(w), "en", "src0", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(0, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(marked):
    docs, labels = marked
    m = toxicity.train(docs, labels.where("doc_id < 700"))
    assert 0 < len(m["at"]) < 2000  # L1 leaves few
    out = {r.doc_id for r in toxicity.rejected(docs.where("doc_id >= 700"), m).collect()}
    bad = {i for i in range(700, 1000) if i % 5 == 0}
    assert len(out & bad) >= 0.95 * len(bad) and not out - bad
    kept = toxicity.drop_toxic(docs.where("doc_id >= 700"), m)
    assert {r.doc_id for r in kept.collect()} == set(range(700, 1000)) - out and kept.columns == docs.columns


def test_toxicity_of_awkward_rows(marked, docs, clash, empty, spark):
    m = toxicity.train(*marked)
    s = toxicity.scores(docs, m).collect()
    assert len(s) == docs.count() and all(r.toxicity < 0.3 for r in s if r.doc_id in (130, 131, 132, 133))
    assert toxicity.drop_toxic(clash, m).columns == clash.columns and toxicity.drop_toxic(clash, m).count() == docs.count()
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.rejected(docs, toxicity.train(docs, none)).count() == 0
    assert toxicity.rejected(empty, toxicity.train(empty, marked[1])).count() == 0


def plain_model(rows, p):
    """FTRL-proximal by the book, one coordinate at a time; rows: (label, set of coordinates) in order of training."""
    from math import exp, sqrt

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - (p.l1 if z[i] > 0 else -p.l1)) / ((p.beta + sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for y, xs in rows:
            w = {i: weight(i) for i in xs}
            g = 1 / (1 + exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in xs:
                sigma = (sqrt(n[i] + g * g) - sqrt(n[i])) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i)}


def plain_coordinates(text, bits):
    """Words, neighbouring pairs and pairs around a word, hashed one by one."""
    m = (1 << 64) - 1
    ws = tk.plain_tokens(text)
    h = [int(tk.tokenize(pa.array([w])).hash[0]) for w in ws]
    out = {x >> (64 - bits) for x in h}
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        for a, b in zip(h, h[gap:]):
            x = ((a * salt) & m) ^ ((b * (salt | 7) + gap) & m)
            x = ((x ^ (x >> 29)) * 0x9E3779B97F4A7C15) & m
            out.add(x >> (64 - bits))
    return out | {1 << bits}


def test_training_equals_plain_ftrl(spark, marked):
    from math import exp

    from pyspark.sql import functions as F

    p = toxicity.Params(bits=16, l1=0.5, epochs=3)
    docs, labels = marked[0].where("doc_id < 60"), marked[1]
    m = toxicity.train(docs, labels, p)
    order = F.concat(*[F.lpad(F.hex(F.xxhash64(c)), 16, "0") for c in ("doc_id", "text")])
    rows = docs.join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").select(order.alias("o"), "y", "text").collect()
    want = plain_model([(r.y, plain_coordinates(r.text, p.bits)) for r in sorted(rows, key=lambda r: r.o)], p)
    got = dict(zip(m["at"].tolist(), m["weight"].tolist(), strict=True))
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want) and len(want) > 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scores(docs, m).collect():
        s = sum(want.get(i, 0.0) for i in plain_coordinates(texts[r.doc_id], p.bits))
        assert r.toxicity == pytest.approx(1 / (1 + exp(-s)), abs=1e-6)


def test_repeated_rows_stay_within_the_bound(spark, marked):
    docs = marked[0].where("doc_id < 50")
    many = docs
    for _ in range(3):
        many = many.unionAll(many)
    a, b = (toxicity.train(d, marked[1], toxicity.Params(sample=40, l1=0.5)) for d in (docs, many))
    assert a["at"].tolist() == b["at"].tolist() and np.allclose(a["weight"], b["weight"]) and len(a["at"])


def test_sample_bound(marked):
    assert toxicity.sampled_labels(marked[1], "toxic", 50).count() == 50
    assert toxicity.sampled_labels(marked[1], "toxic", 10**6).count() == 1001


# 4: sharding


def least_by_table(sizes, k):
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = [[float("inf")] * (n + 1) for _ in range(k + 1)]
    best[0][0] = 0
    for j in range(1, k + 1):
        for i in range(n + 1):
            best[j][i] = min([best[j - 1][i]] + [max(best[j - 1][h], sums[i] - sums[h]) for h in range(i)])
    return best[k][n]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=14), st.integers(1, 5), st.integers(1, 4))
def test_capacity_is_the_least(sizes, k, block):
    parts = [np.array(sizes[i : i + block]) for i in range(0, len(sizes), block)]
    for cached in (1, 100):
        blocks = sharding.Blocks(np.array(list(map(len, parts))), np.array([x.sum() for x in parts]), lambda ks: {i: parts[i] for i in ks}, cached)
        c = sharding.least_capacity(blocks, max(sizes), k)
        assert c == least_by_table(sizes, k)
        cuts = sharding.walk(blocks, c)
        assert len(cuts) < k or k == 1 and not cuts
        for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            assert sum(sizes[a:b]) <= c and (b == len(sizes) or sum(sizes[a : b + 1]) > c)


@pytest.mark.parametrize("cached", [100, 1])
def test_shards(docs, clash, empty, cached):
    p = sharding.Params(shards=5, block=7, cached=cached)
    got = sharding.shards(docs, p).collect()
    assert len(got) == docs.count()
    order = sorted((r.doc_id if r.doc_id is not None else -1, r.shard) for r in got)
    assert [s for _, s in order] == sorted(s for _, s in order)  # contiguous
    assert len({r.shard for r in got if r.doc_id == 140}) == 1  # atomic
    sizes = defaultdict(int)
    load = defaultdict(int)
    for r in got:
        sizes[r.doc_id if r.doc_id is not None else -1] += r.tokens
        load[r.shard] += r.tokens
    assert max(load.values()) == least_by_table([sizes[k] for k in sorted(sizes)], 5)
    out = sharding.sharded(clash, p)
    assert out.columns == [*clash.columns, "shard"] and collected(out.select("doc_id", "shard")) == collected(sharding.shards(docs, p).select("doc_id", "shard"))
    assert sharding.sharded(out, p).columns == out.columns  # the column is replaced
    assert sharding.shards(empty, p).count() == 0


# 5: decontamination


def brute_matches(rows, items, need):
    out = {}
    for n, (i, text) in enumerate(rows):
        u = tk.plain_tokens(text)
        for j, item in items:
            v = tk.plain_tokens(item)
            best = None
            for a in range(len(u)):
                for b in range(len(v)):
                    k = 0
                    while a + k < len(u) and b + k < len(v) and u[a + k] == v[b + k]:
                        k += 1
                    if k and k >= min(need, len(v)) and (best is None or (-k, a, b) < best):
                        best = (-k, a, b)
            if best:
                out[n, j] = (i, j, -best[0], best[1], best[2])
    return sorted(out.values(), key=repr)


@pytest.fixture(scope="module")
def bench(spark, rows):
    at = rows[4][1].split()
    items = [(1, " ".join(at[5:25])), (2, "Quite " + " ".join(rows[6][1].split()[:14])), (3, "one"), (4, None), (5, ""), (None, "two words"), (7, "absent passage of words")]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("shard,piece", [(1_000_000, 2_000_000), (200, 10)])
def test_matches_equal_brute_force(spark, rows, bench, shard, piece):
    few = [r for r in rows if r[0] != 150]
    d = spark.createDataFrame(few, DOCS)
    items, b = bench
    got = decontaminate.matches(d, b, decontaminate.Params(shard_tokens=shard, piece_tokens=piece))
    assert collected(got) == brute_matches([(r[0], r[1]) for r in few], [x for x in items if x[1]], 13)


def test_contaminated_rows_go(docs, clash, bench, empty, spark):
    b = bench[1]
    hit = {r.doc_id for r in decontaminate.matches(docs, b).collect()}
    assert {4, 6, 133} <= hit
    for d in (docs, clash):
        kept = decontaminate.drop_contaminated(d, b)
        assert kept.columns == d.columns and Counter(r[0] for r in kept.collect()) == Counter(r[0] for r in d.collect() if r[0] not in hit)
    assert decontaminate.matches(empty, b).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matches(docs, none).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == docs.count()


# 6 and 9: near duplicates


def brute_groups(sets, threshold):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) >= threshold * u - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    size = Counter(find(i) for i in ids)
    return {i: find(i) for i in ids if size[find(i)] > 1}


def shingle_sets(rows):
    out = {}
    for i, text, *_ in rows:
        w = tk.plain_tokens(text)
        if i is not None and w:
            out[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or {tuple(w)}
    return out


@pytest.mark.parametrize("spread", [64, 0])
def test_near_duplicates_equal_brute_force(docs, rows, clash, spread):
    got = {r.doc_id: r.group_id for r in hyperminhash.groups(docs, hyperminhash.Params(spread=spread)).collect()}
    assert got == brute_groups(shingle_sets(rows), 0.55)
    assert {100, 105, 110, 114, 140} <= set(got) and not {130, 131, 132, 133, 120, 150} & set(got)
    kept = hyperminhash.drop_duplicates(clash)
    ids = Counter(r[0] for r in kept.collect())
    gone = {i for i, g in got.items() if i != g}
    assert kept.columns == clash.columns and ids == Counter({r[0]: 1 for r in rows if r[0] not in gone})


def test_hot_buckets_are_split(spark):
    """Half of all rows are short texts around one common shingle, some of them near copies, and a fifth is one text."""
    rng = random.Random(11)
    rows = [(i, f"{words(rng, 3)} common start words {words(rng, 3)}", "en", "s", 0) for i in range(150)]
    for k in range(12):
        w = rows[k][1].split()
        w[-1] = "other"
        rows.append((200 + k, " ".join(w), "en", "s", 0))
    rows += [(300 + k, "one text that a fifth of all rows hold", "en", "s", 0) for k in range(60)]
    rows += [(400 + i, words(rng, 40), "en", "s", 0) for i in range(60)]
    want = brute_groups(shingle_sets(rows), 0.55)
    for spread in (64, 1):
        p = hyperminhash.Params(spread=spread, log_buckets=7, bands=64, slack=6.0)
        assert {r.doc_id: r.group_id for r in hyperminhash.groups(spark.createDataFrame(rows, DOCS), p).collect()} == want
    assert len(want) == 84


def test_repeated_doc_ids_stay_once(spark):
    d = spark.createDataFrame([(1, "a b c d e", "en", "s", 0)] * 3 + [(1, None, None, None, None), (None, "x", None, None, 0), (None, "x", None, None, 0)], DOCS)
    got = collected(hyperminhash.drop_duplicates(d))
    assert [r[0] for r in got] == [1, None, None] and got[0][1] == "a b c d e"


def test_no_duplicates_in_empty_tables(empty):
    assert hyperminhash.duplicates(empty).count() == 0 and hyperminhash.drop_duplicates(empty).count() == 0 and spotsigs.groups(empty).count() == 0


def test_estimate_is_corrected():
    rng = np.random.default_rng(0)
    p = hyperminhash.Params(mantissa=2)
    errors, raw = [], []
    for _ in range(40):
        a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        b = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        ra, rb = (hyperminhash.registers(tk.mix(x), np.zeros(len(x), dtype=np.int64), 1, p) for x in (a, b))
        n = np.array([3000.0])
        errors.append(hyperminhash.estimate(ra, rb, n, n, p)[0][0])
        raw.append((ra == rb).mean())
    assert np.mean(raw) > 0.03 and np.mean(errors) < 0.015  # two mantissa bits clash; the estimate knows


@pytest.mark.parametrize("spread", [64, 0])
def test_spotsigs_equal_brute_force(spark, spread):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(WORDS + ["the", "is", "a", "of"] * 8) for _ in range(n))
    rows = [(i, text(rng.randint(20, 200)), "en", "s", 0) for i in range(30)]
    for i in range(10):
        w = rows[i % 3][1].split()
        for _ in range(2 + i):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((50 + i, " ".join(w), "en", "s", 0))
    rows += [(70, rows[4][1], "en", "s", 0)] * 2 + [(71, None, None, None, None), (72, "", "en", "s", 0), (None, rows[4][1], "en", "s", 0)]
    p = spotsigs.Params(spread=spread)
    sig, doc = spotsigs.signatures(pa.array([r[1] for r in rows]), p)
    sets = defaultdict(set)
    for s, d in zip(sig.tolist(), doc.tolist(), strict=True):
        if rows[d][0] is not None:
            sets[rows[d][0]].add(s)
    d = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.group_id for r in spotsigs.groups(d, p).collect()} == brute_groups(sets, p.threshold)
    want = set()
    w = rows[5][1].split()
    for i, x in enumerate(w):
        rest = [y for y in w[i + 1 :] if y not in p.common]
        if x in p.anchors and len(rest) >= 2:
            want.add((x, rest[0], rest[1]))
    assert len(sets[5]) == len(want)
    assert spotsigs.unpack(spotsigs.pack(sig)).tolist() == sig.tolist()


def test_spotsigs_keep_leader_pairs_whose_buckets_others_lead(spark):
    """Two sets of 20 share 16; seven of their ten rarest signatures are also rare ones of documents with smaller ids."""
    text = lambda names: " ".join(f"the {x}x {x}y" for x in names)
    shared, rest = [f"s{i}" for i in range(10)], [f"r{i}" for i in range(6)]
    own = [[f"o{k}n{i}" for i in range(4)] for k in range(2)]
    filler = [[f"f{k}n{i}" for i in range(9)] for k in range(7)]
    rows = [(k, text([shared[k], *filler[k]])) for k in range(7)]
    rows += [(10 + k, text([*shared, *rest, *own[k]])) for k in range(2)]
    usual = [*rest, *own[0], *own[1], *[x for f in filler for x in f]]
    rows += [(20 + k, text([*usual, *[f"u{k}n{i}" for i in range(100)]])) for k in range(5)]
    p = spotsigs.Params()
    sig, doc = spotsigs.signatures(pa.array([t for _, t in rows]), p)
    sets = defaultdict(set)
    for s, d in zip(sig.tolist(), doc.tolist(), strict=True):
        sets[rows[d][0]].add(s)
    assert len(sets[10]) == len(sets[11]) == 20 and len(sets[10] & sets[11]) == 16
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert {r.doc_id: r.group_id for r in spotsigs.groups(d).collect()} == brute_groups(sets, p.threshold) == {10: 10, 11: 10}


# 8: URL rules


def test_url_rules(spark):
    pages, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        pages.append((i, f"https://{'free-pills' if bad else 'good'}{i % 3}.example.com/en/{i}.html?ref=x#top", "<p>"))
        labels.append((i, 0 if bad and i % 40 else 1, 0))
    pages += [(900, None, ""), (901, "", ""), (902, "not a url", ""), (903, "https://free-pills1.example.com/en/77777", ""), (None, "https://good1.example.com/", "")]
    p = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    lab = spark.createDataFrame(labels + [(None, 0, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    params = urlrules.Params(support=0.01, confidence=0.8)
    rules = urlrules.mine(p, lab, params)
    found = rules.collect()
    tx = [set(r.items) for r in urlrules.transactions(p, lab).collect()]
    for r in found:
        have = [t for t in tx if set(r["items"]) <= t]
        assert r.confidence == pytest.approx(sum(urlrules.BAD in t for t in have) / len(have)) and r.confidence >= 0.8
    out = {r.page_id: r for r in urlrules.decisions(p, rules).collect()}
    assert len(out) == len(pages) and out[903].drop and not out[900].drop and not out[901].drop and not out[None].drop
    for i in range(400):
        assert out[i].drop == (i % 4 == 0)
    assert urlrules.mine(p.limit(0), lab).count() == 0
    assert urlrules.decisions(p, urlrules.mine(p.limit(0), lab)).where("drop").count() == 0


def brute_rules(tx, support, hits, confidence, certainty):
    """Every set of tokens, without mining."""
    from itertools import combinations

    n, bad = len(tx), sum(urlrules.BAD in t for t in tx)
    base, least = bad / n, max(support, hits / n)
    out = {}
    for t in tx:
        if urlrules.BAD in t:
            own = sorted(t - {urlrules.BAD})
            for k in range(1, len(own) + 1):
                for s in combinations(own, k):
                    if s not in out:
                        have = [x for x in tx if set(s) <= x]
                        hit = sum(urlrules.BAD in x for x in have)
                        out[s] = (hit / len(have), hit / n)
    out = {s: (c, f) for s, (c, f) in out.items() if f >= least - 1e-12 and c >= confidence and (c - base) >= certainty * (1 - base)}
    return {s: v for s, v in out.items() if not any(set(r) < set(s) and out[r][0] >= v[0] for r in out)}


@pytest.mark.parametrize("seed,share", [(1, 0.25), (2, 0.5), (3, 0.9)])
def test_every_url_rule_is_found(spark, seed, share):
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(120):
        bad = rng.random() < share
        host = rng.choice(["pills", "shop"] if bad and rng.random() < 0.6 else ["news", "shop", "blog"])
        pages.append((i, f"https://{host}.example/{rng.choice(['en', 'fr'])}/{i}?{rng.choice(['ref=ad', 'page=x', 'q'])}", "", "own"))
        labels.append((i, int(not bad), 0))
    p = spark.createDataFrame(pages, "page_id bigint, url string, html string, items string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    params = urlrules.Params(support=0.02, hits=5)
    want = brute_rules([set(r.items) for r in urlrules.transactions(p, lab).collect()], params.support, params.hits, params.confidence, params.certainty)
    rules = urlrules.mine(p, lab, params)
    found = rules.collect()
    assert {tuple(r["items"]): (round(r.confidence, 9), round(r.support, 9)) for r in found} == {s: (round(c, 9), round(f, 9)) for s, (c, f) in want.items()}
    assert [r.rule for r in sorted(found, key=lambda r: (-r.confidence, -r.support, r["items"]))] == list(range(1, len(found) + 1))
    order = {tuple(r["items"]): r.rule for r in found}
    have = {r.page_id: set(r.have) for r in p.select("page_id", urlrules.url_tokens(p.url).alias("have")).collect()}
    for r in urlrules.decisions(p, rules).collect():
        assert r.rules == sorted(n for s, n in order.items() if set(s) <= have[r.page_id])
    assert seed == 3 or want


def test_tokens_that_all_urls_have_make_no_rule(spark):
    pages = [(i, f"https://good.example/{i}", "") for i in range(50)] + [(99, "https://good.example/" + "long/" * 20_000 + "99", "")]
    p = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for bad in (lambda i: i % 2, lambda i: 1, lambda i: 0):
        lab = spark.createDataFrame([(i, 1, int(bad(i))) for i in range(50)], "doc_id bigint, quality int, toxic int")
        out = urlrules.decisions(p, urlrules.mine(p, lab)).collect()
        assert len(out) == 51 and not any(r.drop for r in out)


def test_document_number(spark):
    from pyspark.sql import functions as F

    urls = ["http://a.b/fr/825?page=2", "https://m.a/en/25#top", "http://x/en/148.html", "http://x/en/853/", "http://x/", "x", None]
    d = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in d.select(urlrules.document_of(F.col("url"))).collect()] == [825, 25, 148, 853, None, None, None]


# 10: language


def test_language_on_held_out_rows(spark, clash, empty):
    rng = random.Random(2)
    stems = {"aa": ["tion", "the", "ing", "ous"], "bb": ["keit", "sch", "ung", "die"], "cc": ["eau", "oi", "les", "que"]}
    rows = []
    for i in range(600):
        lang = sorted(stems)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(6, 60))), lang, "s", 0))
    d = spark.createDataFrame(rows + [(700, None, None, None, None), (701, "", "aa", "s", 0), (702, "xx", "aa", "s", 0), (703, "!!! ???", "aa", "s", 0), (None, rows[0][1], "aa", "s", 0)], DOCS)
    m = langid.train(d.where("doc_id < 300"))
    out = {r.doc_id: r for r in langid.identify(d, m).collect()}
    assert len(out) == 605
    right = sum(out[i].predicted == rows[i][2] for i in range(300, 600))
    assert right >= 0.99 * 300
    assert all(out[i].predicted is None and out[i].share == 0 for i in (700, 701, 702, 703)) and out[None].predicted == "aa"
    assert langid.identify(empty, m).count() == 0 and langid.identify(clash, m).count() == clash.count()
    none = langid.train(empty)
    assert none.langs == [] and all(r.predicted is None for r in langid.identify(d, none).collect())


def test_every_labelled_language_is_known(spark):
    rows = []
    for k in range(130):
        own = f"{chr(97 + k // 12)}{chr(97 + k % 12)}"
        rows.append((k, " ".join(f"x{own}z{v}" for v in "aeiou"), f"l{k:03d}", "s", 0))
    d = spark.createDataFrame(rows, DOCS)
    m = langid.train(d)
    assert m.langs == [r[2] for r in rows]
    assert {r.doc_id: r.predicted for r in langid.identify(d, m).collect()} == {r[0]: r[2] for r in rows}


def test_grams_are_those_of_each_text():
    g, doc = langid.grams(pa.array(["ab  cd", None, "x", "É-b!c"]))
    want = [(d, x.encode()[i : i + 4]) for d, x in enumerate(["ab cd", "", "x", "é b c"]) for i in range(len(x.encode()) - 3)]
    assert [(d, int(v).to_bytes(4, "little")) for d, v in zip(doc.tolist(), g.tolist(), strict=True)] == want


# Pipeline


def test_pipeline_stages(spark, marked, rows, bench, tmp_path):
    labelled = marked[0].collect()
    base = [(r[0] + 10_000, *r[1:]) for r in labelled]
    table = base + [r for r in rows]
    docs = spark.createDataFrame(table, DOCS)
    labels = spark.createDataFrame([(r.doc_id + 10_000, r.quality, r.toxic) for r in marked[1].collect() if r.doc_id is not None], "doc_id bigint, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench[1])):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [Counter(r[0] for r in now.collect())]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(Counter(r[0] for r in now.collect()))
    toxic = {10_000 + i for i in range(1000) if i % 5 == 0}
    assert len(toxic & set(seen[1])) <= 0.05 * len(toxic) and set(seen[0]) - toxic <= set(seen[1])
    assert not {100, 103, 110, 114} & set(seen[2]) and {0, 1, 2, 120, 150, None, 130, 131} <= set(seen[2]) and set(seen[2].values()) == {1}
    assert not {4, 6, 133} & set(seen[3]) and set(seen[2]) - set(seen[3]) <= {4, 6, 133}
    assert set(seen[4]) <= set(seen[3]) and sum(seen[4].values()) > 0.5 * sum(seen[3].values())
    assert seen[5] == seen[4] and now.columns == [*docs.columns, "shard"]
    assert collected(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "shard")) == collected(now.select("doc_id", "shard"))


def test_pipeline_on_empty_documents(spark, tmp_path, empty, marked, bench):
    for name, df in (("documents", empty), ("labels", marked[1]), ("benchmark", bench[1])):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
