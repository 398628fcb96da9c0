"""The training-data operators on odd rows, on no rows, and against brute force."""

import collections
import hashlib
import math
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaestor.llm import common, exact_dedup, interpolation, language_id, minhash, mixing, neighbours, pieces, secrets, sharding, toxicity
from quaestor.llm.components import components

DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def driver_docs(spark):
    return common.read(spark, DIR, "documents")


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB \t\n\x0bé日") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, ""]
    names: dict = {}
    for a, b, raw, ends in common.packs(pa.array(texts), 16, 200):
        h, n = common.word_hashes(raw, ends)
        words = [lower(w) for t in texts[a:b] for w in WORDS.findall(t or "")]
        assert n.tolist() == [len(WORDS.findall(t or "")) for t in texts[a:b]] and len(h) == len(words)
        for w, x in zip(words, h.tolist()):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


# 1


def bag(text):
    w = [lower(x) for x in WORDS.findall(text or "")]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def classes(rows):
    """Brute force: components of pairs with multiset overlap of 0.8."""
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if min(len(a), len(b)) * 3 < max(len(a), len(b)):
                continue
            common_ = sum((a & b).values())
            if common_ >= 0.8 * (sum(a.values()) + sum(b.values()) - common_):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), math.inf), math.inf if k is None else k)
    return sorted((math.inf if k is None else k, least[top(i)]) for i, (k, _) in enumerate(rows))


def test_near_dedup_is_brute_force(spark, docs):
    for d in (docs, driver_docs(spark)):
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        got = minhash.near_dedup(d).collect()
        inf = lambda x: math.inf if x is None else x
        assert sorted((inf(r.doc_id), inf(r.class_id)) for r in got) == classes(rows)
        sizes = collections.Counter(r.class_id for r in got)
        assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_dedup_of_nothing(empty):
    assert minhash.near_dedup(empty).count() == 0


def test_bag_minhash_estimates_overlap():
    rng = np.random.default_rng(0)
    got, want = [], []
    for trial in range(30):
        d = np.sort(common.mix(np.arange(trial * 999, trial * 999 + 200, dtype=np.uint64)))
        x, y = rng.integers(1, 20, 200), rng.integers(1, 20, 200)
        h = minhash.bag_minhash([(d, x), (d, y), (d[:0], x[:0])])
        got.append((h[0] == h[1]).mean())
        want.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
        assert np.isinf(h[2]).all()
    assert abs(np.mean(got) - np.mean(want)) < 0.03


def test_signatures_do_not_depend_on_the_pack(monkeypatch):
    rng = np.random.default_rng(8)
    bags = [(np.sort(common.mix(np.arange(k * 1000, k * 1000 + n, dtype=np.uint64))), rng.integers(1, 6, n)) for k, n in enumerate((3, 12, 40, 200, 900))]
    whole = minhash.bag_minhash(bags)
    for points in (64, 5000, 1 << 19):
        monkeypatch.setattr(minhash, "POINTS", points)
        assert np.array_equal(whole, minhash.bag_minhash(bags[::-1])[::-1])
        assert all(np.array_equal(minhash.bag_minhash([b])[0], w) for b, w in zip(bags, whole, strict=True))


def test_near_dedup_with_hot_texts(spark, monkeypatch):
    """Copies of one text, near copies of one text, and a pair that only the second round links; two heads at most."""
    monkeypatch.setattr(common, "HEADS", 3)
    monkeypatch.setattr(minhash, "TOGETHER", 4)
    rng = random.Random(4)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = lambda k: " ".join([*text[:k], f"other{k}", *text[k + 1 :]])
    rows = [(k, " ".join(text)) for k in range(40)] + [(100 + k, near(3 * k)) for k in range(30)] + [(200 + k, f"alone {k} " * 9) for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_dedup(d, keep=("stays",)).collect()
    assert sorted((float(r.doc_id), float(r.class_id)) for r in got) == [(float(a), float(b)) for a, b in classes(rows)]
    assert sum(r.stays for r in got) == len({r.class_id for r in got})


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(20):
        d = common.mix(np.arange(500, dtype=np.uint64))
        a = (d[:400], rng.integers(1, 4, 400))
        b = (d[100:], rng.integers(1, 4, 400))
        p = minhash.parities([a, b])
        apart = sum(int(x).bit_count() for x in (p[0] ^ p[1]).view(np.uint64))
        ca, cb = collections.Counter(dict(zip(a[0].tolist(), a[1].tolist()))), collections.Counter(dict(zip(b[0].tolist(), b[1].tolist())))
        assert apart <= sum(((ca - cb) + (cb - ca)).values())


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(139, 200), (5, 5), (200, 139)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 61)} == {1} and {got[k] for k in [*range(100, 140), 200]} == {100} and len(got) == 101
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2


def test_interpolation_base_is_brute_force(spark, docs):
    for d in (docs, driver_docs(spark)):
        rows = [(r.doc_id, [lower(w) for w in WORDS.findall(r.text or "")] + [None]) for r in d.select("doc_id", "text").collect()]
        rest = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 for k, _ in rows]
        c = collections.Counter(w for (_, t), r in zip(rows, rest) if r for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(k), r == 0, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for (k, t), r in zip(rows, rest))
        got = interpolation.interpolated(d).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # held-out texts are likelier under the model


def test_interpolation_score_is_brute_force(spark, docs, monkeypatch):
    """Scores from counted bigrams and words under the learned weights; the weights are close to those of single tokens."""
    learned = []
    weights = interpolation.weights
    monkeypatch.setattr(interpolation, "weights", lambda *x, **y: learned.append(weights(*x, **y)) or learned[-1])
    for d in (docs, driver_docs(spark)):
        rows = [(r.doc_id, ["<", *[lower(w) for w in WORDS.findall(r.text or "")], ">"]) for r in d.select("doc_id", "text").collect()]
        rest = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 for k, _ in rows]
        got = sorted((str(r.doc_id), round(r.score, 6)) for r in interpolation.interpolated(d).collect())

        def counted(keep):
            one, two = collections.Counter(), collections.Counter()
            for (_, t), r in zip(rows, rest):
                if keep(r):
                    one.update(t)
                    two.update(zip(t, t[1:]))
            return one, two

        def parts(one, two, t):
            total = sum(n for w, n in one.items() if w != "<")
            for v, w in zip(t, t[1:]):
                yield min(one[v].bit_length(), interpolation.CONTEXTS - 1), two[v, w] / one[v] if one[v] else 0.0, one[w] / total

        one, two = counted(lambda r: r > 0)
        uniform, m = 1 / (len(set(one) - {"<"}) + 1), learned[-1]
        want = sorted((str(k), round(sum(math.log10(m[b] @ [p2, p1, uniform]) for b, p2, p1 in parts(one, two, t)), 6)) for k, t in rows)
        assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-6, atol=1e-5)
    base = counted(lambda r: 0 < r < 9)
    cells = [(b, 1, p2, p1) for (_, t), r in zip(rows, rest) if r == 9 for b, p2, p1 in parts(*base, t)]
    exact = weights(cells, uniform)
    seen = collections.Counter(b for b, *_ in cells)
    assert all(np.abs(exact[b] - m[b]).max() < 0.05 for b, n in seen.items() if n > 50)


def test_interpolation_weights_sum_to_one_and_fit():
    w = interpolation.weights([(3, 90, 0.5, 0.01), (3, 10, 0.0, 0.01)], 1e-4)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[0, 0] == 0


def test_interpolation_of_nothing(empty):
    assert interpolation.interpolated(empty).count() == 0


# 3


def test_slots_are_even_gapless_and_edited(spark, docs):
    for d in (docs, driver_docs(spark)):
        out, _ = sharding.place(d)
        rows = out.collect()
        assert len(rows) == d.count()
        for k in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
    size = {s: (s * 7919) % 1000 + 1 for s in range(512)}
    one = sharding.SlotMap.even(512, 8)
    two = one.rebalance(size)
    moved = [s for s in range(512) if one.shards[s] != two.shards[s]]
    assert two.version == 2 and [e[0] for e in two.edits] == moved and len(moved) < 256
    heavy = max(sum(size[s] for s in size if two.shards[s] == k) for k in range(8))
    assert heavy <= sharding.lightest_first(size, 8) * 1.01
    assert set(two.rebalance(size, 9).shards) == set(range(9))


def test_slots_are_brute_force(spark, docs):
    import xxhash

    d = driver_docs(spark)
    rows = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    got = sharding.op3_virtual_slots(spark, DIR).collect()
    assert len(got) == len(rows)
    want = {}
    for k, t in rows.items():
        raw = (t or "").encode()
        h = xxhash.xxh64_intdigest(struct.pack("<q", zlib.crc32(raw)), xxhash.xxh64_intdigest(struct.pack("<q", k), 42))
        want[k] = (len(raw) + 8, zlib.crc32(raw), (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS)
    assert {r.doc_id: (r.size, r.text_crc32, r.vslot) for r in got} == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(24))
    place = collections.defaultdict(list)
    for r in got:
        place[r.shard].append((r.slot, r.vslot, r.doc_id))
    for rows_ in place.values():
        assert [s for s, _, _ in sorted(rows_)] == list(range(len(rows_))) and sorted(rows_) == [(n, v, k) for n, (v, k) in enumerate(sorted((v, k) for _, v, k in rows_))]


def test_maps_are_stored_and_edited_later(spark, docs, tmp_path):
    path = f"{tmp_path}/maps"
    assert sharding.SlotMap.load(spark, path) is None
    _, one = sharding.place(driver_docs(spark), 8, 256, maps=path)
    more = driver_docs(spark).select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    _, two = sharding.place(more, 9, maps=path)
    assert (one.version, two.version) == (2, 3) and len(two.shards) == 256
    stored = [sharding.SlotMap.load(spark, path, v) for v in (1, 2, 3)]
    assert stored[0].shards == sharding.SlotMap.even(256, 8).shards and stored[1].shards == one.shards and sharding.SlotMap.load(spark, path).shards == two.shards
    assert {s for s in range(256) if one.shards[s] != two.shards[s]} == {s for s, _, _ in two.edits} and two.n_shards == 9


def test_slots_of_nothing(empty):
    assert sharding.place(empty)[0].count() == 0


# 4


@pytest.mark.parametrize("digest_bytes", [32, 1])  # one byte: nearly all digests collide, and bytes decide
def test_exact_dedup_is_brute_force(spark, docs, digest_bytes):
    for d in (docs, driver_docs(spark)):
        rows = [(r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect()]
        groups = collections.defaultdict(list)
        for k, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), math.inf if k is None else k))
        want = sorted((str(k), str(min(groups[n])[1]).replace("inf", "None"), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for k, t in rows for n in [re.sub(r"[\x20\x09-\x0D]", "", t)])
        got = exact_dedup.exact_dedup(d, digest_bytes).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_with_hot_texts_and_ids_of_text(spark, monkeypatch):
    monkeypatch.setattr(common, "HEADS", 3)
    monkeypatch.setattr(exact_dedup, "TOGETHER", 4)
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 16)
    rows = [(f"id{k:02}", "one  text" if k < 40 else "onetext" if k < 60 else f"text {k % 9}" + " " * (k % 3)) for k in range(90)]
    d = spark.createDataFrame([*rows, ("id00", "one  text"), (None, "onetext")], "doc_id string, text string").withColumn("digest", F.lit(1)).withColumn("_block", F.lit(2)).repartition(5)
    for size in (32, 1):
        got = exact_dedup.exact_dedup(d, size, keep=("stays",)).collect()
        assert {r.keep_id for r in got if r.doc_id is None or r.doc_id < "id60"} == {"id00"} and len(got) == 92
        assert [r.group_size for r in got if r.doc_id == "id59"] == [62]
        assert sum(r.stays for r in got) == 10 and sum(r.kept for r in got) == 11
        assert {r.keep_id for r in got if r.doc_id and r.doc_id >= "id60"} == {min((-len(t), k) for k, t in rows[60:] if t.split()[1] == str(n))[1] for n in range(9)}


def test_index_of_batches(spark):
    index = exact_dedup.DigestIndex(spark)
    batch = lambda a, b: exact_dedup.digests(common.located(spark.createDataFrame([(k, f"text {k % 50}") for k in range(a, b)], "doc_id long, text string"), "doc_id", "text"))
    assert index.lookup(batch(0, 5)).count() == 0
    for k in range(5):
        index.add(batch(20 * k, 20 * k + 20))
    assert [level for level, _ in index.live] == [1, 0]  # four runs became one
    again = exact_dedup.DigestIndex.open(spark, index.folder)
    assert (again.version, again.live) == (index.version, index.live)
    found = {r.doc_id: (r.held_id, r.held_n) for r in again.lookup(batch(140, 160)).collect()}
    assert found == {k: (k % 50, 2) for k in range(140, 150)} | {k: (k % 50, 2) for k in range(150, 160)}
    assert again.compact().count() == 50 and [level for level, _ in again.live] == [2]
    keys = batch(0, 40).select("digest")
    f = exact_dedup.Filter(keys, 40)
    hits = f.probe(batch(0, 50)).collect()
    assert all(r.maybe for r in hits if r.doc_id < 40) and sum(r.maybe for r in hits) < 45


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# 5


def test_languages(spark, docs, empty):
    d = common.read(spark, "/root/testdata/sf0.01", "documents")
    learned = language_id.prototypes(d.where((common.remainder("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    held = d.where(common.remainder("doc_id", 4) == 2)
    out = language_id.predict(held, *learned, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    odd = {r.text: r for r in language_id.predict(docs, *learned, keep=("doc_id", "text")).collect()}
    assert {odd[t].lang_pred for t in (None, "", "12 34 !!")} == {"und"} and odd["Der schnelle braune Fuchs springt"].lang_pred == "de"
    assert language_id.predict(empty, *learned).count() == 0
    none = language_id.prototypes(empty)
    assert {r.lang_pred for r in language_id.predict(docs, *none).collect()} == {"und"}


def test_languages_are_brute_force(spark, monkeypatch):
    """Vectors of the n-grams one by one, from the letters' vectors; and the query's columns."""
    dim, sp = 64, language_id.Space(64)
    letters = np.random.default_rng(11).integers(0, 2, (language_id.SYMBOLS, dim)).astype(int) * 2 - 1

    def vector(text):
        symbols = [int(sp.symbol[ord(c)]) for c in (text or "").lower()]
        plain = [0] + [s for s, before in zip(symbols, [0, *symbols]) if s or before]
        plain = plain if plain[-1] == 0 else [*plain, 0]
        out = np.zeros(dim)
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out, len(plain) - 2

    rows = [(1, "the quick brown fox", "en"), (2, "Der Fuchs, schnell!", "de"), (3, "the dog", "en"), (4, "le renard  brun", "fr"), (5, "12", "en"), (6, None, "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, protos = language_id.prototypes(d, dim)
    want = {}
    for _, t, lang in rows:
        v, n = vector(t)
        if n > 0 and any(c.isalpha() for c in t or ""):
            want[lang] = want.get(lang, 0) + v / n
    assert names == sorted(want) and np.allclose(protos, [want[k] / np.linalg.norm(want[k]) for k in names], atol=1e-5)
    tests = spark.createDataFrame([(1, "the brown dog"), (2, "der Hund"), (3, "renard"), (4, "?!")], "doc_id long, text string")
    cos = {}
    for r in tests.collect():
        v, _ = vector(r.text)
        cos[r.doc_id] = [v @ p / max(np.linalg.norm(v), 1e-12) for p in protos]
    for most in (2000, 1):  # one pass over the texts, and one for each language
        monkeypatch.setattr(language_id, "LANGUAGES", most)
        for r in language_id.predict(tests, names, protos).collect():
            if r.doc_id < 4:
                assert r.lang_pred == names[int(np.argmax(cos[r.doc_id]))] and r.score == pytest.approx(max(cos[r.doc_id]), abs=1e-5)
            else:
                assert (r.lang_pred, r.score) == ("und", 0.0)
    out = language_id.op5_hyperdimensional(spark, DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out) and len(out) == driver_docs(spark).count()


def test_binding_is_position_aware():
    sp = language_id.space(language_id.DIM)
    g = lambda s: sp.vectors(sp.counts([s])[0])
    assert g("abc").shape[1] == language_id.DIM
    a, b = sp.vectors(np.array([(1 * 128 + 2) * 128 + 3])), sp.vectors(np.array([(3 * 128 + 2) * 128 + 1]))
    assert abs(float((a @ b.T)[0, 0])) < 200


# 6


def test_mixture(spark, docs, empty):
    for d in (docs, driver_docs(spark)):
        sizes = {r.source: r.n for r in mixing.sized(d).groupBy("source").agg(F.sum("size").alias("n")).collect()}
        got = mixing.mix(d).collect()
        assert len(got) == d.count() and all(0 <= r.taken <= 2 * r.size for r in got)
        target = {r.source: r for r in mixing.targets(mixing.sized(d)).collect()}
        assert sum(r.target for r in target.values()) == pytest.approx(1.5 * sum(sizes.values()))
        assert all(r.target <= 2 * r.source_size + 1e-9 for r in target.values())
        taken = collections.Counter()
        for r in got:
            taken[r.source_size, round(r.target, 6)] += r.taken
        want = collections.Counter()
        for r in target.values():
            want[r.source_size, round(r.target, 6)] += r.target
        assert all(abs(taken[k] - want[k]) <= 1.5 for k in want)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d).collect()))
    assert mixing.mix(empty).count() == 0


def test_schedule_is_spread(spark):
    s = spark.createDataFrame([(0, "a", 100_000, 150_000.0), (1, "b", 50_000, 50_000.0)], "sid int, source string, source_size long, target double")
    rows = mixing.schedule(spark, s).orderBy("k").collect()
    assert sum(r.take for r in rows if r.sid == 0) == 150_000 and sum(r.take for r in rows if r.sid == 1) == 50_000
    half = rows[: len(rows) // 2]
    share = sum(r.sid == 0 for r in half) / len(half)
    assert abs(share - sum(r.sid == 0 for r in rows) / len(rows)) < 0.03


# 7


def test_neighbours_are_exact(spark, empty):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 16)) * rng.random((3000, 1)) * 3
    v[500:900] = v[500]  # many equal vectors
    rows = [(int(k), [float(np.float32(x)) for x in r]) for k, r in enumerate(v)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [float("inf")] + [1.0] * 15), (9006, [1.0]), (9007, [None] + [1.0] * 15), (None, [1.0] * 16), (1, rows[1][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("block", F.lit("x"))
    got = collections.defaultdict(list)
    for r in neighbours.neighbours(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.array([r for _, r in rows])
    assert set(got) == set(range(0, 3000, 20))
    for q in got:
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -s))[:20]
        assert [k for k, _ in got[q]] == order.tolist() and np.allclose([s_ for _, s_ in got[q]], s[order], rtol=1e-12)
    assert neighbours.neighbours(empty.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))).count() == 0


def test_neighbours_of_other_id_types(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    long = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).collect()
    assert sorted(neighbours.neighbours(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), 3).collect()) == sorted(long)
    with pytest.raises(ValueError, match="whole numbers"):
        neighbours.neighbours(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_hilbert_keys_are_a_curve():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    k = neighbours.hilbert_keys(g, 3)
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_windows_find_most_of_structured_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 2)) @ rng.standard_normal((2, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(int(k), [float(y) for y in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").where("vec_id % 20 <> 0 OR vec_id < 2000")
    exact = {(r.query_id, r.vec_id) for r in neighbours.neighbours(rows).collect()}
    near = {(r.query_id, r.vec_id) for r in neighbours.neighbours(rows, exact=False).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


# 8


def test_toxicity_finds_disguised_words(spark, docs, empty):
    rng = random.Random(5)
    clean = ["garden", "river", "music", "window", "paper", "summer", "letter", "stone", "bridge", "forest", "you", "are", "this", "is", "the", "i", "saw", "a"]
    bad = ["idiot", "moron", "loser"]
    rows, labels = [], []
    for k in range(900):
        t = [rng.choice(clean) for _ in range(12)]
        toxic = k % 5 == 0
        if toxic:
            t[rng.randrange(12)] = rng.choice(bad)
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(toxicity.sample(d, y), toxicity.trigrams(d))
    held = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert all((held[k] >= 0.7) == bool(t) for k, t in labels)
    tests = ["you 1d10t", "what a m0r0n!", "l-o-s-e-r", "i d i o t", "mooorooon", "l0$er", "yo u id iot", "this is a m o r o n", "the los er i saw", "the garden by the r1ver", "a ga rd en", "", None, "!!! ???"]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert [s >= 0.7 for s in got] == [True] * 9 + [False] * 5
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(d, toxicity.learn(toxicity.sample(d, y.limit(0)), toxicity.trigrams(d))).collect()} == {0.0}


def test_decoding_is_the_least_of_all_paths():
    grams = collections.Counter()
    for w in "you are a stupid idiot in the river of music loser moron".split():
        w = f"^^{w}$"
        grams.update(w[i : i + 3] for i in range(len(w) - 2))
    channel = toxicity.Channel(dict(grams))

    def cost(choice):
        total, a, b = 0.0, "^", "^"
        for letters, own in choice:
            total += own
            if letters == " ":
                if b == "^":
                    return math.inf
                total, a, b = total + channel.cost(a, b, "$"), "^", "^"
            else:
                for c in letters:
                    total, a, b = total + channel.cost(a, b, c), b, c
        return total + channel.cost(a, b, "$")

    for text in ("1d10t", "m0oor!n", "l-o-s-e-r", "yo u id 1", "s t u p 1 d", "a b", "$+up1d"):
        paths = {"".join(x for x, _ in choice): cost(choice) for choice in itertools.product(*toxicity.Channel.lattice(text))}
        got = channel.decode(text)
        assert paths[got] == pytest.approx(min(paths.values()))
        assert toxicity.skeleton(got.replace(" ", "")) == toxicity.skeleton(text.replace(" ", ""))


def test_toxicity_is_brute_force(spark):
    """G2, weights and scores of the query, word by word; and the query's columns."""
    docs, labels = driver_docs(spark), common.read(spark, DIR, "labels")
    grams = toxicity.trigrams(docs)
    words = collections.Counter(w for r in docs.collect() for w in (r.text or "").lower().split())
    want = collections.Counter()
    for w, k in words.items():
        w = w.strip(toxicity.EDGE)
        if toxicity.LETTERS.fullmatch(w):
            for g in zip(f"^^{w}$", f"^{w}$", f"{w}$"):
                want["".join(g)] += k
    assert grams == {g: k for g, k in want.items() if k > 1}
    rows = toxicity.sample(docs, labels)
    _, weights, prior = toxicity.learn(rows, grams)
    channel, a, b, n = toxicity.Channel(grams), collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows.collect():
        low = (r.text or "").lower()
        restored = [channel.restore(w) for w in toxicity.tokens(low)] + [w for x in toxicity.runs(low, toxicity.SPELLED) for w in channel.words(x)]
        n[r.toxic] += 1
        (a if r.toxic else b).update({f for w in restored for f in toxicity.features(w)})
    assert prior == (n[1] + 0.5) / (n[1] + n[0] + 1)
    for f, w in weights.items():
        assert w == pytest.approx(math.log((a[f] + 0.5) / (n[1] + 1)) - math.log((b[f] + 1.5) / (n[0] + 2))) and w >= toxicity.MIN_WEIGHT
        table = np.array([[a[f], b[f]], [n[1] - a[f], n[0] - b[f]]], float)
        expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
        assert 2 * (table * np.log(np.where(table > 0, table, 1) / expected))[table > 0].sum() >= toxicity.MIN_G2
    out = {r.doc_id: r for r in toxicity.op8_deobfuscation(spark, DIR).collect()}
    for r in docs.collect():
        low = (r.text or "").lower()
        found = set()
        for w in [channel.restore(w) for w in toxicity.tokens(low)] + [w for x in toxicity.runs(low) for w in channel.words(x)]:
            hits = [f for f in toxicity.features(w) if f in weights]
            found |= {max(hits, key=weights.get)} if hits else set()
        z = math.log(prior / (1 - prior)) + sum(weights[f] for f in found)
        got = out[r.doc_id]
        assert got.score == pytest.approx(1 / (1 + math.exp(-z))) and got.predicted == int(got.score >= 0.7)
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


# 9


def test_pieces_equal_the_library(spark, docs, empty):
    import sentencepiece

    path = pieces.default_model()
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(path)
    rng = random.Random(7)
    vocabulary = list(own.id)
    texts = ["", None, " ", "\n", "▁", "a  b   c    ", " " * 40 + "d", "<s></s><unk><0x41>", "日本語 한국어 العربية 😀é̂", "\x00a", "the" * 3000, "a" * 5000]
    texts += ["".join(rng.choice("abcdefgh ijklmn  opéßñ日😀\t\nTHEing") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice(vocabulary).replace("▁", rng.choice([" ", ""])) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    for t in texts:
        ids = lib.encode(t or "", num_threads=1)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids) == own.run(t)[2]
    got = pieces.encode_column(docs, path).collect()
    assert len(got) == docs.count() and pieces.digest_column(empty, path).count() == 0
    want = sorted((str(r.doc_id), lib.encode(r.text or "", num_threads=1)) for r in docs.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in (docs, driver_docs(spark)):
        want = []
        for r in d.collect():
            ids = lib.encode(r.text or "", num_threads=1)
            want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest_column(d, path).collect()) == sorted(want)


def test_other_settings_are_refused(monkeypatch):
    model, settings = pieces.read_model(pieces.default_model())
    assert settings == pieces.SETTINGS
    monkeypatch.setattr(pieces, "read_model", lambda path: (model, {**settings, "squeezes": True}))
    with pytest.raises(ValueError, match="squeezes"):
        pieces.Codec("x")


def test_backtracking_equals_merging():
    own = pieces.codec(pieces.default_model())
    rng = random.Random(9)
    for _ in range(3000):
        s = "".join(rng.choice("abcdefghinorstuel▁") for _ in range(rng.randrange(1, 25))).replace("▁▁", "▁")
        if "▁▁" not in s:
            assert [own.text[i] for i in own.backtrack(s)] == own.merge(s)


# 10


def secret_spans(text):
    out = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for n, c in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(c.pattern[2:], text):
            if any(re.search(a, m[0]) for a in secrets.ALLOW):
                continue
            hot = [i for i in range(len(m[0]) - c.window + 1) if -sum(k / c.window * math.log2(k / c.window) for k in collections.Counter(m[0][i : i + c.window]).values()) >= c.bits]
            if hot:
                out.append((m.start() + hot[0], n, m.start() + hot[-1] + c.window))
    return sorted(out)


def test_secrets_are_brute_force(spark, docs, empty):
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
    make = lambda k, a=alphabet: "".join(rng.choice(a) for _ in range(k))
    texts = ["token=token:abcdef", "Api-Key api_key = 'abc.def/1'", "é😀 password : hunter22", "AKIAAKIA" + make(20, "ABC123"), "AKIA" + make(15, "AB1"), make(23, "0123456789abcdef") + " " + make(64, "0123456789abcdef")]
    texts += [" ".join(rng.choice(["word", "secret=", make(30), make(45, "abcdef0123456789"), "x" * 30, "token: " + make(7), "é", "password=short", "some_long_plain_identifier_name_12", make(25, "0123456789")]) for _ in range(12)) for _ in range(150)]
    texts += ["token=abcdef1 " * 700]  # many matches in one text
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    kinds = ("assign", "access", "hex", "entropy64", "entropy16")
    want = sorted((str(r.doc_id), str(secret_spans((r.text or "").replace("\x01", "\x03").replace("\x02", "\x03")))) for r in d.collect())
    got = secrets.scan(d).collect()
    assert sorted((str(r.doc_id), str(sorted((s.start, s.kind, s.end) for k in kinds for s in r[k]))) for r in got) == want
    assert secrets.scan(empty).count() == 0


def test_secrets_in_long_candidates(spark):
    rng = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    make = lambda k, a=alphabet: "".join(rng.choice(a) for _ in range(k))
    quiet = "ab1" * 20_000 + make(60, "xy9") + "cd2" * 5_000
    texts = [make(10_000), make(100_000), "data:image/png;base64," + make(30_000) + "==", quiet, quiet[:40_000] + make(25) + quiet[:40_000], "aa-" * 40_000 + "b", make(20_000, "0123456789abcdef")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((s.start, s.kind, s.end) for k in ("assign", "access", "hex", "entropy64", "entropy16") for s in r[k]) for r in secrets.scan(d).collect()}
    assert got == {k: secret_spans(t) for k, t in enumerate(texts)}


def test_workers_keep_one_operators_memory():
    gone = []
    common.only("one", lambda: gone.append("one"))
    common.only("one", lambda: gone.append("one"))
    assert gone == []
    common.only("two", lambda: gone.append("two"))
    assert gone == ["one"]


def test_language_counts_in_slices(monkeypatch):
    texts = ["", "Ab c", "xyz xyz", "abcdefgh " * 50, "1 2 3"]
    batch = pa.record_batch({"text": pa.array([*texts, None])})
    sp = language_id.space(64)
    whole = next(language_id._profiles(sp, batch))
    monkeypatch.setattr(language_id, "CELLS", 1)
    monkeypatch.setattr(language_id, "BLOCK", 2)
    parts = list(language_id._profiles(sp, batch))
    assert [p[0] for p in parts] == list(range(6))
    assert np.array_equal(np.vstack([p[2] for p in parts]), whole[2])
    assert np.array_equal(np.concatenate([p[3] for p in parts]), whole[3])
    assert np.array_equal(np.vstack([sp.bundle(p[1], p[2]) for p in parts]), whole[2] @ sp.vectors(whole[1]))
