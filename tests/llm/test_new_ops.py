"""Alignment of tokenizers, whitening, and URL filters on odd rows, on no rows, and against brute force."""

import collections
import hashlib
import random
import re
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import alignment, common, url_filter, whitening

DIR = "/root/testdata/sf0.001"

# 11


def aligned(rows):
    """Brute force: whole texts by the libraries of both files, sets of common ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_models()
    a_side, b_side, letters = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), alignment.byte_letters()
    a_side.encode_special_tokens = True
    spell = lambda k: bytes([int(b_side.id_to_piece(k)[3:5], 16)]) if b_side.is_byte(k) else b_side.id_to_piece(k).replace("▁", " ").encode()
    docs = []
    for i, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        x, y = [bytes(letters[c] for c in a_side.id_to_token(k)) for k in a], [spell(k) for k in b]
        groups = []
        if text and b"".join(x) == b"".join(y) == (" " + text).encode():
            ends = sorted(set(accumulate(map(len, x))) & set(accumulate(map(len, y))))
            groups = [([], []) for _ in ends]
            for side, ids, parts in ((0, a, x), (1, b, y)):
                for k, e in zip(ids, accumulate(map(len, parts))):
                    groups[next(g for g, end in enumerate(ends) if end >= e)][side].append(k)
        else:
            a = b = []
        docs.append((i, a, b, groups))
    links = [[(p, q) for u, v in g for p in u for q in v] for *_, g in docs]
    count = collections.Counter(p for own in links for p in set(own))
    most = collections.Counter()
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    text = lambda g: ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)
    return [(i, len(a), len(b), len(g), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text(g).encode()).hexdigest() if g else "") for (i, a, b, g), own in zip(docs, links)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_is_brute_force(spark, docs, empty):
    rng = random.Random(11)
    odd = ["".join(rng.choice("ab 1é\n\t ^日😀 ▂'s\x1f<|endoftext|>") for _ in range(rng.randrange(60))) for _ in range(60)]
    odd += ["x▁y", "▁", " ", "  two  spaces ", "\nline", "a  b", "don't 12,345 ...", "<|endoftext|>", "zz" * 4000, " " * 700]
    rows = [(k, t) for k, t in enumerate(odd)] * 2 + [(r.doc_id, r.text) for r in docs.collect()] + [(r.doc_id, r.text) for r in common.read(spark, DIR, "documents").select("doc_id", "text").collect()]
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in rows]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit(1)).withColumn("packet", F.lit("x")).repartition(5)
    got = alignment.align(table, *alignment.default_models()).select(*COLUMNS).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(aligned(rows), key=key)
    assert alignment.align(empty, *alignment.default_models()).collect() == []
    nulls = spark.createDataFrame([("a", None), (None, "")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_links, r.groups_sha256) for r in alignment.align(nulls, *alignment.default_models()).collect()) == [("", 0, ""), ("a", 0, "")]


def test_wide_groups_count_the_same(monkeypatch):
    texts = ["the theatre of 日本 😀😀 and  more", "x" * 50, "ÿþýü" * 20]
    a = alignment.Aligner(*alignment.default_models()).align(texts)
    monkeypatch.setattr(alignment, "WIDE", 1)
    b = alignment.Aligner(*alignment.default_models()).align(texts)
    assert a[0].tolist() == b[0].tolist() and a[1] == b[1] and sum(a[4]) == sum(b[4])


def test_encoder_equals_the_library_of_the_file():
    from tokenizers import Tokenizer

    path = alignment.default_models()[0]
    encode, _ = alignment.byte_level(path)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    points = [c for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = [f" a{chr(c)}b 1{chr(c)}2 !{chr(c)}! {chr(c)}x{chr(c)}{chr(c)} y'{chr(c)}s" for c in points]
    assert [encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_cutters_are_refused(tmp_path):
    import json

    with open(alignment.default_models()[0], encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="byte-level"):
        alignment.byte_level(str(tmp_path / "t.json"))


# 12


def whitened(ids, x, k=8):
    n = len(x)
    apart = n * x - x.sum(axis=0)
    c = apart.astype(np.float64) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e, c @ u / np.sqrt(e), (apart.astype(object) ** 2).sum(axis=1), (c * c).sum() / n


@pytest.mark.parametrize("rank", [None, 9])
def test_whitening_is_brute_force(spark, rank):
    if rank:  # vectors of low rank: the random range suffices
        rng = np.random.default_rng(4)
        v = (rng.standard_normal((300, rank)) * np.arange(rank, 0, -1)) @ rng.standard_normal((rank, 40))
        v = np.round(v * 1024) / 1024
    else:
        v = np.array([r.embedding for r in common.read(spark, DIR, "embeddings").orderBy("vec_id").collect()])
    table = spark.createDataFrame([(k, [float(c) for c in row], k % 3) for k, row in enumerate(v)], "vec_id long, embedding array<double>, x int").repartition(4)
    got = whitening.whiten(table).toPandas()
    x = np.floor(v * 1024).astype(np.int64) + 100_000
    e, w, deviation, trace = whitened(None, x)
    own = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(own * np.sign((own * w).sum(axis=0)) - w).max() < 1e-8
    assert got.groupby("vec_id").deviation.first().tolist() == deviation.tolist() and set(got.n) == {len(v)}
    assert np.allclose(got.groupby("component").explained.first(), e / trace, rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    span = whitening.components(whitening.whole(table), whitening.centre(whitening.whole(table))).span
    assert span == (18 if rank else 64)


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).toPandas()
    assert got.vec_id.fillna(-1).tolist().count(1) == 4 and len(got) == 8 and set(got.component) == {1, 2} and set(got.n) == {4} and got.identity_error.max() < 1e-9
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])], "vec_id int, embedding array<double>")).toPandas()
    assert flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all()
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in one] == [(None, None, 0)] * 2
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [0.0, 5.0])], "vec_id int, embedding array<double>")).collect()
    assert {r.deviation for r in far if r.vec_id == 1} == {None} and all(r.identity_error < 1e-9 for r in far)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


# 13


URLS = [
    "https://a.com/en/1", "http://EXAMPLE.com/en/2", "http://example.com/en", "http://www.example.com/en/3?utm_source=x&b=2&a=1#top", "ftp://x.net/es/", "x.net/es/", None, "", "://", "http://", "http://net/es/", "http://a.net/es", "http://anet/es/x",
    "http://b.org/p/?a=1&b=2", "https://b.org:443/p?b=2&a=1&ref=z", "https://B.ORG/p?b=2&a=1#f", "http://b.org/p?b=2&a=1&c", "http://user@com:80/x", "http://www.example.com.:8080/en/", "a http://q.com/://net/es/", "http://ü.com/ö?ä=1", "http://..com/", "http://com", "http://com?x=/", "http://x.org/" + "long/" * 5000, "http://" + "a." * 5000 + "net/fr/x",
]


def judged(rows):
    """Brute force over (page_id, url, number of the row)."""
    def parts(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        after = rest[len(host) + len(path) :]
        query = after[1:].split("#", 1)[0] if after[:1] == "?" else ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        kept = "&".join(sorted((p for p in query.split("&") if p and not re.match(url_filter.TRACKING, p)), key=str.encode))
        return low, path, re.sub(url_filter.PORTS, "", low) + path.rstrip("/") + ("?" + kept if kept else "")

    ids = collections.defaultdict(set)
    for i, u in rows:
        ids[parts(u)[2]].add(i)
    out = []
    for i, u in rows:
        host, path, canon = parts(u)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        known = ids[canon] - {None}
        listed = canon is not None and len(ids[canon]) > 1 and bool(known)
        rule = max(fit)[1:] if fit else (None, "block" if listed and i != min(known) else "allow")
        out.append((i, host, path, *rule, canon, listed))
    return out


def test_url_filter_is_brute_force(spark, monkeypatch):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[14]), (13, URLS[13]), (13, URLS[13]), (100, URLS[14]), (None, None), (7, "http://never.org/"), (None, "http://only.org/null"), (None, "http://only.org/null/")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, key string, block int")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    run = lambda: sorted((tuple(r) for r in url_filter.judge(table, url_filter.rule_table(spark), url_filter.repeated(table)).collect()), key=key)
    assert run() == sorted(judged(rows), key=key)
    monkeypatch.setattr(url_filter, "PER_BLOCK", 1)
    assert run() == sorted(judged(rows), key=key)
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.rule_table(spark), url_filter.repeated(none)).collect() == []


def test_url_filter_is_its_sql(spark, tmp_path):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(200 + k, u) for k, u in enumerate(URLS)] + [(None, URLS[15])]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(url_filter.SQL).fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in url_filter.op13_blocked_bloom(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)


def test_bloom_passes_all_listed_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).cache()
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    for at_most in (url_filter.BLOCKS, 1):  # blocks broadcast, and by shuffle
        assert url_filter.passing(keys, keys, at_most).count() == 20_000
        assert url_filter.passing(others, keys, at_most).count() < 400


def test_listed_urls_of_others(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x/"), (2, "https://bad.org/x?utm_source=1"), (3, "http://bad.org/y"), (4, "http://sub.bad.com/x")], "page_id int, url string")
    listed = spark.createDataFrame([("bad.org/x", None), ("sub.bad.com/x", None)], "canonical string, first int")
    rules = spark.createDataFrame([("COM", "/", "allow"), ("com", "/", "block"), ("bad.com", "", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict, r.listed) for r in url_filter.judge(pages, rules, listed).collect()}
    assert got == {1: (None, "block", True), 2: (None, "block", True), 3: (None, "allow", False), 4: ("bad.com", "allow", True)}
