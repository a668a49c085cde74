"""The queries' contracts against brute force: odd rows, null and large ids, copies, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("kinloom.llm")
from kinloom.llm import bpe, embed_dedup, packing, pii, queries, quality, sharding, url_filters  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " \t\n", "a", "x" * 1_000_000, "é " * 3000, "the same", "the same", "the same", "<|endoftext|>a", "Σίσυφος ΣΑΣ", "😀 " * 500]


def write(spark, path, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def documents(spark, path, texts):
    r = random.Random(1)
    return write(spark, path, [(i, t, None, r.choice(["hot", "hot", "b", None]), 1) for i, t in texts], DOCS)


def words(r, n):
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


def test_packing_keeps_ids_beside_null_ids(spark, tmp_path):
    r = random.Random(2)
    texts = [(2**53 + 1, words(r, 5)), (2**53 + 3, words(r, 900)), (None, "a b"), (None, None), *((i, t) for i, t in enumerate(TEXTS)), *[(7, "the same")] * 40]
    path = documents(spark, tmp_path, texts)
    rows = queries.op3_packing(spark, path).collect()
    model = bpe.WordBpe(bpe.default_path())
    want = Counter()
    for i, t in texts:
        ids = np.append(model.encode([t or ""])[0], 2).astype("<u4")
        want.update((i, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()), len(ids)) for at in range(0, len(ids), 4096))
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in rows) == want
    held = defaultdict(list)
    for x in rows:
        held[x.sequence_id].append((x.offset, x.length))
    assert all([o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 4096 for own in held.values())
    packed = packing.pack(spark.read.parquet(f"{path}/documents.parquet")).collect()
    got = Counter()
    for p in packed:
        at = 0
        for i, s, n in zip(p.doc_ids, p.starts, p.lengths):
            got[i, s, n, zlib.crc32(np.array(p.ids[at : at + n], "<u4").tobytes())] += 1
            at += n
        assert at == p.n_tokens and set(p.ids[at:]) <= {0} and len(p.ids) == 4096
    assert got == Counter({k[:4]: n for k, n in want.items()})
    assert packing.place(spark.createDataFrame([], DOCS)).collect() == packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_first_fit_decreasing_equals_a_plain_one():
    r = np.random.default_rng(1)
    for _ in range(50):
        sizes = r.integers(1, 101, r.integers(1, 80))
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            b = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
            room += [100] * (b == len(room))
            want[i] = (b, 100 - room[b])
            room[b] -= int(sizes[i])
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist()))} == want


def test_vectors_of_all_lengths_link(spark, tmp_path):
    r = np.random.default_rng(3)
    rows, near = [], []
    for size, n in ((16, 700), (64, 1500), (3, 40), (2, 30), (1, 4), (200, 20)):
        for _ in range(n // 2):
            a = r.normal(size=size)
            noise = r.normal(size=size)
            noise -= a * (noise @ a) / (a @ a)
            c = r.uniform(0.9805, 0.985)
            b = c * a / np.linalg.norm(a) + np.sqrt(1 - c * c) * noise / max(np.linalg.norm(noise), 1e-12) * (size > 1)
            rows += [[float(x) for x in a], [float(x) for x in b]]
    rows += [[1.0, 2.0], [1.0, 2.0], [1e200, 2e200], [0.0, 0.0], [1.0, float("nan")], [1.0, float("inf")], [1.0, None], None, []]
    table = [(i, v, i // 2 % 3) for i, v in enumerate(rows)] + [(10**6, [1.0, 2.0], None), (None, [5.0, 6.0, 7.0, 8.0], 1), (10**6 + 1, [5.0, 6.0, 7.0, 8.0], 1)]
    path = write(spark, tmp_path, table, "vec_id long, embedding array<double>, label int", "embeddings")
    got = {x.vec_id: x for x in queries.op6_embedding_dedup(spark, path).collect()}
    by = defaultdict(list)
    for i, v, label in table:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            by[label, len(v)].append((i, np.array(v) / np.abs(v).max()))
    want, links = Counter(), 0
    for own in by.values():
        unit = np.array([v / np.linalg.norm(v) for _, v in own])
        for x, n in zip(own, (unit @ unit.T >= 0.98).sum(1) - 1):
            want[x[0]] = int(n)
    assert all(got[i].n_links <= want[i] for i, *_ in table)
    for sizes in ({16, 64, 200}, {1, 2, 3, 4}):
        own = [i for (_, size), rows_ in by.items() if size in sizes for i, _ in rows_]
        assert sum(got[i].n_links for i in own) >= 0.97 * sum(want[i] for i in own), sizes
    same = [i for i, v in enumerate(rows) if v == [1.0, 2.0]]
    assert got[None].n_links == 1 and got[None].component_id == 10**6 + 1 and got[10**6].n_links == 0
    assert all(got[i].kept == (got[i].component_id == i) for i, *_ in table if i is not None) and len(same) == 2
    text = spark.createDataFrame([("a", [1.0, 2.0], 0), ("b", [1.0, 2.0], 0)], "vec_id string, embedding array<double>, label int")
    assert {x.component_id for x in embed_dedup.near_vectors(text).collect()} == {"a"}
    assert embed_dedup.near_vectors(text.limit(0)).collect() == []


def brute_pii(text):
    """The base spans, straight from their definition."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        out += [("card", *m.span())] * (14 <= len(d) <= 19 and total % 10 == 0)
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_equals_brute_force(spark, tmp_path):
    r = random.Random(4)
    bits = ["a", "B.c", "@", "@x", ".com", ".", "-", " ", "  ", "+", "+1", "(", ")", "1", "255", "256", "17.57.238.115", "4495114827612972", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "٣", "é", "\n", "%", "_", "274", "555-9629"]
    texts = ["".join(r.choices(bits, k=r.randrange(1, 25))) for _ in range(400)] + [None, "", "1" * 3_000, "a.b@c.de " * 5_000]
    path = documents(spark, tmp_path, [(i if i % 40 else None, t) for i, t in enumerate(texts)])
    got = defaultdict(list)
    for x in queries.op9_pii(spark, path).collect():
        got[x.doc_id, x.base_sha256].append(x)
    for i, t in enumerate(texts):
        want = brute_pii(t or "")
        x = got[i if i % 40 else None, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()][0]
        if i % 40:
            assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w[0] == k for w in want) for k in pii.KINDS]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(x.spans.split(","))
    assert brute_pii("card 4495114827612972, ip 17.57.238.115")[-1][0] == "ip"
    assert pii.shape("ab" * 40 + "9") != pii.shape("ab" * 40 + "x")
    empty = write(spark, tmp_path / "none", [], DOCS)
    assert queries.op9_pii(spark, empty).collect() == []


def test_quality_query_and_its_plan(spark, tmp_path):
    r = random.Random(5)
    path = documents(spark, tmp_path, [*enumerate(TEXTS), (None, words(r, 90)), (100, words(r, 90))])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = queries.op4_quality_cascade(spark, path).collect()
    assert len(rows) == len(TEXTS) + 2 and sorted(x.doc_id or -1 for x in rows if x.kept) == [-1, 100]
    assert {m[0] for m in quality.plan(docs)} == {rule.name for rule in quality.RULES}
    assert quality.cascade(docs.limit(0)).collect() == quality.keep_good(docs.limit(0)).collect() == []


def test_sharding_follows_fractional_ranks(spark, tmp_path):
    r = random.Random(6)
    texts = [(i if i % 30 else None, words(r, 4) if i % 7 else "copy é") for i in range(500)] + [*enumerate(TEXTS)]
    path = documents(spark, tmp_path, texts)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = queries.op8_sharding(spark, path).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in rows) == Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in texts)
    counts = Counter(x.shard for x in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(x.slot for x in rows if x.shard == s) == list(range(n)) for s, n in counts.items())
    # in the order of shards and slots the k-th of a source's n rows has the share (2k + 1) / 2n, and shares rise
    of, seen, last = Counter(x.stratum for x in rows), Counter(), 0.0
    for x in sorted(rows, key=lambda x: (x.shard, x.slot)):
        share = (2 * seen[x.stratum] + 1) / (2 * of[x.stratum])
        assert share >= last
        seen[x.stratum], last = seen[x.stratum] + 1, share
    assert sharding.shard(docs.limit(0)).collect() == []
    named = docs.selectExpr("*", "'u' as shard", "1 as slot", "2 as size", "3 as run")
    sharding.write_shards(named, f"{tmp_path}/shards", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter(x.shard for x in back.collect()) == counts and {"shard_", "slot_", "run_", "size", "text", "doc_id"} <= set(back.columns)
    assert Counter((x.doc_id, x.text) for x in back.collect()) == Counter((i, t) for i, t in texts)


def test_url_query_equals_brute_force(spark, tmp_path):
    r = random.Random(7)
    hosts = ["a.Org", "org", "example.org", "www.example.ORG", "notexample.org", "x.com", "com", "xcom", "b.net", "org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/a", "/de/b.html", "//es/", "/de"]
    urls = [f"{r.choice(['http', 'https'])}{r.choice(['://', '://', '://', ':/', ''])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=1', '#f', '?a=://b'])}" for _ in range(500)] + [None, "", "://", "a\n://x.org/\n"]
    path = write(spark, tmp_path, [(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string", "pages")
    stated = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
    rows = {x.page_id: x for x in queries.op10_url_filter(spark, path).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        where = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in stated if (host == h or host.endswith("." + h)) and where.startswith(p)]
        x = rows[i]
        assert (x.host, x.path, x.rule) == (host, where, max(fits)[1] if fits else None), u
        assert x.verdict == max(fits)[2] if fits else x.verdict in ("allow", "block")
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), []).collect() == []


def test_tokens_that_always_stand_together_are_one_item(spark):
    many = [f"t{i:02}" for i in range(20)]
    rows = [(many + ["x"], "block")] * 50 + [(many[:1] + ["y"], "allow")] * 50 + [([f"u{i}" for i in range(20)], "allow")] * 50 + [(None, "allow"), ([], "block"), (["x"], None)]
    began = time.perf_counter()
    mined = url_filters.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.1, 0.9)
    assert time.perf_counter() - began < 60
    index = url_filters.Index(mined)
    assert index.best(["t07"]).verdict == index.best(["x"]).verdict == "block" and index.best(["u3"]).verdict == index.best(["y"]).verdict == "allow"
    assert index.best(["t00"]) is None and len(mined) <= 8
