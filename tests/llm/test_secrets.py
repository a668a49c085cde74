"""Secrets against brute force, through the query's digests, and in every layer that has been found to hide one."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib

import pytest

pytest.importorskip("kinloom.llm")
from kinloom.llm import queries, secrets  # noqa: E402

SECRET = b"password=hunter2hunter2"
b64 = lambda raw: base64.b64encode(raw).decode()


def brute(text):
    """The base spans, straight from their definition."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] * (len(m[2]) >= 8)
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_the_query_equals_brute_force(spark, tmp_path):
    r = random.Random(1)
    bits = ["password", "PassWD", "token", "api_key", "apikey", "ſecret", "secret", '"', "'", " ", "  ", ":", "=", "abc.DEF/9", "x" * 8, "AKIA", "AKIAABCDEFGHIJKL", "0f" * 15, "0f" * 16, "g", "\n", "é", "😀", "K", "%", "\\u", "/"]
    texts = ["".join(r.choices(bits, k=r.randrange(1, 25))) for _ in range(400)] + [None, "", "a" * 1_000_000, " token=abcdefgh" * 50_000]
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[1], rows[1]], "doc_id long, text string, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for x in queries.op1_secret_scan(spark, str(tmp_path)).collect():
        got.setdefault((x.doc_id, x.base_sha256), []).append(x)
    assert sum(map(len, got.values())) == len(texts) + 2
    for i, t in enumerate(texts):
        want = brute(t or "")
        x = got[i if i % 50 else None, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()][0]
        if i % 50:
            assert [x.n_assign, x.n_access, x.n_hex] == [sum(w[0] == k for w in want) for k in secrets.KINDS]
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(x.spans.split(","))
    assert len(got[1, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[1])).encode()).hexdigest()]) == 3
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op1_secret_scan(spark, f"{tmp_path}/none").collect() == []


def kinds(text):
    return {f[0] for f in secrets.scan(text)[0]}


@pytest.mark.parametrize(
    "text",
    [
        b64(b"token=abcdefgh"),
        "%FF%74%6f%6b%65%6e=abcdefgh1",
        "%74%6f%FE%FF%6b %74%6f%6b%65%6e%3dabcdefgh1",
        "/srv/data/" + b64(b"some text, token=abcdefgh1"),
        "/a/b/" + b64(gzip.compress(SECRET)),
        "x/" + b64(bz2.compress(SECRET)),
        "\\uD83D\\uDE00\\u0074oken=abcdefgh1",
        b64(b"\x00\x01\x02\xff" + SECRET + b"\xfe\xfd"),
        b64(b"x^ is no zlib, " + SECRET),
        b64(gzip.compress(b"first") + gzip.compress(SECRET)),
        b64(bz2.compress(b"first") + bz2.compress(SECRET)),
        b64(lzma.compress(b"first") + lzma.compress(SECRET)),
        b64(zlib.compress(zlib.compress(gzip.compress(SECRET)))),
        b64(gzip.compress(SECRET * 20)[:-6]),
        b64(gzip.compress(b"first") + b"trailing rubbish") + " " + SECRET.decode(),
        "\n".join(re.findall(".{1,76}", b64(b"w " * 60 + SECRET + b" w" * 60))),
    ],
)
def test_a_layer_that_hides_a_secret(text):
    assert kinds(text) == {"assign"}


def test_zstandard_frames():
    zstandard = pytest.importorskip("zstandard")
    pack = zstandard.ZstdCompressor().compress
    assert kinds(b64(pack(b"first") + pack(SECRET))) == {"assign"}


def test_a_large_stream_is_read_to_its_end(monkeypatch):
    raw = b"nothing here " * 1_500_000  # 20 MB in some KB
    text = "é " + b64(gzip.compress(raw + SECRET + b" " + raw)) + " end"
    assert secrets.scan(text)[0] == [("assign", 2, len(text) - 4, 1)]
    monkeypatch.setattr(secrets, "PART", 1000)  # a secret that a part's end cuts
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    for n in (980, 990, 995, 1000, 1010):
        assert kinds(b64(zlib.compress(b"." * n + SECRET + b"." * 3000))) == {"assign"}


def test_what_unpacks_or_decodes_to_itself_ends():
    level = SECRET
    for _ in range(30):
        level = gzip.compress(level)
    assert kinds(b64(level)) == {"assign"}
    for text in ("%25" * 50, "%2525252525", "\\u005cu005c" * 20, b64(b"A" * 5000), "A" * 5000, "/" * 3000):
        assert secrets.scan(text)[0] == []
