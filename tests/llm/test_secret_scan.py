import base64
import bz2
import gzip
import hashlib
import lzma
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard
from pyspark.sql import functions as F

from corpuslens.llm import queries as Q
from corpuslens.llm import secret_scan as S

SECRET = "password=Zx9Kq81mPw"


def base(text):
    """The contract's base rule, word for word."""
    out = []
    pats = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[2]) >= 6),
            (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24)]
    for k, (p, flags, ok) in enumerate(pats):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "", flags) if ok(m)]
    return [(S.KINDS[k], s, e) for s, k, e in sorted(out)]


def spans(text):
    return [(k, s, e) for k, s, e, _ in S.find_secrets(text)[0]]


def test_base_rule():
    for t in ["", SECRET, "token=token:abcdefgh", "PASSWORD : 'abcdef' api_key=\"123456\" apikey:12345", "to\u212aen=abcdefgh \u017fecret=abcdefgh",
              "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 30, "x" + "0af" * 8, "é" * 5 + "secret = abcdef0123456789abcdef0123 tail"]:
        got = S.find_secrets(t)[0]
        assert [(k, s, e) for k, s, e, layer in got if not layer] == base(t), t


b64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize("wrap", [
    lambda s: b64(s.encode()), lambda s: b64(s.encode()).rstrip("="), lambda s: base64.urlsafe_b64encode(s.encode()).decode(),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    lambda s: "".join(f"%{b:02X}" for b in s.encode()), lambda s: b64(gzip.compress(s.encode())), lambda s: b64(zlib.compress(s.encode())),
    lambda s: b64(bz2.compress(s.encode())), lambda s: b64(lzma.compress(s.encode())), lambda s: b64(zstandard.compress(s.encode())),
    lambda s: b64(gzip.compress(b64(gzip.compress(s.encode())).encode())), lambda s: b64(quote(b64(s.encode()), safe="").encode()),
    lambda s: "".join(f"%{b:02x}" for b in gzip.compress(s.encode())), lambda s: quote("".join(f"\\u{ord(c):04x}" for c in b64(s.encode())), safe="")])
def test_nested_layers_map_to_the_wrapped_region(wrap):
    inner = wrap(f"note {SECRET} end")
    text = f"é plain {inner} tail"
    found = [x for x in S.find_secrets(text)[0] if x[0] == "assign"]
    assert found, text
    for _, s, e, layer in found:
        assert layer and 8 <= s < e <= 8 + len(inner)


def test_exact_mapping():
    text = "ab pass%77ord%3Dabc123def z"
    assert spans(text) == [("assign", 3, len(text) - 2)]
    coded = "x " + b64(b"0123456789 token=abcdefgh rest")
    (k, s, e), = [x for x in spans(coded) if x[0] == "assign"]
    assert b"token=abcdefgh" in base64.b64decode(coded[2:][(s - 2) // 4 * 4:-(-(e - 2) // 4) * 4])
    two = "\\ud83d\\ude00 secret=\\u0061bcdefg"
    assert spans(two)[0][2] == len(two)


def test_wrapped_lines_and_neighbours():
    code = b64(b"some longer text around it, token=abcdefgh1234 and more words after it")
    folded = "\n".join(code[i:i + 32] for i in range(0, len(code), 32))
    assert any(k == "assign" for k, _, _ in spans(f"begin\n{folded}\nend"))
    assert any(k == "assign" for k, _, _ in spans(f"{b64(b'token=abcdefgh1')}\nanotherquitelongwordhere"))


def test_short_last_lines_and_codes_inside_runs():
    for n in range(30, 100):
        body = b"x" * n + b" password=Sup3rSecretValue99xyz"
        for code in (base64.encodebytes(body).decode(), base64.encodebytes(body).decode().replace("\n", "\r\n"), base64.encodebytes(body).decode().replace("\n", "\\n")):
            text = f"a\n{code}b"
            place = text.index(code.strip("\\nr=")[-20:]) + 20  # of the code's end, where the secret is
            assert any(k == "assign" and place - 4 <= e for k, _, e in spans(text)), (n, text)
    for n in range(4):
        code = base64.urlsafe_b64encode(b"token=abcdefgh1234" + b"z" * n).decode()
        for front in ("https://h.io/", "id-", "k_", "\\n", "abc/d", "x+", "line\n", "averylongwordinfront\n"):
            for back in ("", "/x", "-tail", "_y1"):
                assert any(k == "assign" for k, _, _ in spans(f"see {front}{code}{back} end")), (front, code, back)
    for raw in (b"\xff\xfe caf\xe9 " + SECRET.encode(), "é".encode("latin-1") + SECRET.encode() + b"\x80"):
        assert spans(b64(raw)) and spans(b64(gzip.compress(raw)))


def test_cycles_and_bombs_end():
    assert spans("%2525252525" * 50) == []
    bomb = b64(gzip.compress(b"a" * 5_000_000 + b" token=abcdefgh"))
    found, oversize = S.find_secrets(bomb, max_layer_chars=100_000)
    assert oversize == 1
    assert S.find_secrets(bomb)[1] == 0 and any(x[0] == "assign" for x in S.find_secrets(bomb)[0])


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_all_of_an_oversize_layer_is_read(pack):
    filler = b"plain words, " * 30_000  # several windows
    for body in (filler + SECRET.encode(), filler + SECRET.encode() + b" " + filler, filler + b64(b"more text " * 3_000 + SECRET.encode()).encode() + b" " + filler,
                 filler + pack(b"inner " * 2_000 + SECRET.encode()) + b" " + filler, "é".encode() * 150_001 + b" " + SECRET.encode()):
        text = f"a {b64(pack(body)).rstrip(chr(61))} b"
        found, oversize = S.find_secrets(text, max_layer_chars=100_000)
        assert oversize == 1 and {x[0] for x in found} == {"assign"} and S.redact_text(text, max_layer_chars=100_000) == "a [secret] b"
    for at in range(99_900, 100_020, 7):  # across the cut
        body = (b"word " * 40_000)[:at] + b" " + SECRET.encode() + b" word" * 40_000
        assert {x[0] for x in S.find_secrets(b64(pack(body)), max_layer_chars=100_000)[0]} == {"assign"}
    assert S.find_secrets(b64(pack(filler)), max_layer_chars=100_000) == ([], 1)


def test_members_and_refused_layers():
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        assert spans(b64(pack(b"some words in front ") + pack(SECRET.encode())))
        assert spans(b64(pack(b"first member, password=Zx9") + pack(b"Kq81mPw and on")))
    wide = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=28)).compressobj()
    for code in (b64(lzma.compress(b"x", filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 29}])), b64(wide.compress(SECRET.encode()) + wide.flush())):
        code = code.rstrip("=")
        assert S.find_secrets(f"a {code} b")[1] == 1 and S.redact_text(f"a {code} b") == "a [secret] b"


def test_redaction():
    assert S.redact_text(f"a {SECRET} b") == "a [secret] b"
    assert S.redact_text("a b") == "a b"
    coded = b64(SECRET.encode())
    assert SECRET not in S.redact_text(coded) and coded not in S.redact_text(f"x {coded} y")
    assert spans(S.redact_text(f"{SECRET} AKIA{'Q' * 16} {'0f' * 20}")) == []


def test_query_on_hard_rows_and_table(spark, sf, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (None, SECRET), (4, "word " * 30000 + SECRET), (5, f"{SECRET} {b64(SECRET.encode())}")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("start", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    for d in (path, sf):
        docs = {(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        want = {}
        for i, t in docs:
            b = base(t)
            want[i] = (*[sum(x[0] == k for x in b) for k in S.KINDS], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest())
        out = Q.QUERIES["op5_secret_scan"](spark, d).collect()
        assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
        for r in out:
            assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id]
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = S.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in out if r.text and SECRET in r.text] == [] and sum(r.text is None for r in out) == 1
