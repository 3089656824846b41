import base64
import bz2
import gzip
import lzma
import re
import urllib.parse
import zlib

import pytest
import zstandard

from plumbline.llm import secrets as S

SECRET = 'token = "586908a73d53ffc7776756ed304e7317d12d4663"'


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def found(text):
    return S.all_spans(text, S.scan(text))


def test_base_spans_equal_brute_force():
    text = "PassWord: 'abcdef' token=abc api-key=1 apikey:=x secret=a/b+c.d_e AKIA" + "B" * 16 + " AKIAXX " + "0f" * 12 + " " + "a" * 23
    assign = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    expected = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    expected += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    expected += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert S.scan(text) == expected and len(expected) == 4
    assert S.scan("toKen=abcdefgh pasſword=abcdefgh") == []


@pytest.mark.parametrize(
    "wrap",
    [
        urllib.parse.quote,
        lambda s: urllib.parse.quote(urllib.parse.quote(s)),
        lambda s: "".join(f"%{b:02x}" for b in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s),
        b64,
        lambda s: b64(b64(s)),
        lambda s: b64(gzip.compress(s.encode())),
        lambda s: b64(zlib.compress(s.encode())),
        lambda s: b64(bz2.compress(s.encode())),
        lambda s: b64(lzma.compress(s.encode())),
        lambda s: b64(zstandard.compress(s.encode())),
        lambda s: "".join(f"%{b:02x}" for b in b64(zlib.compress(b64(s).encode())).encode()),
        lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    ],
)
def test_wrapped_secrets_map_to_their_place(wrap):
    wrapped = wrap(SECRET)
    spans = [s for s in found(f"é {wrapped} end") if s[0] == "assign"]
    assert spans
    for _, start, end in spans:
        assert 2 <= start < end <= 2 + len(wrapped)
    assert max(end - start for _, start, end in spans) > len(wrapped) / 2


def test_plain_words_add_nothing():
    text = "thanonontioniner hainghethesthing nichtchzulichein 100% sure %zz \\u12 &amp; " * 50
    assert found(text) == set()


def test_spans_are_ordered_and_rows_defined(odd_documents, no_documents, clashing):
    assert S.written_out([("hex", 5, 30), ("assign", 5, 40), ("access", 1, 22)]) == "access:1:22,assign:5:40,hex:5:30"
    rows = S.secret_spans(clashing(odd_documents)).collect()
    assert len(rows) == 12 and all(r.spans == "" and r.n_hex == 0 for r in rows)
    assert S.secret_spans(no_documents).count() == 0


def test_redaction_hides_all_layers():
    text = f"a {SECRET} b {b64(SECRET)} c"
    assert S.redact(text).startswith("a [SECRET]") and "5869" not in S.redact(text) and b64(SECRET)[:30] not in S.redact(text)
    assert S.redact("clean text") == "clean text"
