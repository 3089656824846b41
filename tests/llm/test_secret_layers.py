"""Layers that a document holds twice, and base64 joined to other text or wrapped."""

import base64
import bz2
import gzip
import lzma
import random
import textwrap
import time
import tracemalloc
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


def test_equal_payloads_that_inflate_beyond_the_document():
    payload = b64(zlib.compress((SECRET + " padding" * 2000).encode()))
    text = f"one {payload} two {payload} three"
    assert len(zlib.decompress(base64.b64decode(payload))) > len(text)
    first, second = text.index(payload), text.rindex(payload)
    starts = {start for kind, start, _ in found(text) if kind == "assign"}
    assert starts == {first, second}
    assert payload not in S.redact(text) and S.redact(text).count("[SECRET]") == 2


def noise(n):
    return "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))


LONG = SECRET + " " + " ".join(noise(40 + i) for i in range(8))


@pytest.mark.parametrize(
    "payload",
    [
        f"host/path/{b64(SECRET)}",
        f"id-{b64(SECRET)}",
        f"some_id_{b64(SECRET).rstrip('=')}_more",
        f"a/b-c_{b64(zlib.compress(SECRET.encode()))}",
        f"host/{b64(gzip.compress(SECRET.encode())).rstrip('=')}/tail-of-path",
        base64.encodebytes(gzip.compress(LONG.encode())).decode(),
        base64.encodebytes(zlib.compress(LONG.encode())).decode().replace("\n", "\r\n"),
        base64.encodebytes(bz2.compress(LONG.encode())).decode().replace("\n", "\\n"),
        textwrap.indent(base64.encodebytes(lzma.compress(LONG.encode())).decode(), "    "),
        "\n".join(textwrap.wrap(b64(zstandard.compress(LONG.encode())), 64)),
        "\n".join(textwrap.wrap(b64(SECRET), 12)),
        base64.encodebytes(("x" * 40 + " " + SECRET).encode()).decode(),
        b64(gzip.compress(b"first") + gzip.compress(SECRET.encode())),
        b64(bz2.compress(b"first") + bz2.compress(SECRET.encode())),
        b64(lzma.compress(b"first") + bytes(4) + lzma.compress(SECRET.encode())),
        b64(zstandard.compress(b"first") + zstandard.compress(SECRET.encode())),
        b64(b"\xff\x00\xfe" + SECRET.encode() + b"\x00\xff"),
        b64(gzip.compress(b"\xff\x00" + SECRET.encode())),
    ],
)
def test_joined_and_wrapped_base64(payload):
    text = f"é {payload} end"
    spans = [(start, end) for kind, start, end in found(text) if kind == "assign"]
    assert spans and all(2 <= start < end <= 2 + len(payload) for start, end in spans)
    low, high = min(s for s, _ in spans), max(e for _, e in spans)
    assert high - low >= 50


def test_a_secret_across_a_line_end_maps_to_its_place():
    plain = "x" * 40 + " " + SECRET
    text = base64.encodebytes(plain.encode()).decode()
    joined = text.replace("\n", "")
    first = plain.index("token") * 4 // 3
    last = -(-plain.rindex('"') * 4 // 3)
    spans = {(start, end) for kind, start, end in found(text) if kind == "assign"}
    assert (first, last + 1) in spans and joined[first:last] == text[first : last + 1].replace("\n", "")


def test_runs_without_secrets_add_nothing():
    data = random.Random(5).randbytes(30_000)
    assert not [s for s in found(f"{b64(data)} {base64.encodebytes(data).decode()}") if s[0] == "assign"]
    assert found("one-long/path_of/words-and/parts " * 50 + "word\nnext\nlines\n" * 200) == set()


HIDDEN = "password = hunter2hunter2"


def raw_deflate(data):
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def one_span(written, before="see ", after=" end"):
    """The only span found in a text around ``written`` covers it or lies in it."""
    found = S.all_spans(before + written + after, S.scan(before + written + after))
    inside = [s for s in found if len(before) <= s[1] and s[2] <= len(before) + len(written)]
    return bool(inside) and inside == list(found)


@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress, lzma.compress, lambda d: zstandard.ZstdCompressor().compress(d)])
@pytest.mark.parametrize("write", ["url", "url-all", "x", "repr", "base64", "base64-url"])
def test_payloads_in_every_writing(pack, write):
    data = pack(HIDDEN.encode())
    if write == "url":
        text = urllib.parse.quote_from_bytes(data, safe="")
    elif write == "url-all":
        text = "".join(f"%{b:02X}" for b in data)
    elif write == "x":
        text = "".join(f"\\x{b:02x}" for b in data)
    elif write == "repr":
        text = repr(data)[2:-1]
    else:
        text = base64.b64encode(data).decode()
        text = urllib.parse.quote(text, safe="") if write == "base64-url" else text
    assert one_span(text)


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "utf-16"])
def test_wide_text_and_raw_deflate_in_base64(encoding):
    assert one_span(base64.b64encode(HIDDEN.encode(encoding)).decode())
    assert one_span(base64.b64encode(raw_deflate(HIDDEN.encode() * 3)).decode())
    assert one_span(base64.b64encode(gzip.compress(base64.b64encode(HIDDEN.encode(encoding)))).decode())


@pytest.mark.parametrize("pack", [bz2.compress, lzma.compress, lambda d: zlib.compress(d, 9), lambda d: zstandard.ZstdCompressor().compress(d)])
def test_small_payloads_of_large_content_stay_small_in_memory(pack):
    content = b"x" * 30_000_000 + HIDDEN.encode() + b"y" * 10_000_000
    text = base64.b64encode(pack(content)).decode()
    tracemalloc.start()
    found = S.all_spans(text, S.scan(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ("assign", 0, len(text)) in found and peak < 60_000_000


def test_secrets_across_windows_are_found(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 1000)
    monkeypatch.setattr(S, "OVERLAP", 200)
    monkeypatch.setattr(S, "PIECE", 64)
    for at in range(900, 1100, 7):
        inner = base64.b64encode(HIDDEN.encode()).decode()
        for hidden in (HIDDEN, inner):
            content = " ".join("ab" for _ in range(at // 3)) + " " * (at % 3) + " " + hidden + " and" * 400
            text = base64.b64encode(zlib.compress(content.encode())).decode()
            assert S.all_spans(text, S.scan(text)) == {("assign", 0, len(text))}, at


@pytest.mark.parametrize("nested", ["%" + "25" * 20_000 + "41", "\\" + "u005c" * 8_000 + "u0041", "&" + "amp;" * 10_000 + "lt;", "\\" + "x5c" * 9_000 + "x41"])
def test_deep_nesting_is_one_step(nested):
    started = time.perf_counter()
    text = f"password=abc{nested}def"
    spans = S.all_spans(text, S.scan(text))
    assert time.perf_counter() - started < 5
    if "lt;" not in nested:
        assert ("assign", 0, len(text)) in spans
