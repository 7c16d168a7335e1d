"""Keys and tokens in places where a plain run does not start with them."""

import base64
import json
import random
import textwrap

import pytest

from canopy.llm import secret_scan

RNG = random.Random(12)


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def key(n=40):
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) + RNG.randbytes(n)) for _ in range(8)))


def token():
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    return ".".join([part({"alg": "HS256", "typ": "JWT"}), part({"sub": "12345"}), base64.urlsafe_b64encode(RNG.randbytes(32)).decode().rstrip("=")])


def kinds(text):
    return [(text[a:b], k) for a, b, k in secret_scan.scan(text) if k in ("jwt", "key")]


@pytest.mark.parametrize("before", ["session12.", "a.b.c.", "longer-name.", "x.session99.", "see "])
def test_token_after_dotted_segments(before):
    t = token()
    assert kinds(before + t + " end") == [(t, "jwt")]


def test_two_tokens_in_one_run():
    a, b = token(), token()
    assert kinds(f"{a}.{b}") == [(a, "jwt"), (b, "jwt")]


@pytest.mark.parametrize("before", ["keys/", "KEY_", "a/b_c/", "name+", "id="])
def test_key_glued_to_a_name(before):
    for n in (3, 20, 40, 41, 42):
        k = base64.b64encode(key(n)).decode()
        assert kinds(f"see {before}{k} end") == [(k, "key")]


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_key_without_armour(newline, width):
    for n in (20, 40, 41):
        lines = textwrap.wrap(base64.b64encode(key(n)).decode(), width)
        whole = newline.join(lines)
        assert kinds(f"the key is\n{whole}\nand more text here") == [(whole, "key")]
        assert kinds(f"{'A' * 40}\n{whole}\n\nend") == [(whole, "key")]


def test_encrypted_key_with_headers():
    body = base64.b64encode(RNG.randbytes(160)).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00AA\n\n" + "\n".join(textwrap.wrap(body, 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert kinds(f"x {pem} y") == [(pem, "key")]
    odd = pem.replace(body[:64], body[:60])
    assert kinds(odd) == []


def test_random_text_is_left_alone():
    for _ in range(200):
        text = base64.b64encode(RNG.randbytes(RNG.randint(30, 400))).decode()
        assert kinds(text) == [] and kinds("\n".join(textwrap.wrap(text, 64))) == [] and kinds("M" * RNG.randint(30, 200)) == []
