"""Long and hostile texts: secrets and token ids in linear time, and as before."""

from __future__ import annotations

import base64
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelake.llm import bpe, secrets

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("start", ["b3BlbnNzaC1rZXktdjEA", "LS0tLS1CRUdJTi", "eyJ", "30820", "6f70656e7373682d6b65792d763100", "MIICXAIBAAKB", "-----BEGIN ", "password="])
def test_repeated_starts_take_linear_time(start):
    text = (start * (5_000_000 // len(start) + 1))[:5_000_000]
    began = time.process_time()
    secrets.find_secrets(text)
    assert time.process_time() - began < 15  # some 5 s on a free machine; hours if it grew with the square


def test_long_claims_take_linear_time():
    """Sequences that claim a megabyte each, at every tenth byte, and sequences of a million small items."""
    for raw in (bytes([0x30, 0x83, 0x0F, 0xFF, 0xFF, 2, 1, 0, 2, 1]) * 300_000, bytes([0x30, 0x83, 0x0F, 0xFF, 0xFE]) + bytes([2, 1, 1]) * 900_000):
        for text in (base64.b64encode(raw).decode(), raw.hex()):
            began = time.process_time()
            secrets.find_secrets(text)
            assert time.process_time() - began < 15


def plain_base64(chars):
    """Keys in base64 with a decoding of its own for every start."""
    done = 0
    for at in range(len(chars)):
        if at < done or not secrets.BASE64_START.match(chars, at):
            continue
        tail = chars[at:].rstrip("=")
        data = secrets.from_base64(tail if len(tail) % 4 != 1 else tail[:-1]) or b""
        size = secrets.der_size(data[:12])
        if chars[at] == "M":
            found = secrets.key_size(data[:size]) if size and at + -(-size * 4 // 3) <= len(chars) else None
        elif chars[at] == "b":
            found = secrets.key_size(data)
        else:
            inner = secrets.PEM.match(data.decode("latin-1"))
            found = (inner.end(), "pem") if inner and secrets.is_pem_body(inner[2]) else None
        if found:
            done = at + -(-found[0] * 4 // 3)
            while done < len(chars) and chars[done] == "=" and (done - at) % 4:
                done += 1
            yield at, done, found[1]


def der(tag, content):
    size = len(content)
    head = bytes([size]) if size < 128 else bytes([0x81, size]) if size < 256 else bytes([0x82, size >> 8, size & 255])
    return bytes([tag]) + head + content


def keys(r):
    """A PKCS#1 key, an elliptic one, an OpenSSH file and a PEM file around one."""
    integers = b"".join(der(2, b"\0" if k == 0 else b"\1" + r.randbytes(r.randrange(1, 20))) for k in range(9))
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = secrets.MAGIC + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(r.randbytes(30)) + field(r.randbytes(50))
    elliptic = der(0x30, der(2, b"\1") + der(4, r.randbytes(32)))
    pem = f"-----BEGIN EC PRIVATE KEY-----\n{base64.b64encode(elliptic).decode()}\n-----END EC PRIVATE KEY-----"
    return [der(0x30, integers), elliptic, ssh, pem.encode()]


def test_base64_against_plain_decoding():
    r = random.Random(31)
    hits = 0
    for _ in range(400):
        parts = []
        for _ in range(r.randrange(1, 5)):
            raw = r.choice(keys(r)) if r.random() < 0.7 else r.randbytes(r.randrange(40))
            text = base64.b64encode(raw).decode()
            parts.append(text.rstrip("=") if r.random() < 0.7 else text)
            parts.append("".join(r.choice("ABMIb3LS0xyz") for _ in range(r.randrange(5))))
        chars = "".join(parts).rstrip("=").replace("=", "A") + "=" * r.randrange(3)
        got = list(secrets.keys_in_base64(chars))
        assert got == list(plain_base64(chars))
        hits += len(got)
    assert hits > 300


def test_hex_keys_at_odd_places():
    r = random.Random(32)
    for key in keys(r)[:3]:
        for before in ("", "a", "ab", "abc"):
            assert [(a, b) for a, b, _ in secrets.keys_in_hex(before + key.hex() + "00")][:1] == [(len(before), len(before) + 2 * len(key))] or key.startswith(secrets.MAGIC)


def test_tokens_from_left_to_right():
    """Runs are tried once; the matches are those of a search from every place."""
    r = random.Random(33)
    for _ in range(2000):
        text = "".join(r.choice(["eyJ", "abcdefgh", ".", ".", "x" * 16, " ", "eyJhbGciOiJI"]) for _ in range(r.randrange(14)))
        assert [m.span() for m in secrets.tokens(text)] == [m.span() for m in secrets.TOKEN.finditer(text)]


def test_long_words():
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    trie = bpe.PrefixTrie(VOCABULARY)
    r = random.Random(34)
    word = "".join(r.choice("etaoin shrdlu".replace(" ", "")) for _ in range(1_000_000))
    began = time.process_time()
    ids = trie.encode([word])[word]
    assert time.process_time() - began < 25 and sum(trie.size[x] for x in ids) == len(word)
    short = [word[k * 997 :][:n] for k, n in enumerate([1, 2, 5, 40, 1000, 20_000])]
    found = trie.encode(short)
    assert [found[w] for w in short] == [library.encode(w, add_special_tokens=False).ids for w in short]
