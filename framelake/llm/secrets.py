"""Secret scan: patterns propose, structure confirms.

Patterns give the base kinds. Beyond them, base64 or hex is decoded wherever a key may begin, also inside a longer run and
over line ends, and reported only if the bytes parse: DER private keys whose nested lengths fill each other exactly,
OpenSSH key files with length-prefixed fields, PEM files around or below either, and signed tokens whose header and
payload are JSON objects and whose header names an algorithm. A key's own lengths say where it ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import pieces, returning

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{64,}")
#: Line ends, also as they are written inside strings.
BREAK = r"(?:\r?\n|\\r\\n|\\n)[ \t]*"
#: Base64 runs, over line ends, in both alphabets.
RUNS = tuple(re.compile(rf"[{c}]{{40,}}(?:{BREAK}[{c}]+)*={{0,2}}") for c in ("A-Za-z0-9+/", r"A-Za-z0-9_\-"))
#: Where a DER sequence of the first few items of a key, the OpenSSH magic or a PEM file may begin, as base64 and as hex.
BASE64_START = re.compile(r"(?=(M[A-I])|(b3BlbnNzaC1rZXktdjEA)|(LS0tLS1CRUdJTi))")
HEX_START = re.compile(r"(?=(30(?:82|81|[2-7]))|(6f70656e7373682d6b65792d763100))", re.IGNORECASE)
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}")
TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.DOTALL)
#: Header of an encrypted PEM body: the cipher and its start value.
DEK_INFO = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,32}\b")
#: Object identifiers that begin the algorithms of encrypted keys (PKCS#5 and PKCS#12).
ENCRYPTING = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
MAGIC = b"openssh-key-v1\0"

INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
ITEMS = 16
#: Parts of a run are views, never copies: a long run may have a start at every few characters.
Bytes = bytes | memoryview


def der_items(data: Bytes) -> list[tuple[int, Bytes]] | None:
    """(tag, content) of consecutive DER items that fill `data` exactly; else None. No key has more than `ITEMS` at one level."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or len(out) == ITEMS:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + wide]), at + wide
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: Bytes) -> bool:
    """A private key: PKCS#1 (nine integers), DSA (six), PKCS#8 (version, algorithm, nested key; or encrypted) or SEC 1 (version 1, key octets)."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE or not (items := der_items(top[0][1])):
        return False
    tags = [tag for tag, _ in items]
    if tags == [SEQUENCE, OCTETS]:
        algorithm = der_items(items[0][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT and bytes(algorithm[0][1]).startswith(ENCRYPTING) and len(items[1][1]) >= 16
    if tags[0] != INTEGER:
        return False
    if len(items) >= 9 and tags[:9] == [INTEGER] * 9:
        return all(content for _, content in items[:9])
    if tags == [INTEGER] * 6:
        return items[0][1] == b"\0" and len(items[1][1]) >= 60 and 18 <= len(items[2][1]) <= 33 and all(content for _, content in items)
    if tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_items(items[1][1])
        return bool(algorithm and algorithm[0][0] == OBJECT and der_items(items[2][1]))
    return items[0][1] == b"\1" and tags[1:2] == [OCTETS] and len(items[1][1]) in (24, 28, 32, 48, 66)


def der_size(data: Bytes) -> int:
    """The bytes of the DER sequence that `data` begins with, by its header; 0 if no key begins like that."""
    if len(data) < 8 or data[0] != SEQUENCE:
        return 0
    wide = data[1] & 0x7F if data[1] >= 0x80 else 0
    if wide > 4 or data[1] == 0x80:
        return 0
    after = data[2 + wide]
    if after not in (INTEGER, SEQUENCE) or after == INTEGER and data[3 + wide] != 1:
        return 0
    return 2 + wide + (int.from_bytes(data[2 : 2 + wide]) if wide else data[1])


def ssh_size(data: Bytes) -> int:
    """The bytes of the OpenSSH private key file that `data` begins with: magic, cipher, kdf, kdf options, number of keys,
    the public keys and, unless the data end there, the private part, each with its length; 0 if they don't fit."""
    if bytes(data[: len(MAGIC)]) != MAGIC:
        return 0
    at = len(MAGIC)

    def skip(fields: int) -> None:
        nonlocal at
        for _ in range(fields):
            at += 4 + (int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else len(data))

    skip(3)
    keys = int.from_bytes(data[at : at + 4])
    if at + 4 > len(data) or not 1 <= keys <= 64:
        return 0
    at += 4
    skip(keys)
    if at != len(data):
        skip(1)
    return at if at <= len(data) else 0


def from_base64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def key_size(data: Bytes | None, exact: bool = False) -> tuple[int, str] | None:
    """(bytes, kind) of the key that `data` begins with, or with `exact` is; None without one."""
    if not data:
        return None
    if (size := der_size(data)) and size <= len(data) and is_der_key(data[:size]):
        found = size, "der"
    elif size := ssh_size(data):
        found = size, "ssh"
    else:
        return None
    return None if exact and found[0] != len(data) else found


def is_pem_body(body: str) -> bool:
    """The base64 between the marks is a key, or, under headers that say so, an encrypted one."""
    body = body.replace("\\r\\n", "\n").replace("\\n", "\n")
    lines = [line.strip() for line in body.splitlines()]
    encrypted = "Proc-Type: 4,ENCRYPTED" in body and DEK_INFO.search(body)
    data = from_base64("".join(line for line in lines if ":" not in line).replace(" ", ""))
    return bool(data) and (bool(encrypted) and len(data) % 8 == 0 or key_size(data, exact=True) is not None)


class Folded:
    """A run of characters over line ends, as one string; places in it lead back to the text."""

    def __init__(self, text: str, start: int, stop: int):
        self.parts, self.starts = [], []
        at = start
        for m in re.finditer(BREAK, text[start:stop]):
            self._add(text, at, start + m.start())
            at = start + m.end()
        self._add(text, at, stop)
        self.chars = "".join(self.parts)

    def _add(self, text: str, start: int, stop: int) -> None:
        self.starts.append((sum(map(len, self.parts[-1:])) + (self.starts[-1][0] if self.starts else 0), start))
        self.parts.append(text[start:stop])

    def place(self, k: int) -> int:
        """The text's place of character `k`."""
        joined, start = self.starts[bisect_right(self.starts, (k, 1 << 62)) - 1]
        return start + k - joined


class Decoded:
    """A run of base64 or hex decoded once for each place in a group of characters that its bytes may begin at."""

    def __init__(self, chars: str, width: int):
        self.chars, self.width, self.made = chars, width, {}

    def at(self, place: int) -> tuple[bytes, int]:
        """The bytes of the run from some place on, and where in them those of `place` begin."""
        first = place % self.width
        if first not in self.made:
            own = self.chars[first:]
            if self.width == 2:
                self.made[first] = bytes.fromhex(own[: len(own) // 2 * 2])
            else:
                own = own.rstrip("=")
                self.made[first] = from_base64(own if len(own) % 4 != 1 else own[:-1]) or b""
        return self.made[first], (place - first) // self.width * (3 if self.width == 4 else 1)


def keys_in_base64(chars: str) -> Iterator[tuple[int, int, str]]:
    """(first character, end, kind) of the keys in a string of base64, wherever they begin."""
    done, decoded, texts = 0, Decoded(chars, 4), {}
    for m in BASE64_START.finditer(chars):
        at = m.start()
        if at < done:
            continue
        raw, begin = decoded.at(at)
        data = memoryview(raw)
        if m[1]:
            size = der_size(data[begin : begin + 12])
            if not size or at + -(-size * 4 // 3) > len(chars):  # characters that hold the bytes
                continue
            found = key_size(data[begin : begin + size])
        elif m[2]:
            found = key_size(data[begin:])
        else:
            if at % 4 not in texts:
                texts[at % 4] = raw.decode("latin-1")
            inner = PEM.match(texts[at % 4], begin)
            found = (inner.end() - begin, "pem") if inner and is_pem_body(inner[2]) else None
        if found:
            done = at + -(-found[0] * 4 // 3)
            while done < len(chars) and chars[done] == "=" and (done - at) % 4:
                done += 1
            yield at, done, found[1]


def keys_in_hex(digits: str) -> Iterator[tuple[int, int, str]]:
    """The same for a string of hex digits."""
    done, decoded = 0, Decoded(digits, 2)
    for m in HEX_START.finditer(digits):
        at = m.start()
        if at < done:
            continue
        raw, begin = decoded.at(at)
        data = memoryview(raw)[begin:]
        size = der_size(data[:8]) if m[1] else len(data)
        if size and size <= len(data) and (found := key_size(data[:size])):
            done = at + 2 * found[0]
            yield at, done, found[1]


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        header, payload = (json.loads(from_base64(x, url=True) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(payload, dict) and isinstance(header.get("alg"), str)


def tokens(text: str) -> Iterator[re.Match]:
    """Matches of TOKEN from left to right. A run of its characters is tried once: where its first start fails, all do."""
    at = text.find("eyJ")
    while at >= 0:
        m = TOKEN.match(text, at)
        if m:
            yield m
        at = text.find("eyJ", m.end() if m else TOKEN_RUN.match(text, at).end())


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as in KINDS."""
    found: list[tuple[int, int, str]] = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    pems = [m.span() for m in PEM.finditer(text) if is_pem_body(m[2])] if "-----BEGIN " in text else []
    found += [(*span, "pem") for span in pems]
    keys = {(m.start() + a, m.start() + b, kind) for m in HEX_ANY.finditer(text) for a, b, kind in keys_in_hex(m[0])}
    for pattern, url in zip(RUNS, (False, True), strict=True):
        for m in pattern.finditer(text):
            if url and "-" not in m[0] and "_" not in m[0]:
                continue  # part of a run in the first alphabet
            mark = m[0].find("----")  # of a PEM file, whose dashes the second alphabet has
            run = Folded(text, m.start(), m.end() if mark < 0 else m.start() + mark)
            chars = run.chars.replace("-", "+").replace("_", "/") if url else run.chars
            keys |= {(run.place(a), run.place(b - 1) + 1, kind) for a, b, kind in keys_in_base64(chars)}
    found += [x for x in keys if not any(a <= x[0] and x[1] <= b for a, b in pems)]  # a PEM file's key is that file
    if "eyJ" in text:
        found += [(*m.span(), "jwt") for m in tokens(text) if is_signed_token(m[0])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<kind:string,start:long,stop:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its secret spans.

    Null texts are empty and have none; rows stand for themselves, so null or repeated doc_ids change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for whole in batches:
            for batch in pieces(whole):
                spans = [[{"kind": k, "start": a, "stop": b} for a, b, k in find_secrets(t or "")] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(returning(run), f"doc_id long, spans {SPANS}")


def mask(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each stretch of secret characters replaced by `mark`, n_chars following; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts, changed = batch.column("text").to_pylist(), False
                for k, text in enumerate(texts):
                    if text and (spans := find_secrets(text)):
                        out, at, changed = [], 0, True
                        for start, stop, _ in spans:
                            if stop > at:
                                out += [text[at:start], mark] if start >= at else []
                                at = stop
                        texts[k] = "".join([*out, text[at:]])
                yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type)) if changed else batch

    masked = docs.mapInArrow(returning(run), docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked
