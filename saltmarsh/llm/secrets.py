"""Secret scans: patterns propose, structure confirms.

Three base patterns are reported as they match:

* ``assign``: a secret-like name, ``:`` or ``=``, and a value of six characters or more;
* ``access``: an access key id of twenty characters or more;
* ``hex``: a run of 24 or more lower-case hex digits.

The method adds spans whose contents hold up when decoded:

* ``jwt``: three base64url parts of which the first is a JSON object with an ``alg`` and the second a JSON object;
* ``der``: base64 (with or without PEM lines) or hex that decodes to a private key: a DER sequence whose nested
  lengths fill it exactly and which has the fields of an RSA, DSA or EC key, of a PKCS#8 key or of an encrypted
  one; or the whole cipher blocks between PEM lines whose headers say that they are encrypted;
* ``ssh``: base64 of an OpenSSH private key: cipher, derivation, public keys and private part, by their lengths;
* ``public``: a public key, as DER or as length-prefixed strings of SSH. No secret, but what a pattern alone
  would take for one; callers that want secrets only leave this kind out.

Signatures, certificates' digests and other sequences of numbers are nothing.

Base64 is of either alphabet, and may be wrapped by white space or by ``\\n`` as JSON escapes it. It starts where no
letter or digit stands before it and goes as far as the lengths inside it say.

Spans are (kind, start, end) in code points, end exclusive; base spans do not overlap within a kind.

Defined cases: null and empty texts have no span; texts of any length are scanned whole; repeated rows
have the same spans; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._text import runs, slices

#: The kinds, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "public")
DER, SSH, PUBLIC = 4, 5, 6
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Names that must stand, in either case, somewhere in a text with an ``assign`` span.
NAMES = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
#: How base64 of a key starts: a DER sequence whose first item is an integer or a sequence, or an SSH key.
KEY_START = re.compile(r"M(?:[A-H][AEIMQUYcgkosw048][Cw]|I[E-T])|AAA[A-P]|b3BlbnNzaC1rZXktdjE")
RUNS = (re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"))
#: What may stand between two lines of base64: white space, also as escaped in JSON.
BREAK = re.compile(r"(?:\s|\\+[nrt])+")
ESCAPED = re.compile(r"\\+(?:u00([0-9A-Fa-f]{2})|/)")
PADDING = re.compile(r"(?:=|\\+u003[dD]){0,2}")
#: Quotes, and string literals that a program joins, around the lines of a PEM body.
QUOTED = re.compile(r"""["'](?:\s*\+)?|,$""", re.MULTILINE)
HEADER = re.compile(r"^[ \t]*([A-Za-z][A-Za-z0-9-]*):(.*)$", re.MULTILINE)
KEY_TYPE = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-|sk-(ssh|ecdsa)-)")
MAGIC = b"openssh-key-v1\0"
HEX_BODY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
#: A run of this many base64 characters may hold a candidate.
CANDIDATE = 24
_B64 = np.zeros(256, bool)
_B64[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 45, 46, 47, 95]] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True


def der_items(body: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill ``body`` exactly, or None where lengths do not nest."""
    out, at = [], 0
    while at < len(body):
        if at + 2 > len(body):
            return None
        tag, size = body[at], body[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(body):
                return None
            size = int.from_bytes(body[at : at + n], "big")
            at += n
        if at + size > len(body):
            return None
        content = body[at : at + size]
        if tag == 0x30 and depth < 8 and der_items(content, depth + 1) is None:
            return None
        out.append((tag, content))
        at += size
    return out


def der_kind(body: bytes) -> int | None:
    """The kind of the key that bytes are as one DER sequence, by the fields that it has."""
    if len(body) < 24 or body[0] != 0x30:
        return None
    items = der_items(body)
    inner = der_items(items[0][1]) if items and len(items) == 1 else None
    if not inner:
        return None
    tags = [t for t, _ in inner]
    if max((len(c) for t, c in inner if t in (0x02, 0x03, 0x04)), default=0) < 16:
        return None
    rest = set(tags[2:])
    if tags[0] == 0x02 and inner[0][1] in (b"\0", b"\1"):  # a version
        numbers = set(tags) == {0x02} and len(tags) >= 6  # DSA has six numbers, RSA nine
        several = tags[:9] == [0x02] * 9 and tags[9:] == [0x30]  # RSA of more than two primes
        curve = tags[1:2] == [0x04] and rest <= {0xA0, 0xA1}
        wrapped = tags[1:3] == [0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81} and _fields(inner[1][1])[:1] == [0x06]
        return DER if numbers or several or curve or wrapped else None
    # An algorithm with a sequence of parameters, as encryption by password has it; a digest has none.
    if tags == [0x30, 0x04] and _fields(inner[0][1]) == [0x06, 0x30]:
        return DER
    if tags == [0x30, 0x03] and _fields(inner[0][1])[:1] == [0x06]:
        return PUBLIC
    return None


def _fields(body: bytes) -> list[int]:
    return [t for t, _ in der_items(body) or []]


def ssh_strings(body: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int]:
    """Up to ``most`` length-prefixed strings from ``at`` on, and where they end."""
    parts: list[bytes] = []
    while (most is None or len(parts) < most) and at + 4 <= len(body):
        size = int.from_bytes(body[at : at + 4], "big")
        if at + 4 + size > len(body):
            break
        parts.append(body[at + 4 : at + 4 + size])
        at += 4 + size
    return parts, at


def is_wire_key(body: bytes) -> bool:
    """Whether strings with lengths fill ``body``, the first a key type."""
    parts, end = ssh_strings(body)
    return end == len(body) and len(parts) >= 2 and KEY_TYPE.match(parts[0]) is not None


def openssh_size(body: bytes) -> int | None:
    """How many of the bytes are an OpenSSH private key, by all its nested lengths; None if it is none or is cut."""
    if not body.startswith(MAGIC):
        return None
    head, at = ssh_strings(body, len(MAGIC), 3)
    if len(head) < 3 or not head[0] or at + 4 > len(body):
        return None
    count = int.from_bytes(body[at : at + 4], "big")
    if not 1 <= count <= 16:
        return None
    keys, at = ssh_strings(body, at + 4, count + 1)
    if len(keys) < count + 1 or not all(map(is_wire_key, keys[:-1])):
        return None
    private = keys[-1]
    if len(private) < 16 or len(private) % 8 or (head[0] == b"none" and private[:4] != private[4:8]):
        return None
    return at


def ssh_kind(body: bytes) -> int | None:
    """The kind of the key that bytes are in one of the encodings of SSH."""
    if openssh_size(body) == len(body):
        return SSH
    return PUBLIC if is_wire_key(body) else None


def decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, padding optional."""
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def is_token(text: str) -> bool:
    """Whether a dotted text is a signed token: JSON header with ``alg``, JSON claims."""
    try:
        header, claims = (json.loads(decoded(x) or b"") for x in text.split(".")[:2])
    except (ValueError, RecursionError):  # deeply nested JSON is no header
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


class Body:
    """Base64 from a place of a text on, over breaks and escapes, decoded as far as it is asked for."""

    def __init__(self, text: str, at: int, run: re.Pattern):
        self.text, self.run, self.at = text, run, at
        self.data, self.n = b"", 0
        self.pieces: list[str] = []
        self.places: list[tuple[int, int, int]] = []  # characters up to the piece's end, its start and end in the text

    def has(self, n: int) -> bool:
        """Whether ``n`` bytes can be decoded; then ``data`` holds them."""
        if n > len(self.data) and n <= len(self.text):
            want = (2 * n * 4 + 2) // 3
            while self.n < want:
                if m := self.run.match(self.text, self.at, self.at + want - self.n):
                    piece = m[0]
                elif m := ESCAPED.match(self.text, self.at):
                    piece = chr(int(m[1], 16)) if m[1] else "/"
                    if not self.run.match(piece):
                        break
                elif self.pieces and (m := BREAK.match(self.text, self.at)):
                    self.at = m.end()
                    continue
                else:
                    break
                self.n += len(piece)
                self.pieces.append(piece)
                self.places.append((self.n, m.start(), m.end()))
                self.at = m.end()
            coded = "".join(self.pieces)
            self.data = decoded(coded[: len(coded) - (len(coded) % 4 == 1)]) or b""
        return n <= len(self.data)

    def end(self, n: int) -> int | None:
        """Where the first ``n`` bytes and their padding end in the text, if base64 ends there or a line does."""
        count = (n * 4 + 2) // 3
        upto, _, end = self.places[bisect.bisect_left(self.places, (count,))]
        end -= upto - count
        padded = PADDING.match(self.text, end).end()
        return None if padded == end and self.run.match(self.text, end) else padded

    def number(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + 4], "big")


def der_end(body: Body) -> tuple[int, int] | None:
    """The kind of the DER key at the start of ``body`` and where it ends in the text."""
    if not body.has(24) or body.data[0] != 0x30:
        return None
    n = body.data[1] & 0x7F if body.data[1] & 0x80 else 0
    if n > 4:
        return None
    size = int.from_bytes(body.data[2 : 2 + n], "big") if n else body.data[1]
    size += 2 + n
    if body.data[2 + n] not in (0x02, 0x30) or not body.has(size):
        return None
    kind = der_kind(body.data[:size])
    end = body.end(size) if kind else None
    return None if end is None else (kind, end)


def ssh_end(body: Body) -> tuple[int, int] | None:
    """The kind of the SSH key at the start of ``body`` and where it ends in the text."""
    if body.has(len(MAGIC)) and body.data.startswith(MAGIC):
        size, have = None, 256
        while size is None and body.has(have):
            size, have = openssh_size(body.data), 2 * have
        if size is None:
            body.has(len(body.text))  # all there is
            size = openssh_size(body.data)
        end = None if size is None else body.end(size)
        return None if end is None else (SSH, end)
    at, count, best = 0, 0, None
    while body.has(at + 4):
        size = body.number(at)
        if not body.has(at + 4 + size) or (count == 0 and not KEY_TYPE.match(body.data[4 : 4 + size])):
            break
        at += 4 + size
        count += 1
        if count >= 2:
            best = body.end(at) or best
    return None if best is None else (PUBLIC, best)


def armoured(inner: str) -> int | None:
    """The number of the kind of what stands between PEM lines."""
    inner = re.sub(r"\\+[nrt]", "\n", inner)
    inner = ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else "/", inner)
    headers = {m[1].lower(): m[2] for m in HEADER.finditer(inner)}
    body = decoded(QUOTED.sub("", HEADER.sub("", inner)))
    if not body:
        return None
    if "ENCRYPTED" in headers.get("proc-type", "") and "dek-info" in headers:
        return DER if len(body) % 8 == 0 else None  # whole blocks of a cipher
    return der_kind(body) or ssh_kind(body)


def confirmed_spans(text: str, candidates: bool = True) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what decodes to a key or token."""
    out = []
    if candidates and "." in text:
        out += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_token(m[0])]
    if "-----BEGIN " in text:
        for m in BEGIN.finditer(text):
            close = text.find("-----", m.end())
            line = f"-----END {m[1]}-----"
            if close >= 0 and text.startswith(line, close) and (kind := armoured(text[m.end() : close])):
                out.append((m.start(), kind, close + len(line)))
    taken = sorted((s, e) for s, _, e in out)
    past = 0
    for m in KEY_START.finditer(text):
        at = m.start()
        before = text[at - 1 : at]
        if at < past or (before.isascii() and before.isalnum() and text[max(at - 2, 0) : at] not in ("\\n", "\\r", "\\t")):
            continue
        k = bisect.bisect_right(taken, (at, len(text))) - 1
        if k >= 0 and taken[k][1] > at:
            continue
        for run in RUNS:
            body = Body(text, at, run)
            if found := der_end(body) if m[0][0] == "M" else ssh_end(body):
                kind, past = found
                out.append((at, kind, past))
                break
    if candidates:
        for m in HEX_BODY.finditer(text):
            if any(s < m.end() and m.start() < e for s, _, e in out):
                continue
            body = bytes.fromhex(m[0])
            if kind := der_kind(body) or ssh_kind(body):
                out.append((m.start(), kind, m.end()))
    return out


def spans_of(text: str, candidates: bool = True, hex_run: bool = True) -> list[tuple[int, int, int]]:
    """All spans of a text in order. A caller that knows that no run of hex or base64 is long enough says so."""
    out = []
    if NAMES.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if hex_run:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out + confirmed_spans(text, candidates))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found) for every row of ``docs``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for first, end, data, offsets in slices(batch.column(1)):
                s, e = runs(_HEX_BYTE[data], offsets)
                hexed = set((np.searchsorted(offsets, s[e - s >= HEX_LEAST], side="right") - 1).tolist())
                s, e = runs(_B64[data], offsets)
                coded = set((np.searchsorted(offsets, s[e - s >= CANDIDATE], side="right") - 1).tolist())
                for k in range(end - first):
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode(errors="replace")
                    # Tokens and hex keys hold runs of CANDIDATE characters; wrapped base64 may not.
                    spans = spans_of(text, k in coded, k in hexed)
                    base = [x for x in spans if x[1] < 3]
                    counts = np.bincount([x[1] for x in base], minlength=3).tolist() if base else [0, 0, 0]
                    found = [{"kind": KINDS[x[1]], "start": x[0], "end": x[2]} for x in spans]
                    for values, x in zip(columns, (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), found)):
                        values.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds))], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>")
