"""Secret scan with structural confirmation.

Candidates are runs of base64 or hex characters, found by array operations over the bytes of a
batch. A candidate is reported only once its structure was parsed:

- private_key: DER inside base64, hex (in one run, at the end of one after one of +/-_, or wrapped
  over lines) or PEM armour whose nested lengths fill it exactly and whose fields are those of
  PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1; or an OpenSSH key with its magic and length-prefixed
  strings;
- jwt: a signed token whose header decodes to JSON with an "alg" and whose payload is JSON;
- aws_key_id: AKIA or ASIA and 16 upper-case letters and digits;
- hex_secret, base64_secret: assigned to a name such as token, secret, password or api_key,
  decoding to at least 8 bytes that are not a text of few distinct values; base64 with letters
  of both cases, so that a long mixed-case identifier assigned to such a name is reported too.

Digests, public keys and identifiers outside an assignment are not reported.

Cases: null and empty texts have no findings; a null id is reported as null. Every occurrence is
a finding of its own, in repeated rows too. Texts are scanned whole, however long, in time that
grows with their length. An empty table gives an empty result. Other columns are ignored by scan
and carried through by redact.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, chunks, position, project, with_columns_apart

SCHEMA = "doc_id bigint, kind string, start_char bigint, end_char bigint, decoded_bytes int"
LEAST = 16

_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_BLANK = frozenset(b" \t\n\r\f\v")
_HEX = re.compile(rb"[0-9a-fA-F]+\Z")
_AWS = re.compile(rb"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_NAME = re.compile(rb"(?i)secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential")
_BEGIN = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_END = re.compile(rb"-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
_OBJECT = re.compile(rb"\{\s*\"[\w.-]*\"\s*:")
_AFTER = re.compile(rb"(?<=[+/_-])[A-Za-z0-9]")

_LINE = re.compile(rb"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_-]+)")
_OPENSSH_HEADS = b"b3BlbnNzaC1rZXktdjEA", b"openssh-key-v1\0".hex().encode()


def _tlv(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at at, if it fits before end."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        t = _tlv(b, at, end)
        if t is None:
            return None
        out.append(t)
        at = t[2]
    return out


def is_private_der(b: bytes) -> bool:
    """PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1, its lengths nested without a byte to spare."""
    top = _tlv(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return False
    kids = _children(b, top[1], top[2])
    if not kids:
        return False
    tags = [t for t, _, _ in kids]
    if len(tags) >= 9 and tags[:9] == [2] * 9:
        return kids[0][2] - kids[0][1] == 1 and b[kids[0][1]] in (0, 1)
    if tags[:3] == [2, 0x30, 4] or tags[:2] == [0x30, 4]:
        at = tags.index(0x30)
        inner = _children(b, kids[at][1], kids[at][2])
        return bool(inner) and inner[0][0] == 6 and kids[at + 1][2] - kids[at + 1][1] >= 16
    return tags[:2] == [2, 4] and b[kids[0][1] : kids[0][2]] == b"\x01" and 16 <= kids[1][2] - kids[1][1] <= 80


def is_openssh_private(b: bytes) -> bool:
    magic = b"openssh-key-v1\x00"
    if not b.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, derivation, its options
        if at + 4 > len(b):
            return False
        n = int.from_bytes(b[at : at + 4], "big")
        at += 4 + n
        if at > len(b):
            return False
    return at + 4 <= len(b) and int.from_bytes(b[at : at + 4], "big") >= 1


def _b64(s: bytes) -> bytes | None:
    s = s.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + b"=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(s: bytes) -> object:
    raw = _b64(s)
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None


def _varied(raw: bytes) -> bool:
    return len(raw) >= 8 and len(set(raw)) >= min(16, (len(raw) + 1) // 2)


def assigned(doc: bytes, start: int) -> bool:
    """Whether the run at start is the value of a name such as token: the name, perhaps quoted,
    then :, =, := or =>, then the value, perhaps quoted, with any space between."""
    at = start - 1

    def quote_and_space(at: int, quote_first: bool) -> int:
        for quote in (quote_first, not quote_first):
            if quote:
                at -= at >= 0 and doc[at] in b"\"'"
            else:
                while at >= 0 and doc[at] in _BLANK:
                    at -= 1
        return at

    at = quote_and_space(at, True)
    if at < 0 or doc[at] not in b":=>":
        return False
    at -= 2 if doc[at - 1 : at + 1] in (b":=", b"=>") and at else 1
    if doc[at + 1] == 62:  # a > alone
        return False
    end = at = quote_and_space(at, False)
    while at >= 0 and doc[at] in _WORD:
        at -= 1
    return _NAME.search(doc, at + 1, end + 1) is not None


def _signed(doc: bytes, start: int, end: int) -> tuple[str, int, int, int] | None:
    """The signed token whose header is the end of the run doc[start:end]."""
    at = doc.find(b"eyJ", start, end) if doc[end : end + 1] == b"." else -1
    while at >= 0:
        if _OBJECT.match(_b64(doc[at : min(end, at + 64) - (min(end, at + 64) - at) % 4]) or b"") and (m := _JWT.match(doc, at)):
            head, body, _ = m.group(0).split(b".")
            header = _json(head)
            if isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(_json(body), dict):
                return "jwt", at, m.end(), len(_b64(head) or b"") + len(_b64(body) or b"")
        at = doc.find(b"eyJ", at + 1, end)
    return None


def _key(run: bytes) -> int | None:
    """Decoded size of the private key that the run is, in hex or base64."""
    raw = binascii.unhexlify(run) if len(run) % 2 == 0 and _HEX.match(run) else _b64(run)
    return len(raw) if raw and (is_private_der(raw) or is_openssh_private(raw)) else None


def confirm(doc: bytes, start: int, end: int) -> tuple[str, int, int, int] | None:
    """What the run doc[start:end] is, with its extent and decoded size, or None."""
    run = doc[start:end]
    if got := _signed(doc, start, end):
        return got
    if (m := _AWS.search(doc, start, end)) and (m.start() == start or not doc[m.start() - 1 : m.start()].isalnum()):
        return "aws_key_id", m.start(), m.end(), 16
    pad = end
    while pad < min(len(doc), end + 2) and doc[pad] == 61:
        pad += 1
    is_hex = _HEX.match(run) and len(run) % 2 == 0
    if size := _key(run):
        return "private_key", start, end if is_hex else pad, size
    for m in _AFTER.finditer(run):  # a key at the end of a longer run, after a path or a prefix
        rest = len(run) - m.start()
        need = _digits(run[m.start() : m.start() + 32])
        if (need and need[0] == rest or any(run.startswith(h, m.start()) for h in _OPENSSH_HEADS)) and (size := _key(run[m.start() :])):
            return "private_key", start + m.start(), end if need and need[1] else pad, size
    if is_hex:
        raw = binascii.unhexlify(run)
        return ("hex_secret", start, end, len(raw)) if _varied(raw) and assigned(doc, start) else None
    raw = _b64(run)
    if raw is None:
        return None
    mixed = re.search(rb"[a-z]", run) and re.search(rb"[A-Z]", run)
    if mixed and _varied(raw) and assigned(doc, start):
        return "base64_secret", start, pad, len(raw)
    return None


def _digits(head: bytes) -> tuple[int, bool] | None:
    """Base64 or hex digits of the private key whose DER begins with head, and whether hex."""
    for is_hex in (True, False):
        if head[:2] == b"30" if is_hex else head[:1] == b"M":
            try:
                raw = binascii.unhexlify(head[:16]) if is_hex else _b64(head[:16])
            except (binascii.Error, ValueError):
                raw = None
            if raw and raw[0] == 0x30 and (t := _tlv(raw, 0, 1 << 40)) and t[1] < len(raw) and raw[t[1]] in (2, 0x30):
                return (2 * t[2] if is_hex else -(-t[2] * 4 // 3)), is_hex
    return None


def wrapped(doc: bytes, start: int, end: int) -> tuple[str, int, int, int] | None:
    """The private key without armour whose first line is doc[start:end]. DER says how long it is;
    an OpenSSH key goes on until a line is shorter than its first, or another ends the block."""
    if not (m := _LINE.match(doc, end)):
        return None
    head, width = doc[start : start + 32], end - start
    need = _digits(head)
    openssh = next((i for i, x in enumerate(_OPENSSH_HEADS) if head[:20].lower() == x[:20] or head.startswith(x)), None)
    if need is None and openssh is None or need and need[0] > len(doc) - start:
        return None
    is_hex = need[1] if need else openssh == 1
    lines, total, stop = [doc[start:end]], width, end
    while m and (total < need[0] if need else len(lines[-1]) == width and len(m.group(1)) <= width):
        lines.append(m.group(1))
        total, stop = total + len(m.group(1)), m.end()
        m = None if doc[stop : stop + 1] == b"=" else _LINE.match(doc, stop)
    if need and total != need[0]:
        return None
    # the last short line may be a word after the key
    for last in (len(lines), len(lines) - 1) if not need else (len(lines),):
        text = b"".join(lines[:last])
        raw = (binascii.unhexlify(text) if len(text) % 2 == 0 and _HEX.match(text) else None) if is_hex else _b64(text)
        if last > 1 and raw and (is_private_der(raw) or is_openssh_private(raw)):
            if last < len(lines):
                stop = doc.rindex(lines[-2], start, stop - len(lines[-1])) + len(lines[-2])
            while not is_hex and doc[stop : stop + 1] == b"=":
                stop += 1
            return "private_key", start, stop, len(raw)
    return None


def armoured(doc: bytes) -> list[tuple[str, int, int, int]]:
    """Keys in PEM armour: from BEGIN to the first END of its label, if that is before the next BEGIN."""
    out = []
    begins = list(_BEGIN.finditer(doc))
    ends = {}
    for m in _END.finditer(doc):
        ends.setdefault(m.group(1), []).append(m)
    for i, m in enumerate(begins):
        those = ends.get(m.group(1), [])
        at = bisect_right(those, m.start(), key=lambda e: e.start())
        if at == len(those) or i + 1 < len(begins) and begins[i + 1].start() < those[at].start():
            continue
        lines = re.sub(rb"\\[nr]", b"\n", doc[m.end() : those[at].start()]).split(b"\n")
        raw = _b64(b"".join(b"".join(x for x in lines if b":" not in x).split()))
        if raw and (is_private_der(raw) or is_openssh_private(raw)):
            out.append(("private_key", m.start(), those[at].end(), len(raw)))
    return out


def find(doc: bytes, spans: list[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
    """Confirmed findings in a document, byte offsets, in order and without overlap."""
    pem = armoured(doc) if b"PRIVATE KEY-----" in doc else []
    begins, out, last = [x[1] for x in pem], list(pem), 0
    for s, e in spans:
        at = bisect_right(begins, s)
        if s < last or at and s < pem[at - 1][2]:
            continue
        if got := wrapped(doc, s, e) or confirm(doc, s, e):
            out.append(got)
            last = got[2]
    out.sort(key=lambda x: x[1])
    if b"AKIA" in doc or b"ASIA" in doc:  # those that share a run with another finding or id
        begins, ends, more = [x[1] for x in out], [x[2] for x in out], []
        for m in _AWS.finditer(doc):
            at = bisect_right(begins, m.start())
            if (not at or ends[at - 1] <= m.start()) and (at == len(begins) or begins[at] >= m.end()):
                more.append(("aws_key_id", m.start(), m.end(), 16))
        out = sorted(out + more, key=lambda x: x[1])
    return out


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of LEAST or more characters with a digit, an AKIA or ASIA, an M in front (as of DER in
    base64) or an assignment before them, or of 40 or more: (start, end, document)."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = _RUN[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    # documents end runs too
    bounds = np.unique(np.concatenate([[0], flips, offsets[(offsets > 0) & (offsets < n)], [n]]))
    starts, ends = bounds[:-1], bounds[1:]
    keep = inside[starts] & (ends - starts >= LEAST)
    starts, ends = starts[keep], ends[keep]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    keep = (digits[ends] > digits[starts]) | (ends - starts >= 40) | (data[starts] == 77)
    aws = np.zeros(n + 1, np.int64)
    if n > 3:
        aws[4:] = np.cumsum((data[:-3] == 65) & ((data[1:-2] == 75) | (data[1:-2] == 83)) & (data[2:-1] == 73) & (data[3:] == 65))
    keep |= aws[ends] > aws[np.minimum(starts + 3, n)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    for i in np.flatnonzero(~keep).tolist():  # long words, few in any text
        at = int(starts[i]) - 1
        at -= at >= 0 and data[at] in (34, 39)
        while at >= 0 and int(data[at]) in _BLANK:
            at -= 1
        keep[i] = at >= offsets[doc[i]] and data[at] in (58, 61, 62)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _scan(texts: pa.Array) -> Iterator[tuple[int, bytes, list[tuple[str, int, int, int]]]]:
    """(row, document, findings) of the rows that have any."""
    for first, last, data, offsets in chunks(texts):
        starts, ends, doc = candidates(data, offsets)
        rows = {int(d) for d in np.unique(doc)}
        blob = data.tobytes()
        at = blob.find(b"PRIVATE KEY-----")
        while at >= 0:
            rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
            at = blob.find(b"PRIVATE KEY-----", at + 1)
        lows, highs = np.searchsorted(doc, np.arange(last - first)), np.searchsorted(doc, np.arange(last - first), "right")
        for r in sorted(rows):
            base = int(offsets[r])
            text = blob[base : int(offsets[r + 1])]
            spans = [(int(s) - base, int(e) - base) for s, e in zip(starts[lows[r] : highs[r]], ends[lows[r] : highs[r]], strict=True)]
            if got := find(text, spans):
                yield first + r, text, got


def scan(docs: DataFrame) -> DataFrame:
    """Each finding with its document, kind, place in characters and decoded size."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            out: list[list] = [[], [], [], [], []]
            for row, text, found in _scan(b.column(1)):
                at = done = 0
                for kind, s, e, n in found:
                    at, done = at + len(text[done:s].decode("utf-8", "replace")), s
                    for col, v in zip(out, (ids[row].as_py(), kind, at, at + e - s, n), strict=True):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], names=["doc_id", "kind", "start_char", "end_char", "decoded_bytes"])

    return project(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, each finding replaced by [kind] and n_chars counted anew where the text
    changed; all other rows and columns as they were."""
    arrow_batches(docs.sparkSession)
    plain, names = with_columns_apart(docs)
    text_at, n_at = position(docs, "text"), position(docs, "n_chars")
    if text_at is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            changed: dict[int, str] = {}
            for row, text, found in _scan(b.column(text_at)):
                parts, at = [], 0
                for kind, s, e, _ in found:
                    if s >= at:
                        parts += [text[at:s], b"[" + kind.encode() + b"]"]
                        at = e
                changed[row] = b"".join([*parts, text[at:]]).decode("utf-8", "replace")
            if changed:
                texts = b.column(text_at).to_pylist()
                counts = b.column(n_at).to_pylist() if n_at is not None else None
                for row, new in changed.items():
                    texts[row] = new
                    if counts is not None:
                        counts[row] = len(new)
                cols = list(b.columns)
                cols[text_at] = pa.array(texts, b.column(text_at).type)
                if counts is not None:
                    cols[n_at] = pa.array(counts, b.column(n_at).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return plain.mapInArrow(run, plain.schema).toDF(*names)
