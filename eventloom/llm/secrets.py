"""Secret scans with structural confirmation.

Patterns give the base findings; the method then looks at what long base64 and
hex runs decode to, from every place where an encoding can begin, and reports
what has the structure of a key or token: DER sequences whose nested lengths add
up at all levels, length-prefixed SSH key blobs, OpenSSH's private key files field
by field, armour around any of these (also encrypted, with header lines, or with a check
sum that fits), and signed tokens whose header is a JSON object that names an
algorithm. Whatever stands in a text, nothing raises.

Spans are code points, end exclusive. Defined results: null or empty text has
no findings; overlapping findings of different kinds are all reported; repeated
rows give equal results; an empty table gives an empty result; other columns
pass through if named in ``keep``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from .common import kept_columns, map_texts, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
MIN_VALUE = 12

SEGMENTS = re.compile(r"[A-Za-z0-9_.-]+")
HEADER_AT = re.compile(r"(?:(?<=[_-])|\A)eyJ")
FIRST_NAME = re.compile(rb"\{\s*\"(?:[^\"\\\x00-\x1f]|\\.)*\"\s*:")
RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
RUN16 = re.compile(r"[0-9A-Fa-f]{40,}")
# Where an encoding can begin: a DER sequence, an SSH key type with its length, OpenSSH's magic.
START64 = re.compile(r"M[A-P]|AAAA[BCEI]|b3BlbnNzaC1rZXktdjE")
START16 = re.compile(r"(?=30|000000..(?:7373682d|6563647361)|6f70656e7373682d6b65792d763100)", re.IGNORECASE)
ARMOUR_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
ARMOUR_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ")
ADDED_KINDS = ("jwt", "pem", "key64", "keyhex")
KINDS = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
SSH_NAMES = (b"ssh-rsa", b"ssh-ed25519", b"ssh-dss", b"ecdsa-sha2-")
OPENSSH_MAGIC = b"openssh-key-v1\0"
CIPHER_NAME = re.compile(rb"[A-Za-z0-9@.-]{1,64}")
# What is taken for a key's encoding: at most so many parts and levels, and a value of key size.
MOST_PARTS, MOST_LEVELS, KEY_BYTES = 128, 16, 16
DER_TAGS = frozenset((0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x16, 0x17, 0x18, 0x30, 0x31, 0x80, 0x81, 0x82, 0xA0, 0xA1, 0xA2, 0xA3))
DER_NESTED = frozenset((0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base findings by start, then kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS[x[2]]))


def _decoded64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_item(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value that begins at ``at``."""
    if at + 2 > len(data):
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    length = first
    if first & 0x80:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > len(data):
            return None
        length = int.from_bytes(data[at : at + n], "big")
        at += n
        if length < 0x80:  # would have had the short form
            return None
    return (tag, at, at + length) if at + length <= len(data) else None


def der_end(data: bytes, at: int = 0) -> int | None:
    """Where the key encoded at ``at`` ends; None if none is.

    A sequence of two parts or more, at every level filled by its parts to the
    last byte, with a number, bit or byte string of key size somewhere inside.
    """
    outer = _der_item(data, at)
    if outer is None or outer[0] != 0x30:
        return None
    open_ends, at, parts, top, key = [outer[2]], outer[1], 0, 0, False
    while open_ends:
        if at == open_ends[-1]:
            open_ends.pop()
            continue
        item = _der_item(data, at)
        if item is None or item[2] > open_ends[-1] or item[0] not in DER_TAGS:
            return None
        tag, start, end = item
        parts, top = parts + 1, top + (len(open_ends) == 1)
        if parts > MOST_PARTS or (tag in (0x01, 0x02, 0x03, 0x06) and start == end):
            return None
        key = key or (tag in (0x02, 0x03, 0x04) and end - start >= KEY_BYTES)
        if tag in DER_NESTED:
            if len(open_ends) == MOST_LEVELS:
                return None
            open_ends.append(end)
            at = start
        else:
            at = end
    return outer[2] if top >= 2 and key else None


def _field(data: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the length-prefixed field at ``at``."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (at + 4, end) if at + 4 <= end <= len(data) and at + 4 <= len(data) else None


def openssh_end(data: bytes, at: int = 0) -> int | None:
    """Where the private key file at ``at`` ends: after its magic the names of cipher
    and key derivation, its options, a number of public keys, as many of them, and
    private parts that fill whole cipher blocks."""
    if not data.startswith(OPENSSH_MAGIC, at):
        return None
    at += len(OPENSSH_MAGIC)
    for name in (True, True, False):
        field = _field(data, at)
        if field is None or (name and not CIPHER_NAME.fullmatch(data, *field)):
            return None
        at = field[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= MOST_LEVELS:
        return None
    for _ in range(keys):
        field = _field(data, at)
        if field is None or _field(data, field[0]) is None or not data.startswith(SSH_NAMES, field[0] + 4):
            return None
        at = field[1]
    field = _field(data, at)
    if field is None or field[1] - field[0] < KEY_BYTES or (field[1] - field[0]) % 8:
        return None
    return field[1]


def ssh_end(data: bytes, at: int = 0) -> int | None:
    """Where the length-prefixed fields at ``at`` end that follow an SSH key type."""
    if data.startswith(OPENSSH_MAGIC, at):
        return openssh_end(data, at)
    fields, end, key = 0, at, False
    while fields < 8 and (field := _field(data, end)):
        if not (fields or data.startswith(SSH_NAMES, field[0])):
            break
        key = key or (fields > 0 and field[1] - field[0] >= KEY_BYTES)
        fields, end = fields + 1, field[1]
    return end if fields >= 2 and key else None


def key_end(data: bytes, at: int = 0) -> int | None:
    return der_end(data, at) or ssh_end(data, at)


def keys_in64(run: str) -> list[tuple[int, int]]:
    """Spans in a base64 run that decode to keys, the leftmost first.

    The run is decoded once for each of the four places a group can begin at; a
    place where an encoding can begin is looked up in the one that fits it.
    """
    found, at = [], 0
    body = run.rstrip("=")
    by_place: dict[int, bytes] = {}
    while m := START64.search(body, at):
        start = m.start()
        if start % 4 not in by_place:
            part = body[start % 4 :]
            by_place[start % 4] = _decoded64(part[: len(part) - (len(part) % 4 == 1)]) or b""
        first = start // 4 * 3
        end = key_end(by_place[start % 4], first)
        if end is None:
            at = start + 1
            continue
        at = start + -(-(end - first) * 4 // 3)
        found.append((start, len(run) if at >= len(body) else at))
    return found


def keys_in16(run: str) -> list[tuple[int, int]]:
    """Spans in a hex run, at even and odd places alike, that decode to keys."""
    found, at = [], 0
    by_parity = [bytes.fromhex(run[p : len(run) - (len(run) - p) % 2]) for p in (0, 1)]
    while m := START16.search(run, at):
        start = m.start()
        end = key_end(by_parity[start % 2], start // 2)
        if end is None:
            at = start + 1
            continue
        at = end * 2 + start % 2
        found.append((start, at))
    return found


def is_signed_header(part: str, at: int = 0) -> bool:
    """Whether ``part`` decodes, from ``at`` on, to a JSON object that names an algorithm.

    It is decoded piece by piece, and no further than it is JSON.
    """
    first = _decoded64(part[at : at + 400])
    if first is None or not FIRST_NAME.match(first):
        return False
    chars = 4096
    while True:
        data, whole = _decoded64(part[at : at + chars]), at + chars >= len(part)
        if data is None:
            return False
        try:
            head = json.loads(data.decode() if whole else data.decode("latin-1"))
            return whole and isinstance(head, dict) and isinstance(head.get("alg"), str)
        except json.JSONDecodeError as error:
            if whole or (error.pos < len(data) - 8 and not error.msg.startswith("Unterminated")):
                return False
        except (ValueError, RecursionError):
            return False
        chars *= 4


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of header.claims.signature whose header is confirmed."""
    found = []
    for m in SEGMENTS.finditer(text):
        if "eyJ" not in m[0] or m[0].count(".") < 2:
            continue
        parts = m[0].split(".")
        at = m.start()
        for i in range(len(parts) - 2):
            if "eyJ" in parts[i] and parts[i + 1] and _decoded64(parts[i + 2]):
                head = next((h.start() for h in HEADER_AT.finditer(parts[i]) if is_signed_header(parts[i], h.start())), None)
                if head is not None:
                    found.append((at + head, at + sum(map(len, parts[i : i + 3])) + 2))
            at += len(parts[i]) + 1
    return found


def _crc24(data: bytes) -> int:
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


def is_armoured_key(body: str) -> bool:
    """Whether the lines between armour marks, headers included, hold a key.

    Plain ones decode to a key's structure; encrypted ones say so in a header
    and fill whole cipher blocks; those with a check sum fit it.
    """
    lines = [x.strip() for x in body.splitlines()]
    while lines and not lines[0]:
        lines.pop(0)
    headers = []
    while lines and (ARMOUR_HEADER.match(lines[0]) or (headers and headers[-1].endswith(("\\", ",")))):
        headers.append(lines.pop(0))
    last = next((x for x in reversed(lines) if x), "")
    checked = last.startswith("=") and len(last) == 5
    joined = "".join("".join(lines).split())
    data = _decoded64(joined[:-5] if checked else joined)
    if not data:
        return False
    if checked:
        wanted = _decoded64(last[1:])
        return wanted is not None and data[0] & 0x80 != 0 and _crc24(data) == int.from_bytes(wanted, "big")
    if any(h.startswith("Proc-Type:") and "ENCRYPTED" in h for h in headers):
        return len(data) >= KEY_BYTES and len(data) % 8 == 0
    return key_end(data) == len(data)


def armoured_keys(text: str) -> list[tuple[int, int]]:
    """Spans from a begin mark to the next end mark of the same label."""
    found, begin = [], None
    for m in ARMOUR_LINE.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None and begin[2] == m[2]:
            if is_armoured_key(text[begin.end() : m.start()]):
                found.append((begin.start(), m.end()))
            begin = None
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Findings confirmed by what they decode to."""
    found = []
    if "eyJ" in text:
        found += [(a, b, "jwt") for a, b in signed_tokens(text)]
    if "-----BEGIN " in text:
        found += [(a, b, "pem") for a, b in armoured_keys(text)]
    found += [(m.start() + a, m.start() + b, "key64") for m in RUN64.finditer(text) for a, b in keys_in64(m[0])]
    found += [(m.start() + a, m.start() + b, "keyhex") for m in RUN16.finditer(text) for a, b in keys_in16(m[0])]
    return found


def span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans to every row; with
    ``redact`` also redacted_text (null stays null)."""
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted_text"]
    kept = kept_columns(docs, keep, own)
    small_batches(docs.sparkSession)
    added = dict(zip(own, ["long", "long", "long", "string", "string", "string"], strict=True))
    if not redact:
        del added["redacted_text"]

    def scan(texts: list) -> tuple:
        rows = []
        for text in texts:
            base = base_spans(text) if text else []
            spans = sorted(base + (confirmed_spans(text) if text else []), key=lambda x: (x[0], KINDS[x[2]], x[1]))
            counts = [sum(k == kind for _, _, k in base) for kind in BASE_KINDS]
            row = [*counts, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans)]
            rows.append([*row, redacted(text, spans) if text else text] if redact else row)
        return None, list(zip(*rows, strict=True)) if rows else [[] for _ in added]

    return map_texts(docs, kept, text_column, added, lambda: scan)
