"""Secret scan with structural confirmation.

Three base kinds are plain patterns. Further kinds are reported only after their structure holds. Runs of at
least 40 base64 or base64url characters, and of at least 48 hex digits, are decoded. der: lengths nest exactly
and the parts are those of a private key (PKCS#1, PKCS#8 plain or encrypted, SEC 1, or DSA's six numbers), so
public keys and certificates are none. openssh: its magic and length-prefixed fields. jwt: a JSON header that
names an algorithm, and a JSON payload. pem: a block that decodes to one of those, or whose headers say how it
is encrypted. What decodes to plain ASCII is looked through again, up to NESTED times, and reported as what
lies inside.

Defined results: a null text counts as empty and gives zero counts, the hash of the empty string and
empty spans; repeated rows and repeated or null doc_ids are judged row by row; rows are never joined,
so columns of any other name pass unseen. Texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import slices

# The three base patterns, group numbers and least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")

# Looks ahead, so that each dot-joined part may begin a token.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=(eyJ[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[^-]|-(?!----))+)-----END \1-----")
PEM_HEADERS = re.compile(r"(?:\s*[A-Za-z][A-Za-z0-9-]*:[ \t]*\S+(?=\s))*")
ENCRYPTED = re.compile(r"Proc-Type:\s*4,ENCRYPTED\s[\s\S]*DEK-Info:\s*[A-Za-z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})\s*$")
ESCAPED_SPACE = re.compile(r"\\+[nrt]")
BREAK = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[ \t]*")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+(?:" + BREAK.pattern + r"[A-Za-z0-9+/]++)+={0,2}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
BASE64URL = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
HEX_ANY_CASE = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
#: Every run of the four patterns above lies in one of these, so a text without any needs none of them.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40}")
#: Encodings within encodings that are undone, and the least bytes of a key.
NESTED, LEAST_BYTES = 2, 24
OPENSSH = b"openssh-key-v1\0"
#: Parts that a private key has at most: those of PKCS#1 with more than two primes.
KEY_PARTS = 10
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


Element = tuple[int, int, int]  # tag, and where its contents begin and end


def elements(data: bytes, at: int, end: int, depth: int = 0) -> list[Element] | None:
    """The DER elements that fill data[at:end] exactly, as those of every constructed one fill it; else None."""
    found = []
    while at < end:
        if at + 2 > end or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end or tag == 0:
            return None
        if tag & 0x20 and not elements(data, at, at + size, depth + 1):
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def private_key(data: bytes) -> bool:
    """Whether data is one DER SEQUENCE with the parts of a private key."""
    outer = elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = elements(data, *outer[0][1:]) or []
    tags = [tag for tag, _, _ in parts]
    names = lambda part: [t for t, _, _ in elements(data, *part[1:]) or []][:1] == [OBJECT]
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8: an algorithm, then the key
        return names(parts[0])
    version = data[parts[0][1]] if tags[:1] == [INTEGER] and parts[0][2] - parts[0][1] == 1 else None
    if version not in (0, 1):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8: an algorithm, the key, attributes, the public key
        return names(parts[1]) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if tags[1:2] == [OCTETS]:  # SEC 1: the key, the curve, the public key
        return version == 1 and set(tags[2:]) <= {0xA0, 0xA1}
    if set(tags) == {INTEGER}:  # PKCS#1 of two primes; DSA
        return len(tags) == 9 or (len(tags) == 6 and version == 0)
    return version == 1 and tags == [INTEGER] * 9 + [SEQUENCE]  # PKCS#1 of more primes


def _openssh_fields(read: Callable[[int, int], bytes], size: int, fields: int) -> int | None:
    """Where the first fields of an OpenSSH private key end, if they are within its size; read(at, n): its bytes."""
    at = len(OPENSSH)
    if read(0, at) != OPENSSH:
        return None
    for _ in range(fields):
        if at + 4 > size:
            return None
        at += 4 + int.from_bytes(read(at, 4), "big")
        if at > size:
            return None
    return at


def openssh_whole(data: bytes) -> bool:
    """Whether data starts as an OpenSSH private key: its magic, then three fields with fitting lengths."""
    return _openssh_fields(lambda at, n: data[at : at + n], len(data), 3) is not None


def from_base64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    data = from_base64(part, url=True)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def key_kind(data: bytes | None) -> str | None:
    """der or openssh if the decoded bytes have the structure of a key."""
    if data and len(data) >= LEAST_BYTES:
        if private_key(data):
            return "der"
        if openssh_whole(data):
            return "openssh"
    return None


def decoded_kind(data: bytes | None, nested: int) -> str | None:
    """The same, or the kind of the first thing that confirmed_spans() finds where they are plain ASCII text."""
    kind = key_kind(data)
    if kind or not data or not nested or not data.isascii() or not data.decode("ascii").replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
        return kind
    return next((k for _, _, k in confirmed_spans(data.decode("ascii"), nested - 1)), None)


def pem_key(body: str) -> bool:
    """Whether the inside of a PEM block decodes to a key, or is an encrypted key: its headers name a cipher
    and an initial vector, and the rest is whole cipher blocks. Line ends may be escaped, as in JSON."""
    body = ESCAPED_SPACE.sub("\n", body).replace("\\/", "/")
    headers = PEM_HEADERS.match(body)[0]
    data = from_base64(re.sub(r"\s", "", body[len(headers) :]))
    encrypted = ENCRYPTED.search(headers)
    if encrypted and data and len(data) >= LEAST_BYTES and len(data) % (len(encrypted[1]) // 2) == 0:
        return True
    return key_kind(data) is not None


class Lines:
    """Wrapped base64 as one run of characters, of which any bytes can be decoded without the rest."""

    def __init__(self, text: str, start: int, end: int):
        breaks = [b.span() for b in BREAK.finditer(text, start, end)]
        self.spans = list(zip([start, *(b for _, b in breaks)], [*(a for a, _ in breaks), end]))
        lines = [text[a:b] for a, b in self.spans]
        lines[-1] = lines[-1].rstrip("=")
        self.flat = "".join(lines)
        self.at = [0, *itertools.accumulate(map(len, lines))]
        # the last of the lines that follow line i and have its length
        self.alike = list(range(len(lines)))
        for i in range(len(lines) - 2, -1, -1):
            if len(lines[i]) == len(lines[i + 1]):
                self.alike[i] = self.alike[i + 1]

    def size(self, i: int, last: int) -> int | None:
        """Bytes of lines i to last; None if they aren't whole."""
        chars = self.at[last + 1] - self.at[i]
        return None if chars % 4 == 1 else chars * 3 // 4

    def bytes(self, i: int, start: int, n: int) -> bytes:
        """n bytes from start on, counted from line i; fewer at the end."""
        first = self.at[i] + start // 3 * 4
        chars = self.flat[first : self.at[i] + -(-(start + n) // 3) * 4]
        return base64.b64decode(chars[: len(chars) - (len(chars) % 4 == 1)] + "==")[start % 3 :][:n]

    def number(self, i: int, start: int) -> int:
        return int.from_bytes(self.bytes(i, start, 4), "big")

    def last_of(self, i: int, size: int) -> int | None:
        """The first line with which lines from i on hold size bytes; None if all of them hold fewer."""
        last = bisect.bisect_left(self.at, self.at[i] + -(-size * 4 // 3)) - 1
        return max(last, i) if last < len(self.spans) else None


def wrapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 over several lines: a DER key's own length and an OpenSSH key's fields say
    where it ends; an OpenSSH key that is cut off ends with the last line as long as its first.

    Of a line that begins none only a few bytes are looked at, so the time grows with the text."""
    found = []
    for m in WRAPPED.finditer(text):
        lines, i = Lines(text, m.start(), m.end()), 0
        while i < len(lines.spans):
            last, kind = _wrapped_key(lines, i)
            if kind:
                found.append((lines.spans[i][0], lines.spans[last][1], kind))
            i = last + 1 if kind else i + 1
    return found


def _wrapped_key(lines: Lines, i: int) -> tuple[int, str | None]:
    """Where the key that begins line i ends, and its kind; None if none does, or not over several lines."""
    head = lines.bytes(i, 0, 6)
    if head == OPENSSH[:6]:
        last = lines.alike[i]
        size = openssh_size(lines, i, min(last + 1, len(lines.spans) - 1))
        if size:
            last = lines.last_of(i, size) or i
        whole = lines.size(i, last)
        return last, "openssh" if last > i and whole and whole >= LEAST_BYTES and _openssh_fields(lambda at, n: lines.bytes(i, at, n), whole, 3) else None
    if head[:1] != b"\x30" or len(head) < 6:
        return i, None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    last = lines.last_of(i, size) if n <= 4 else None
    if not last or last == i or lines.size(i, last) != size or size < LEAST_BYTES or not _key_parts(lines, i, 2 + n, size):
        return i, None
    return last, "der" if private_key(lines.bytes(i, 0, size)) else None


def _key_parts(lines: Lines, i: int, at: int, end: int) -> bool:
    """Whether no more parts than a key has fill the bytes from at to end, by their lengths alone."""
    for _ in range(KEY_PARTS):
        head = lines.bytes(i, at, 6)
        if len(head) < 2:
            return False
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        if n > 4:
            return False
        at += 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
        if at >= end:
            return at == end
    return False


def openssh_size(lines: Lines, i: int, last: int) -> int | None:
    """Length of an OpenSSH private key by its fields, give or take the last two bytes that a line may lack.
    Its fields: cipher, way and options of encryption, how many keys (always one), public and private key."""
    whole = (lines.at[last + 1] - lines.at[i]) // 4 * 3
    read = lambda at, n: lines.bytes(i, at, n)
    at = _openssh_fields(read, whole, 3)
    if not at or at + 4 > whole or lines.number(i, at) != 1:
        return None
    at += 4
    for _ in range(2):
        if at + 4 > whole:
            return None
        at += 4 + lines.number(i, at)
    return at if at <= whole + 2 else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append((m.start(), m.end(), "assign"))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            found.append((m.start(), m.end(), "access"))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str, nested: int = NESTED) -> list[tuple[int, int, str]]:
    """Candidates whose decoded structure holds. A candidate inside another one's span is not reported again."""
    found, public = [], []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if "PUBLIC" in m[1] or "CERTIFICATE" in m[1]:
                public.append(m.span())
            elif pem_key(m[2]):
                found.append((m.start(), m.end(), "pem"))
    if "eyJ" in text:  # base64url of {"
        upto = 0
        for m in TOKEN.finditer(text):
            head = _json_object(m[1]) if m.start() >= upto else None
            if head and isinstance(head.get("alg"), str) and _json_object(m[2]) is not None:
                upto = m.end(3)
                found.append((m.start(), upto, "jwt"))
    if not ENCODED.search(text):
        return found
    free = _outside([(s, e) for s, e, _ in found] + public)
    found += [w for w in wrapped_spans(text) if free(*w[:2])]
    for pattern, decode in ((BASE64, from_base64), (BASE64URL, lambda x: from_base64(x, url=True)), (HEX_ANY_CASE, lambda x: bytes.fromhex(x[: len(x) // 2 * 2]))):
        free = _outside([(s, e) for s, e, _ in found] + public)
        for m in pattern.finditer(text):
            kind = decoded_kind(decode(m[0]), nested) if free(*m.span()) else None
            if kind:
                found.append((*m.span(), kind))
    return found


def _outside(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Tells of a span whether it overlaps none of these."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return lambda start, end: (i := bisect.bisect_right(ends, start)) == len(ends) or starts[i] >= end


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind in listed order, comma-joined."""
    order = {k: i for i, k in enumerate((*BASE_KINDS, "pem", "jwt", "der", "openssh"))}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256 and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, spans = {k: [] for k in BASE_KINDS}, [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for kind in BASE_KINDS:
                    counts[kind].append(sum(k == kind for _, _, k in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + confirmed_spans(text or "")))
            columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; in text, every span found is replaced by mark (a null text stays null)."""

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t and redacted(t, base_spans(t) + confirmed_spans(t), mark) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(redact, docs.withColumn("text", F.col("text").cast("string")).schema)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
