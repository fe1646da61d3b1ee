"""Secret scans with structural confirmation.

Pattern matches (assignments, access ids, long hex) are reported as they are. Further spans are reported
only if their content parses: base64 (also wrapped over lines) or hex that decodes to DER with consistent nested
lengths, to an SSH key's length-prefixed fields, PEM blocks around either, and signed tokens whose header and
claims are JSON. The structure tells private keys from public material (certificates, public keys, signatures
and other DER), which is reported as a kind of its own.

Most documents hold neither a keyword nor a long run of key characters; a byte-level test finds them
exactly, and only the others are read by the patterns.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairwell.llm.common import byte_texts, slices, without

#: In the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh", "public"]
BASE = KINDS[:3]
RESULT = ["spans"]

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[A-Za-z0-9+/=\s]|\\[nr])++)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Lines of base64 without anything else on them, broken by a newline or by its spelling in a string; blanks may indent.
_BREAK = r"(?:(?:\\r)?\\n|\r?\n[ \t]*+)"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
_LINE = re.compile(rf"(?:{_BREAK})?+([A-Za-z0-9+/_-]+)")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){12,}(?![0-9A-Za-z])")

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"-----begin")
#: The shortest run of key characters that any pattern but an assignment needs.
_RUN = 16
_RUN_MEMBER = np.zeros(256, bool)
_RUN_MEMBER[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-", np.uint8)] = True

#: Names that an SSH key blob may begin with.
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")

_SSH_MAGIC = b"openssh-key-v1\0"
#: The most fields that a public one has.
_SSH_FIELDS = 5


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """The content length at a position and where the content begins."""
    if at >= len(data):
        return None
    n = data[at]
    if n < 128:
        return n, at + 1
    k = n & 127
    if not 1 <= k <= 4 or at + 1 + k > len(data):
        return None
    n = int.from_bytes(data[at + 1 : at + 1 + k], "big")
    return None if n < 128 else (n, at + 1 + k)


def is_der(data: bytes) -> bool:
    """A sequence that fills the data, whose elements' lengths fit at every depth and which holds an integer, bit or octet string or object id."""
    if len(data) < 12 or data[0] != 0x30:
        return False
    got = der_length(data, 1)
    if not got or got[0] + got[1] != len(data):
        return False
    stack, leaves = [(got[1], len(data))], 0
    while stack:
        at, end = stack.pop()
        while at < end:
            tag, got = data[at], der_length(data, at + 1)
            if not got or got[1] + got[0] > end or tag & 0x1F == 0x1F or tag == 0:
                return False
            if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
                stack.append((got[1], got[1] + got[0]))
            elif tag in (2, 3, 4, 6):
                leaves += got[0] > 0
            at = got[1] + got[0]
    return leaves > 0


def is_private_der(data: bytes) -> bool:
    """Whether consistent DER is laid out as a private key or a key store: a version of 0 to 3 before something
    else, or an algorithm before an octet string (an encrypted key). Certificates and public keys begin otherwise."""
    at, end = der_length(data, 1)[1], len(data)
    parts: list[tuple[int, int, int]] = []
    while at < end and len(parts) < 3:  # the first three elements tell
        size, begin = der_length(data, at + 1)
        parts.append((data[at], begin, size))
        at = begin + size
    tags = [tag for tag, *_ in parts]
    if tags == [0x30, 0x04]:
        return True
    _, begin, size = parts[0]
    return tags[0] == 2 and size == 1 and data[begin] <= 3 and len(parts) > 1 and not (tags == [2, 2])


def is_private_ssh(data: bytes) -> bool:
    """A private SSH key: its magic, then length-prefixed fields."""
    return data.startswith(_SSH_MAGIC) and fields(data, len(_SSH_MAGIC), 3, exact=False)


def is_public_ssh(data: bytes) -> bool:
    """A public SSH key: length-prefixed fields that begin with a key type and fill the data."""
    got = int.from_bytes(data[:4], "big")
    return data[4 : 4 + got] in _SSH_NAMES and fields(data, 0, 2, exact=True)


def fields(data: bytes, at: int, least: int, exact: bool) -> bool:
    n = 0
    while at + 4 <= len(data) and (exact or n < least):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at, n = at + 4 + size, n + 1
    return n >= least and (not exact or at == len(data) and n <= _SSH_FIELDS)


def decoded64(text: str) -> bytes | None:
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def as_object(part: str) -> dict | None:
    data = decoded64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed(header: str, claims: str) -> bool:
    head = as_object(header)
    return bool(head) and isinstance(head.get("alg"), str) and as_object(claims) is not None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_der(data):
        return "der" if is_private_der(data) else "public"
    return "ssh" if is_private_ssh(data) else "public" if is_public_ssh(data) else None


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens among dotted parts: any three in a row, whatever stands before and after them."""
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        k = 0
        while k + 2 < len(parts):
            if len(parts[k]) >= 8 and is_signed(parts[k], parts[k + 1]):
                end = at + sum(map(len, parts[k : k + 3])) + 2
                yield at, end
                at, k = end + 1, k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1


def wrapped_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64 over several lines: lines of one width, then a narrower one or none.

    Lines are decoded whole only where the lengths that DER or SSH fields declare add up to what the lines hold.
    """
    for m in WRAPPED.finditer(text):
        lines = [(x.start(1), x.end(1)) for x in _LINE.finditer(text, m.start(), m.end())]
        widths = [b - a for a, b in lines]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and widths[j] == widths[i]:
                j += 1
            ends = [j + 1, j] if j < len(lines) and widths[j] < widths[i] else [j]
            for k, e in ((k, e) for k in range(i, j) for e in ends):
                if kind := kind_of_lines(text, lines, k, e):
                    yield lines[k][0], m.end() if e == len(lines) else lines[e - 1][1], kind
                    break
            i = j


def kind_of_lines(text: str, lines: list[tuple[int, int]], first: int, end: int) -> str | None:
    """The kind of key that lines first to end (exclusive) spell, which all but the last are of one width."""
    width = lines[first][1] - lines[first][0]
    if end - first < 2 or width < 16 or text[lines[first][0]] not in "MAb":
        return None
    chars = (end - first - 1) * width + lines[end - 1][1] - lines[end - 1][0]

    def read(at: int, n: int) -> bytes:
        """n bytes of what the lines spell, fewer at the end."""
        a, b = at // 3 * 4, min(chars, -(-(at + n) // 3) * 4)
        rows = range(first + a // width, first + -(-b // width))
        part = "".join(text[x:y] for x, y in (lines[r] for r in rows))[a % width :][: max(0, b - a)]
        return (decoded64(part) or b"")[at % 3 :][:n]

    if not any(-(-total * 4 // 3) == chars for total in declared(read, chars * 3 // 4)):
        return None
    return key_kind(decoded64("".join(text[x:y] for x, y in lines[first:end])))


def declared(read: Callable[[int, int], bytes], held: int) -> Iterator[int]:
    """How many bytes a key may take in all, by the lengths that it declares; held bytes are there."""
    head = read(0, 16)
    if head[:1] == b"\x30":
        if got := der_length(head, 1):
            yield sum(got)
    elif head.startswith(_SSH_MAGIC):
        yield held
    elif head[4:8] in {name[:4] for name in _SSH_NAMES}:
        at = 0
        for _ in range(_SSH_FIELDS):
            at += 4 + int.from_bytes(read(at, 4), "big")
            if at >= held:
                break
        yield at


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed; code points, the end exclusive."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out += [(a, b, "jwt") for a, b in signed_tokens(text)]
    blocks = []
    for m in PEM.finditer(text):
        if kind := key_kind(decoded64(re.sub(r"\s|\\[nr]", "", m[2]))):
            blocks.append((m.start(), m.end(), "public" if kind == "public" else "pem"))
    out += blocks
    bare = [(m.start(), m.end(), key_kind(decoded64(m[0]))) for m in BASE64.finditer(text)]
    bare += wrapped_keys(text)
    seen = {x for x in bare if x[2] and not any(a <= x[0] < b for a, b, _ in blocks)}
    for m in ANY_HEX.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0])):
            seen.add((m.start(), m.end(), kind))
    out += seen
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def suspects(texts: list[bytes]) -> np.ndarray:
    """Which texts may have a span: those with a keyword or a run of key characters."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    breaks = np.flatnonzero(~_RUN_MEMBER[raw])
    far = np.flatnonzero(np.diff(breaks, prepend=-1) > _RUN)
    # a run ends at the break behind it, at the latest at the newline that follows its own text
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, breaks[far], "left")] = True
    for i in np.flatnonzero(~out).tolist():
        low = texts[i].lower()
        out[i] = any(k in low for k in _KEYWORDS)
    return out


def scan(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with spans: array of struct(kind, start, end), by start, then kind as listed in KINDS.

    A null or empty text has no spans. Each row is scanned on its own, so repeated rows have equal spans; a very
    long text is scanned whole. An empty table gives an empty result. An input column named spans gives way to
    the result.
    """
    docs = without(docs, RESULT)
    out_fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*out_fields, T.StructField("spans", T.ArrayType(kind))])
    names = [f.name for f in out_fields]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            spans: list[list[dict]] = [[] for _ in texts]
            for a, b in slices(texts):
                for i in (np.flatnonzero(suspects(texts[a:b])) + a).tolist():
                    spans[i] = [{"kind": k, "start": s, "end": e} for s, e, k in find(texts[i].decode("utf-8", "replace"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(spans, arrow)], names=[*names, "spans"])

    return docs.mapInArrow(run, schema)
