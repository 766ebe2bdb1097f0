"""Secret scans with structural confirmation.

Base patterns find assignments, access keys and hexadecimal runs. Beyond them, candidates are
decoded and reported only if what they hold has the structure of a secret: base64 or
hexadecimal (of either case) that is a private key in DER, an armoured private key, an OpenSSH
key (magic and nested length-prefixed strings), and signed tokens whose first part is a JSON
object with an algorithm. A key may start inside a run of base64: its own length must then
end it with the run. DER lengths must add up exactly, inside as well, and the values be those
of PKCS#8 (plain or encrypted), SEC1, or a version and integers only, as PKCS#1 has; public
keys, certificates and signatures have other shapes. An armour may hold header lines and
line ends spelt as backslash n; the content of a legacy encrypted one is a cipher's blocks.

Plan: one narrow pass over the texts in Arrow batches; nothing is shuffled or gathered.

Defined results: a null text is empty and has no spans. Repeated rows each give a row. Spans of
one kind don't overlap; spans of different kinds may. An OpenSSH key that is cut off behind its
number of keys is reported; one whose strings are whole must end with the last of them. Empty tables give no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm.shared import short_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "openssh")

# The base patterns and the least length of what they must catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of 18 or more; a shorter one holds no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[\r\n]|\\[nr])*+(?:[A-Za-z-]++: [^\r\n\\]*+(?:[\r\n]|\\[nr])++)*+)((?:[A-Za-z0-9+/=\s]|\\[nr])++)-----END \1-----", re.ASCII)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]{48,}")
#: How the first bytes of a DER sequence and of an OpenSSH key look in base64.
KEY_STARTS = re.compile(r"M[B-I]|b3BlbnNzaC1rZXktdjEA")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
OPENSSH = b"openssh-key-v1\x00"


def decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, padding optional."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_tags(data: bytes, depth: int = 0) -> list[int] | None:
    """The tags of a run of DER values, inner ones after their outer; None if lengths don't add up."""
    tags, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data) or not data[at]:
                return None
            n = int.from_bytes(data[at : at + wide], "big")
            at += wide
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        tags.append(tag)
        if tag & 0x20:
            if depth >= 16:
                return None
            inner = der_tags(data[at : at + n], depth + 1)
            if inner is None:
                return None
            tags += inner
        elif tag in (0x02, 0x06) and not n:
            return None
        at += n
    return tags


def der_values(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of a run of DER values whose lengths are known to add up."""
    out, at = [], 0
    while at < len(data):
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            wide = n & 0x7F
            n = int.from_bytes(data[at : at + wide], "big")
            at += wide
        out.append((tag, data[at : at + n]))
        at += n
    return out


# The tags of DER that private keys are made of.
INTEGER, BITS, OCTETS, IDENTIFIER, SEQUENCE, FIRST, SECOND = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE over all bytes, and a private key by the values in it."""
    if len(data) < 24 or data[0] != SEQUENCE or not der_tags(data):
        return False
    whole = der_values(data)
    if len(whole) != 1:
        return False
    inner = der_values(whole[0][1])
    tags = [t for t, _ in inner]
    algorithm = lambda v: [t for t, _ in der_values(v)][:1] == [IDENTIFIER]
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        return algorithm(inner[0][1]) and len(inner[1][1]) >= 8
    if not inner or inner[0] not in ((INTEGER, b"\0"), (INTEGER, b"\1")):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8
        return algorithm(inner[1][1]) and bool(der_tags(inner[2][1])) and set(tags[3:]) <= {FIRST, 0x81, SECOND}
    if tags[1:2] == [OCTETS]:  # SEC1
        return inner[0][1] == b"\1" and len(inner[1][1]) >= 16 and tags[2:] in ([], [FIRST], [SECOND], [FIRST, SECOND])
    return len(tags) >= 4 and set(tags) == {INTEGER}


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(string() is None for _ in range(3)):  # cipher, key derivation, its options
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= n <= 16:
        return False
    at += 4
    for _ in range(n + 1):  # the public keys, then the private part
        if string() is None:
            return True  # cut off
    return at == len(data)


def keys_in(run: str) -> Iterator[tuple[int, str]]:
    """(place, kind) of the key that a run of base64 ends with."""
    size = len(run.rstrip("="))
    for m in KEY_STARTS.finditer(run):
        at = m.start()
        if m[0][0] == "b":
            if (raw := decoded(run[at:])) and is_openssh_key(raw):
                yield at, "openssh"
                return
            continue
        head = decoded(run[at : at + 8].rstrip("="))
        if head is None or len(head) < 6 or (size - at) % 4 == 1:
            continue
        wide = head[1] & 0x7F if head[1] & 0x80 else 0
        if wide > 4 or 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1]) != (size - at) * 6 // 8:
            continue
        if (raw := decoded(run[at:])) and is_der_key(raw):
            yield at, "der"
            return


def is_armoured(headers: str, body: str) -> bool:
    raw = decoded(re.sub(r"\s+|\\[nr]", "", body))
    if not raw:
        return False
    return is_der_key(raw) or is_openssh_key(raw) or ("ENCRYPTED" in headers and len(raw) % 8 == 0)


def is_token_header(text: str) -> bool:
    raw = decoded(text)
    if raw is None:
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none"


def find_secrets(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind as listed."""
    text = text or ""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    found += [(m.start(), "der", m.end()) for m in HEXADECIMAL.finditer(text) if len(m[0]) % 2 == 0 and m[0].startswith("30") and is_der_key(bytes.fromhex(m[0]))]
    if "-----BEGIN " in text:
        found += [(m.start(), "pem", m.end()) for m in PEM.finditer(text) if is_armoured(m[2], m[3])]
    for m in BASE64.finditer(text):
        found += [(m.start() + at, kind, m.end()) for at, kind in keys_in(m[0])]
    found += [(m.start(), "jwt", m.end()) for m in JWT.finditer(text) if is_token_header(m[1])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _scan(batches):
    for batch in batches:
        rows = [find_secrets(x.as_py()) for x in batch.column(1)]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        spans = pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in r] for r in rows], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["id", "spans"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: its id and spans, array<struct<kind,start,end>> in code points, end
    exclusive, by start, then kind as listed in KINDS."""
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def secret_digest(found: DataFrame) -> DataFrame:
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest_of(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans if k in BASE).encode()).hexdigest()
