"""Secret scans with structural confirmation.

Plain patterns find assigned passwords, access keys and hex strings. Candidates
that only look like an encoded key or a signed token are decoded first and
reported only if their structure holds: DER with exact nested lengths and the
shape of a private key, the length-prefixed fields of an OpenSSH key, a PEM block
around either, or a token whose header names an algorithm and whose signature has
that algorithm's length.

Plan. One pass of Arrow batches, no shuffle. A linear-time (RE2) filter over the
whole batch leaves few texts for the exact patterns. Every text is scanned whole.

Edge cases. A null text counts as empty and has no spans. Empty tables give
empty results; extra columns are ignored; null ids and repeated rows stay as
they are. Offsets count code points, ends are exclusive. Spans of different
kinds may overlap; two spans of one kind never do.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.arrowtext import text_udf

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "token")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:(?!-----)[\s\S]){16,}?)-----END \1-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{39,}={0,2}")
#: First line of base64 that goes on over line ends, real or escaped (an escape's own letter may stand before it).
_FIRST_LINE = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{39,}")
_NEXT_LINE = re.compile(r"""["']?(?:\r\n|[\r\n]|\\r\\n|\\[rn])[\x20\t]*["']?([A-Za-z0-9+/_-]+={0,2})""")
#: Hex of a DER sequence, of the OpenSSH mark, or of the head of a signed token.
_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|(?i:6f70656e7373682d6b65792d7631|65794a))[0-9A-Fa-f]{78,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Superset of all patterns above, in RE2 syntax.
_ANY = (r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{16}|-----BEGIN |eyJ[A-Za-z0-9_-]+\."
        r"|M[A-Za-z0-9+/_-]{39}|b3BlbnNzaC1rZXktdjE|[0-9A-Fa-f]{80}")
#: Signature bytes of the signed-token algorithms with a fixed length (fixed values of RFC 7518).
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER items that fill ``data`` exactly; None if a length does not hold."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at:at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        items.append((tag, data[at:at + n]))
        at += n
    return items


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA private key by its nested items."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags[0] == 0x02 and len(items[0][1]) == 1:
        version = items[0][1][0]
        if tags[1:3] == [0x30, 0x04] and version <= 1:
            algorithm = der_items(items[1][1])
            return bool(algorithm) and algorithm[0][0] == 0x06
        if tags[1:2] == [0x04] and version == 1:
            return len(items[1][1]) >= 16
        return set(tags) == {0x02} and len(tags) in (6, 9) and max(len(c) for _, c in items) >= 16
    if tags == [0x30, 0x04]:
        algorithm = der_items(items[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(items[1][1]) >= 16
    return False


def is_openssh_key(data: bytes) -> bool:
    """OpenSSH private key container by its length-prefixed fields."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at:at + 4], "big")
        at += 4 + n
        return data[at - n:at] if at <= len(data) else None

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1))


def decode64(text: str) -> bytes | None:
    """Standard or url-safe base64 with or without padding; None if it is not base64."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _json_object(segment: str) -> dict | None:
    data = decode64(segment)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """Header with an algorithm, payload an object, signature of a fitting length."""
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    sign, alg = decode64(signature), head["alg"]
    if sign is None:
        return False
    if alg == "none":
        return not sign
    if alg in SIGNATURE_BYTES:
        return len(sign) == SIGNATURE_BYTES[alg]
    return alg[:2] in ("RS", "PS") and len(sign) >= 128 and len(sign) % 8 == 0


def is_private_pem(body: str) -> bool:
    """Body of a PEM block: encrypted by its own header lines, or a key of a known structure."""
    body = body.replace("\\r", "\n").replace("\\n", "\n")  # escaped line ends, as in JSON
    lines = [x.strip(" \t\"'+,") if ":" not in x else x.strip() for x in body.strip().splitlines()]
    headed = [x for x in lines if ":" in x]
    data = decode64("".join(x for x in lines if ":" not in x))
    if not data:
        return False
    if any(x.startswith("DEK-Info:") for x in headed):
        return len(data) % 8 == 0
    return is_der_private_key(data) or is_openssh_key(data)


def _structures(data: bytes | None) -> list[str]:
    """Kinds of the key or token that decoded bytes hold from end to end."""
    if not data:
        return []
    found = [kind for kind, test in (("der", is_der_private_key), ("openssh", is_openssh_key)) if test(data)]
    if data.startswith(b"eyJ") and data.isascii() and (m := _TOKEN.fullmatch(data.decode())) and is_signed_token(*m.groups()):
        found.append("token")
    return found


def _wrapped(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 over several lines of one length, the last of which may be shorter; quotes and indentation between lines are skipped."""
    found = []
    for m in _FIRST_LINE.finditer(text):
        lines, ends = [m[0]], [m.end()]
        while (n := _NEXT_LINE.match(text, ends[-1])) and len(n[1]) <= len(m[0]):
            lines.append(n[1])
            ends.append(n.end())
            if len(n[1]) < len(m[0]):
                break
        for k in {len(lines), len(lines) - 1} - {0, 1}:  # the shorter line may be no part of it
            found += [(m.start(), ends[k - 1], kind) for kind in _structures(decode64("".join(lines[:k])))]
    return found


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of one text, by start and then by the order of ``KINDS``."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    found += [(*m.span(), "pem") for m in _PEM.finditer(text) if is_private_pem(m[2])]
    for m in _BASE64.finditer(text):
        found += [(*m.span(), kind) for kind in _structures(decode64(m[0]))]
    found += _wrapped(text)
    for m in _HEX.finditer(text):
        found += [(*m.span(), kind) for kind in _structures(bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else None)]
    found += [(*m.span(), "token") for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by a marker."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], "<secret>"]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the number of base spans by kind, a digest of the base spans, and all spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([rows.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
                        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            text = batch.column(1)
            n = len(text)
            counts = {k: [0] * n for k in BASE_KINDS}
            digest, spans = [nothing] * n, [""] * n
            hit = pc.fill_null(pc.match_substring_regex(text, _ANY), False)
            for i in pc.indices_nonzero(hit).to_pylist():
                found = find_secrets(text[i].as_py())
                base = [s for s in found if s[2] in BASE_KINDS]
                for s in base:
                    counts[s[2]][i] += 1
                digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in BASE_KINDS], pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                names=[f.name for f in out])

    return rows.mapInArrow(run, out)


def redacted(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of its texts replaced by ``<secret>``; the length column, where there is one, is set anew."""
    schema = docs.schema

    def make():
        def clean(texts: pa.Array) -> pa.Array:
            hit = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False)).to_pylist()
            if not hit:
                return texts
            mask = pc.is_in(pa.array(range(len(texts)), pa.int64()), value_set=pa.array(hit, pa.int64()))
            return pc.replace_with_mask(texts, mask, pa.array([redact(t, find_secrets(t)) for i in hit for t in [texts[i].as_py()]], texts.type))

        return clean

    out = docs.withColumn(text_col, text_udf(make, "string")(F.col(text_col).cast("string")))
    if chars_col and chars_col in docs.columns:
        changed = F.char_length(text_col)
        out = out.withColumn(chars_col, F.when(F.col(chars_col).isNull(), F.col(chars_col)).otherwise(changed).cast(schema[chars_col].dataType))
    return out
