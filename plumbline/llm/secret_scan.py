"""Secret scans with structural confirmation.

Pattern findings (kinds assign, access, hex) are reported as matched. Beyond them, candidates in
base64 or hex are reported only if what they decode to has the structure of key material:

jwt   a signed-token header: base64url of a JSON object with a text member "alg", then payload and
      signature segments that decode too
der   ASN.1 DER, bare in base64 or hex or inside PEM armour: a SEQUENCE whose nested lengths add
      up to the whole, with the INTEGER or OBJECT IDENTIFIER first that key encodings have
ssh   the OpenSSH private key container or an SSH public key: length-prefixed fields that fill the
      blob and name a key algorithm

Base64 may be of either alphabet, padded or not, on one line or wrapped, with a name glued to it by
``_`` or ``-``; hex may have ``0x`` before it or colons or blanks between bytes; PEM may have header
lines, and an encrypted body is confirmed by its cipher line and whole cipher blocks.

Positions are code points, end exclusive. Defined cases: null text is the empty text; repeated
rows keep their rows; very long texts are scanned whole; spans are ordered by start, then kind in
the order of ``KINDS``; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
# The patterns of the contract
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}(?:KEY|CERTIFICATE|PARAMETERS))-----")
PEM_HEADER = re.compile(r"[ \t]*[A-Za-z][A-Za-z0-9-]*:.*")
CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})[ \t]*$", re.MULTILINE)
NEW_LINE = re.compile(r"\r?\n|\\r\\n|\\n")
#: Base64 of either alphabet, on one line or wrapped (shorter lines then do): before the text of a line that
#: follows there may be white space and marks of quotation.
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:(?:\r?\n|\\r\\n|\\n)[ \t>]*[A-Za-z0-9+/_-]+)*|[A-Za-z0-9+/_-]{20,}(?:(?:\r?\n|\\r\\n|\\n)[ \t>]*[A-Za-z0-9+/_-]{20,})+(?:(?:\r?\n|\\r\\n|\\n)[ \t>]*[A-Za-z0-9+/_-]+)?")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{20,}(?:(?:\r?\n|\\n)[ \t>]*[0-9A-Fa-f]{2,})+|[0-9A-Fa-f]{48,}|[0-9A-Fa-f]{2}(?:[: ][0-9A-Fa-f]{2}){23,})(?![0-9A-Fa-f:])")
NOT_HEX = re.compile(r"[^0-9A-Fa-f]+")
URL_SAFE = str.maketrans("-_", "+/")
#: Fields of an SSH public key at most; a certificate has fewer.
SSH_FIELDS = 24
#: Which texts can hold any candidate at all; most can't, and are left after one search.
NAME = re.compile(r"pass|secret|token|key", re.IGNORECASE | re.ASCII)


# ------------------------------------------------------------------ structure
def der_length(blob: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the content starts) of the DER element whose length field is at ``at``."""
    if at >= len(blob):
        return None
    first = blob[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(blob):
        return None
    size = int.from_bytes(blob[at + 1 : at + 1 + n], "big")
    if size < 0x80 or blob[at + 1] == 0:  # DER: shortest form only
        return None
    return size, at + 1 + n


def der_elements(blob: bytes, start: int, end: int) -> list[int] | None:
    """Tags of the elements that fill [start, end) exactly, nested ones checked however deep; None if
    they don't."""
    tags, ends, at = [], [end], start
    while ends:
        if at == ends[-1]:
            ends.pop()
            continue
        got = der_length(blob, at + 1)
        if got is None or got[1] + got[0] > ends[-1]:
            return None
        if len(ends) == 1:
            tags.append(blob[at])
        if blob[at] & 0x20:  # constructed: its content are elements
            at = got[1]
            ends.append(got[1] + got[0])
        else:
            at = got[1] + got[0]
    return tags


def is_der_key(blob: bytes) -> bool:
    """A key encoding: SEQUENCE over the whole blob that starts as PKCS#1, PKCS#8, SEC1 or SPKI do."""
    if len(blob) < 24 or blob[0] != 0x30:
        return False
    got = der_length(blob, 1)
    if got is None or got[1] + got[0] != len(blob):
        return False
    tags = der_elements(blob, got[1], len(blob))
    if not tags or len(tags) < 2:
        return False
    # INTEGER INTEGER ... (PKCS#1, DSA), INTEGER SEQUENCE ... (PKCS#8, PKCS#12),
    # INTEGER OCTET STRING (SEC1), SEQUENCE BIT STRING (public key), SEQUENCE OCTET STRING (encrypted)
    return tags[:2] in ([2, 2], [2, 0x30], [2, 4], [0x30, 3], [0x30, 4], [0x30, 0x30])


def is_ssh_key(blob: bytes) -> bool:
    """Length-prefixed fields that fill the blob: an SSH public key, or the container of private keys
    (cipher, derivation and its options, how many keys, their public parts, the private part)."""
    at, fields, most = 0, [], SSH_FIELDS
    if bytes(blob[:15]) == b"openssh-key-v1\0":
        at, most = 15, 3
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "big")
        if len(fields) == 3 and most == 3:
            at, most = at + 4, size + 4
            continue
        if at + 4 > len(blob) or at + 4 + size > len(blob) or len(fields) == most:
            return False
        fields.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    if most != SSH_FIELDS:
        return len(fields) == most > 4
    return len(fields) >= 2 and re.fullmatch(rb"(ssh-|ecdsa-|sk-)[a-z0-9@.-]{2,60}", fields[0]) is not None


def is_ssh_start(head: bytes) -> bool:
    """Whether twelve bytes can begin an SSH public key: the length of a name, and the name's start."""
    return head[:3] == bytes(3) and 5 <= head[3] <= 66 and head[4:].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding."""
    text = text.rstrip("=").translate(URL_SAFE)
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(segment: str) -> bool:
    raw = unbase64(segment)
    try:
        head = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def key_kind(blob: bytes | None) -> int | None:
    """The index in KINDS of the key encoding that fills the blob."""
    return None if not blob else 4 if is_der_key(blob) else 5 if is_ssh_key(blob) else None


def armoured(text: str) -> Iterator[tuple[int, int, int]]:
    """Keys in PEM armour; an encrypted one is confirmed by its cipher line and whole blocks."""
    gone: set[str] = set()  # labels that end nowhere further on
    at = 0
    while m := PEM.search(text, at):
        at = m.end()
        stop = -1 if m[1] in gone else text.find(f"-----END {m[1]}-----", at)
        if stop < 0:
            gone.add(m[1])
            continue
        lines = NEW_LINE.split(text[at:stop])
        headers = [x for x in lines if PEM_HEADER.fullmatch(x)]
        body = unbase64("".join("".join(x.split()) for x in lines if not PEM_HEADER.fullmatch(x)))
        cipher = CIPHER.search("\n".join(headers))
        kind = 4 if cipher and body and len(body) % (len(cipher[1]) // 2) == 0 else key_kind(body)
        if kind:
            at = stop + len(m[1]) + 14
            yield m.start(), kind, at


def in_base64(text: str, m: re.Match) -> tuple[int, int, int] | None:
    """The key in a run of base64 lines. DER says how long it is; a key ends where a line does."""
    parts, at = [], m.start()
    for sep in NEW_LINE.finditer(text, m.start(), m.end()):
        parts.append((at, sep.start()))
        at = sep.end()
        while text[at] in " \t>":
            at += 1
    parts.append((at, m.end()))
    joined_ = "".join(text[s:e] for s, e in parts).translate(URL_SAFE)
    ends, n = [], 0  # where lines end, in the joined text
    for s, e in parts:
        n += e - s
        ends.append(n)
    bytes_: dict[int, bytes] = {}  # the run is decoded once for each of the four ways to align it

    def blob(start: int, end: int) -> memoryview:
        if start % 4 not in bytes_:
            own = joined_[start % 4 :]
            bytes_[start % 4] = base64.b64decode(own[: len(own) // 4 * 4] + (own[len(own) // 4 * 4 :].ljust(4, "A") if len(own) % 4 else ""))
        at = start // 4 * 3
        return memoryview(bytes_[start % 4])[at : at + (end - start) * 6 // 8]

    first = parts[0][1] - parts[0][0]
    glued = [i + 1 for i, c in enumerate(text[slice(*parts[0])]) if c in "_-"]  # a name can stand before the key
    for skip in (0, *glued):
        if len(joined_) - skip < 32 or first - skip < 16:
            break
        head = bytes(blob(skip, skip + 16))
        if head[0] == 0x30:  # DER says how long it is, and where the key ends a line does
            need = der_length(head, 1)
            if need is None or (end := skip - (-(need[0] + need[1]) * 8 // 6)) > len(joined_):
                continue
            at = bisect_left(ends, end)
            some = [at] if at < len(ends) and ends[at] == end else []
        elif head.startswith(b"openssh-key") or is_ssh_start(head):
            some = list(dict.fromkeys((*range(len(ends))[-2:], 0)))
        else:
            continue
        for i in some:
            if (ends[i] - skip) % 4 == 1 or ends[i] <= skip:
                continue
            kind = key_kind(blob(skip, ends[i]))
            if kind:
                end = parts[i][1]
                while end < parts[i][1] + 2 and text[end : end + 1] == "=":
                    end += 1
                return parts[0][0] + skip, kind, end
    return None


def confirmed(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of what the structure confirms."""
    out = []
    if "." in text:
        for m in JWT.finditer(text):
            if is_token_header(m[1]) and unbase64(m[2]) is not None and unbase64(m[3]) is not None:
                out.append((m.start(), 3, m.end()))
    in_armour = list(armoured(text)) if "-----BEGIN " in text else []
    out += in_armour
    for m in RUN.finditer(text):
        if not any(s <= m.start() < e for s, _, e in in_armour) and (found := in_base64(text, m)):
            out.append(found)
    for m in LONG_HEX.finditer(text):
        digits = NOT_HEX.sub("", NEW_LINE.sub("", m[0]))
        if len(digits) % 2 == 0 and (kind := key_kind(bytes.fromhex(digits))):
            out.append((m.start(), kind, m.end()))
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """All spans as (start, index in KINDS, end), sorted."""
    spans = []
    if NAME.search(text):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans + confirmed(text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` with ``out_col``: array of (kind, start, end)."""
    common.bound_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c != out_col]
    schema = docs.select(*cols).schema.add(out_col, SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in common.slices(batches):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t or "")] for t in b.column(cols.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*cols, out_col])

    return docs.select(*cols).mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans count as one."""
    common.bound_batches(docs.sparkSession)
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cols.index(text_col)
        for b in common.slices(batches):
            out = []
            for t in b.column(at).to_pylist():
                parts, done = [], 0
                for s, _, e in find(t) if t else []:
                    if s >= done:
                        parts += [t[done:s], mark]
                    done = max(done, e)
                out.append("".join([*parts, t[done:]]) if parts else t)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, b.column(at).type), *b.columns[at + 1 :]], names=cols)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``: a row for each row of ``docs``."""
    rows = scan(docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s.kind.isin(*KINDS[:3]))
    line = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("bigint")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
