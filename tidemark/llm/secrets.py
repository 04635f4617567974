"""Secret scan: patterns find candidates, structure confirms them.

Base spans are assignments, access keys and long hex runs. The method adds spans only for what decodes to something
with the inner shape of key material: DER whose nested lengths fill the value, PEM armour, OpenSSH key blobs and
signed tokens whose header is a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mapped, read, rows, sha256

# The base patterns and the order of their kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "ssh", "der")

WORDS = ("passw", "secret", "token", "api")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,60})-----((?:[A-Za-z0-9+/=\s]|\\+[nr])*)-----END \1-----")  # line breaks may be escaped
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")


def unbase64(text: str) -> bytes | None:
    s = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[int] | None:
    """Tags of the DER items that fill ``data`` exactly, nested ones checked as well; None if the lengths do not fit."""
    at, tags = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > len(data):
            return None
        if tag == 0x30 and (depth > 8 or der_items(data[at : at + n], depth + 1) is None):
            return None
        tags.append(tag)
        at += n
    return tags


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the value, of at least two items, led by a version INTEGER or an algorithm SEQUENCE."""
    if len(data) < 24 or data[0] != 0x30 or der_items(data) != [0x30]:
        return False
    skip = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    inner = der_items(data[skip:])
    return bool(inner) and len(inner) >= 2 and inner[0] in (0x02, 0x30)


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH private key magic, or length-prefixed fields that fill the value and begin with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data) and len(fields) < 64:
        n = int.from_bytes(data[at : at + 4], "big")
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def is_signed_token(header: str, payload: str) -> bool:
    parts = []
    for x in (header, payload):
        try:
            parts.append(json.loads(unbase64(x) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that decode to key material; PEM armour, signed tokens, then bare base64 and hex values."""
    found = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = unbase64(re.sub(r"\\+[nr]", "", m[2]))
            if body and ("KEY" in m[1] or "CERTIFICATE" in m[1]) and (is_der_key(body) or is_ssh_key(body)):
                found.append(("pem", *m.span()))
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    taken, at, end = sorted(x[1:] for x in found), 0, 0
    for m in BASE64.finditer(text):
        while at < len(taken) and taken[at][0] <= m.start():  # both go forward
            end, at = max(end, taken[at][1]), at + 1
        if m.start() < end:
            continue
        value = m[0]
        for data in (bytes.fromhex(value) if len(value) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", value) else None, unbase64(value)):
            if data and is_ssh_key(data):
                found.append(("ssh", *m.span()))
                break
            if data and is_der_key(data):
                found.append(("der", *m.span()))
                break
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, counts and spans; with ``redact`` also the text with each span replaced.

    Spans are in code points, end exclusive. A null or empty text has none (and stays as it is). Repeated rows give
    repeated rows, null ids stay null, an empty table gives no rows, other columns are not read. Texts are whole.
    """
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long" + ", text string" * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows(whole):
                out: list[list] = [[] for _ in range(7)]
                for text in batch.column(1).to_pylist():
                    base = base_spans(text or "")
                    spans = base + confirmed_spans(text or "")
                    counts = [sum(x[0] == k for x in base) for k in KINDS[:3]]
                    for column, value in zip(out, [*counts, sha256(joined(base).encode()), joined(spans), len(spans), redacted(text, spans) if redact else None], strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                arrays = [batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays[: 7 + redact], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "text"][: 7 + redact])

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, schema)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each maximal run of overlapping spans replaced by <secret>."""
    if not text or not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``, one row a document; odd rows as in ``scan``."""
    return scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with every secret replaced in its text and n_chars brought up to date; no document goes.

    Null and empty texts stay as they are, repeated rows repeat, null ids stay null, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows(whole):
                at = batch.schema.get_field_index("text")
                texts = [redacted(t, base_spans(t) + confirmed_spans(t)) if t else t for t in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    clean = mapped(docs, run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
