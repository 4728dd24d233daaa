"""Secret scans: an Aho-Corasick pass over each text finds keywords; regular expressions are anchored at the hits only,
and tokens that embed a checksum are kept only if it holds."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, pick

# The kinds of the contract, in its order, with their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
# Public token formats. The last six characters of the first two are a checksum of those before.
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ORDER = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}


def checksum62(body: str) -> str:
    """CRC-32 in six digits of base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def json_header(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (ACCESS, lambda m: m.end() - m.start() >= ACCESS_LEAST),
    "github": (GITHUB, lambda m: checksum62(m[1]) == m[2]),
    "npm": (NPM, lambda m: checksum62(m[1]) == m[2]),
    "jwt": (JWT, lambda m: json_header(m[1])),
    "pem": (PEM, lambda m: True),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case, one character for each: the one letter whose lower case is longer is left as it is."""
    return text.lower() if "İ" not in text else text.replace("İ", "\x00").lower()


def scan(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind, end) of all secrets by start, then kind. Matches of a kind are leftmost and do not
    overlap, failing ones included: a hit inside the match before it is no new start."""
    out, free = [], dict.fromkeys(RULES, 0)
    for last, (kind, size) in keywords.iter(lowered(text)):
        start = last - size + 1
        if start < free[kind]:
            continue
        pattern, valid = RULES[kind]
        if m := pattern.match(text, start):
            free[kind] = m.end()
            if valid(m):
                out.append((start, ORDER.index(kind), kind, m.end()))
    out += [(m.start(), ORDER.index("hex"), "hex", m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 8 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and found, an array of
    (kind, start, end, value). Offsets are code points, the end exclusive.

    Null counts as empty, and an empty text has no secrets: counts 0, spans '' and its digest that of ''. A null doc_id
    stays null. Map-only; each text is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for ids, texts in blocks(batches, limit):
            rows = []
            for key, raw in zip(ids, texts, strict=True):
                text = raw.decode("utf-8") if raw else ""
                hits = scan(text, keywords)
                said = [f"{kind}:{start}:{end}" for start, place, kind, end in hits]
                base = ",".join(s for s, h in zip(said, hits, strict=True) if h[1] < 3)
                kinds = [h[1] for h in hits]
                found = [{"kind": kind, "start": start, "end": end, "value": text[start:end]} for start, _, kind, end in hits]
                rows.append((key, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), found))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    texts = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return texts.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint,value:string>>")
