"""Secret scans: fixed patterns, and novelty under a dictionary-primed compressor.

A candidate string in a sensitive context is compressed after the text around it, with a
dictionary of code and identifiers in front; the bytes that it adds are its novelty. Other
copies of the string, and long pieces of it, are blanked out of the text around first: a
secret is no less one for being written twice. Strings that add nearly their whole length cannot be names or words that code already holds, and are
reported as kind "novel". Spans are code points, end exclusive.

Null text counts as empty text: no spans. Every row gives one row, repeated rows too, and an empty
table none; other columns are not read. The time taken is linear in a text's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT_WORDS = ("secret", "token", "passw", "pwd", "credential", "auth", "bearer", "private", "apikey", "api_key", "api-key", "access_key", "access key", "signing")
_CONTEXT = re.compile("|".join(_CONTEXT_WORDS), re.I | re.A)
#: A long unbroken string that mixes digits with letters.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}")
_PLAIN = (
    "import from return function class public private static const let var def self this null None true false string int float "
    "configuration environment development production application database connection username hostname endpoint client server "
    "request response handler manager controller service repository module package version default example placeholder "
    "changeme your_api_key_here your-secret-here access_token refresh_token client_secret client_id authorization bearer "
    "content_type application_json user_agent session_id created_at updated_at primary_key foreign_key public_key private_key "
    "get_user_by_id set_password_hash is_authenticated token_type expires_in max_length min_length buffer_size timeout_seconds "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 12345678 xxxxxxxxxxxxxxxx aaaaaaaaaaaaaaaa "
    "https://www.example.com/path/index.html http://localhost:8080/api/v1 2020-01-01T00:00:00Z utf-8 sha256 base64 "
)


@dataclass(frozen=True)
class Novelty:
    """before: characters of context looked at; share: least added bytes for each character;
    kinds: least number of different characters; piece: length from which on a part of the
    candidate is blanked out of the context."""

    before: int = 64
    share: float = 0.70
    kinds: int = 10
    piece: int = 12
    level: int = 3


_made: dict[int, zstandard.ZstdCompressor] = {}


def _compressor(level: int) -> zstandard.ZstdCompressor:
    if level not in _made:
        words = zstandard.ZstdCompressionDict(_PLAIN.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _made[level] = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)
    return _made[level]


def novelty(context: str, candidate: str, level: int = 3) -> float:
    """Bytes that candidate adds to the compressed context, for each of its characters."""
    z = _compressor(level)
    before = context.encode()
    return (len(z.compress(before + candidate.encode())) - len(z.compress(before))) / len(candidate)


def _without(text: str, start: int, end: int, pieces: set[str], size: int) -> str:
    """text[start:end] with blanks for all that belongs to one of pieces (of size characters), also where the cut goes through it."""
    out, at = [], start
    for k in range(max(0, start - size + 1), min(end, len(text) - size + 1)):
        if text[k : k + size] in pieces:
            if k > at:
                out += [text[at:k], " "]
            at = max(at, k + size)
    return "".join(out) + text[at:end]


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _overlaps(spans: list[list[int]], a: int, b: int) -> bool:
    """spans are apart from each other, and in order."""
    k = bisect_left(spans, [b])
    return k > 0 and spans[k - 1][1] > a


def scan(text: str, rules: Novelty = Novelty()) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each by start and then kind."""
    low = text.lower()
    base = sorted(base_spans(text, low), key=lambda s: (s[1], KINDS.index(s[0])))
    added, taken = [], []
    for _, x, y in base:  # overlapping spans as one
        if taken and x <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], y)
        else:
            taken.append([x, y])
    if any(w in low for w in _CONTEXT_WORDS):
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            context = text[max(0, a - rules.before) : a]
            if len(set(m[0])) < rules.kinds or not _CONTEXT.search(context) or _overlaps(taken, a, b):
                continue
            size = rules.piece
            pieces = {m[0][k : k + size] for k in range(len(m[0]) - size + 1)}
            # The candidate itself is on neither side, so that no piece of it is met in its own place.
            left, right = text[max(0, a - rules.before - size) : a], text[b : b + rules.before + size]
            around = _without(left, max(0, len(left) - rules.before), len(left), pieces, size) + _without(right, 0, rules.before, pieces, size)
            if novelty(around, m[0], rules.level) >= rules.share:
                added.append(("novel", a, b))
    return base, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, rules: Novelty = Novelty()) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) for every row of docs(doc_id, text)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [scan(t or "", rules) for t in batch.column(1).to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b[k]] for b in both], pa.list_(span)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        common.lean(run), "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"
    )


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, rules: Novelty = Novelty()) -> DataFrame:
    """docs with the secrets in text replaced and n_chars counted anew. All rows stay, repeated ones
    each on their own; null text stays null, an empty table empty. Columns are as in docs, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = (batch.schema.get_field_index(c) for c in ("text", "n_chars"))
            texts = [t if t is None else redact(t, sum(scan(t, rules), [])) for t in batch.column(k).to_pylist()]
            cols = list(batch.columns)
            cols[k] = pa.array(texts, batch.schema.field(k).type)
            if n >= 0:
                cols[n] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return common.over(docs, run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    order = F.array(*(F.lit(k) for k in KINDS))
    every = F.transform(
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end")))),
        lambda s: F.struct(F.get(order, (s["k"] - 1).cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"))
