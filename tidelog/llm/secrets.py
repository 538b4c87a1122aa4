"""Secret scans: fixed patterns, and a token-efficiency test for the rest.

A string that a tokenizer's vocabulary has never met costs it about one token for one or two characters, a
word or an identifier much less. Candidates are runs of at least `min_chars` characters of the usual
alphabets of keys that mix two of lower-case letters, upper-case letters and digits; those of known digest
lengths in hex, UUIDs, numbers, and names of words in one case or capitalised are excluded; the others are
reported when they have fewer than `max_ratio` characters a token, which camel-case names have not. What a
fixed pattern has found already isn't reported twice.

Python, because the vocabulary's merges are: rows pass one batch at a time and nothing is gathered.

Defined cases: a null or empty text has no spans ('' and the digest of ''); a very long text is searched
whole; of spans that start at one place (ties) the kinds' order decides; repeated rows are answered alike; a
null doc_id passes through; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the vocabulary file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CLASSES = [re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]")]
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hex digits of the usual digests (fixed values): MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_/-](?:[A-Z]?[a-z]+|[A-Z]+))*[_-]?[0-9]{0,4}|[0-9/_-]+")


def encoding(vocabulary: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns' matches, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def excluded(s: str) -> bool:
    bare = s.strip("=_-/+")
    return bool((len(bare) in DIGEST_CHARS and DIGEST.fullmatch(bare)) or UUID.fullmatch(bare) or IDENTIFIER.fullmatch(bare))


def random_spans(text: str, count, max_ratio: float, min_chars: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if len(s) < min_chars or sum(c.search(s) is not None for c in CLASSES) < 2 or excluded(s) or any(a < m.end() and m.start() < b for a, _, b in taken):
            continue
        if len(s) < max_ratio * count(s):
            out.append((m.start(), 3, m.end()))
    return out


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = 2.0, min_chars: int = 16) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(vocabulary)
        count = lambda s: len(enc.encode_ordinary(s))
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        for batch in batches:
            n: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    n[k].append(sum(kind == k for _, kind, _ in base))
                digests.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(sorted(base + random_spans(text, count, max_ratio, min_chars, base))))
            cols = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
