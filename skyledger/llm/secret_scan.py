"""Secret scan: fixed patterns plus a token-efficiency test.

Fixed patterns find assignments, access keys and long hex runs.  The token-efficiency test
then looks at every other word of 16 characters or more, letters alone included: text that a byte-pair
vocabulary was trained on costs few tokens a character, a random string costs many.  A word with
few characters per token is reported as ``random`` unless it is a known digest, a UUID or an
identifier (which takes in every word of small letters alone, so a random string of them is missed).

Defined cases: a null or empty text has no spans and the hash of the empty string; repeated
rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import docs_only, map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run under 16 fails whole, so the bound may stand in the pattern
KINDS = ("assign", "access", "hex", "random")

#: A word that may be a random string: long, with a letter (checked in code).
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Words of letters, each with at most four digits behind it: snake_case, camelCase2, paths.
IDENTIFIER = re.compile(r"[_/+=-]*(?:(?:[A-Z]?[a-z]{3,}|[A-Z]{3,})[0-9]{0,4}[_/+=-]*)+\Z|[0-9_/+=-]+\Z")

_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tiktoken encoding of a ``.tiktoken`` file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(word: str) -> bool:
    """A digest, a UUID or an identifier."""
    return bool(DIGEST.match(word) and len(word) in DIGEST_LENGTHS or UUID.match(word) or IDENTIFIER.match(word))


def random_spans(text: str, taken: list[tuple[int, int, int]], encode, most: float) -> list[tuple[int, int, int]]:
    """Words that cost a token for every ``most`` characters or fewer, outside ``taken``."""
    found = []
    for m in WORD.finditer(text):
        word = m.group()
        if not any(c.isalpha() for c in word) or known(word):
            continue
        if any(start < m.end() and m.start() < end for start, _, end in taken):
            continue
        if len(word) <= most * len(encode(word)):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, *, vocabulary: str = VOCABULARY, chars_per_token: float = 2.2) -> DataFrame:
    """Every document's secrets.

    Returns ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``.  Spans are
    ``kind:start:end`` in code points, end exclusive, ordered by start and then kind.
    ``vocabulary`` is a ``.tiktoken`` file found at that path on every executor.
    """

    def make():
        encode = encoder(vocabulary).encode_ordinary

        def one(doc_id, text):
            base = base_spans(text)
            more = random_spans(text, base, encode, chars_per_token)
            count = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            return (doc_id, *count, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))

        return one

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return map_rows(docs_only(docs, "doc_id", "text"), make, schema)
