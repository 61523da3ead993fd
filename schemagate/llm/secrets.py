"""Secret scans: named patterns, and strings that a public vocabulary can only write with very many tokens."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemagate.llm.common import slices

#: Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

#: Strings that are tested for token efficiency. They count as random from the tokens that random text of their own
#: alphabet and length has, less SLACK standard deviations, and in any case below so many characters per token: those
#: that mix letters and digits, and others.
SHORTEST = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Where runs are split, and the characters per token from which a part of letters is a word.
MARKS, READABLE = "=/_-", 2.5
SLACK, FEW_MIXED, FEW_PLAIN = 2.0, 1.8, 1.5
LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: From the narrowest; text of digits alone or with marks between has no alphabet.
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, LOWER + UPPER, LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER + DIGITS)
SAMPLES, SAMPLE_LENGTH = 300, 64
#: Lengths in hex digits of usual digests, and shapes of usual identifiers, which are not secrets.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
IDENTIFIERS = r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]+|(.)\2*|[a-z]+([-_/][a-z]+)+|[A-Z]+([-_/][A-Z]+)+"

_assign, _access, _hex = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(ACCESS), re.compile(r"[0-9a-f]{32,}")
_part, _uuid = re.compile(f"[^{MARKS}]+"), re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
_candidate, _identifier, _digest = re.compile(CANDIDATE), re.compile(IDENTIFIERS), re.compile(r"[0-9a-f]+|[0-9A-F]+")


def vocabulary(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds; matches are taken leftmost and whole, then the short ones fall out."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return sorted(found + [(m.start(), 2, m.end()) for m in _hex.finditer(text)])  # a run of 32 is the whole run


@lru_cache(maxsize=1)
def random_tokens(encoding) -> list[tuple[frozenset, float, float]]:
    """Mean and variance of the tokens a character of random text has, for each alphabet; the samples are fixed."""
    draw, out = random.Random(0), []
    for alphabet in ALPHABETS:
        n = [len(encoding.encode_ordinary("".join(draw.choices(alphabet, k=SAMPLE_LENGTH)))) / SAMPLE_LENGTH for _ in range(SAMPLES)]
        mean = sum(n) / SAMPLES
        out.append((frozenset(alphabet), mean, sum((x - mean) ** 2 for x in n) / (SAMPLES - 1) * SAMPLE_LENGTH))
    return out


def looks_random(s: str, encoding) -> bool:
    """Whether a string has as many tokens as random text; digests and identifiers never count."""
    if len(s) in DIGEST_LENGTHS and _digest.fullmatch(s) or _identifier.fullmatch(s):
        return False
    n, used = len(encoding.encode_ordinary(s)), frozenset(s)
    letters = not used.isdisjoint(LOWER + UPPER)
    if len(s) < (FEW_MIXED if letters and not used.isdisjoint(DIGITS) else FEW_PLAIN) * n:
        return True
    level = next(((m, v) for a, m, v in random_tokens(encoding) if used <= a), None) if letters else None
    return level is not None and n >= level[0] * len(s) - SLACK * math.sqrt(level[1] * len(s))


def random_ranges(s: str, encoding) -> list[tuple[int, int]]:
    """Ranges of a run of candidate characters that look random.

    The whole run, else its stretches between readable parts, else the parts of such a stretch: a name or path before a
    random string would hide it. Identifiers by UUID are cut out first.
    """
    known = [m.span() for m in _uuid.finditer(s)]
    if not known and looks_random(s, encoding):
        return [(0, len(s))]
    within = {m.start() for a, b in known for m in _part.finditer(s, a, b)}
    out, at = [], 0
    parts = [(*m.span(), m.start() in within or _readable(m[0], encoding)) for m in _part.finditer(s)]
    while at < len(parts):
        end = at
        while end < len(parts) and not parts[end][2]:
            end += 1
        a, b = parts[at][0], parts[max(at, end - 1)][1]
        if end > at + 1 and b - a >= SHORTEST and looks_random(s[a:b], encoding):
            out.append((a, b))
        else:
            out += [(x, y) for x, y, _ in parts[at : max(end, at + 1)] if y - x >= SHORTEST and looks_random(s[x:y], encoding)]
        at = max(end, at + 1)
    return out


def _readable(part: str, encoding) -> bool:
    """A part of letters alone that few tokens write; all other parts may belong to a random string."""
    return len(part) > 2 and part.isalpha() and len(part) >= READABLE * len(encoding.encode_ordinary(part))


def random_spans(text: str, encoding, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of few characters per token outside the spans already taken, digests and identifiers left out.

    Of a random string that touches such spans, what goes on without a mark between counts whatever its length;
    the rest of a run is judged for itself.
    """
    found, cuts, k = [], [], 0
    for m in _candidate.finditer(text):  # both are in order; of each base kind at most one span goes on past a run
        at, stop = m.span()
        while k < len(taken) and taken[k][0] < stop:
            cuts.append((taken[k][0], taken[k][2]))
            k += 1
        cuts = [c for c in cuts if c[1] > at]
        ranges = [(at + a, at + b) for a, b in random_ranges(m[0], encoding)]
        if not cuts:
            found += [(a, 3, b) for a, b in ranges]
            continue
        starts, ends = {b for _, b in cuts}, {a for a, _ in cuts}
        # a longer random string goes on over the edge of the span
        over = [
            (a, b) for a, b in _without(ranges, cuts)
            if a in starts and text[a] not in MARKS or b in ends and text[b - 1] not in MARKS
        ]
        for a, b in _without([(at, stop)], cuts):
            over += [(a + x, a + y) for x, y in random_ranges(text[a:b], encoding)] if b - a >= SHORTEST else []
        found += [(a, 3, b) for a, b in _merged(over)]
    return found


def _without(ranges: list[tuple[int, int]], cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges less the cuts; both are in order."""
    out, k = [], 0
    cuts = _merged(cuts)
    for a, b in ranges:
        while k < len(cuts) and cuts[k][1] <= a:
            k += 1
        for c, d in cuts[k:]:
            if c >= b:
                break
            if a < c:
                out.append((a, c))
            a = max(a, d)
        if a < b:
            out.append((a, b))
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(documents: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row of (doc_id, text).

    Offsets are code points, end exclusive. Null text: as empty. Rows are independent: repeated ones give repeated
    results, a null doc_id stays null, any length of text is scanned whole. Other columns are not read.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path, pattern)
        for batch in slices(batches, 1000):
            base = [base_spans(t.as_py() or "") for t in batch["text"]]
            every = [sorted(b + random_spans(t.as_py() or "", encoding, b)) for b, t in zip(base, batch["text"], strict=True)]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in every], pa.int64()) for kind in range(4)]
            digests = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array(digests), pa.array([written(s) for s in every])], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")


def mask_secrets(documents: DataFrame, vocabulary_path: str, pattern: str, mask: str = "[SECRET]") -> DataFrame:
    """`documents` with every span masked (overlapping ones as one) and n_chars counted anew where text changed.

    No document goes. Null text stays null; all other columns stay as they are.
    """
    names = documents.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path, pattern)
        for batch in slices(batches, 1000):
            texts, lengths = [], batch["n_chars"].to_pylist() if "n_chars" in names else [None] * batch.num_rows
            for i, value in enumerate(batch["text"]):
                text = value.as_py()
                spans = base_spans(text) if text else []
                spans = sorted(spans + random_spans(text, encoding, spans)) if text else []
                out, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        out += [text[at:a], mask]
                    at = max(at, b)
                if spans:
                    text = "".join([*out, text[at:]])
                    lengths[i] = len(text)
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else pa.array(lengths, pa.int64()) if c == "n_chars" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(clean, documents.schema)
