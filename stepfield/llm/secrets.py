"""Secret scans: fixed patterns and the token-efficiency test.

Strings that a byte-pair vocabulary cannot compress are random: a run of key characters, a part of it between separators, or a
window of it, whose characters per token fall below `ratio` is exposed, after known digests and identifiers are excluded (hexadecimal digests by their length, UUIDs,
plain numbers, words, and names made of words). Patterns that an Arrow batch's texts do not match at all, by a linear-time
scan, are not tried text by text. Places are code points, ends exclusive; kinds are listed in KINDS order.

Defined cases: null text is empty; texts of any length are scanned whole; repeated rows are scanned alike; a null doc_id stays
null; an empty table gives no rows; further columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame

from stepfield.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Runs that the token-efficiency test looks at, and the characters per token below which a run is random.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RATIO = 2.0
#: Least characters of a random place.
LEAST = 16
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z0-9]+")
_KNOWN_PART = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{DIGEST.pattern})(?![A-Za-z0-9])", re.IGNORECASE)
#: Names: words and numbers joined by separators, or camel case of whole words. Neither pattern can match in two ways.
_SEPARATORS = re.compile(r"[/_=+-]+")
_WORD = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*[0-9]*")
_SCANS = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA", "[0-9a-f]{16}", "[A-Za-z0-9+/_=-]{16}")


@cache
def _vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_name(run: str) -> bool:
    return bool(_CAMEL.fullmatch(run)) or all(map(_WORD.fullmatch, _SEPARATORS.split(run)))


def is_known(run: str) -> bool:
    """Digests, UUIDs, numbers and identifiers, which are no secrets."""
    return bool(DIGEST.fullmatch(run) or UUID.fullmatch(run) or is_name(run))


def _lengths(run: str, encoding: tiktoken.Encoding) -> list[int]:
    """The lengths of the run's tokens; runs are ASCII."""
    return [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(run)]


def _touches(places: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the places, which are in order and apart, overlaps [a, b)."""
    k = bisect_left(places, (b, 0)) - 1
    return k >= 0 and places[k][1] > a


def _windows(run: str, encoding: tiktoken.Encoding, ratio: float, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of whole tokens, of LEAST to 3 LEAST characters, below the ratio and clear of digests and UUIDs. A longer stretch
    below it can be cut into such ones, one of which is below it too."""
    starts, out = [0, *accumulate(_lengths(run, encoding))], []
    for i, a in enumerate(starts[:-1]):
        for j in range(i + 1, len(starts)):
            b = starts[j]
            if b - a > 3 * LEAST:
                break
            if LEAST <= b - a < ratio * (j - i) and not _touches(known, a, b):
                out.append((a, b))
    return out


def exposed(run: str, encoding: tiktoken.Encoding, ratio: float) -> list[tuple[int, int]]:
    """Places of a run that are random: all of it, or its parts between separators, or parts in which a window is random; words at
    the edges of the latter are left out. Time grows with the run's length, times a constant."""
    if is_known(run):
        return []
    known = [m.span() for m in _KNOWN_PART.finditer(run)]
    low = lambda a, b: b - a < ratio * len(_lengths(run[a:b], encoding))
    if not known and low(0, len(run)):
        return [(0, len(run))]
    parts = [m.span() for m in _PART.finditer(run)]
    found = [(a, b) for a, b in parts if b - a >= LEAST and not is_known(run[a:b]) and low(a, b)]
    windows = [(a, b) for a, b in _windows(run, encoding, ratio, known) if not _touches(found, a, b)]
    ends = list(accumulate((b for _, b in reversed(windows)), min))[::-1]  # the least end of this window and the later ones
    merged: list[list[int]] = []
    for a, b in windows:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    more = []
    for a, b in merged:
        first, last = bisect_right(parts, a, key=lambda p: p[1]), bisect_left(parts, b, key=lambda p: p[0]) - 1
        edge = lambda p: is_known(run[p[0] : p[1]]) and not low(*p)
        while first <= last and edge(parts[first]):
            first += 1
        while last >= first and edge(parts[last]):
            last -= 1
        if first <= last:
            x, y = parts[first][0], parts[last][1]
            k = bisect_left(windows, (x, 0))
            if y - x >= LEAST and not is_known(run[x:y]) and k < len(windows) and ends[k] <= y and not _touches(found, x, y) and not (more and more[-1][1] > x):
                more.append((x, y))
    return sorted(found + more)


def spans(text: str, encoding: tiktoken.Encoding, ratio: float = RATIO, tries: tuple[bool, ...] = (True,) * 4) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; `tries` tells which kinds can occur."""
    found = []
    if tries[0]:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if tries[1]:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if tries[2]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if tries[3]:
        found.sort()
        reach = list(accumulate((b for _, _, b in found), max))
        random = []
        for m in RUN.finditer(text):
            k = bisect_right(found, m.start(), key=lambda s: s[0]) - 1
            if k < 0 or reach[k] < m.end():
                random += [(m.start() + a, 3, m.start() + b) for a, b in exposed(m[0], encoding, ratio)]
        found += random
    return sorted(found)


def _batch_spans(column: pa.Array, encoding, ratio: float) -> list[tuple[str, list[tuple[int, int, int]]]]:
    texts = pc.fill_null(column, "")
    tries = zip(*(pc.match_substring_regex(texts, p).to_pylist() for p in _SCANS), strict=True)
    return [(t, spans(t, encoding, ratio, flags) if any(flags) else []) for t, flags in zip(texts.to_pylist(), tries, strict=True)]


def scan(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans array<struct<start,kind,end>> in order of start and kind. No shuffle."""
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        encoding = _vocabulary(vocabulary, pattern)
        for b in batches:
            out = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in got] for _, got in _batch_spans(b.column(1), encoding, ratio)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start:bigint,kind:string,end:bigint>>")


def redact(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO, mark: str = "[secret]") -> DataFrame:
    """docs with every span of their texts replaced by the mark, overlapping ones by one. Rows and other columns stay."""
    bounded_batches(docs.sparkSession)
    column = docs.columns.index("text")

    def clean(text: str, found: list) -> str:
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches):
        encoding = _vocabulary(vocabulary, pattern)
        for b in batches:
            valid = b.column(column).is_valid().to_pylist()
            new = [clean(t, got) if ok else None for ok, (t, got) in zip(valid, _batch_spans(b.column(column), encoding, ratio), strict=True)]
            yield b.set_column(column, b.schema.field(column), pa.array(new, b.schema.field(column).type))

    return docs.mapInArrow(run, docs.schema)
