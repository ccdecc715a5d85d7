"""Random strings glued to words, and random letters."""

import re
import string
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfield.llm import secrets
from tests.llm.test_text_operators import encoding

LETTERS, ALL = string.ascii_letters, string.ascii_letters + string.digits


@pytest.mark.parametrize("before", ["", "authorization_header=", "production_database_connection_key=", "account/settings/notifications/verify/"])
@pytest.mark.parametrize("letters,k", [(ALL, 16), (ALL, 20), (ALL, 40), (LETTERS, 20), (LETTERS, 40)])
def test_random_strings_are_found(before, letters, k):
    rng, hits = np.random.default_rng(k), 0
    for _ in range(200):
        key = "".join(rng.choice(list(letters), k))
        text = f"see {before}{key} here"
        at = text.index(key)
        hits += any(kind == 3 and a <= at and at + k <= b for a, kind, b in secrets.spans(text, encoding()))
    assert hits >= (150 if k == 16 else 180)


def test_names_in_runs_stay():
    for text in ("account/settings/notifications/verify/index2", "release-notes/version2/getting-started", "image/123e4567-E89b-12d3-a456-426614174000", "sha/D41D8CD98F00B204E9800998ECF8427E/old1", "==========-----------", "HelloWorldFromHere2024"):
        assert secrets.spans(text, encoding()) == []


def slow_exposed(run, ratio=secrets.RATIO):
    """The rule spelled out: every stretch of tokens and every part is tried against all others."""
    tokens = lambda s: encoding().encode_ordinary(s)
    low = lambda a, b: b - a < ratio * len(tokens(run[a:b]))
    if secrets.is_known(run):
        return []
    digests = [m.span() for m in secrets._KNOWN_PART.finditer(run)]
    if not digests and low(0, len(run)):
        return [(0, len(run))]
    parts = [m.span() for m in re.finditer("[A-Za-z0-9]+", run)]
    apart = lambda a, b, places: all(y <= a or b <= x for x, y in places)
    found = [(a, b) for a, b in parts if b - a >= secrets.LEAST and not secrets.is_known(run[a:b]) and low(a, b)]
    at, cuts = 0, [0]
    for t in tokens(run):
        at += len(encoding().decode_single_token_bytes(t))
        cuts.append(at)
    windows = [(a, cuts[j]) for i, a in enumerate(cuts) for j in range(i + 1, len(cuts)) if secrets.LEAST <= cuts[j] - a <= 3 * secrets.LEAST and cuts[j] - a < ratio * (j - i)]
    windows = [w for w in windows if apart(*w, digests) and apart(*w, found)]
    covered = [any(a <= c < b for a, b in windows) for c in range(len(run))] + [False]
    c, more = 0, []
    while c < len(run):
        if not covered[c]:
            c += 1
            continue
        e = c
        while covered[e] or any(a == e for a, _ in windows):
            e += 1
        held = [p for p in parts if p[0] < e and c < p[1]]
        edge = lambda p: secrets.is_known(run[p[0] : p[1]]) and not low(*p)
        while held and edge(held[0]):
            held = held[1:]
        while held and edge(held[-1]):
            held = held[:-1]
        if held:
            x, y = held[0][0], held[-1][1]
            if y - x >= secrets.LEAST and not secrets.is_known(run[x:y]) and any(x <= a and b <= y for a, b in windows) and apart(x, y, found + more):
                more.append((x, y))
        c = e
    return sorted(found + more)


PIECES = ["account", "verify", "key", "Index", "2024", "k9Qv7ZtL2mXw8RbN", "xYzQwPmK", "Zr4", "qX7", "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "/", "_", "-", "=", "+", "=="]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=14))
def test_random_spans_against_brute_force(pieces):
    run = "".join(pieces)
    if len(run) >= 16:
        assert secrets.exposed(run, encoding(), secrets.RATIO) == slow_exposed(run)


def test_names_match_in_one_way():
    rng = np.random.default_rng(0)
    nested = re.compile(r"(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+)(?:[/_=+-]+(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+))*|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*[0-9]*")
    for _ in range(3000):
        run = "".join(rng.choice(list("aB7_=/"), rng.integers(0, 9)))
        assert secrets.is_name(run) == bool(nested.fullmatch(run))


@pytest.mark.parametrize("piece", ["=", "_", "-", "/", "+", "a", "A", "7", "aB", "A=", "=v2", "_x9", "AB12cd", "123e4567-e89b-12d3-a456-426614174000/", "k9Qv7ZtL2mXw8RbN4pJd/", "token=abcdefghijkl ", "k9Qv7ZtL2m "])
def test_long_runs_take_little_time(piece):
    encoding()
    secrets.spans("see ======================v2 end", encoding())
    text = "see " + piece * (10_000 // len(piece)) + "v2 end"
    began = time.process_time()
    secrets.spans(text, encoding())
    took = time.process_time() - began
    began = time.process_time()
    secrets.spans("see " + piece * (40_000 // len(piece)) + "v2 end", encoding())
    assert took < 0.1 if piece in "=_-/+" else took < 1.5
    assert time.process_time() - began < 8 * max(took, 0.1)
