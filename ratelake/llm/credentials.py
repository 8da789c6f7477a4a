"""Secret scans with a password guess-cost model.

Base spans come from three fixed patterns. The method adds ``guess`` spans: the
value given in a credential context (a key word, a separator, a value) that the
base patterns miss is kept if guessing it would be dear. Guess cost is a dynamic
program over the value: the cheapest segmentation into common words, dates,
repeats, keyboard or alphabet walks and brute-force characters, in log10 guesses.

Offsets are code points, ends exclusive. Defined results: a null or empty text
has no spans; equal rows give equal results; an empty table gives an empty
result; other columns are ignored. A value of any length is costed whole: the
program looks back at most ``REACH`` characters from each position, except over
a single repeated character, which it follows to its start.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the base patterns and their least lengths
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "guess")

# ---- fixed values: further credential contexts, common password words (by rank), walks
CONTEXT_WORDS = ("pwd", "passphrase", "passcode", "credentials?", "bearer", "private_?key", "access_?key", "client_?key")
COMMON_WORDS = (
    "password pass word qwerty dragon monkey letmein football iloveyou admin welcome login master hello freedom "
    "whatever shadow sunshine princess michael jordan hunter ranger buster thomas robert daniel soccer hockey killer "
    "george charlie andrew michelle love jessica pepper joshua summer winter spring autumn ashley matthew access "
    "secret token user guest root test demo example sample change changeme default temp my your the key api server "
    "database backup company office home internet computer google orange banana cheese cookie coffee flower"
).split()
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

REACH = 24
GUESS_LEAST = 8  # characters of a value
GUESS_COST = 8.0  # log10 guesses from which a value counts as a secret


def _any_case(words: tuple[str, ...]) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in w) for w in words)


_SEP = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(rf"({_any_case(ASSIGN_WORDS)}){_SEP}([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")  # the runs of [0-9a-f]+ that are long enough
CONTEXT = re.compile(rf"({_any_case(ASSIGN_WORDS + CONTEXT_WORDS)}){_SEP}([^\s\"',;]+)")
# A text without any of these has no context (checked on the lower-cased text).
CUES = ("passw", "passc", "passp", "secret", "token", "api", "pwd", "credential", "bearer", "private", "access", "client")

_RANK = {w: math.log10(i + 1) for i, w in reversed(list(enumerate(COMMON_WORDS, 1)))}
_DATES = re.compile(r"(19|20)\d\d([-/.]?)(0\d|1[0-2])\2([0-2]\d|3[01])|([0-2]\d|3[01])([-/.]?)(0\d|1[0-2])\6(19|20)\d\d")
_YEAR = re.compile(r"(19|20)\d\d")


def _span_cost(part: str) -> float:
    """Log10 guesses of ``part`` as one word, date or walk; infinite if it is none."""
    low = part.lower()
    best = math.inf
    if low in _RANK:
        case = 0.0 if part == low else 0.31 if part[1:] == low[1:] or part.isupper() else len(part) * 0.31
        best = _RANK[low] + case
    if len(part) == 4 and _YEAR.fullmatch(part):
        best = min(best, math.log10(200))
    if 8 <= len(part) <= 10 and _DATES.fullmatch(part):
        best = min(best, math.log10(200 * 365 * 4))
    if len(part) >= 3 and any(low in w or low[::-1] in w for w in WALKS):
        best = min(best, math.log10(4 * 47) + math.log10(len(part)))
    return best


def guess_cost(value: str) -> float:
    """Log10 guesses of the cheapest segmentation of ``value``."""
    n = len(value)
    cost = [0.0] * (n + 1)
    run = 0  # start of the run of equal characters that ends here
    for end in range(1, n + 1):
        if end > 1 and value[end - 1] != value[end - 2]:
            run = end - 1
        best = cost[end - 1] + 1.0  # brute force, one character
        if end - run >= 3:
            best = min(best, cost[run] + 1.0 + math.log10(end - run))
        for start in range(max(0, end - REACH), end - 1):
            if cost[start] >= best:
                continue
            got = cost[start] + _span_cost(value[start:end])
            if got < best:
                best = got
            width = (end - start) // 2  # the same piece two times
            if width >= 2 and (end - start) % 2 == 0 and value[start : start + width] == value[start + width : end]:
                best = min(best, cost[start + width] + math.log10(2))
        cost[end] = best
    return cost[n]


def base_spans(text: str, cued: bool) -> list[tuple[int, int, str]]:
    out = []
    if cued:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    cued = any(c in low for c in CUES)
    spans = base_spans(text, cued)
    if cued:
        taken = [(a, b) for a, b, _ in spans]
        for m in CONTEXT.finditer(text):
            if len(m[2]) < GUESS_LEAST or any(a < m.end() and m.start() < b for a, b in taken):
                continue
            if guess_cost(m[2]) >= GUESS_COST:
                spans.append((m.start(), m.end(), "guess"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per (document, span): doc_id, kind, start, end, the matched text and its value's guess cost."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, t in zip(f["doc_id"], f["t"], strict=True):
                for a, b, kind in find_spans(t):
                    value = (CONTEXT.match(t[a:b]) or [None, None, t[a:b]])[2]
                    rows.append((doc, kind, a, b, t[a:b], guess_cost(value)))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "end", "found", "guess_cost"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("t")).mapInPandas(
        run, "doc_id long, kind string, start long, end long, found string, guess_cost double"
    )


def span_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: base span counts, the digest of the base spans, and all spans."""

    def listed(spans: list[tuple[int, int, str]]) -> str:
        return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [find_spans(t) for t in f["t"]]
            base = [[s for s in spans if s[2] != "guess"] for spans in found]
            out = {"doc_id": f["doc_id"]}
            for kind in KINDS[:3]:
                out[f"n_{kind}"] = [sum(s[2] == kind for s in spans) for spans in base]
            out["base_sha256"] = [hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [listed(spans) for spans in found]
            yield pd.DataFrame(out)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("t")).mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
