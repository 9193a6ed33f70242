"""Secret scans: three base patterns, and a randomness battery for tokens that no pattern knows.

Base kinds, leftmost and non-overlapping each on its own: `assign` (a keyword, then : or =, then a value of at
least 6 characters; the span is the whole match), `access` (AKIA key ids) and `hex` (24 or more hex digits).

The method adds spans of kind `random`. A candidate is a maximal run of 20 or more token characters that is no plain
number. Its encoding is inferred as the smallest known alphabet that holds it. Chi-squared uniformity over the alphabet, a
runs test about the alphabet's middle, and the lag-1 serial correlation give three p-values under "uniform over that
encoding", combined by Fisher's method.

Random tokens are those that pass the battery although ordinary ones of their encoding and length would not. What the
combined statistic is for ordinary tokens is drawn once, from fixed tables of letters and of changes between
classes of characters, for each encoding and length; its square root is near normal, so a candidate gets the p-value
of a statistic as low as its own under "ordinary token". Short tokens can't reach small values: the tests have no power
there. All distinct candidates of the whole table are one family for the weighted Benjamini-Hochberg rule, with weights
in proportion to the length (up to LONG): among the tokens reported as random at most `alpha` are expected to be
ordinary, as far as the tables describe ordinary ones. The rule reads a histogram of p-values, so the driver gets a few
hundred numbers.

Defined results: null or empty text: no spans. Ties of start: in the order of KINDS. Base spans are cut
out of a candidate; what is left of it in pieces of 20 or more characters is a candidate of its own, so no `random` span meets a
base span. Repeated rows give equal results, and repeated tokens count once in the family; other columns are not read. In an
empty table nothing is found.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_D, _U, _L = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From small to large; the first that holds a token is its encoding.
ENCODINGS = {
    "hex": _D + _L[:6],
    "HEX": _D + _U[:6],
    "lower26": _L,
    "upper26": _U,
    "base32": _U + "234567",
    "lower36": _D + _L,
    "upper36": _D + _U,
    "base62": _U + _L + _D,
    "base64": _U + _L + _D + "+/",
    "base64url": _U + _L + _D + "-_",
    "any": _U + _L + _D + "+/-_",
}
# Letters of ordinary European text per 1000, a to z.
_LETTERS = (80, 15, 30, 40, 130, 18, 17, 40, 75, 3, 6, 45, 26, 72, 70, 22, 4, 64, 68, 80, 35, 11, 14, 3, 15, 7)
# How often ordinary tokens change from one class of characters (row) to another: lower, upper, digit, mark.
_TURN = {"l": (0.93, 0.02, 0.01, 0.04), "u": (0.40, 0.55, 0.01, 0.04), "d": (0.03, 0.02, 0.90, 0.05), "m": (0.60, 0.20, 0.15, 0.05)}
#: The expected share of ordinary tokens among those reported as random; lengths at which ordinary tokens are drawn;
#: the length from which on the weight no longer grows; bins of the histogram of p-values for each factor of 2.
ALPHA, LENGTHS, LONG, PER_OCTAVE = 0.001, (20, 28, 40, 64), 64, 8


def _class(c: str) -> str:
    return "d" if c in _D else "l" if c in _L else "u" if c in _U else "m"


def _ordered(letters: str) -> list[str]:
    """Upper case, lower case, digits, marks; letters from the most frequent in text to the rarest."""
    return sorted(letters, key=lambda c: ("uldm".index(_class(c)), -_LETTERS[ord(c.lower()) - 97] if c.isalpha() else 0, c))


def _kinds(letters: str) -> dict[str, int]:
    """What the runs test tells apart: the classes of characters, or vowels from consonants where there is one class."""
    classes = {c: "uldm".index(_class(c)) for c in letters}
    return classes if len(set(classes.values())) > 1 else {c: int(c.lower() in "aeiou") for c in letters}


_VALUES = {name: {c: i for i, c in enumerate(_ordered(letters))} for name, letters in ENCODINGS.items()}
_KINDS = {name: _kinds(letters) for name, letters in ENCODINGS.items()}
_SHARES = {name: [sum(k == i for k in kinds.values()) / len(kinds) for i in range(4)] for name, kinds in _KINDS.items()}


def infer_encoding(token: str) -> str:
    return next(name for name, values in _VALUES.items() if all(c in values for c in token))


def _chi2_tail(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    t = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(t / math.sqrt(2))


def battery(token: str, encoding: str | None = None) -> dict[str, float]:
    """p-values under "uniform over the encoding": uniformity, runs, serial, and all three combined."""
    token = token.rstrip("=")
    encoding = encoding or infer_encoding(token)
    values, kinds = _VALUES[encoding], _KINDS[encoding]
    size, n = len(values), len(token)
    v = [values[c] for c in token]
    groups = max(2, min(size, n // 4))
    seen, room = [0] * groups, [0] * groups
    for x in v:
        seen[x * groups // size] += 1
    for x in range(size):
        room[x * groups // size] += 1
    uniform = _chi2_tail(sum((s - n * r / size) ** 2 / (n * r / size) for s, r in zip(seen, room)), groups - 1)
    k = [kinds[c] for c in token]
    two, three = (sum(p**e for p in _SHARES[encoding]) for e in (2, 3))
    turn = 1 - two  # the chance that two neighbours are of different kinds
    var = (n - 1) * turn * two + 2 * max(0, n - 2) * (1 - 2 * two + three - turn * turn)
    turns = sum(a != b for a, b in zip(k, k[1:]))
    p_runs = math.erfc(abs(turns - (n - 1) * turn) / math.sqrt(2 * var)) if n > 1 else 1.0
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    r = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread if spread else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, p_runs, p_serial))
    return {"uniform": uniform, "runs": p_runs, "serial": p_serial, "combined": math.exp(-half) * (1 + half + half * half / 2)}


def statistic(token: str, encoding: str | None = None) -> float:
    """Square root of Fisher's statistic of the battery: about 2.4 for random tokens, and the larger the less random."""
    p = battery(token, encoding)
    return math.sqrt(-2 * sum(math.log(max(p[k], 1e-300)) for k in ("uniform", "runs", "serial")))


def ordinary_token(encoding: str, length: int, rng: random.Random) -> str:
    """A token as ordinary text would have it: a chain of classes of characters, with letters as frequent as in words."""
    letters = ENCODINGS[encoding]
    by_class = {k: [c for c in letters if _class(c) == k] for k in "ludm"}
    turns = {a: [(b, p) for b, p in zip("ludm", row) if by_class[b]] for a, row in _TURN.items()}
    weights = {k: [_LETTERS[ord(c.lower()) - 97] if k in "lu" else 1 for c in own] for k, own in by_class.items()}
    now = rng.choice([k for k in "lud" if by_class[k]])
    out = []
    for _ in range(length):
        out.append(rng.choices(by_class[now], weights[now])[0])
        names, chances = zip(*turns[now])
        now = rng.choices(names, chances)[0]
    return "".join(out)


@lru_cache(1)
def ordinary_statistics(draws: int = 150, seed: int = 11) -> dict[str, list[tuple[float, float]]]:
    """For each encoding, mean and standard deviation of the statistic of ordinary tokens of each of LENGTHS."""
    rng, out = random.Random(seed), {}
    for name in ENCODINGS:
        out[name] = []
        for length in LENGTHS:
            drawn = np.array([statistic(ordinary_token(name, length, rng), name) for _ in range(draws)])
            out[name].append((float(drawn.mean()), float(drawn.std())))
    return out


def p_ordinary(token: str, known: dict[str, list[tuple[float, float]]]) -> float:
    """The chance that an ordinary token of this encoding and length passes the battery as well as this one, or better."""
    token = token.rstrip("=")
    encoding = infer_encoding(token)
    value = statistic(token, encoding)
    mean, spread = (float(np.interp(len(token), LENGTHS, [c[i] for c in known[encoding]])) for i in (0, 1))
    return 0.5 * math.erfc((mean - value) / spread / math.sqrt(2))


def length_weight(length: int) -> float:
    return min(length, LONG) / LONG


def limit_of(bins: dict[int, int], mean_weight: float, alpha: float) -> float:
    """The weighted Benjamini-Hochberg limit on p / length_weight, from counts by bin (see `bin_of`), rounded down to a bin."""
    m, below, limit = sum(bins.values()), 0, 0.0
    for k in sorted(bins, reverse=True):  # from the smallest p-values on
        below += bins[k]
        top = 2.0 ** (-k / PER_OCTAVE)  # the upper end of the bin
        if top * mean_weight <= alpha * below / m:
            limit = top
    return limit


def bin_of(ratio: float) -> int:
    return max(-8 * PER_OCTAVE, min(200 * PER_OCTAVE, math.floor(-math.log2(max(ratio, 1e-300)) * PER_OCTAVE)))


def _free(text: str, runs: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs, and of those that base spans meet what is left between the spans, where it is long enough for a candidate."""
    out = []
    spans = sorted((s, e) for s, e, _ in found)
    for a, b in runs:
        met = [(s, e) for s, e in spans if s < b and a < e]
        if not met:
            out.append((a, b))
            continue
        at = a
        for s, e in [*met, (b, b)]:
            left = at + (at > a and at < s and text[at] in "+/_-")  # the mark that joins the rest to a span is not its own
            right = s - (s < b and s > left and text[s - 1] in "+/_-")
            if _RUN.fullmatch(text, left, max(left, right)):
                out.append((left, right))
            at = max(at, e)
    return out


def _scanned(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans, in no order, and the candidates beside them."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [m.span() for m in _RUN.finditer(text)]
    for a, b in runs:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text, a, b)]
        found += [(*m.span(), 2) for m in HEX.finditer(text, a, b)]
    return found, [(a, b) for a, b in _free(text, runs, found) if not text[a:b].rstrip("=").isdecimal()] if runs else []


def candidates(text: str | None) -> list[str]:
    """The tokens of one text that the battery is to judge."""
    return [text[a:b] for a, b in _scanned(text)[1]] if text else []


def find_secrets(text: str | None, limit: float, known: dict[str, list[tuple[float, float]]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, index of the kind) of one text, in code points, ends exclusive, in order.

    limit: as `random_limit` finds it for a table; known: `ordinary_statistics()`.
    """
    if not text:
        return []
    found, free = _scanned(text)
    found += [(a, b, 3) for a, b in free if p_ordinary(text[a:b], known) <= limit * length_weight(b - a)]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def random_limit(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> float:
    """The limit on p / length_weight up to which the distinct candidates of all rows are reported as random."""
    known = ordinary_statistics()

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("bin", T.IntegerType()), T.StructField("w", T.DoubleType())])))
    def judged(texts: pa.Array) -> pa.Array:
        import xxhash

        rows = [[{"h": xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63), "bin": bin_of(p_ordinary(t, known) / length_weight(len(t))), "w": length_weight(len(t))} for t in set(candidates(x))] for x in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("h", pa.int64()), ("bin", pa.int32()), ("w", pa.float64())])))

    family = docs.select(F.explode(judged(F.col(text))).alias("c")).groupBy("c.h").agg(F.first("c.bin").alias("bin"), F.first("c.w").alias("w"))
    rows = family.groupBy("bin").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()  # at most 208 * PER_OCTAVE
    m = sum(r.n for r in rows)
    return limit_of({r.bin: r.n for r in rows}, sum(r.w for r in rows) / m, alpha) if m else 0.0


def secret_spans(text: Column, limit: float) -> Column:
    """array<struct<kind, start, end>> of a text column, by start, then kind. limit: of the table, see `random_limit`."""
    known = ordinary_statistics()

    @F.arrow_udf(SPAN)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in find_secrets(t, limit, known)] for t in texts.to_pylist()]
        return pa.array(rows, _SPAN_ARROW)

    return scan(text)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that meet, the first is named."""
    if not spans:
        return text
    parts, at = [], 0
    for s, e, k in spans:
        if e > at:
            parts += [text[at : max(at, s)]] + [f"[{KINDS[k].upper()}]"] * (s >= at)
            at = e
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """Every found span becomes its kind in brackets; all other columns and rows stay. Null stays null."""
    known, limit = ordinary_statistics(), random_limit(docs, text, alpha)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t, find_secrets(t, limit, known)) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, run(F.col(text)))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row (key, spans) for each input row."""
    return docs.select(F.col(key), secret_spans(F.col(text), random_limit(docs, text, alpha)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
