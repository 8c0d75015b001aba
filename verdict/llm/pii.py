"""Personal data by fixed patterns and a semi-Markov conditional random field.

Patterns give the base spans of four kinds, which always stay. The field looks at regions that
hold groups of digits or an at sign: a region is a row of units, and a segment is up to
``MOST_UNITS`` of them with one kind, or one unit of none. Features of whole segments (digits,
groups, marks between and around them, checksum, parts of an address) score each candidate, learned
weights of neighbouring kinds score their order, and dynamic programming over segments of
bounded length chooses boundaries and kinds together. Added spans never overlap base spans.

It is trained on a bounded sample of documents, with the exact gradient of the likelihood, once as they are and once with
their base spans written otherwise (``rewritten``): phone numbers without sign, in local groups or with other marks, cards
and addresses with other marks, at signs spelled out. So it learns what the patterns stand for and not their spelling. What else these texts hold is none, nor are
dates, amounts, versions and other numbers made for the purpose (``harmless``). Bounds of the fit: ``SAMPLE`` documents; of each text ``REGIONS``
regions, those of least hash wherever they stand, and those that hold a span; regions are cut into rows of at most ``ROW`` units.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import give_back

KINDS = ("email", "ip", "card", "phone")
#: Documents with digits or at signs the field is trained on at most, those of least hash of their id.
SAMPLE = 3_000
#: Regions of a text besides those that hold a span, and units of a row, that the fit takes.
REGIONS, ROW = 50, 40
MOST_UNITS = 8
#: Log-odds by which a segment has to beat none.
MARGIN = 1.0
STEPS = 150
#: Spans are rare, so little is taken off their weights.
RIDGE = 1e-5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a match that starts inside one exists only if one starts at its head.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]++")
_GAP = re.compile(r"[\x20()\[\].+/-]{1,3}")
_AROUND = re.compile(r"[^\s@]*+@[^\s@]*+")
#: An at sign that is spelled out in brackets, or in capitals between blanks, and dots that are.
_SPELLED = re.compile(r"[\w.%+-]+ ?(?:[\[({<](?:at|AT)[\])}>]| AT ) ?[\w-]+(?: ?[\[({<](?:dot|DOT)[\])}>] ?[\w-]+| DOT [\w-]+|\.[\w-]+)+")
_SIGNS = re.compile(r"[\[({<](?:at|AT)[\])}>]| AT ")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> list[Span]:
    """Leftmost matches: the local part is all that stands before the sign, back to the last match."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start, host = at, _HOST.match(text, at)
        if host:
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, host.end()))
                low = host.end()
        at = text.find("@", max(at + 1, low))
    return out


def _octets(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start; offsets are code points, ends exclusive."""
    out = emails(text) if text and "@" in text else []
    if not text or not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def held(text: str) -> bool:
    """Whether a text can hold personal data at all."""
    return "@" in text or _DIGIT.search(text) is not None or _SIGNS.search(text) is not None


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Rows of units: groups of digits with short gaps of marks between, and what surrounds an at sign, which may be spelled out."""
    out = [[m.span()] for m in _AROUND.finditer(text)] if "@" in text else []
    if _SIGNS.search(text):
        out += [[m.span()] for m in _SPELLED.finditer(text)]
    row: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        if row and not _GAP.fullmatch(text, row[-1][1], m.start()):
            out.append(row)
            row = []
        row.append(m.span())
    return [*out, row] if row else out


def features(text: str, units: list[tuple[int, int]], i: int, j: int) -> np.ndarray:
    """Of the segment of units i to j, j exclusive."""
    a, b = units[i][0], units[j - 1][1]
    whole = text[a:b]
    groups = [text[x:y] for x, y in units[i:j]]
    digits = _digits(whole)
    n = len(digits)
    left, right = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    at = "@" in whole
    local, _, host = whole.partition("@")
    spelled = not at and _SPELLED.fullmatch(whole) is not None
    sizes = [len(g) for g in groups]
    year = sizes[0] == 4 and groups[0][:2] in ("19", "20") or sizes[-1] == 4 and groups[-1][:2] in ("19", "20")
    gaps = {text[units[k][1] : units[k + 1][0]] for k in range(i, j - 1)}
    return np.array(
        [
            1.0,
            at, at and bool(local), at and "." in host.strip("."), at and bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host.rstrip(".,;:!?"))),
            not at and 9 <= n <= 15, not at and 13 <= n <= 19, not at and n < 9, not at and n > 19,
            not at and 13 <= n <= 19 and luhn(digits),
            j - i == 1, j - i == 4, gaps == {"."}, j - i == 4 and gaps == {"."} and _octets(".".join(groups)),
            bool(gaps) and gaps <= {" ", "-"}, any("(" in g or ")" in g for g in gaps),
            left == "+", left == "(", left.isalnum() or left in "\"'_=", right.isalnum() or right in "\"'_=%",
            left == "." or right == "." and b + 1 < len(text) and text[b + 1].isdigit(),
            all(len(g) == 4 for g in groups), len(groups[-1]) == 4, len(groups[0]) <= 3,
            spelled, sizes == [3, 3, 4], j - i >= 4 and set(sizes[-4:]) == {2}, groups[0][0] == "0", groups[0][:2] == "00",
            n == 10, year and j - i <= 3, len(gaps) > 1, j - i == 4 and gaps <= {"[.]", " . "} and _octets(".".join(groups)),
            j - i >= 3 and gaps == {"."} and 9 <= n <= 15,
        ],
        dtype=float,
    )


N_FEATURES = len(features("1", [(0, 1)], 0, 1))


def candidates(text: str, units: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    pairs = [(i, j) for i in range(len(units)) for j in range(i + 1, min(i + MOST_UNITS, len(units)) + 1)]
    return pairs, np.stack([features(text, units, i, j) for i, j in pairs])


def span_of(text: str, units: list[tuple[int, int]], i: int, j: int, kind: str) -> Span:
    """The text a segment stands for: a phone number takes the sign or bracket before it along."""
    a, b = units[i][0], units[j - 1][1]
    if kind == "phone":
        while a and text[a - 1] in "+(" and units[i][0] - a < 2:
            a -= 1
    if kind == "email":
        b -= len(text[a:b]) - len(text[a:b].rstrip(".,;:!?#*$%&|"))
    return kind, a, b


@dataclass
class Model:
    """Weights of each kind's features, and of each kind behind each (the last one is none)."""

    weights: np.ndarray
    order: np.ndarray

    def scores(self, n: int, pairs: list[tuple[int, int]], f: np.ndarray):
        """Per start, (end, scores of the kinds and of none)."""
        typed = f @ self.weights.T
        out = [[] for _ in range(n)]
        for (i, j), s in zip(pairs, typed, strict=True):
            out[i].append((j, np.append(s, 0.0 if j == i + 1 else -np.inf)))
        return out

    def best(self, n: int, pairs: list[tuple[int, int]], f: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
        """(begin, end, kind) of the best segments that are some kind."""
        bias = np.append(np.full(len(KINDS), -margin), 0.0)
        top = np.full((n + 1, len(KINDS) + 1), -np.inf)
        back: dict = {}
        top[0, -1] = 0.0
        for i, ends in enumerate(self.scores(n, pairs, f)):
            reach = top[i][:, None] + self.order
            came, into = reach.argmax(axis=0), reach.max(axis=0)
            for j, s in ends:
                value = into + s + bias
                for k in np.flatnonzero(value > top[j]):
                    top[j, k] = value[k]
                    back[j, int(k)] = (i, int(came[k]))
        out, at, k = [], n, int(top[n].argmax())
        while at > 0:
            i, before = back[at, k]
            if k < len(KINDS):
                out.append((i, at, k))
            at, k = i, before
        return out[::-1]

    def add(self, text: str, base: list[Span]) -> list[Span]:
        out = []
        for units in regions(text):
            # Base spans are fixed: what is left of a region lies between them.
            free = [u for u in units if not any(a < u[1] and u[0] < b for _, a, b in base)]
            if not free:
                continue
            for i, j, k in self.best(len(free), *candidates(text, free)):
                span = span_of(text, free, i, j, KINDS[k])
                if span[1] < span[2] and not any(a < span[2] and span[1] < b for _, a, b in [*base, *out]):
                    out.append(span)
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top[~np.isfinite(top)] = 0
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def other_form(kind: str, span: str, by: int) -> str:
    """A base span as it might be written otherwise; ``by`` chooses."""
    digits = _digits(span)
    if kind == "phone":
        last = digits[-10:].rjust(10, "2")
        pairs = " ".join(last[i : i + 2] for i in range(2, 10, 2))
        return (
            f"{last[:3]}-{last[3:6]}-{last[6:]}", f"({last[:3]}) {last[3:6]} {last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}",
            f"{last[:3]} {last[3:6]} {last[6:]}", f"00{last[:2] if last[0] != '0' else '33'} {last[1]} {pairs}", f"0{last[1]} {pairs}",
        )[by % 6]
    if kind == "card":
        return (".", "/", " - ")[by % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "ip":
        return span.replace(".", ("[.]", " . ")[by % 2])
    local, _, host = span.partition("@")
    return (f"{local} (at) {host}", f"{local}[at]{host.replace('.', '[dot]')}", f"{local} AT {host.replace('.', ' DOT ')}", f"{local} <at> {host.replace('.', ' (dot) ')}")[by % 4]


def rewritten(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """The text with its base spans written otherwise, and where they are then; overlapping spans stay as they are."""
    out, spans, at, n = [], [], 0, 0
    for kind, a, b in sorted(base, key=lambda s: s[1:]):
        if a < at:
            continue
        new = other_form(kind, text[a:b], zlib.crc32(text[max(0, a - 20) : b].encode("utf-8", "surrogatepass")))
        out += [text[at:a], new]
        n += a - at
        spans.append((kind, n, n + len(new)))
        n += len(new)
        at = b
    return "".join([*out, text[at:]]), spans


def harmless(by: int) -> str:
    """Numbers that are no personal data, though some are as long: dates, times, book numbers, amounts, versions, sizes."""
    rng = np.random.default_rng(by)
    n = lambda low, high, width=0: f"{rng.integers(low, high):0{width}d}"
    day = lambda: f"{n(1950, 2060)}-{n(1, 13, 2)}-{n(1, 29, 2)}"
    return "; ".join((
        f"{day()} {n(0, 24, 2)}:{n(0, 60, 2)}", f"{day()} {n(0, 24, 2)}.{n(0, 60, 2)}", f"{day()} - {day()}", day(),
        f"{n(1, 29, 2)}/{n(1, 13, 2)}/{n(1950, 2060)} - {n(1, 29, 2)}/{n(1, 13, 2)}/{n(1950, 2060)}", f"{n(1, 29)}.{n(1, 13)}.{n(1950, 2060)}",
        f"978-{n(0, 10)}-{n(10, 100)}-{n(100000, 1000000)}-{n(0, 10)}", f"979-{n(0, 10)}-{n(1000, 10000)}-{n(1000, 10000)}-{n(0, 10)}",
        f"{n(1, 1000)} {n(0, 1000, 3)} {n(0, 1000, 3)}", f"{n(1, 1000)}.{n(0, 1000, 3)}.{n(0, 1000, 3)},{n(0, 100, 2)}",
        f"{n(0, 10)}.{n(0, 20)}.{n(0, 30)}", f"{n(0, 10)}.{n(0, 20)}.{n(0, 30)}-{n(1, 10)}", f"{n(1, 100)}-{n(100, 999)}", n(10**8, 10**11), n(10**12, 10**15),
    ))


def _drawn(text: str, spans: list[Span]) -> list[list[tuple[int, int]]]:
    """Rows of units to learn from: all that hold a span, and of the others those of least hash."""
    rows = [units[i : i + ROW] for units in regions(text) for i in range(0, len(units), ROW)]
    inside = lambda row: any(a < row[-1][1] and row[0][0] < b for _, a, b in spans)
    others = sorted((zlib.crc32(f"{row[0][0]}:{text[row[0][0] : row[-1][1]]}".encode("utf-8", "surrogatepass")), row) for row in rows if not inside(row))
    return [row for row in rows if inside(row)] + [row for _, row in others[:REGIONS]]


def _expected(model: Model, n: int, pairs: list, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected feature sums of the kinds, and expected neighbours, under the model."""
    k = len(KINDS) + 1
    ends = model.scores(n, pairs, f)
    a, b = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    a[0, -1] = 0.0
    into = np.full((n + 1, k), -np.inf)
    for i in range(n):
        into[i] = _logsum(a[i][:, None] + model.order, 0)
        for j, s in ends[i]:
            a[j] = np.logaddexp(a[j], into[i] + s)
    b[n] = 0.0
    out_of = np.full((n + 1, k), -np.inf)
    for i in range(n - 1, -1, -1):
        for j, s in ends[i]:
            out_of[i] = np.logaddexp(out_of[i], s + b[j])
        b[i] = _logsum(model.order + out_of[i][None, :], 1)
    z = _logsum(a[n], 0)
    row = {p: x for x, p in enumerate(pairs)}
    w, order = np.zeros_like(model.weights), np.zeros_like(model.order)
    for i in range(n):
        for j, s in ends[i]:
            w += np.outer(np.exp(into[i] + s + b[j] - z)[:-1], f[row[i, j]])
        order += np.exp(a[i][:, None] + model.order + out_of[i][None, :] - z)
    return w, order


def fit(docs: DataFrame) -> Model:
    """A model from the base spans of docs (doc_id, text), at most SAMPLE of those with digits or at signs."""
    rows = docs.filter("text rlike '[0-9@]'").select(F.xxhash64("doc_id").alias("h"), "text")
    # Twice the bound lies below the mark, so few rows meet where the least are taken, however many parts there are.
    share = 2 * SAMPLE / max(rows.count(), 1)
    if share < 1:
        rows = rows.filter(F.col("h") <= int((share - 0.5) * 2**64))

    def seen(frames):
        shapes: Counter = Counter()
        for pdf in frames:
            for text in pdf["text"]:
                base = base_spans(text)
                forms = [(text, base)]
                if base:
                    forms += [rewritten(text, base), (harmless(zlib.crc32(text.encode("utf-8", "surrogatepass"))), [])]
                for form, spans in forms:
                    known = set(spans)
                    for units in _drawn(form, spans):
                        pairs, f = candidates(form, units)
                        gold = [next((k for k, kind in enumerate(KINDS) if span_of(form, units, i, j, kind) in known), -1) for i, j in pairs]
                        # All features are yes or no.
                        shapes[len(units), np.array(gold, np.int8).tobytes(), np.packbits(f > 0).tobytes()] += 1
        yield pd.DataFrame([(*shape, many) for shape, many in shapes.items()], columns=["n", "gold", "f", "many"])

    # Equal regions count once, with their number: few shapes make up most of a sample.
    sample = rows.orderBy("h").limit(SAMPLE).repartition(8, "h").mapInPandas(seen, "n int, gold binary, f binary, many long")
    shapes = []
    for n, gold, f, many in sample.groupBy("n", "gold", "f").agg(F.sum("many").alias("many")).orderBy("n", "gold", "f").collect():
        pairs = [(i, j) for i in range(n) for j in range(i + 1, min(i + MOST_UNITS, n) + 1)]
        bits = np.unpackbits(np.frombuffer(f, np.uint8), count=len(pairs) * N_FEATURES)
        shapes.append((many, n, pairs, bits.reshape(len(pairs), -1).astype(float), np.frombuffer(gold, np.int8)))
    k = len(KINDS) + 1
    model = Model(np.zeros((len(KINDS), N_FEATURES)), np.zeros((k, k)))
    model.weights[:, 0] = -2.0
    total = max(sum(many for many, *_ in shapes), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.weights, model.order)]
    for step in range(1, STEPS + 1):
        w, order = RIDGE * model.weights, RIDGE * model.order
        for many, n, pairs, f, gold in shapes:
            e_w, e_order = _expected(model, n, pairs, f)
            at, last = 0, k - 1
            while at < n:
                inside = [(j, gold[x]) for x, (i, j) in enumerate(pairs) if i == at and gold[x] >= 0]
                j, kind = inside[-1] if inside else (at + 1, k - 1)
                if kind < k - 1:
                    e_w[kind] -= f[pairs.index((at, j))]
                e_order[last, kind] -= 1
                at, last = j, int(kind)
            w, order = w + many / total * e_w, order + many / total * e_order
        for x, grad, (m, v) in ((model.weights, w, moments[0]), (model.order, order, moments[1])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def written(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and spans (kind, begin, end) for each row of docs (doc_id, text).

    spans holds the base spans and what the field adds. Null and empty texts have none.
    Offsets count code points. Whole texts are read; repeated rows are searched one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        for pdf in frames:
            base = [base_spans(t) for t in pdf["text"]]
            spans = [b + m.add(t, b) if t and held(t) else b for t, b in zip(pdf["text"], base, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": pd.Series(map(_rows, base), dtype=object), "spans": pd.Series(map(_rows, spans), dtype=object)})

    kind = "array<struct<kind: string, begin: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, f"doc_id long, base {kind}, spans {kind}")


def _rows(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "begin": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))]


def mask(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by its kind in angle brackets; overlapping spans go together, under the first one's kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if not text or not held(text):
            return text
        base = base_spans(text)
        out, at = [], 0
        for kind, a, b in sorted([*base, *shared.value.add(text, base)], key=lambda s: s[1]):
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([clean(t) for t in texts], dtype=object)
        give_back()
        return out

    return docs.withColumn(column, F.pandas_udf(run, "string")(F.col(column)))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
