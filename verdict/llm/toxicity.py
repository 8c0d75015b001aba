"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Units of a token are itself and its first 4, 5 and 6 letters, so that words that share a stem tell of one another. Fit:
the labelled documents that hold a unit, counted by label, give its log-odds with an informative Dirichlet prior (the rate
of both labels together, worth ``PRIOR`` documents, and half a document for every unit). Documents of a label with equal
sets of tokens count once, so copies of a text are not taken for many. Units whose log-odds lie at
least z standard errors from zero keep them, above or below. A token takes the score of its clearest unit; tokens
without one share one negative score, so that ordinary text drifts downward.

Score: a linear scan finds all maximal segments of a text: disjoint runs of tokens whose sum no
longer or shorter run beats. Chance segments of a text of n tokens reach a sum of s with a
probability of about 1 - exp(-K n e^(-lambda s)). lambda solves the moment equation of the
token scores in ordinary text, K is fitted to the best segments of ordinary documents. A
segment counts by its evidence, lambda s - log(K n), where that is positive. The sum over
segments and their density go through a logistic curve fitted to the labels, which never falls as either grows.

z is the one of ``MARKS`` whose models, each fitted without a fold of the labelled documents, predict that fold best.

Bounds: a model is fitted on ``SAMPLE`` labelled rows at most, those of least hash of their id. The driver takes units that are
near the least mark, and a few numbers of each of these documents, no texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import stored

#: Labelled documents a model is fitted on at most, those of least hash of their id.
SAMPLE = 20_000
PRIOR = 20.0
#: Standard errors of which one becomes the mark, and the folds that decide.
MARKS = (2.5, 3.0, 3.5, 4.0, 5.0)
FOLDS = 3
#: Letters of the beginnings of a token that are units.
STARTS = (4, 5, 6)
#: Least count of a unit that can have a score of its own.
LEAST = 4
#: Tokens whose scores a worker remembers, a bound on memory only.
KNOWN = 500_000

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def units(token: str) -> list[str]:
    """The token and its beginnings, which end with a star."""
    return [token, *(f"{token[:k]}*" for k in STARTS if len(token) > k)]


def log_odds(n0: np.ndarray, n1: np.ndarray, docs0: float, docs1: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds for label 1 of units held by n0 and n1 documents of the labels, and how many standard errors they are from zero."""
    prior = 0.5 + (n0 + n1) / max(docs0 + docs1, 1) * PRIOR
    a, b = n1 + prior, n0 + prior
    total0, total1 = (docs + PRIOR + 1 for docs in (docs0, docs1))
    delta = np.log(a / np.maximum(total1 - a, 0.5)) - np.log(b / np.maximum(total0 - b, 0.5))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """(begin, end, sum) of all maximal scoring segments, end exclusive, in linear time.

    scores lists (position, score) of tokens with a score of their own; those between score drift,
    which is negative. Only positive tokens can begin or end a segment, so others are skipped.
    """
    stack: list[list[float]] = []  # begin, end, sum before, sum after
    total, last = 0.0, 0
    for at, score in scores:
        total += drift * (at - last)
        last = at + 1
        before, total = total, total + score
        if score <= 0:
            continue
        new = [at, at + 1, before, total]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k -= 1
            if k < 0 or stack[k][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
    return [(int(b), int(e), r - l) for b, e, l, r in stack]


@dataclass
class Model:
    """Scores of units and their standard errors from zero, drift, extreme-value parameters and the logistic curve."""

    units: dict[str, tuple[float, float]]
    drift: float = -0.05
    rate: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: dict[str, float | None] = field(default_factory=dict, repr=False)

    def score(self, token: str) -> float | None:
        """The score of the token's clearest unit; of equally clear ones, of the longest."""
        known = self.known
        if token not in known:
            if len(known) >= KNOWN:
                known.clear()
            found = [u for name in units(token) if (u := self.units.get(name))]
            known[token] = max(found, key=lambda u: u[1])[0] if found else None
        return known[token]

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        return self.segments_of([(i, s) for i, w in enumerate(words) if (s := self.score(w)) is not None])

    def segments_of(self, own: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
        """Segments of a text whose tokens with a score are own: (position, score)."""
        return maximal_segments(own, self.drift) if own else []

    def features(self, words: list[str]) -> tuple[float, float, list]:
        """Evidence, evidence by length, and the segments that count."""
        if not words:
            return 0.0, 0.0, []
        strong = [(b, e, s, self.evidence(s, len(words))) for b, e, s in self.segments(words)]
        strong = [x for x in strong if x[3] > 0]
        evidence = float(sum(x[3] for x in strong))
        return evidence, evidence / len(words) ** 0.5, strong

    def evidence(self, total: float, n: int) -> float:
        return self.rate * total - self.log_k - float(np.log(n))

    def probability(self, evidence: float, density: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence) + c * np.log1p(density), -30, 30))))


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive solution of sum(weights * exp(rate * scores)) = 1."""
    low, high = 0.0, 1.0
    moment = lambda x: (weights * np.exp(np.clip(x * scores, -700, 700))).sum()
    while moment(high) < 1 and high < 64:
        high *= 2
    low = 1e-6
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton steps with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def fit(labelled: DataFrame) -> Model:
    """A model from rows (id, text, label), of which at most SAMPLE are used. Null labels and texts are ignored."""
    rows = labelled.filter("label is not null and text is not null").withColumn("h", F.xxhash64("id"))
    count = rows.agg(F.count(F.lit(1))).first()[0]
    if count > SAMPLE:
        # The share whose hash lies below the mark, then exactly the bound of it.
        mark = int((1.2 * SAMPLE / count - 0.5) * 2**64) if 1.2 * SAMPLE < count else 2**63 - 1
        rows = rows.filter(F.col("h") <= mark)
        ids = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
        rows = rows.filter(F.col("h") <= ids)

    def signed(frames):
        for pdf in frames:
            marks = [hashlib.md5("\n".join(sorted(set(tokens(t)))).encode()).hexdigest() for t in pdf["text"]]
            yield pdf[["text", "label", "h"]].assign(mark=marks)

    plain = rows.select("text", F.expr("cast(label = 1 as int)").alias("label"), "h")
    once = plain.mapInPandas(signed, "text string, label int, h long, mark string").groupBy("label", "mark").agg(F.min_by("text", "h").alias("text"))
    once = stored(once.select("text", "label", F.expr(f"pmod(xxhash64(mark), {FOLDS})").cast("int").alias("fold")), "labelled")
    docs = np.zeros((FOLDS, 2))
    for fold, label, n in once.groupBy("fold", "label").count().collect():
        docs[fold, label] = n
    models = _models(once, docs)
    _drifts(once, models)
    seen = _best_segments(once, models)

    def finished(i: int, held: int) -> np.ndarray:
        """Complete model i by the documents of other folds; the probabilities of those of this one."""
        model, label, n = models[i], seen["label"].to_numpy(), seen["n"].to_numpy(float)
        inside = (seen["fold"] != held).to_numpy()
        sums = [s[i] for s in seen["sums"]]
        top = np.array([max(s, default=0.0) for s in sums])
        ordinary = inside & (label != 1) & (n > 0)
        # Half of all ordinary texts have a best segment below log(K n / log 2) / rate.
        if ordinary.any():
            model.log_k = float(np.quantile(model.rate * top[ordinary] - np.log(n[ordinary]), 0.9) + np.log(-np.log(0.9)))
        evidence = np.array([sum(max(model.evidence(t, k), 0.0) for t in s) if k else 0.0 for s, k in zip(sums, n, strict=True)])
        x = np.column_stack((np.log1p(evidence), np.log1p(evidence / np.maximum(n, 1) ** 0.5))) if len(n) else np.empty((0, 2))
        model.curve = _curve(x[inside], (label[inside] == 1).astype(float))
        return model.curve[0] + x[~inside] @ np.array(model.curve[1:])

    losses = np.zeros(len(MARKS))
    for held in range(FOLDS):
        y = (seen["label"] == 1).to_numpy(float)[(seen["fold"] == held).to_numpy()]
        for m in range(len(MARKS)):
            losses[m] += np.logaddexp(0, np.where(y > 0, -1, 1) * finished(held * len(MARKS) + m, held)).sum()
    best = FOLDS * len(MARKS) + int(losses.argmin())
    finished(best, -1)
    return models[best]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Base and weights of the logistic curve; a feature that would lower the score is left out."""
    if not len(y) or not 0 < y.sum() < len(y):
        return ((2.0 if y.sum() else -2.0), 0.0, 0.0)
    for use in ([0, 1], [1], [0], []):
        w = _logistic(x[:, use], y)
        if (w[1:] >= 0).all():
            break
    out = [float(w[0]), 0.0, 0.0]
    for i, value in zip(use, w[1:], strict=True):
        out[i + 1] = float(value)
    return tuple(out)


def _models(once: DataFrame, docs: np.ndarray) -> list[Model]:
    """Unit scores without each fold and with all, for each mark: FOLDS + 1 times len(MARKS) models."""

    def counted(frames):
        seen = Counter()
        for pdf in frames:
            for text, label, fold in zip(pdf["text"], pdf["label"], pdf["fold"], strict=True):
                seen.update((u, 2 * fold + label) for u in {u for w in set(tokens(text)) for u in units(w)})
        yield pd.DataFrame({"unit": pd.Series([u for u, _ in seen], dtype=object), "part": [p for _, p in seen], "n": list(seen.values())})

    total = docs.sum(axis=0)
    parts = once.mapInPandas(counted, "unit string, part int, n long").groupBy("unit")
    counts = parts.agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).cast("double").alias(f"p{p}") for p in range(2 * FOLDS)])
    n0, n1 = ("(" + " + ".join(f"p{p}" for p in range(i, 2 * FOLDS, 2)) + ")" for i in (0, 1))
    prior = f"(0.5D + ({n0} + {n1}) * {float(PRIOR / max(total.sum(), 1))!r}D)"
    odds = [f"ln(({n} + {prior}) / greatest({t + PRIOR + 1!r}D - {n} - {prior}, 0.5D))" for n, t in ((n0, total[0].item()), (n1, total[1].item()))]
    error = f"sqrt(1 / ({n0} + {prior}) + 1 / ({n1} + {prior}))"
    # Units far from every mark are of no fold's model, but for chance.
    near = counts.filter(f"{n0} + {n1} >= {LEAST} and abs({odds[1]} - {odds[0]}) >= {min(MARKS) - 0.5} * {error}").orderBy("unit").toPandas()
    names, held = near["unit"].to_numpy(), near.drop(columns="unit").to_numpy(float).reshape(-1, FOLDS, 2)
    models = []
    for fold in [*range(FOLDS), None]:
        own, of = held.sum(axis=1), total
        if fold is not None:
            own, of = own - held[:, fold], total - docs[fold]
        delta, errors = log_odds(own[:, 0], own[:, 1], *of)
        for mark in MARKS:
            clear = (np.abs(errors) >= mark) & (own.sum(axis=1) >= LEAST)
            models.append(Model(dict(zip(names[clear], zip(delta[clear].tolist(), np.abs(errors[clear]).tolist(), strict=True), strict=True))))
    return models


class _Scores:
    """Scores of a token in several models at once; most tokens have none in any."""

    def __init__(self, models: list[Model]):
        self.models, self.every = models, set().union(*(m.units for m in models))
        self.known: dict[str, tuple] = {}

    def __call__(self, token: str) -> tuple:
        """(model, score) of each model that has one."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = ()
            if not self.every.isdisjoint(units(token)):
                found = tuple((i, s) for i, m in enumerate(self.models) if (s := m.score(token)) is not None)
            self.known[token] = found
        return found


def _drifts(once: DataFrame, models: list[Model]) -> None:
    """Set drift and rate of each model by how often ordinary text shows its scores."""

    def shown(frames):
        total, seen, scores = 0, Counter(), _Scores(models)
        for pdf in frames:
            for text in pdf["text"]:
                words = tokens(text)
                total += len(words)
                for word in words:
                    if found := scores(word):
                        seen.update(found)
        rows = [(-1, 0.0, total), *((i, s, n) for (i, s), n in seen.items())]
        yield pd.DataFrame(rows, columns=["model", "score", "n"])

    ordinary = once.filter("label = 0").select("text").mapInPandas(shown, "model int, score double, n long")
    counts = ordinary.groupBy("model", "score").agg(F.sum("n").alias("n")).orderBy("model", "score").toPandas()
    total = max(float(counts["n"][counts["model"] == -1].sum()), 1.0)
    for i, model in enumerate(models):
        own = counts[counts["model"] == i]
        values, weights = own["score"].to_numpy(), own["n"].to_numpy(float) / total
        model.drift = min(-0.05, -2 * float(weights @ np.maximum(values, 0)))
        if len(values):
            model.rate = _rate(np.append(values, model.drift), np.append(weights, max(1 - weights.sum(), 0)))


def _best_segments(once: DataFrame, models: list[Model]) -> pd.DataFrame:
    """label, fold, n (tokens) and the sums of the segments of each model, for each document."""

    def best(frames):
        scores = _Scores(models)
        for pdf in frames:
            words, sums = [tokens(t) for t in pdf["text"]], []
            for text in words:
                own: list[list] = [[] for _ in models]
                for at, word in enumerate(text):
                    for i, score in scores(word):
                        own[i].append((at, score))
                sums.append([[s for _, _, s in m.segments_of(x)] for m, x in zip(models, own, strict=True)])
            yield pd.DataFrame({"label": pdf["label"], "fold": pdf["fold"], "n": [len(w) for w in words], "sums": sums})

    return once.mapInPandas(best, "label int, fold int, n int, sums array<array<double>>").toPandas()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, segments (begin and end token, sum, evidence) for each row of docs (doc_id, text).

    Null, empty and wordless texts have no segments and the score of no evidence. Whole texts
    are read; rows and repeated rows are scored one by one, ids are passed through.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        for pdf in frames:
            scores, segments = [], []
            for text in pdf["text"]:
                evidence, density, strong = m.features(tokens(text))
                scores.append(m.probability(evidence, density))
                segments.append([{"begin": b, "end": e, "sum": s, "evidence": v} for b, e, s, v in strong])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "segments": segments})

    schema = "doc_id long, score double, segments array<struct<begin: int, end: int, sum: double, evidence: double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)
