"""Language of each word and document by a linear-chain conditional random field.

A word is a run of letters; in scripts written without spaces every letter is a word of its own.
A word's features are its affixes, all its character n-grams of two and three, and the word itself (the
lexicon), hashed into ``FEATURES`` rows of weights, one column for each language. A learned
matrix scores the transitions between the languages of neighbouring words. Forward-backward
gives every word's probabilities; a document's are their mean.

Training: a bounded sample of documents. A word's label is its document's language. So
that transitions are learned from switches, sequences are joined from stretches of different
documents, ``STRETCH`` words each. Every language of the labels is learned. The gradient of the
log-likelihood is exact, summed over blocks of sequences; steps are Adam's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import give_back, mix, slices

#: Documents of a language a model is fitted on at most, those of least hash of their id.
SAMPLE = 150
FEATURES = 1 << 15
STRETCH = 40
#: Stretches of a document at most, drawn from its whole text.
STRETCHES = 20
STEPS = 25
#: Letters of words, marks included, whose features are made at once; a longer word is made alone.
PART = 260_000
#: Characters worked on at once inside a task, words times languages worked on at once there
#: and in fitting, and weights summed at once.
CHUNK = 2_000_000
CELLS = 1_600_000
FITTED = 4_000_000
SUMMED = 4_000_000
#: Word scores a task remembers, fewer where there are more than four languages, and letters of a remembered word at most.
REMEMBERED = 80_000
REMEMBERED_LETTERS = 64

#: Scripts written without spaces: Thai, Lao, Burmese, Khmer, Tai, Balinese, Javanese, kana, bopomofo, Han, Yi.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\ua4cf\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff"
)
_WORD = re.compile(rf"[^\W\d_{_UNSPACED}]+|(?=[^\W\d_])[{_UNSPACED}]")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights of each word, word after word, and how many a word has."""
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(length) - length
    sizes = 2 * length + 2
    begin = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(c)) - start[word]

    def gram(chars: list[np.ndarray], salt: int) -> np.ndarray:
        h = np.full(chars[0].shape, salt, np.uint64)
        for x in chars:
            h = mix(h ^ x)
        return h

    first = [c[start + k] for k in range(3)]
    fourth = np.where(length > 3, c[start + np.minimum(3, length - 1)], np.uint64(0))
    last = [c[start + np.maximum(length - k, 0)] for k in (4, 3, 2, 1)]
    hashes = np.empty(int(sizes.sum()), np.uint64)
    hashes[begin] = mix(np.add.reduceat(mix(mix(place.astype(np.uint64)) ^ c), start) ^ np.uint64(1))
    for k, (salt, chars) in enumerate(((2, first), (3, [*first, fourth]), (4, last[1:]), (5, last)), 1):
        hashes[begin + k] = gram(chars, salt)
    at = np.flatnonzero(place + 1 < length[word])
    hashes[begin[word[at]] + 5 + place[at]] = gram([c[at], c[at + 1]], 6)
    at = np.flatnonzero(place + 2 < length[word])
    hashes[begin[word[at]] + 4 + length[word[at]] + place[at]] = gram([c[at], c[at + 1], c[at + 2]], 7)
    return (hashes % np.uint64(FEATURES)).astype(np.int32), sizes


def parts_of(words: list[str]):
    """Stretches of words of at most PART letters, or single words."""
    for a, b in slices(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)), PART):
        yield words[a:b]


class Lexicon:
    """Feature rows of distinct words, to be summed by word."""

    def __init__(self, words: list[str]):
        parts = [features(part) for part in parts_of(words)] or [(np.empty(0, np.int32), np.empty(0, np.int64))]
        self.rows, self.sizes = (np.concatenate(x) for x in zip(*parts, strict=True))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.sizes), weights.shape[1]))
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        step = max(1, SUMMED // max(1, weights.shape[1]))
        for i in range(0, len(word), step):
            part = word[i : i + step]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            out[part[first]] += np.add.reduceat(weights[self.rows[i : i + step]], first, axis=0)
        return out / np.sqrt(self.sizes)[:, None]

    def gradient(self, by_word: np.ndarray) -> np.ndarray:
        each = by_word / np.sqrt(self.sizes)[:, None]
        return np.stack([np.bincount(self.rows, np.repeat(each[:, k], self.sizes), FEATURES) for k in range(by_word.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Probabilities of every word's label; sequences lie one after the other, ``sizes`` words each.

    All sequences take a step at a time together, the longest first, so that those still running
    are a prefix. With pairs also the expected number of each transition, and the likelihood.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max(initial=0))
    running = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores
    emit, move = np.exp(scores - top), np.exp(transitions)
    alpha, scale = np.empty_like(emit), np.ones(len(emit))
    for t in range(longest):
        at = starts[: running[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    beta = np.ones_like(emit)
    expected = np.zeros_like(move)
    for t in range(longest - 2, -1, -1):
        at = starts[: running[t + 1]] + t
        ahead = emit[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        if pairs:
            expected += (alpha[at].T @ ahead) * move
        beta[at] = ahead @ move.T
    marginal = alpha * beta
    if not pairs:
        return marginal
    return marginal, expected, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    """Languages, feature weights and transitions."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def marginals(self, docs: list[list[str]], known: dict | None = None) -> list[np.ndarray]:
        """For each document its words' probabilities, one row a word. known remembers word scores between calls."""
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.empty(int(sizes.sum()), dtype=object)
        flat[:] = [w for d in docs for w in d]
        codes, kinds = pd.factorize(flat)
        known = {} if known is None else known
        new = [w for w in kinds if w not in known]
        fresh: dict = {}
        for part in parts_of(new):
            fresh.update(zip(part, Lexicon(part).scores(self.weights).astype(np.float32), strict=True))
        if (len(known) + len(fresh)) * max(4, len(self.languages)) <= 4 * REMEMBERED:
            known.update((w, x) for w, x in fresh.items() if len(w) <= REMEMBERED_LETTERS)
        table = np.array([fresh[w] if w in fresh else known[w] for w in kinds], np.float32).reshape(len(kinds), len(self.languages))
        return np.split(forward_backward(table[codes].astype(np.float64), sizes, self.transitions), np.cumsum(sizes)[:-1])


def fit(labelled: DataFrame) -> Model:
    """A model from rows (id, text, lang). Null texts and languages, and texts without letters, are ignored."""
    rows = labelled.filter("text is not null and lang is not null and text rlike '\\\\p{L}'").withColumn("h", F.xxhash64("id"))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toPandas()
    languages = sorted(per["lang"])
    rng = np.random.default_rng(5)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((0, 0)))
    # A hash mark of its own for each language keeps about SAMPLE rows, with a margin; then the least are taken.
    marks = [(lang, min(int((min(1.0, 2 * SAMPLE / n) - 0.5) * 2**64), 2**63 - 1)) for lang, n in zip(per["lang"], per["n"], strict=True)]
    # One row for each language.
    mark = F.broadcast(labelled.sparkSession.createDataFrame(marks, "lang string, mark long"))
    ranked = rows.join(mark, "lang").filter("h <= mark").select("lang", "text", "h").withColumn("r", F.expr("row_number() over (partition by lang order by h)"))
    sample = ranked.filter(F.col("r") <= SAMPLE).orderBy("lang", "r").select("lang", "text").toPandas()
    place = {lang: k for k, lang in enumerate(languages)}
    parts = []
    for lang, text in zip(sample["lang"], sample["text"], strict=True):
        ws, k = words_of(text), place[lang]
        starts = np.arange(0, len(ws), STRETCH)
        parts += [(k, ws[i : i + STRETCH]) for i in rng.permutation(starts)[:STRETCHES]]
    parts = [parts[i] for i in rng.permutation(len(parts))]
    joined = [parts[i : i + 6] for i in range(0, len(parts), 6)]
    lengths = np.array([sum(len(ws) for _, ws in sequence) for sequence in joined], np.int64)
    blocks = [_Block(joined[i:j], len(languages)) for i, j in slices(lengths, max(1, FITTED // len(languages)))]
    total = int(lengths.sum())
    seen = sum(block.seen for block in blocks)
    w, a = np.zeros((FEATURES, len(languages))), np.zeros((len(languages),) * 2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, a)]
    for step in range(1, (STEPS if blocks else 0) + 1):
        of_words, expected = blocks[0].gradient(w, a)
        for block in blocks[1:]:
            more, pairs = block.gradient(w, a)
            of_words += more
            expected += pairs
        for x, grad, (m, v) in ((w, of_words / total + 1e-6 * w, moments[0]), (a, (expected - seen) / total, moments[1])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(languages, w, a)


class _Block:
    """Sequences of stretches (label, words) whose share of the gradient is made at once."""

    def __init__(self, sequences: list[list[tuple[int, list[str]]]], languages: int):
        self.labels = np.array([k for sequence in sequences for k, ws in sequence for _ in ws])
        flat = np.empty(len(self.labels), dtype=object)
        flat[:] = [w for sequence in sequences for _, ws in sequence for w in ws]
        self.codes, kinds = pd.factorize(flat)
        self.lexicon = Lexicon(list(kinds))
        self.sizes = np.array([sum(len(ws) for _, ws in sequence) for sequence in sequences])
        inside = np.ones(len(self.labels), bool)
        inside[np.cumsum(self.sizes) - self.sizes] = False
        self.seen = np.zeros((languages,) * 2)
        np.add.at(self.seen, (self.labels[np.flatnonzero(inside) - 1], self.labels[inside]), 1)

    def gradient(self, w: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By feature and language, and the expected number of each transition."""
        error, expected, _ = forward_backward(self.lexicon.scores(w)[self.codes], self.sizes, a, pairs=True)
        error[np.arange(len(error)), self.labels] -= 1
        by_word = np.stack([np.bincount(self.codes, error[:, k], len(self.lexicon.sizes)) for k in range(len(a))], axis=1)
        return self.lexicon.gradient(by_word), expected


def predict(model: Model, texts: list[str | None], known: dict) -> list[tuple[str, float, dict, float]]:
    """Language, score and words by language of each text, see label_documents, and the mean of its words' greatest probabilities."""
    out = []
    units = CELLS // max(1, len(model.languages))
    for docs in _together(texts if model.languages else [None] * len(texts), units):
        for p in model.marginals(docs, known) if model.languages else [()] * len(docs):
            if not len(p):
                out.append(("und", 0.0, {}, 0.0))
                continue
            mean = p.mean(axis=0)
            k = int(mean.argmax())
            counts = np.bincount(p.argmax(axis=1), minlength=len(mean))
            out.append((model.languages[k], float(min(mean[k], 1.0)), {model.languages[i]: int(c) for i, c in enumerate(counts) if c}, float(p.max(axis=1).mean())))
    return out


def _together(texts: list[str | None], most: int):
    """Words of texts, lists of texts of at most CHUNK characters and ``most`` words, or single texts."""
    docs, chars, units = [], 0, 0
    for text in texts:
        words, n = words_of(text), len(text or "")
        if docs and (chars + n > CHUNK or units + len(words) > most):
            yield docs
            docs, chars, units = [], 0, 0
        docs.append(words)
        chars, units = chars + n, units + len(words)
    if docs:
        yield docs


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, words (a count for each language, by its most probable words).

    lang_pred is the language with the greatest mean probability over the words, score is that
    mean. Null texts and texts without a letter give ``und`` with score 0, as do all texts where
    no language was learned. Ties go to the first language by name. Rows are labelled one by
    one, repeated rows too; ids are passed through.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(frames):
        known = {}
        for pdf in frames:
            langs, scores, words, _ = zip(*predict(shared.value, pdf["text"].to_list(), known), strict=True) if len(pdf) else ((), (), (), ())
            give_back()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": pd.Series(langs, dtype=object), "score": scores, "words": pd.Series(words, dtype=object)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, lang_pred string, score double, words map<string, int>")
