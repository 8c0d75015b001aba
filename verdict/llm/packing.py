"""Packing documents into sequences along a Hilbert curve.

A document's words are hashed into ``BUCKETS`` buckets; a fixed random sign matrix projects the
counts to ``DIMENSIONS`` numbers, which are squashed to a grid and give the document's place on the
Hilbert curve. Documents are sorted by range along the curve, ties by id, laid end to end, and cut
where a sequence is full. So only the very last sequence needs padding, neighbours in a sequence
are neighbours on the curve, and equal documents, however many, spread over ranges by their ids.

Only (place, id, number of tokens) is sorted. Running sums inside the ranges and one row a range
give every document its offset; the tokens, written once as 16-bit ids, are joined to it by
a hash of the row. White space never lies inside a token of the vocabulary, so texts are encoded by
distinct words between white space; frequent words are remembered.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import mix, names, stored, text_parts

LENGTH = 4_096
END = 2
BUCKETS = 1 << 16
DIMENSIONS = 3
GRID_BITS = 10
#: Bytes of text worked on at once inside a task, and parts of words a worker remembers.
CHUNK = 7_000_000
REMEMBERED = 700_000

_SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)(?P<marks>[.,!?;:|&*#$%()-]*)\z"
_TOKENS = "doc_id long, n long, place long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Distances along the Hilbert curve of integer points, one row each, of ``bits`` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t = np.where(x[n - 1] & (1 << level), t ^ ((1 << level) - 1), t)
    x ^= t
    out = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def projection() -> np.ndarray:
    """A sign for each bucket and dimension."""
    return np.stack([(mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(d << 32)) >> np.uint64(63)).astype(np.int8) * 2 - 1 for d in range(DIMENSIONS)], axis=1)


class Pool:
    """Entries of ids (16 bits each) laid end to end, each with a hash bucket, found by their text."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint16)
        self.ends, self.buckets = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def add(self, texts: list[str], ids: list[bytes]) -> None:
        n, used = len(self.number), int(self.ends[len(self.number)])
        ends = used + np.cumsum(np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids)))
        while len(self.ends) < n + len(ids) + 1:
            self.ends, self.buckets = (np.concatenate((x, np.zeros_like(x))) for x in (self.ends, self.buckets))
        last = int(ends[-1]) if len(ids) else used
        while len(self.ids) < last:
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[used:last] = np.frombuffer(b"".join(ids), np.uint16)
        self.ends[n + 1 : n + 1 + len(ids)] = ends
        self.buckets[n : n + len(ids)] = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in texts), np.int64, len(texts))
        self.number.update(zip(texts, range(n, n + len(texts)), strict=True))


def gather(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the pool one after another, and where each begins in that."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat((begin - upto[:-1]).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return pool[at], upto


class Encoder:
    """Ids and hash buckets of words between white space; letters of a word and the marks behind them are remembered apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [k for word, k in self.tokenizer.get_vocab().items() if word.endswith("</w>")]
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[ends] = True
        self.known = Pool()
        self.signs = projection()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.uint16).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters only, encoded together and cut at the tokens that end a word."""
        out = []
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint16)
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(group) and len(ids) == (cuts[-1] if len(cuts) else 0):
                data, starts = ids.tobytes(), [0, *(2 * cuts).tolist()]
                out += [data[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            else:
                out += self.encode(group)
        return out

    def numbers(self, texts: pa.Array, encode) -> np.ndarray:
        """Entries of distinct texts; those not known are encoded and remembered."""
        texts, known = texts.to_pylist(), self.known.number
        new = [t for t in texts if t not in known]
        self.known.add(new, encode(new))
        return np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))

    def look_up(self, words: pa.Array, remembered: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these distinct words one after another, where each begins and the last ends, and their hash buckets."""
        if len(self.known.number) > (REMEMBERED if remembered is None else remembered):
            self.known = Pool()
        parts = pc.extract_regex(words, _SIMPLE)
        simple = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        first, second = np.empty(len(words), np.int64), np.full(len(words), -1)
        for name, into, encode in (("letters", first, self.letters), ("marks", second, self.encode)):
            column = parts.field(name).filter(pa.array(simple))
            coded = (pc.utf8_lower(column) if name == "letters" else column).dictionary_encode()
            into[simple] = self.numbers(coded.dictionary, encode)[coded.indices.to_numpy(zero_copy_only=False)]
        first[~simple] = self.numbers(words.filter(pa.array(~simple)), self.encode)
        pool = self.known
        begin, size = pool.ends[:-1], np.diff(pool.ends)
        both = np.column_stack((first, second)).ravel()
        ids, upto = gather(pool.ids, begin[both], np.where(both >= 0, size[both], 0))
        buckets = pool.buckets[first]
        # Other words are hashed by their lower case.
        buckets[~simple] = [zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS for w in words.filter(pa.array(~simple)).to_pylist()]
        return ids, upto[::2], buckets

    def documents(self, texts: pa.Array, remembered: int | None = None) -> tuple[list[bytes], np.ndarray]:
        """The ids of each text (none is null), with END behind them, and its place on the curve."""
        # Only ASCII white space parts words here; other kinds stay inside a word and are left to the tokenizer.
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values[ends[0] : ends[-1]]
        full = pc.not_equal(pc.binary_length(values), 0)
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[ends - ends[0]]
        coded = values.filter(full).dictionary_encode()
        codes, sizes = coded.indices.to_numpy(zero_copy_only=False), np.diff(ends)
        del lists, values, full
        pool, begin, buckets = self.look_up(coded.dictionary, remembered)
        ids, upto = gather(pool, begin[codes], np.diff(begin)[codes])
        upto = upto[ends]
        sums = np.concatenate((np.zeros((1, DIMENSIONS), np.int32), np.cumsum(self.signs[buckets][codes], axis=0, dtype=np.int32)))[ends]
        spread = np.diff(sums, axis=0) / np.sqrt(np.maximum(sizes, 1))[:, None]
        grid = np.minimum((1 << GRID_BITS) / (1 + np.exp(-np.clip(spread / 3, -30, 30))), (1 << GRID_BITS) - 1)
        last = np.array([END], np.uint16).tobytes()
        return [ids[a:b].tobytes() + last for a, b in zip(upto[:-1], upto[1:], strict=True)], hilbert(grid, GRID_BITS)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, remembered: int | None = None) -> DataFrame:
    """doc_id, n, place, ids (16 bits each, END behind them) for each row of docs (doc_id, text). Null texts are empty.

    path is where the vocabulary's file lies on every machine; without it each machine asks its installed package.
    A worker's memory grows with chunk, the bytes of text it works on at once, and with the parts of words it remembers
    (REMEMBERED unless told otherwise); smaller numbers take more time.
    """

    def run(batches):
        encoder = _encoder(path or vocabulary())
        for batch in batches:
            for a, b, texts in text_parts(batch.column(1), chunk):
                ids, places = encoder.documents(pc.fill_null(texts, ""), remembered)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(places), pa.array(ids, pa.binary())],
                    names=names(_TOKENS),
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENS)


def offsets(tokens: DataFrame) -> DataFrame:
    """(row, position) of each row of tokens (row, doc_id, n, place): tokens laid before it along the curve."""

    def running(frames):
        part, total = TaskContext.get().partitionId(), 0
        for pdf in frames:
            upto = total + pdf["n"].cumsum()
            yield pd.DataFrame({"row": pdf["row"], "part": part, "n": pdf["n"], "before": upto - pdf["n"]})
            total = int(upto.iloc[-1]) if len(upto) else total

    order = ("place", "doc_id", "row")
    ranged = tokens.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)
    local = stored(ranged.mapInPandas(running, "row long, part int, n long, before long"), "ranges")
    # One row a range.
    base = local.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.expr("sum(n) over (order by part) - n")).select("part", "base")
    return local.join(base, "part").select("row", (F.col("base") + F.col("before")).alias("position"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, chunk: int = CHUNK, remembered: int | None = None) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs (doc_id, text, ...) is its own document, repeated rows and rows without id
    too; null and empty texts have the end token only. Sequences are numbered along the
    curve and full but the last, which is padded unless it has a power of two tokens. An empty table
    gives no pieces. Other columns are not read.
    """
    tokens = stored(encoded(docs, path, chunk, remembered).withColumn("row", F.monotonically_increasing_id()), "tokens")
    placed = tokens.select("row", "doc_id", "n", "ids").join(offsets(tokens), "row").select("doc_id", "n", "ids", "position")

    def cut(batches):
        for batch in batches:
            out = []
            for doc, n, ids, position in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                whole = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < n:
                    at = position + start
                    end = min(n, start + length - at % length)
                    out.append((doc, start, end - start, zlib.crc32(whole[start:end]), n, at // length, at % length))
                    start = end
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names(_PIECES))

    return placed.mapInArrow(cut, _PIECES)
