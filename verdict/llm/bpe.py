"""Byte-level BPE, encoded and decoded by DuckDB queries inside each partition.

A text is cut by the tokenizer's pattern. Distinct pieces that are a token themselves are that token. The others
start as one row for each byte; a recursive query joins neighbouring tokens with the merge table and contracts,
in every piece, the leftmost pair of least rank, until no piece has a pair left. Pieces are short as a rule, and
one pair at a time is quick. In a piece of over ``LONG`` bytes one step contracts all places of the pair of least
rank at once, from the left and without overlap, where that gives the same: no pair that holds the new token may
rank below it. Such a query runs in strides, so that the rows it gathers stay bounded. Ordered aggregation turns rows
into ids, and, in decoding, the bytes of tokens into texts.

Each worker remembers up to ``KNOWN`` pieces, a bound on memory that changes no result. Null texts count as empty.
Whole texts are read; rows are worked on one by one, so repeated rows, ids and further columns do no harm.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import small_batches, text_slices

#: Bytes of a piece from which all places of a pair are contracted in one step.
LONG = 64
#: Pieces a worker remembers.
KNOWN = 600_000
#: Bytes of text at once, pieces learned at once, tokens decoded at once, rows of a stride.
CHUNK, PIECES, TOKENS, ROWS = 4_000_000, 200_000, 1_000_000, 8_000_000

#: The white space of Unicode.
_SPACE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_SHORT = """
WITH RECURSIVE state AS (
  SELECT piece, list(id ORDER BY pos) AS ids, 0 AS step FROM start GROUP BY piece
  UNION ALL
  SELECT state.piece, ids[:place - 1] || [merged] || ids[place + 2:], step + 1
  FROM state JOIN (
    SELECT piece, CAST(min(m * 4294967296 + pos) >> 32 AS INTEGER) AS merged, min(m * 4294967296 + pos) & 4294967295 AS place
    FROM (SELECT piece, generate_subscripts(ids, 1) AS pos, unnest(ids) AS id, unnest(ids[2:]) AS next FROM state)
    JOIN merges ON l = id AND r = next GROUP BY piece) AS found USING (piece))
SELECT piece, arg_max(ids, step) AS ids FROM state GROUP BY piece
"""

_LONG = """
WITH RECURSIVE state AS (
  SELECT piece, pos, id, 0 AS step FROM start
  UNION ALL
  SELECT piece, pos, CASE WHEN hit THEN CAST(best AS INTEGER) ELSE id END, step + 1
  FROM (
    SELECT *, lag(hit) OVER (PARTITION BY piece ORDER BY pos) AS gone
    FROM (
      SELECT piece, pos, id, step, best, coalesce(m = best, false) AND (closed OR pos = first)
          AND row_number() OVER (PARTITION BY piece, coalesce(m = best, false), run ORDER BY pos) % 2 = 1 AS hit
      FROM (
        SELECT *, min(pos) FILTER (m = best) OVER (PARTITION BY piece) AS first,
          k - row_number() OVER (PARTITION BY piece, coalesce(m = best, false) ORDER BY pos) AS run
        FROM (
          SELECT piece, pos, id, step, k, m, closed, min(m) OVER (PARTITION BY piece) AS best
          FROM (
            SELECT *, lead(id) OVER w AS next, row_number() OVER w AS k FROM state WHERE step < ? WINDOW w AS (PARTITION BY piece ORDER BY pos))
          LEFT JOIN merges ON l = id AND r = next)
        WHERE best IS NOT NULL)))
  WHERE gone IS NOT true)
SELECT piece, pos, id, step FROM state QUALIFY step = max(step) OVER (PARTITION BY piece)
"""


class Coder:
    """The tables of one vocabulary in a DuckDB of this process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.cut, self.letter, self.blank = regex.compile(pattern), regex.compile(r"\p{L}"), regex.compile(r"\s+")
        # Where all parts are endings or runs that a blank may lead, DuckDB cuts without the look-ahead, and white space
        # before other text is set right after it.
        head, look, tail = pattern.partition(r"\s+(?!\S)|")
        plain = look and tail == r"\s+" and all(regex.fullmatch(r"'[a-z]+| \?(\\p\{\w\}|\[[^\[\]]+\])\+|", part) for part in head.split("|"))
        self.quick = (head + tail).replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]") if plain else None
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        tokens = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())})  # noqa: F841
        pairs = pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["l", "r", "m"])  # noqa: F841
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM tokens")
        self.db.execute("""CREATE TABLE merges AS
            WITH lower AS (SELECT l AS id FROM pairs WHERE m < l UNION SELECT r FROM pairs WHERE m < r)
            SELECT CAST(l AS INTEGER) AS l, CAST(r AS INTEGER) AS r, m, m NOT IN (SELECT id FROM lower) AS closed FROM pairs""")
        self.known: dict[str, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct pieces, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        given = pa.table({"piece": np.arange(len(pieces), dtype=np.int32), "bytes": pa.array(pieces, pa.binary())})  # noqa: F841
        whole = self.db.sql("SELECT piece, id FROM given JOIN tokens USING (bytes)").to_arrow_table()
        for i, word in zip(whole["piece"].to_pylist(), whole["id"].to_numpy().astype("<u4"), strict=True):
            out[i] = word.tobytes()
        rest = [i for i, x in enumerate(out) if not x]
        for wanted, run in (([i for i in rest if len(pieces[i]) <= LONG], self._short), ([i for i in rest if len(pieces[i]) > LONG], self._long)):
            if wanted:
                sizes = np.array([len(pieces[i]) for i in wanted])
                ends = np.cumsum(sizes)
                start = pa.table({
                    "piece": np.repeat(np.array(wanted, np.int32), sizes),
                    "pos": np.arange(ends[-1]) - np.repeat(ends - sizes, sizes),
                    "id": self.first[np.frombuffer(b"".join(pieces[i] for i in wanted), np.uint8)],
                })
                found = run(start)
                ids = found["ids"].combine_chunks()
                flat, at = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
                for i, a, b in zip(found["piece"].to_pylist(), at, at[1:], strict=False):
                    out[i] = flat[a:b]
        return out

    def _short(self, start: pa.Table) -> pa.Table:
        return self.db.sql(_SHORT).to_arrow_table()

    def _long(self, start: pa.Table) -> pa.Table:
        while True:
            stride = max(1, ROWS // start.num_rows)
            start = self.db.sql(_LONG, params=[stride]).select("piece, pos, id, step").to_arrow_table()
            if start["step"].to_numpy().max() < stride:
                return self.db.sql("SELECT piece, list(id ORDER BY pos) AS ids FROM start GROUP BY piece").to_arrow_table()

    def pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The pieces of all texts one after another, as numbers into a list of distinct pieces; where each text begins and ends; that list."""
        if self.quick is None:
            lists = [self.cut.findall(t) if t else [] for t in texts]
            ends, values = np.cumsum([0, *map(len, lists)]), pa.array([p for x in lists for p in x], pa.string())
        else:
            texts = pa.table({"text": pa.array(texts, pa.string()), "row": np.arange(len(texts))})
            found = self.db.sql("SELECT regexp_extract_all(coalesce(text, ''), ?) AS pieces FROM texts ORDER BY row", params=[self.quick]).to_arrow_table()
            lists = found["pieces"].combine_chunks()
            ends = lists.offsets.to_numpy().astype(np.int64)
            values, ends = lists.values[ends[0] : ends[-1]], ends - ends[0]
        coded = values.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        return (codes, ends, distinct) if self.quick is None else self._last_spaces(codes, ends, distinct)

    def _last_spaces(self, codes: np.ndarray, ends: np.ndarray, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """White space before other text keeps all but its last character; a last blank goes to what follows.

        A blank before an ending such as 's takes the apostrophe alone, and the letters run on.
        """
        runs = np.array([len(p) > 1 and p.isspace() and self.blank.fullmatch(p) is not None for p in distinct], bool)
        inside = np.ones(len(codes), bool)
        inside[ends[1:][ends[1:] > ends[:-1]] - 1] = False
        if not runs.any() or not (places := np.flatnonzero(runs[codes] & inside)).size:
            return codes, ends, distinct
        number = {p: i for i, p in enumerate(distinct)}
        code = lambda p: number.setdefault(p, len(number))
        codes, texts, more = codes.copy(), np.searchsorted(ends, places, side="right"), []
        for i, end in zip(places.tolist(), ends[texts].tolist(), strict=True):
            run, after = distinct[codes[i]], distinct[codes[i + 1]]
            codes[i] = code(run[:-1])
            if run[-1] != " ":
                more.append((i + 1, code(run[-1])))
            elif after[0] == "'" and after[1:].isalpha():
                codes[i + 1] = code(" '")
                if i + 2 < end and self.letter.match(distinct[codes[i + 2]]):
                    codes[i + 2] = code(after[1:] + distinct[codes[i + 2]])
                else:
                    more.append((i + 2, code(after[1:])))
            else:
                codes[i + 1] = code(" " + after)
        at = np.array([i for i, _ in more], np.int64)
        return np.insert(codes, at, [c for _, c in more]), ends + np.searchsorted(at, ends, side="right"), list(number)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        codes, ends, distinct = self.pieces(texts)
        self.learn(distinct)
        known = [self.known[p] for p in distinct]
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.array([len(x) // 4 for x in known], np.int64)
        of = sizes[codes]
        upto = np.concatenate(([0], np.cumsum(of)))
        # Each piece's place in flat, repeated for its ids, and counted on inside it.
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - upto[:-1], of) + np.arange(upto[-1])]
        return [ids[a:b] for a, b in zip(upto[ends[:-1]], upto[ends[1:]], strict=True)]

    def learn(self, pieces: list[str]) -> None:
        """Know at least these distinct pieces."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, pieces
        for a in range(0, len(new), PIECES):
            part = new[a : a + PIECES]
            self.known.update(zip(part, self.merged([p.encode() for p in part]), strict=True))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids; ids outside the vocabulary are refused."""
        sizes = np.array([len(x) for x in ids], np.int64)
        row, flat = np.repeat(np.arange(len(ids)), sizes), np.concatenate([np.empty(0, np.uint32), *ids])
        out: list[list[bytes]] = [[] for _ in ids]
        for a in range(0, len(flat), TOKENS):
            piece = pa.table({"text": row[a : a + TOKENS], "pos": np.arange(a, min(a + TOKENS, len(flat))), "id": flat[a : a + TOKENS].astype(np.int64)})  # noqa: F841
            parts = self.db.sql("SELECT text, list(bytes ORDER BY pos) AS parts FROM piece LEFT JOIN tokens USING (id) GROUP BY text ORDER BY text").to_arrow_table()
            lists = parts["parts"].combine_chunks()
            if lists.values.null_count:
                raise ValueError("an id is outside the vocabulary")
            # Tokens lie one after another in the buffer, so a text is a slice of it.
            values = lists.values
            at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
            data, edges = memoryview(values.buffers()[2] or b""), at[lists.offsets.to_numpy()].tolist()
            for i, b, e in zip(parts["text"].to_pylist(), edges, edges[1:], strict=False):
                out[i].append(bytes(data[b:e]))
        return [b"".join(x) for x in out]


@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    """The coder of this worker; tasks that follow one another use it again."""
    return Coder(path, pattern)


def _run(docs: DataFrame, columns: list, schema: str, fields: list[tuple[str, pa.DataType]], work) -> DataFrame:
    """Work on the texts (second column) of Arrow batches, a bounded slice at a time; work gives the columns after the id."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b, values in text_slices(batch.column(1), CHUNK):
                arrays = [batch.column(0)[a:b], *work(values)]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, (_, t) in zip(arrays, fields, strict=True)], [n for n, _ in fields])

    return docs.select(*columns).mapInArrow(run, schema)


def _docs(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the tokens of each text, without special ones."""

    def work(texts):
        ids = coder(path, pattern).encode(texts)
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))]

    return _run(docs, _docs(docs), "doc_id long, ids array<int>", [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))], work)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text binary: the bytes of each row's ids; null ids give none."""
    small_batches(tokens.sparkSession)

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            texts = own.decode([np.array(x or [], np.int64) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode each text, decode its ids, and take digests of both."""

    def work(texts):
        own = coder(path, pattern)
        ids = own.encode(texts)
        digest = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
        return [pa.array(map(len, ids), pa.int64()), digest(x.tobytes() for x in ids), digest(own.decode(ids))]

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _run(docs, _docs(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", fields, work)
