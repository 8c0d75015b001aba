"""Ranked lexical search with range-maximum tables over posting lists.

Index: documents are cut, where they are read, into shards of at most ``SHARD`` bytes of text or ``MOST`` documents (a
longer text is a shard of its own). A shard has one row for each of its terms, with the places of the
documents that hold it and how often, and one row without term for ids and lengths. Inside a shard
documents stand in the order of their most frequent term, so that those of a language are neighbours.

Search: a term's impact in a document is a whole number. For each shard and block of items, the posting lists of the
items' terms meet. Over each list lies a sparse table of the places of greatest impact, so that the greatest
impact of a term in any interval of documents takes two look-ups. Their sum over an item's terms
bounds every score in the interval. Intervals wait in the order of their bounds; the best are split at the document
where the weightiest term has its greatest impact, that document is scored (its bound as an interval of one is
exact), and the two sides are bounded anew. The search ends when no bound reaches the k-th best score. Some shards, a
bounded number, are searched first; their k-th best scores are where the others begin, which loses nothing.
Best documents of the shards are merged by a windowed rank.

Sizes: an item-term row meets one posting row of each shard, so no term gathers in one task: the items'
terms are broadcast where they are at most ``BROADCAST`` rows, else joined with terms salted by shard.

Defined cases: null texts and texts without term count as no document; items without term find none. Repeated rows are
documents of their own, equal scores go by doc_id, null ids last. Repeated item ids are items of their own,
each with its ranks. Only doc_id, text and item_id are read. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import small_batches, stored, text_slices

SHARD, MOST = 6_000_000, 8_192
#: Items searched together in a shard.
ITEMS = 256
#: Item-term rows that are broadcast at most.
BROADCAST = 200_000
SALTS = 32
#: Shards searched first.
SEEDS = 16
#: Intervals split in one step.
STEP = 48

#: Everything below 128 but digits and letters separates; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def postings(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; where each one's postings begin; documents and counts of the postings; lengths of the documents, and their order.

    Documents are numbered by their place in that order.
    """
    words = [terms(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    coded = pa.array([w for one in words for w in one], pa.binary()).dictionary_encode()
    del words
    keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), lengths)
    keys, counts = np.unique(keys, return_counts=True)
    code, doc = np.divmod(keys, max(len(texts), 1))
    top = np.full(len(texts), -1)
    by_count = np.argsort(counts, kind="stable")
    top[doc[by_count]] = code[by_count]
    order = np.lexsort((lengths, top))
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    again = np.lexsort((place[doc], code))
    return coded.dictionary, np.searchsorted(code, np.arange(len(coded.dictionary) + 1)), place[doc[again]], counts[again], lengths, order


_INDEX = "shard long, term string, docs array<int>, counts array<int>, ids array<long>, lengths array<int>"


def index(docs: DataFrame) -> DataFrame:
    """The posting rows and the document rows of all shards, stored."""
    small_batches(docs.sparkSession)
    ints = lambda starts, values: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))

    def build(batches):
        context, n = TaskContext.get(), 0
        first = (context.partitionId() if context else 0) << 32

        def shard(ids: pa.Array, texts: list) -> pa.RecordBatch:
            words, starts, places, counts, lengths, order = postings(texts)
            own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
            none = lambda n, kind: pa.nulls(n, pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + n] * (len(words) + 1), pa.int64()),
                    pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())]),
                    pa.concat_arrays([ints(starts, places), none(1, pa.int32())]),
                    pa.concat_arrays([ints(starts, counts), none(1, pa.int32())]),
                    pa.concat_arrays([none(len(words), pa.int64()), own]),
                    pa.concat_arrays([none(len(words), pa.int32()), ints([0, len(ids)], lengths[order])]),
                ],
                [field.split()[0] for field in _INDEX.split(", ")],
            )

        ids, texts, size = [], [], 0
        for batch in batches:
            for a, b, some in text_slices(batch.column(1), SHARD):
                more = sum(len(t) for t in some if t)
                if texts and (size + more > SHARD or len(texts) + len(some) > MOST):
                    yield shard(pa.concat_arrays(ids), texts)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(batch.column(0)[a:b])
                texts += some
                size += more
        if texts:
            yield shard(pa.concat_arrays(ids), texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(build, _INDEX), "ranked")


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of its own for each row), item_id, term, times: the terms of each item, stored."""

    def count(batches):
        for batch in batches:
            out = []
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: dict[bytes, int] = {}
                for w in terms(text):
                    seen[w] = seen.get(w, 0) + 1
                out += [(item, item_id, w.decode(), n) for w, n in seen.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "item_id", "term", "times"), r, strict=True)) for r in out], schema)

    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.string()), ("times", pa.int64())])
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(count, "item long, item_id long, term string, times long"), "items")


class Lists:
    """Posting lists laid end to end: documents, impacts, and a sparse table of the places of greatest impact."""

    def __init__(self, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        self.n, self.docs = n_docs, docs
        self.impacts = np.append(impacts, 0)
        self.keys = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * np.int64(n_docs + 1) + docs
        longest = int(np.diff(starts).max(initial=1))
        self.levels = [np.arange(len(docs))]
        while 2 << (len(self.levels) - 1) <= longest:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            right = np.append(last[step:], np.full(min(step, len(last)), len(docs)))
            self.levels.append(np.where(self.impacts[right] > self.impacts[last], right, last))
        self.table = np.stack(self.levels).astype(np.int32)
        self.log = np.maximum(np.frexp(np.arange(longest + 1))[1] - 1, 0)

    def greatest(self, lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the greatest impact of each list in each interval of documents [low, high); the end of all places where there is none."""
        base = lists[:, None] * np.int64(self.n + 1)
        a, b = np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)
        size = b - a
        level = self.log[size]
        last = len(self.docs) - 1
        left, right = self.table[level, np.minimum(a, last)], self.table[level, np.clip(b - (1 << level), 0, last)]
        best = np.where(self.impacts[right] > self.impacts[left], right, left)
        return np.where(size > 0, best, len(self.docs))

    def search(self, lists: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is at least ``least`` and among the k best (all that tie with the last), and their scores."""

        def bounds(low, high):
            places = self.greatest(lists, low, high)
            weights = self.impacts[places] * times[:, None]
            top = places[weights.argmax(axis=0), np.arange(len(low))]
            return weights.sum(axis=0), top

        low, high = np.array([0]), np.array([self.n])
        bound, top = bounds(low, high)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while True:
            open_ = bound >= least
            low, high, bound, top = low[open_], high[open_], bound[open_], top[open_]
            if not len(low):
                return docs, scores
            if len(low) > STEP:
                now = np.zeros(len(low), bool)
                now[np.argpartition(-bound, STEP)[:STEP]] = True
            else:
                now = np.ones(len(low), bool)
            split = self.docs[top[now]]
            sides = np.concatenate((low[now], split + 1, split)), np.concatenate((split, high[now], split + 1))
            some = sides[0] < sides[1]
            new, tops = bounds(sides[0][some], sides[1][some])
            one = np.zeros(len(some), bool)
            one[2 * len(split) :] = True
            one = one[some]
            docs, scores = np.append(docs, sides[0][some][one]), np.append(scores, new[one])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                docs, scores = docs[keep], scores[keep]
            rest = ~now
            low, high = np.append(low[rest], sides[0][some][~one]), np.append(high[rest], sides[1][some][~one])
            bound, top = np.append(bound[rest], new[~one]), np.append(top[rest], tops[~one])


def search(index_rows: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items (item_id, text)."""
    documents = index_rows.filter("term is null").select("shard", "ids", "lengths")
    lists = index_rows.filter("term is not null").select("shard", "term", "docs", "counts")
    sums = documents.selectExpr("cast(size(filter(lengths, n -> n > 0)) as long) n", "aggregate(lengths, 0L, (a, n) -> a + n) l")
    n_docs, n_terms = sums.agg(F.sum("n"), F.sum("l")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    asked = item_terms(items)
    n_asked = asked.count()
    blocks = max(1, -(-asked.select("item").distinct().count() // ITEMS))

    words = asked.select("term").distinct()
    small = n_asked <= BROADCAST
    found = lists.join(F.broadcast(words) if small else words, "term", "left_semi")
    frequency = found.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    wanted = asked.join(frequency.select("term", weight.alias("w")), "term").select("term", "w", block, "item", "item_id", "times")
    wanted = stored(wanted.groupBy("term", "w", "block").agg(F.collect_list(F.struct("item", "item_id", "times")).alias("asking")), "wanted")

    def ranked(rows: DataFrame, heads: DataFrame, least: DataFrame | None) -> DataFrame:
        """item, item_id, doc_id, score of candidates in these shards."""
        if small:
            met = rows.join(F.broadcast(wanted), "term")
        else:
            salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = rows.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
        met = met.select("shard", "block", "w", "asking", "docs", "counts", F.expr("cast(null as array<long>)").alias("ids"), F.expr("cast(null as array<int>)").alias("lengths"))
        none = "cast(null as array<int>)"
        heads = heads.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ids", "lengths")
        heads = heads.selectExpr("shard", "block", "cast(null as long) w", "cast(null as array<struct<item: long, item_id: long, times: long>>) asking", f"{none} docs", f"{none} counts", "ids", "lengths")
        begins = spark.sparkContext.broadcast({r["item"]: r["least"] for r in least.collect()} if least is not None else {})

        def run(table: pa.Table) -> pa.Table:
            return _search_shard(table, n_docs, n_terms, k, begins.value)

        schema = "item long, item_id long, doc_id long, score long"
        return met.unionByName(heads).groupBy("shard", "block").applyInArrow(run, schema)

    spark = index_rows.sparkSession
    every = documents.select("shard")
    seeds = F.broadcast(every.orderBy(F.xxhash64("shard"), "shard").limit(SEEDS))
    by_score = "row_number() over (partition by item order by score desc, doc_id nulls last)"
    first = stored(ranked(lists.join(seeds, "shard", "left_semi"), documents.join(seeds, "shard", "left_semi"), None), "first")
    place = first.withColumn("place", F.expr(by_score)).filter(F.col("place") <= k)
    # Only k-th scores start a search; they are one number for each item of at most BROADCAST item-term rows.
    least = place.filter(F.col("place") == k).select("item", F.col("score").alias("least")) if small else None
    rest = ranked(lists.join(seeds, "shard", "left_anti"), documents.join(seeds, "shard", "left_anti"), least)
    merged = first.unionByName(rest).withColumn("rank", F.expr(f"cast({by_score} as int)")).filter(F.col("rank") <= k)
    return merged.select("item_id", "rank", "doc_id", "score")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists of a column, and their values one after another."""
    return pc.list_value_length(column).to_numpy(), pc.list_flatten(column).to_numpy()


def _search_shard(table: pa.Table, n_docs: int, n_terms: int, k: int, begins: dict[int, int]) -> pa.Table:
    out = {"item": [], "item_id": [], "doc_id": [], "score": []}
    head = table.filter(pc.is_valid(table["ids"]))
    table = table.filter(pc.is_valid(table["asking"]))
    if head.num_rows and table.num_rows:
        lengths = _flat(head["lengths"])[1].astype(np.int64)
        ids = pc.list_flatten(head["ids"]).combine_chunks()
        sizes, docs = _flat(table["docs"])
        counts = _flat(table["counts"])[1].astype(np.int64)
        weights = np.repeat(table["w"].to_numpy(), sizes)
        spread = 100 - 25 + (25 * lengths * n_docs) // max(n_terms, 1)
        impacts = weights * ((1_000_000_000 * counts) // (1000 * counts + 12 * spread[docs]))
        lists = Lists(np.concatenate(([0], np.cumsum(sizes))), docs.astype(np.int64), impacts, len(lengths))
        number = np.repeat(np.arange(table.num_rows), pc.list_value_length(table["asking"]).to_numpy())
        asking = pc.list_flatten(table["asking"]).combine_chunks()
        item, times, item_id = (asking.field(name) for name in ("item", "times", "item_id"))
        item, times, item_id = item.to_numpy(), times.to_numpy(), item_id.to_pylist()
        order = np.argsort(item, kind="stable")
        edges = np.concatenate((np.flatnonzero(np.diff(item[order], prepend=item[order[0]] - 1)), [len(order)]))
        for a, b in zip(edges, edges[1:], strict=False):
            some = order[a:b]
            one = int(item[some[0]])
            found, scores = lists.search(number[some], times[some], k, max(1, begins.get(one, 1)))
            names = ids.take(pa.array(found)).to_pylist()
            best = sorted(zip((-scores).tolist(), names, strict=True), key=lambda x: (x[0], x[1] is None, x[1] or 0))[:k]
            out["item"] += [one] * len(best)
            out["item_id"] += [item_id[some[0]]] * len(best)
            out["doc_id"] += [name for _, name in best]
            out["score"] += [-score for score, _ in best]
    return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})
