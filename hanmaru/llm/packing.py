"""Filling fixed-capacity containers with items by lexical retrieval.

Documents are spread by a hash of their id over shards of bounded size. Each shard holds a BM25 inverted index, weighted with
the document frequencies of the whole corpus. The largest unused document opens a container; its unused neighbours in the
index, best first, fill it greedily; what room is left then goes to the largest unused documents that fit.
A shard is bounded by its tokens, and seeds share no shard: neighbours are looked for among the shard's documents, which are a
hash sample of the corpus, not among all.
"""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanmaru.llm.pairing import spread
from hanmaru.llm.tokens import VOCABULARY_SIZE, token_sizes
from hanmaru.session import write_through

COLUMNS = ("pack_name", "shard", "container", "position", "doc_id", "token_from", "tokens", "retrieved")
#: BM25's constants.
K1, B = 1.2, 0.75
#: A container takes neighbours until less than this share of it is free, then whatever fits best.
NEIGHBOUR_SHARE = 0.12
#: Tokens of a shard: bounds the index a task holds.
SHARD_TOKENS = 1_500_000


class Unused:
    """Unused items by size: the largest that fits a room, in nearly constant time."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.sorted = sizes[self.order]
        self.place = np.empty(len(sizes), dtype=np.int64)
        self.place[self.order] = np.arange(len(sizes))
        self.down = list(range(-1, len(sizes)))  # down[i + 1]: the highest unused place <= i, or -1
        self.alive = np.ones(len(sizes), dtype=bool)

    def _find(self, i: int) -> int:
        down, root = self.down, i + 1
        while down[root] != root - 1:
            root = down[root] + 1
        while down[i + 1] != root - 1:
            down[i + 1], i = root - 1, down[i + 1]
        return root - 1

    def take(self, item: int) -> None:
        self.alive[item] = False
        p = int(self.place[item])
        self.down[p + 1] = p - 1

    def place_before(self, place: int) -> int:
        """The highest unused place below a place, or -1."""
        return self._find(place - 1)

    def largest_within(self, room: int) -> int:
        """The largest unused item not above `room`, or -1."""
        p = self._find(int(np.searchsorted(self.sorted, room, side="right")) - 1)
        return int(self.order[p]) if p >= 0 else -1


#: Seeds scored at a time, and entries of the matrix that holds the postings of frequent tokens (32 MB).
SEEDS_AHEAD = 16
MATRIX_ENTRIES = 4_000_000


class Index:
    """BM25 inverted index of a shard. Tokens in a large share of the items are rows of a matrix, all others have postings; the
    scores of several seeds come from one matrix product and a sum over their rare tokens' postings."""

    def __init__(self, bags: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean_length: float) -> None:
        self.items = len(bags)
        items = np.repeat(np.arange(self.items), [len(b) for b in bags])
        tokens = np.concatenate(bags) if bags else np.zeros(0, dtype=np.int64)
        tf = (np.concatenate(counts) if counts else np.zeros(0)).astype(np.float64)
        weight = idf[tokens] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[items] / mean_length))
        frequency = np.bincount(tokens, minlength=len(idf))
        frequent = np.flatnonzero(frequency * 32 > self.items)
        most = min(512, MATRIX_ENTRIES // max(1, self.items))
        frequent = frequent[np.argsort(-frequency[frequent], kind="stable")[:most]]
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.matrix = np.zeros((len(frequent), self.items))
        inside = self.row[tokens] >= 0
        self.matrix[self.row[tokens[inside]], items[inside]] = weight[inside]
        tokens, items, weight = tokens[~inside], items[~inside], weight[~inside]
        order = np.argsort(tokens, kind="stable")
        self.starts = np.searchsorted(tokens[order], np.arange(len(idf) + 1))
        self.postings, self.weights = items[order], weight[order]

    def only(self, kept: np.ndarray) -> Index:
        """The index of the items at the places `kept`, which get new places in their order."""
        out = copy.copy(self)
        place = np.full(self.items, -1)
        place[kept] = np.arange(len(kept))
        inside = place[self.postings] >= 0
        out.items, out.matrix = len(kept), self.matrix[:, kept]
        out.postings, out.weights = place[self.postings[inside]], self.weights[inside]
        out.starts = np.concatenate([[0], np.cumsum(inside)])[self.starts]
        return out

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """The score of every item for each bag of tokens, to nine digits, so that the order of sums does not matter."""
        asked = np.zeros((len(bags), len(self.matrix)))
        for i, bag in enumerate(bags):
            rows = self.row[bag]
            asked[i, rows[rows >= 0]] = 1
        out = asked @ self.matrix
        for i, bag in enumerate(bags):
            rare = bag[self.row[bag] < 0]
            first, lengths = self.starts[rare], self.starts[rare + 1] - self.starts[rare]
            ends = np.cumsum(lengths)
            at = np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
            out[i] += np.bincount(self.postings[at], self.weights[at], self.items)
        return np.round(out, 9)


class Neighbours:
    """Scores of seeds, computed for the largest unused items ahead: the next seeds are among them. Items used up leave the index
    whenever they are 40 % of it."""

    def __init__(self, index: Index, bags: list[np.ndarray], unused: Unused) -> None:
        self.index, self.bags, self.unused = index, bags, unused
        self.items = np.arange(index.items)
        self.ahead: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, their scores) for a seed; among them all unused items."""
        if seed not in self.ahead:
            alive = self.unused.alive[self.items]
            if np.count_nonzero(alive) < 0.6 * len(alive):
                self.index, self.items = self.index.only(np.flatnonzero(alive)), self.items[alive]
            p, group = int(self.unused.place[seed]), [seed]
            while len(group) < SEEDS_AHEAD and (p := self.unused.place_before(p)) >= 0:
                group.append(int(self.unused.order[p]))
            self.ahead = {g: (self.items, s) for g, s in zip(group, self.index.scores([self.bags[g] for g in group]), strict=True)}
        return self.ahead.pop(seed)


def best_first(score: np.ndarray, most: int) -> np.ndarray:
    """The places of the highest scores, ties in order: `most` of them and all that tie with the last."""
    wanted = np.arange(len(score))
    if len(score) > most:
        wanted = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    return wanted[np.argsort(-score[wanted], kind="stable")]


def pack_shard(ids: np.ndarray, sizes: np.ndarray, bags: list[np.ndarray], index: Index, capacity: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(container, position, item, offset, tokens, retrieved): every item in containers of the capacity, only those above it being cut;
    items are in the order of their ids. `retrieved`: the item was placed as a neighbour of the container's seed."""
    rows: list[tuple[int, int, int, int, int, bool]] = []
    container = 0
    rest = sizes % capacity
    rest = np.where(sizes <= capacity, sizes, rest)
    for item in np.flatnonzero(sizes > capacity):
        for offset in range(0, int(sizes[item] - rest[item]), capacity):
            rows.append((container, 0, int(item), offset, capacity, False))
            container += 1
    unused = Unused(rest)
    for item in np.flatnonzero(rest == 0):
        unused.take(int(item))
    neighbours = Neighbours(index, bags, unused)
    threshold = NEIGHBOUR_SHARE * capacity
    while (seed := unused.largest_within(capacity)) >= 0:
        window, room, near = [seed], capacity - int(rest[seed]), 1
        unused.take(seed)
        if room > threshold:
            (items, score), most = neighbours.of(seed), 64
            fits = (score > 0) & unused.alive[items] & (rest[items] <= room)
            items, score = items[fits], score[fits]
            while len(items) and room > threshold:
                every = len(items) <= most
                for item in items[best_first(score, most)]:
                    if rest[item] <= room:
                        window.append(int(item))
                        unused.take(int(item))
                        room -= int(rest[item])
                        if room <= threshold:
                            break
                if every:
                    break
                fits = unused.alive[items] & (rest[items] <= room)  # those passed over do not fit, those taken are gone
                items, score, most = items[fits], score[fits], most * 4
            near = len(window)
        while room > 0 and (item := unused.largest_within(room)) >= 0:
            window.append(item)
            unused.take(item)
            room -= int(rest[item])
        for position, item in enumerate(window):
            rows.append((container, position, item, int(sizes[item] - rest[item]), int(rest[item]), 0 < position < near))
        container += 1
    return rows


def _pack(capacities: list[tuple[str, int]], idf: np.ndarray, mean_length: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        ids, sizes = table.column("doc_id").chunk(0), table.column("n_tokens").to_numpy().astype(np.int64)
        tokens, counts = table.column("token_ids").chunk(0), table.column("token_counts").chunk(0)
        cuts = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))[:-1]
        bags = np.split(tokens.flatten().to_numpy().astype(np.int64), cuts)
        index = Index(bags, np.split(counts.flatten().to_numpy(), cuts), sizes, idf, mean_length)
        shard = table.column("shard")[0].as_py()
        parts = []
        for name, capacity in capacities:
            rows = pack_shard(np.arange(len(sizes)), sizes, bags, index, capacity)
            c, p, i, o, n, r = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, dtype=np.int64)] * 6
            fixed = [pa.array([name] * len(c), pa.string()), pa.array(np.full(len(c), shard, dtype=np.int32))]
            parts.append(pa.table([*fixed, pa.array(c), pa.array(p), ids.take(pa.array(i)), pa.array(o), pa.array(n), pa.array(r.astype(bool))], names=list(COLUMNS)))
        return pa.concat_tables(parts)

    return run


def pack_documents(docs: DataFrame, key: str, text: str, capacities: list[tuple[str, int]], shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(pack_name, shard, container, position, key, token_from, tokens, retrieved): for each named capacity every document in a container.

    A container is (pack_name, shard, container) and never holds more than its capacity. A document is cut only if it is
    longer than the capacity: into full containers and a rest that is packed as an item. `retrieved`: it was placed as a neighbour of the seed, not for its size. Documents without tokens (null or
    empty text) and null keys are left out; equal documents are items of their own, and so are rows with equal keys. Statistics of
    BM25 come from all documents; the frequencies are as many as the vocabulary has tokens, whatever the corpus.
    """
    sized = write_through(token_sizes(docs.withColumnRenamed(key, "doc_id"), "doc_id", text, bags=True), "token-bags")
    total, count = sized.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    if not count:
        return sized.sparkSession.createDataFrame([], f"pack_name string, shard int, container bigint, position bigint, `{key}` {dict(docs.dtypes)[key]}, token_from bigint, tokens bigint, retrieved boolean")
    frequencies = sized.select(F.explode("token_ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the vocabulary
    df = np.zeros(VOCABULARY_SIZE)
    for row in frequencies:
        df[row.t] = row.n
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    shards = max(1, -(-total // shard_tokens))
    placed = spread(sized, "doc_id", shards, "shard")
    schema = f"pack_name string, shard int, container bigint, position bigint, doc_id {dict(sized.dtypes)['doc_id']}, token_from bigint, tokens bigint, retrieved boolean"
    return placed.groupBy("shard").applyInArrow(_pack(capacities, idf, total / count), schema).withColumnRenamed("doc_id", key)


def fill_report(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, containers, tokens, fill_share, retrieved_share, cut_documents) of packed documents. `retrieved_share`: the
    share of all tokens that retrieval placed."""
    spark = packed.sparkSession
    sizes = spark.createDataFrame(capacities, "pack_name string, capacity int")
    boxes = packed.groupBy("pack_name", "shard", "container").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("retrieved"), F.col("tokens")).otherwise(0)).alias("retrieved"))
    cut = packed.where(F.col("token_from") > 0).groupBy("pack_name").agg(F.count_distinct(packed.columns[4]).alias("cut_documents"))
    sums = boxes.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("retrieved").alias("retrieved"))
    out = sizes.join(sums, "pack_name").join(cut, "pack_name", "left")
    return out.select(
        "pack_name", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill_share"),
        (F.col("retrieved") / F.col("tokens")).alias("retrieved_share"), F.coalesce("cut_documents", F.lit(0)).alias("cut_documents"),
    )


def check_packs(packed: DataFrame, sized: DataFrame, key: str, capacities: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, key, whole, kept): per document of `sized` (key, n_tokens) and capacity whether its pieces are all of it, one after
    the other, and whether all its containers keep the capacity and it is cut only if it is longer."""
    limits = sized.sparkSession.createDataFrame(capacities, "pack_name string, capacity int")
    loads = packed.groupBy("pack_name", "shard", "container").agg(F.sum("tokens").alias("load"))
    pieces = packed.join(loads, ["pack_name", "shard", "container"])
    # pieces of a document follow on each other if the sum of what starts before each is where it starts
    w = Window.partitionBy("pack_name", key).orderBy("token_from").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.withColumn("gap", F.col("token_from") != F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    per = before.groupBy("pack_name", key).agg(F.sum("tokens").alias("tokens"), F.max("gap").alias("gap"), F.max("load").alias("load"), F.count(F.lit(1)).alias("pieces"))
    every = sized.select(key, "n_tokens").join(F.broadcast(limits))  # a few capacities
    out = every.join(per, ["pack_name", key], "left")
    whole = F.coalesce(~F.col("gap") & (F.col("tokens") == F.col("n_tokens")), F.lit(False))
    kept = F.coalesce((F.col("load") <= F.col("capacity")) & ((F.col("pieces") == 1) | (F.col("n_tokens") > F.col("capacity"))), F.lit(False))
    return out.select("pack_name", key, whole.alias("whole"), kept.alias("kept"))
