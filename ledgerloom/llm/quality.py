"""Document quality from random-indexing word vectors and a small network.

Every word (or run of punctuation) owns a sparse random index vector.  A first
pass over all documents adds, to each word's context vector, the index vectors
of its neighbours; words are hashed to a fixed number of cells, so the table
has one size whatever the corpus.  A document's vector is the weighted mean of
its words' vectors (context plus own index); a word that repeats the word
before it also adds the vector of a repetition mark.  A two-layer network,
trained on a bounded sample of labelled rows and calibrated by one temperature
on rows it has not fitted, turns the vector into a probability.

All sums over the corpus are sums of whole numbers, and a document's mean is
added up in stretches of its own, so neither the order of tasks nor the way the
table is cut changes a score.

Labels, language, source and ids are never inputs.  Null and empty texts have
the zero vector and are scored like others.  Texts are read whole, however long.
Repeated rows, and rows with a null id, are scored each; labels of an id that
contradict each other are left out, and of an id that occurs with several texts
the same one is always fitted.  Without labelled rows of both classes every
score is the share 0.5.  Extra columns are ignored (``keep_good`` keeps them);
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import ship_package

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class WordCells(dict):
    """The cell of each word: a hash into a fixed number; starts anew when full."""

    def __init__(self, cells: int):
        super().__init__()
        self.cells = cells

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        # The last cell is the mark of repetition.
        value = self[word] = zlib.crc32(word.encode()) % (self.cells - 1)
        return value


_cells: dict[int, WordCells] = {}


def _word_cells(cells: int) -> WordCells:
    if cells not in _cells:
        _cells[cells] = WordCells(cells)
    return _cells[cells]


def index_vectors(cells: int, dims: int, spikes: int = 2, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """For each cell, the dimensions and signs of its sparse index vector."""
    random = np.random.default_rng(seed)
    return random.integers(0, dims, (cells, spikes)), random.choice([-1.0, 1.0], (cells, spikes))


def token_stream(texts: list[str | None], cells: WordCells) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all tokens of the texts, one after another, and the number per text."""
    look, counts, parts = cells.__getitem__, [], []
    for text in texts:
        tokens = _TOKEN.findall(text) if text else []
        counts.append(len(tokens))
        parts.append(np.fromiter(map(look, tokens), np.int32, len(tokens)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(counts, np.int64)


def _context_sums(cells: int, dims: int, window: int, chunk: int):
    """Task: texts -> summed index vectors of neighbours and word counts, in chunks of cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, signs = index_vectors(cells, dims)
        table, seen = np.zeros(cells * dims), np.zeros(cells)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 500):
                ids, counts = token_stream(texts[at : at + 500], _word_cells(cells))
                doc = np.repeat(np.arange(len(counts)), counts)
                seen += np.bincount(ids, minlength=cells)
                for apart in range(1, window + 1):
                    same = doc[apart:] == doc[:-apart]
                    one, two = ids[:-apart][same].astype(np.int64), ids[apart:][same].astype(np.int64)
                    for word, near in ((one, two), (two, one)):
                        for s in range(slots.shape[1]):
                            table += np.bincount(word * dims + slots[near, s], signs[near, s], cells * dims)
        block = np.concatenate([table.reshape(cells, dims), seen[:, None]], axis=1).astype("<i4")
        part = TaskContext.get().partitionId()
        yield pa.record_batch(
            [
                pa.array(np.arange(0, cells, chunk)), pa.array([part] * len(range(0, cells, chunk)), pa.int64()),
                pa.array([block[k : k + chunk].tobytes() for k in range(0, cells, chunk)], pa.binary()),
            ],
            names=["cell", "part", "sums"],
        )

    return work


def context_vectors(texts: DataFrame, cells: int, dims: int, window: int, fan_in: int = 32) -> np.ndarray:
    """Vectors of all cells, learnt from a one-column table of texts.

    Tasks' sums meet in groups of ``fan_in`` tasks at a time, so no group grows
    with the corpus.  The result (cells x dims) has a fixed size.
    """
    chunk = max(1, cells // 64)
    sums = texts.mapInArrow(_context_sums(cells, dims, window, chunk), "cell long, part long, sums binary")
    parts = texts.rdd.getNumPartitions()

    def add(kind: str):
        def work(key: tuple, group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, kind).astype("<i8") for b in group.column("sums").to_pylist())
            return pa.table({"cell": group.column("cell")[:1], "part": group.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        return work

    kind = "<i4"  # a task's sums; those of several tasks have twice the width
    while True:
        parts = -(-parts // fan_in)
        sums = sums.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("cell", "part").applyInArrow(add(kind), "cell long, part long, sums binary")
        kind = "<i8"
        if parts <= 1:
            break
    table = np.zeros((cells, dims + 1))
    for cell, blob in sums.select("cell", "sums").collect():  # one row per chunk of cells
        table[cell : cell + chunk] = np.frombuffer(blob, "<i8").reshape(-1, dims + 1)
    context, seen = table[:, :dims], table[:, dims]
    slots, signs = index_vectors(cells, dims)
    own = np.zeros((cells, dims))
    np.add.at(own, (np.arange(cells)[:, None], slots), signs)
    vectors = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    vectors += own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    # Frequent words weigh less, though never nothing.
    share = seen / max(seen.sum(), 1.0)
    return (vectors * (0.2 + 1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray, step: int = 60_000) -> np.ndarray:
    """Mean vector of each text's words, with the share of repeated words marked."""
    cells, dims = vectors.shape
    ids, counts = token_stream(texts, _word_cells(cells))
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((len(counts), dims))
    # Stretches of a document's own words, some of them at a time.
    ends = np.cumsum(counts)
    starts = np.concatenate([np.arange(e - n, e, 4096) for e, n in zip(ends, counts)]) if len(ids) else np.zeros(0, np.int64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + step)))
        end = starts[to] if to < len(starts) else len(ids)
        np.add.at(out, doc[starts[at:to]], np.add.reduceat(vectors[ids[starts[at] : end]], starts[at:to] - starts[at], axis=0))
        at = to
    again = np.bincount(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], minlength=len(counts)) if len(ids) else np.zeros(len(counts))
    out += again[:, None] * vectors[cells - 1]
    return out / np.maximum(counts, 1)[:, None]


class TwoLayerNet:
    """Hidden tanh layer and a logistic output, with one calibration temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> "TwoLayerNet":
        """Adam on four fifths of the rows; the temperature on the last fifth."""
        random = np.random.default_rng(seed)
        order = random.permutation(len(x))
        x, y = x[order], y[order].astype(float)
        cut = max(1, len(x) * 4 // 5)
        mean, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-6
        dims = x.shape[1]
        params = [random.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        z = (x - mean) / scale
        for _ in range(epochs):
            for at in range(0, cut, 128):
                rows = random.integers(0, cut, 128)
                h = np.tanh(z[rows] @ params[0] + params[1])
                p = 1.0 / (1.0 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
                d = (p - y[rows]) / len(rows)
                dh = np.outer(d, params[2]) * (1 - h * h)
                grads = [z[rows].T @ dh + decay * params[0], dh.sum(0), h.T @ d + decay * params[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        net = cls(mean, scale, *params[:3], params[3][0], 1.0)
        if len(x) > cut:
            logits, truth = net.logits(x[cut:]), y[cut:]
            losses = {t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in np.geomspace(0.25, 8, 61)}
            net.temperature = min(losses, key=losses.get)
        return net


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is held out from learning, by the checksum of its id."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    modulus: int = 4,
    held_out_remainder: int = 2,
    max_labelled: int = 20_000,
    cells: int = 1 << 14,
    dims: int = 64,
    window: int = 2,
) -> tuple[object, TwoLayerNet | None]:
    """Broadcast word vectors, learnt from all documents, and the network.

    ``max_labelled`` bounds the labelled rows that the network is fitted on
    (those of the smallest hash).  The network is None if the labels that may
    be used hold fewer than two classes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vectors = context_vectors(docs.select(F.col(text_col).cast("string").alias("t")), cells, dims, window)
    shared = spark.sparkContext.broadcast(vectors)
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"), modulus, held_out_remainder))
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pool(batch.column(1).to_pylist(), shared.value).astype("<f4")
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "y", "x"])

    fitted = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
        .join(F.broadcast(sample), "id")  # at most max_labelled rows of an id and a label
        .select("id", "t", "y").mapInArrow(vectorise, f"id {kind}, y int, x binary").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    )
    rows = sorted(((zlib.crc32(str(r.id).encode()), r.id, r.y, r.x) for r in fitted.toLocalIterator()), key=lambda r: (r[0], r[1]))
    if len({r[2] for r in rows}) < 2:
        return shared, None
    return shared, TwoLayerNet.fit(np.array([np.frombuffer(r[3], "<f4") for r in rows], float), np.array([r[2] for r in rows]))


def judge(texts: list[str | None], vectors: np.ndarray, net: TwoLayerNet | None) -> np.ndarray:
    """Probability of good quality of each text."""
    scores = [np.zeros(0)]
    for at in range(0, len(texts), 500):
        x = pool(texts[at : at + 500], vectors)
        scores.append(net(x) if net is not None else np.full(len(x), 0.5))
    return np.concatenate(scores)


def score(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.7,
    modulus: int = 4, held_out_remainder: int = 2, **settings,
) -> DataFrame:
    """Score every document; learn labels only from rows that are not held out.

    ``settings`` go to ``train``.  Returns ``id_col``, ``held_out``, ``score``,
    ``predicted``.
    """
    shared, net = train(docs, labels, text_col, id_col, modulus=modulus, held_out_remainder=held_out_remainder, **settings)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(judge(batch.column(1).to_pylist(), shared.value, net))], names=["id", "score"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
        .mapInArrow(work, f"id {kind}, score double")
        .select(
            F.col("id").alias(id_col), held_out(F.col("id"), modulus, held_out_remainder).alias("held_out"), "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )
    )


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.7, **settings) -> DataFrame:
    """The documents that score at least ``threshold``, with all of their columns.

    Where nothing can be learnt (no labels of both classes), all are kept.
    """
    shared, net = train(docs, labels, text_col, id_col, **settings)
    if net is None:
        return docs
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(place).to_pylist(), shared.value, net) >= threshold))

    return docs.mapInArrow(work, docs.schema)
