"""Language-model scores: subword lattices over an existing vocabulary.

A text is a run of words, each with a mark of where it starts; a word is spelt
by pieces of a public tokenizer's vocabulary, and its probability is the sum
over all of its segmentations, each weighted by the pieces' unigram scores, by
a forward recursion in log space.  No piece spans two words, so a document's
marginal probability is the product over its words; after each word it ends or
goes on, with the share of ends among the tokens of the training documents.

The vocabulary's own scores are ranks (see ``read_pieces``).  They are the prior
from which expectation-maximisation re-estimates the scores of the same pieces
over all training words, each weighing its count; ``score`` is the lattice under
these.  ``rank_score`` is the same lattice under the ranks alone.

``word_score`` is a further model: a word that the training documents hold also
has an edge over the whole of it, weighted by its count, and words without one
are spelt by pieces re-estimated over the distinct training words.  The
weights of words are held per class of documents (their language, where a column tells it), backed off to
all classes and then to the lattice, each step by the share of words that occur
once (Good and Turing).  A document's own class is not used to score it: its
probability is the sum over all classes.  Within a document, words recur: its
marginal probability integrates over a Dirichlet prior around the word weights.

Words are counted over all training documents.  Blocks of documents keep, per
distinct word, one row; a word's counts are summed before its lattice is
walked, once, and return to the blocks by a join on the word, of which each
block has one row at most, and a shuffle on the block.  Nothing grows on the
driver: it holds one weight per piece of the vocabulary.

Null and empty texts consist of the end alone.  Rows with a null id count as
training rows and are scored like the others.  Repeated rows are scored, and
counted, each.  Texts and words are read whole, however long.  Extra columns
are ignored, whatever their names (but for ``class_col``); an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.grouped import in_bulk
from ledgerloom.session import materialise, ship_package

WORD_MARK = b" "  # no word holds a space


def read_pieces(model_file: str) -> list[tuple[bytes, float]]:
    """Pieces of a sentencepiece model that can occur in a marked word, with their weights.

    The scores of such a file are ranks of merges (0, -1, -2, ...), not log
    probabilities, so they become weights by Zipf's law: 1 / (rank + 2); a
    single byte has the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    weights: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            continue
        if model.is_byte(k):
            piece, rank = bytes([int(model.id_to_piece(k)[1:-1], 16)]), float(model.get_piece_size())
        else:
            piece, rank = model.id_to_piece(k).replace("▁", " ").encode(), -model.get_score(k)
        if b" " not in piece[1:]:
            weights[piece] = max(weights.get(piece, 0.0), 1.0 / (rank + 2.0))
    return sorted(weights.items())


class Lattice:
    """All segmentations of many words at once, over a fixed set of pieces."""

    _BASE = np.uint64(1099511628211)
    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes], cells: int = 3_000_000):
        self.n_pieces = len(pieces)
        self.longest = max(map(len, pieces))
        self._cells = cells
        bits = max(10, (8 * len(pieces)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.zeros(1 << bits, np.uint64)
        self._ids = np.full(1 << bits, -1, np.int32)
        for k, piece in enumerate(pieces):
            h = 0
            for b in piece:
                h = (h * int(self._BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            slot = ((h * int(self._SPREAD)) & 0xFFFFFFFFFFFFFFFF) >> int(self._shift)
            while self._ids[slot] >= 0:
                slot = (slot + 1) & self._mask
            self._keys[slot], self._ids[slot] = h, k

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        flat = hashes.ravel()
        slots = ((flat * self._SPREAD) >> self._shift).astype(np.int64)
        ids = self._ids[slots]
        open_ = np.flatnonzero((ids >= 0) & (self._keys[slots] != flat))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self._mask
            ids[open_] = self._ids[slots[open_]]
            open_ = open_[(ids[open_] >= 0) & (self._keys[slots[open_]] != flat[open_])]
        return ids.reshape(hashes.shape)

    def _edges(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece that starts at each place of each word, or -1."""
        text = words.T.astype(np.uint64) + np.uint64(1)
        n = len(text)
        hashes, edges = np.zeros_like(text), {}
        for size in range(1, min(self.longest, n) + 1):
            hashes = hashes[: n - size + 1] * self._BASE + text[size - 1 :]
            ids = self._lookup(hashes)
            if (ids >= 0).any():
                edges[size] = ids
        return edges

    @staticmethod
    def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        top = np.maximum.reduce(terms)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(sum(np.exp(t - safe) for t in terms))

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Marked words as byte rows of one length, and their places in the list."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            places = np.flatnonzero(sizes == size)
            step = max(1, self._cells // (int(size + 1) * self.longest))
            for at in range(0, len(places), step):
                part = places[at : at + step]
                rows = np.frombuffer(b"".join(WORD_MARK + words[k] for k in part), np.uint8)
                yield rows.reshape(len(part), int(size) + 1), part

    def _forward(self, edges: dict[int, np.ndarray], n: int, m: int, logp: np.ndarray) -> np.ndarray:
        ahead = np.zeros((n + 1, m))
        for j in range(1, n + 1):
            ahead[j] = self._log_sum([ahead[j - s] + logp[e[j - s]] for s, e in edges.items() if s <= j])
        return ahead

    def log_probs(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, summed over its segmentations."""
        return self.log_probs_under(words, [weights])[0]

    def log_probs_under(self, words: list[bytes], several: Sequence[np.ndarray]) -> np.ndarray:
        """The same under several weights of the pieces, whose edges are looked up once."""
        logs = [np.append(np.log(weights), -np.inf) for weights in several]  # the last entry serves id -1
        out = np.zeros((len(logs), len(words)))
        for rows, places in self._groups(words):
            m, n = rows.shape
            edges = self._edges(rows)
            for k, logp in enumerate(logs):
                out[k, places] = self._forward(edges, n, m, logp)[n]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur ``counts`` times."""
        return self.expected_under(words, [counts], [weights])[0]

    def expected_under(self, words: list[bytes], counts: Sequence[np.ndarray], several: Sequence[np.ndarray]) -> np.ndarray:
        """The same for several pairs of counts and weights, whose edges are looked up once."""
        logs = [np.append(np.log(weights), -np.inf) for weights in several]
        uses = np.zeros((len(logs), self.n_pieces + 1))
        for rows, places in self._groups(words):
            m, n = rows.shape
            edges = self._edges(rows)
            for k, logp in enumerate(logs):
                ahead = self._forward(edges, n, m, logp)
                back = np.zeros((n + 1, m))
                for j in range(n - 1, -1, -1):
                    back[j] = self._log_sum([logp[e[j]] + back[j + s] for s, e in edges.items() if j + s <= n])
                for s, ids in edges.items():
                    share = np.exp(ahead[: n - s + 1] + logp[ids] + back[s:] - ahead[n]) * counts[k][places]
                    uses[k] += np.bincount(ids.ravel() + 1, share.ravel(), self.n_pieces + 1)
        return uses[:, 1:]


def split_words(text: str | None) -> list[bytes]:
    """Words in lower case (A to Z only), cut at ASCII white space."""
    return text.encode().lower().split() if text else []


class _Index(dict):
    """Numbers new keys in the order in which they come."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _count_blocks(block_bytes: int, classes: int, names: list[str]):
    """Task: rows of documents -> rows of distinct words and rows of documents, by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, size = TaskContext.get().partitionId() << 24, 0, 0
        index, ids, held, kinds, docs = _Index(), [], [], [], []
        id_type = pa.int64()

        def flush() -> pa.RecordBatch:
            known = np.zeros((classes, len(index)), np.int64)
            for (words, counts), out, kind in zip(docs, held, kinds):
                if not out:
                    known[kind, words] += counts
            n, d = len(index), len(docs)
            number = pa.array(np.arange(n), pa.int32())
            tokens = pa.array([int(c.sum()) + 1 for _, c in docs], pa.int64())
            packed = [np.concatenate([np.diff(w, prepend=0), c]).astype("<u4").tobytes() for w, c in docs]
            columns = [
                pa.array(np.full(n + d, part + block)),
                pa.concat_arrays([pa.array(index.keys(), pa.binary()), pa.nulls(d, pa.binary())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), tokens]),
                pa.concat_arrays([number, pa.nulls(d, pa.int32())]),
                pa.concat_arrays([pa.nulls(n, id_type), pa.array(ids, id_type)]),
                pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(held, pa.bool_())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(packed, pa.binary())]),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(kinds, pa.int32())]),
                *[pa.concat_arrays([pa.array(k), pa.nulls(d, pa.int64())]) for k in known],
            ]
            return pa.record_batch(columns, names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, text, out, kind in zip(*(c.to_pylist() for c in batch.columns)):
                words = list(map(index.__getitem__, split_words(text)))
                docs.append(np.unique(np.array(words, np.int32), return_counts=True))
                ids.append(key)
                held.append(out)
                kinds.append(kind)
                size += len(text or "") + 64
                if size > block_bytes:
                    yield flush()
                    index, ids, held, kinds, docs = _Index(), [], [], [], []
                    block, size = block + 1, 0
        if docs:
            yield flush()

    return work


def _lgamma(t: np.ndarray) -> np.ndarray:
    """Log of the gamma function by Stirling's series; for arguments of 16 and more."""
    return (t - 0.5) * np.log(t) - t + 0.5 * math.log(2 * math.pi) + 1 / (12 * t) - 1 / (360 * t**3) + 1 / (1260 * t**5)


def log_rising(x: np.ndarray, log_x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log of x (x + 1) ... (x + n - 1), for rows of x and their n."""
    out = log_x.copy()
    for k in range(1, 16):
        many = np.flatnonzero(n > k)
        if not len(many):
            return out
        out[many] += np.log(x[many] + k)
    many = np.flatnonzero(n > 16)
    out[many] += _lgamma(x[many] + n[many, None]) - _lgamma(x[many] + 16.0)
    return out


def score(
    docs: DataFrame,
    model_file: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    class_col: str | None = "lang",
    max_classes: int = 8,
    modulus: int = 7,
    held_out_remainder: int = 2,
    rounds: int = 2,
    score_rounds: int = 4,
    prior_weight: float = 1000.0,
    concentration: float = 3200.0,
    block_bytes: int = 24 << 20,
) -> DataFrame:
    """Score every document; counts come from the documents that are not held out.

    ``score_rounds`` passes of expectation-maximisation over all training words,
    and for ``word_score`` ``rounds`` passes over the distinct ones, start from
    the vocabulary's own weights, which stay in as ``prior_weight``
    pseudo-pieces; ``concentration`` (16 or more) is the strength of the
    Dirichlet prior.
    ``class_col``, if the table has it, tells the classes of training
    documents; the ``max_classes`` most frequent values have one each, all
    others share one more.  Returns ``id_col``, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (add-one word unigrams),
    ``score`` (lattices under re-estimated piece scores), ``word_score`` (lattices
    with word edges) and ``rank_score`` (lattices under the vocabulary's ranks);
    the scores are log10.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus
    values: list = [None]
    if class_col in docs.columns:
        found = docs.groupBy(F.col(class_col).cast("string").alias("z")).count().orderBy(F.desc("count"), "z").limit(max_classes + 1)
        values = [r.z for r in found.collect()] or values  # at most max_classes + 1 rows
    # Nulls and what is beyond max_classes share the last class, if there are any.
    shared_last = None in values or len(values) > max_classes
    values = [v for v in values if v is not None][:max_classes]
    classes = len(values) + shared_last
    kind = F.coalesce(*[F.when(F.col(class_col).cast("string") == v, k) for k, v in enumerate(values)], F.lit(classes - 1))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), (rest == held_out_remainder).alias("held"), kind.cast("int").alias("z"),
    )
    per_class = [f"c{z}" for z in range(classes)]
    names = ["block", "word", "n", "idx", "id", "held", "packed", "z", *per_class]
    schema = f"block long, word binary, n long, idx int, id {id_type}, held boolean, packed binary, z int, {', '.join(f'{c} long' for c in per_class)}"
    blocks = materialise(rows.mapInArrow(_count_blocks(block_bytes, classes, names), schema), "lm-blocks")

    pieces, weights = zip(*read_pieces(model_file))
    weights = np.array(weights) / sum(weights)
    shared_pieces = spark.sparkContext.broadcast(list(pieces))
    of_words = blocks.filter("word is not null")
    words = of_words.groupBy("word").agg(*[F.sum(c).alias(c) for c in per_class])
    words = materialise(words.withColumn("c", sum((F.col(c) for c in per_class), F.lit(0))), "lm-words")
    known = words.filter("c > 0")
    totals = known.agg(
        F.count("*").alias("distinct"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in per_class], *[F.count_if(F.col(c) == 1).alias(f"once_{c}") for c in per_class],
        *[F.count_if((F.col(c) == 1) & (F.col("c") == 1)).alias(f"new_{c}") for c in per_class],
    ).first()
    n_words = sum(totals[f"n_{c}"] for c in per_class)
    trained = {r.z: r["count"] for r in blocks.filter("word is null and not held").groupBy("z").count().collect()}  # one row per class
    n_ends = sum(trained.values())
    train_tokens, distinct = n_words + n_ends, totals["distinct"] + (n_ends > 0)

    fitted = learned = weights
    for k in range(max(rounds, score_rounds) if n_words else 0):  # a pass serves both, as long as both are in need of one
        learn, fit = k < score_rounds, k < rounds
        uses = iter(_expected_uses(known, shared_pieces, [learned] * learn + [fitted] * fit, [False] * learn + [True] * fit))
        if learn:
            learned = _refitted(next(uses), weights, prior_weight)
        if fit:
            fitted = _refitted(next(uses), weights, prior_weight)

    # Pseudo-counts keep every text possible.  Per class: all words, the share of words
    # new to the class, and the share of those that are new to all classes.
    sizes = np.array([max(totals[f"n_{c}"], 1) for c in per_class], float)
    new_here = np.array([(totals[f"once_{c}"] + 1.0) / (totals[f"n_{c}"] + 2.0) for c in per_class])
    new_anywhere = np.array([(totals[f"new_{c}"] + 1.0) / (totals[f"once_{c}"] + 2.0) for c in per_class])
    if not n_words:
        new_here[:], new_anywhere[:] = 1.0, 1.0
    class_logs = np.log([(trained.get(z, 0) + 1.0) / (n_ends + classes) for z in range(classes)])
    record = np.dtype([("idx", "<i4"), ("c", "<i8"), ("spelt", "<f8"), ("ranked", "<f4"), ("lp", "<f4", (classes,))])
    scored = _word_scores(record, sizes, new_here, new_anywhere, max(n_words, 1))
    spelt = words.select("word", "c", *per_class).mapInArrow(
        _spelt(shared_pieces, learned, fitted, weights), f"word binary, c long, {', '.join(f'{c} long' for c in per_class)}, spelt double, fitted double, ranked double",
    )
    returned = of_words.select("block", "idx", "word").join(spelt, "word").select("block", "idx", "c", "spelt", "fitted", "ranked", *per_class).mapInArrow(scored, "block long, scores binary")
    ends = (n_ends + 1.0) / (n_words + n_ends + 2.0)
    add_one = float(np.log10(train_tokens + distinct + 1))
    end_base = float(np.log10(n_ends + 1)) - add_one

    def join_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = np.frombuffer(b"".join(right.column("scores").to_pylist()), record)
        count, spelt, ranked, log_x = np.zeros(len(table), np.int64), np.zeros(len(table)), np.zeros(len(table)), np.zeros((len(table), classes))
        count[table["idx"]], spelt[table["idx"]], ranked[table["idx"]], log_x[table["idx"]] = table["c"], table["spelt"], table["ranked"], table["lp"] + math.log(concentration)
        base, x = np.log10(count + 1.0) - add_one, np.exp(log_x)
        blobs = [np.frombuffer(b, "<u4").astype(np.int64).reshape(2, -1) for b in left.column("packed").to_pylist()]
        sizes = np.array([b.shape[1] for b in blobs])
        tokens, n_known = np.zeros(len(blobs), np.int64), np.zeros(len(blobs), np.int64)
        base_sum, lattice, by_rank = np.zeros(len(blobs)), np.zeros(len(blobs)), np.zeros(len(blobs))
        by_class = np.zeros((len(blobs), classes))
        reach = np.cumsum(sizes)
        at = 0
        while at < len(blobs):  # some documents at a time, so many (document, word) pairs
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + 200_000, "right")))
            words, times = np.concatenate([np.cumsum(b[0]) for b in blobs[at:to]]), np.concatenate([b[1] for b in blobs[at:to]])
            filled = at + np.flatnonzero(sizes[at:to])
            if len(filled):
                starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
                tokens[filled] = np.add.reduceat(times, starts)
                n_known[filled] = np.add.reduceat(np.where(count[words] > 0, times, 0), starts)
                base_sum[filled] = np.add.reduceat(base[words] * times, starts)
                lattice[filled] = np.add.reduceat(spelt[words] * times, starts)
                by_rank[filled] = np.add.reduceat(ranked[words] * times, starts)
                by_class[filled] = np.add.reduceat(log_rising(x[words], log_x[words], times), starts, axis=0)
            at = to
        by_class += class_logs
        top = by_class.max(axis=1)
        recur = top + np.log(np.exp(by_class - top[:, None]).sum(axis=1)) - _lgamma(concentration + tokens) + float(_lgamma(np.float64(concentration)))
        lengths = tokens * math.log1p(-ends) + math.log(ends)
        n_known += n_ends > 0
        base_sum += end_base
        rows = left.num_rows
        return pa.table({
            "id": left.column("id"), "held_out": left.column("held"), "n_tokens": left.column("n"),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([train_tokens] * rows, pa.int64()),
            "base_score": pa.array(base_sum, pa.float64()),
            "score": pa.array((lattice + lengths) / math.log(10.0), pa.float64()), "word_score": pa.array((recur + lengths) / math.log(10.0), pa.float64()),
            "rank_score": pa.array((by_rank + lengths) / math.log(10.0), pa.float64()),
        })

    result = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double, rank_score double"
    documents = blocks.filter("word is null").select("block", "id", "held", "n", "packed")
    return (
        documents.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(join_block, result)
        .withColumnRenamed("id", id_col)
    )


_lattices: dict[int, Lattice] = {}


def _lattice(shared_pieces) -> Lattice:
    """The lattice of a broadcast vocabulary, built once per Python worker."""
    pieces = shared_pieces.value
    key = hash(tuple(pieces))
    if key not in _lattices:
        _lattices[key] = Lattice(pieces)
    return _lattices[key]


def _refitted(uses: np.ndarray, prior: np.ndarray, prior_weight: float) -> np.ndarray:
    return (uses + prior_weight * prior) / (uses.sum() + prior_weight)


def _expected_uses(known: DataFrame, shared_pieces, several: list[np.ndarray], distinct: list[bool]) -> np.ndarray:
    """Expected uses of each piece over all training words, under each of several weights; one number per piece and weights.

    A word weighs its count; where ``distinct`` is true 1 / its count, since
    rare words tell how new ones are spelt.
    """
    names = [f"u{k}" for k in range(len(several))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, uses = _lattice(shared_pieces), 0.0
        for batch in in_bulk(batches, 20_000):
            counts = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            uses = uses + lattice.expected_under(batch.column(0).to_pylist(), [1.0 / counts if d else counts for d in distinct], several)
        if np.ndim(uses):
            used = np.flatnonzero(uses.any(axis=0))
            yield pa.record_batch([pa.array(used, pa.int64()), *(pa.array(u[used]) for u in uses)], names=["piece", *names])

    found = known.select("word", "c").mapInArrow(work, f"piece long, {', '.join(f'{n} double' for n in names)}").groupBy("piece").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((len(several), len(several[0])))
    for piece, *uses in found.collect():  # at most one row per piece of the vocabulary
        out[:, piece] = uses
    return out


def _spelt(shared_pieces, *weights: np.ndarray):
    """Task: (word, counts) -> the same and the log of the word's lattice probability under each of the weights."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared_pieces)
        for batch in in_bulk(batches, 20_000):
            found = [pa.array(p, pa.float64()) for p in lattice.log_probs_under(batch.column(0).to_pylist(), weights)]
            yield pa.record_batch([*batch.columns, *found], names=[*batch.schema.names, "spelt", "fitted", "ranked"])

    return work


def _word_scores(record: np.dtype, sizes: np.ndarray, new_here: np.ndarray, new_anywhere: np.ndarray, n_words: int):
    """Task: counted words -> packed (idx, count, log probabilities), one row per block and batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_bulk(batches, 20_000):
            count, spelt, fitted, ranked = (batch.column(k).to_numpy() for k in (2, 3, 4, 5))
            here = np.stack([batch.column(6 + z).to_numpy() for z in range(len(sizes))], axis=1)
            seen = (1 - new_here) * (here / sizes) + new_here * (1 - new_anywhere) * (count[:, None] / n_words)
            with np.errstate(divide="ignore"):  # words that were never seen
                mixed = np.logaddexp(np.log(seen), np.log(new_here * new_anywhere) + fitted[:, None])
            table = np.empty(len(count), record)
            table["idx"], table["c"], table["spelt"], table["ranked"], table["lp"] = batch.column(1).to_numpy(), count, spelt, ranked, mixed
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            parts = np.split(table[order], cuts)
            keys = block[order][np.concatenate([[0], cuts])] if len(count) else block[:0]
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array([p.tobytes() for p in parts if len(p)], pa.binary())], names=["block", "scores"],
            )

    return work
