import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import lattice_lm
from ledgerloom.llm.lattice_lm import Lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_sum_over_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b" ab", b"ba", b"bab"]
    weights = np.array([0.1, 0.2, 0.05, 0.15, 0.2, 0.1, 0.1, 0.1])
    p = dict(zip(pieces, weights))
    lattice = Lattice(pieces)

    def slow(text):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, at = [], 0
            for k, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(text[at:k])
                    at = k
            total += math.prod(p.get(x, 0.0) for x in parts)
        return total

    words = [b"a", b"ab", b"abab", b"babba", b"b" * 7, b"abababab"]
    assert np.allclose(np.exp(lattice.log_probs(words, weights)), [slow(b" " + w) for w in words])
    uses = lattice.expected(words, np.ones(len(words)), weights)
    lengths = np.array([len(x) for x in pieces])
    assert np.isclose((uses * lengths).sum(), sum(len(w) + 1 for w in words))


def test_score_is_the_sum_over_all_segmentations_under_learnt_weights(spark):
    """By hand: every segmentation of every word, under the vocabulary's ranks, and under weights that EM learns from all training words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    weight = {}
    for k in range(model.get_piece_size()):
        if model.is_byte(k):
            name, rank = bytes([int(model.id_to_piece(k)[3:5], 16)]), model.get_piece_size()
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            name, rank = model.id_to_piece(k).replace("▁", " ").encode(), -model.get_score(k)
        else:
            continue
        if b" " not in name[1:]:
            weight[name] = max(weight.get(name, 0), 1 / (rank + 2))
    total = sum(weight.values())

    ranked = {p: w / total for p, w in weight.items()}

    def segmentations(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in weight:
                for rest in segmentations(text[k:]):
                    yield (text[:k], *rest)

    def probability(word, under):
        return sum(math.prod(under[p] for p in parts) for parts in segmentations(b" " + word))

    texts = ["the cat sat", "The  CAT\tsat", "", None, "über naïve", "xqzt", "a a a b", "日本 x", "information"]
    rows = list(enumerate(texts))
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    words = {k: (t or "").encode().lower().split() for k, t in rows}
    n_words, n_ends = (sum(f(k) for k, _ in rows if not held[k]) for f in (lambda k: len(words[k]), lambda k: 1))
    end = (n_ends + 1) / (n_words + n_ends + 2)
    counts = Counter(w for k, _ in rows if not held[k] for w in words[k])
    learnt = ranked
    for _ in range(3):
        uses = Counter()
        for w, c in counts.items():
            whole = probability(w, learnt)
            for parts in segmentations(b" " + w):
                share = c * math.prod(learnt[p] for p in parts) / whole
                for p in parts:
                    uses[p] += share
        learnt = {p: (uses[p] + 5.0 * r) / (sum(uses.values()) + 5.0) for p, r in ranked.items()}
    got = {r.doc_id: r for r in lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, score_rounds=3, prior_weight=5.0).collect()}
    for k, _ in rows:
        want, by_rank = (math.log10(end) + sum(math.log10((1 - end) * probability(w, under)) for w in words[k]) for under in (learnt, ranked))
        assert math.isclose(got[k].score, want, rel_tol=1e-9), texts[k]
        assert math.isclose(got[k].rank_score, by_rank, rel_tol=1e-6), texts[k]
    assert sum(got[k].score for k, _ in rows if not held[k]) > sum(got[k].rank_score for k, _ in rows if not held[k])


def docs():
    base = ["the cat sat on the mat", "the dog ate the cat", "", None, "THE Cat", "über straße über", "zzz unknownword", "a a a a a a a", "x" * 3000]
    return [(k, base[k % len(base)] and base[k % len(base)] + (f" w{k}" if k % 5 == 0 else "")) for k in range(120)] + [(None, "the end")]


def test_base_score_and_counts(spark):
    rows = docs()
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n", "'w' as word")
    got = lattice_lm.score(table, MODEL, block_bytes=600).collect()
    assert len(got) == len(rows)

    def tokens(text):
        return (text or "").encode().lower().split() + [b" end"]

    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows}
    counts = Counter(w for k, t in rows if not held[k] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    by_id = {r.doc_id: r for r in got}
    for k, text in rows:
        r = by_id[k]
        assert r.held_out == held[k] and r.train_tokens == n and r.n_tokens == len(tokens(text))
        assert r.n_known == sum(counts[w] > 0 for w in tokens(text))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(text)), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score) and r.word_score < 0 and math.isfinite(r.word_score)


def test_probabilities_of_all_texts_stay_below_one(spark):
    """Over an alphabet of two words, the model's mass of all texts up to a length is at most one."""
    rows = [(k, "ab b"[: 2 + 2 * (k % 2)]) for k in range(0, 60)]
    probes = [" ".join(c) for n in range(0, 7) for c in itertools.product(["ab", "b"], repeat=n)]
    held = [k for k in range(1000, 9000) if zlib.crc32(str(k).encode()) % 7 == 2][: len(probes)]
    table = spark.createDataFrame(rows + list(zip(held, probes)), "doc_id long, text string")
    found = [r for r in lattice_lm.score(table, MODEL).collect() if r.doc_id >= 1000]
    assert 0.5 < sum(10 ** r.word_score for r in found) <= 1.0 + 1e-9
    assert sum(10 ** r.score for r in found) <= 1.0 + 1e-9 and sum(10 ** r.rank_score for r in found) <= 1.0 + 1e-9


@pytest.mark.parametrize("rows", [[], [(4, "only held out")]])
def test_without_training_rows(spark, rows):
    held = [(k, t) for k, t in rows]
    table = spark.createDataFrame([(next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2), t) for _, t in held], "doc_id long, text string")
    got = lattice_lm.score(table, MODEL).collect()
    assert len(got) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
