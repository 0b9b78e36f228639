import random
import re
import zlib

import numpy as np

from ledgerloom.llm import quality


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    words = ["tree", "river", "house", "green", "walks", "seldom", "bright", "stone", "winter", "garden"]
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.6
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        kind = k % 3
        text = " ".join(body) + "." if good else (" ".join(w + "###" for w in body) if kind == 0 else " ".join(body).upper() + "!!" if kind == 1 else " ".join([body[0]] * 30))
        rows.append((k, text, "en", f"src{k % 3}"))
        labels.append((k, int(good)))
    return rows, labels


def tables(spark, extra=()):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string, source string").selectExpr("*", "1 as score", "2 as quality")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = tables(spark, [(9000, None, None, None), (9001, "", "x", "y"), (None, "tree house", "x", "y"), (9002, "z" * 50_000, None, None)])
    got = quality.score(docs, labels, dims=32, cells=1024).collect()
    assert len(got) == 704 and all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.held_out for r in got if r.doc_id == 5} == {zlib.crc32(b"5") % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95 and len(held) > 100


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = tables(spark)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    one = {r.doc_id: r.score for r in quality.score(docs, labels, dims=16, cells=512).collect()}
    two = {r.doc_id: r.score for r in quality.score(docs, turned, dims=16, cells=512).collect()}
    assert one == two


def test_keep_good_keeps_columns(spark):
    docs, labels, truth = tables(spark)
    kept = quality.keep_good(docs, labels, dims=32, cells=1024)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = {k for k, y in truth.items() if y}
    assert len(ids & good) >= 0.97 * len(good) and len(ids - good) <= 0.05 * (700 - len(good))


def test_without_labels_nothing_is_rejected(spark):
    docs, labels, _ = tables(spark)
    none = labels.limit(0)
    assert {r.score for r in quality.score(docs, none, dims=8, cells=64).collect()} == {0.5}
    assert quality.keep_good(docs, none, dims=8, cells=64).count() == docs.count()
    assert quality.score(docs.limit(0), labels, dims=8, cells=64).count() == 0


def test_contexts_are_sums_over_neighbours(spark):
    texts = spark.createDataFrame([("a b a",), ("c",), (None,)], "text string").repartition(3)
    cells, dims = 32, 16
    got = quality.context_vectors(texts, cells, dims, window=1, fan_in=2)
    slots, signs = quality.index_vectors(cells, dims)
    own = np.zeros((cells, dims))
    np.add.at(own, (np.arange(cells)[:, None], slots), signs)
    word = quality.WordCells(cells)
    context = 2 * own[word["b"]]
    share = 2 / 4
    want = (context / np.linalg.norm(context) + own[word["a"]] / np.linalg.norm(own[word["a"]])) * (0.2 + 1e-3 / (1e-3 + share))
    assert np.allclose(got[word["a"]], want, atol=1e-5)


def test_scores_do_not_depend_on_how_the_table_is_cut(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one, two = ({r.doc_id: r.score for r in quality.score(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(7, "lang", "n_chars")))
    assert one == two


def test_score_equals_plain_arithmetic(spark):
    """Word by word, from the vectors that were learnt: pooled mean, hidden layer, logistic output over the temperature."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    shared, net = quality.train(docs, labels)
    vectors, rows = shared.value.astype(float), docs.collect()
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    for r in rows[:40]:
        cells = [zlib.crc32(w.encode()) % (len(vectors) - 1) for w in re.findall(r"\w+|[^\w\s]+", r.text)]
        total = sum((vectors[c] for c in cells), np.zeros(vectors.shape[1]))
        total = total + vectors[-1] * sum(a == b for a, b in zip(cells, cells[1:]))
        x = (total / max(1, len(cells)) - net.mean) / net.scale
        hidden = [np.tanh(sum(x[i] * net.w1[i, j] for i in range(len(x))) + net.b1[j]) for j in range(net.w1.shape[1])]
        logit = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-logit))) < 1e-4
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)


def test_null_ids_repeats_and_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    text = docs.first().text
    extra = spark.createDataFrame([(None, text), (None, text), (0, "other text"), (5000, None), (5001, ""), (5002, "long word " * 100_000)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(extra).selectExpr("*", "1 as id", "2 as y", "3 as x", "4 as score")
    got = quality.score(table, labels).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id is None}) == 1 and len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1
    assert quality.keep_good(table, labels).columns == table.columns
