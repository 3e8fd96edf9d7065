import random
import zlib

import numpy as np

from fleetstops.llm import toxicity as tx

BAD = ["vileword", "nastyword", "hexword"]


def made(n=400):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(n):
        words = ["w" + str(int(rng.expovariate(0.05))) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD) + rng.choice(["", "s", "er"]))
        texts.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return texts, labels


def test_learns_from_positives_and_unlabelled_text():
    texts, labels = made()
    positive = [tx.features(dict(texts)[i]) for i, y in labels if y]
    model = tx.train(positive, [tx.features(t) for _, t in texts], 0.25)
    scorer = tx.Scorer(model.base, tuple(model.weights.items()))
    scores = np.array([scorer.score(t) for _, t in texts])
    truth = np.array([any(b in t for b in BAD) for _, t in texts])
    assert scores[truth].min() > 0.3 > scores[~truth].max()
    assert tx.train([], positive, 0.2).weights == {} and tx.train(positive, positive, 0.0).weights == {}


def test_scorer_equals_features():
    texts, labels = made()
    model = tx.train([tx.features(dict(texts)[i]) for i, y in labels if y], [tx.features(t) for _, t in texts], 0.25)
    scorer = tx.Scorer(model.base, tuple(model.weights.items()))
    for _, t in [*texts[:100], (0, ""), (0, None), (0, "vileword " * 5000)]:
        slow = model.base + sum(model.weights.get(int(f), 0.0) for f in tx.features(t))
        assert abs(scorer.score(t) - 1 / (1 + np.exp(-np.clip(slow, -30, 30)))) < 1e-12


def test_held_out_rows_teach_nothing(spark):
    texts, labels = made(200)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = docs.select("doc_id", tx.held_out(docs.doc_id).alias("h")).collect()
    assert all(r.h == out(r.doc_id) for r in rows)
    kept = [(i, y) for i, y in labels if not out(i)]
    turned = kept + [(i, 1 - y) for i, y in labels if out(i)]
    schema = "doc_id long, toxic int"
    a, b = (tx.fit(docs, spark.createDataFrame(x, schema)) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (3, 1), (None, 1), (31, None), (777, 1)], "doc_id long, toxic int")
    model = tx.fit(odd, labels)
    scored = tx.with_score(odd.drop("score"), model)
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert tx.clean(odd, labels).columns == odd.columns
    assert tx.clean(odd, labels.limit(0)).count() == odd.count()
    assert tx.clean(none, labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = tx.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    hit = np.array([r.predicted for r in got])
    assert y[hit == 1].mean() > 0.75 and hit[y == 1].mean() > 0.85


def test_prior_from_positives_and_unlabelled_text():
    texts, labels = made(900)
    toxic, texts = [tx.features(t) for _, t in texts if any(b in t for b in BAD)], [tx.features(t) for _, t in texts]
    assert abs(tx.class_prior(toxic[::2], texts) - len(toxic) / len(texts)) < 0.05
    assert tx.class_prior([], texts) == tx.class_prior(toxic, []) == 0.0
    assert 0 < tx.class_prior(toxic[:1], texts[:2]) < 1


def test_labels_of_clean_documents_teach_nothing(spark):
    texts, labels = made(200)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = (tx.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"), tx.class_prior) for x in (labels, [r for r in labels if r[1]]))
    assert a == b and a.weights


def test_sample_is_bounded_and_the_least_by_hash(spark):
    texts, labels = made(200)
    docs = spark.createDataFrame(texts + texts[:50], "doc_id long, text string")
    drawn = tx._drawn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), 7, 20).collect()
    learned = {r.doc_id: r.h for r in docs.filter(~tx.held_out(docs.doc_id)).selectExpr("doc_id", "pmod(xxhash64(doc_id), 1L << 62) h").collect()}
    toxic = {i for i, y in labels if y}
    order = sorted(learned, key=learned.get)
    assert {r.doc_id for r in drawn if r.open} == set(order[:20])
    assert {r.doc_id for r in drawn if r.positive} == set([i for i in order if i in toxic][:7])
    assert len({r.doc_id for r in drawn}) == len(drawn)
    assert all(r.f == tx.features(dict(texts)[r.doc_id]).tolist() for r in drawn)
