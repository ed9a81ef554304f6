import random

import numpy as np

from strandloom.llm import quality as Q


def corpus(n=700):
    rng = random.Random(9)
    good = lambda: ". ".join(" ".join(rng.choice(["the", "river", "runs", "slowly", "past", "old", "mills", "and", "fields"]) for _ in range(9)) for _ in range(rng.randint(1, 20)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "now$$", "click|", "%%%", "a"]) for _ in range(rng.randint(5, 200)))
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.8)
        docs.append((i, good() if y else bad(), "en", "src0"))
        if i % 2:
            labels.append((i, y))
    return docs, labels


def test_held_out_accuracy_and_odd_texts(spark):
    docs, labels = corpus()
    docs += [(9000, None, None, None), (9001, "", "en", "x"), (9002, "word " * 50000, "en", "x"), (None, "x", "en", "x"), (1, docs[1][1], "en", "x")]
    labels += [(1, labels[0][1]), (9000, None), (None, 1), (9001, 0), (12345, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    l = spark.createDataFrame(labels, "doc_id long, quality int")  # noqa: E741
    for meta in ((), ("lang",)):
        machine = Q.train(d, l, meta=meta)
        got = Q.score(d, machine, meta=meta).withColumn("held_out", Q.C.held_out()).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        truth = dict(labels)
        held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None and r.doc_id < 9000]
        assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    by = {r.doc_id: r.score for r in got}
    assert by[9000] is not None


def test_nothing_labelled(spark):
    d = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(d, Q.train(d, none)).collect()[0].predicted == 0
    assert Q.score(d.limit(0), Q.train(d, none)).count() == 0


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = Q.Machine(0.3, rng.normal(size=Q.SLOTS), rng.normal(size=(Q.SLOTS, 4)))
    row, slot, value = Q.features([b"a b c", b"", b"x | y http://z\nx"])
    for i in range(3):
        s, v = slot[row == i], value[row == i]
        pairs = sum(m.factors[s[a]] @ m.factors[s[b]] * v[a] * v[b] for a in range(len(s)) for b in range(a))
        assert np.isclose(m.raw(row, slot, value, 3)[i], m.constant + m.linear[s] @ v + pairs)


def plain_training(texts, labels, rank, epochs, batch, rate, decay, seed):
    """Adam on the pairwise model, feature by feature; only slots of a batch move."""
    rng = np.random.default_rng(seed)
    n = len(texts)
    v = rng.normal(0, 0.02, (Q.SLOTS, rank))
    w, c = {}, 0.0
    moments = {}
    row, slot, value = Q.features(texts)
    items = [list(zip(slot[row == i].tolist(), value[row == i].tolist())) for i in range(n)]
    ones = sum(labels)
    weight = [n / 2 / (ones if y else n - ones) for y in labels]
    c1 = c2 = 0.0
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch].tolist()
            grad_w, grad_v, grad_c = {}, {}, 0.0
            for i in rows:
                z = c + sum(w.get(s, 0.0) * x for s, x in items[i])
                z += sum((v[s] @ v[t]) * x * y for a, (s, x) in enumerate(items[i]) for t, y in items[i][:a])
                g = (1 / (1 + np.exp(-z)) - labels[i]) * weight[i] / len(rows)
                grad_c += g
                for a, (s, x) in enumerate(items[i]):
                    grad_w[s] = grad_w.get(s, 0.0) + g * x
                    others = sum((v[t] * y for b, (t, y) in enumerate(items[i]) if b != a), np.zeros(rank))
                    grad_v[s] = grad_v.get(s, np.zeros(rank)) + g * x * others
            step += 1
            lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for kind, grads in (("w", grad_w), ("v", grad_v)):
                for s, g in grads.items():
                    now = w.get(s, 0.0) if kind == "w" else v[s]
                    g = g + decay * now
                    m1, m2 = moments.get((kind, s), (0.0, 0.0))
                    m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g**2
                    moments[kind, s] = m1, m2
                    new = now - lr * m1 / (np.sqrt(m2) + 1e-8)
                    if kind == "w":
                        w[s] = new
                    else:
                        v[s] = new
            c1, c2 = 0.9 * c1 + 0.1 * grad_c, 0.999 * c2 + 0.001 * grad_c**2
            c -= lr * c1 / (np.sqrt(c2) + 1e-8)
    return c + np.log(ones / n / (1 - ones / n)), w, v


def test_training_equals_plain_loops():
    docs, _ = corpus(24)
    texts = [t[:160].encode() for _, t, _, _ in docs] + [b""]
    labels = [int("river" in t.decode() or "the" in t.decode()) for t in texts]
    assert 0 < sum(labels) < len(labels)
    how = dict(rank=2, epochs=2, batch=8, rate=0.03, decay=1e-5, seed=3)
    got = Q.fit(texts, np.array(labels), **how)
    c, w, v = plain_training(texts, labels, **how)
    assert np.isclose(got.constant, c)
    linear = np.zeros(Q.SLOTS)
    linear[list(w)] = list(w.values())
    assert np.allclose(got.linear, linear) and np.allclose(got.factors, v)


def test_an_id_with_both_labels_counts_as_one(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    both = [x for i, y in labels for x in ([(i, y), (i, 0)] if y else [(i, y)])]
    one, two = (Q.train(d, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, both))
    assert one.constant == two.constant and (one.linear == two.linear).all()


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    taken, fit = [], Q.fit
    monkeypatch.setattr(Q, "fit", lambda texts, *rest: taken.append(texts) or fit(texts, *rest))
    for most in (3000, 64 << 20):
        Q.train(d, spark.createDataFrame(labels, "doc_id long, quality int"), max_bytes=most)
    assert 300 < sum(map(len, taken[0])) <= 3000 < sum(map(len, taken[1]))


def test_long_texts_do_not_empty_the_sample(spark):
    rows = [(i, ("good prose indeed " if i % 2 else "junk $$$ click ") * (90_000 if i % 10 < 2 else 3)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    machine = Q.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_bytes=1 << 20)
    fresh = spark.createDataFrame([(1, "good prose indeed"), (2, "junk $$$ click")], "doc_id long, text string")
    good, junk = (r.score for r in sorted(Q.score(fresh, machine).collect()))
    assert good > 0.9 and junk < 0.1
