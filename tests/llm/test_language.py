import random

import numpy as np

from strandloom.llm import language as L

SYLLABLES = {"aa": ["the", "ing", "tion", "ed", "wh"], "bb": ["sch", "ü", "ung", "ein", "pf"], "cc": ["ñ", "ción", "os", "ll", "que"]}


def text(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))


def rows():
    rng = random.Random(1)
    return [(i, text(rng, lang, rng.randint(3, 60)), lang) for i in range(600) for lang in [rng.choice(["aa", "aa", "aa", "bb", "cc"])]]


def test_held_out_accuracy_and_odd_texts(spark):
    data = rows()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !!", "cc"), (1003, "the " * 40000, None), (None, data[0][1], data[0][2]), (1004, "x", "aa")]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string")
    model = L.train(df)
    assert model.languages == ["aa", "bb", "cc"]
    got = L.predict(df, model).withColumn("held_out", L.C.held_out()).collect()
    assert len(got) == len(data) + len(odd)
    want = {i: lang for i, _, lang in data}
    tested = [(r.lang_pred, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert len(tested) > 100 and sum(a == b for a, b in tested) / len(tested) > 0.98
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0.0
    assert by[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.predict(df, L.train(df)).collect()] == ["und"]
    assert L.predict(df.limit(0), L.train(df.limit(0))).count() == 0


def plain_slots(text):
    """Slots of all n-grams, one by one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return {int(L.gram_slots(raw[i : i + n], n)[0]) for n in L.ORDERS for i in range(len(raw) - n + 1)}


def plain_kernel(left, right):
    left, right = [plain_slots(t) for t in left], [plain_slots(t) for t in right]
    return np.array([[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in right] for a in left])


def test_kernel_equals_plain_sets_and_texts_do_not_touch():
    data = rows()
    learned = [t.lower() for _, t, _ in data[:40]]
    model = L.fit([t.encode() for t in learned], [lang for _, _, lang in data[:40]], landmarks=20)
    marks = [learned[i] for i in np.flatnonzero(np.isclose(model.kernel([t.encode() for t in learned]).max(axis=1), 1, atol=1e-5))]
    assert len(set(marks)) == 20
    texts = ["", "x", "zz", "abc" * 50, *learned, "the \u00fcber \u03a9 text" * 300]
    got = model.kernel([t.encode() for t in texts])
    want = plain_kernel(texts, marks)
    assert got.shape == want.shape
    assert np.allclose(np.sort(got, axis=1), np.sort(want, axis=1), atol=1e-5)
    alone = np.concatenate([model.kernel([t.encode()]) for t in texts])
    assert np.allclose(alone, got, atol=1e-6)


def test_weights_equal_the_ridge_of_the_whole_kernel():
    """With every training text a landmark, Nystrom is exact: f = K a + b with (K + penalty / share) a = y - b, sum a = 0."""
    data = rows()[:60]
    texts, langs = [t.lower() for _, t, _ in data], [lang for _, _, lang in data]
    ridge, n = 1e-2, len(data)
    model = L.fit([t.encode() for t in texts], langs, landmarks=n, ridge=ridge)
    share = np.array([n / 3 / langs.count(x) for x in langs])
    k = plain_kernel(texts, texts)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n], system[:n, n], system[n, :n] = k + np.diag(ridge * n / share), 1, 1
    new = [t.lower() for _, t, _ in rows()[60:120]]
    between, got = plain_kernel(new, texts), model.scores([t.encode() for t in new])
    for c, lang in enumerate(model.languages):
        y = np.where(np.array(langs) == lang, 1.0, -1.0)
        solved = np.linalg.solve(system, np.append(y, 0))
        assert np.allclose(got[:, c], between @ solved[:n] + solved[n], atol=5e-3)


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [a + b for a in letters[:16] for b in letters[:16]]
    words = {lang: ["".join(rng.choices(letters, k=6)) for _ in range(5)] for lang in langs}
    data = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(langs * 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = L.train(df, max_rows=300)
    learnable = {lang for i, _, lang in data if __import__("zlib").crc32(str(i).encode()) % 4 != 2}
    assert set(model.languages) == learnable and len(learnable) > 250


def test_long_texts_do_not_empty_the_sample(spark):
    """Whichever rows come first in the sample's order, some are of 2 MB where 1 MB is the bound."""
    short = {"en": "the cat sat on the mat and the dog ran with it ", "fr": "le chat est assis sur le tapis et le chien avec lui "}
    rows = [(i, lang * 0 + short[lang] * (45_000 if i % 10 == 0 else 2), lang) for i in range(200) for lang in ("en" if i % 2 else "fr",)]
    rows += [(1000 + i, short["en"] * 45_000, "en") for i in range(5)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_bytes=1 << 20)
    assert model.languages == ["en", "fr"]
    got = L.predict(spark.createDataFrame([(1, "the dog sat on the mat"), (2, "le chien est sur le tapis")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["en", "fr"]
    only_long = L.train(spark.createDataFrame([r for r in rows if len(r[1]) > 10**6], "doc_id long, text string, lang string"), max_bytes=1 << 20)
    assert only_long.languages == ["en", "fr"]
