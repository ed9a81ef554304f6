import random
import re

from strandloom.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall((text or "").translate(str.maketrans(L.UPPER, L.LOWER)))


def plain(text, k=4):
    w = plain_words(text)
    places = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in L.PHRASES}
    every = sorted(x for v in places.values() for x in v)
    labels = {x for x, v in places.items() if v}
    shares = []
    for label, t in L.TEMPLATES:
        tw = plain_words(t)
        n = len(tw) - k + 1
        diagonals = {}
        for i in range(len(w) - k + 1):
            for j in range(n):
                if w[i : i + k] == tw[j : j + k]:
                    diagonals.setdefault(i - j, []).append((i, j))
        group = []
        for d in [*sorted(diagonals), None]:
            if group and (d is None or d - group[-1] > 3):
                hits = [x for g in group for x in diagonals[g]]
                first, last = min(i for i, _ in hits), max(i for i, _ in hits) + k - 1
                share = len({j for _, j in hits}) / n
                if share >= 0.6 and last - first + 1 <= 1.5 * len(tw):
                    shares.append((label, share))
                group = []
            group.append(d)
    own = labels | {x for x, _ in shares}
    score = max([s for _, s in shares] + [0.5 if every else 0.0])
    return len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(labels)), ",".join(sorted(own)), round(score, 9)


def test_scan_equals_brute_force(spark):
    rng = random.Random(8)
    noise = lambda n: [rng.choice(["the", "license", "mit", "apache", "general", "public", "Éa", "K", "under"]) for _ in range(n)]
    texts = [None, "", " ...", "MIT License", "mit-license; MIT\nLICENSE apache license", "GENERAL public License general", "É mit", "word " * 30000 + "the MIT license"]
    for _, t in L.TEMPLATES:
        words = t.split()
        for _ in range(3):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = noise(rng.randint(0, 1))
            texts.append(" ".join(noise(rng.randint(0, 40)) + w + noise(rng.randint(0, 40)) + (words if rng.random() < 0.3 else [])))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(5, texts[5], "x", "y"), (None, texts[9], "x", "y"), (9, "other", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, labels string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], str(r))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.scan(df).collect()), key=key)
    assert got == sorted(((i, *plain(t)) for i, t, _, _ in rows), key=key)
    assert L.scan(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
