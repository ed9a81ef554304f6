import math
import random

import pytest

from strandloom.llm import decontamination as D


def index_of(items, **how):
    return D.Index([e for i, t in items for e in D.entries_of(i, t, 256)], **how)


def world(n_items=60):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(900)]
    common = [f"c{i}" for i in range(25)]
    some = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(12, 60))) + ".") for i in range(n_items)]
    return rng, some, items


def test_wand_retrieves_what_exhaustive_scoring_does():
    rng, some, items = world()
    index = index_of([(i, t.encode()) for i, t in items], blocks=7)
    names = sorted({w for _, t in items for w in D.plain(t.encode()).split()})
    for _ in range(200):
        words = some(80) + items[rng.randrange(len(items))][1].split()[: rng.randint(0, 60)]
        terms = sorted({names.index(w) for w in D.plain(" ".join(words).encode()).split() if w in names})
        for theta in (0.2, 0.5, 0.9):
            scores = [sum(x for t in terms for e2, x in zip(index.ids[t], index.impact[t]) if e2 == e) for e in range(len(index.items))]
            want = {e for e, s in enumerate(scores) if s >= theta + 1e-9}
            got = {e for e, _ in index.wand(terms, theta)}
            assert want <= got <= {e for e, s in enumerate(scores) if s >= theta - 1e-9}


def question_words(text, words):
    """Up to the last sentence that leaves five words and has five before it, or else two thirds."""
    ends = [len(D.plain(text[: i + 1].encode()).split()) for i, c in enumerate(text) if c in ".?!:\n" and (i + 1 == len(text) or text[i + 1] not in ".?!:\n")]
    return max((n for n in ends if 5 <= n <= len(words) - 5), default=-(-2 * len(words) // 3))


def plain_hits(docs, items, part, threshold=0.5, overlap=0.8, k1=1.2, b=0.75):
    """{(doc, item): best score} by scoring every part against every passage, and the whole item around it."""
    parts = []
    for i, t in items:
        ws = D.plain((t or "").encode()).split()
        at = 0
        while at < len(ws):
            to = at + part if len(ws) - at - part >= 5 else len(ws)
            parts.append((i, ws[at:to], at, ws, question_words(t, ws)))
            at = to
    n, mean = len(parts), sum(len(p[1]) for p in parts) / max(len(parts), 1)
    df = {w: sum(w in set(p[1]) for p in parts) for w in {w for p in parts for w in p[1]}}
    half, out = max([32] + [len(p[1]) for p in parts]), {}
    for doc, text in docs:
        words = D.plain((text or "").encode()).split()
        for p in range(max(1, -(-len(words) // half) - 1)):
            here = words[p * half : (p + 2) * half]
            for item, ws, at, whole, cut in parts:
                weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * (k1 + 1) / (ws.count(w) + k1 * (1 - b + b * len(ws) / mean)) for w in set(ws)}
                score = sum(x for w, x in weight.items() if w in set(here)) / sum(weight.values())
                if score < threshold:
                    continue
                around = words[max(0, p * half - at) : (p + 2) * half + len(whole) - at - len(ws)]
                k = min(5, len(whole))
                grams = [tuple(whole[j : j + k]) for j in range(len(whole) - k + 1)]
                q = max(1, min(cut - 4, len(grams)))
                have = {tuple(around[j : j + k]) for j in range(max(1, len(around) - k + 1))}
                if all(len(x & have) >= overlap * len(x) for x in (set(grams[:q]), set(grams[q:]) or set(grams))):
                    out[doc, item] = max(out.get((doc, item), 0), score)
    return out


@pytest.mark.parametrize("part", [256, 20])
def test_question_and_answer_of_long_items(spark, part):
    """Items of 257 to 600 words: all of one is contained, its question alone is not, with every size of parts."""
    rng = random.Random(8)
    words = lambda tag, n: [f"{tag}{rng.randrange(4000)}" for _ in range(n)]
    items, docs = [], []
    for i, (q, a) in enumerate(((400, 200), (250, 7), (252, 8), (100, 400), (20, 258))):
        question, answer, noise = words(f"q{i}x", q), words(f"a{i}x", a), words("n", 300)
        items.append((i, " ".join(question) + "? " + " ".join(answer)))
        docs += [(10 * i, " ".join(noise + question + answer + noise)), (10 * i + 1, " ".join(noise + question[:250] + noise)), (10 * i + 2, " ".join(noise + question)), (10 * i + 3, " ".join(answer + noise))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contained(d, b, part=part).collect()}
    assert got == {(10 * i, i) for i in range(5)} == set(plain_hits(docs, items, part))


@pytest.mark.parametrize("part", [256, 20])
def test_contained_equals_brute_force_in_any_number_of_shards(spark, part):
    rng, some, items = world(30)
    items += [(900, " ".join(some(700))), (901, None), (902, ""), (903, "Tiny item"), (None, "no id but text of some length here"), (7, items[7][1])]
    docs = []
    for i in range(24):
        words = some(rng.choice([5, 200, 900]))
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = items[rng.randrange(30)][1].upper().replace(".", "!?").split()
        docs.append((i, ", ".join(words)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[30][1]), (503, " ".join(items[5][1].split()[:6])), (504, "a tiny ITEM, and no id but text of some length here")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = lambda shard: {(r.doc_id, r.item_id): round(r.score, 9) for r in D.contained(d, b, part=part, shard_bytes=shard).collect()}
    want = {k: round(v, 9) for k, v in plain_hits(docs, items, part).items()}
    assert len(want) > 9 and {(None, 3), (502, 900), (504, 903), (504, None)} <= set(want)
    assert found(16 << 20) == want == found(500)
    assert D.contained(d, b.limit(0)).count() == 0 == D.contained(d.limit(0), b).count()


def test_items_of_fewer_words_than_a_shingle():
    index = index_of([(1, b"Zeta quux"), (2, b"alone"), (3, b"one two three four"), (4, b"alpha beta gamma delta epsilon zeta eta")])
    texts = [b"much text before zeta, QUUX and behind it", b"zeta then quux apart in this text", b"here it stands alone with others", b"one two three four five", b"one two four three five", b"zeta quux", b"alpha beta gamma delta"]
    assert set(index.search(texts, 0.5, 0.8)) == {(0, 1), (2, 2), (3, 3), (5, 1)}
