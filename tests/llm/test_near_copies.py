import random

import numpy as np

import corpus_pipeline as P
from strandloom.llm import common as C
from strandloom.llm import near_copies as M
from strandloom.llm import near_dedup as N


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(rows):
    """The least id of each component of pairs of similarity 0.8 and more."""
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                label = [label[i] if x == label[j] else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label))


def planted(seed=4):
    """Texts, most with copies of similarity 0.5 to 1, some of these copied again."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(900)]
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b c d e f"]
    for _ in range(90):
        w = rng.choices(vocab, k=rng.randint(30, 300))
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w = [*w]
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def test_stage_equals_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    sets = [plain_set(t) for _, t in rows]
    near = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i] if a != b]
    assert sum(0.8 <= x < 0.95 for x in near) > 30 and sum(0.6 < x < 0.8 for x in near) > 20
    got = dict(P.STAGES)["simhash_near_dedup"](spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    rows = planted(5) + [(10**4 + i, " ".join(["same"] * i + [f"w{j}" for j in range(80)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in M.representatives(df).collect()) == plain_kept(rows)


def test_odd_ids(spark):
    long = " ".join(f"w{j}" for j in range(60))
    rows = [(1, long + " a"), (2, long + " b"), (None, long + " c"), (3, "other words here now ok"), (3, "quite different words there ok"), (3, "other words here now ok"), (None, "lonely text"), (None, "lonely text"), (7, None), (8, "")]
    got = sorted(((r.doc_id or 0), r.text or "") for r in M.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, long + " a"), (3, "other words here now ok"), (3, "quite different words there ok"), (0, "lonely text"), (7, "")])
    assert M.representatives(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_candidates_come_by_simhash():
    """Fingerprints as plain loops make them; pairs of 0.8 to 0.95 are near and share a key, unrelated ones are not near."""
    texts = [t.encode() for _, t in planted(6) if t and len(t) > 100]
    h, size = M.shingle_sets(texts)
    sims = M.sketches(h, size)
    own = h[: size[0]]
    for salt, sim in zip(M._SALT, sims[0], strict=True):
        mixed = [int(x) for x in C.mix(own ^ salt)]
        assert int(sim) == sum((2 * sum(x >> bit & 1 for x in mixed) > len(mixed)) << bit for bit in range(64))
    keys, sets = M.sim_keys(sims, N.Golay()), [plain_set(t.decode()) for t in texts]
    close, far = [], []
    for i in range(len(texts)):
        for j in range(i):
            s, met = jaccard(sets[i], sets[j]), bool(M.near(sims[i, :2], sims[j, :2]))
            if 0.8 <= s < 0.95:
                close.append(met and (keys[i] == keys[j]).any())
            elif s < 0.1:
                far.append(met)
    assert len(close) > 100 and sum(close) >= 0.98 * len(close) and not any(far)


def test_one_first_fingerprint_for_several_sets(spark):
    """Nodes that share a first fingerprint are candidates, whatever the others are, and those near them too."""
    rows = [(1, 5, 0), (2, 5, 2**64 - 1), (3, 4, 0), (4, 0xAAAAAAAAAAAAAAAA, 0x5555555555555555)]
    sims = lambda a, b: np.array([a] + [b] * (M.SIMS - 1), "<u8").tobytes()
    df = spark.createDataFrame([(fp, int(np.uint64(a).view(np.int64)), sims(a, b)) for fp, a, b in rows] + [(0, None, None)], "fp long, sim long, sims binary")
    got = sorted((r.node, r.root) for r in N.components(M.candidates(df, len(rows))).collect())
    assert got == [(1, 1), (2, 1), (3, 1)]


def test_large_runs_equal_small_ones(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (12, 2), dtype=np.uint64)
    sims = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (12, 2), dtype=np.uint64)) for _ in range(30)])
    keys = np.zeros(len(sims), np.uint32)
    reached = []
    for most in (10**6, 64):
        monkeypatch.setattr(M, "SMALL", most)
        label = {int(x): int(x) for x in sims[:, 0]}
        for a, b in M.bucket_links(keys, sims).tolist():
            label = {x: label[a] if y == label[b] else y for x, y in label.items()}
        groups = {}
        for x, y in label.items():
            groups.setdefault(y, set()).add(x)
        reached.append(sorted(map(sorted, groups.values())))
    assert reached[0] == reached[1] and len(reached[0]) == 12


def test_a_group_gives_as_many_links_as_rows():
    rng = np.random.default_rng(4)
    pairs = np.concatenate([rng.integers(g * 100, g * 100 + 40, (300, 2), dtype=np.uint64) for g in range(5)] + [np.array([[7000, 7001], [7002, 7001], [7003, 7002]], np.uint64)])
    got = M.stars(pairs[rng.permutation(len(pairs))])
    assert len(got) <= 5 * 39 + 3 and {tuple(x) for x in got.tolist() if x[0] > 6999} == {(7001, 7000), (7002, 7000), (7003, 7000)}
    assert all(a // 100 == b // 100 and a > b for a, b in got.tolist()) and len(M.stars(np.zeros((0, 2), np.uint64))) == 0


def test_links_do_not_grow_with_shared_keys():
    """All buckets together connect what brute force connects, by a few links a row, and twice the group gives about twice the links."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, M.SIMS, dtype=np.uint64)
    flips = np.packbits(rng.random((800, M.SIMS, 64)) < 0.08, axis=2).view("<u8")[..., 0]
    alone = rng.integers(0, 2**64, (50, M.SIMS), dtype=np.uint64)
    made = []
    for n in (400, 800):
        sims = np.concatenate([base ^ flips[:n], alone, alone[:20] ^ flips[:20]])
        keys = M.sim_keys(sims, N.Golay())
        bucket = (C.mix(keys.astype(np.uint64)) % np.uint64(97)).ravel()
        row, links = np.repeat(np.arange(len(sims)), M.KEYS), []
        for at in (np.flatnonzero(bucket == i) for i in range(97)):
            links.append(M.stars(M.bucket_links(keys.ravel()[at], sims[row[at], :2])))
        made.append(sum(map(len, links)))
        a, b = (np.array(x) for x in zip(*((i, j) for i in range(len(sims)) for j in range(i) if M.near(sims[i, :2], sims[j, :2]) and (keys[i] == keys[j]).any()), strict=True))
        assert len(a) > 20 * len(sims)
        plain = M.stars(np.stack([sims[a, 0], sims[b, 0]], axis=1))
        assert sorted(map(tuple, M.stars(np.concatenate(links)).tolist())) == sorted(map(tuple, plain.tolist()))
        assert made[-1] < 12 * n, made
    assert made[1] < 2.5 * made[0], made


def test_texts_made_to_collide_stay_two(spark):
    """Words of the letters a and b in the order of the Thue-Morse sequence and its complement: polynomial hashes modulo a power of two
    give both one value."""
    for n in (1024, 2048, 4096):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = one.translate(str.maketrans("ab", "ba"))
        texts = [f"the first words {w} and then some more words" for w in (one, other)]
        nodes = M.text_nodes([t.encode() for t in texts])
        assert nodes[0] != nodes[1]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")
    assert M.representatives(docs).count() == 2
