import numpy as np
import xxhash

from strandloom.llm import near_dedup as N


def plain_fingerprint(text):
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n\t", "One", "one two", "One TWO three", "É x a b c d e", "w " * 700, "x" * 5000 + " y z " + "q" * 40] + ["lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 9 + w for w in ("a", "b", "c", "a")]


def test_fingerprints_equal_plain_ones():
    texts = [(t or "").encode() for t in TEXTS]
    assert N.fingerprint_texts(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_keys_meet_up_to_three_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in rng.choice(64, i % 3 + 1, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.concatenate([base, near])
    keys, rows = N.fuzzy_keys(fps, N.Golay())
    a, b, _ = N.bucket_links(keys, fps[rows], 3)
    found = set(zip(a.tolist(), b.tolist()))
    assert all((min(x, y), max(x, y)) in found for x, y in zip(base.tolist(), near.tolist()))


def plain_components(ids, fps, bits=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [min((d for d, x in zip(ids, label) if x == label[i] and d is not None), default=None) for i in range(len(fps))]


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = []
    for i, c in enumerate(centre):
        for _ in range(40 if i == 0 else 8):
            x = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            fps.append(int(x))
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in set(fps)]
    df = spark.createDataFrame(rows, "fp long")
    roots = {r.node: r.root for r in N.components(N.links(df, len(rows), block=8)).collect()}
    u = [r[0] for r in rows]
    want = plain_components(u, [x & (2**64 - 1) for x in u])
    assert [roots.get(x, x) for x in u] == want


def test_near_duplicates_of_odd_rows(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.fp & (2**64 - 1), r.component_id) for r in N.near_duplicates(df).collect())
    fps = [plain_fingerprint((t or "").encode()) for _, t, _ in rows]
    comp = plain_components([r[0] for r in rows], fps)
    assert got == sorted(((r[0] if r[0] is not None else -1), f, c) for r, f, c in zip(rows, fps, comp))
    assert N.near_duplicates(df.limit(0)).count() == 0
