import hashlib
import random

import pytest

from strandloom.llm import substring_dedup as S


def plain(rows, window=20):
    """Brute force over (doc_id, text) in order."""
    seen, out = set(), []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ü.", "a\x00b"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [some(n) for n in (19, 20, 21, 60, 200)]
    rows = []
    for i in range(160):
        words = some(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i * 7 % 160, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200, None), (201, ""), (202, "x " * 3000), (203, "a b " * 100), (204, " ".join(some(20000))), (205, rows[3][1]), (-9223372036854775807, rows[5][1])]
    return rows


@pytest.mark.parametrize("chunk", [1000, 1 << 20])
def test_digest_equals_brute_force(spark, chunk):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in S.digest(df, chunk_bytes=chunk).collect())
    assert got == sorted(plain(sorted(rows)))


def test_text_is_cut_and_other_columns_stay(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, "start " + passage + "\nend", "en", 5), (2, "other\n" + passage + "  tail here\n", None, None), (3, None, "x", 1), (4, "as  it is\n", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, docs int")
    got = {r.doc_id: tuple(r) for r in S.remove_repeats(df).collect()}
    assert got == {1: rows[0], 2: (2, "other  tail here", None, None), 3: rows[2], 4: rows[3]}
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_null_and_equal_ids(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(None, passage), (3, passage), (3, passage)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.n_removed) for r in S.digest(df).collect())
    assert got == [(0, 0), (3, 25), (3, 25)]


def test_one_level_alone(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in S.digest(df, window=20, base=20).collect()) == sorted(plain(sorted(rows)))
    assert sorted(tuple(r) for r in S.digest(df, window=20, base=5).collect()) == sorted(plain(sorted(rows)))


def test_colliding_words_stay(spark):
    """The Thue-Morse word of two letters and its counterpart collide in any polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{lead} {word}"), (2, f"{lead} {other}"), (3, f"{lead} {other}"), (4, f"{other} {lead}"), (5, f"{word} {lead}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.digest(df).collect()) == [(1, 0), (2, 0), (3, 20), (4, 0), (5, 0)]
