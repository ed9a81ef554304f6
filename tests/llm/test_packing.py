import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.dictionaries(st.integers(1, 15), st.integers(0, 3), max_size=5))
def test_fullest_equals_brute_force(room, counts):
    items = [k for k, n in counts.items() for _ in range(n)]
    best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= room)
    got = P.fullest(room, counts)
    assert sum(got) == best and all(got.count(k) <= counts.get(k, 0) for k in got)


def test_plan_uses_every_piece_once_and_few_bins():
    rng = random.Random(2)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[min(4096, int(rng.expovariate(1 / 600)) + 1)] += 1
    steps = P.plan(dict(counts))
    used = defaultdict(int)
    for times, bin_ in steps:
        assert sum(bin_) <= 4096
        for x in bin_:
            used[x] += times
    assert used == counts
    assert sum(t for t, _ in steps) <= 1 + -(-sum(k * v for k, v in counts.items()) // 4096)


def test_word_ids_equal_the_whole_texts():
    t = Tokenizer.from_file(P.default_tokenizer())
    words = P.WordIds(P.default_tokenizer(), most=50)
    for text in ["Hello, World's don't 123abc É straße ÀÇ ñ|x <|endoftext|> a<|startoftext|>b", "ΣΑΣ İx ½² ﬁ é x y\x1cz 　", "", "  \n", "can't'll''s 'S DON'T " * 30, "ªµº ×÷ ÿŸ", "z" * 300, "日本語 한국어 🙂👍🏽"]:
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "bétà", "x1"]) for _ in range(rng.choice([3, 50, 900, 9000]))), "z") for i in range(60)]
    rows += [(60, None, "z"), (61, "", None), (5, rows[5][1], "z"), (None, "null id", "z")] + [(100 + i, "same text", "z") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = P.pack(df, shares=4).collect()
    t = Tokenizer.from_file(P.default_tokenizer())
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 2 + -(-sum(r.length for r in got) // 4096)
    assert P.pack(df.limit(0)).count() == 0


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    import public_tokenizers

    dealt = json.load(open(P.default_tokenizer(), encoding="utf-8"))
    assert P.keeps_apart(P.default_tokenizer())
    paths = [public_tokenizers.path("byte_bpe_50k.json")]
    for name, change in {"cased": {"normalizer": None}, "blank": {"added_tokens": [*dealt["added_tokens"], {**dealt["added_tokens"][-1], "id": 0, "content": "two words"}]}, "cut": {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}}.items():
        paths.append(str(tmp_path / f"{name}.json"))
        json.dump(dealt | change, open(paths[-1], "w", encoding="utf-8"))
    rng = random.Random(5)
    letters = list("aB c\n\t  é'sXYZ09-<|>") + ["two words", "ǅ", "漢", "e\u0301"]
    for path in paths:
        assert not P.keeps_apart(path)
        words, whole = P.WordIds(path), Tokenizer.from_file(path)
        whole.no_truncation()
        for _ in range(60):
            text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
            assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text():
    words, whole = P.WordIds(P.default_tokenizer()), Tokenizer.from_file(P.default_tokenizer())
    for raw in (b"\xff", b"ab\xc3 cd\xe2\x82", b"\x80\n\xf0\x9f plain"):
        want = whole.encode(raw.decode(errors="replace"), add_special_tokens=False).ids
        assert np.frombuffer(words.of(raw), "<u4").tolist() == want
