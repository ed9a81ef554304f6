from collections import Counter, defaultdict

import pytest

from strandloom.llm import divergence as D


def words(text):
    out, word = [], b""
    for b in (text or "").encode() + b" ":
        if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F:
            if word:
                out.append(word)
            word = b""
        else:
            word += bytes([b + 32]) if 0x41 <= b <= 0x5A else bytes([b])
    return out


def plain(rows, least):
    """The audit, straight from its definition: every group against every kept term."""
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        own = Counter(words(text))
        found[lang or "", source or ""].update(own)
        docs[lang or ""].update(own.keys())
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        group = {s: c for (x, s), c in found.items() if x == lang}
        whole = sum(group.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in group.items()}, shares(whole)
        for s in group:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in group if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if group[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = [(i if isinstance(i, bytes) else i.encode(), v) for i, v in items]
                items.sort(key=lambda x: (-x[1], x[0]))
                out += [(lang, s, part, i.decode(), v, n) for n, (i, v) in enumerate(items, 1) if part == "pair" or n <= D.TOP]
    return sorted(out)


def told(spark, rows, least, extra=False):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    if extra:
        for c in ("term", "item", "value", "n", "V", "p", "z"):
            df = df.withColumn(c, D.F.lit("x"))
    pairs, terms = D.audit(df.repartition(3), least)
    rows = [("pair", r) for r in D.ranked(pairs).collect()] + [("term", r) for r in terms.collect()]
    return sorted((r.lang, r.source, part, r["item"], r.value, r["rank"]) for part, r in rows)


def corpus():
    rows = []
    for i in range(240):
        source = "hot" if i % 3 else f"s{i % 5}"
        text = " ".join(f"w{'xyzuvabcdefgh'[(i * j) % 13]}" for j in range(1 + i % 9)) + (" Same THING, naïve x-ray" if i % 2 else "")
        rows.append((text, "en" if i % 4 else "de", source))
    rows += [(None, None, None), ("", "en", "void"), ("only rare", "fr", "a"), ("other", "fr", "b"), ("a\x00b_c`d{e\x7fÉé", None, "x"), ("Same thing", "en", "s0")] + [("ties ties", "en", f"t{i}") for i in range(3)]
    return rows


@pytest.mark.parametrize("least", [1, 3, 30])
def test_equals_definition(spark, least):
    rows = corpus()
    assert told(spark, rows, least) == plain(rows, least)


def test_extra_columns_and_empty_tables(spark):
    rows = corpus()[:60]
    assert told(spark, rows, 2, extra=True) == plain(rows, 2)
    assert told(spark, [], 2) == []


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    text = ("Wort " * 300_000 + "z" * 30_000 + " end").encode()
    assert Counter(D.terms_of(text)) == Counter(words(text.decode()))
    monkeypatch.setattr(D, "PIECE", 8)
    assert list(D.terms_of(b"one two,three  fourfourfourfourfour five")) == [b"one", b"two", b"three", b"fourfourfourfourfour", b"five"]


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**14 + 3, 7 * 10**15 + 1, 12345)], "c long, n long, v long")
    got = df.select(D.share(D.F.col("c"), D.F.col("n"), D.F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (10**14 + 8) // (7 * 10**15 + 1 + 5 * 12345)
