import random

import corpus_pipeline as P
from strandloom.llm import near_dedup as N

SF = "/root/testdata/sf0.001"


def test_representatives_of_odd_ids(spark):
    long = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 9
    rows = [(1, long + "a", "x"), (2, long + "a", "y"), (None, long + "a", "z"), (3, "other words here now", "n"), (3, "quite different words there", "n"), (3, "other words here now", "n"), (None, "lonely text", "q"), (None, "lonely text", "q"), (7, None, "e"), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(((r.doc_id or 0), r.text or "") for r in N.representatives(df).collect())
    assert got == sorted([(1, long + "a"), (3, "other words here now"), (3, "quite different words there"), (0, "lonely text"), (7, "")])
    plain = df.where("doc_id in (1, 2, 7, 8)")
    assert sorted(r.doc_id for r in N.representatives(plain).collect()) == [1, 7]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(1)
    some = lambda n: " ".join("".join(rng.choice(["th", "in", "on", "wh", "er"]) for _ in range(4)) for _ in range(n))
    passage = some(60)
    planted = [(10**6, some(80) + " " + passage), (10**6 + 1, some(80) + " " + passage + " " + some(9)), (10**6 + 2, some(50) + " " + bench[0]), (10**6 + 3, some(300)), (10**6 + 5, "12 %% 34"), (10**6 + 6, None)]
    planted += [(10**6 + 4, planted[3][1] + " x")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in planted], docs.schema))
    stages = dict(P.STAGES)
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id - 10**6: r for r in docs.where(f"doc_id >= {10**6}").collect()}
    assert list(stages) == list(seen)
    assert set(seen["language_id"]) == {0, 1, 2, 3, 4}
    assert set(seen["simhash_near_dedup"]) == {0, 1, 2, 3}
    assert passage in seen["substring_dedup"][0].text and passage not in seen["substring_dedup"][1].text
    assert seen["substring_dedup"][1].n_chars == len(seen["substring_dedup"][1].text)
    assert set(seen["benchmark_decontamination"]) == {0, 1, 3}
    assert docs.select("doc_id").distinct().count() > 100


def scratch(spark):
    import os

    from strandloom.functions.layout import shared_dir

    return set(os.listdir(shared_dir(spark).replace("file://", "").replace("file:", "")))


def test_stages_delete_their_own_scratch_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = N.near_duplicates(docs)
    before = scratch(spark)
    out = P.run(spark, SF)
    left = scratch(spark) - before
    assert {x.rsplit("-", 1)[0] for x in left} == {"pieces", "counts"}
    assert out.count() > 100 and frame.count() == docs.count()


def test_stages_of_no_documents_and_of_null_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(1, None, None, None, None), (2, None, "en", "x", 3), (None, None, None, None, None)], docs.schema)
    for name, start in (("none", docs.limit(0)), ("nulls", nulls)):
        for stage, f in P.STAGES:
            start.write.parquet(f"{tmp_path}/{name}-{stage}")
            kept = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            got = f(spark, kept, SF).collect()
            if name == "none" or stage == "language_id":
                assert got == []
            elif stage == "simhash_near_dedup":
                assert [r.doc_id for r in got] == [1]
            elif stage == "best_fit_packing":
                assert sorted((r.length, r.offset) for r in got) == [(1, 0), (1, 1), (1, 2)]
            else:
                assert len(got) == 3 and {r.text for r in got} == {None}
