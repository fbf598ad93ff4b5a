from collections import Counter

from samples import corpus, make
from test_dedup import brute_exact, brute_near
from test_packing_tokens_mixing import check_packing

import corpus_pipeline
from logstrata.llm import mixing, quality_classifier


def test_stages_against_brute_force(spark, tmp_path):
    texts = corpus(30, 260)
    texts = [t if i % 7 else " | ".join(t.upper().split()) + "!!" for i, t in enumerate(texts)] + [None, ""]
    sf_dir = str(tmp_path)
    make(spark, texts, ["a", "b", "c"]).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    def through(k, docs):
        path = f"{sf_dir}/stage{k}"
        stages[k](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    good = through(0, docs)
    want = {r.doc_id for r in quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in good.collect()} == want and 0 < len(want) < len(texts)
    given = sorted((r.doc_id, r.text) for r in good.collect())

    single = through(1, good)
    want = {k for _, k, _, _ in brute_exact(given)}
    given = sorted((r.doc_id, r.text) for r in single.collect())
    assert {d for d, _ in given} == want and len(given) == len(want)

    apart = through(2, single)
    want = {c for _, c, _, _ in brute_near(given)}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(want) and len(want) < len(given)

    mixed = through(3, apart)
    taken = {r.doc_id: r.taken for r in mixing.mix(apart).collect() if r.taken}
    have = Counter()
    for r in mixed.collect():
        have[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert have == Counter(taken)

    packed = through(4, mixed)
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()])
    for k in range(4):
        assert spark.read.parquet(f"{sf_dir}/stage{k}").columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_one_row_of_each_group_where_doc_ids_repeat(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c, d = (" ".join(f"{x}{w}" for w in words) for x in "abcd")
    near_b = b.replace("bw7 ", "changed ")
    lone = [None, "null one", None, "s", 8]
    exact_rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 2), (4, b, "en", "s", 3), (4, c, "en", "s", 4), (4, c.replace(" ", "  "), "de", "s", 5), (None, a, None, "s", 6), (None, d, None, "s", 7), (None, d, None, "s", 7), lone, (5, None, "en", "s", 0), (5, "", "en", "s", 0)]
    make_docs = lambda rows: spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    keyed = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, " ".join((r.text or "").split())) for r in rows)
    want = [(False, 1, a), (False, 2, b), (False, 4, c), (False, 5, ""), (True, 0, d), (True, 0, "null one")]
    assert keyed(corpus_pipeline.exact(spark, make_docs(exact_rows), "").collect()) == want

    # the same with near copies; 6 has two texts of one class, 7 two classes of its own, and one class has null ids only
    e, f, g, h = (" ".join(f"{x}{w}" for w in words) for x in "efgh")
    near_rows = [*exact_rows, (4, near_b, "en", "s", 3), (6, e, "en", "s", 1), (6, e.replace("ew7 ", "changed "), "en", "s", 1), (7, f, "en", "s", 1), (7, g, "en", "s", 1), (9, f.replace("fw7 ", "changed "), "en", "s", 1), (None, h, "en", "s", 1), (None, h.replace("hw7 ", "changed "), "en", "s", 1)]
    got = keyed(corpus_pipeline.near(spark, make_docs(near_rows), "").collect())
    assert [x[:2] for x in got] == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 6), (False, 7), (False, 7)] + [(True, 0)] * 3
    assert {x[2][0] for x in got if x[1] == 7} == {"f", "g"} and {x[2][0] for x in got if x[0]} == {"d", "h", "n"}
    assert (False, 2, b) in got and (False, 4, c) in got


def test_stages_on_awkward_tables(spark, odd, none, awkward, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, and empty tables."""
    sf_dir = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    rows = [r[:2] for r in awkward[0]]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out, nothing = stage(spark, odd, sf_dir), stage(spark, none, sf_dir)
        assert nothing.count() == 0 and nothing.columns == out.columns
        got = out.collect()
        counts.append(len(got))
        if name != "best-fit packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert {r.doc_id for r in got} <= {d for d, _ in rows}
    assert counts[0] <= len(rows)
    assert counts[1] == len({h for _, _, _, h in brute_exact(rows)})
    assert 0 < counts[2] <= counts[1] and counts[3] > 0
    long = sum(len((t or "").split()) > 4096 for _, t in rows)
    assert counts[4] >= len(rows) + long
