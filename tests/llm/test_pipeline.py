import random

import pytest
from test_dedup import contaminated, lines, near, words_of

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, make_docs, word_list, tmp_path_factory):
    """Documents with repeated lines, near copies, benchmark passages and junk, written as tables."""
    r = random.Random(41)
    folder = str(tmp_path_factory.mktemp("corpus"))
    bench = [(i, " ".join(r.choices(word_list, k=30))) for i in range(5)]
    shared = [" ".join(r.choices(word_list, k=12)) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = [" ".join(r.choices(word_list, k=r.randint(20, 60)))]
        if i % 3 == 0:
            parts.append(r.choice(shared))
        if i % 11 == 0:
            parts.append(r.choice(bench)[1])
        rows.append((i, "\n".join(parts), "en", None))
    for i in range(80, 100):  # near copies in one line, so that line dedup leaves them
        w = rows[i - 80][1].split()
        if len(w) > 40:
            w[3], w[30] = "changed", "altered"
        rows.append((i, " ".join(w), "en", None))
    rows += [(200, None, "en", None), (201, "", "en", None), (202, "12 34 !!", "en", None), (203, rows[5][1], None, "x")]
    make_docs([r[:3] for r in rows], clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, bench


def test_stages_are_the_dealt_ones():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "benchmark_decontamination", "encode_pieces",
    ]


def test_each_stage_equals_brute_force(spark, corpus):
    folder, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, language), (_, line), (_, dedup), (_, decontaminate), (_, encode) = corpus_pipeline.STAGES

    def rows(df):
        assert df.columns == COLUMNS and df.schema == docs.schema
        return [(x.doc_id, x.text) for x in df.collect()]

    clear = language(spark, docs, folder).cache()
    first = rows(clear)
    assert {d for d, _ in first} == {d for d, _ in rows(docs)} - {200, 201, 202}
    lined = line(spark, clear, folder).cache()
    second = rows(lined)
    kept = lines(first)
    assert {d for d, _ in second} == {d for d, k in kept.items() if k}
    assert all(t == "\n".join(x for i, x in enumerate(dict(first)[d].split("\n")) if i in kept[d]) for d, t in second)
    assert all(x.n_chars == len(x.text) for x in lined.collect())
    single = dedup(spark, lined, folder).cache()
    third = rows(single)
    assert {d for d, _ in third} == {d for d, (_, c) in near(second, 80).items() if c == d}
    assert len(third) < len(second)
    clean = decontaminate(spark, single, folder).cache()
    fourth = rows(clean)
    assert {d for d, _ in fourth} == {d for d, f in contaminated(third, bench).items() if not f}
    assert 0 < len(fourth) < len(third)
    last = encode(spark, clean, folder).collect()
    assert {x.doc_id for x in last} == {d for d, _ in fourth} and all(x.round_trip and x.n_ids > 0 for x in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((x.doc_id, x.ids_crc32) for x in whole) == sorted((x.doc_id, x.ids_crc32) for x in last)
    assert all(words_of(t) for _, t in fourth)


def test_queries_are_registered():
    from redline.llm.catalog import QUERIES, SQL

    assert sorted({int(q[2:].split("_")[0]) for q in QUERIES}) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
