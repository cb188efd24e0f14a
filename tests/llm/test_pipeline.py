"""The pipeline against a version in plain loops, and the registered queries."""

import random
import zlib

import pytest

import corpus_pipeline
from sievework.llm import queries, quality, toxicity
from sievework.llm.common import table
from tests.llm.test_texts import brute_components
from tests.oracle import connected, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic and bad documents, copies, near copies, a repeated row, null and empty texts."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghiklmno") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(r.randint(20, 120))) for _ in range(120)]
    texts += [f"{x} you idiot {x}" for x in texts[:60]] + [" ".join([word()] * 80) for _ in range(60)]
    marks = [(1, 0)] * 120 + [(1, 1)] * 60 + [(0, 0)] * 60
    labels = [(k, *m) for k, m in enumerate(marks)]
    texts += texts[100:110] + [f"{x} end" for x in texts[90:100]] + [None, "", ""]
    rows = [(k, x, "en", None, len(x or "")) for k, x in enumerate(texts)]
    rows.append(rows[5])
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_loops(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
            score = toxicity.scores([x or "" for x in kept.values()], model, {})
            want = {k: x for (k, x), s in zip(kept.items(), score, strict=True) if s < queries.TOXIC_FROM}
            bad = {k for k, x in kept.items() if "idiot" in (x or "")}
            assert len(bad & want.keys()) <= 0.1 * len(bad)
            assert len(want.keys() - bad) >= 0.9 * (len(kept) - len(bad))
        elif name == "quality":
            net = quality.fit_quality(docs, table(spark, folder, "labels"))
            score = quality.scores([x or "" for x in kept.values()], net)
            want = {k: x for (k, x), s in zip(kept.items(), score, strict=True) if s >= queries.GOOD_FROM}
        elif name == "exact_dedup":
            last = {x or "": k for k, x in sorted(kept.items())}
            want = {k: kept[k] for k in last.values()}
        else:
            groups = brute_components(kept.items())
            want = {k: x for k, x in kept.items() if groups[k][1] == k}
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        got = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        if name in ("toxicity", "quality"):  # the repeated row passes filters twice
            assert set(got) == set(want.items())
        else:
            assert got == sorted(want.items(), key=lambda x: x[0])
        kept = want
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_no_usable_labels_keep_all(spark, tmp_path):
    """An empty table of labels, labels of other documents, and those of held-out or long texts alone."""
    texts = ["some words", "you idiot", None, "word " * 3000]
    fold = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0)
    long_ = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5)
    docs = spark.createDataFrame(list(zip([fold, 1001, 1002, long_], texts, strict=True)), "doc_id long, text string")
    for k, labels in enumerate(([], [(500, 1, 0), (501, 1, 1)], [(fold, 1, 1)], [(long_, 1, 1)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        got = corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{k}")
        assert {r.doc_id for r in got.collect()} == {fold, 1001, 1002, long_}


def test_rows_that_share_an_id_are_judged_apart(spark):
    """Null ids and repeated ids with different texts: only rows equal in id and text are one."""
    r = random.Random(9)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = f"{a} end"
    rows = [(None, a), (None, b), (None, b), (None, None), (1, c), (2, c), (1, d), (3, e), (3, e), (3, f), (4, c), (5, None), (5, "")]
    kind = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(*x, str(k)) for k, x in enumerate(rows)], kind).repartition(4)
    seen = lambda x: sorted(((r.doc_id, r.text) for r in x.collect()), key=str)
    got = corpus_pipeline.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert seen(got) == sorted([(None, a), (None, b), (1, d), (3, e), (3, f), (4, c), (5, None)], key=str)
    # 7's first text is similar to 6, its second to none; 8's texts are similar to each other alone
    rows = [(6, a), (7, near), (7, b), (8, c), (8, f"{c} end"), (9, d), (9, d), (None, a), (None, e), (None, e), (10, ""), (10, f)]
    docs = spark.createDataFrame([(*x, str(k)) for k, x in enumerate(rows)], kind).repartition(4)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    found = [x for x in seen(got) if x[0] != 8]
    assert found == sorted([(6, a), (7, b), (9, d), (None, a), (None, e), (10, ""), (10, f)], key=str)
    assert [r.text in (c, f"{c} end") for r in got.where("doc_id = 8").collect()] == [True]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connected(SF), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op2_html_text", "op3_toxicity", "op4_token_counts", "op5_quality", "op8_byte_bpe", "op9_packing"])
def test_queries_return_every_row(spark, name):
    result = queries.QUERIES[name](spark, SF)
    source = table(spark, SF, "pages" if name == "op2_html_text" else "documents")
    key = "page_id" if name == "op2_html_text" else "doc_id"
    assert {r[0] for r in result.select(key).collect()} == {r[0] for r in source.select(key).collect()}


def test_held_out_quality_and_toxicity(spark):
    """Accuracy on rows that training never sees."""
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    for name, k in (("op3_toxicity", 1), ("op5_quality", 0)):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01").where("held_out").collect()
        judged = [r.predicted == labels[r.doc_id][k] for r in rows if r.doc_id in labels]
        assert len(judged) > 50 and sum(judged) / len(judged) > 0.85


def test_stages_on_empty_tables_and_clashing_names(spark, folder):
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(8)]
    rows = [(k, x) for k, x in enumerate([*texts, texts[0], f"{texts[1]} end", None, "", "x"])] + [(None, texts[2]), (None, None)]
    names = ["row", "id", "digest", "none", "number", "score", "kept", "n", "rep", "key_a", "component", "label", "y", "u", "v", "held_out"]
    made = spark.createDataFrame([(*x, *[str(k) for k in range(len(names))]) for x in rows], f"doc_id long, text string, {', '.join(f'{x} string' for x in names)}")
    want = None
    for docs in (made.select("doc_id", "text"), made):
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            found, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
            assert none.count() == 0 and none.columns == found.columns
            counts.append(sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in found.select("doc_id").collect()))
            if name != "packing":
                assert found.columns == docs.columns
        want = want or counts
        assert counts == want
    assert len(want[2]) < len(rows) and len(want[3]) < len(rows)
