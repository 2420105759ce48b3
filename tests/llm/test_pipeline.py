"""The stages one by one and together, on the generated tables and on planted cases."""

import random

import pytest

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.test_setjoin import brute
from tidemark.llm import bpe, toxicity

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stage_order():
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "pii", "best_fit_packing"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {"documents": spark.read.parquet(f"{SF}/documents.parquet").toPandas()}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        out[name] = docs.toPandas()
        docs = spark.createDataFrame(out[name], docs.schema) if name != P.STAGES[-1][0] else docs
    return out


def test_columns(stages):
    assert all(list(stages[n].columns) == P.COLUMNS for n, _ in P.STAGES[:-1])
    for n, _ in P.STAGES[1:-1]:
        assert (stages[n].text.str.len() == stages[n].n_chars).all()


def test_toxic_documents_go(spark, stages):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    scorer = toxicity.Scorer(model)
    want = [i for i, t in zip(stages["documents"].doc_id, stages["documents"].text) if scorer.scores([t.lower().encode()])[0] < 0.5]
    assert sorted(stages["toxicity"].doc_id) == sorted(want)


def test_near_duplicates_go(stages):
    rows = list(zip(stages["line_dedup"].doc_id.tolist(), stages["line_dedup"].text.tolist()))
    want = [i for i, _, c in brute(rows, 5, 80, 100) if i == c]
    assert sorted(stages["ngram_jaccard"].doc_id) == want


def test_packed_ids(stages):
    lib = bpe.encoder(bpe.default_tokenizer()).library
    last = stages["best_fit_packing"]
    total = last.groupby("doc_id").length.sum()
    for i, t in zip(stages["pii"].doc_id, stages["pii"].text):
        assert total[i] == len(lib.encode(t, add_special_tokens=False).ids) + 1
    assert set(last.doc_id) == set(stages["pii"].doc_id)


def test_run_is_the_stages(spark, stages):
    got = P.run(spark, SF).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, stages["best_fit_packing"][columns].values.tolist()))


def test_planted(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(30))
    clean = ["\n".join(line() for _ in range(3)) for _ in range(5)]
    passage = line() + " " + line()
    words = clean[0].split(" ")
    words[7] = "changed"
    near = " ".join(words).replace("\n", " ")
    rows = [(i, t) for i, t in enumerate(clean)] + [(10, clean[1]), (11, clean[0].replace("\n", " ")), (12, near), (13, passage + "\n" + line()), (14, line() + "\n" + passage), (15, None), (16, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    lines = P.drop_repeated_lines(spark, docs, SF)
    kept = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert 10 not in kept and passage in kept[13] and passage not in kept[14] and all(kept[i] == clean[i] for i in range(5))
    alone = {r["doc_id"] for r in P.drop_near_duplicates(spark, lines, SF).collect()}
    assert not alone & {11, 12} and alone >= {0, 1, 2, 3, 4, 13, 14, 15, 16}


def test_empty_documents(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_nulls_everywhere(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, "a b c", None, None, 5)], COLUMNS)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 3
    assert P.STAGES[-1][1](spark, docs, SF).count() == 3
