import zlib

import numpy as np
import pytest

import corpus_pipeline
from trellis.llm import quality, toxicity
from trellis.llm.common import text_buffer, word_hashes

SYLLABLES = ["ta", "ri", "no", "el", "um", "so", "ke", "va", "pi", "du"]


def make(rng, n=700):
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(rng.integers(5, 200))]
        toxic, low = rng.random() < 0.25, rng.random() < 0.25
        for _ in range(3 * toxic):
            w[rng.integers(len(w))] = "grumpf" + str(rng.choice(SYLLABLES))
        if low:
            w = [x + "***" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = make(np.random.default_rng(8))
    odd = [(10_000, None), (10_001, ""), (None, "ta ri"), (10_002, "grumpfxx " * 3), (10_003, "ta " * 20_000)]
    return spark.createDataFrame(docs + odd, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None, 5), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("module", "column", "cut"), [(toxicity, 2, 0.5), (quality, 1, 0.3)])
def test_held_out_accuracy(tables, module, column, cut):
    docs, labels, truth = tables
    got = {r.doc_id: r.score for r in module.score(docs, module.train(docs, labels)).collect()}
    assert len(got) == 705 and all(0 <= s <= 1 for s in got.values())
    held = [r for r in truth if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = np.mean([(got[r[0]] >= cut) == (r[column] == 1) for r in held])
    assert right >= 0.95
    if module is toxicity:
        assert got[10_002] >= 0.5 > got[10_003]  # an ending that was never seen


@pytest.mark.parametrize(("module", "label", "cut", "least"), [(toxicity, "toxic", 0.5, 0.7), (quality, "quality", 0.3, 0.9)])
def test_held_out_rows_of_the_documents(spark, module, label, cut, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r.score for r in module.score(docs.select("doc_id", "text"), model).select("doc_id", "score").collect()}
    held = [(got[r.doc_id] >= cut, r[label] == 1) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in got]
    caught = [a for a, b in held if b]
    alone = [not a for a, b in held if not b]
    assert len(held) > 500 and np.mean(caught) >= least and np.mean(alone) >= 0.9, (np.mean(caught), np.mean(alone))
    # one text by itself scores as it does among others
    some = docs.where("doc_id % 997 = 0").select("doc_id", "text").collect()
    for r in some:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        assert abs(model.score(data, np.array([0, len(data)]))[0] - got[r.doc_id]) < 1e-6


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_and_no_documents(spark, module):
    docs = spark.createDataFrame([(1, "some text", 9.0), (2, None, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [round(r.score, 3) for r in module.score(docs, module.train(docs, labels)).collect()] == [0.5, 0.5]
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).collect() == []


def test_word_hashes_stop_at_texts():
    import pyarrow as pa

    data, at = text_buffer(pa.array(["ab CD", "ab", "", "cd\x0bAB"]))
    h, first = word_hashes(data, at[:-1])
    assert len(h) == 5 and h[0] == h[2] == h[4] and h[1] == h[3] and first.tolist() == [0, 3, 5, 7, 10]


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs, labels = make(rng, 300)
    fresh = lambda n: " ".join("".join(rng.choice(SYLLABLES, 3)) for _ in range(n))
    passage, line = fresh(60), fresh(12)
    base = fresh(80)
    planted = [(1000, base), (1001, base.replace(base.split()[3], "changed")), (1002, passage + " " + fresh(40)), (1003, line + "\n" + fresh(50)), (1004, line + "x\n" + fresh(50)), (1005, line), (1006, "grumpfta grumpfri grumpfno ta"), (1007, fresh(70)), (None, fresh(30)), (1008, None)]
    rows = [(i, t, "en", "s", len(t or ""), "mine", "mine") for i, t in docs + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, rows string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "rows"]
        path = f"{tmp_path}/stage{len(kept)}"
        df.write.parquet(path)
        df = spark.read.parquet(path)
        kept.append({r.doc_id: r for r in df.collect()})
    assert 1006 not in kept[0] and {1000, 1007, None, 1008} <= kept[0].keys()
    assert 1005 not in kept[1] and "\n" not in kept[1][1004].text and kept[1][1004].n_chars == len(kept[1][1004].text) and "\n" in kept[1][1003].text
    assert 1000 in kept[2] and 1001 not in kept[2]
    assert 1002 in kept[2] and 1002 not in kept[3] and {1007, None, 1008} <= kept[3].keys()
    assert {r.score + r["rows"] for r in kept[3].values()} == {"minemine"}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept[3].keys()
