import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_planted_documents(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choice(["th", "er", "an", "on", "re", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocab) + ("." if r.random() < 0.1 else "") for _ in range(n)).capitalize() + "."

    texts = {k: prose(r.randint(30, 160)) for k in range(150)}
    item = prose(25)
    passage = prose(60)
    near = texts[3].split()
    near[len(near) // 2] = "thanreti"
    planted = {
        200: texts[0],  # exact copy
        201: " ".join(near),  # near copy
        202: f"{prose(50)} {item} {prose(50)}",  # leak
        203: f"{prose(40)} {passage} {prose(40)}",
        204: f"{prose(40)} {passage} {prose(40)}",
        205: "QX!! ZZ!! " * 30,  # junk
        206: "",
        207: None,
    }
    rows = [(k, t, "en", "s", len(t or "")) for k, t in (texts | planted).items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows + rows[:2], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(100)] + [(205, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())

    good = stage["quality"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and not {205, 206, 207} & set(ids(good)) and len(ids(good)) >= 154
    lined = {x.doc_id: x for x in stage["line_dedup"](spark, docs, str(tmp_path)).collect()}
    assert 200 not in lined and lined[206].text == "" and lined[207].text is None
    assert passage in lined[203].text and passage not in lined[204].text and lined[204].n_chars == len(lined[204].text)
    one = stage["ngram_jaccard"](spark, docs, str(tmp_path))
    assert ids(one) == sorted((texts.keys() | planted.keys()) - {200, 201})
    assert ids(stage["decontamination"](spark, docs, str(tmp_path))) == sorted([*(texts.keys() | planted.keys()) - {202}, 0, 1])
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == out.count() and {0, 3, 203, 204} <= set(got) and not set(got) & {200, 202, 205, 206, 207}
    assert got[5].decoded_sha256 == hashlib.sha256(texts[5].encode()).hexdigest()

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
