import numpy as np
import zlib

from graphloom.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    y = np.array([(rows[x.doc_id].score, x.toxic) for x in labels if x.doc_id in rows and rows[x.doc_id].held_out and x.toxic is not None])
    good, bad = y[y[:, 1] == 1, 0], y[y[:, 1] == 0, 0]
    assert (good[:, None] > bad[None, :]).mean() >= 0.85


def test_held_out_labels_are_never_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.classify(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_grams_equal_plain_slices():
    texts = ["Abc", "", "abcabc", "äöü ß", "x"]
    who, what = toxicity.grams(texts)
    seen = {}
    for i, t in enumerate(texts):
        s = f" {t.lower()} "
        plain = {s[k : k + n] for n in toxicity.SIZES for k in range(len(s) - n + 1)}
        assert len(set(what[who == i].tolist())) == len(plain)
        seen[i] = plain
    assert set(what[who == 0].tolist()) & set(what[who == 2].tolist())


def test_edges(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, "vile rubbish words" if i % 4 == 0 else "kind pleasant words", "a") for i in range(60)] + [(61, None, "a"), (62, "", "a"), (None, "x", "a"), (3, "again", "a")]
    out = toxicity.classify(docs(rows).withColumnRenamed("lang", "score"), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert toxicity.classify(docs([]), labels).count() == 0
    assert toxicity.classify(docs(rows), labels.limit(0)).count() == len(rows)
