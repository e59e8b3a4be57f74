import corpus_pipeline
import tiktoken
import public_tokenizers
from graphloom.llm import bpe, mixing, ngram_join, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


def rows_of(df, names=("doc_id", "text", "source")):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_stages_equal_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = corpus_pipeline.common.stored(stages["toxicity"](spark, docs, SF))
    scores = {r.doc_id: r.predicted for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert rows_of(clean) == rows_of(docs.filter(~docs.doc_id.isin([i for i, p in scores.items() if p])))
    one = corpus_pipeline.common.stored(stages["n-gram Jaccard join"](spark, clean, SF))
    groups = {}
    for r in ngram_join.near_duplicates(clean).collect():
        groups.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(min(g) for g in groups.values())
    masked = corpus_pipeline.common.stored(stages["secret scans"](spark, one, SF))
    assert rows_of(masked) == sorted(((r.doc_id, secret_scan.mask(r.text, secret_scan.all_spans(r.text)[1]), r.source) for r in one.collect()), key=str)
    mixed = corpus_pipeline.common.stored(stages["mixing sources to target weights"](spark, masked, SF))
    copies = {r.doc_id: r.copies for r in mixing.mix(masked).collect() if r["size"]}
    got = [r.doc_id for r in mixed.collect()]
    assert all(got.count(i) == n for i, n in copies.items())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(got)
    assert all(r.round_trip and list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) for r in last)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_edges(spark, docs):
    rows = [(1, None, None), (2, "", "a"), (3, "word " * 9, "a"), (3, "word " * 9, "a"), (None, "x y", "a"), (5, "word " * 9, "b")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs([]), SF).count() == 0
        assert stage(spark, docs(rows), SF).count() > 0
    kept = corpus_pipeline.near_duplicates_stage(spark, docs(rows), SF).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3]


def test_clashing_columns_pass_and_texts_of_one_id_stay(spark, docs):
    rows = [(1, "one two three four five six", "a"), (1, "seven eight nine ten eleven twelve", "a"), (2, "one two three four five six", "a"), (None, None, None)]
    df = docs(rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "held_out").withColumnRenamed("n_chars", "predicted")
    out = corpus_pipeline.toxicity_stage(spark, df, SF)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    kept = corpus_pipeline.near_duplicates_stage(spark, df, SF)
    assert kept.columns == df.columns and sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, (r[1] for r in rows if r[0] != 2)))
    last = corpus_pipeline.bpe_stage(spark, docs([(1, None, "a"), (2, "", "b"), (3, "x" * 300_000, None), (3, "x" * 300_000, None)]), SF).collect()
    assert sorted((r.doc_id, r.n_tokens == 0) for r in last) == [(1, True), (2, True), (3, False), (3, False)] and all(r.round_trip for r in last)
    assert corpus_pipeline.bpe_stage(spark, docs([]), SF).count() == 0


def test_columns_of_the_stages_own_names_pass(spark, docs):
    names = ["size", "__k__", "__copies__", "__key__", "__n__", "__masked__", "__h__", "copies", "component"]
    df = docs([(i, f"one two three four five six seven {i} " * (i + 2), "ab"[i % 2]) for i in range(12)])
    df = df.select("*", *(corpus_pipeline.F.lit(70 + i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        rows = out.collect()
        assert rows and all([r[n] for n in names] == [*range(70, 70 + len(names))] for r in rows), name


def test_mix_takes_its_words_where_rows_repeat(spark, docs):
    rows = [(i // 4 % 5 or None, "w " * 10, "a") for i in range(400)] + [(1, f"w{i} " * 10, "b") for i in range(97)] + [(1, "v " * 10, "b")] * 50
    df = docs(rows)
    want = {r.source: r.s for r in mixing.mix(df).groupBy("source").agg(corpus_pipeline.F.sum("taken").alias("s")).collect()}
    got = corpus_pipeline.mixing_stage(spark, df, SF).groupBy("source").agg((10 * corpus_pipeline.F.count("*")).alias("s")).collect()
    assert {r.source: r.s for r in got} == want
