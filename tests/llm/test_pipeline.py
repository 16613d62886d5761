import duckdb
import test_decontaminate
import test_simhash
import test_tokens
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import mixing, toxicity
from chronoloom.plans.materialize import materialize


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_every_stage_against_brute_force(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources", "token shards"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, sf001), f"test-stage{i}")
        before = rows(docs, *columns)
        if name == "toxicity":
            scorer = toxicity.Scorer(toxicity.fit(docs, labels))
            texts = dict(rows(docs, "doc_id", "text"))
            kept = {d for d, s in zip(texts, scorer.score(list(texts.values()))) if s < 0.5}
        elif name == "simhash near-dedup":
            kept = {d for d, _, c in test_simhash.brute(rows(docs, "doc_id", "text")) if d == c}
        elif name == "benchmark decontamination":
            kept = {r[0] for r in test_decontaminate.brute(rows(docs, "doc_id", "text"), items) if not r[5]}
        elif name == "mixing sources":
            docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
            kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.oracle(corpus_pipeline.BUDGET_SHARE, corpus_pipeline.MAX_EPOCHS)}) WHERE copies > 0").fetchall()}
        else:
            assert test_tokens.got(out) == test_tokens.brute(rows(docs, "doc_id", "text"))
            continue
        assert out.columns == columns
        assert rows(out, *columns) == [r for r in before if r[0] in kept]
        assert 0 < len(kept) < len(before)
        docs = out


def test_run_and_odd_rows(spark, sf0001, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf0001}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", "src1", 0), (10**7, None, None, "src2", None), (10**7 + 1, "lone words here", None, None, 15), (10**7 + 1, "lone words here", None, None, 15)]
    docs.unionAll(spark.createDataFrame(odd, docs.schema)).withColumn("score", docs["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and len(out) > 0.3 * docs.count()
    assert sorted(r.start for r in out)[0] == 0 and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    empty = str(tmp_path / "empty")
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf0001}/{t}.parquet").write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_rows_of_null_and_repeated_ids_are_judged_each(spark, tmp_path):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    leak = word("leak", 12)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, word("a", 300)), (None, word("b", 300)), (5, word("c", 300)), (5, word("d", 300)), (6, word("e", 300))]
    dirty = [(None, leak), (5, word("f", 200) + " " + leak)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert rows(corpus_pipeline.drop_contaminated(spark, df(clean + dirty), str(tmp_path)), "doc_id", "text") == sorted(clean, key=repr)
    near = [(None, word("a", 300) + " end"), (9, word("e", 300))]
    assert rows(corpus_pipeline.drop_near_duplicates(spark, df(clean), ""), "doc_id", "text") == sorted(clean, key=repr)
    out = rows(corpus_pipeline.drop_near_duplicates(spark, df(clean + near), ""), "doc_id", "text")
    assert len(out) == len(clean) and (6, word("e", 300)) in out and (9, word("e", 300)) not in out


def test_odd_column_names_and_a_very_long_text(spark, sf0001, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf0001}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{sf0001}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("_row", F.lit("kept"))
    long = spark.range(1).select(F.lit(10**8).alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1_300_000)), lambda i: F.concat(F.lit("word"), i.cast("string")))).alias("text"))
    docs = docs.unionByName(long, allowMissingColumns=True)
    assert long.select(F.length("text")).first()[0] > 10**7
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == columns
    # The long text has no shorter sibling to give way to; mixing may end its source before it.
    out = materialize(corpus_pipeline.write_tokens(spark, docs, str(tmp_path)), "odd-tokens")
    assert out.count() == docs.count() > 100 and {r._row for r in docs.select("_row").distinct().collect()} <= {"kept", None}
