import brute
import corpus_pipeline
from compare import SF
from gaugeframe.llm import toxicity
from gaugeframe.llm.common import read


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what the stage before has kept."""
    docs = read(spark, SF, "documents")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        out = stage(spark, docs, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = rows(out)
        texts = {i: r["text"] for i, r in before.items()}
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.classify(docs, read(spark, SF, "labels"), spark).collect() if r["predicted"]}
            assert after == {i: r for i, r in before.items() if i not in bad}
        elif name == "line_dedup":
            want = brute.line_dedup(texts)
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, (t, gone) in want.items() if t != "" or not gone}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "jaccard_join":
            assert set(after) == {i for i, (_, c) in brute.jaccard(texts).items() if c == i}
        elif name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
            bad = {d for d, _, _ in brute.find(texts.items(), bench)}
            assert bad and set(after) == set(before) - bad
            items = [r["text"] for r in read(spark, SF, "benchmark").collect()]
            assert not any(x in r["text"] for x in items for r in after.values())
        else:
            assert {i: r["text"] for i, r in after.items()} == texts and len({r["mix_position"] for r in after.values()}) == len(after)
        kept.append(len(after))
        docs = out
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4] > 0
    assert sorted(r["mix_position"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["mix_position"] for r in docs.collect())


def test_toxic_documents_go(spark):
    """On a table with enough labels to learn from."""
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    bad = {r["doc_id"] for r in toxicity.classify(docs, read(spark, sf, "labels"), spark).collect() if r["predicted"]}
    before, after = rows(docs), rows(corpus_pipeline.drop_toxic(spark, docs, sf))
    assert bad and after == {i: r for i, r in before.items() if i not in bad}


def test_empty_corpus(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_leave_other_columns_alone(spark):
    """Columns of names that the stages use themselves, with dots, and differing in case only: they pass, values unchanged."""
    from pyspark.sql import functions as F

    docs = read(spark, SF, "documents")
    extra = ["removed", "N_LINES", "a.b", "Token", "t1", "row", "KEY"]
    wide = docs.select("*", *[F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(extra)])
    for name, stage in corpus_pipeline.STAGES:
        plain, out = stage(spark, docs, SF), stage(spark, wide, SF)
        assert out.columns == [*docs.columns, *extra, *plain.columns[len(docs.columns) :]], name
        plain, got = rows(plain), [tuple(r) for r in out.collect()]
        n = len(docs.columns)
        assert sorted(r[0] for r in got) == sorted(plain)
        assert all(r[n : n + len(extra)] == tuple(f"{i}-{r[0]}" for i in range(len(extra))) for r in got), name
        if name != "mixing":  # the place in the mix follows a digest of all columns
            assert all(r[:n] == tuple(plain[r[0]].values())[:n] for r in got), name
