"""The pipeline's stages on a small table, and its SQL-expressible queries."""

import corpus_pipeline
import pytest

from lattica.llm import registry

from ..test_queries import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "token files":
            assert out.columns == docs.columns
            assert 0 < out.count() <= n
            docs = out.cache()
            n = docs.count()
        else:
            assert out.count() == n
    ends = out.orderBy("start").collect()
    assert ends[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ends, ends[1:], strict=False))


def odd_tables(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _toxicity int, component_id string"
    docs = spark.createDataFrame([(i, t, "en" if i else None, f"s{(i or 0) % 2}", len(t or ""), 1, "c") for i, t in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, tmp_path, monkeypatch):
    clean = [f"the river {k} runs by the {k * 7} old mill and the house of {k * 13} near the wood where {k * 17} birds sing all day" for k in range(60)]
    bad = "you idiot you are stupid trash and scum you worthless idiot "
    rows = [(k, bad * 2 + f"w{k} v{k} u{k} t{k} r{k}" if k % 3 == 0 else clean[k]) for k in range(60)]
    twin = clean[1] + " again"
    rows += [(100, clean[1]), (101, twin), (102, None), (103, ""), (None, clean[2]), (None, None), (104, "they said one two three four five six seven eight nine ten"), (5, clean[5]), (105, "word " * 30_000)]
    folder = odd_tables(spark, tmp_path, rows)
    monkeypatch.setattr(corpus_pipeline.mixing, "KEEP", 1.0)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "mixing":
            stage = lambda s, d, f: corpus_pipeline.mixing.sample(d, keep=1.0, temper=1.0)
        kept = corpus_pipeline.common.materialize(stage(spark, docs, folder), "stage")
        assert kept.columns == docs.columns
        seen.append([r["doc_id"] for r in kept.collect()])
        docs = kept
    toxic, near, leaked, mixed = seen
    assert not {k for k in range(60) if k % 3 == 0} & set(toxic) and {k for k in range(60) if k % 3} <= set(toxic)
    # Of exact and near copies the smallest id stays; repeated ids, null ids, null and empty texts stay.
    assert not {100, 101} & set(near) and near.count(5) == 2 and near.count(None) == 2 and {1, 102, 103, 105} <= set(near)
    assert set(near) - set(leaked) == {104}
    assert sorted(map(str, mixed)) == sorted(map(str, leaked))
    tokens = corpus_pipeline.write_tokens(spark, docs, folder).collect()
    assert sorted(str(r["doc_id"]) for r in tokens) == sorted(map(str, mixed)) and min(r["n_tokens"] for r in tokens) == 1
    starts = sorted((r["start"], r["n_tokens"]) for r in tokens)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_pipeline_of_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path, [])).count() == 0
