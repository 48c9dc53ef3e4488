import os
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

from gradlens.llm.packing import Limits, default_vocabulary

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


def plain(rows):
    return sorted((tuple(round(float(v), 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


def test_queries_with_sql(spark):
    from gradlens.llm import registry

    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in registry.queries()}
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        cols = sorted(df.columns)
        assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(duck.execute(f"select {', '.join(cols)} from ({sql})").fetchall()), name


def test_chat_query_is_native(spark):
    from gradlens.llm import registry

    plan = registry.queries()["op3_perspective_rotation"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm.common import frame, hard_rows
    from tests.llm.test_dedup import brute_components, brute_removed
    from tests.llm.test_packing import check
    from tests.llm.test_quality import plain_verdict

    docs = frame(spark, hard_rows(7), False).selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "passages", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert out.schema.names == docs.schema.names
        before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality":
            assert Counter(map(tuple, out.select("doc_id", "text").collect())) == Counter(r for r in rows if plain_verdict(r[1])[0])
        if name == "near":
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(d for d, n, c in brute_components(rows, corpus_pipeline.NEAR_PERCENT) if d == c or d is None or not n)
        if name == "exact":
            texts = [r["text"] for r in out.collect()]
            assert len(texts) == len(set(texts)) == len({r["text"] for r in docs.collect()})
        if name == "passages":
            want = {d: n - gone for d, n, gone, _, _ in brute_removed([(r["doc_id"], r["text"]) for r in docs.collect()])}
            assert {r["doc_id"]: len(r["text"].encode()) for r in out.collect()} == {d: n for d, n in want.items() if n}
        docs = out
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), Tokenizer.from_file(default_vocabulary()), Limits())
    assert corpus_pipeline.run(spark, SF).count() > 0
