"""The pipeline on driver tables, against its stages applied by brute force."""

import corpus_pipeline
import __spark_entry__ as entry
from aerolytics.llm import pii, toxicity
from aerolytics.llm.common import documents
from tests.conftest import SF
from tests.llm.cases import empty, messy, messy_rows
from tests.llm.test_dedup import brute_components, brute_fingerprint


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_keeps_what_brute_force_keeps(spark):
    docs = documents(spark, SF)
    toxic = {r["doc_id"] for r in toxicity.toxicity_report(docs, documents(spark, SF, "labels")).where("toxic").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    last = {t: i for i, t in sorted(rows.items())}
    unique = sorted(last.values())
    near = brute_components([(i, brute_fingerprint(rows[i])) for i in unique])
    want = {i for i, _, c in near if i == c}
    seen, out = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns
        out[name] = {r["doc_id"]: r for r in seen.collect()}
    assert set(out["toxicity"]) == set(rows) and set(out["exact_dedup"]) == set(unique)
    assert set(out["near_dedup"]) == set(out["pii"]) == want
    for i, r in out["pii"].items():
        assert r["text"] == pii.redact_text(rows[i], pii.find_spans(rows[i]))
        assert r["n_chars"] == len(r["text"])
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == want


def test_stages_survive_messy_and_empty_documents(spark):
    for frame, n in ((messy(spark), len(messy_rows())), (empty(spark), 0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, frame, SF).collect()
            assert (len(rows) > 0) == (n > 0), name


def test_queries_with_sql_match_duckdb(spark):
    import duckdb

    from scripts.check_oracle import rows
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    from aerolytics.llm.oracle import ORACLE
    for name, sql in ORACLE.items():
        assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.execute(sql).fetchdf()), name
