"""The registered queries: their schemas on odd tables, and SQL where there is some."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.llm import queries

#: Columns that the results must have, with their types.
COLUMNS = {
    "op1": "query_id bigint, rank int, vec_id bigint, score double",
    "op2": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4": "doc_id bigint, fingerprint string, component_id bigint",
    "op5": "doc_id bigint, expected_severity double, toxic boolean",
    "op6": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op10": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
}


@pytest.fixture(scope="module")
def tables(spark, edge_rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, value string, key string, chunk string, bucket long, sizes string")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(100, 150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float((i * k) % 7 - 3) for k in range(1, 9)]) for i in range(60)] + [(61, None), (80, [float("nan")] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    said = [None, "", "a ### b ####", "x:\n</turn></turn>\\", "\\\\n <</turn>", "\U0001f600é"]
    turns = [(i % 7, i // 7, ("user", "assistant", "to:ol\n:", None)[i % 4], said[i % 6]) for i in range(60)]
    turns += [(None, 1, "assistant", "x"), (3, None, "system", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS) and len(queries.QUERIES) == len(COLUMNS)
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, tables, edge_rows, name):
    df = queries.QUERIES[name](spark, tables)
    op = name.split("_")[0]
    types = dict(df.dtypes)
    for column in COLUMNS[op].split(", "):
        assert types.get(column.split(" ")[0]) == column.split(" ")[1], column
    rows = df.collect()
    if op in ("op1", "op8"):
        assert {r["query_id"] for r in rows} == {0, 20, 40}
    elif op == "op12":
        assert {r["vec_id"] for r in rows} == set(range(60)) and {r["n"] for r in rows} == {60}
    elif op == "op13":
        assert {r["conv_id"] for r in rows} == {-7, None, *range(7)}
    elif op == "op2":
        assert sum(r["start"] == 0 for r in rows) == len(edge_rows)
    else:
        assert len(rows) == len(edge_rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(spark, tables, name):
    for folder in (tables, "/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "conversations"):
            files = f"{folder}/{t}.parquet" + ("/*.parquet" if folder == tables else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
        got = queries.QUERIES[name](spark, folder)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
