"""Entity tables, stored files and JSON at the edges."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemark.sources import files as fl
from sourcemark.sources import tables as tb


@pytest.mark.parametrize("name", sorted(tb.TABLES))
def test_entity_tables_are_read_with_their_own_schema(spark, tmp_path, name):
    schema = T.StructType.fromDDL(tb.TABLES[name])
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    assert tb.read_table(spark, str(tmp_path), name).schema == schema


def test_only_asked_columns_and_rows_are_read(spark, tmp_path):
    rows = [("j1", "o1", "t", "d", "draft"), ("j2", "o2", "t", "d", "published")]
    jobs = spark.createDataFrame(rows, "id string, owner_id string, title string, description string, status string")
    jobs.write.parquet(f"{tmp_path}/jobs")
    found = tb.read_table(spark, str(tmp_path), "jobs").where("status = 'published'").select("id", "published_at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,published)" in plan and "description" not in plan
    assert [tuple(r) for r in found.collect()] == [("j2", None)]


def test_rows_of_a_database_become_entities(spark):
    spans = [{"page_number": 1, "char_start": 0, "char_end": 9}]
    fields = [f.name for f in T.StructType.fromDDL(tb.TABLES["resumes"])]
    values = {"id": "r1", "attempts": "3", "pages_without_text": "[2]", "page_spans": json.dumps(spans), "page_geometry": "not json"}
    raw = spark.createDataFrame([tuple(values.get(f) for f in fields)], ", ".join(f"{f} string" for f in fields))
    (row,) = tb.as_entity(raw, "resumes").collect()
    assert (row.id, row.attempts, row.pages_without_text, row.page_geometry) == ("r1", 3, [2], None)
    assert row.page_spans[0].asDict() == spans[0]


def test_files_by_key(spark, tmp_path):
    for key in ("a/one.txt", "a/two.txt", "b/one.txt"):
        path = tmp_path / "store" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(key.encode())
    keys = spark.createDataFrame([("a/two.txt",), ("b/one.txt",), ("b/none.txt",), ("a/two.txt",)], "storage_key string")
    found = fl.read_files_by_key(fl.read_files(spark, f"{tmp_path}/store", "*.txt"), keys)
    assert sorted(bytes(r.content) for r in found.collect()) == [b"a/two.txt", b"b/one.txt"]


def test_documents_go_out_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a1", 1, "x"), ("a2", 2, None)], "account string, n int, quote string")
    fl.write_document(rows, f"{tmp_path}/out", ["account"])
    back = fl.read_claims(spark, f"{tmp_path}/out", "n int, quote string, account string")
    assert sorted(map(tuple, back.collect())) == [(1, "x", "a1"), (2, None, "a2")]
    (tmp_path / "bad.json").write_text('{"n": "many"}\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        fl.read_claims(spark, f"{tmp_path}/bad.json", "n int").collect()


def test_unknown_fields_are_named(spark):
    df = spark.createDataFrame([('{"value": 1, "extra": 2}',)], "j string")
    assert df.select(fl.unknown_fields(F.col("j"), ["value", "quote"])).first()[0] == ["extra"]


def test_files_are_opened_by_key_and_never_listed(spark, tmp_path, monkeypatch):
    from pyarrow import fs as arrow_fs

    from sourcemark.sources import keyed

    store = tmp_path / "store"
    for n in range(100):
        (store / f"{n:02d}").mkdir(parents=True)
        for k in range(100):
            (store / f"{n:02d}" / f"{k:02d}").write_bytes(b"%d" % (100 * n + k))
    asked = [f"{n:02d}/{n:02d}" for n in range(10)]
    keys = spark.createDataFrame([(k,) for k in [*asked, asked[0], "00/none", None]], "storage_key string")
    found = keyed.read_by_key(spark, f"file://{store}", keys, per_task=3)
    rows = {r.storage_key: (r.length, r.content) for r in found.collect()}
    assert rows == {**{k: (len(b), bytes(b)) for k in asked for b in [b"%d" % (int(k[:2]) * 101)]}, "00/none": (None, None)}
    # The same reader in this process, with its file system watched.
    folder = tmp_path / "keys"
    spark.createDataFrame([(k,) for k in asked], "storage_key string").coalesce(1).write.parquet(str(folder))
    opened, listed = [], []

    def watched(uri, real=keyed.located):
        system, path = real(uri)

        class Watch:
            def open_input_stream(self, name, **options):
                opened.append(name)
                return system.open_input_stream(name, **options)

            def open_input_file(self, name):
                return system.open_input_file(name)

            def get_file_info(self, selector):
                listed.append(selector.base_dir)
                return system.get_file_info(selector)

        return Watch(), path

    monkeypatch.setattr(keyed, "located", watched)
    reader = keyed.KeyedReader({"root": str(store), "keys": str(folder), "keys_per_task": "4"})
    parts = reader.partitions()
    assert [p.count for p in parts] == [4, 4, 2]
    assert sum(batch.num_rows for p in parts for batch in reader.read(p)) == 10
    assert opened == [str(store / k) for k in asked]
    assert listed == [str(folder)]
    assert isinstance(arrow_fs.LocalFileSystem(), arrow_fs.FileSystem)


def test_keys_that_lead_out_of_the_store_are_refused(spark, tmp_path):
    import pytest

    from sourcemark.sources import keyed

    for key in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(Exception, match="not a storage key"):
            keyed.read_by_key(spark, str(tmp_path), spark.createDataFrame([(key,)], "storage_key string"))
