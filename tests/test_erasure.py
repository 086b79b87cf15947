"""Erasing from stored tables: files first, all or nothing, and finishing what was cut off."""

import pytest

from sourcemark.sources import erasure as er
from sourcemark.sources import keyed

SCHEMAS = {
    "accounts": "account_id long, name string",
    "resumes": "resume_id long, owner_id long, storage_key string",
    "jobs": "job_id long, owner_id long",
    "screenings": "screening_id long, job_id long, resume_id long",
    "applications": "application_id long, job_id long, candidate_id long, resume_id long",
    "events": "application_id long, position int, actor_id long, screening_id long",
}


def rows():
    return {
        "accounts": [(i, f"a{i}") for i in range(20)],
        "resumes": [(100 + i, i, f"{i}/cv") for i in range(20)],
        "jobs": [(200 + i, i) for i in range(0, 20, 2)],
        "screenings": [(300 + i, 200 + i % 10 * 2, 100 + i) for i in range(20)],
        "applications": [(400 + i, 200 + (i + 1) % 10 * 2, i, 100 + i) for i in range(20)],
        "events": [(400 + i, p, (i + p) % 20 if p else None, 300 + (i + p) % 20 if p == 2 else None) for i in range(20) for p in range(3)],
    }


@pytest.fixture
def stored(spark, tmp_path):
    root, files = tmp_path / "tables", tmp_path / "files"
    er.store_tables({n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows().items()}, str(root), 4)
    for i in range(20):
        (files / str(i)).mkdir(parents=True)
        (files / str(i) / "cv").write_text(f"cv {i}")
    return root, files


def contents(spark, root):
    tables = er.read_tables(spark, str(root), SCHEMAS)
    return {n: sorted((tuple(r) for r in t.drop("part").collect()), key=str) for n, t in tables.items()}


def erase(spark, root, files, ids):
    asked = spark.createDataFrame([(i,) for i in ids], "account_id long")
    return er.erase_stored(er.read_tables(spark, str(root), SCHEMAS), asked, str(root), str(files))


def expected(ids):
    t = rows()
    cvs = {100 + i for i in ids}
    jobs = {j for j, o in t["jobs"] if o in ids}
    screenings = {s for s, j, r in t["screenings"] if j in jobs or r in cvs}
    gone = {a for a, j, c, r in t["applications"] if j in jobs or c in ids or r in cvs}
    return {
        "accounts": [r for r in t["accounts"] if r[0] not in ids],
        "resumes": [r for r in t["resumes"] if r[1] not in ids],
        "jobs": [r for r in t["jobs"] if r[1] not in ids],
        "screenings": [r for r in t["screenings"] if r[0] not in screenings],
        "applications": [r for r in t["applications"] if r[0] not in gone],
        "events": [(a, p, None if w in ids else w, None if s in screenings else s) for a, p, w, s in t["events"] if a not in gone],
    }


def test_rows_and_files_go_together(spark, stored):
    root, files = stored
    touched = erase(spark, root, files, {3, 4})
    assert contents(spark, root) == {n: sorted(r, key=str) for n, r in expected({3, 4}).items()}
    assert sorted(int(p.parent.name) for p in files.glob("*/cv")) == [i for i in range(20) if i not in (3, 4)]
    # An account lies in one part of its table: the others are not written again.
    assert len(touched["accounts"]) <= 2


def test_everything_may_go(spark, stored):
    root, files = stored
    erase(spark, root, files, set(range(20)))
    assert contents(spark, root) == {n: [] for n in SCHEMAS}
    assert not list(files.glob("*/cv"))


def test_a_file_that_stays_keeps_all_tables(spark, stored):
    root, files = stored
    before = contents(spark, root)
    (files / "4" / "cv").unlink()
    (files / "4" / "cv").mkdir()
    with pytest.raises(er.FilesKept):
        erase(spark, root, files, {3, 4})
    assert contents(spark, root) == before
    # With the obstacle gone the same request goes through, though one file went the first time.
    (files / "4" / "cv").rmdir()
    erase(spark, root, files, {3, 4})
    assert contents(spark, root) == {n: sorted(r, key=str) for n, r in expected({3, 4}).items()}


def test_a_failure_while_staging_keeps_tables_and_files(spark, stored, monkeypatch):
    root, files = stored
    before = contents(spark, root)
    real = er._touched

    def fails(tables, survivors, name):
        if name == "applications":
            raise OSError("disk full")
        return real(tables, survivors, name)

    monkeypatch.setattr(er, "_touched", fails)
    with pytest.raises(OSError):
        erase(spark, root, files, {3})
    assert contents(spark, root) == before
    assert len(list(files.glob("*/cv"))) == 20


def test_a_publication_that_was_cut_off_is_finished(spark, stored):
    root, files = stored
    tables = er.read_tables(spark, str(root), SCHEMAS)
    survivors = er.erase_accounts(tables, spark.createDataFrame([(3,), (4,)], "account_id long"))
    survivors.pop("storage_keys")
    folder, touched = er.stage(tables, survivors, str(root))
    first = dict(list(touched.items())[:2])
    er.publish(tables, str(root), folder, first)
    er.publish(tables, str(root), folder, touched)
    assert contents(spark, root) == {n: sorted(r, key=str) for n, r in expected({3, 4}).items()}


def test_writing_is_not_tied_to_the_number_of_parts(spark, tmp_path):
    rows = spark.range(0, 8_000, numPartitions=8).withColumnRenamed("id", "account_id")
    er.store_tables({"accounts": rows}, str(tmp_path), 2)
    # Every task writes its share of both parts, instead of one task a part.
    assert len(list((tmp_path / "accounts").glob("part=*/*.parquet"))) == 16
    stored = er.read_tables(spark, str(tmp_path), {"accounts": "account_id long"})["accounts"]
    assert stored.count() == stored.select("account_id").distinct().count() == 8_000


def test_a_table_is_read_once_per_erasure(spark, stored):
    tables = er.read_tables(spark, str(stored[0]), SCHEMAS)
    survivors = er.erase_accounts(tables, spark.createDataFrame([(3,)], "account_id long"))
    for name in ("applications", "events"):
        plan = survivors[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1, plan


def test_missing_files_are_told_without_opening_any(spark, stored):
    asked = spark.createDataFrame([("3/cv",), ("3/none",)], "storage_key string")
    found = {r.storage_key: (r.length, r.content) for r in keyed.read_by_key(spark, str(stored[1]), asked, opened=False).collect()}
    assert found == {"3/cv": (4, None), "3/none": (None, None)}
