import pytest
from pyspark.sql import functions as F

from sourcelode.operators.changes import changed_files
from sourcelode.schema import INDEX
from sourcelode.session import list_folders
from sourcelode.sources.index_table import IndexTable


def rows(spark, *keys, purpose="p"):
    made = [("p", f, f"m{f}", "file", "Python", f, purpose, purpose, [0.5, 1.0], 0, n, 1, True) for n, f in enumerate(keys)]
    return spark.createDataFrame(made, INDEX)


def keys(spark, *files):
    return spark.createDataFrame([("p", f) for f in files], "project string, file string")


def state(index):
    return sorted((r["file"], r["purpose"]) for r in index.rows().collect())


@pytest.fixture
def index(spark, tmp_path):
    return IndexTable.open(spark, str(tmp_path / "index"), 2)


def test_deltas_tombstones_and_compaction(spark, index):
    index.append(rows(spark, "a", "b", "c"))
    index.replace(rows(spark, "b", purpose="new"), keys(spark, "b", "c"))
    assert state(index) == [("a", "p"), ("b", "new")]
    index.append(rows(spark, "c", purpose="again"))
    assert state(index) == [("a", "p"), ("b", "new"), ("c", "again")]
    index.replace(rows(spark, "b", purpose="last"), keys(spark, "b"))
    index.replace(rows(spark), keys(spark, "a"))
    before = state(index)
    assert before == [("b", "last"), ("c", "again")] and len(index.live()) == 6
    old = index.rows()
    index.compact()
    assert state(index) == before and len(index.live()) == 1
    assert sorted(r["file"] for r in old.collect()) == ["b", "c"]
    assert index.vacuum() == 6 and state(index) == before and len(index.log()) == 1
    index.append(rows(spark, "z"))
    assert [f for f, _ in state(index)] == ["b", "c", "z"]


def test_a_replacement_writes_only_what_changed(spark, index):
    index.append(rows(spark, *[f"f{n:03d}" for n in range(500)]))
    index.replace(rows(spark, "f007", purpose="new"), keys(spark, "f007"))
    last = index.live()[-1]
    place = f"{index.path}/data/{last.folder}"
    assert spark.read.parquet(f"{place}/rows").count() == 1 and spark.read.parquet(f"{place}/gone").count() == 1
    assert dict(state(index))["f007"] == "new" and len(state(index)) == 500


def test_a_writer_that_dies_leaves_the_old_state(spark, index, monkeypatch):
    index.append(rows(spark, "a", "b"))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched, pytest.raises(KeyboardInterrupt):
        patched.setattr(IndexTable, "_commit", die)
        index.replace(rows(spark, "a", purpose="lost"), keys(spark, "a", "b"))
    assert state(index) == [("a", "p"), ("b", "p")]
    # Dead as well in the middle of the commit: a version without a row.
    spark.createDataFrame([], "x int").write.parquet(f"{index.path}/log/version={3:012d}")
    index.replace(rows(spark, "a", purpose="new"), keys(spark, "a"))
    assert state(index) == [("a", "new"), ("b", "p")]
    assert index.vacuum() == 1 and state(index) == [("a", "new"), ("b", "p")]
    assert len(list_folders(spark, f"{index.path}/data")) == 3


def test_the_second_of_two_writers_fails(spark, index):
    other = IndexTable.open(spark, index.path, 2)
    after = index.log()[-1].version
    other.append(rows(spark, "a"))
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit(after, "delta", "nowhere", 0, "", 1)
    assert state(index) == [("a", "p")]


def test_an_overwrite_may_read_the_index(spark, index):
    index.append(rows(spark, "a", "b"))
    index.overwrite(index.rows().where("file = 'b'"))
    assert state(index) == [("b", "p")]


def test_a_vector_of_another_width_fails_the_write(spark, index):
    wrong = rows(spark, "a").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="not 2 numbers"):
        index.append(wrong)
    assert state(index) == []


def test_an_index_of_another_width_is_not_opened(spark, index):
    with pytest.raises(ValueError, match="vectors of 2"):
        IndexTable.open(spark, index.path, 3)


@pytest.mark.parametrize("buckets", [None, 4])
def test_change_detection_shuffles_no_index(spark, tmp_path, buckets):
    index = IndexTable.open(spark, str(tmp_path / "index"), 2, buckets)
    index.append(rows(spark, "a", "b", "d", "e"))
    index.replace(rows(spark, "b", purpose="n").withColumn("md5", F.lit("new")), keys(spark, "b", "d"))
    listed = [("p", "a", "ma"), ("p", "b", "mb"), ("p", "c", "mc"), ("p", "d", "md"), ("p", "e", None)]
    listing = spark.createDataFrame(listed, "project string, file string, md5 string")

    def found(df):
        return sorted(r["file"] for r in df.collect())

    again = IndexTable.open(spark, index.path, 2)
    assert found(again.changed(listing)) == ["b", "c", "d", "e"]
    assert found(again.changed(spark.createDataFrame([("p", "b", "new")], listing.schema))) == []
    assert found(changed_files(listing, again.rows())) == ["b", "c", "d", "e"]
    again.compact()
    assert found(index.changed(listing)) == ["b", "c", "d", "e"]
    again.vacuum()
    assert found(index.changed(listing)) == ["b", "c", "d", "e"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.changed(listing)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "embedding" not in plan and "content" not in plan
    if buckets:
        held = plan[plan.index("index_keys_") - 2000 :] if "index_keys_" in plan else plan
        assert "Bucketed: true" in held and plan.count("Exchange") == 1, plan
