"""Merging rules, one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roleledger.operators import keys, merge
from roleledger.operators.summary import RunCounts
from roleledger.plans.recover import recover
from roleledger.plans.refresh import Rules, empty_block_list, empty_duplicates, refresh_master
from roleledger.schema import POSTING
from pyspark.sql import types as T
from workload import merging

DAY = dt.date(2024, 1, 31)
COLLECTED = T.StructType([*POSTING.fields, T.StructField("ordinal", T.LongType())])


def posting(key, post="2024-01-10", **other):
    row = {
        "key_id": key, "status": "NEW", "title": f"title {key}", "company": "c", "location": "l",
        "post_date": dt.date.fromisoformat(post) if post else None, "scrape_date": DAY,
        "description": f"wording{key}", "short_description": "", "tags": ["t"], "url": f"u/{key}",
        "provider": "INDEED", "query": "q", "locale": "USA_ENGLISH", "wage": "", "remoteness": "UNKNOWN",
    }
    return row | other


def table(spark, rows, schema=POSTING):
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def incoming(spark, rows):
    return table(spark, [r | {"ordinal": i} for i, r in enumerate(rows)], COLLECTED)


def matches(spark, rows):
    return spark.createDataFrame(
        rows, "original_key_id string, duplicate_key_id string, dup_type string, similarity double"
    )


def test_several_updates_end_with_the_latest_and_last(spark):
    master = table(spark, [posting("m", status="APPLIED"), posting("n", "2024-01-20")])
    new = incoming(
        spark,
        [
            posting("a", "2024-01-12", wage="first", title="other"),
            posting("b", "2024-01-15", wage="tie, earlier"),
            posting("c", "2024-01-15", wage="tie, later"),
            posting("d", "2024-01-05", wage="older"),
            posting("e", "2024-01-19", wage="older than n"),
        ],
    )
    found = matches(
        spark,
        [("m", k, "NEW_TFIDF", 0.9) for k in "abcd"] + [("n", "e", "NEW_TFIDF", 0.8)],
    )
    rows = {r["key_id"]: r for r in merge.update_if_newer(master, found, new).collect()}
    assert rows["m"]["wage"] == "tie, later"
    assert rows["m"]["status"] == "APPLIED" and rows["m"]["title"] == "title m"
    assert rows["m"]["url"] == "u/c" and rows["m"]["post_date"] == dt.date(2024, 1, 15)
    assert rows["n"]["wage"] == "" and rows["n"]["post_date"] == dt.date(2024, 1, 20)


def test_an_update_of_the_same_date_counts(spark):
    master = table(spark, [posting("m")])
    new = incoming(spark, [posting("m", wage="same day")])
    found = matches(spark, [("m", "m", "KEY_ID", None)])
    assert merge.update_if_newer(master, found, new).first()["wage"] == "same day"


def test_status_and_key_may_follow_the_update(spark):
    master = table(spark, [posting("m", status="APPLIED")])
    new = incoming(spark, [posting("a", "2024-01-12")])
    found = matches(spark, [("m", "a", "NEW_TFIDF", 0.9)])
    row = merge.update_if_newer(master, found, new, preserve=("title",), rekey=True).first()
    assert (row["key_id"], row["status"], row["title"]) == ("a", "NEW", "title m")


def test_first_and_last_row_of_a_busy_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key_id"), "id"
    )
    assert keys.first_wins(rows, ["id"]).where("key_id = 'hot'").first()["id"] == 0
    assert keys.last_wins(rows, ["id"]).where("key_id = 'hot'").first()["id"] == 2997
    assert keys.last_wins(rows, ["id"]).count() == 2001


def test_rows_without_a_key_are_set_aside(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "key_id string, id int")
    assert [r["id"] for r in keys.last_wins(rows, ["id"]).collect()] == [3]
    assert sorted((r["id"], r["invalid_reason"]) for r in keys.without_key(rows).collect()) == [(1, "key unset"), (2, "key unset")]


def test_one_row_per_key_leaves_a_map_task(spark):
    plan = keys.first_wins(spark.range(10).select(F.col("id").alias("key_id"), "id"), ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in text


def run(spark, master, new, rules=None, block_list=None, duplicates=None):
    any_rows = incoming(spark, new)
    return refresh_master(
        None if master is None else table(spark, master),
        any_rows,
        empty_block_list(any_rows) if block_list is None else block_list,
        empty_duplicates(any_rows) if duplicates is None else duplicates,
        rules or Rules(as_of=DAY),
    )


def keys_of(df):
    return sorted(r["key_id"] for r in df.select("key_id").collect())


def test_without_a_master_all_that_passes_is_taken(spark):
    done = run(spark, None, [posting("a"), posting("b", "2023-01-01"), posting("c", None)])
    assert keys_of(done.master) == ["a", "c"]
    assert done.master.where("key_id = 'c'").first()["post_date"] == DAY
    assert done.matches.count() == 0


def test_a_removal_is_remembered(spark):
    master = [posting("a", status="DELETE"), posting("b")]
    done = run(spark, master, [posting("a"), posting("c")])
    assert keys_of(done.master) == ["b", "c"]
    assert keys_of(done.block_list) == ["a"]


def test_a_row_that_aged_out_may_come_back(spark):
    done = run(spark, [posting("a", "2023-11-01"), posting("b")], [posting("a", "2024-01-30")])
    assert keys_of(done.master) == ["a", "b"]
    assert done.matches.count() == 0


def test_known_repetitions_stay_out_and_may_update(spark):
    duplicates = spark.createDataFrame(
        [("x", "NEW_TFIDF", "b"), ("y", "KEY_ID", "y")], "key_id string, dup_type string, original_key_id string"
    )
    for name in ("title", "company", "post_date", "description", "status"):
        duplicates = duplicates.withColumn(name, F.lit(""))
    duplicates = duplicates.select("key_id", "title", "company", "post_date", "description", "status", "dup_type", "original_key_id")
    new = [posting("x", "2024-01-12", wage="news"), posting("y")]
    done = run(spark, [posting("b")], new, duplicates=duplicates)
    assert keys_of(done.master) == ["b", "y"]
    assert done.master.where("key_id = 'b'").first()["wage"] == "news"
    all_types = run(spark, [posting("b")], new, Rules(as_of=DAY, all_types=True), duplicates=duplicates)
    assert keys_of(all_types.master) == ["b"]


def test_similar_texts_are_found_in_a_small_corpus(spark):
    text = "senior spark engineer building large pipelines near the river"
    master = [posting(f"m{i}", description=f"{text} number{i % 2}") for i in range(3)]
    new = [posting("n", "2024-01-12", description=f"{text} number0")]
    done = run(spark, master, new)
    assert [(r["original_key_id"], r["duplicate_key_id"]) for r in done.matches.collect()] == [("m0", "n")]
    assert done.duplicates.first()["original_key_id"] == "m0"


def test_a_second_run_with_the_same_rows_leaves_the_master_alone(spark):
    master = [posting(f"m{i}") for i in range(5)]
    new = [posting(f"m{i}", "2024-01-15") for i in range(3)] + [posting("z")]
    once = run(spark, master, new)
    twice = refresh_master(once.master, incoming(spark, new), once.block_list, once.duplicates, Rules(as_of=DAY))
    assert sorted(map(tuple, twice.master.drop("tags").collect())) == sorted(map(tuple, once.master.drop("tags").collect()))
    # What was new the first time is a key match by now.
    assert keys_of(twice.duplicates) == [*keys_of(once.duplicates), "z"]


def test_recovery_takes_the_newest_snapshot_and_keeps_key_matches(spark):
    rows = table(spark, [posting("a"), posting("b"), posting("c")])
    old = rows.withColumns({"snapshot_date": F.lit(dt.date(2024, 1, 29)), "version": F.lit("1")})
    new = rows.where("key_id <> 'c'").withColumns(
        {"wage": F.lit("new"), "snapshot_date": F.lit(dt.date(2024, 1, 30)), "version": F.lit("1")}
    )
    duplicates = empty_duplicates(rows).unionByName(
        merge.block_entry(rows.where("key_id <> 'c'")).withColumns(
            {
                "dup_type": F.when(F.col("key_id") == "a", "KEY_ID").otherwise("NEW_TFIDF"),
                "original_key_id": F.lit(None).cast("string"),
            }
        )
    )
    got = recover(old.unionByName(new), empty_block_list(rows), duplicates, Rules(as_of=DAY))
    assert {r["key_id"]: r["wage"] for r in got.collect()} == {"a": "new", "c": ""}


@pytest.mark.parametrize("inclusive, kept", [(False, ["edge", "young"]), (True, ["young"])])
def test_a_row_of_exactly_the_age_limit(spark, inclusive, kept):
    new = [posting("young"), posting("edge", "2023-12-02"), posting("old", "2023-12-01")]
    assert keys_of(run(spark, None, new, Rules(as_of=DAY, inclusive=inclusive)).master) == kept


def test_block_entry_keeps_whole_texts(spark):
    rows = table(spark, [posting("a", description="x" * 150), posting("b", description="x" * 1510)])
    kept = {r["key_id"]: r["description"] for r in merge.block_entry(rows).collect()}
    assert kept == {"a": "x" * 150, "b": "x" * 1510}


def test_a_run_leaves_a_snapshot_to_recover_from(spark, tmp_path):
    rows = incoming(spark, [posting("a"), posting("b", status="DELETE"), posting("c", "2023-01-01")])
    root = str(tmp_path / "snapshots")
    refresh_master(None, rows, empty_block_list(rows), empty_duplicates(rows), Rules(as_of=DAY), root, "2")
    kept = spark.read.parquet(root)
    assert keys_of(kept) == ["a", "b", "c"] and {r["version"] for r in kept.collect()} == {"2"}
    got = recover(kept, empty_block_list(rows), empty_duplicates(rows), Rules(as_of=DAY))
    assert keys_of(got) == ["a"]


@pytest.mark.parametrize("rekey", [False, True])
def test_changes_make_the_new_master_of_the_old_one(spark, rekey):
    text = "senior spark engineer building large pipelines near the river"
    master = [posting("a"), posting("old", "2023-01-01"), posting("gone", status="ARCHIVE"), posting("t", description=text), posting("still")]
    new = [posting("a", "2024-01-20", wage="news"), posting("x", "2024-01-12", description=text + " now"), posting("fresh"), posting("old", "2024-01-20")]
    done = run(spark, master, new, Rules(as_of=DAY, rekey=rekey))
    changes = done.changes["master"].collect()
    assert len({r["key_id"] for r in changes}) == len(changes)
    table_now = {r["key_id"]: tuple(r) for r in table(spark, master).collect()}
    for r in changes:
        if r["_gone"]:
            del table_now[r["key_id"]]
        else:
            table_now[r["key_id"]] = tuple(r)[:-1]
    assert table_now == {r["key_id"]: tuple(r) for r in done.master.collect()}
    assert "still" not in {r["key_id"] for r in changes}
    assert ("t" in table_now) == (not rekey) and ("x" in table_now) == rekey


def test_wide_rows_move_for_winners_only(spark):
    """Neither the choice of an update nor that of a snapshot row aggregates descriptions."""
    master, new = table(spark, [posting("a")]), incoming(spark, [posting("a", "2024-01-20")])
    matches = spark.createDataFrame([("a", "a", "KEY_ID", None)], "original_key_id string, duplicate_key_id string, dup_type string, similarity double")
    days = master.withColumns({"snapshot_date": F.lit(DAY), "version": F.lit("1")})
    recovered = recover(days, empty_block_list(master), empty_duplicates(master), Rules(as_of=DAY))
    for plan in (merge.update_if_newer(master, matches, new), recovered):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        first = [line for line in text.splitlines() if "max(" in line]
        assert first and all("description" not in line for line in first if "max(struct(" in line)


def counted(spark, tmp_path, master, new):
    counts, any_rows = RunCounts(), incoming(spark, new)
    old = None if master is None else table(spark, master)
    nothing = empty_block_list(any_rows), empty_duplicates(any_rows)
    done = refresh_master(old, any_rows, *nothing, Rules(as_of=DAY), counts=counts)
    counts.all_rows(done.master, "written").write.parquet(str(tmp_path / "master"))
    return done, {(r["stage"], r["provider"], r["reason"]): r["n_rows"] for r in counts.summary(spark).collect()}


def test_a_run_counts_the_rows_it_writes(spark, tmp_path):
    master = [posting("a"), posting("b", status="DELETE"), posting("c")]
    new = [
        posting("a", provider="INDEED"), posting("d", provider="INDEED"), posting("d", provider="MONSTER"),
        posting("b", provider="MONSTER"), posting("e", "2023-01-01", provider="OTHER"), posting("f", provider=None),
        posting(None, provider="INDEED"),
    ]
    done, found = counted(spark, tmp_path, master, new)
    # One row a key; "b" is on the block list since its removal, "e" is too old.
    assert found == {
        ("collected", "INDEED", ""): 2, ("collected", "MONSTER", ""): 1, ("collected", "OTHER", ""): 1, ("collected", "", ""): 1,
        ("rejected", "", "block list"): 1, ("rejected", "", "age"): 1,
        ("read", "", ""): 3, ("duplicate", "", "KEY_ID"): 1, ("written", "", ""): done.master.count(),
        **{("duplicate", "", t): n for t, n in by_type(done).items() if t != "KEY_ID"},
    }


def by_type(done):
    return {r["dup_type"]: r["count"] for r in done.matches.groupBy("dup_type").count().collect()}


@pytest.mark.parametrize("providers", [300, 6000])
def test_few_and_many_providers_are_counted(spark, tmp_path, providers):
    rows = spark.range(20_000).selectExpr(f"concat('p', id % {providers}) AS provider", "IF(id % 4 = 0, 'age', NULL) AS reject_reason")
    counts = RunCounts()
    counts.judged(rows).where("reject_reason is null").write.parquet(str(tmp_path / "kept"))
    found = {(r["stage"], r["provider"] or r["reason"]): r["n_rows"] for r in counts.summary(spark).collect()}
    expected = {("collected", f"p{i}"): len(range(i, 20_000, providers)) for i in range(providers)}
    assert found == expected | {("rejected", "age"): 5000}


@pytest.mark.parametrize("master, new", [([], []), ([posting("a")], []), ([], [posting("a", provider="INDEED")]), (None, [])])
def test_counts_of_empty_tables_are_left_out(spark, tmp_path, master, new):
    _, found = counted(spark, tmp_path, master, new)
    rows = len(master or []) + len(new)
    expected = {("read", "", ""): len(master or []), ("written", "", ""): rows, ("collected", "INDEED", ""): len(new)}
    assert found == {k: n for k, n in expected.items() if n}


def test_landing_grows_with_its_tasks(spark, tmp_path, monkeypatch):
    """No task of the landing gathers a fixed share of the rows."""
    monkeypatch.setattr(merging, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = spark.range(0, 400, 1, 20).select(F.col("id").cast("string").alias("key_id"))
    monkeypatch.setattr(merging, "view", lambda *_: rows.withColumn("post_date", F.lit(dt.date(2024, 1, 30))))
    assert merging.stream_drop_old(spark, "").count() == 400
    assert len(spark.read.parquet(f"{tmp_path}/landed").inputFiles()) == 20
