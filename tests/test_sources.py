"""Files in and out, run state, and the streaming forms."""

import datetime as dt
import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roleledger.plans.refresh import Rules
from roleledger.scratch import cleared, shared_dir, staged
from roleledger.sources import keyed_json, master_csv, snapshots
from roleledger.sources.state import RunState
from roleledger.streaming import refresh as streaming
from tests.test_merge import COLLECTED, DAY, incoming, keys_of, posting, table

HEADER = "status,title,company,location,date,blurb,tags,link,id,provider,query,locale,wage,remoteness"


def test_master_of_a_user(spark, tmp_path):
    path = tmp_path / "master.csv"
    path.write_bytes(
        (
            HEADER + "\n"
            'NEW,"Title, with ""quotes""",Co,Here,2024-01-05,"line one\nline, two","a\nb",http://x,k1,INDEED,q,usa_english,,UNKNOWN\n'
            " applied ,Second,Co,Here,2024-1-5,text,,http://y,k2,INDEED,q,nowhere,$5,FULLY_REMOTE\n"
            "interview,Old line,Co,Here,2024-01-05,text,,http://z,k3,INDEED,q,UK_ENGLISH,,sometimes\n"
            "OLD,New line,Co,Here,2024-01-06,text,,http://z,k3,INDEED,q,UK_ENGLISH,,sometimes\n"
        ).encode()
        + b"NEW,Bad \xff byte,Co,Here,n/a,text,,http://b,k4,INDEED,q,UK_ENGLISH,,UNKNOWN\n"
    )
    rows = {r["key_id"]: r for r in master_csv.read_master(spark, str(path)).collect()}
    assert sorted(rows) == ["k1", "k2", "k3", "k4"]
    first = rows["k1"]
    assert first["title"] == 'Title, with "quotes"' and first["description"] == "line one\nline, two"
    assert first["tags"] == ["a", "b"] and first["locale"] == "USA_ENGLISH"
    assert first["scrape_date"] == dt.date(2024, 1, 5) and first["short_description"] == ""
    assert rows["k2"]["status"] == "APPLIED" and rows["k2"]["post_date"] == dt.date(2024, 1, 5)
    assert rows["k2"]["locale"] is None and rows["k2"]["locale_reason"] == "unknown locale"
    assert rows["k3"]["title"] == "New line" and rows["k3"]["status"] == "OLD"
    assert rows["k3"]["remoteness"] == "UNKNOWN" and rows["k3"]["remoteness_reason"] == "unknown remoteness"
    assert rows["k4"]["title"] == "Bad  byte" and rows["k4"]["post_date"] is None


def test_master_of_an_old_version(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text("title,id,company,location,date,blurb,tags,link,provider,query\nT,k,C,L,2024-01-05,text,\"x, y\",u,p,q\n")
    row = master_csv.read_master(spark, str(path), tag_separator=", ").first()
    assert (row["status"], row["remoteness"], row["wage"], row["locale"]) == ("UNKNOWN", "UNKNOWN", "", None)
    assert row["tags"] == ["x", "y"]


def test_master_folder_of_two_versions(spark, tmp_path):
    folder = tmp_path / "all of them"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + "\nNEW,One,Co,Here,2024-01-05,a long text,,http://x,k1,INDEED,q,UK_ENGLISH,,UNKNOWN\n")
    (folder / "b.csv").write_text(
        "title,id,company,location,date,blurb,tags,link,provider,query\nT,k2,C,L,2024-01-05,a long text,,u,p,q\n"
        "No key,,C,L,2024-01-05,a long text,,u,p,q\nNor here,,C,L,2024-01-05,a long text,,u,p,q\n"
    )
    (folder / "c.csv").write_text("")
    rows = {r["key_id"]: (r["title"], r["status"], r["url"]) for r in master_csv.read_master(spark, str(folder)).collect()}
    assert rows == {"k1": ("One", "NEW", "http://x"), "k2": ("T", "UNKNOWN", "u")}
    bad = master_csv.rejected_master_rows(spark, str(folder)).collect()
    assert sorted((r["title"], r["invalid_reason"]) for r in bad) == [("No key", "key unset"), ("Nor here", "key unset")]


def test_master_round_trip(spark, tmp_path):
    rows = table(spark, [posting("a", description=' "odd", \\ text\n\nwith lines '), posting("b", tags=["x", "y z"])])
    master_csv.write_master(rows, str(tmp_path / "m"))
    back = master_csv.read_master(spark, str(tmp_path / "m"))
    got = {r["key_id"]: r for r in back.collect()}
    assert got["a"]["description"] == ' "odd", \\ text\n\nwith lines '
    assert got["b"]["tags"] == ["x", "y z"]
    header = next((tmp_path / "m").glob("*.csv")).read_text().splitlines()[0]
    assert header == HEADER


def test_keyed_json(spark, tmp_path):
    entry = {"title": "T", "company": "C", "post_date": "2024-01-01", "description": "d", "status": "DELETE"}
    path = tmp_path / "list.json"
    path.write_text(json.dumps({"k1": entry, "k2": entry | {"title": "ü"}}, indent=4, ensure_ascii=False))
    read = keyed_json.read_keyed_json(spark, str(path))
    assert {r["key_id"]: r["title"] for r in read.collect()} == {"k1": "T", "k2": "ü"}
    keyed_json.write_keyed_json(read, str(tmp_path / "lines"))
    again = keyed_json.read_keyed_json(spark, str(tmp_path / "lines"), object_per_line=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, read.collect()))
    missing = keyed_json.read_keyed_json(spark, str(tmp_path / "nowhere.json"))
    assert missing.count() == 0 and missing.columns == read.columns


def odd_entries(count):
    """Entries whose texts look like structure: quotes, braces, backslashes, line ends, other scripts."""
    pick = random.Random(count)
    bits = ["{", "}", '"', "\\", "\n", "},{", '\\"', "\\\\", "é", "日本", "plain words", ": {", "", '"}', "[", "\u2028"]
    word = lambda: "".join(pick.choice(bits) for _ in range(pick.randrange(12)))
    return {f"k{i} {word()}": {"title": word(), "company": word(), "post_date": None, "description": word() * 9, "status": "OLD"} for i in range(count)}


@pytest.mark.parametrize("layout", [{"indent": 4, "sort_keys": True, "ensure_ascii": False}, {}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_one_object_is_read_in_splits(spark, tmp_path, layout):
    folder = tmp_path / "lists"
    folder.mkdir()
    entries = odd_entries(300)
    names = list(entries)
    for i, part in enumerate((names[:200], names[200:299], [], names[299:])):
        (folder / f"{i}.json").write_text(json.dumps({n: entries[n] for n in part}, **layout) + "\n" * (i % 2), encoding="utf-8")
    whole = keyed_json.read_keyed_json(spark, str(folder))
    expected = sorted((k, *v.values()) for k, v in entries.items())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        split = keyed_json._fragments(spark, str(folder))
        assert split.select("file", "block").distinct().count() > 20
        found = keyed_json.read_keyed_json(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    none = lambda rows: sorted(tuple("" if v is None else v for v in r) for r in rows)
    assert none(found) == none(expected) == none(whole.collect())


def test_an_object_as_written(spark, tmp_path):
    rows = spark.createDataFrame([(k, *v.values()) for k, v in odd_entries(40).items()], "key_id string, title string, company string, post_date string, description string, status string")
    keyed_json.write_json_object(rows, str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("part-*")
    assert {k: v["title"] for k, v in json.loads(file.read_text()).items()} == {r["key_id"]: r["title"] for r in rows.collect()}
    read = keyed_json.read_keyed_json(spark, str(tmp_path / "one"))
    assert sorted(map(str, read.collect())) == sorted(map(str, rows.collect()))


def test_a_long_object_is_written_in_parts(spark, tmp_path, monkeypatch):
    schema = "key_id string, title string, company string, post_date string, description string, status string"
    entries = [(k, *v.values()) for k, v in odd_entries(400).items()]
    monkeypatch.setattr(keyed_json, "PART_BYTES", 4000)
    # One key makes up half of the second list.
    for name, values in (("many", entries), ("one", entries + [("same", *entries[0][1:])] * 400)):
        rows, folder = spark.createDataFrame(values, schema), tmp_path / name
        keyed_json.write_json_object(rows, str(folder))
        files = sorted(folder.glob("part-*"))
        whole = "".join(f.read_text() for f in files)
        assert {k: v["title"] for k, v in json.loads(whole).items()} == {v[0]: v[1] for v in values}
        assert len(files) > 5 and max(f.stat().st_size for f in files) < len(whole.encode()) / 3
        assert sorted(map(str, keyed_json.read_keyed_json(spark, str(folder)).collect())) == sorted(map(str, rows.collect()))


def test_snapshot_of_a_day_is_replaced_alone(spark, tmp_path):
    root, days = str(tmp_path / "snaps"), [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    rows = table(spark, [posting("a"), posting("b")])
    for day in days:
        snapshots.write_snapshot(rows, root, day, "1")
    snapshots.write_snapshot(rows.where("key_id = 'a'"), root, days[0], "2")
    assert keys_of(snapshots.read_snapshot(spark, root, days[0])) == ["a"]
    assert keys_of(snapshots.read_snapshot(spark, root, days[1])) == ["a", "b"]
    odd = snapshots.foreign_versions(snapshots.read_snapshots(spark, root), "1").collect()
    assert [tuple(r) for r in odd] == [("2", 1)]
    assert snapshots.read_snapshot(spark, root, dt.date(2024, 2, 1), missing_ok=True) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root, dt.date(2024, 2, 1))
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, str(tmp_path / "none"), days[0])
    plan = snapshots.read_snapshot(spark, root, days[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def numbers(spark, values, mark="one"):
    return spark.createDataFrame([(f"k{i}", mark) for i in values], "key_id string, mark string")


def rows_of(state, run):
    return {r["key_id"]: r["mark"] for r in state.read("master", run).collect()}


def test_state_follows_commits(spark, tmp_path):
    state = RunState(spark, str(tmp_path / "state"))
    assert state.latest_run() is None and state.read("master", None) is None
    state.commit(0, {"master": numbers(spark, range(100))})
    # A run that died before its commit.
    numbers(spark, range(9), "died").write.parquet(f"{state.root}/master/changes/run_id=1")
    assert state.latest_run() == 0 and len(rows_of(state, 0)) == 100
    gone = numbers(spark, [0, 1], None).withColumn("_gone", F.lit(True))
    state.commit(1, {"master": numbers(spark, [5, 200], "two").withColumn("_gone", F.lit(False)).unionByName(gone)})
    assert state.latest_run() == 1 and state.latest_run(before=1) == 0
    assert state.is_committed(1) and not state.is_committed(2)
    expected = {f"k{i}": "one" for i in range(2, 100)} | {"k5": "two", "k200": "two"}
    assert rows_of(state, 1) == expected and len(rows_of(state, 0)) == 100
    # A key that went may come again.
    state.commit(2, {"master": numbers(spark, [0], "again")})
    assert rows_of(state, 2) == expected | {"k0": "again"}


def written(root):
    return sum(f.stat().st_size for f in root.rglob("*.parquet"))


def test_state_writes_changes_compacts_and_prunes(spark, tmp_path):
    root = tmp_path / "state"
    state = RunState(spark, str(root))
    state.commit(0, {"master": numbers(spark, range(40_000))})
    whole = written(root / "master")
    state.commit(1, {"master": numbers(spark, range(400), "new")})
    # One row in a hundred, and the footers of a few small files.
    assert written(root / "master" / "changes" / "run_id=1") < 0.1 * whole
    assert state.layout(1)["master"]["base"] == 0 and state.layout(1)["master"]["changed_rows"] == 400
    plan = state.read("master", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3
    for run in range(2, 5):
        state.commit(run, {"master": numbers(spark, range(run * 4000, run * 4000 + 4000), f"run {run}")})
    # The changes reached a quarter of the base, so a new base was written, and what it replaced goes in time.
    held = state.layout(4)["master"]
    assert held["base"] == 4 and held["base_rows"] == 40_000 and held["changes"] == []
    for run in range(5, 8):
        state.commit(run, {"master": numbers(spark, [1], f"run {run}")})
    assert sorted(p.name for p in (root / "master" / "base").iterdir()) == ["run_id=4"]
    assert sorted(p.name for p in (root / "master" / "changes").iterdir()) == ["run_id=5", "run_id=6", "run_id=7"]
    found = rows_of(state, 7)
    assert len(found) == 40_000 and found["k1"] == "run 7" and found["k9000"] == "run 2" and found["k300"] == "new"


def test_a_run_writes_only_what_it_changes(spark, tmp_path):
    state = RunState(spark, str(tmp_path / "state"))
    run = streaming.refresh_batch(state, Rules(as_of=DAY))
    words = [f"w{i} w{i + 1} w{i + 2} w{i * i}" for i in range(0, 600, 3)]
    run(incoming(spark, [posting(f"p{i}", "2024-01-05", description=w) for i, w in enumerate(words)]), 0)
    changed = [posting("p7", "2024-01-20", wage="news", description="other q1 q2"), posting("new", description="z1 z2 z3")]
    run(incoming(spark, changed), 1)
    held = state.layout(1)["master"]
    assert held["base"] == 0 and held["changed_rows"] == 2
    # The next run is so late that almost all rows are too old; they leave by their keys.
    streaming.refresh_batch(state, Rules(as_of=dt.date(2024, 3, 18)))(incoming(spark, [posting("late", "2024-03-10", description="y1 y2")]), 2)
    assert keys_of(state.read("master", 2)) == ["late", "p7"]


def test_a_batch_delivered_twice_counts_once(spark, tmp_path):
    state = RunState(spark, str(tmp_path / "state"))
    run = streaming.refresh_batch(state, Rules(as_of=DAY))
    run(incoming(spark, [posting("a")]), 0)
    run(incoming(spark, [posting("b")]), 1)
    run(incoming(spark, [posting("c")]), 1)
    assert state.latest_run() == 1
    assert keys_of(state.read("master", 1)) == ["a", "b"]


def test_stream_over_landed_files(spark, tmp_path):
    landing, root, marks = (str(tmp_path / n) for n in ("landing", "state", "marks"))
    for rows in ([posting("a"), posting("a", wage="second")], [posting("a", "2024-01-20", wage="news"), posting("b")]):
        incoming(spark, rows).write.mode("append").parquet(landing)
        stream = streaming.landed_postings(spark, landing, COLLECTED)
        streaming.stream_refresh(stream, root, marks, Rules(as_of=DAY)).awaitTermination()
    state = RunState(spark, root)
    master = state.read("master", state.latest_run())
    assert {r["key_id"]: r["wage"] for r in master.collect()} == {"a": "news", "b": ""}


def test_stream_keeps_the_first_of_a_key(spark, tmp_path):
    """By page and place, not by arrival, and only once a later day has been seen."""
    landing, out, marks = (str(tmp_path / n) for n in ("landing", "out", "marks"))
    shape = "key_id string, wage string, page_no int, pos int, seen timestamp"
    day = dt.datetime(2024, 1, 31, 9)
    batches = [
        [("a", "third", 2, 0, day), ("b", "only", 1, 0, day)],
        [("a", "second", 1, 5, day + dt.timedelta(hours=3)), ("a", "first", 1, 4, day)],
        [("a", "next day", 9, 9, day + dt.timedelta(days=1)), ("c", "later", 1, 1, day + dt.timedelta(days=4))],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(landing)
        stream = streaming.landed_postings(spark, landing, spark.createDataFrame([], shape).schema)
        firsts = streaming.stream_first_wins(stream, "seen", "1 day")
        writer = firsts.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
        writer.trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((r["key_id"], r["wage"]) for r in spark.read.schema(shape).parquet(out).collect()))
    assert seen == [[], [], [("a", "first"), ("a", "next day"), ("b", "only")]]


def test_what_a_run_stages_goes_at_its_end(spark):
    with cleared(spark) as folder:
        inside = staged(spark.range(3), "numbers")
        assert inside.count() == 3 and Path(folder).exists()
    assert not Path(folder).exists()
    with pytest.raises(ValueError), cleared(spark) as folder:
        staged(spark.range(3), "numbers")
        raise ValueError
    assert not Path(folder).exists()
    assert staged(spark.range(3), "numbers").count() == 3


def test_a_staged_table_leaves_no_shuffle_files(spark):
    folders = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*")}
    before = files()
    assert staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    # The count after it is one more shuffle, which is not staged and small.
    until = time.time() + 20
    while (left := {f.name.split("_")[1] for f in files() - before}) and len(left) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_batch_leaves_nothing_staged(spark, tmp_path):
    shared = Path(shared_dir(spark)) / "roleledger"
    before = set(shared.iterdir()) if shared.exists() else set()
    state = RunState(spark, str(tmp_path / "state"))
    for number in range(2):
        streaming.refresh_batch(state, Rules(as_of=DAY))(incoming(spark, [posting("a"), posting("b")]), number)
    assert set(shared.iterdir()) == before
    assert sorted(r["key_id"] for r in state.read("master", 1).collect()) == ["a", "b"]


def test_files_of_one_header_are_read_by_their_folder(spark, tmp_path):
    line = "\nNEW,One,Co,Here,2024-01-05,a long text,,http://x,{},INDEED,q,UK_ENGLISH,,UNKNOWN\n"
    for key in ("k1", "k2"):
        (tmp_path / f"{key}.csv").write_text(HEADER + line.format(key))
    assert master_csv._layouts(spark, str(tmp_path)) == [str(tmp_path)]
    assert sorted(r["key_id"] for r in master_csv.read_master(spark, str(tmp_path)).collect()) == ["k1", "k2"]
    (tmp_path / "k3.csv").write_text("title,id\nT,k3\n")
    assert len(master_csv._layouts(spark, str(tmp_path))) == 2
    assert sorted(r["key_id"] for r in master_csv.read_master(spark, str(tmp_path)).collect()) == ["k1", "k2", "k3"]
