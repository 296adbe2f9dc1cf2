"""Bucketed tables and the log of commits: what a change touches, who wins, and what a reader sees."""

import hashlib
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstream.sources.store import Conflict, Store, bucket_of


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, value string")


def contents(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def begun(spark, tmp_path, n=1000, buckets=16):
    store = Store(spark, str(tmp_path))
    t = store.begin()
    t.replace("a", spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("value")), ["id"], buckets)
    t.replace("b", rows(spark, (1, "x")), ["id"], 2)
    t.commit(batch=-1)
    return store


def test_a_change_touches_its_buckets(spark, tmp_path):
    """A delta of one in a hundred rows, in two buckets: the files of the other buckets stay, byte for byte, and are named as before."""
    store = begun(spark, tmp_path)
    before, held = store.current(), contents(tmp_path)
    delta = spark.range(1000).where(bucket_of(["id"], 16).isin(3, 8)).limit(9).select("id", F.lit("new").alias("value")).unionByName(rows(spark, (5000, "added"))).where(bucket_of(["id"], 16).isin(3, 8))
    n = delta.count()
    changed = delta.where("id < 1000").count()
    t = store.begin()
    touched = t.upsert("a", delta)
    assert touched == sorted(r[0] for r in delta.select(bucket_of(["id"], 16)).distinct().collect()) and set(touched) <= {3, 8}
    after = t.commit()
    assert {k: v for k, v in contents(tmp_path).items() if k in held} == held
    for b in set(range(16)) - set(touched):
        assert after.files("a", [b]) == before.files("a", [b])
    assert after["a"].where("value = 'new'").count() == changed and after["a"].count() == 1000 + n - changed and before["a"].where("value = 'new'").count() == 0
    assert after.of_keys("a", rows(spark, (4, ""), (4, ""), (9999, ""))).collect() == after["a"].where("id = 4").collect()


def test_changes_in_one_transaction(spark, tmp_path):
    store = begun(spark, tmp_path, 20)
    t = store.begin()
    t.upsert("a", spark.createDataFrame([(1, "first", 1), (1, "last", 2), (99, "n", 1)], "id long, value string, seq int"), "seq")
    t.delete("a", rows(spark, (2, None), (77, None)))
    t.append("a", rows(spark, (100, "added")))
    t.upsert("b", rows(spark))
    assert store.current()["a"].count() == 20  # nobody sees it yet
    got = {r["id"]: r["value"] for r in t.commit(batch=4)["a"].collect()}
    assert len(got) == 21 and (got[1], got[99], got[100]) == ("last", "n", "added") and 2 not in got
    assert store.current().meta == {"batch": 4} and store.current(1)["a"].count() == 20 and store.current()["b"].count() == 1


def test_two_writers(spark, tmp_path):
    """Of two that began at one version one commits; the other's tables are seen by nobody, and a run from anew takes both in."""
    store = begun(spark, tmp_path, 10)
    one, two = store.begin(), store.begin()
    one.upsert("a", rows(spark, (1, "one"))), two.upsert("a", rows(spark, (2, "two")))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert {r["value"] for r in store.current()["a"].collect()} & {"one", "two"} == {"one"}
    store.run(lambda t: t.upsert("a", rows(spark, (2, "two"))))
    assert {r["value"] for r in store.current()["a"].collect()} & {"one", "two"} == {"one", "two"}
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if store.put(9, {"tables": {}, "meta": {"k": k}}) else None) for k in range(8)]
    [x.start() for x in threads], [x.join() for x in threads]
    assert len(won) == 1 and store.current(9).meta == {"k": won[0]}


def test_a_writer_that_dies(spark, tmp_path):
    """Between two tables, and between data and manifest: readers stay on the old version, and what was left goes with vacuum."""
    store = begun(spark, tmp_path, 10)
    t = store.begin()
    t.upsert("a", rows(spark, (1, "lost")))
    assert store.current().version == 1 and store.current()["a"].where("value = 'lost'").count() == 0
    (Path(tmp_path) / "_commits" / ".half").write_bytes(b'{"tables": ')
    assert store.current().version == 1
    files = len(contents(tmp_path))
    assert store.vacuum(older_than=3600) == 0 and store.vacuum(older_than=-1) >= 1 and len(contents(tmp_path)) < files
    assert store.current()["a"].count() == 10
    for k in range(3):
        store.run(lambda t, k=k: t.upsert("a", rows(spark, (k, f"r{k}"))))
    store.vacuum(keep=1, older_than=-1)
    assert store.current()["a"].where("value like 'r%'").count() == 3 and store.current().version == 4
    assert Store(spark, f"{tmp_path}/none").current().tables == {}


def test_a_batch_that_runs_again(spark, tmp_path):
    """A micro-batch that died before its manifest leaves nothing and runs anew; one that had committed does nothing."""
    from tests_tables import item, items_of, keyword, source, tables

    from quillstream.streaming import collect as stream

    folder = str(tmp_path)
    for name, df in tables(spark, rss_sources=[source(1)], keywords=[keyword(1, ["tariff"])]).items():
        df.write.parquet(f"{folder}/base/{name}")
    store, when = stream.begun(spark, folder, 4), datetime(2026, 7, 22, 4)
    items = items_of(spark, item(1, 1, 0, title="Tariff", published_at=datetime(2026, 7, 22, 3)))
    t = store.begin()
    t.upsert("articles", stream.changes(stream._tables(t.base), items, F.lit(when).cast("timestamp"), 1)["articles"])  # and dies
    assert stream.current(spark, folder)["articles"].count() == 0
    assert stream.step(store, items, 0, when) and not stream.step(store, items, 0, when)
    now = stream.current(spark, folder, 0)
    assert (now["articles"].count(), now["collection_runs"].count(), now["collection_cursors"].count()) == (1, 1, 1)
    with pytest.raises(ValueError, match="not that of batch"):
        stream.current(spark, folder, -2)


def test_search_reads_files_that_may_hold_the_text(spark, tmp_path):
    """Equal rows for patterns of all kinds, and only the files that the trigrams leave; a commit indexes its new files alone."""
    import random

    from quillstream.sources import textindex

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    docs = [(i, " ".join(word() for _ in range(6)), None if i % 9 == 0 else " ".join(word() for _ in range(9)), "P", f"https://n.org/{i}") for i in range(300)]
    docs += [(300, "Quixotic ZEBRA", "", "Straße 100%", "u"), (301, "xy", "Ünïcode ÉCOLE", "a_b", "u")]
    frame = spark.createDataFrame(docs, "id long, title string, summary string, publisher string, url string")
    store = Store(spark, str(tmp_path))
    t = store.begin()
    t.replace("articles", frame, ["id"], 16)
    first = t.commit()
    index = textindex.signatures(first, "articles").cache()
    every = len(first.files("articles"))
    read = {}
    for pattern in ("zebra", "quix", "ic ze", "école", "STRASSE", "straße", "a", "", "xy", "ab%gh", "%", "q_ix", "ixo%bra", "100\\%", "nothing here", "abc", "https://n.org/12", "zz"):
        got = textindex.holding(first, "articles", index, pattern)
        want = frame.where(F.col("title").ilike(f"%{pattern}%") | F.col("summary").ilike(f"%{pattern}%") | F.col("publisher").ilike(f"%{pattern}%") | F.col("url").ilike(f"%{pattern}%"))
        assert sorted(x["id"] for x in got.collect()) == sorted(x["id"] for x in want.collect()), pattern
        read[pattern] = len(textindex.files_with(index, first, "articles", pattern))
    assert read["zebra"] == read["quix"] == read["ixo%bra"] == 1 and read["nothing here"] == 0 and read["a"] == read["100\\%"] == read["xy"] == every > 10
    second = store.run(lambda t: t.upsert("articles", spark.createDataFrame([(500, "Zebra too", "", "", "")], frame.schema)))
    fresh = set(second.files("articles")) - set(first.files("articles"))
    later = textindex.signatures(second, "articles", known=index)
    assert {x["file"] for x in later.select("file").collect()} == set(second.files("articles")) and len(fresh) == 1
    assert sorted(x["id"] for x in textindex.holding(second, "articles", later, "zebra").collect()) == [300, 500]
    assert len(textindex.holding(second, "articles", later, "zebra").inputFiles()) <= 2


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """One bucket of more than a task should read: its rows lie in several files, and are all there."""
    from quillstream.sources import textindex

    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    frame = spark.range(0, 4000, 1, 8).select("id", F.concat(F.lit("T"), "id").alias("title"), F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(8)]).alias("summary"), F.lit("P").alias("publisher"), F.lit("").alias("url"))
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
        t = Store(spark, str(tmp_path)).begin()
        t.replace("articles", frame, ["id"], 2)
        last = t.commit()
        assert set(last.tables["articles"]["files"]) == {"0", "1"} and all(len(last.files("articles", [b])) > 2 for b in (0, 1))
        assert last["articles"].count() == last["articles"].select("id").distinct().count() == 4000
        assert last.of_keys("articles", last["articles"].where("id = 77")).count() == 1
        index = textindex.signatures(last, "articles")
        assert [r["id"] for r in textindex.holding(last, "articles", index, "T3999").select("id").collect()] == [3999]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_arrivals_of_many_files(spark, tmp_path, monkeypatch):
    """Three arrivals are three micro-batches, whatever the number of files each was written in."""
    from quillstream.plans import state_queries

    docs = spark.range(0, 60, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("the license "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(state_queries, "shared_folder", lambda s, kind="cut": f"{tmp_path}/{kind}")
    got = {r[0]: r[1] for r in state_queries.streamed_in_batches(spark, str(tmp_path)).collect()}
    assert got["runs"] == "3" and len(list(Path(f"{tmp_path}/items").glob("*.parquet"))) > 3 * 3
