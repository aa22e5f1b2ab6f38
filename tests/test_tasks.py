from __future__ import annotations

from tallyframe.functions.frames import ROWS_A_TASK, TASK_BYTES, empty, small_tasks
from tallyframe.plans import reconciliation
from tallyframe.streaming import matcher

SIZE, PARTS = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"


def test_tasks_stay_small_however_many_rows_there_are(spark):
    before = spark.conf.get(SIZE), spark.conf.get(PARTS)
    with small_tasks(spark, 100 * ROWS_A_TASK + 1):
        assert int(spark.conf.get(SIZE)) == TASK_BYTES and spark.conf.get(PARTS) == "101"
        with small_tasks(spark):
            assert spark.conf.get(PARTS) == "101"
    assert (spark.conf.get(SIZE), spark.conf.get(PARTS)) == before


def test_the_results_table_is_built_in_small_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(reconciliation, "_submitted", lambda s, d: 9 * ROWS_A_TASK)
    monkeypatch.setattr(reconciliation, "_results", lambda s, d: seen.append(s.conf.get(PARTS)) or s.range(3).withColumnRenamed("id", "n"))
    monkeypatch.setattr(reconciliation.store, "save", lambda found, path: seen.append(spark.conf.get(PARTS)))
    reconciliation._build(spark, "nowhere")
    assert seen == ["9", "9"] and spark.conf.get(PARTS) == "4"


def test_counts_against_the_truth_are_decided_in_small_tasks(spark, monkeypatch):
    seen, whole = [], reconciliation.results.reconcile
    monkeypatch.setattr(reconciliation, "_submitted", lambda s, d: 9 * ROWS_A_TASK)
    monkeypatch.setattr(reconciliation.results, "reconcile", lambda *a: seen.append(spark.conf.get(PARTS)) or whole(*a))
    rows = reconciliation.compare_to_truth(spark, "/root/testdata/sf0.001").collect()
    assert seen == ["9"] and len(rows) == 6 and spark.conf.get(PARTS) == "4"


def test_pairs_of_the_stream_carry_what_a_match_says_and_no_more(spark, tmp_path, monkeypatch):
    seen, assign = [], matcher.matching.assign
    monkeypatch.setattr(matcher.matching, "assign", lambda pairs, mode: seen.append(set(pairs.columns)) or assign(pairs, mode))
    rows = empty(spark, matcher.WAITING)
    assert matcher.Matcher(str(tmp_path / "out"), str(tmp_path / "state"))._pairs(rows, rows).count() == 0
    assert seen == [{*matcher.matching.CHOICE, *matcher.SAID}]
