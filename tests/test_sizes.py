"""What a step reads, carries and shuffles, where that decides how large an input it takes."""

from __future__ import annotations

from tallyframe.operators import matching, results, store

from .test_matching import fold, frame, row


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _taken(df):
    return {(r["g_row_id"], r["l_row_id"]) for r in df.collect()}


def test_pairs_alone_in_their_group_are_taken_without_a_fold(spark):
    rows = [row("gateway" if n % 2 else "ledger", n, txn=f"T{n // 2}") for n in range(40)]
    got = matching.assign(matching.classified(frame(spark, rows)))
    assert "collect_list" not in _plan(got) and len(_taken(got)) == 20 and _taken(got) == fold(rows, "arrived")
    # one group of several rows: it alone is folded, by turns and by rounds
    more = [*rows, row("ledger", 100, txn="T3"), row("gateway", 101, txn="T3")]
    pairs = matching.classified(frame(spark, more))
    for most in (matching.FOLD_EDGES, 0):
        assert _taken(matching.assign(pairs, "arrived", most)) == fold(more, "arrived")


def test_where_only_ids_are_asked_for_edges_carry_no_more(spark):
    rows = [row("gateway" if n % 2 else "ledger", n, txn=f"T{n // 6}", received=n * 7 % 11) for n in range(36)]
    pairs = matching.classified(frame(spark, rows))
    for mode in ("arrived", "all"):
        got = matching.assign(pairs.select(*matching.CHOICE), mode)
        assert "amount" not in {c.split("_", 1)[1] for c in got.columns if c.startswith("g_")}
        assert _taken(got) == _taken(matching.assign(pairs, mode)) == fold(rows, mode)


def test_results_are_joined_once_before_they_are_numbered(spark, tmp_path, monkeypatch):
    rows = [row("gateway" if n % 2 else "ledger", n, txn=f"T{n // 2}") for n in range(12)]
    pairs = matching.classified(frame(spark, rows))
    from tallyframe.operators import reads

    found = results.match_results(pairs, keep=reads.SIDES)
    store.save(found.filter("gateway_id % 4 = 1"), str(tmp_path / "t"))
    plans, numbered = [], results.numbered
    monkeypatch.setattr(results, "numbered", lambda df: plans.append(_plan(df)) or numbered(df))
    assert store.add(spark, str(tmp_path / "t"), found) == 3 and store.add(spark, str(tmp_path / "t"), found) == 0
    assert len(plans) == 1 and "Join" not in plans[0]
    assert sorted(r["id"] for r in store.load(spark, str(tmp_path / "t")).collect()) == [1, 2, 3, 4, 5, 6]
