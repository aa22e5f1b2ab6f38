"""Matching: candidate pairs, the layered classifier, and greedy one-to-one assignment.

The join is on (txn_id, currency) and a stretch of time, with the exact window as its
residual, so that even one transaction with very many rows is spread over tasks. The
assignment folds the edges of a group in one row where they are few, and takes them in
rounds of joins where they are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from ..functions.frames import written
from ..functions.money import tolerance
from ..functions.times import diff_us, time_delta_us

GROUP = ("txn_id", "currency")
_FACTS = ("row_id", "amount", "occurred_at", "received_at")
#: What an assignment reads of a pair; where only ids are asked for, edges need carry no more.
CHOICE = (*GROUP, "g_row_id", "l_row_id", "rank", "dt_us", "d_amount", "g_received_at", "l_received_at")
LAYER_OF_RANK = ("exact", "time_drift", "amount_drift")
#: A stretch of the time axis is this many drift windows long.
WINDOWS_A_STRETCH = 10
#: Edges of one transaction and currency that are folded in one row.
FOLD_EDGES = 256
#: Crowded groups (two short keys each) that are broadcast at most.
BROADCAST_GROUPS = 100_000
#: Ids that one task counts.
IDS_A_TASK = 250_000


def side(receipts: DataFrame, name: str, more: tuple[str, ...] = ()) -> DataFrame:
    """One side's facts, and more of its columns, under its own column names."""
    short = name[0]
    return receipts.filter(F.col("side") == name).select(*GROUP, *(F.col(c).alias(f"{short}_{c}") for c in (*_FACTS, *more)))


def layer_rank(g_amount: Column, l_amount: Column, dt_us: Column, cfg: MatchConfig = DEFAULT) -> Column:
    """0 exact, 1 time drift, 2 amount drift, null: the pair does not fit."""
    near = dt_us <= cfg.drift_window_us
    return (
        F.when((g_amount == l_amount) & (dt_us <= cfg.exact_window_us), 0)
        .when((g_amount == l_amount) & near, 1)
        .when((g_amount != l_amount) & near & (F.abs(g_amount - l_amount) <= tolerance(g_amount, cfg)), 2)
    )


def layer_name(rank: Column) -> Column:
    return F.when(rank == 0, LAYER_OF_RANK[0]).when(rank == 1, LAYER_OF_RANK[1]).when(rank == 2, LAYER_OF_RANK[2])


def candidates(receipts: DataFrame, cfg: MatchConfig = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """Every gateway and ledger row of one transaction and currency within the drift window.

    A ledger row stands in each stretch of time that its window touches: one, or two at an edge.
    """
    long = F.lit(max(1, WINDOWS_A_STRETCH * cfg.drift_window_us))
    stretch = lambda c, off: F.floor((diff_us(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c)) + off) / long)
    both = F.array_distinct(F.array(stretch("l_occurred_at", -cfg.drift_window_us), stretch("l_occurred_at", cfg.drift_window_us)))
    g = side(receipts, "gateway", more).withColumn("stretch", stretch("g_occurred_at", 0))
    led = side(receipts, "ledger", more).withColumn("stretch", F.explode(both))
    near = diff_us(F.col("g_occurred_at"), F.col("l_occurred_at")).between(-cfg.drift_window_us, cfg.drift_window_us)
    joined = g.join(led, [*GROUP, "stretch"]).filter(near).drop("stretch")
    return joined.withColumns({"dt_us": time_delta_us(F.col("g_occurred_at"), F.col("l_occurred_at")), "d_amount": F.abs(F.col("g_amount") - F.col("l_amount"))})


def classified(receipts: DataFrame, cfg: MatchConfig = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """Candidate pairs with rank and match_layer; pairs that do not fit are left out. more: further columns of both rows."""
    rank = layer_rank(F.col("g_amount"), F.col("l_amount"), F.col("dt_us"), cfg)
    return candidates(receipts, cfg, more).withColumn("rank", rank).filter("rank is not null").withColumn("match_layer", layer_name(F.col("rank")))


def best_counterparty(pairs: DataFrame, of: str = "gateway") -> DataFrame:
    """For every row of one side its best partner, as if it alone were to choose."""
    me, other = ("g_row_id", "l_row_id") if of == "gateway" else ("l_row_id", "g_row_id")
    order = F.struct("rank", "dt_us", "d_amount", other)
    return pairs.groupBy(me).agg(F.min(F.struct(order.alias("o"), "match_layer")).alias("b")).select(F.col(me).alias("row_id"), F.col(f"b.o.{other}").alias("partner_id"), F.col("b.match_layer").alias("match_layer"))


def _edges(pairs: DataFrame, mode: str, first: str | None = None) -> DataFrame:
    """Pairs as choices of a candidate, in the order in which the matcher meets them.

    first: a column of pairs that goes before the turns.

    ``arrived``: the later arrival chooses. ``all``: either row may choose, at its own turn.
    An edge carries its pair's other columns, so that nothing is joined back to it.
    """
    turn = lambda s: F.struct(F.col(f"{s}_received_at").alias("at"), F.lit(0 if s == "g" else 1).alias("side"), F.col(f"{s}_row_id").alias("id"))
    rest = F.struct(*(c for c in pairs.columns if c not in (*GROUP, "g_row_id", "l_row_id", "rank", "dt_us", "d_amount"))).alias("rest")
    ahead = [F.col(first).alias("ahead")] if first else []
    edge = lambda s, o: F.struct(*ahead, turn(s).alias("turn"), "rank", "dt_us", "d_amount", F.col(f"{o}_row_id").alias("other"), F.col("g_row_id").alias("g"), F.col("l_row_id").alias("l"), rest)
    by_g, by_l = edge("g", "l"), edge("l", "g")
    if mode == "all":
        return pairs.select(*GROUP, F.explode(F.array(by_g, by_l)).alias("edge"))
    if mode != "arrived":
        raise ValueError(f"mode is arrived or all, not {mode}")
    return pairs.select(*GROUP, F.when(turn("g") > turn("l"), by_g).otherwise(by_l).alias("edge"))


def _folded(edges: Column) -> Column:
    """Which of the ordered edges are taken, when neither of their rows is: their places."""
    none = F.struct(F.array().cast("array<bigint>").alias("g"), F.array().cast("array<bigint>").alias("l"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))
    free = lambda a, e: ~F.array_contains(a["g"], e["g"]) & ~F.array_contains(a["l"], e["l"])
    take = lambda a, e: F.struct(F.array_append(a["g"], e["g"]).alias("g"), F.array_append(a["l"], e["l"]).alias("l"), F.array_append(a["at"], a["i"]).alias("at"), (a["i"] + 1).alias("i"))
    leave = lambda a: F.struct(a["g"].alias("g"), a["l"].alias("l"), a["at"].alias("at"), (a["i"] + 1).alias("i"))
    return F.aggregate(edges, none, lambda a, e: F.when(free(a, e), take(a, e)).otherwise(leave(a)), lambda a: a["at"])


def _fold(edges: DataFrame) -> DataFrame:
    """The edges taken, where no group has more than a row may hold."""
    listed = edges.groupBy(*GROUP).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    places = F.when(F.size("edges") == 1, F.array(F.lit(0))).otherwise(_folded(F.transform("edges", lambda e: F.struct(e["g"].alias("g"), e["l"].alias("l")))))
    return listed.select(*GROUP, "edges", F.explode(places).alias("at")).select(*GROUP, F.get("edges", F.col("at")).alias("edge"))


def _shared_groups(edges: DataFrame) -> DataFrame:
    """Groups of more than one edge, and how many they have."""
    return edges.groupBy(*GROUP).agg(F.count("*").alias("n")).filter("n > 1")


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that are first at both of their rows, and those that still have free rows."""
    flat = left.withColumns({"g": F.col("edge.g"), "l": F.col("edge.l")})
    first = lambda c: flat.groupBy(*GROUP, c).agg(F.min("edge").alias(f"first_{c}"))
    met = flat.join(first("g"), [*GROUP, "g"]).join(first("l"), [*GROUP, "l"])
    took = written(met.filter((F.col("edge") == F.col("first_g")) & (F.col("edge") == F.col("first_l"))).select(*GROUP, "edge", "g", "l"), "assigned")
    free = flat.join(took.select(*GROUP, "g"), [*GROUP, "g"], "left_anti").join(took.select(*GROUP, "l"), [*GROUP, "l"], "left_anti")
    return took.select(*GROUP, "edge"), free.select(*GROUP, "edge")


def _settled(edges: DataFrame, most: int) -> DataFrame:
    """The edges taken of a written table of edges: small groups by the fold, others by rounds.

    An edge that is alone in its group is taken as it stands. Where the other groups are few
    enough to be broadcast, nothing is shuffled for it.

    Edges are totally ordered, so the greedy scan takes exactly the edges that are first at
    both of their rows, again and again. A round is two aggregations and joins on single
    rows, and takes at least the first edge of each group, so the loop ends; a group goes to
    the fold as soon as few enough of its edges are left.
    """
    done = []
    while True:
        shared = written(_shared_groups(edges), "shared-groups")
        crowded = shared.filter(F.col("n") > most)
        n, n_crowded = shared.agg(F.count("*"), F.count_if(F.col("n") > most)).first()
        if n <= BROADCAST_GROUPS:
            done.append(edges.join(F.broadcast(shared), [*GROUP], "left_anti"))
            edges = edges.join(F.broadcast(shared), [*GROUP], "left_semi")
        if not n:
            break
        if not n_crowded:
            done.append(_fold(edges))
            break
        if n_crowded <= BROADCAST_GROUPS:
            crowded = F.broadcast(crowded)
        done.append(_fold(edges.join(crowded, [*GROUP], "left_anti")))
        took, left = _round(edges.join(crowded, [*GROUP], "left_semi"))
        done.append(took)
        edges = written(left, "edges-left")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def assign(pairs: DataFrame, mode: str = "arrived", fold_edges: int = FOLD_EDGES, first: str | None = None) -> DataFrame:
    """One-to-one matches: every row, in turn, takes its best partner that is still free.

    first: a column of pairs; those with a smaller value are met before all others.
    """
    edges = written(_edges(pairs, mode, first), "edges")
    rest = [f.name for f in edges.schema["edge"].dataType["rest"].dataType]
    named = {"g_row_id": "g", "l_row_id": "l", "rank": "rank", "dt_us": "dt_us", "d_amount": "d_amount"}
    of = lambda c: F.col(c) if c in GROUP else F.col(f"edge.{named[c]}").alias(c) if c in named else F.col(f"edge.rest.{c}").alias(c)
    assert set(pairs.columns) == {*GROUP, *named, *rest}
    return _settled(edges, fold_edges).select(*map(of, pairs.columns))


def assign_rounds(pairs: DataFrame, mode: str = "arrived") -> DataFrame:
    """The same matches by rounds alone, whatever the size of a group."""
    return assign(pairs, mode, fold_edges=0)


def crowded(matches: DataFrame) -> DataFrame:
    """Rows with more than one match: none, ever. matches is counted first, so it should be a written table.

    Ids are dealt out by how many there are: in bytes they are so few that one task would hold millions of them.
    """
    parts = max(1, -(-matches.count() // IDS_A_TASK))
    per = lambda s, c: matches.select(F.col(c).alias("row_id")).repartition(parts, "row_id").groupBy("row_id").count().filter("count > 1").select(F.lit(s).alias("side"), "row_id", "count")
    return per("gateway", "g_row_id").unionByName(per("ledger", "l_row_id"))
