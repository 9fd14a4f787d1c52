"""Order-dependent duplicate rules, folded within components of similar rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(pairs: DataFrame) -> DataFrame:
    """id and component (its least id) of the rows that pairs (a, b) join; labels fall along pairs until none does.

    Each round halves the way to go by also taking the label of a row's label.  Rounds are checkpointed.
    """
    edges = pairs.select("a", "b").union(pairs.select("b", "a")).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")).checkpoint()
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        fell = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = fell.join(far, "component", "left").select("id", F.least("component", F.coalesce("far", "component")).alias("component"), "old").checkpoint()
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            break
    return labels


#: Pairs of a component that are folded in one task; larger components are decided in rounds of joins.
IN_TASK = 200_000


def _directed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs from the earlier row (a) to the later (b), with sim and the rows' places (oa, ob) and qualities (qa, qb)."""
    place = F.struct("seq", "id")
    one, two = (rows.select(F.col("id").alias(n), place.alias(f"o{n}"), F.col("quality").alias(f"q{n}")) for n in "ab")
    known = pairs.select("a", "b", "sim").distinct().join(one, "a").join(two, "b").where("a <> b")
    turn = F.col("oa") > F.col("ob")
    ends = [F.when(turn, F.col(f"{k}{x}")).otherwise(F.col(f"{k}{y}")).alias(f"{k}{y}") for k in ("", "o", "q") for x, y in ("ba", "ab")]
    return known.select(*ends, "sim").groupBy("a", "b", "oa", "ob", "qa", "qb").agg(F.max("sim").alias("sim"))


def _fold_in_tasks(edges: DataFrame, existing_wins: bool) -> DataFrame:
    """id and duplicate_of_id of components (column component) of edges, each folded by one task."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        quality: dict = {}
        order: dict = {}
        near: dict[int, list] = {}
        for e in group.itertuples(index=False):
            quality[e.a], quality[e.b] = e.qa, e.qb
            order[e.a], order[e.b] = (e.sa, e.a), (e.sb, e.b)
            near.setdefault(e.b, []).append((-e.sim, e.a))
        alive: set[int] = set()
        points: dict[int, int] = {}
        for new in sorted(order, key=order.get):
            best = min((x for x in near.get(new, []) if x[1] in alive), default=None)
            if best and (existing_wins or quality[new] < quality[best[1]]):
                points[new] = best[1]
                continue
            if best:
                points[best[1]] = new
                alive.discard(best[1])
            alive.add(new)
        return pd.DataFrame({"id": list(points), "duplicate_of_id": list(points.values())}, dtype="int64")

    flat = edges.select("component", "a", "b", "sim", "qa", "qb", F.col("oa.seq").alias("sa"), F.col("ob.seq").alias("sb"))
    return flat.groupBy("component").applyInPandas(fold, "id long, duplicate_of_id long")


def _fold_in_rounds(edges: DataFrame, existing_wins: bool) -> DataFrame:
    """The same by joins and grouped aggregations, round by round, each checkpointed.

    A row is decided once all its earlier neighbours are, and every undecided row before it that could take a neighbour's
    place.  The first undecided row always is, so rounds end; how many there are depends on how long rows wait for each
    other, not on how many there are.
    """
    ends = edges.select(F.col("a").alias("id"), F.lit(False).alias("waits")).union(edges.select("b", F.lit(True)))
    none = F.lit(None)
    state = ends.groupBy("id").agg(F.max("waits").alias("waits"))
    state = state.select("id", (~F.col("waits")).alias("decided"), none.cast(edges.schema["oa"].dataType).alias("dead"), none.cast("long").alias("point")).checkpoint()
    while not state.where("NOT decided").isEmpty():
        later = state.where("NOT decided").select(F.col("id").alias("b"))
        now = edges.join(later, "b")
        rivals = now.where(F.lit(not existing_wins) & (F.col("qb") >= F.col("qa"))).groupBy("a").agg(F.min("ob").alias("rival"))
        met = now.join(state.select(F.col("id").alias("a"), "decided", "dead"), "a").join(rivals, "a", "left")
        ready = F.col("decided") & (F.col("rival").isNull() | (F.col("rival") >= F.col("ob")))
        alive = F.col("dead").isNull() | (F.col("dead") > F.col("ob"))
        best = F.max(F.when(alive, F.struct("sim", (-F.col("a")).alias("minus"), "qa", "a")))
        settled = met.groupBy("b", "ob", "qb").agg(F.bool_and(ready).alias("ready"), best.alias("best")).where("ready")
        falls = F.col("best").isNotNull() & (F.lit(existing_wins) | (F.col("qb") < F.col("best.qa")))
        settled = settled.withColumn("falls", falls).checkpoint()
        own = settled.select(F.col("b").alias("id"), F.lit(True).alias("new"), F.when(F.col("falls"), F.col("ob")).alias("at"), F.when(F.col("falls"), F.col("best.a")).alias("to"))
        taken = settled.where("NOT falls AND best IS NOT NULL").select(F.col("best.a").alias("id"), F.lit(False), F.col("ob").alias("at"), F.col("b").alias("to"))
        change = own.union(taken).groupBy("id").agg(F.max("new").alias("new"), F.max("at").alias("at"), F.max("to").alias("to"))
        state = state.join(change, "id", "left").select("id", (F.col("decided") | F.coalesce("new", F.lit(False))).alias("decided"), F.coalesce("at", "dead").alias("dead"), F.coalesce("to", "point").alias("point")).checkpoint()
    return state.where("point IS NOT NULL").select("id", F.col("point").alias("duplicate_of_id"))


def _folded(rows: DataFrame, edges: DataFrame, existing_wins: bool, in_task: int) -> DataFrame:
    edges = edges.checkpoint()
    edges = edges.join(components(edges).select(F.col("id").alias("a"), "component"), "a").checkpoint()
    sizes = edges.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > in_task).select("component").checkpoint()
    found = _fold_in_tasks(edges.join(large, "component", "left_anti"), existing_wins)
    if not large.isEmpty():
        found = found.union(_fold_in_rounds(edges.join(large, "component", "left_semi").checkpoint(), existing_wins))
    return rows.select("id").join(found, "id", "left")


def greedy_duplicates(rows: DataFrame, pairs: DataFrame, existing_wins: bool = False, in_task: int = IN_TASK) -> DataFrame:
    """id and duplicate_of_id: rows in the order of `seq` (then id), each set against its most similar surviving neighbour.

    rows: id, seq and quality (a comparable rank); pairs: a, b, sim.  The better of a row and its neighbour survives, the
    later one if they are equal; the other points at it.  With existing_wins the neighbour always survives.  Rows meet only
    inside a component of pairs: one of at most `in_task` pairs is folded by a task, any larger one in rounds of joins.
    """
    return _folded(rows, _directed(rows, pairs), existing_wins, in_task)


def leader_clusters(rows: DataFrame, pairs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """id and cluster: rows in the order of `seq` (then id) join the first cluster whose leader is near, or lead a new one."""
    some = rows.select("id", "seq", F.lit(0).alias("quality"))
    edges = _directed(some, pairs.select("a", "b", F.lit(0).alias("sim"))).withColumn("sim", -F.col("oa.seq"))
    found = _folded(rows, edges, True, in_task)
    return found.select("id", F.coalesce("duplicate_of_id", "id").alias("cluster"))


def pointer_chains(rows: DataFrame) -> DataFrame:
    """id, canonical, cycle and stale of pointers (id, duplicate_of_id), followed to their ends by doubling.

    A pointer to no row is its own end (stale: the chain ends there).  Rows on a cycle, and those that lead to one, have no end: cycle
    is then the least id on it, and stands for them as canonical.  Rounds grow with the logarithm of the longest chain or cycle,
    and not with the number of rows: a row is known to lead to a cycle once it has passed the same least id twice.
    """
    end = F.coalesce("duplicate_of_id", "id")
    heads = rows.where("duplicate_of_id IS NULL OR duplicate_of_id = id").select("id")
    known = rows.select(F.col("id").alias("at"), F.lit(True).alias("known"))
    # open: whether there is more to follow; least: the least id from the row's own to the one it has come to; cycle: where known.
    first = rows.select("id", end.alias("at")).join(known, "at", "left").join(heads.select(F.col("id").alias("at"), F.lit(True).alias("head")), "at", "left")
    moves = (F.col("at") != F.col("id")) & F.col("known").isNotNull()
    least, none = F.least("id", F.when(F.col("known"), F.col("at"))), F.lit(None).cast(rows.schema["id"].dataType)
    at = first.select("id", "at", (moves & F.col("head").isNull()).alias("open"), least.alias("least"), (F.col("known").isNull()).alias("stale"), none.alias("cycle")).checkpoint()
    # The least id before a place and the least after it are one only if it comes round; or else the place is this id.
    twice = F.when((F.col("least") == F.col("low")) & (F.col("least") != F.col("at")), F.col("least"))
    back = F.when(F.col("to") == F.col("id"), F.least("least", "low"))
    while not at.where("open").isEmpty():
        step = at.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("open").alias("more"), F.col("least").alias("low"), F.col("stale").alias("lost"), F.col("cycle").alias("round"))
        far = at.where("open").join(step, "at").withColumn("cycle", F.coalesce("round", twice, back))
        far = far.select("id", F.col("to").alias("at"), (F.col("more") & F.col("cycle").isNull()).alias("open"), F.least("least", "low").alias("least"), F.col("lost").alias("stale"), "cycle")
        at = at.where("NOT open").unionByName(far).checkpoint()
    return at.select("id", F.coalesce("cycle", "at").alias("canonical"), "cycle", (F.col("stale") & F.col("cycle").isNull()).alias("stale"))


def resolve_chains(rows: DataFrame) -> DataFrame:
    """id and canonical: pointers followed to their end; see pointer_chains for cycles."""
    return pointer_chains(rows).select("id", "canonical")


def refolded(rows: DataFrame, pairs: DataFrame, state: DataFrame, changed: DataFrame, existing_wins: bool = False, in_task: int = IN_TASK) -> DataFrame:
    """The state (id, component, duplicate_of_id) after the rows of `changed` (id) were cleared, added, altered or removed.

    rows and pairs are those that hold now; state is what an earlier call, or `folded_state`, returned.  Only components that held a
    changed row, or that a pair joins to one, are taken apart and folded again; all other rows of the state stay as they are.  The
    result equals a fold of all rows.
    """
    changed = changed.select("id").distinct().checkpoint()
    ends = pairs.select("a", "b").union(pairs.select("b", "a"))
    beside = ends.join(changed.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    touched = state.join(changed.union(beside).distinct(), "id", "left_semi").select("component").distinct().checkpoint()
    again = state.join(touched, "component", "left_semi").select("id").union(changed).distinct().checkpoint()
    inside = pairs.join(again.withColumnRenamed("id", "a"), "a", "left_semi").join(again.withColumnRenamed("id", "b"), "b", "left_semi")
    new = folded_state(rows.join(again, "id", "left_semi"), inside, existing_wins, in_task)
    return state.join(again, "id", "left_anti").select("id", "component", "duplicate_of_id").unionByName(new)


def folded_state(rows: DataFrame, pairs: DataFrame, existing_wins: bool = False, in_task: int = IN_TASK) -> DataFrame:
    """id, component (its least id; of a row without pairs its own) and duplicate_of_id of every row."""
    held = pairs.join(rows.select(F.col("id").alias("a")), "a", "left_semi").join(rows.select(F.col("id").alias("b")), "b", "left_semi").checkpoint()
    points = greedy_duplicates(rows, held, existing_wins, in_task)
    named = components(held.where("a <> b"))
    return points.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "duplicate_of_id").checkpoint()
