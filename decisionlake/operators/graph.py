"""Supersession graph: chain ends by pointer doubling, cycles, broken chains.

All iterations take a logarithmic number of rounds in the longest chain; each round joins the still-open
rows with the pointer table and is cut by a reliable checkpoint. Nodes are keyed by (lib, rec_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake import config
from decisionlake.functions import text as tx
from decisionlake.session import cut

MAX_ROUNDS = 64


ROWS = 250_000                            # of a shuffled table a task


def _tasks(records: DataFrame) -> int:
    """Tasks for a shuffle of rows taken from ``records``, so that one holds the same share whatever the number of records."""
    spark = records.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // ROWS))


def _named_edges(records: DataFrame, n: int) -> DataFrame:
    """The edges of :func:`supersede_edges`, once for each record that says so.

    One end is the record that names the other, so only the named end is looked up.
    """
    own = records.where("lib is not null and rec_id is not null")
    by_status = own.select("lib", tx.superseded_by(F.col("status")).alias("named"), F.col("rec_id").alias("own"), F.lit("status").alias("via"))
    by_field = own.select("lib", F.explode(tx.id_refs(F.col("supersedes"))).alias("named"), F.col("rec_id").alias("own"), F.lit("supersedes").alias("via"))
    rows = by_status.where("named is not null").unionByName(by_field).repartition(n, "lib", "named")
    known = own.select("lib", F.col("rec_id").alias("named")).repartition(n, "lib", "named")
    end = lambda status, field: F.when(F.col("via") == "status", F.col(status)).otherwise(F.col(field))
    return rows.join(known, ["lib", "named"], "left_semi").select("lib", end("own", "named").alias("src_id"), end("named", "own").alias("dst_id"), "via")


def supersede_edges(records: DataFrame) -> DataFrame:
    """Edges "src is superseded by dst" from both fields, both ends existing: (lib, src_id, dst_id, via)."""
    n = _tasks(records)
    return _named_edges(records, n).repartition(n, "lib", "src_id", "dst_id").distinct()


def nodes(records: DataFrame) -> DataFrame:
    """One row an id: (lib, rec_id, n, names, field): how many records hold it, the superseder it names, its Supersedes value."""
    return _named(records, F.max(F.coalesce("supersedes", F.lit(""))).alias("field"))


def _named(records: DataFrame, *more: Column) -> DataFrame:
    """The columns of :func:`nodes` that a walk needs; the statuses say where it leads."""
    return records.groupBy("lib", "rec_id").agg(F.count(F.lit(1)).alias("n"), F.min(tx.superseded_by(F.col("status"))).alias("names"), *more)


def _with_next(ids: DataFrame, *more: str) -> DataFrame:
    """:func:`nodes` with what is known of the superseder that each names: next_n and the like of ``more``, NULL where there is none."""
    known = ids.select("lib", F.col("rec_id").alias("names"), *[F.col(c).alias(f"next_{c}") for c in ("n", *more)])
    return ids.select("lib", "rec_id", "names").join(known, ["lib", "names"], "left")


def _next_id():
    return F.when(F.col("next_n") == 1, F.col("names"))


def _pointers(ids: DataFrame) -> DataFrame:
    """One row per record: (lib, rec_id, next_id, terminal) where terminal says why a walk stops here."""
    return _with_next(ids).select("lib", "rec_id", _next_id().alias("next_id"),
                                  F.when(F.col("names").isNull(), "live").when(F.col("next_n").isNull(), "missing")
                                  .when(F.col("next_n") > 1, "ambiguous").alias("terminal"))


def _double(state: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Runs (lib, rec_id, ptr, hops, open) to closed pointers.

    Returns the closed rows and, when rows are left that run into a cycle, those rows (their ``ptr`` is a
    cycle node and every cycle node is the ``ptr`` of some row).
    """
    state = cut(state)
    closed = state.where("not open")
    active = state.where("open")
    last = images = None
    for _ in range(MAX_ROUNDS):
        n = active.count()
        if n == 0:
            return closed, None
        if n == last:                                       # nothing was closed: only now can all that is left loop
            now = active.agg(F.count_distinct("lib", "ptr")).first()[0]
            if now == images:
                return closed, active
            images = now
        else:
            last, images = n, None
        jump = closed.unionByName(active).select(
            "lib", F.col("rec_id").alias("ptr"), F.col("ptr").alias("ptr2"),
            F.col("hops").alias("hops2"), F.col("open").alias("open2"))
        step = active
        for _ in range(3):        # three hops of the same length: the reach grows fourfold per round
            step = step.join(jump, ["lib", "ptr"]).select(
                "lib", "rec_id", F.when(F.col("open"), F.col("ptr2")).otherwise(F.col("ptr")).alias("ptr"),
                (F.col("hops") + F.when(F.col("open"), F.col("hops2")).otherwise(0)).alias("hops"),
                (F.col("open") & F.col("open2")).alias("open"))
        step = cut(step)
        closed = closed.unionByName(step.where("not open"))
        active = step.where("open")
    raise RuntimeError("supersession chains did not converge")


def _cycle_labels(ring: DataFrame) -> DataFrame:
    """(lib, rec_id, next_id) of cycle nodes only -> (lib, rec_id, cycle_id, cycle_len)."""
    state = cut(ring.select("lib", "rec_id", F.col("next_id").alias("ptr"), F.col("rec_id").alias("low"),
                            F.lit(True).alias("moved")))
    for _ in range(MAX_ROUNDS):
        other = state.select("lib", F.col("rec_id").alias("ptr"), F.col("ptr").alias("ptr2"),
                             F.col("low").alias("low2"))
        step = state.withColumn("moved", F.lit(False))
        for _ in range(3):
            step = step.join(other, ["lib", "ptr"]).select(
                "lib", "rec_id", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"),
                (F.col("moved") | (F.col("low2") < F.col("low"))).alias("moved"))
        state = cut(step)
        if state.where("moved").isEmpty():
            sizes = state.groupBy("lib", "low").agg(F.count(F.lit(1)).alias("cycle_len"))
            return state.join(sizes, ["lib", "low"]).select(
                "lib", "rec_id", F.col("low").alias("cycle_id"), "cycle_len")
    raise RuntimeError("cycle labels did not converge")


def _walk_table(pointers: DataFrame) -> DataFrame:
    """(lib, rec_id, endpoint, depth, terminal, cycle_id) for a table (lib, rec_id, next_id, terminal)."""
    pointers = cut(pointers)
    start = pointers.select("lib", "rec_id", F.coalesce("next_id", "rec_id").alias("ptr"),
                            F.when(F.col("next_id").isNotNull(), 1).otherwise(0).cast("bigint").alias("hops"),
                            F.col("next_id").isNotNull().alias("open"))
    # a row whose successor is a chain end is closed after its first hop
    ends = pointers.where(F.col("next_id").isNull()).select("lib", F.col("rec_id").alias("ptr"), F.lit(True).alias("end"))
    start = start.join(ends, ["lib", "ptr"], "left").select(
        "lib", "rec_id", "ptr", "hops", (F.col("open") & F.col("end").isNull()).alias("open"))
    closed, looping = _double(start)
    reasons = pointers.select("lib", F.col("rec_id").alias("ptr"), "terminal")
    out = closed.join(reasons, ["lib", "ptr"]).select(
        "lib", "rec_id", F.col("ptr").alias("endpoint"), F.col("hops").alias("depth"), "terminal",
        F.lit(None).cast("string").alias("cycle_id"))
    if looping is None:
        return out
    # cycle nodes become chain ends of their own; the rows that lead to them are walked again
    loop_next = looping.select("lib", "rec_id").join(pointers, ["lib", "rec_id"]).select("lib", "rec_id", "next_id")
    on_cycle = looping.select("lib", F.col("ptr").alias("rec_id")).distinct()
    rings = cut(_cycle_labels(loop_next.join(on_cycle, ["lib", "rec_id"], "left_semi")))
    flagged = loop_next.join(rings.select("lib", "rec_id", F.lit(True).alias("ring")), ["lib", "rec_id"], "left")
    tails = flagged.select("lib", "rec_id", F.when(F.col("ring").isNull(), F.col("next_id")).alias("next_id"),
                           F.lit("cycle").alias("terminal"))
    entry = _walk_table(tails).drop("cycle_id")
    cyclic = entry.join(rings.select("lib", F.col("rec_id").alias("endpoint"), "cycle_id", "cycle_len"), ["lib", "endpoint"]).select(
        "lib", "rec_id", "endpoint", (F.col("depth") + F.col("cycle_len")).alias("depth"), F.lit("cycle").alias("terminal"), "cycle_id")
    return out.unionByName(cyclic)


def resolve_current(records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Where each record's ``Superseded by`` chain ends: (lib, rec_id, endpoint, depth, terminal).

    ``depth`` is the number of records walked; terminal is live, missing, ambiguous or cycle. On a cycle
    the endpoint is the first record met twice and the walk holds all of the cycle. ``ids`` are the records' :func:`nodes`.
    """
    return _walk_table(_pointers(_named(records) if ids is None else ids)).drop("cycle_id")


def successors(records: DataFrame) -> DataFrame:
    """(lib, at, to): the record each superseded record names, where it is one known record."""
    return cut(_pointers(_named(records)).where(F.col("next_id").isNotNull()).select("lib", F.col("rec_id").alias("at"), F.col("next_id").alias("to")))


def resolve_walk(records: DataFrame, resolved: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The records walked from each record, in order: (lib, rec_id, hop, walked_id).

    The hop-th successor is reached through the binary digits of ``hop``, so the work follows the size of
    the output. ``only`` (lib, rec_id) restricts the origins.
    """
    origins = resolved.where("depth > 0").select("lib", "rec_id", "depth")
    if only is not None:
        origins = origins.join(only.select("lib", "rec_id").distinct(), ["lib", "rec_id"], "left_semi")
    top = origins.agg(F.max("depth")).first()[0] or 0
    rows = origins.select("lib", "rec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("depth") - 1)).alias("hop"))
    rows = rows.withColumn("at", F.col("rec_id"))
    jump = successors(records)
    bit = 1
    while bit < top:
        due = (F.col("hop").bitwiseAND(F.lit(bit))) != 0
        rows = rows.join(jump, ["lib", "at"], "left").select(
            "lib", "rec_id", "hop", F.when(due, F.col("to")).otherwise(F.col("at")).alias("at"))
        jump2 = jump.select("lib", F.col("at").alias("to"), F.col("to").alias("to2"))
        jump = cut(jump.join(jump2, ["lib", "to"]).select("lib", "at", F.col("to2").alias("to")))
        bit *= 2
    return rows.select("lib", "rec_id", "hop", F.col("at").alias("walked_id"))


def immediately_replaced(records: DataFrame, current: DataFrame) -> DataFrame:
    """What each current record replaced: first id of its Supersedes, else the first record (type, path
    order) whose status points to it. (lib, rec_id, replaced_id, replaced_title); no row without one."""
    titles = records.groupBy("lib", "rec_id").agg(F.min("title").alias("replaced_title"))
    cur = current.select("lib", "rec_id").distinct()
    own = (records.join(cur, ["lib", "rec_id"], "left_semi")
           .select("lib", "rec_id", F.get(tx.id_refs(F.col("supersedes"), r"\b([A-Za-z]+)\s+(\d+)\b"), F.lit(0)).alias("own_id")))
    back = (records.select("lib", F.col("rec_id").alias("from_id"), tx.superseded_by(F.col("status")).alias("rec_id"),
                           F.struct(tx.type_rank(F.col("type")), "path").alias("ord"))
            .where(F.col("rec_id").isNotNull() & (F.col("rec_id") != F.col("from_id")))
            .join(cur, ["lib", "rec_id"], "left_semi")
            .groupBy("lib", "rec_id").agg(F.min_by("from_id", "ord").alias("back_id")))
    own = own.join(titles.select("lib", F.col("rec_id").alias("own_id"), F.lit(True).alias("known")), ["lib", "own_id"], "left")
    picked = own.join(back, ["lib", "rec_id"], "left").select(
        "lib", "rec_id", F.coalesce(F.when(F.col("known"), F.col("own_id")), F.col("back_id")).alias("replaced_id"))
    return picked.join(titles.withColumnRenamed("rec_id", "replaced_id"), ["lib", "replaced_id"]).select(
        "lib", "rec_id", "replaced_id", "replaced_title").distinct()


def validation_edges(records: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Edges as validation reads them: upper-case labels, and targets need not exist."""
    pattern = tx.strict_ref(labels or config.LABELS)
    by_status = (records.where(F.lower("status").contains("supersed"))
                 .select("lib", F.col("rec_id").alias("src_id"), F.explode(tx.id_refs(F.col("status"), pattern)).alias("dst_id")))
    by_field = records.select("lib", F.explode(tx.id_refs(F.col("supersedes"), pattern)).alias("src_id"),
                              F.col("rec_id").alias("dst_id"))
    return by_status.unionByName(by_field).distinct()


def supersede_cycles(edges: DataFrame) -> DataFrame:
    """Every record on a cycle of a general edge set (lib, src_id, dst_id): (lib, rec_id, cycle_id), one id a component.

    Runs of records with one way out are walked by doubling and contracted to edges between forks. Dead ends go with them, so
    forks lose ways and become runs themselves: the contraction is repeated on what is left, and on the turned graph
    where it no longer helps, until no fork is left. Only a core in which every record has several ways out and in
    comes to the component iteration.
    """
    return _cycles(cut(edges.select("lib", "src_id", "dst_id").distinct()), turned=False)


def _cycles(edges: DataFrame, turned: bool) -> DataFrame:
    loops = edges.where("src_id = dst_id").select("lib", F.col("src_id").alias("rec_id"), F.col("src_id").alias("cycle_id"))
    edges = edges.where("src_id <> dst_id")
    out_degree = edges.groupBy("lib", "src_id").agg(F.count(F.lit(1)).alias("out"), F.min("dst_id").alias("dst_id"))
    nodes = edges.select("lib", F.col("src_id").alias("rec_id")).unionByName(
        edges.select("lib", F.col("dst_id").alias("rec_id"))).distinct()
    pointers = cut(nodes.join(out_degree.withColumnRenamed("src_id", "rec_id"), ["lib", "rec_id"], "left").select(
        "lib", "rec_id", F.when(F.col("out") == 1, F.col("dst_id")).alias("next_id"),
        F.when(F.col("out").isNull(), "sink").when(F.col("out") > 1, "fork").alias("terminal")))
    walks = cut(_walk_table(pointers))
    # the endpoint of a looping walk is its entry, so every ring node is the endpoint of its own walk
    found = walks.where("terminal = 'cycle' and endpoint = rec_id").select("lib", "rec_id", "cycle_id")
    forks = pointers.where("terminal = 'fork'").select("lib", "rec_id")
    # contracted graph: fork -> the fork its way out leads to
    ways = cut(edges.join(forks.withColumnRenamed("rec_id", "src_id"), ["lib", "src_id"], "left_semi")
               .join(walks.where("terminal = 'fork'").select(
                   "lib", F.col("rec_id").alias("dst_id"), F.col("endpoint").alias("to_id")), ["lib", "dst_id"]))
    joints = cut(ways.select("lib", "src_id", F.col("to_id").alias("dst_id")).distinct())
    left = joints.count()
    if left:
        if left < edges.count():
            comps = _cycles(joints, turned=False)
        elif not turned:
            comps = _cycles(joints.select("lib", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")), turned=True)
        else:
            core = _components(joints.select("lib", F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
            comps = core.withColumnRenamed("comp", "cycle_id") if core is not None else found.limit(0)
        comps = cut(comps)
        inside = (ways.join(comps.select("lib", F.col("rec_id").alias("src_id"), "cycle_id"), ["lib", "src_id"])
                  .join(comps.select("lib", F.col("rec_id").alias("to_id"), F.col("cycle_id").alias("other")), ["lib", "to_id"])
                  .where("cycle_id = other").select("lib", F.col("dst_id").alias("rec_id"), "cycle_id").distinct())
        steps = _unary_steps(pointers, walks, inside.select("lib", "rec_id"))
        on_way = steps.join(inside, ["lib", "rec_id"]).select("lib", F.col("walked_id").alias("rec_id"), "cycle_id")
        found = found.unionByName(on_way).unionByName(comps)
    found = found.groupBy("lib", "rec_id").agg(F.min("cycle_id").alias("cycle_id"))
    return found.unionByName(loops.join(found, ["lib", "rec_id"], "left_anti"))


def _unary_steps(pointers: DataFrame, walks: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes passed from each start up to (not including) its endpoint."""
    origins = walks.where("depth > 0").join(starts.distinct(), ["lib", "rec_id"], "left_semi")
    top = origins.agg(F.max("depth")).first()[0] or 0
    rows = origins.select("lib", "rec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("depth") - 1)).alias("hop"))
    rows = rows.withColumn("at", F.col("rec_id"))
    jump = pointers.where(F.col("next_id").isNotNull()).select("lib", F.col("rec_id").alias("at"), F.col("next_id").alias("to"))
    bit = 1
    while bit < top:
        rows = rows.join(jump, ["lib", "at"], "left").select(
            "lib", "rec_id", "hop",
            F.when(F.col("hop").bitwiseAND(F.lit(bit)) != 0, F.col("to")).otherwise(F.col("at")).alias("at"))
        jump = cut(jump.join(jump.select("lib", F.col("at").alias("to"), F.col("to").alias("to2")), ["lib", "to"]).select(
            "lib", "at", F.col("to2").alias("to")))
        bit *= 2
    return rows.select("lib", "rec_id", F.col("at").alias("walked_id"))


def _components(edges: DataFrame) -> DataFrame | None:
    """Strongly connected components that hold a cycle: (lib, rec_id, comp); None when there is none.

    Trims nodes without a way in or out, then colours forward and collects backward.
    """
    done = None
    edges = cut(edges)
    while True:                                             # every round removes edges or ends
        before = edges.count()
        if before == 0:
            return done
        live = (edges.join(edges.select("lib", F.col("a").alias("b")).distinct(), ["lib", "b"], "left_semi")
                .join(edges.select("lib", F.col("b").alias("a")).distinct(), ["lib", "a"], "left_semi"))
        edges = cut(live.select("lib", "a", "b"))
        after = edges.count()
        if after == 0:
            return done
        if after < before:
            continue
        colour = cut(edges.select("lib", F.col("a").alias("rec_id")).distinct().withColumn("c", F.col("rec_id")))
        while True:                                         # colours only grow
            pushed = (edges.join(colour.withColumnRenamed("rec_id", "a"), ["lib", "a"])
                      .groupBy("lib", F.col("b").alias("rec_id")).agg(F.max("c").alias("p")))
            nxt = cut(colour.join(pushed, ["lib", "rec_id"], "left").select(
                "lib", "rec_id", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.col("p") > F.col("c")).alias("moved")))
            colour = nxt.select("lib", "rec_id", "c")
            if nxt.where("moved").isEmpty():
                break
        back = cut(colour.where("rec_id = c"))
        frontier = back
        while True:                                         # the frontier is new each time
            step = (edges.join(frontier.select("lib", F.col("rec_id").alias("b"), "c"), ["lib", "b"])
                    .select("lib", F.col("a").alias("rec_id"), "c").distinct()
                    .join(colour, ["lib", "rec_id", "c"], "left_semi")
                    .join(back, ["lib", "rec_id"], "left_anti"))
            frontier = cut(step)
            if frontier.isEmpty():
                break
            back = cut(back.unionByName(frontier))
        sizes = back.groupBy("lib", "c").agg(F.count(F.lit(1)).alias("n"))
        own = edges.where("a = b").select("lib", F.col("a").alias("c"), F.lit(True).alias("own")).distinct()
        comps = cut(back.join(sizes, ["lib", "c"]).join(own, ["lib", "c"], "left")
                    .where("n > 1 or own").select("lib", "rec_id", F.col("c").alias("comp")))
        done = comps if done is None else done.unionByName(comps)
        gone = back.select("lib", "rec_id")
        edges = cut(edges.join(gone.withColumnRenamed("rec_id", "a"), ["lib", "a"], "left_anti")
                    .join(gone.withColumnRenamed("rec_id", "b"), ["lib", "b"], "left_anti"))


def _node_reasons(records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Why a walk may not pass this record: (lib, rec_id, ptr, reason), reason NULL when it may; ptr is the next record."""
    ids = cut(nodes(records)) if ids is None else ids
    edges = cut(_named_edges(records, _tasks(records)).groupBy("lib", "src_id", "dst_id").agg(
        F.bool_or(F.col("via") == "status").alias("told"), F.bool_or(F.col("via") == "supersedes").alias("listed")))
    forks = edges.groupBy("lib", F.col("src_id").alias("rec_id")).agg(F.count(F.lit(1)).alias("ways")).where("ways >= 2")
    one_sided = edges.where("told and not listed").select("lib", F.col("src_id").alias("rec_id"), F.col("dst_id").alias("names"), F.lit(True).alias("one_sided"))
    reason = (F.when(F.col("ways") >= 2, F.concat(F.lit("forked: "), F.col("ways").cast("string"), F.lit(" superseders")))
              .when(F.col("names").isNull(), F.lit(None).cast("string"))
              .when(F.col("next_field").isNull(), F.concat(F.lit("names missing superseder "), F.col("names")))
              .when((F.col("next_field") != "") & F.col("one_sided").isNotNull(),
                    F.concat(F.lit("not listed back by "), F.col("names"))))
    return (_with_next(ids, "field").where("lib is not null and rec_id is not null").join(forks, ["lib", "rec_id"], "left")
            .join(one_sided, ["lib", "rec_id", "names"], "left").select("lib", "rec_id", _next_id().alias("ptr"), reason.alias("reason")))


def invalid_chains(records: DataFrame, resolved: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Alias-bearing records whose chain cannot be followed, with the first reason on the walk.

    (lib, rec_id, reason). Forks, missing superseders, contradicted back links and cycles. Walks that have met a reason or their
    end are not joined again. ``ids`` are the records' :func:`nodes`.
    """
    top = resolved.agg(F.max("depth")).first()[0] or 0
    state = cut(_node_reasons(records, ids))
    ended = "reason is not null or ptr is null"
    done, active = state.where(ended), state.where(f"not ({ended})")
    span = 1
    while span <= top and not active.isEmpty():
        other = done.unionByName(active).select("lib", F.col("rec_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("reason").alias("reason2"))
        step = active
        for _ in range(3):
            step = step.join(other, ["lib", "ptr"], "left").select(
                "lib", "rec_id", F.col("ptr2").alias("ptr"), F.coalesce("reason", "reason2").alias("reason"))
        state = cut(step)
        done, active = done.unionByName(state.where(ended)), state.where(f"not ({ended})")
        span *= 4
    bearing = records.where(F.size(tx.parse_aliases(F.col("aliases"))) > 0).select("lib", "rec_id")
    looping = resolved.where("terminal = 'cycle'").select("lib", "rec_id", F.lit("supersede cycle").alias("loop"))
    return (done.unionByName(active).join(looping, ["lib", "rec_id"], "left")
            .select("lib", "rec_id", F.coalesce("reason", "loop").alias("reason")).where(F.col("reason").isNotNull())
            .join(bearing, ["lib", "rec_id"], "left_semi"))


def apply_supersede(records: DataFrame, ops: DataFrame) -> DataFrame:
    """Applies (lib, old_id, new_id): the old status becomes ``Superseded by new``, the new record gets
    ``Supersedes: old``. Self references, unknown ids and records named by several conflicting operations
    are left alone and reported: (lib, rec_id, status, supersedes, change)."""
    ids = records.select("lib", "rec_id").distinct()
    ops = ops.select("lib", "old_id", "new_id").distinct()
    good = (ops.where("old_id <> new_id")
            .join(ids.withColumnRenamed("rec_id", "old_id"), ["lib", "old_id"], "left_semi")
            .join(ids.withColumnRenamed("rec_id", "new_id"), ["lib", "new_id"], "left_semi"))
    as_old = good.groupBy("lib", F.col("old_id").alias("rec_id")).agg(
        F.count(F.lit(1)).alias("olds"), F.min("new_id").alias("by_id"))
    as_new = good.groupBy("lib", F.col("new_id").alias("rec_id")).agg(
        F.count(F.lit(1)).alias("news"), F.min("old_id").alias("of_id"))
    named = records.join(as_old, ["lib", "rec_id"], "left").join(as_new, ["lib", "rec_id"], "left")
    clash = (F.coalesce("olds", F.lit(0)) > 1) | (F.coalesce("news", F.lit(0)) > 1)
    return named.select(
        "lib", "rec_id",
        F.when(~clash & F.col("by_id").isNotNull(), F.concat(F.lit("Superseded by "), F.col("by_id")))
        .otherwise(F.col("status")).alias("status"),
        F.when(~clash & F.col("of_id").isNotNull(), F.col("of_id")).otherwise(F.col("supersedes")).alias("supersedes"),
        F.when(clash, "conflict").when(F.col("by_id").isNotNull(), "superseded")
        .when(F.col("of_id").isNotNull(), "supersedes").otherwise("none").alias("change"))


def rejected_supersede(records: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations that name an unknown record or the same one twice: (lib, old_id, new_id, reason)."""
    ids = records.select("lib", "rec_id").distinct()
    old = ids.select("lib", F.col("rec_id").alias("old_id"), F.lit(True).alias("has_old"))
    new = ids.select("lib", F.col("rec_id").alias("new_id"), F.lit(True).alias("has_new"))
    reason = (F.when(F.col("old_id") == F.col("new_id"), "self reference")
              .when(F.col("has_old").isNull() | F.col("has_new").isNull(), "unknown id"))
    return (ops.select("lib", "old_id", "new_id").distinct().join(old, ["lib", "old_id"], "left")
            .join(new, ["lib", "new_id"], "left").select("lib", "old_id", "new_id", reason.alias("reason"))
            .where("reason is not null"))
