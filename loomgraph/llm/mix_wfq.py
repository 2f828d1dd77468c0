"""Mixing sources to target weights by weighted fair queueing, in DataFrame
operations only.

Within its source each document takes a place by a hash of its id and text (the
shuffle). Its virtual finish time is the words its source has sent up to and including
it, divided by the source's target; a second copy follows one whole source later. All
copies are ordered by finish time and cut where the words reach the budget.

Rows with the same source, id and text are one item with a count from the start, so
a group of copies of any size is one row wherever order matters. Running sums never
gather a source in one task: places are cut into ranges, as many as the number of
items asks for, range totals get their prefix sums by ranges again, and only items of
one range meet. The cut is found by halving: totals of `STEPS` parts of an interval of
finish time say in which part the budget is reached, until few enough rows are left
to be ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, Scratch
from loomgraph.operators.scan import prefix_sums

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
COPIES = 2
#: Bits of the shuffle hash; items of a range, about; parts of an interval of finish
#: time, and rows that are ordered in one task.
HASH_BITS, RANGE, STEPS, ONE_BY_ONE = 60, 1024, 4096, 100_000
#: Rows of one item that one task makes.
SPREAD = 1_000_000


def place(seed: int) -> Column:
    """60 bits of an md5 of id and text: the same in any engine and partitioning."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, copies: int = COPIES) -> DataFrame:
    """One row per source: key, source_size, target. The table of sources is a
    catalogue, so its order and its running sums are taken in one task.

    Sources by code point, null last, get the weights in turn; they share `budget`
    times all words, no target above `copies` times its source's words; what is
    above is shared again by weight. With the sources ordered by capacity per
    weight, the common level is the largest of the levels reached one by one.
    """
    per = sizes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", turn)
    before = Window.orderBy(F.col("source_size") * copies / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    spent = F.coalesce(F.sum("source_size").over(before) * copies, F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget)) - spent) / left)
    level = F.max("level").over(every)
    return per.select("key", "source", "source_size", F.least((F.col("source_size") * copies).cast("double"), F.col("weight") * level).alias("target"))


def items(docs: DataFrame, seed: int) -> DataFrame:
    """key, source, doc_id, place, size and rows: how many rows are the same."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(key.alias("key"), "source", "doc_id", place(seed).alias("place"), size.alias("size"))
    return rows.groupBy("key", "source", "doc_id", "place", "size").agg(F.count(F.lit(1)).alias("rows"))


def queued(sizes: DataFrame, plan: DataFrame, copies: int) -> DataFrame:
    """Items with source_size, target and sent: the words of their source before them."""
    n = sizes.count()
    parts = max(1, n // RANGE)
    sizes = sizes.withColumn("part", F.floor(F.col("place") / F.lit(float(2**HASH_BITS / parts))))
    ranges = sizes.groupBy("key", "part").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    ranges = prefix_sums(ranges, ["key", "part"], "words", "upto")
    first = ranges.groupBy("key").agg(F.min("upto").alias("begin"))
    ranges = ranges.join(first, "key").select("key", "part", (F.col("upto") - F.col("begin")).alias("offset"))
    within = Window.partitionBy("key", "part").orderBy("place", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.join(ranges, ["key", "part"]).join(plan.drop("source"), "key")
    sent = F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0))
    return rows.select("key", "source", "doc_id", "place", "size", "rows", "source_size", "target", sent.alias("sent"))


def finish(k: Column | int, copy: int) -> Column:
    """When the first k rows of an item are through, for the copy of that number."""
    return (F.col("sent") + F.col("size") * k + F.col("source_size") * copy) / F.col("target")


def each_row(rows: DataFrame, most: int) -> DataFrame:
    """Items as the rows they stand for, numbered in `k` from 1; most: of one item. An
    item of more than `SPREAD` rows is dealt to several tasks."""
    n = F.col("rows")
    if most > SPREAD:
        rows = rows.withColumn("__at", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / SPREAD)))).repartition("key", "place", "doc_id", "__at")
    else:
        rows = rows.withColumn("__at", F.lit(0))
    first = (F.col("__at") * SPREAD + 1).cast("long")
    return rows.withColumn("k", F.explode(F.sequence(first, F.least(n, first + SPREAD - 1)))).drop("__at")


def cut(rows: DataFrame, budget: float, copies: int, most: int) -> float:
    """The finish time up to which the mix takes rows: that of the last one whose middle
    lies within the budget, in the order of (finish, key, place, doc_id, size)."""
    ends = F.array(*[finish(F.col("k"), i) for i in range(copies)])
    sent = each_row(rows.where("size > 0"), most).select("size", "key", "place", "doc_id", F.explode(ends).alias("finish"))
    part, low, spent = sent, 0.0, 0  # spent: words of rows before those of part
    while True:
        n, low, high = part.agg(F.count(F.lit(1)), F.min("finish"), F.max("finish")).first()
        if n <= ONE_BY_ONE or low == high:  # rows of one source never finish together
            break
        spot = F.least(F.floor((F.col("finish") - low) / ((high - low) / STEPS)), F.lit(STEPS - 1))
        sums = part.groupBy(spot.alias("spot")).agg(F.sum("size").alias("words"), F.min("finish").alias("a"), F.max("finish").alias("b")).orderBy("spot").collect()  # STEPS rows at most
        for r in sums:
            if spent + r["words"] > budget:
                break
            spent += r["words"]
        else:
            return float("inf")
        part = part.where((F.col("finish") >= r["a"]) & (F.col("finish") <= r["b"]))
    if not n:
        return float("inf")
    order = Window.orderBy("finish", "key", "place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    one = part.select("finish", (F.lit(spent) + F.sum("size").over(order) - F.col("size") / 2).alias("middle"))
    last = one.where(F.col("middle") <= budget).agg(F.max("finish")).first()[0]
    # none: the budget ends before the first row of this part
    return last if last is not None else sent.where(F.col("finish") < low).agg(F.max("finish")).first()[0] or 0.0


def taken_items(docs: DataFrame, weights, budget: float, copies: int, seed: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Items with source_size, target and, of their rows in turn, taken0, taken1 ...: how
    many are in the mix at least once, twice ...; and the most rows that an item has."""
    sizes = scratch.table(items(docs, seed), "items")
    plan = scratch.table(targets(sizes, weights, budget, copies), "targets")
    rows = scratch.table(queued(sizes, plan, copies), "queued")
    scratch.drop("items")
    whole = (plan.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    most = rows.agg(F.max("rows")).first()[0] or 0
    last = cut(rows, whole, copies, most)
    for i in range(copies):
        near = (F.lit(last) * F.col("target") - F.col("sent") - F.col("source_size") * i) / F.col("size")
        near = F.floor(F.greatest(F.lit(0.0), F.least(near, F.col("rows").cast("double"))))
        exact = near + F.when(finish(near + 1, i) <= last, 1).otherwise(0) - F.when(finish(near, i) > last, 1).otherwise(0)
        exact = F.least(F.col("rows"), F.greatest(F.lit(0), exact))
        rows = rows.withColumn(f"taken{i}", F.when(F.col("size") > 0, exact).otherwise(0).cast("long"))
    return rows, most


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    taken is size times the copies the mix holds (0 to `copies`). Null texts and
    texts without words have size 0 and are never taken; null sources form one
    source, the last; a very long text is taken whole or not at all; ties of the
    shuffle go by doc_id, then size; rows that are the same in source, id and text
    follow one another. A run with the same seed gives the same rows. Extra columns are
    ignored; an empty table gives no rows.
    """
    rows = each_row(*taken_items(docs, weights, budget, copies, seed, Scratch(docs.sparkSession, "mix")))
    taken = sum((F.when(F.col("k") <= F.col(f"taken{i}"), F.col("size")).otherwise(F.lit(0)) for i in range(copies)), F.lit(0))
    return rows.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """docs as the mix holds them: every row as often as it is taken, with all its
    columns. Texts without words are never taken; null texts, sources and ids are as in
    `mix`. Where the cut goes through rows that are the same in source, id and text (at
    most one such item for each source and copy), all get the number of copies that all
    have, and one of them the rest."""
    rows = taken_items(docs, weights, budget, copies, seed, Scratch(docs.sparkSession, "mix"))[0].where("taken0 > 0")
    total = sum((F.col(f"taken{i}") for i in range(copies)), F.lit(0))
    each = F.least(*[F.floor(total / F.col("rows"))], F.lit(copies))
    rows = rows.select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"), F.col("place").alias("__place"), each.cast("int").alias("__each"), (total - each * F.col("rows")).cast("int").alias("__more"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    own = docs.withColumn("__k", key).withColumn("__p", place(seed))
    same = (F.col("__k") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__p") == F.col("__place"))
    both = own.join(rows.hint("merge"), same)
    keep = [both[f"`{c}`"] for c in docs.columns]
    all_of = both.where("__each > 0").select(*keep, F.explode(F.sequence(F.lit(1), F.col("__each"))).alias("__copy")).drop("__copy")
    one = both.where("__more > 0").dropDuplicates(["__k", "__id", "__p"])
    rest = one.select(*[one[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__more"))).alias("__copy")).drop("__copy")
    return all_of.unionByName(rest)
