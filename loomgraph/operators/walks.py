"""Rarity-started, chunk-crossing random walks over the knowledge graph.

Randomness is a hash of (seed, candidate, attempt, hop, node), so walks are the same
in any partitioning. A weighted choice is an exponential race: the neighbour with
the least -ln(u) / score wins, with a probability in proportion to its score, and
finding it is a plain aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import hashed_uniform
from loomgraph.operators.graph import degrees
from loomgraph.sources.scratch import Scratch

#: Start weights are summed as whole multiples of 2^-32, so sums are exact; hash
#: ranges of names, at most 4,096, keep running sums out of a single task.
UNIT, PREFIX = 4294967296, 3
#: Walks under way that are sent to the neighbours, instead of dealing both anew.
FEW = 200_000
#: Walks whose attempts and rounds go at once: for these, reading the neighbours costs
#: more than walking.
ONCE = 5_000


@dataclass(frozen=True)
class WalkConfig:
    num_walks: int = 10_000
    min_hops: int = 3
    max_hops: int = 5
    min_chunks_crossed: int = 2
    cross_chunk_alpha: float = 3.0
    max_retries: int = 10
    seed: int = 42
    rare_start: bool = True
    rare_frequency_threshold: int = 2
    #: Candidates drawn in a round for each walk wanted, and rounds at most.
    surplus: float = 1.5
    max_rounds: int = 8


def start_weights(nodes: DataFrame, edges: DataFrame, cfg: WalkConfig) -> DataFrame:
    """name, degree, frequency, weight. Rare starts weigh 1 / (frequency * degree);
    if no node is rare, and without rare starts, the degree counts."""
    rows = degrees(nodes, edges, "frequency").drop("node_ord")
    rare = F.when((F.col("degree") > 0) & (F.col("frequency") <= cfg.rare_frequency_threshold), 1.0 / F.nullif(F.col("frequency") * F.col("degree"), F.lit(0)))
    rare = F.coalesce(rare, F.lit(0.0))
    degree = F.col("degree").cast("double")
    if not cfg.rare_start:
        return rows.withColumn("weight", degree)
    rows = Scratch(nodes.sparkSession, "weights").table(rows, "degrees")  # read twice
    any_rare = rows.agg((F.coalesce(F.sum(rare), F.lit(0.0)) > 0).alias("any"))
    return rows.join(F.broadcast(any_rare), F.lit(True)).withColumn("weight", F.when(F.col("any"), rare).otherwise(degree)).drop("any")


def eligible(weights: DataFrame) -> DataFrame:
    """nodes, eligible: how many nodes there are, and how many a walk may start at."""
    return weights.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("weight") > 0).alias("eligible"))


def cumulative(weights: DataFrame) -> DataFrame:
    """part, name, low, high (whole units): each eligible node's interval."""
    rows = weights.withColumn("units", F.floor(F.col("weight") * UNIT).cast("decimal(38,0)")).where("units > 0")
    rows = rows.withColumn("part", F.substring(F.md5(F.col("name").cast("binary")), 1, PREFIX))
    parts = rows.groupBy("part").agg(F.sum("units").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("decimal(38,0)").alias("base"))
    upto = Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(parts), "part").withColumn("high", F.col("base") + F.sum("units").over(upto))
    return rows.select("part", "name", (F.col("high") - F.col("units")).cast("double").alias("low"), F.col("high").cast("double").alias("high"))


def draw_starts(candidates: DataFrame, intervals: DataFrame, seed: int) -> DataFrame:
    """cand, start: a node for each candidate, by weight. [0, total) is cut into as many
    even buckets as there are nodes; a node is in all that its interval touches (at most
    twice as many rows as nodes, whatever the weights), a candidate's point in one."""
    whole = intervals.agg(F.max("high").alias("total"), (F.max("high") / F.count(F.lit(1))).alias("width"))
    place = lambda c: F.floor(F.col(c) / F.col("width"))
    points = candidates.join(F.broadcast(whole), F.lit(True)).select("cand", "width", (hashed_uniform(seed, "start", F.col("cand")) * F.col("total")).alias("point"))
    points = points.select("cand", "point", place("point").alias("bucket"))
    held = intervals.join(F.broadcast(whole), F.lit(True)).select("name", "low", "high", F.explode(F.sequence(place("low"), place("high"))).alias("bucket"))
    found = points.join(held, "bucket").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    return found.select("cand", F.col("name").alias("start"))


def primary(c: str) -> Column:
    return F.try_element_at(F.col(c), F.lit(1))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, weight, b_chunk: both directions of every edge but self-loops."""
    there = edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    both = there.unionAll(there.select("b", "a", "weight"))
    return both.join(nodes.select(F.col("name").alias("b"), primary("text_unit_ids").alias("b_chunk")), "b").select("a", "b", "weight", "b_chunk")


def hop(frontier: DataFrame, adj: DataFrame, number: int, cfg: WalkConfig, few: bool = False) -> DataFrame:
    """frontier (cand, attempt, target, path, chunks, live) one step on. A walk stays
    as it is once it has its hops or finds no unvisited neighbour. With `few`, known to
    be at most `FEW`, walks go to the neighbours, which stay where they lie. Walks as
    they are meet their moves in the one aggregation that finds the winners."""
    here = frontier.where(F.col("live") & (F.col("target") >= number))
    here = here.select("cand", "attempt", "path", F.element_at("path", -1).alias("cur"), F.element_at("chunks", -1).alias("chunk")).where("cur is not null")
    moves = (F.broadcast(here) if few else here).join(adj, F.col("cur") == F.col("a")).where(~F.array_contains("path", F.col("b")))
    crosses = (F.coalesce("b_chunk", F.lit("")) != "") & ~F.col("b_chunk").eqNullSafe(F.col("chunk"))
    score = F.col("weight") * F.when(crosses, F.lit(float(cfg.cross_chunk_alpha))).otherwise(F.lit(1.0))
    moves = moves.withColumn("score", score).where("score > 0")
    race = -F.ln(hashed_uniform(cfg.seed, F.col("cand"), F.col("attempt"), number, F.col("b"))) / F.col("score")
    moves = moves.select("cand", "attempt", F.struct(race.alias("race"), "b", "b_chunk").alias("move"))
    asis = frontier.select("cand", "attempt", F.struct("target", "path", "chunks", "live").alias("w"))
    step = asis.unionByName(moves, allowMissingColumns=True).groupBy("cand", "attempt").agg(F.first("w", ignorenulls=True).alias("w"), F.min("move").alias("won"))
    moved = F.col("won").isNotNull()
    return step.select(
        "cand", "attempt", "w.target",
        F.when(moved, F.concat("w.path", F.array("won.b"))).otherwise(F.col("w.path")).alias("path"),
        F.when(moved, F.concat("w.chunks", F.array("won.b_chunk"))).otherwise(F.col("w.chunks")).alias("chunks"),
        (F.col("w.live") & moved).alias("live"),
    )


def crossed() -> Column:
    return F.size(F.array_distinct(F.array_compact("chunks")))


def attempts(starts: DataFrame, nodes: DataFrame, adj: DataFrame, first: int, last: int, cfg: WalkConfig, scratch: Scratch | None = None, name: str = "walk") -> DataFrame:
    """All attempts first..last-1 of each start: cand, attempt, path, chunks, accepted."""
    homes = nodes.select(F.col("name").alias("start"), primary("text_unit_ids").alias("chunk"))
    rows = starts.join(homes, "start").withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    wanted = cfg.min_hops + F.floor(hashed_uniform(cfg.seed, F.col("cand"), F.col("attempt"), "hops") * (cfg.max_hops - cfg.min_hops + 1))
    front = rows.select("cand", "attempt", wanted.cast("int").alias("target"), F.array("start").alias("path"), F.array("chunk").alias("chunks"), F.lit(True).alias("live"))
    few = scratch is not None and starts.count() * (last - first) <= FEW
    for i in range(1, cfg.max_hops + 1):
        front = hop(front, adj, i, cfg, few)
        if scratch and (few or i % 2 == 0) and i < cfg.max_hops:
            front = scratch.table(front, f"{name}-{i}")
    good = (F.size("path") - 1 >= cfg.min_hops) & (crossed() >= cfg.min_chunks_crossed)
    return front.select("cand", "attempt", "path", "chunks", good.alias("accepted"))


def generate(nodes: DataFrame, edges: DataFrame, cfg: WalkConfig) -> DataFrame:
    """Up to num_walks walks: cand, attempt, path, chunks. Of each candidate the first
    attempt that is accepted counts; candidates count in order. An empty graph gives none.

    Each hop reads all neighbours once. So up to `ONCE` walks, all attempts of several
    rounds, go at once; of more, later attempts are walked only for candidates whose
    first failed. Walks do not depend on one another: the result is the same."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "walks")
    adj = scratch.table(adjacency(nodes, edges), "adjacency")
    intervals = scratch.table(cumulative(start_weights(nodes, edges, cfg)), "starts")
    batch, tries = max(1, int(cfg.num_walks * cfg.surplus)), max(1, cfg.max_retries)
    last, once = cfg.max_rounds * batch, ONCE // (batch * tries)
    done, n = None, 0
    for r, low in enumerate(range(0, last, batch * max(1, once))):
        cands = spark.range(low, min(last, low + batch * max(1, once))).select(F.col("id").alias("cand"))
        starts = scratch.table(draw_starts(cands, intervals, cfg.seed), f"drawn-{r}")
        if once:
            kept = _first_accepted(attempts(starts, nodes, adj, 0, tries, cfg, scratch, f"a{r}"))
        else:
            one = scratch.table(attempts(starts, nodes, adj, 0, 1, cfg, scratch, f"a{r}"), f"first-{r}")
            kept = one.where("accepted").drop("accepted")
            if tries > 1:
                failed = scratch.table(starts.join(kept.select("cand"), "cand", "left_anti"), f"failed-{r}")
                kept = kept.unionByName(_first_accepted(attempts(failed, nodes, adj, 1, tries, cfg, scratch, f"b{r}")))
        kept = scratch.table(kept, f"kept-{r}")
        done = kept if done is None else done.unionByName(kept)
        n += kept.count()
        if n >= cfg.num_walks or starts.isEmpty():
            break
    return scratch.table(done.orderBy("cand").limit(cfg.num_walks), "walks").orderBy("cand")


def _first_accepted(tried: DataFrame) -> DataFrame:
    """Of each candidate the first accepted attempt: cand, attempt, path, chunks."""
    best = tried.where("accepted").groupBy("cand").agg(F.min_by(F.struct("attempt", "path", "chunks"), "attempt").alias("w"))
    return best.select("cand", "w.*")


def with_attributes(walks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Walks as records: cand and the walk file's fields. walks should be a table. Few of
    them, counted first, go to nodes and edges, which stay where they lie."""
    few = (walks.agg(F.sum(F.size("path"))).first()[0] or 0) <= FEW
    put = F.broadcast if few else lambda rows: rows
    steps = walks.select("cand", F.posexplode("path").alias("i", "name"), "path")
    names = nodes.select("name", F.coalesce(primary("description"), F.lit("")).alias("d"))
    described = put(steps.select("cand", "i", "name")).join(names, "name").groupBy("cand").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("x")).select("cand", F.transform("x", lambda x: x["d"]).alias("node_descriptions"))
    last = F.get("path", F.col("i") - 1)
    pairs = steps.where("i > 0").select("cand", "i", F.least("name", last).alias("u"), F.greatest("name", last).alias("v"))
    taken = put(pairs).join(edges.select("u", "v", F.struct("weight", "description", "text_unit_ids").alias("e")), ["u", "v"]).groupBy("cand").agg(F.array_sort(F.collect_list(F.struct("i", "e.weight", "e.description", "e.text_unit_ids"))).alias("x"))
    taken = taken.select("cand", F.transform("x", lambda x: F.struct(x["weight"].alias("weight"), x["description"].alias("description"), x["text_unit_ids"].alias("text_unit_ids"))).alias("edges"))
    chunks = F.transform("chunks", lambda c: F.coalesce(c, F.lit("")))
    return walks.select("cand", F.col("path").alias("nodes"), chunks.alias("chunk_ids"), crossed().alias("chunks_crossed")).join(described, "cand").join(taken, "cand")


def summary(walks: DataFrame) -> DataFrame:
    hops = F.size("path") - 1
    return walks.agg(F.count(F.lit(1)).alias("walks"), F.avg(hops).alias("avg_hops"), F.avg(crossed()).alias("avg_chunks"))
