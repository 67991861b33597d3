"""Overlapping communities of a graph, with only the few communities of a node that are not zero.

The affiliation graph model (Yang and Leskovec, WSDM 2013) makes two users friends with probability
``1 - exp(-f_u . f_v - e)``, ``e`` being chance. Expectation maximisation multiplies each strength ``f_uc`` by
``g_uc / F_c``: ``g_uc`` sums ``f_vc / (1 - exp(-f_u . f_v - e))`` over the friends ``v``, and ``F_c`` is the total of a
community. A strength that is zero stays zero under this rule, so a community enters a node where the
likelihood rises with it (``g_uc > F_c``); strengths below a bound leave. What a round shuffles grows with the
strengths that are not zero, whatever the number of communities.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from revloom.operators.communities import undirected
from revloom.operators.skew import SALT, SALTS, skew_join
from revloom.session import ROWS_PER_PART, deal, fits_workers, parts_of, pin, unpin

LEAST = 1e-3  # smaller strengths are dropped
CHANCE = 0.01  # share of the graph's density that is put down to chance; much more hides communities of few links
ENTRY = 0.05  # strength a community enters a node with
LIKELIHOOD = -1  # in place of a community: a link's share of the log-likelihood
NODES = "id bigint, f map<int, double>"
NODE_NUMBERS = 6  # what a node without strengths takes where it is sent to the edges, in numbers of 16 bytes


def _both_ends(
    edges: DataFrame, nodes: DataFrame, value: str, hot: DataFrame | None = None, parts: int | None = None,
    fits: bool = False, keep_salt: bool = False,
) -> DataFrame:
    """Edges with the ``value`` of their ends: ``far`` for ``dst``, ``near`` for ``src``. Nodes that fit come to the edges."""
    far = nodes.select(F.col("id").alias("dst"), F.col(value).alias("far"))
    near = nodes.select(F.col("id").alias("src"), F.col(value).alias("near"))
    if fits:
        return edges.join(F.broadcast(far), "dst").join(F.broadcast(near), "src")
    named = lambda end: None if hot is None else hot.withColumnRenamed("id", end)
    both = skew_join(edges, far, ["dst"], named("dst"), salt_on=["src"], parts=parts)
    return skew_join(both, near, ["src"], named("src"), salt_on=["dst"], parts=parts, keep_salt=keep_salt)


def _seeds(
    edges: DataFrame, degrees: DataFrame, c: int, hot: DataFrame | None = None, parts: int | None = None, fits: bool = False
) -> list[int]:
    """``c`` nodes to start from: those with more friends than any friend of theirs, then the largest ones."""
    # Of nodes with as many friends the smaller id is the larger node. Flags are hashed where structs would be sorted.
    larger = (F.col("far") > F.col("near")) | ((F.col("far") == F.col("near")) & (F.col("dst") < F.col("src")))
    both = _both_ends(edges, degrees, "n", hot, parts, fits).select(F.col("src").alias("id"), F.col("near").alias("n"), larger.alias("larger"))
    ranked = both.groupBy("id").agg(F.max("n").alias("n"), (~F.max("larger")).alias("is_top"))
    return [r["id"] for r in ranked.orderBy(F.desc("is_top"), F.desc("n"), "id").limit(c).collect()]


def _start(edges: DataFrame, degrees: DataFrame, seeds: list[int]) -> DataFrame:
    """Strength 1 of each seed's community for the seed and its friends, slightly different from node to node."""
    place = {s: i for i, s in enumerate(seeds)}
    number = F.create_map(*[x for s, i in place.items() for x in (F.lit(s).cast("bigint"), F.lit(i))])
    own = degrees.where(F.col("id").isin(seeds)).select("id", number[F.col("id")].alias("c"))
    near = edges.where(F.col("dst").isin(seeds)).select(F.col("src").alias("id"), number[F.col("dst")].alias("c"))
    noise = 1 + F.pmod(F.xxhash64("id", "c"), F.lit(1000)) / F.lit(10_000.0)
    found = own.unionByName(near).distinct().select("id", F.struct("c", noise.alias("v")).alias("e"))
    found = found.groupBy("id").agg(F.map_from_entries(F.collect_list("e")).alias("f"))
    none = F.expr("cast(map() as map<int, double>)")
    return degrees.select("id").join(found, "id", "left").select("id", F.coalesce("f", none).alias("f"))


def _pulls(
    edges: DataFrame, nodes: DataFrame, chance: float, hot: DataFrame | None = None, parts: int | None = None, fits: bool = False
) -> DataFrame:
    """``(id, c, g)``: what friends pull a node to each of their communities with, and its links' likelihood.

    In ``parts`` parts a node's sums are made where its edges lie; those of a node on several salts are added up.
    """
    salted = bool(parts) and hot is not None and not fits
    both = _both_ends(edges, nodes, "f", hot, parts, fits, keep_salt=salted)
    shared = F.aggregate(
        F.map_entries("near"), F.lit(chance), lambda q, e: q + e["value"] * F.coalesce(F.try_element_at("far", e["key"]), F.lit(0.0))
    )
    salt = [SALT] if salted else []
    both = both.select("src", *salt, "far", shared.alias("q"))
    certain = -F.expm1(-F.col("q"))  # exact for small affinities
    pulls = F.transform(
        F.map_entries("far"), lambda e: F.struct(e["key"].alias("c"), (e["value"] / certain).alias("g"))
    )
    share = F.struct(F.lit(LIKELIHOOD).alias("c"), (F.log(certain) + F.col("q")).alias("g"))
    links = both.select(F.col("src").alias("id"), *salt, F.explode(F.concat(pulls, F.array(share))).alias("e"))
    sums = links.groupBy("id", *salt, "e.c").agg(F.sum("e.g").alias("g"))
    return deal(sums, parts, "id").groupBy("id", "c").agg(F.sum("g").alias("g")) if salted else sums


def _totals(rows: DataFrame, value: str) -> dict[int, float]:
    """Sum per community; one row a community."""
    return {r["c"]: r["v"] for r in rows.where(F.col("c") != LIKELIHOOD).groupBy("c").agg(F.sum(value).alias("v")).collect()}


def fit_affiliations(
    edges: DataFrame, c: int, tolerance: float = 1e-3, max_rounds: int = 50, rows_per_task: int = 1_000_000,
    links_per_part: int = ROWS_PER_PART,
) -> tuple[DataFrame, float, list[float]]:
    """Strengths ``(id, c, strength)`` that are not zero, the density, and the log-likelihood before each round.

    Rounds end when the log-likelihood rises by less than ``tolerance`` of its size. Each is written to the shared
    folder and its predecessor deleted; nodes with more than ``rows_per_task`` friends are salted in both joins.
    Loops and null ends are left out; a graph without edges is an error. Many links are dealt to parts of about
    ``links_per_part``, a node's links to one part, so that what a task sorts or sums does not grow with the graph.
    """
    spark = edges.sparkSession
    links = pin(edges.select("src", "dst").na.drop())
    parts = parts_of(spark, 2 * links.count(), links_per_part)
    edges = undirected(links, parts).select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    edges = pin(deal(edges, parts, "src"))
    unpin(spark, links)
    degrees = pin(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    size = degrees.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("ends")).first()
    if not size["nodes"]:
        raise ValueError("the graph has no edges")
    density = min(size["ends"] / (size["nodes"] * (size["nodes"] - 1)), 0.999)
    chance = -CHANCE * math.log(1 - density)
    hot = degrees.where(F.col("n") > rows_per_task).select("id", F.ceil(F.col("n") / rows_per_task).cast("bigint").alias(SALTS))
    hot = None if hot.isEmpty() else hot
    fits = lambda strengths: bool(parts) and fits_workers(spark, NODE_NUMBERS * size["nodes"] + strengths, 16)
    nodes = pin(_start(edges, degrees, _seeds(edges, degrees, c, hot, parts, fits(0))))
    held = nodes.select("id", F.explode("f").alias("c", "v"))
    totals, history = _totals(held, "v"), []
    while True:
        pulls = pin(_pulls(edges, nodes, chance, hot, parts, fits(held.count() if parts else 0)))
        explained = pulls.where(F.col("c") == LIKELIHOOD).agg(F.sum("g")).first()[0]
        history.append(explained - sum(v * v for v in totals.values()))
        gained = history[-1] - history[-2] if len(history) > 1 else math.inf
        if gained < tolerance * abs(history[-1]) or len(history) > max_rounds:
            unpin(spark, pulls)
            break
        # A total per community, as rows: Spark sees how small it is.
        whole = spark.createDataFrame(sorted(totals.items()), "c int, whole double")
        moved = deal(pulls, parts, "id").join(deal(held, parts, "id"), ["id", "c"], "left").join(whole, "c", "left").select(
            "id", "c", (F.col("v") * F.col("g")).alias("vg"), (F.col("v").isNull() & (F.col("g") > F.col("whole"))).alias("enters")
        )
        moved = pin(moved)
        squares = _totals(moved, "vg")
        root = spark.createDataFrame([(k, math.sqrt(v)) for k, v in sorted(squares.items()) if v], "c int, root double")
        value = F.when(F.col("enters"), F.lit(ENTRY)).otherwise(F.col("vg") / F.col("root"))
        entry = F.when(value >= LEAST, F.struct("c", value.alias("v")))
        new = deal(moved, parts, "id").join(root, "c", "left").groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("f"))
        last, nodes = nodes, pin(new)
        held = nodes.select("id", F.explode("f").alias("c", "v"))
        totals = _totals(held, "v")
        unpin(spark, last, pulls, moved)
    return held.select("id", "c", F.col("v").alias("strength")), density, history


def members(strengths: DataFrame, density: float) -> DataFrame:
    """``(community_id, user_id)``: who is so strong in a community that a link of two such is likelier than ``density``."""
    found = strengths.where(F.col("strength") >= math.sqrt(-math.log(1.0 - density)))
    return found.select((F.col("c") + 1).cast("bigint").alias("community_id"), F.col("id").alias("user_id"))


def detect_communities(edges: DataFrame, c: int, tolerance: float = 1e-3, max_rounds: int = 50, rows_per_task: int = 1_000_000) -> DataFrame:
    """Overlapping communities ``(community_id, user_id)`` of an undirected graph ``(src, dst)``; ids run from 1."""
    strengths, density, _ = fit_affiliations(edges, c, tolerance, max_rounds, rows_per_task)
    return members(strengths, density)
