"""Communities: read from text, attached to reviews, or found in a friendship graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from revloom.functions.vectors import components, divide, hadamard, total, vector_sums
from revloom.operators.ordering import number_rows
from revloom.operators.skew import SALTS, skew_join
from revloom.session import deal, pin, unpin

# The affinity of two neighbours is kept above this, so that dividing by it stays finite.
MIN_AFFINITY = 1e-9


def members(line: Column | str) -> Column:
    """Numbers of a tab-separated line; what is not a number (such as an empty tail) is left out."""
    c = F.col(line) if isinstance(line, str) else line
    # Not through double, which has no room for large numbers and knows "nan".
    parts = F.transform(F.split(c, r"\t\s*"), lambda s: F.trim(s).try_cast("decimal(38,6)").try_cast("bigint"))
    return F.filter(parts, lambda x: x.isNotNull())


def parse_communities(lines: DataFrame, line: str = "value", line_id: str | None = None) -> DataFrame:
    """``(community_id, user_id)`` from one community per line.

    The id is ``line_id`` if the caller has one. Otherwise communities are numbered from 1 in the
    order of a hash of their sorted members: stable under any partitioning of the text.
    """
    lists = lines.select(*([F.col(line_id).alias("community_id")] if line_id else []), members(line).alias("m"))
    if line_id is None:
        lists = lists.where(F.size("m") > 0)
        name = F.md5(F.array_join(F.sort_array("m"), ",").cast("binary"))
        lists = number_rows(lists.withColumn("__name", name), [F.asc("__name")], "community_id", start=1)
    # Outer, as the plain form would make Spark parse each line again to test its size.
    long = lists.select("community_id", F.explode_outer("m").alias("user_id"))
    return long.where(F.col("user_id").isNotNull()).distinct()


def community_arrays(membership: DataFrame) -> DataFrame:
    """``(user_id, community_id_arr)``; an array is no longer than the number of communities."""
    return membership.groupBy("user_id").agg(
        F.sort_array(F.collect_set("community_id")).alias("community_id_arr")
    )


def attach_communities(
    reviews: DataFrame, membership: DataFrame, as_array: bool = False, hot_users: DataFrame | None = None
) -> DataFrame:
    """Reviews of users in a community: one row per review and community, or an array per review.

    Users with very many reviews may be named as hot keys (``skew.hot_keys``).
    """
    side = community_arrays(membership) if as_array else membership.select("user_id", "community_id")
    return skew_join(reviews, side, ["user_id"], hot_users)


def undirected(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Both directions of every edge once, without loops; pairs are compared in so many parts, if a number is given."""
    whole = edges.select("src", "dst").na.drop().where(F.col("src") != F.col("dst"))
    # A pair is compared once, the smaller end first, and turned round afterwards.
    pairs = deal(whole.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), parts, "a", "b").distinct()
    ways = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ab", "ba")])
    return pairs.select(F.inline(ways))


def _start(edges: DataFrame, degrees: DataFrame, seeds: list[int]) -> DataFrame:
    """Node ``(id, f)``: 1 for the communities seeded at the node or a neighbour, plus small noise."""
    seeded = {s: j for j, s in enumerate(seeds)}
    near = edges.where(F.col("dst").isin(seeds)).groupBy(F.col("src").alias("id")).agg(
        *[F.max(F.when(F.col("dst") == s, 1.0).otherwise(0.0)).alias(f"__n{j}") for s, j in seeded.items()]
    )
    noise = [F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / F.lit(10_000.0) for j in range(len(seeds))]
    value = [
        F.when(F.col("id") == s, 1.0).otherwise(F.coalesce(F.col(f"__n{j}"), F.lit(0.0))) + noise[j]
        for s, j in seeded.items()
    ]
    return degrees.select("id").join(near, "id", "left").select("id", F.array(*value).alias("f"))


def _expected_links(edges: DataFrame, nodes: DataFrame, c: int, hot: DataFrame) -> DataFrame:
    """``(id, f)``: for every node and community the expected number of links it explains.

    A link u-v counts ``f_u * f_v / (1 - exp(-f_u . f_v))`` for each community.
    """
    far = nodes.select(F.col("id").alias("dst"), F.col("f").alias("__fv"))
    near = nodes.select(F.col("id").alias("src"), F.col("f").alias("__fu"))
    both = skew_join(edges, far, ["dst"], hot.withColumnRenamed("id", "dst"), salt_on=["src"])
    both = skew_join(both, near, ["src"], hot.withColumnRenamed("id", "src"), salt_on=["dst"]).withColumn("__m", hadamard("__fu", "__fv"))
    affinity = F.greatest(total("__m"), F.lit(MIN_AFFINITY))
    # expm1 keeps the small affinities exact.
    links = both.select(F.col("src").alias("id"), divide("__m", -F.expm1(-affinity)).alias("f"))
    return vector_sums(links, ["id"], "f", c).select("id", "f")


def affiliations(
    edges: DataFrame, c: int, rounds: int = 20, rows_per_task: int = 1_000_000
) -> tuple[DataFrame, float]:
    """Affiliation strengths ``(id, f)`` of every node and the edge density.

    The affiliation graph model makes two users friends with probability
    ``1 - exp(-f_u . f_v)`` (Yang and Leskovec, WSDM 2013). It is fitted by expectation
    maximisation (as Ball, Karrer and Newman, Phys. Rev. E 2011, do for link counts), which needs
    no step size. Seeds are the ``c`` nodes with most friends. Nodes with more than
    ``rows_per_task`` friends are the hot keys of both joins of a round. Every round is written to
    the shared folder and its predecessor deleted.
    """
    edges = pin(undirected(edges))
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    degrees = pin(degrees)
    seeds = [r["id"] for r in degrees.orderBy(F.desc("n"), "id").limit(c).collect()]
    if not seeds:
        raise ValueError("the graph has no edges")
    c = len(seeds)
    hot = degrees.where(F.col("n") > rows_per_task)
    hot = hot.select("id", F.ceil(F.col("n") / rows_per_task).cast("bigint").alias(SALTS))
    size = degrees.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("ends")).first()
    density = size["ends"] / (size["nodes"] * (size["nodes"] - 1))
    nodes = pin(_start(edges, degrees, seeds))
    spark, links = edges.sparkSession, None
    for _ in range(rounds):
        last, links = links, pin(_expected_links(edges, nodes, c, hot))
        if last is not None:
            unpin(spark, last)
        sums = links.agg(*[F.sum(x) for x in components("f", c)]).first()
        weight = F.array(*[F.lit(1.0 / math.sqrt(s) if s else 0.0) for s in sums])
        nodes = links.select("id", hadamard("f", weight).alias("f"))
    return nodes, density


def detect_communities(
    edges: DataFrame, c: int, rounds: int = 20, rows_per_task: int = 1_000_000
) -> DataFrame:
    """Overlapping communities ``(community_id, user_id)`` of an undirected graph ``(src, dst)``.

    ``community_id`` runs from 1. A user belongs to a community when an edge between two such
    members would be likelier than the density of the graph.
    """
    nodes, density = affiliations(edges, c, rounds, rows_per_task)
    threshold = math.sqrt(-math.log(1.0 - min(density, 0.999)))
    return (
        nodes.select("id", F.posexplode("f"))
        .where(F.col("col") >= threshold)
        .select((F.col("pos") + 1).cast("bigint").alias("community_id"), F.col("id").alias("user_id"))
    )
