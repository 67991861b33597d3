"""The whole experiment from record files to metrics, one table per stage under a root folder.

Stages read what earlier ones wrote, so each can be rerun alone. Vector width ``k`` and number of
communities ``c`` are partition columns of the tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.ml import Estimator
from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom import sources
from revloom.operators import affiliation, communities, embed, geo, profiles, regression, social, split
from revloom.operators.evaluate import describe
from revloom.operators.reviews import enrich_reviews
from revloom.plans.sweep import sweep


@dataclass(frozen=True)
class Pipeline:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame:
        return sources.read_table(self.spark, self.path(name))

    def users(self, source: str, as_of: date | str, edge_lists: Sequence[int] = (20, 100), multi_line: bool = False) -> None:
        """``users`` ranked by compliments, all known ``friends`` and the edges of active users."""
        # Written once: the index, both sides of the edges and the profile read the users again.
        raw = sources.read_users(self.spark, source, multi_line=multi_line)
        sources.write_table(social.index_users(raw), self.path("users_indexed"))
        indexed = self.table("users_indexed")
        sources.write_table(social.friend_edges(indexed), self.path("friend_edges"))
        edges = self.table("friend_edges")
        sources.write_edges(edges, self.path("friends"))
        ranked = social.rank_users(social.user_profiles(indexed, edges, as_of))
        sources.write_table(ranked, self.path("users"))
        for least in edge_lists:
            active = social.active_friend_edges(self.table("users"), least)
            sources.write_edges(active, self.path(f"friends_gt{least}"))

    def businesses(self, source: str, group: str = "state", max_dist: float = 10.0, multi_line: bool = False) -> None:
        raw = sources.read_businesses(self.spark, source, multi_line=multi_line)
        rows = geo.prepare_business(raw, group, max_dist)
        sources.write_table(rows, self.path("businesses"))

    def reviews(self, source: str, min_user: int = 100, min_business: int = 100, multi_line: bool = False) -> None:
        raw = sources.read_reviews(self.spark, source, multi_line=multi_line)
        rows = enrich_reviews(raw, self.table("users"), self.table("businesses"), min_user, min_business)
        sources.write_table(rows.withColumn("date", F.col("date").try_cast("date")), self.path("reviews"))

    def tokens(self, stop_words: Sequence[str] | None = None) -> None:
        """``tokens``: reviews with ``clean_text`` and ``words``, made once for all widths."""
        sources.write_table(
            embed.tokenise_reviews(self.table("reviews"), stop_words=stop_words), self.path("tokens")
        )

    def vectors(
        self, ks: Sequence[int], min_count: int = 10, partitions: int = embed.PARTITIONS, max_iter: int = 1
    ) -> None:
        """``vectors``: reviews embedded in each width; raise the last three with the corpus (``embed.word2vec``)."""
        tokens = self.table("tokens")
        for k in ks:
            model = embed.fit_word2vec(tokens, embed.word2vec(k, min_count, partitions, max_iter))
            sources.save_model(model, self.path(f"word2vec_k{k}"))
            rows = embed.arrays(model.transform(tokens), "features").drop("text", "clean_text", "words")
            sources.write_table(rows, self.path(f"vectors/k={k}"))

    def review_vectors(self, k: int) -> DataFrame:
        return self.table("vectors").where(F.col("k") == k).drop("k")

    def blends(self, k: int, mode: str = "l2sum") -> None:
        """``blended``: every review with both profiles and their blend."""
        rows = profiles.blend_bucketed_reviews(self.review_vectors(k), mode, k)
        sources.write_table(rows, self.path(f"blended/mode={mode}/k={k}"))

    def communities(self, c: int, lines: str | None = None, min_reviews: int = 100, rounds: int = 50) -> None:
        """``membership``: read from community lines, or found among active users' friendships."""
        if lines is not None:
            member = communities.parse_communities(sources.read_lines(self.spark, lines))
        else:
            edges = social.active_friend_edges(self.table("users"), min_reviews)
            member = affiliation.detect_communities(edges, c, max_rounds=rounds)
        sources.write_table(member, self.path(f"membership/c={c}"))

    def membership(self, c: int) -> DataFrame:
        return self.table("membership").where(F.col("c") == c).drop("c")

    def split_vectors(self, k: int, by: str = "hash") -> DataFrame:
        """Review vectors with ``is_train``: by ``hash``, by ``date``, or by ``user_date``."""
        rows = self.review_vectors(k)
        if by == "hash":
            return split.hash_split(rows, ["review_id"])
        return split.chronological_split(rows, "date", by="user_id" if by == "user_date" else None)

    def experiment(
        self,
        ks: Sequence[int],
        cs: Sequence[int | None],
        models: Mapping[str, Estimator | str],
        mode: str = "l2sum",
        by: str = "hash",
        run_id: str = "run",
        profile_from: str = "all",
        reg_param: float = 0.01,
    ) -> DataFrame:
        """Metrics of all settings, also added to the ``metrics`` log. ``None`` in ``cs`` is the global model.

        Settings of this ``run_id`` that the log already holds are not run again.

        The pair sums of every setting stay in ``predictions`` (partitioned by run, ``k``, ``c`` and
        model; ``c`` is 0 for the global model) and are described in a CSV of ``summaries``.
        ``profile_from="train"`` keeps test reviews out of the profiles.
        """

        def keep(scored: DataFrame, k: int, c: int | None, name: str) -> DataFrame:
            place = f"run_id={run_id}/k={k}/c={c or 0}/model={name}"
            path = self.path(f"predictions/{place}")
            sources.write_table(scored, path)
            scored = sources.read_table(self.spark, path)
            sources.write_summary(describe(scored, ["label", "prediction", "num_of_reviews"]), self.path(f"summaries/{place}"))
            return scored

        return sweep(
            lambda k: self.split_vectors(k, by),
            {c: self.membership(c) if c is not None else None for c in cs},
            ks,
            models,
            mode,
            reg_param,
            run_id,
            profile_from,
            keep,
            self.path("metrics"),
        )

    def save_global(self, k: int, estimator: Estimator, name: str, mode: str = "l2sum", by: str = "hash") -> None:
        """Fit the global model, save it as ``models/{name}_k{k}`` and add its report to ``model_reports``."""
        model = regression.fit(regression.training_rows(self.split_vectors(k, by), mode), estimator, k)
        sources.save_model(getattr(model, "bestModel", model), self.path(f"models/{name}_k{k}"))
        sources.append_metrics(regression.model_report(self.spark, model, f"{name}_k{k}"), self.path("model_reports"))

    def score_global(
        self, k: int, model_class: type[MLReadable], name: str, mode: str = "l2sum", by: str = "hash", profile_from: str = "all"
    ) -> DataFrame:
        """Pair sums of the test reviews by a model that ``save_global`` has saved."""
        model = sources.load_model(model_class, self.path(f"models/{name}_k{k}"))
        return regression.score_pairs(regression.blended_test(self.split_vectors(k, by), mode, k, profile_from), model)

    def save_models(self, k: int, c: int, estimator: Estimator, mode: str = "l2sum") -> list[int]:
        """One saved model and report per community; gives the communities that have one."""
        vectors = self.split_vectors(k)
        _, models = regression.fit_estimator_by_community(vectors, self.membership(c), estimator, k, mode)
        for community, model in models.items():
            sources.save_model(model, self.path(f"models_k{k}_c{c}/{community}"))
            report = regression.model_report(self.spark, model, f"k{k}_c{c}_{community}")
            sources.append_metrics(report, self.path("model_reports"))
        return sorted(models)
