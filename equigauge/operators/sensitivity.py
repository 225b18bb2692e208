"""How much the ranking depends on the weights."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, functions as F

from equigauge.config import Study
from equigauge.operators.ranks import spearman
from equigauge.operators.scale import (
    apply_scale, check_scale, check_weights, fit_scale, weighted_index,
)
from equigauge.session import staged

REFERENCE = "equal"
MIN_SPEARMAN, MIN_OVERLAP = 0.9, 0.8


def scheme_scores(
    current: DataFrame, study: Study, schemes: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """One score column per weight scheme, from a ruler fitted on the given rows alone.

    The normalised components are computed once; a scheme is one more expression.
    """
    ruler = check_scale(fit_scale(current, study), study)
    normed = apply_scale(current, ruler, study)
    return normed.select(
        "entity",
        *[
            weighted_index(check_weights(w, study), study.components).alias(name)
            for name, w in schemes.items()
        ],
    )


def weight_sensitivity(
    ranked: DataFrame,
    study: Study,
    top: int = 100,
    schemes: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """Per scheme: Spearman and top-list overlap with equal weights, current period only."""
    schemes = dict(study.schemes if schemes is None else schemes)
    current = ranked.filter(F.col("period") == study.current.label)
    scores = staged(scheme_scores(current, study, schemes), "scheme-scores")
    pairs = scores.select(
        "entity",
        F.col(REFERENCE).alias("reference"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("scheme"), F.col(s).alias("score"))
                    for s in schemes
                ]
            )
        ),
    )
    agreement = spearman(pairs, ["scheme"], "reference", "score")
    overlap = _top_overlap(scores, list(schemes), top)
    share = F.col("overlap") / F.lit(float(top))
    return agreement.join(overlap, "scheme").select(
        "scheme",
        "n",
        "spearman",
        "overlap",
        ((F.col("spearman") > MIN_SPEARMAN) & (share > MIN_OVERLAP)).alias("stable"),
    )


def top_entities(scores: DataFrame, score: str, top: int) -> DataFrame:
    """Highest scores; ties go to the smaller entity code."""
    return scores.orderBy(F.desc_nulls_last(score), F.asc("entity")).limit(top)


def _top_overlap(scores: DataFrame, schemes: list[str], top: int) -> DataFrame:
    """Size of the intersection of each scheme's top list with the reference's."""
    reference = top_entities(scores.select("entity", REFERENCE), REFERENCE, top).select("entity")
    lists = None
    for scheme in schemes:
        one = top_entities(scores.select("entity", F.col(scheme)), scheme, top).select(
            F.lit(scheme).alias("scheme"), "entity"
        )
        lists = one if lists is None else lists.unionByName(one)
    # The reference list holds at most ``top`` rows, whatever the data.
    marked = lists.join(
        F.broadcast(reference.withColumn("_in_reference", F.lit(True))), "entity", "left"
    )
    return marked.groupBy("scheme").agg(F.count_if("_in_reference").alias("overlap"))


def shared_top(a: DataFrame, b: DataFrame, score: str, top: int) -> DataFrame:
    """Number of entities in both top lists."""
    keys = lambda df: top_entities(df.select("entity", score), score, top).select("entity")
    return keys(a).intersect(keys(b)).agg(F.count("*").alias("shared"))
