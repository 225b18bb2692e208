"""Which entities have enough events to be ranked, and why the others do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equigauge.config import Study
from equigauge.session import staged


def volume_flag(df: DataFrame, cut: int) -> DataFrame:
    """Row-level flag; knows nothing of periods."""
    return df.withColumn("ranked", F.col("cases") >= cut)


def rank_eligibility(stacked: DataFrame, totals: DataFrame, study: Study) -> DataFrame:
    """Two rules: enough cases over all years, and enough in each comparison period.

    ``totals`` is (entity, total_cases). The intermediate flags stay, so exclusions can be told
    apart. An entity absent from a period fails. A period absent from the whole frame, or an
    entity without a total, raises when the flags are read.
    """
    base, current = study.periods
    present = stacked.agg(
        F.coalesce(
            F.bool_or(F.col("period") == base.label) & F.bool_or(F.col("period") == current.label),
            F.lit(False),
        ).alias("both")
    ).scalar()
    per_period = stacked.groupBy("entity").agg(
        *[
            F.sum(F.when(F.col("period") == p.label, F.col("cases"))).alias(f"_n{i}")
            for i, p in enumerate((base, current))
        ]
    )
    enough = F.when(
        ~present, F.raise_error(F.lit("a period is absent from the frame")).cast("boolean")
    ).otherwise(
        F.coalesce(
            (F.col("_n0") >= study.min_period) & (F.col("_n1") >= study.min_period), F.lit(False)
        )
    )
    flags = (
        per_period.join(totals.select("entity", "total_cases"), "entity", "left")
        .select(
            "entity",
            "total_cases",
            F.when(
                F.col("total_cases").isNull(),
                F.raise_error(F.concat(F.lit("entity without a total: "), F.col("entity"))).cast("boolean"),
            )
            .otherwise(F.col("total_cases") >= study.min_total)
            .alias("passed_total"),
            enough.alias("passed_period"),
        )
        .withColumn("ranked", F.col("passed_total") & F.col("passed_period"))
    )
    return stacked.join(flags, "entity")


def rank_by_events(events: DataFrame, study: Study) -> DataFrame:
    """`rank_eligibility` straight from (entity, year, cases): one pass over the events.

    Totals and periods come from one aggregation by entity, written once, because whether a period
    is there at all is asked of the same few rows. Entities without a case in either period have
    no row.
    """
    periods = study.periods
    sums = staged(
        events.groupBy("entity").agg(
            F.sum("cases").cast("long").alias("total_cases"),
            *[
                F.sum(F.when(F.col("year").isin(*p.years), F.col("cases"))).cast("long").alias(f"_n{i}")
                for i, p in enumerate(periods)
            ],
        ),
        "entity-cases",
    )
    counts = [F.col(f"_n{i}") for i in range(len(periods))]
    seen = sums.agg(*[F.count(c).alias(f"s{i}") for i, c in enumerate(counts)])
    present = seen.select(F.least(*[F.col(c) for c in seen.columns]) > 0).scalar()
    enough = F.lit(True)
    for count in counts:
        enough = enough & F.coalesce(count >= study.min_period, F.lit(False))
    flags = sums.withColumns(
        {
            "passed_total": F.col("total_cases") >= study.min_total,
            "passed_period": F.when(present, enough).otherwise(
                F.raise_error(F.lit("a period is absent from the frame")).cast("boolean")
            ),
        }
    ).withColumn("ranked", F.col("passed_total") & F.col("passed_period"))
    rows = F.array(
        *[
            F.struct(F.lit(p.label).alias("period"), count.alias("cases"))
            for p, count in zip(periods, counts, strict=True)
        ]
    )
    flat = flags.select(
        "entity", F.inline(rows), "total_cases", "passed_total", "passed_period", "ranked"
    )
    return flat.filter(F.col("cases").isNotNull())


# Funnel outcomes, in the order the rules are tried.
BELOW_TOTAL, BELOW_PERIOD, INCOMPLETE, RANKED = (
    "below_total", "below_period", "incomplete", "ranked",
)


def exclusion_reason():
    """First failing rule of an entity-level row."""
    return (
        F.when(~F.coalesce(F.col("passed_total"), F.lit(False)), F.lit(BELOW_TOTAL))
        .when(~F.coalesce(F.col("passed_period"), F.lit(False)), F.lit(BELOW_PERIOD))
        .when(F.col("n_periods") < 2, F.lit(INCOMPLETE))
        .otherwise(F.lit(RANKED))
    )


def exclusion_funnel(flagged: DataFrame) -> DataFrame:
    """Entities per outcome, zero outcomes included. One pass; the parts sum to the total."""
    entities = flagged.groupBy("entity").agg(
        F.bool_and("passed_total").alias("passed_total"),
        F.bool_and("passed_period").alias("passed_period"),
        F.countDistinct("period").alias("n_periods"),
    )
    outcomes = (BELOW_TOTAL, BELOW_PERIOD, INCOMPLETE, RANKED)
    reason = exclusion_reason()
    counted = entities.select(reason.alias("reason")).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("reason") == o).alias(o) for o in outcomes],
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("step"),
                        F.lit(o).alias("reason"),
                        F.col(o).alias("entities"),
                        F.col("total"),
                    )
                    for i, o in enumerate(outcomes, start=1)
                ]
            )
        )
    )


def ranked_in_both(flagged: DataFrame) -> DataFrame:
    """Rows of entities that passed every rule. Passing both period cuts implies both periods."""
    return flagged.filter("ranked")
