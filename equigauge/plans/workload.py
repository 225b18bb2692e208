"""The order tables in the role of admission records.

An order line is an admission, a customer the entity, its nation the state. Every layer is derived
from the given tables by Spark and nothing is sampled. The tables hold no census: the population of
a cell is key arithmetic over the customers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from equigauge.config import SCHEMES, SEX_BY_RECORD_CODE, Bands, Block, Period, Study
from equigauge.operators.cohort import to_bronze
from equigauge.operators.grid import additive_cells, dense_grid
from equigauge.operators.export import wide_index
from equigauge.operators.profiles import (
    components_of, entity_components, entity_components_sparse, period_cells, sex_profile, with_period,
)
from equigauge.operators.rollup import code_lookup, expand_code, label_sex, merge_cells, roll_up
from equigauge.operators.scale import apply_scale, check_scale, fit_scale, index_change
from equigauge.operators.standardize import sound, standard_population
from equigauge.session import spread, staged, swept
from equigauge.sinks.bucketed import bucket_count, colocate, write_bucketed
from equigauge.sources.nested import all_coverage, annual_coverage

CODE_LENGTH = 12

TABLES_STUDY = Study(
    years=tuple(range(1995, 2002)),
    base=Period("1996", (1996,)),
    current=Period("2000-01", (2000, 2001)),
    blocks=(
        Block("1996", 1, (1996,)),
        Block("1997-98", 2, (1997, 1998)),
        Block("1999-01", 3, None),
    ),
    bands=Bands(
        ("<8", "8-14", "15-21", "22-28", "29-35", "36-42", "43+"), (7, 14, 21, 28, 35, 42)
    ),
    cohort_prefixes=("ECO", "STA", "MED", "PRO"),
    severe_prefix="040805",
    short_code_length=CODE_LENGTH,
    schemes=SCHEMES,
)


def entity_code(custkey: Column) -> Column:
    return F.lpad(custkey.cast("string"), CODE_LENGTH, "0")


def full_code(custkey: Column) -> Column:
    """Short code and a check digit."""
    return F.concat(entity_code(custkey), (custkey % 10).cast("string"))


@dataclass(frozen=True)
class Layers:
    """Lazily built layers over one folder of tables."""

    spark: SparkSession
    sf_dir: str
    study: Study = TABLES_STUDY

    @cached_property
    def _schemas(self) -> dict[str, StructType]:
        return {}

    def table(self, name: str) -> DataFrame:
        """A given table. Its footer schema is read once for all layers."""
        path = f"{self.sf_dir}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    @cached_property
    def places(self) -> DataFrame:
        """Nations with their region; the planner broadcasts them by their size."""
        return self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            "n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region")
        )

    @cached_property
    def entities(self) -> DataFrame:
        """entity, code, name, state, region."""
        return (
            self.table("customer")
            .join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                full_code(F.col("c_custkey")).alias("entity"),
                entity_code(F.col("c_custkey")).alias("code"),
                F.col("c_name").alias("name"),
                "state",
                "region",
                "c_custkey",
                "c_acctbal",
            )
        )

    @cached_property
    def census(self) -> DataFrame:
        """Dense population cells: entity x sex x band. Entities are spread before they multiply."""
        labels = self.study.bands.labels
        cells = [
            F.struct(
                F.lit(sex).alias("sex"),
                F.lit(band).alias("band"),
                F.lit(i).alias("sex_ix"),
                F.lit(j).alias("band_ix"),
            )
            for i, sex in enumerate(self.study.sexes)
            for j, band in enumerate(labels)
        ]
        key = F.col("c_custkey")
        people = (
            F.lit(200)
            + (key * 37 + F.col("sex_ix") * 101 + F.col("band_ix") * 59) % 400
            + F.floor(F.abs(F.col("c_acctbal")) / 100)
        )
        # After the join, which could else broadcast the customers.
        entities = spread(self.entities, self.table("customer").count())
        return entities.select("*", F.inline(F.array(*cells))).select(
            "entity", "code", "state", "region", "sex", "band",
            people.cast("long").alias("population"),
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Admission records with the raw column names, year and month."""
        return self.raw_with()

    def raw_with(self, attributes: DataFrame | None = None) -> DataFrame:
        """The records, and attributes of their short code (MUNIC_RES), where there are any.

        Those meet the orders, which are fewer and shorter than the records; a code without
        attributes has no records then.
        """
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        )
        orders = self.table("orders").select(
            "o_orderkey", entity_code(F.col("o_custkey")).alias("MUNIC_RES"), "o_orderstatus", "o_orderdate"
        )
        extra = [] if attributes is None else [c for c in attributes.columns if c != "MUNIC_RES"]
        if attributes is not None:
            orders = orders.join(attributes, "MUNIC_RES")
        parts = self.table("part").select("p_partkey", "p_type", "p_size")
        size = F.col("p_size")
        unit = (
            F.when(size % 20 == 0, "3")
            .when(size % 20 == 1, "2")
            .when(size % 20 == 2, "5")
            .when(size % 20 == 3, "9")
            .otherwise("4")
        )
        procedure = F.when(
            F.col("l_returnflag") == "R",
            F.concat(F.lit("40805"), F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0")),
        ).when(F.col("l_returnflag") == "A", F.lit("0408010010"))
        diagnosis = F.when(
            size != 50, F.concat(F.lit(" "), F.lower(F.substring("p_type", 1, 3)), F.lit("0 "))
        )
        sex = (
            F.when(F.col("l_tax") > 0.075, "9")
            .when(F.col("l_linestatus") == "F", "1")
            .otherwise("3")
        )
        return (
            lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                "MUNIC_RES",
                sex.alias("SEXO"),
                F.col("l_quantity").cast("int").alias("IDADE"),
                unit.alias("COD_IDADE"),
                diagnosis.alias("DIAG_PRINC"),
                procedure.alias("PROC_REA"),
                F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("string")).alias(
                    "IDENT"
                ),
                (F.col("o_orderstatus") == "F").cast("int").alias("MORTE"),
                F.col("l_extendedprice").alias("VAL_TOT"),
                F.datediff("l_shipdate", "o_orderdate").alias("DIAS_PERM"),
                F.year("o_orderdate").alias("year"),
                F.month("o_orderdate").alias("month"),
                *extra,
            )
        )

    @cached_property
    def bronze(self) -> DataFrame:
        return to_bronze(self.raw, self.study)

    @cached_property
    def silver(self) -> DataFrame:
        """Raw keys (short code, sex code) with additive measures; null bands keep their group."""
        return roll_up(self.bronze)

    @cached_property
    def lookup(self) -> DataFrame:
        entities = self.table("customer").select(full_code(F.col("c_custkey")).alias("entity"))
        return code_lookup(entities, CODE_LENGTH)

    def with_silver_staged(self) -> Layers:
        """The same layers over a silver that is written once, where several steps read it."""
        layers = replace(self)
        with swept(self.spark):
            layers.__dict__["silver"] = staged(self.silver, "silver")
        return layers

    @cached_property
    def coded_silver(self) -> DataFrame:
        return expand_code(self.silver, self.lookup)

    @cached_property
    def events(self) -> DataFrame:
        """Measures per grid cell: entity, labelled sex, band, year."""
        return merge_cells(label_sex(self.coded_silver, SEX_BY_RECORD_CODE))

    @cached_property
    def coverage_records(self) -> DataFrame:
        """Monthly coverage records in the two published layouts, one series per time span."""
        value = F.concat(
            F.floor(F.col("o_totalprice") / 5000).cast("string"),
            F.lit("."),
            F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"),
        )
        year, month = F.year("o_orderdate"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")
        early = year <= 1998
        return self.table("orders").select(
            entity_code(F.col("o_custkey")).alias("coMunicipioIbge"),
            F.when(early, F.concat(year.cast("string"), month))
            .otherwise(F.concat(month, F.lit("/"), year.cast("string")))
            .alias("nuComp"),
            F.when(early, F.replace(value, F.lit("."), F.lit(","))).alias("pcCoberturaAb"),
            F.when(~early & (F.col("o_orderkey") % 20 != 0), value).alias("qtCobertura"),
        )

    @cached_property
    def coverage_monthly(self) -> DataFrame:
        return all_coverage(self.coverage_records)

    @cached_property
    def coverage(self) -> DataFrame:
        """entity, year, source, coverage."""
        return expand_code(annual_coverage(self.coverage_monthly, digits=None), self.lookup).dropna(
            subset=["entity"]
        )

    def grid(self, years=None, coverage: bool = False) -> DataFrame:
        """The dense grid; coverage is joined only where it is used."""
        return dense_grid(
            self.census.drop("code"),
            self.study.years if years is None else years,
            self.events,
            self.coverage if coverage else None,
        )

    def cells(self, years=None) -> DataFrame:
        """Rows for sums over the grid, by any keys, without building it."""
        lookup = code_lookup(self.entities, CODE_LENGTH, ["state", "region"])
        events = label_sex(expand_code(self.silver, lookup), SEX_BY_RECORD_CODE)
        return additive_cells(
            self.census, self.study.years if years is None else years, events, complete=True
        )

    @cached_property
    def gold(self) -> DataFrame:
        return self.grid()

    @cached_property
    def gold_by_entity(self) -> DataFrame:
        """The grid without coverage, joined bucket by bucket: its rows are many, and none is shuffled."""
        # A bucket is sorted by all keys in one task; a quarter of the usual rows need not spill.
        buckets = bucket_count(4 * self.table("customer").count() * self.cells_per_entity)
        with swept(self.spark):
            census = write_bucketed(self.census.drop("code"), "census", "entity", buckets)
            # Merged after they are laid out, which needs no shuffle; no cell has a null entity.
            coded = label_sex(self.coded_silver, SEX_BY_RECORD_CODE).dropna(subset=["entity"])
            events = merge_cells(write_bucketed(coded, "events", "entity", buckets))
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return dense_grid(census, self.study.years, events)

    @property
    def cells_per_entity(self) -> int:
        return len(self.study.sexes) * len(self.study.bands.labels) * len(self.study.years)

    @cached_property
    def gold_covered(self) -> DataFrame:
        return self.grid(coverage=True)

    @cached_property
    def colocated(self) -> dict[str, DataFrame]:
        """Census, events and coverage laid out by entity."""
        tables = {"census": self.census.drop("code"), "events": self.events, "coverage": self.coverage}
        # A bucket of the census is joined and sorted after it has been repeated for every year.
        rows = self.census.count() * len(self.study.years)
        return colocate(self.spark, tables, "entity", rows)

    @cached_property
    def gold_colocated(self) -> DataFrame:
        """The covered grid, joined bucket by bucket."""
        own = self.colocated
        return dense_grid(own["census"], self.study.years, own["events"], own["coverage"])

    @cached_property
    def ranked_colocated(self) -> DataFrame:
        """Components of the ranked entities, laid out by entity."""
        rows = self.ranked.count()
        return colocate(self.spark, {"ranked": self.ranked}, "entity", rows)["ranked"]

    @cached_property
    def period_years(self) -> list[int]:
        return [*self.study.base.years, *self.study.current.years]

    @cached_property
    def standard(self) -> DataFrame:
        return standard_population(self.census, self.study.bands)

    @cached_property
    def components_dense(self) -> DataFrame:
        return entity_components(
            self.grid(self.period_years, coverage=True), self.standard, self.study
        )

    @cached_property
    def components(self) -> DataFrame:
        """Index components, all-year totals and ranking flags, straight from admission rows."""
        return entity_components_sparse(
            label_sex(self.bronze, SEX_BY_RECORD_CODE), self.census, self.standard, self.study,
            complete=True,
        )

    @cached_property
    def ranked(self) -> DataFrame:
        """Components of the ranked entities, written once: the ruler and the index read them.

        They come from the shared pass where there is one already.
        """
        shared = "shared_pass" in self.__dict__
        components = self.shared_components(["entity", "state", "region"]) if shared else self.components
        unused = ["age_sum", "age_known"] if shared else []
        return staged(sound(components.filter("ranked")).drop(*unused), "ranked")

    @cached_property
    def shared_pass(self) -> DataFrame:
        """What entities, regions and sexes add up, from one pass over the records, written once."""
        events = label_sex(self.bronze, SEX_BY_RECORD_CODE)
        return staged(period_cells(events, self.census, self.study), "period-cells")

    def shared_components(self, keys: list[str]) -> DataFrame:
        return components_of(self.shared_pass, keys, self.standard, self.study)

    @cached_property
    def period_coverage(self) -> DataFrame:
        """Mean coverage per entity and period. Equal to the mean over grid cells, where every
        year repeats the same number of times."""
        return (
            with_period(self.coverage, self.study)
            .groupBy("entity", "period")
            .agg(F.avg("coverage").alias("coverage"))
        )

    @cached_property
    def ranked_covered(self) -> DataFrame:
        return self.ranked.join(self.period_coverage, ["entity", "period"], "left")

    @cached_property
    def ruler(self) -> dict:
        return check_scale(fit_scale(self.ranked, self.study), self.study)

    @cached_property
    def index(self) -> DataFrame:
        """Normalised components and index of every ranked entity and period."""
        return apply_scale(self.ranked, self.ruler, self.study)

    @cached_property
    def index_covered(self) -> DataFrame:
        return apply_scale(self.ranked_covered, self.ruler, self.study)

    @cached_property
    def change(self) -> DataFrame:
        return index_change(self.index, self.study)

    @cached_property
    def wide(self) -> DataFrame:
        return wide_index(self.index_covered, self.study)

    @cached_property
    def region_coverage(self) -> DataFrame:
        """Mean coverage per region and period; every entity-year has equally many cells."""
        return (
            with_period(self.coverage, self.study)
            .join(self.entities.select("entity", "region"), "entity")
            .groupBy("region", "period")
            .agg(F.avg("coverage").alias("coverage"))
        )

    @cached_property
    def regions(self) -> DataFrame:
        """Region components over all entities, on the ruler of the ranked ones.

        Both come from the shared pass.
        """
        of_entities = ["total_cases", "passed_total", "passed_period", "ranked", "age_sum", "age_known"]
        components = sound(self.shared_components(["region"])).drop(*of_entities)
        return apply_scale(
            components.join(self.region_coverage, ["region", "period"], "left"),
            self.ruler,
            self.study,
            out="region_index",
        )

    @cached_property
    def sexes(self) -> DataFrame:
        """Region by sex profile of the current period."""
        return sound(
            sex_profile(self.cells(self.study.current.years), self.standard, self.study)
        )
