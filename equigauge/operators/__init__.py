"""DataFrame-to-DataFrame operators.

Column names shared by all layers:

keys       entity, state, region, year, month, sex, band, period
measures   cases, severe, deaths, cost, stay_days, age_sum, age_known
context    population, coverage
"""

MEASURES = ("cases", "severe", "deaths", "cost", "stay_days", "age_sum", "age_known")
CELL = ("entity", "year", "sex", "band")
GOLD_COLUMNS = (
    "entity", "state", "region", "year", "sex", "band",
    "cases", "severe", "deaths", "cost", "stay_days",
    "population", "coverage", "age_sum", "age_known",
)
