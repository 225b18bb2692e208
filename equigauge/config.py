"""Study settings: one frozen object handed to the operators that need it."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values of the health domain (must equal the published results).
# ---------------------------------------------------------------------------

# Two-digit area code -> state.
STATE_BY_CODE = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL",
    28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP",
    41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}

# Region -> its states.
STATES_BY_REGION = {
    "Norte": ("AC", "AM", "AP", "PA", "RO", "RR", "TO"),
    "Nordeste": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "Centro-Oeste": ("DF", "GO", "MS", "MT"),
    "Sudeste": ("ES", "MG", "RJ", "SP"),
    "Sul": ("PR", "RS", "SC"),
}

# Raw sex code -> label (admission records, census).
SEX_BY_RECORD_CODE = {"1": "M", "3": "F"}
SEX_BY_CENSUS_CODE = {"4": "M", "5": "F"}

# Census age-group id -> study band.
CENSUS_GROUPS_BY_BAND = {
    "<30": (93070, 93084, 93085, 93086, 93087, 93088),
    "30-39": (93089, 93090),
    "40-49": (93091, 93092),
    "50-59": (93093, 93094),
    "60-69": (93095, 93096),
    "70-79": (93097, 93098),
    "80+": (49108, 49109, 60040, 60041, 6653),
}

# Labels of the sign of a change of the index (positive is worse).
WORSE, BETTER, STABLE = "Piorou", "Melhorou", "Estavel"


@dataclass(frozen=True)
class Bands:
    """Right-closed value bands: label i covers values <= limits[i]; the last is open."""

    labels: tuple[str, ...]
    limits: tuple[float, ...]

    def __post_init__(self):
        if len(self.labels) != len(self.limits) + 1:
            raise ValueError("bands need exactly one more label than limits")


@dataclass(frozen=True)
class Period:
    label: str
    years: tuple[int, ...]

    @property
    def suffix(self) -> str:
        return self.label.replace("-", "_")


@dataclass(frozen=True)
class Block:
    """A run of years shown together; ``years=None`` takes every other year."""

    label: str
    order: int
    years: tuple[int, ...] | None


@dataclass(frozen=True)
class Study:
    years: tuple[int, ...]
    base: Period
    current: Period
    blocks: tuple[Block, ...]
    bands: Bands
    cohort_prefixes: tuple[str, ...]
    severe_prefix: str
    procedure_width: int = 10
    continuation_code: int = 5
    short_code_length: int = 6
    min_total: int = 20
    min_period: int = 5
    components: tuple[str, ...] = ("std_rate", "severe_frac", "death_frac")
    inverted: tuple[str, ...] = ()
    per: int = 100_000
    winsor: tuple[float, float] = (0.01, 0.99)
    sexes: tuple[str, ...] = ("F", "M")
    schemes: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def periods(self) -> tuple[Period, Period]:
        return (self.base, self.current)

    @property
    def equal_weights(self) -> dict[str, float]:
        return {c: 1 / len(self.components) for c in self.components}


# Weight schemes of the sensitivity analysis, in component order rate, severe, death.
_SCHEME_WEIGHTS = {
    "equal": (1 / 3, 1 / 3, 1 / 3),
    "outcome": (0.20, 0.45, 0.35),
    "severity": (0.20, 0.35, 0.45),
    "access": (0.50, 0.25, 0.25),
}
SCHEMES = {
    name: dict(zip(("std_rate", "severe_frac", "death_frac"), w))
    for name, w in _SCHEME_WEIGHTS.items()
}

# Accepted range per measure; None leaves that side open. Checked in this order.
RANGE_LIMITS = {
    "std_rate": (0.0, None),
    "severe_frac": (0.0, 1.0),
    "death_frac": (0.0, 1.0),
    "coverage": (0.0, 1000.0),
    "index": (0.0, 1.0),
}


def health_study() -> Study:
    """The published study: admissions for one disease, 2019-2024."""
    return Study(
        years=tuple(range(2019, 2025)),
        base=Period("2019", (2019,)),
        current=Period("2023-24", (2023, 2024)),
        blocks=(
            Block("2019", 1, (2019,)),
            Block("2020-21", 2, (2020, 2021)),
            Block("2022-24", 3, None),
        ),
        bands=Bands(
            ("<30", "30-39", "40-49", "50-59", "60-69", "70-79", "80+"),
            (29, 39, 49, 59, 69, 79),
        ),
        cohort_prefixes=("E10", "E11", "E12", "E13", "E14"),
        severe_prefix="040805",
        schemes=SCHEMES,
    )
