"""Variable catalog: the only declared metadata a panel carries.

A catalog is a list of ``Variable`` rows (name, valid min, valid max, label,
group). Operators take the catalog (or plain column lists) as parameters, so
the engine itself stays domain-free.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Variable:
    name: str
    lo: float | None = None
    hi: float | None = None
    label: str | None = None
    group: str | None = None


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Codes meaning "missing" in every column, numeric and text forms, plus a blank.
MISSING_CODES = (-9, -8, -7, -1)
MISSING_STRINGS = ("-9", "-8", "-7", "-1", " ")

# Valid ranges (name, min, max), in the reference's order. Zero is always kept.
REFERENCE_RANGES = [
    ("TOTIDE1", 0, 12), ("TOTIDE2", 0, 12),
    ("HOTFLAS", 1, 5), ("NUMHOTF", 1, 50), ("BOTHOTF", 1, 4),
    ("NITESWE", 1, 5), ("NUMNITS", 1, 24), ("BOTNITS", 1, 4),
    ("COLDSWE", 1, 5), ("BOTCLDS", 1, 4), ("NUMCLDS", 1, 15),
    ("STIFF", 1, 5), ("IRRITAB", 1, 5), ("MOODCHG", 1, 5),
    ("LISTEN", 1, 5), ("TAKETOM", 1, 5), ("HELPSIC", 1, 5), ("CONFIDE", 1, 5),
    ("EMOCTDW", 1, 2), ("EMOACCO", 1, 2), ("EMOCARE", 1, 2),
    ("INTERFR", 1, 5), ("SOCIAL", 1, 5),
    ("INCOME", 1, 4), ("HOW_HAR", 1, 3), ("BCINCML", 1, 2), ("DEGREE", 1, 5),
    ("LANGCOG", 1, 4), ("STATUS", 1, 8),
]

# Stage code -> label, and the display order of the labels.
REFERENCE_STAGE_LABELS = {
    1: "Surgical", 2: "Post-menopause", 3: "Late Peri", 4: "Early Peri",
    5: "Pre-menopause", 8: "Surgical",
}
REFERENCE_STAGE_ORDER = ["Pre-menopause", "Early Peri", "Late Peri", "Post-menopause", "Surgical"]
REFERENCE_STAGE_CODES = [1, 2, 3, 4, 5, 8]
# Codes of the two-way flag's first level ("Surgical"); everything else is "Natural".
REFERENCE_SURGICAL_CODES = [1, 8]

# Significance stars: p < .001 -> ***, < .01 -> **, < .05 -> *, else ''.
SIGNIFICANCE_LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]

# Decision thresholds used in reports.
ALPHA = 0.05                 # association / MCAR / normality decisions
BALANCE_RATIO = 1.5          # group sizes "balanced" when max/min < 1.5
VIF_HIGH = 5.0               # VIF flag
HIGH_CORRELATION = 0.7       # |r| flagged as high
NETWORK_MIN_ABS_R = 0.1      # correlation-network edge threshold
NETWORK_STRENGTH_CUTS = (0.2, 0.4, 0.6)   # weak / moderate / strong / very strong
CORR_CHANGE_CUTS = (0.1, 0.2)             # minimal / moderate / substantial change
SHAPIRO_MAX_N = 5000         # Shapiro-Wilk sample cap


def reference_catalog() -> list[Variable]:
    return [Variable(n, lo, hi) for n, lo, hi in REFERENCE_RANGES]


def ranges(catalog: list[Variable]) -> dict[str, tuple[float, float]]:
    return {v.name: (v.lo, v.hi) for v in catalog if v.lo is not None and v.hi is not None}
