"""Field rules: provisional bounds used for reporting, never for changing the included rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = (
    "column string, lower_bound double, upper_bound double, integer_required boolean, "
    "allowed array<double>, allowed_values string, rule_source string, rule_status string, legacy_max double"
)


@dataclass(frozen=True)
class FieldRule:
    name: str
    lower: float | None = None
    upper: float | None = None
    integer_required: bool = False
    allowed: tuple[float, ...] | None = None
    source: str = "provisional"
    status: str = "provisional"

    def allowed_text(self) -> str | None:
        if self.allowed is None:
            return None
        return ",".join(str(int(v)) if float(v).is_integer() else str(v) for v in sorted(self.allowed))


@dataclass(frozen=True)
class RuleSet:
    """Rules by column plus the legacy upper bounds that drive the out-of-range policy."""

    rules: Mapping[str, FieldRule]
    legacy_max: Mapping[str, float] = field(default_factory=dict)
    default_max: float = 5.0

    def max_of(self, column: str) -> float:
        return float(self.legacy_max.get(column, self.default_max))

    def frame(self, spark: SparkSession, columns: Sequence[str]) -> DataFrame:
        """One row per given column, so its size is the width of the table, never its length."""
        rows = []
        for c in columns:
            r = self.rules.get(c)
            if r is None:
                rows.append((c, None, None, None, None, None, None, None, self.max_of(c)))
            else:
                allowed = None if r.allowed is None else [float(v) for v in sorted(r.allowed)]
                rows.append(
                    (c, r.lower, r.upper, r.integer_required, allowed, r.allowed_text(), r.source, r.status,
                     self.max_of(c))
                )
        return spark.createDataFrame(rows, RULE_SCHEMA)


# The questionnaire table (scale maxima, encoded fields, 0-5 items, the 0-2 label).
SCALE_MAX = {"anxiety_level": 21.0, "self_esteem": 30.0, "depression": 27.0}
ENCODED_MAX = {"blood_pressure": 3.0, "social_support": 3.0}
ITEMS_0_5 = (
    "headache", "sleep_quality", "breathing_problem", "noise_level", "living_conditions", "safety",
    "basic_needs", "academic_performance", "study_load", "teacher_student_relationship",
    "future_career_concerns", "peer_pressure", "extracurricular_activities", "bullying",
)
BINARY_FIELD = "mental_health_history"
QUESTIONNAIRE_LABEL = "stress_level"
QUESTIONNAIRE_DROP = ("anxiety_level", "self_esteem", "mental_health_history", "depression")
QUESTIONNAIRE_PROXY = "blood_pressure"
# Label-driven replacement of zeros, used only to demonstrate a leak.
ZERO_LEAK = {
    "headache": (0, 2, 4),
    "sleep_quality": (0, 3, 4),
    "breathing_problem": (0, 2, 5),
    "noise_level": (0, 3, 5),
    "living_conditions": (4, 5, 0),
    "safety": (5, 3, 0),
    "basic_needs": (5, 3, 0),
    "academic_performance": (5, 3, 0),
    "study_load": (0, 3, 5),
    "teacher_student_relationship": (5, 3, 0),
    "future_career_concerns": (0, 3, 5),
    "social_support": (3, 2, 0),
    "peer_pressure": (0, 3, 5),
    "extracurricular_activities": (0, 3, 5),
    "bullying": (0, 3, 5),
}


def questionnaire_rules() -> RuleSet:
    """The 21 provisional rules of the questionnaire table."""
    rules = {c: FieldRule(c, 0.0, m, source="bulk-data maximum") for c, m in SCALE_MAX.items()}
    rules |= {c: FieldRule(c, 0.0, m, True, source="bulk-data maximum") for c, m in ENCODED_MAX.items()}
    rules |= {c: FieldRule(c, 0.0, 5.0, True, source="item convention") for c in ITEMS_0_5}
    rules[BINARY_FIELD] = FieldRule(BINARY_FIELD, 0.0, 1.0, True, (0.0, 1.0), "item convention")
    rules[QUESTIONNAIRE_LABEL] = FieldRule(
        QUESTIONNAIRE_LABEL, 0.0, 2.0, True, (0.0, 1.0, 2.0), "item convention"
    )
    legacy = {**SCALE_MAX, **ENCODED_MAX, BINARY_FIELD: 1.0, QUESTIONNAIRE_LABEL: 2.0}
    return RuleSet(rules, legacy)
