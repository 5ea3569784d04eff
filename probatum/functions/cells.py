"""Scalar expressions on single cells: text normalisation, numbers, violations, pair kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts a delimited-text reader turns into missing before any other rule.
READER_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cell texts that mean missing after trimming and quote removal (case-sensitive).
NULL_TOKENS = ("", "null", "Null", "NULL", "nan", "NaN", "NA", "None")
# Missing vocabulary of dump comparison (compared in lower case).
DUMP_MISSING = ("", "null", "nan", "na", "none", "n/a")

EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
NUMBER = r"^\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?)))\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(_col(c), EDGE_SPACE, "")


def unquote(c: Column | str) -> Column:
    """Strip double, then single, then curly quotes from both ends of a trimmed cell."""
    s = F.btrim(_col(c), F.lit('"'))
    s = F.btrim(s, F.lit("'"))
    return F.btrim(s, F.lit("“”"))


def reader_nulls_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~c.isin(*READER_NULLS), c)


def normalize_cell(c: Column | str) -> Column:
    """Trimmed, unquoted text, NULL for the missing tokens."""
    return missing_tokens_to_null(unquote(strip_space(c)))


def missing_tokens_to_null(bare: Column | str) -> Column:
    return F.when(~_col(bare).isin(*NULL_TOKENS), _col(bare))


def cell_actions(c: Column | str) -> Column:
    """``;``-joined list of what normalisation did, in the order it was done."""
    return actions_of(c, strip_space(c), unquote(strip_space(c)))


def actions_of(c: Column | str, trimmed: Column | str, bare: Column | str) -> Column:
    """The action list from a cell and its trimmed and unquoted forms."""
    c, trimmed, bare = _col(c), _col(trimmed), _col(bare)
    return F.when(c.isNull(), F.lit("already_missing")).otherwise(
        F.concat_ws(
            ";",
            F.when(trimmed != c, F.lit("stripped_whitespace")),
            F.when(bare != trimmed, F.lit("removed_outer_quotes")),
            F.when(bare.isin(*NULL_TOKENS), F.lit("null_token_to_missing")),
        )
    )


def is_number(text: Column | str) -> Column:
    return _col(text).rlike(NUMBER)


def to_number(text: Column | str) -> Column:
    """Double of a decimal-number text, NULL otherwise. Infinities stay, NaN cannot arise.

    The text is named once, so nested uses do not multiply the work.
    """
    return F.regexp_extract(_col(text), NUMBER, 1).try_cast("double")


def parse_number(c: Column | str) -> Column:
    """Double of a raw cell. No missing token is a number, so they need no test of their own."""
    return to_number(unquote(strip_space(c)))


def issue_reason(raw: Column | str, normalized: Column | str, actions: Column | str) -> Column:
    """Why a cell belongs in the issue log, NULL when it does not."""
    raw, normalized, actions = _col(raw), _col(normalized), _col(actions)
    numeric = is_number(normalized)
    return (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(normalized.isNull(), F.lit("null_or_empty_to_missing"))
        .when(~numeric, F.lit("non_numeric_after_normalization"))
        .when(actions != "", F.lit("format_normalized"))
    )


def is_non_finite(v: Column | str) -> Column:
    v = _col(v)
    return F.coalesce(F.isnan(v) | v.isin(float("inf"), float("-inf")), F.lit(False))


def whole_text(v: Column | str) -> Column:
    """Text of an integral double."""
    v = _col(v)
    small = F.abs(v) < F.lit(9007199254740992.0)
    return F.when(small, v.try_cast("bigint").cast("string")).otherwise(F.format_string("%.0f", v))


def label_reason(v: Column | str, label: str, domain: Sequence[int]) -> Column:
    """Why a parsed label is unusable, NULL when it is valid. Integrality is tested before the domain."""
    v = _col(v)
    integral = ~is_non_finite(v) & (v == F.floor(v).cast("double"))
    # floor() of a huge double saturates at the long range, so test those as integral directly
    integral = F.when(F.abs(v) >= F.lit(9007199254740992.0), ~is_non_finite(v)).otherwise(integral)
    return (
        F.when(v.isNull(), F.lit(f"missing_{label}"))
        .when(~integral, F.lit(f"non_integer_{label}"))
        .when(~v.isin(*[float(d) for d in domain]), F.concat(F.lit(f"illegal_{label}_"), whole_text(v)))
    )


def violation_codes(
    v: Column | str, lower: Column, upper: Column, integer_required: Column, allowed: Column
) -> Column:
    """Array of rule violations of one parsed cell. Missing cells have none; non-finite stands alone."""
    v = _col(v)
    fractional = (F.abs(v) < F.lit(9007199254740992.0)) & (v != F.floor(v).cast("double"))
    codes = F.array_compact(
        F.array(
            F.when(v < lower, F.lit("below_min")),
            F.when(v > upper, F.lit("above_max")),
            F.when(integer_required & fractional, F.lit("non_integer")),
            F.when(allowed.isNotNull() & ~F.array_contains(allowed, v), F.lit("invalid_category")),
        )
    )
    return (
        F.when(v.isNull(), F.array().cast("array<string>"))
        .when(is_non_finite(v), F.array(F.lit("non_finite")))
        .otherwise(codes)
    )


def differs(a: Column | str, b: Column | str) -> Column:
    """Unequal, with missing equal to missing."""
    return ~_col(a).eqNullSafe(_col(b))


def lf_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def dump_format(c: Column | str) -> Column:
    """Comparison form of a dump cell: trimmed, inner line ends as LF."""
    return lf_newlines(strip_space(c))


def dump_missing(c: Column | str) -> Column:
    return F.lower(dump_format(c)).isin(*DUMP_MISSING)


def pair_kind(cand: Column | str, ref: Column | str) -> Column:
    """Kind of difference between two dump cells; ``equal`` when the raw texts are equal."""
    cand, ref = _col(cand), _col(ref)
    fc, fr = dump_format(cand), dump_format(ref)
    mc, mr = F.lower(fc).isin(*DUMP_MISSING), F.lower(fr).isin(*DUMP_MISSING)
    nc, nr = to_number(fc), to_number(fr)
    return (
        F.when(cand == ref, F.lit("equal_raw"))
        .when(mc & mr, F.lit("format_only"))
        .when(mc | mr, F.lit("missing_vs_nonmissing"))
        .when(nc == nr, F.lit("format_only"))
        .when(nc.isNotNull() & nr.isNotNull(), F.lit("numeric_difference"))
        .when(fc == fr, F.lit("format_only"))
        .when(nc.isNotNull() | nr.isNotNull(), F.lit("unparseable"))
        .otherwise(F.lit("content_difference"))
    )


def band(v: Column | str, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Half-open bands ``[a, b)``; outside the edges is missing."""
    if len(names) != len(edges) - 1:
        raise ValueError("one name per band")
    v = _col(v)
    out = F.when(v < edges[0], F.lit(None).cast("string"))
    for hi, name in zip(edges[1:], names):
        out = out.when(v < hi, F.lit(name))
    return out


def number_text(x: Column) -> Column:
    """A double as text without an exponent between 1e-4 and 1e16, and as ``1.5e+16`` or ``1e-05`` outside."""
    text, size = x.cast("string"), F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.substring_index(text, "E", -1).cast("int")
    short = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"),
                     F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(~F.contains(text, F.lit("E")), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)
