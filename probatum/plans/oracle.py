"""SQL text blocks for checking the catalogue's queries with an independent engine."""

from __future__ import annotations

from collections.abc import Sequence

from probatum.functions.cells import DUMP_MISSING, NULL_TOKENS
from probatum.plans import inputs as I

LABELS = (0, 1, 2)
DIRTY = I.for_duckdb(I.DIRTY_ORDERS)
FEATURES = I.for_duckdb(I.ORDER_FEATURES)
DUPES = I.for_duckdb(I.DUP_ORDERS.replace("{order_features}", I.ORDER_FEATURES))
NUM = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
SPACE = "[\\s" + I.NBSP + "]"


def names(values: Sequence[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def bare(c: str) -> str:
    return f"""trim(trim(trim({trim(c)}, '"'), ''''), '“”')"""


def norm(c: str) -> str:
    return f"CASE WHEN {bare(c)} IN ({names(NULL_TOKENS)}) THEN NULL ELSE {bare(c)} END"


def number(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '{NUM}') THEN TRY_CAST({t} AS DOUBLE) END"


PARSED = f"SELECT row_id, {', '.join(f'{number(norm(c))} AS {c}' for c in I.DIRTY_COLUMNS)} FROM ({DIRTY}) d"


def long(src: str, key: str, columns: Sequence[str], value: str = "value") -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{c}' AS \"column\", {c} AS {value} FROM ({src}) s" for c in columns)


def rule_rows() -> str:
    out = []
    for c in I.DIRTY_COLUMNS:
        r = I.ORDER_RULES.rules[c]
        allowed = "NULL" if r.allowed is None else "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in r.allowed) + "]"
        text = "NULL" if r.allowed is None else f"'{r.allowed_text()}'"
        out.append(
            f"SELECT '{c}' AS \"column\", CAST({r.lower} AS DOUBLE) AS lower_bound, CAST({r.upper} AS DOUBLE) AS "
            f"upper_bound, {str(r.integer_required).lower()} AS integer_required, {allowed} AS allowed, "
            f"{text} AS allowed_values, '{r.source}' AS rule_source, '{r.status}' AS rule_status, "
            f"CAST({I.ORDER_RULES.max_of(c)} AS DOUBLE) AS legacy_max"
        )
    return " UNION ALL ".join(out)


INF = "isinf(value)"
CODED = f"""SELECT c.*, r.* EXCLUDE ("column"),
  CASE WHEN value IS NULL THEN CAST([] AS VARCHAR[]) WHEN {INF} THEN ['non_finite'] ELSE list_filter([
    CASE WHEN value < lower_bound THEN 'below_min' END, CASE WHEN value > upper_bound THEN 'above_max' END,
    CASE WHEN integer_required AND value <> floor(value) THEN 'non_integer' END,
    CASE WHEN allowed IS NOT NULL AND NOT list_contains(allowed, value) THEN 'invalid_category' END],
    lambda x: x IS NOT NULL) END AS codes
FROM ({long(PARSED, 'row_id', I.DIRTY_COLUMNS)}) c LEFT JOIN ({rule_rows()}) r ON c."column" = r."column\""""


def label_reason(v: str, label: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN 'missing_{label}' WHEN isinf({v}) OR {v} <> floor({v}) THEN "
            f"'non_integer_{label}' WHEN {v} NOT IN (0, 1, 2) THEN concat('illegal_{label}_', CAST(CAST({v} AS BIGINT) "
            f"AS VARCHAR)) END")


def slots(within: str, hashed: str, k: int) -> str:
    """Place in hash order times k, divided by the size of the group, as a fold number."""
    return (f"CAST(((row_number() OVER (PARTITION BY {within} ORDER BY md5({hashed}), row_id) - 1) * {k}) // "
            f"count(*) OVER (PARTITION BY {within}) AS INTEGER)")


def folds(src: str, label: str, k: int = 5, repeats: int = 2, seed: int = 0) -> str:
    fold = slots(f"repeat, {label}", f"'{seed}:' || repeat || ':' || row_id", k)
    return (f"SELECT repeat, {fold} AS fold, row_id, {label} "
            f"FROM ({src}) s, (SELECT CAST(unnest(range({repeats})) AS INTEGER) AS repeat) r")


def inner(folds_sql: str, label: str, k: int = 5, inner_k: int = 3, seed: int = 0) -> str:
    fold = slots(f"repeat, o.fold, {label}", f"'{seed}:inner:' || repeat || ':' || o.fold || ':' || row_id", inner_k)
    return (f"SELECT repeat, o.fold, {fold} AS inner_fold, row_id, {label} FROM ({folds_sql}) f, "
            f"(SELECT CAST(unnest(range({k})) AS INTEGER) AS fold) o WHERE o.fold <> f.fold")


def permuted(n_perm: int, label: str = "size_label", seed: int = 0) -> str:
    """CTE text (after ``f``): ``p`` has every row's label in each permutation, the labels in order along the hashes."""
    return f"""l AS (SELECT y, n, sum(n) OVER (ORDER BY y) AS upto FROM (SELECT {label} AS y, count(*) AS n FROM f GROUP BY {label}) c),
d AS (SELECT perm, row_id, row_number() OVER (PARTITION BY perm ORDER BY md5('{seed}:perm:' || perm || ':' || row_id), row_id) AS r
FROM f, (SELECT CAST(unnest(range({n_perm})) AS INTEGER) AS perm) g),
p AS (SELECT perm, row_id, l.y FROM d JOIN l ON r > upto - n AND r <= upto)"""


def metrics(counts: str, keys: Sequence[str], labels: Sequence[int] = LABELS, matrix: bool = False) -> str:
    """class_metrics over a (keys, y, pred, n) query; rounding to 9 places, the matrix as text on demand."""
    k = ", ".join(keys)

    def s(cond: str) -> str:
        return f"coalesce(sum(n) FILTER (WHERE {cond}), 0)"

    base = [f"sum(n) AS n_samples", f"{s('y = pred')} AS ok"]
    for a in labels:
        base += [f"{s(f'y = {a} AND pred = {a}')} AS h{a}", f"{s(f'y = {a}')} AS s{a}", f"{s(f'pred = {a}')} AS p{a}"]
        base += [f"{s(f'y = {a} AND pred = {b}')} AS m{a}_{b}" for b in labels]
    lo, hi = labels[0], labels[-1]

    def ratio(x: str, y: str) -> str:
        return f"CASE WHEN {y} = 0 THEN 0.0 ELSE CAST({x} AS DOUBLE) / CAST({y} AS DOUBLE) END"

    f1 = {a: ratio(f"2 * h{a}", f"(s{a} + p{a})") for a in labels}
    macro = " + ".join(f"({f1[a]})" for a in labels)
    cols = [
        "CAST(n_samples AS BIGINT) AS n_samples", f"round(({macro}) / {len(labels)}, 9) AS macro_f1",
        "round(CAST(ok AS DOUBLE) / CAST(n_samples AS DOUBLE), 9) AS accuracy",
        f"CAST(m{lo}_{hi} + m{hi}_{lo} AS BIGINT) AS extreme_error_numerator",
        f"CAST(s{lo} + s{hi} AS BIGINT) AS extreme_error_denominator",
        f"round(CASE WHEN s{lo} + s{hi} > 0 THEN CAST(m{lo}_{hi} + m{hi}_{lo} AS DOUBLE) / CAST(s{lo} + s{hi} AS "
        "DOUBLE) END, 9) AS extreme_error_rate",
    ]
    for a in labels:
        cols += [f"round({ratio(f'h{a}', f'p{a}')}, 9) AS class_{a}_precision",
                 f"round({ratio(f'h{a}', f's{a}')}, 9) AS class_{a}_recall", f"round({f1[a]}, 9) AS class_{a}_f1",
                 f"CAST(s{a} AS BIGINT) AS class_{a}_support"]
    if matrix:
        rows = ", ',', ".join(
            "'[', " + ", ',', ".join(f"CAST(m{a}_{b} AS VARCHAR)" for b in labels) + ", ']'" for a in labels)
        cols.append(f"concat('[', {rows}, ']') AS confusion_matrix")
    return f"SELECT {k}, {', '.join(cols)} FROM (SELECT {k}, {', '.join(base)} FROM ({counts}) c GROUP BY {k}) m"


def histogram(rows: str, part: Sequence[str], fold: str, features: Sequence[str], label: str, ctes: str) -> str:
    """CTE text defining ``filled``: train/valid label counts per (part, fold, feature, value), modes filled in."""
    p, keys = ", ".join(part), ", ".join([*part, fold, "feature"])
    arms = " UNION ALL ".join(f"SELECT {p}, {fold}, {label} AS y, '{c}' AS feature, {c} AS value FROM rws" for c in features)
    t = "t_0 + t_1 + t_2"
    sides = ", ".join(
        f"count(*) FILTER (WHERE y = {v} AND x.{fold} <> g.{fold}) AS t_{v}, "
        f"count(*) FILTER (WHERE y = {v} AND x.{fold} = g.{fold}) AS v_{v}" for v in LABELS)
    gp = ", ".join(f"x.{c}" for c in part)
    on = " AND ".join(f"x.{c} = g.{c}" for c in part)
    order = f"CASE WHEN value IS NOT NULL AND {t} > 0 THEN {t} END DESC NULLS LAST, value"
    sums = ", ".join(f"sum({s}_{v}) AS {s}_{v}" for s in "tv" for v in LABELS)
    return f"""{ctes} rws AS ({rows}), lng AS ({arms}), fl AS (SELECT DISTINCT {p}, {fold} FROM rws),
  h AS (SELECT {gp}, g.{fold}, feature, value, {sides} FROM lng x JOIN fl g ON {on} GROUP BY ALL),
  md AS (SELECT {keys}, first(value ORDER BY {order}) AS md FROM h GROUP BY {keys}),
  filled AS (SELECT {keys}, coalesce(h.value, md.md) AS value, {sums} FROM h JOIN md USING ({keys}) GROUP BY ALL)"""


def tree(keys: Sequence[str], depth: int = 3) -> str:
    """CTE text growing the trees of ``filled``; the last CTE is ``grown`` with a prediction per value."""
    k = ", ".join(keys)
    out = ["l0 AS (SELECT *, 0 AS node, CAST('-inf' AS DOUBLE) AS lo FROM filled)"]
    left, total = "l_0 + l_1 + l_2", "a_0 + a_1 + a_2"
    lsq = "CAST(l_0 * l_0 + l_1 * l_1 + l_2 * l_2 AS DOUBLE)"
    rsq = "CAST((a_0-l_0)*(a_0-l_0) + (a_1-l_1)*(a_1-l_1) + (a_2-l_2)*(a_2-l_2) AS DOUBLE)"
    for i in range(depth):
        sums = ", ".join(f"sum(t_{v}) OVER up AS l_{v}, sum(t_{v}) OVER cell AS a_{v}" for v in LABELS)
        out.append(
            f"a{i} AS (SELECT *, {sums}, min(CASE WHEN t_0 + t_1 + t_2 > 0 THEN value END) OVER aft AS nxt FROM l{i} "
            f"WINDOW cell AS (PARTITION BY {k}, node), up AS (PARTITION BY {k}, node ORDER BY value ROWS UNBOUNDED "
            f"PRECEDING), aft AS (PARTITION BY {k}, node ORDER BY value ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))")
        out.append(
            f"b{i} AS (SELECT *, CASE WHEN t_0 + t_1 + t_2 > 0 AND nxt IS NOT NULL AND greatest(a_0, a_1, a_2) <> {total} "
            f"THEN {lsq} / CAST({left} AS DOUBLE) + {rsq} / CAST({total} - ({left}) AS DOUBLE) END AS score FROM a{i})")
        out.append(f"c{i} AS (SELECT *, max(score) OVER (PARTITION BY {k}, node) AS best FROM b{i})")
        out.append(
            f"d{i} AS (SELECT *, min(CASE WHEN score = best THEN (value + nxt) / 2 END) OVER (PARTITION BY {k}, node) "
            f"AS thr FROM c{i})")
        out.append(
            f"l{i + 1} AS (SELECT {k}, value, t_0, t_1, t_2, v_0, v_1, v_2, CASE WHEN thr IS NULL THEN node ELSE node * 2 "
            f"+ CASE WHEN value > thr THEN 2 ELSE 1 END END AS node, CASE WHEN value > thr THEN thr ELSE lo END AS lo "
            f"FROM d{i})")
    s = [f"sum(t_{v}) OVER (PARTITION BY {k}, node)" for v in LABELS]
    out.append(
        f"grown AS (SELECT *, CASE WHEN {s[0]} >= {s[1]} AND {s[0]} >= {s[2]} THEN 0 WHEN {s[1]} >= {s[2]} THEN 1 ELSE 2 "
        f"END AS pred FROM l{depth})")
    return ", ".join(out)


def grown_counts(keys: Sequence[str], side: str = "v") -> str:
    k = ", ".join(keys)
    return " UNION ALL ".join(
        f"SELECT {k}, {v} AS y, pred, sum({side}_{v}) AS n FROM grown GROUP BY {k}, pred" for v in LABELS)


def pair_kind(c: str, r: str) -> str:
    fc, fr = (f"regexp_replace({trim(x)}, '\\r\\n?', chr(10), 'g')" for x in (c, r))
    miss = names(DUMP_MISSING)
    mc, mr = f"lower({fc}) IN ({miss})", f"lower({fr}) IN ({miss})"
    nc, nr = number(fc), number(fr)
    return f"""CASE WHEN {c} = {r} THEN 'equal_raw' WHEN {mc} AND {mr} THEN 'format_only'
      WHEN {mc} OR {mr} THEN 'missing_vs_nonmissing' WHEN ({nc}) = ({nr}) THEN 'format_only'
      WHEN ({nc}) IS NOT NULL AND ({nr}) IS NOT NULL THEN 'numeric_difference' WHEN {fc} = {fr} THEN 'format_only'
      WHEN ({nc}) IS NOT NULL OR ({nr}) IS NOT NULL THEN 'unparseable' ELSE 'content_difference' END"""


CAND, REF = I.for_duckdb(I.PART_CANDIDATE), I.for_duckdb(I.PART_DUMP)
PAIRS = " UNION ALL ".join(
    f"SELECT c.row_index, {i} AS position, '{x}' AS \"column\", c.{x} AS candidate_raw, r.{x} AS reference_raw, "
    f"{pair_kind(f'c.{x}', f'r.{x}')} AS kind FROM ({CAND}) c JOIN ({REF}) r USING (row_index)"
    for i, x in enumerate(I.DUMP_COLUMNS))
