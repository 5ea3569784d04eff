"""Every registered query with its check. Each reads the given tables whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.functions import cells
from probatum.operators import association as A
from probatum.operators import compare as C
from probatum.operators import duplicates as D
from probatum.operators import invariance as V
from probatum.operators import metrics as M
from probatum.operators import models as L
from probatum.operators import parsing as P
from probatum.operators import permutation as Q
from probatum.operators import preprocess as R
from probatum.operators import splits as S
from probatum.operators import trees as T
from probatum.plans import inputs as I
from probatum.plans import oracle as O
from probatum.plans.proxy import variants
from probatum.session import checkpoint_folder
from probatum.sources import text as text_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

K, REPEATS, LABELS = 5, 2, [0, 1, 2]
DOMAIN = [0, 1, 2]
KEY = "row_id"
LEAK = {"n_lines": (1, 3, 5), "tax": (0, 10, 20), "priority": (1, 3, 5), "disc": (5, 20, 35)}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, because engines add them in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return P.parse_table(I.dirty_orders(spark, sf), KEY, I.DIRTY_COLUMNS)


# cells and tables ---------------------------------------------------------------------------------

@query("parsed_cells", O.PARSED)
def _(spark, sf):
    return parsed(spark, sf)


_ACT = (f"concat_ws(';', CASE WHEN {O.trim('v')} <> v THEN 'stripped_whitespace' END, CASE WHEN {O.bare('v')} <> "
        f"{O.trim('v')} THEN 'removed_outer_quotes' END, CASE WHEN {O.bare('v')} IN ({O.names(cells.NULL_TOKENS)}) THEN "
        f"'null_token_to_missing' END)")


@query("parse_issues", f"""WITH c AS ({O.long(O.DIRTY, 'row_id', I.DIRTY_COLUMNS, 'v')}),
n AS (SELECT *, {O.norm('v')} AS norm, {_ACT} AS acts FROM c WHERE v IS NOT NULL),
r AS (SELECT *, CASE WHEN norm IS NULL THEN 'null_or_empty_to_missing'
  WHEN NOT regexp_matches(norm, '{O.NUM}') THEN 'non_numeric_after_normalization'
  WHEN acts <> '' THEN 'format_normalized' END AS reason FROM n)
SELECT row_id, "column", v AS original_value, coalesce(norm, '') AS normalized_value,
  CASE WHEN acts = '' THEN 'none' ELSE acts END AS action, reason FROM r WHERE reason IS NOT NULL""")
def _(spark, sf):
    return P.parse_issues(I.dirty_orders(spark, sf), KEY, I.DIRTY_COLUMNS)


@query("invalid_labels", f"""SELECT row_id, status, {O.label_reason('status', 'status')} AS reason FROM ({O.PARSED}) p
WHERE {O.label_reason('status', 'status')} IS NOT NULL""")
def _(spark, sf):
    return P.invalid_labels(parsed(spark, sf), KEY, "status", DOMAIN)


def _exclusion_sql(tail: int | None, drop: bool) -> str:
    t = f"row_id >= {tail}" if tail is not None else "false"
    lab = O.label_reason("status", "status")
    over = "CASE WHEN price > 300000 THEN 'price' WHEN priority > 4 THEN 'priority' END" if drop else "CAST(NULL AS VARCHAR)"
    return (f"SELECT row_id, reason, over_column FROM (SELECT row_id, CASE WHEN {t} THEN '{P.TAIL_REASON}' WHEN {lab} IS NOT "
            f"NULL THEN {lab} WHEN {over} IS NOT NULL THEN '{P.RANGE_REASON}' END AS reason, CASE WHEN {t} OR {lab} IS NOT "
            f"NULL THEN NULL ELSE {over} END AS over_column FROM ({O.PARSED}) p) e WHERE reason IS NOT NULL")


def _excluded(spark, sf, scope: P.Scope) -> DataFrame:
    return P.exclusions(parsed(spark, sf), KEY, "status", DOMAIN, ["price", "priority"], I.ORDER_RULES, scope)


def _with_over_column(df: DataFrame) -> DataFrame:
    """The offending column from the detail text, whose number format differs between engines."""
    name = F.regexp_extract("detail", "^([a-z]+)=", 1)
    return df.select(KEY, "reason", F.when(name != "", name).alias("over_column"))


@query("exclusions_primary", _exclusion_sql(1100, False))
def _(spark, sf):
    return _with_over_column(_excluded(spark, sf, P.Scope(1100)))


@query("exclusions_out_of_range", _exclusion_sql(None, True))
def _(spark, sf):
    return _with_over_column(_excluded(spark, sf, P.Scope(None, True)))


@query("included_rows", f"SELECT p.* FROM ({O.PARSED}) p ANTI JOIN ({_exclusion_sql(None, True)}) x USING (row_id)")
def _(spark, sf):
    return P.included(parsed(spark, sf), _excluded(spark, sf, P.Scope(None, True)), KEY)


@query("exclusion_union_first_reason", f"""WITH u AS (
  SELECT row_id, 1 AS priority, {O.label_reason('status', 'status')} AS reason FROM ({O.PARSED}) p UNION ALL
  SELECT row_id, 2, CASE WHEN price > 300000 OR priority > 4 THEN '{P.RANGE_REASON}' END FROM ({O.PARSED}) p)
SELECT row_id, first(reason ORDER BY priority) AS reason, CAST(min(priority) AS INTEGER) AS priority
FROM u WHERE reason IS NOT NULL GROUP BY row_id""")
def _(spark, sf):
    p = parsed(spark, sf)
    labels = P.invalid_labels(p, KEY, "status", DOMAIN).select(KEY, F.lit(1).alias("priority"), "reason")
    above = P.out_of_range(p, KEY, ["price", "priority"], I.ORDER_RULES).select(
        KEY, F.lit(2).alias("priority"), F.lit(P.RANGE_REASON).alias("reason"))
    return D.first_reason(labels.unionByName(above), KEY, "priority").select(KEY, "reason", "priority")


@query("out_of_range", f"""SELECT row_id, "column", value, legacy_max AS provisional_max,
'provisional_bound_not_data_dictionary' AS note FROM ({O.CODED}) c WHERE "column" <> 'status' AND value > legacy_max""")
def _(spark, sf):
    return P.out_of_range(parsed(spark, sf), KEY, ["price", "priority"], I.ORDER_RULES)


@query("domain_violations", f"""SELECT row_id, "column", value AS parsed_value, unnest(codes) AS violation, lower_bound,
upper_bound, integer_required, allowed_values, rule_source, rule_status FROM ({O.CODED}) c""")
def _(spark, sf):
    return P.domain_violations(parsed(spark, sf), KEY, I.DIRTY_COLUMNS, I.ORDER_RULES)


@query("domain_violation_counts", f"""SELECT CAST(sum(len(codes)) AS BIGINT) AS n_violation_records,
count(*) FILTER (WHERE len(codes) > 0) AS n_cells_with_any_violation,
count(DISTINCT CASE WHEN len(codes) > 0 THEN row_id END) AS n_rows_with_any_violation,
count(*) FILTER (WHERE value IS NULL) AS n_missing_cells FROM ({O.CODED}) c""")
def _(spark, sf):
    return P.violation_counts(parsed(spark, sf), KEY, I.DIRTY_COLUMNS, I.ORDER_RULES)


_CODES = ("below_min", "above_max", "non_integer", "invalid_category", "non_finite")


@query("field_checks", f"""SELECT "column" AS field, min(value) AS min, max(value) AS max,
count(*) FILTER (WHERE value IS NULL) AS n_missing, first(legacy_max) AS provisional_max,
count(*) FILTER (WHERE value > legacy_max) AS n_above_provisional_max,
{', '.join(f"count(*) FILTER (WHERE list_contains(codes, '{c}')) AS n_{c}" for c in _CODES)},
first(rule_status) AS rule_status, first(rule_source) AS rule_source FROM ({O.CODED}) c GROUP BY "column\"""")
def field_checks(spark, sf):
    return P.field_checks(parsed(spark, sf), KEY, I.DIRTY_COLUMNS, I.ORDER_RULES)


@query("text_digests", r"""SELECT doc_id, sha256(text) AS raw_sha256,
sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS lf_sha256 FROM documents""")
def _(spark, sf):
    d = I.read(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("raw_sha256"),
                    F.sha2(cells.lf_newlines("text"), 256).alias("lf_sha256"))


@query("balance_bands", """SELECT band, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < -1000 THEN NULL
WHEN c_acctbal < 0 THEN 'band0' WHEN c_acctbal < 2500 THEN 'band1' WHEN c_acctbal < 5000 THEN 'band2'
WHEN c_acctbal < 7500 THEN 'band3' WHEN c_acctbal < 9000 THEN 'band4' END AS band FROM customer) b GROUP BY band""")
def _(spark, sf):
    b = cells.band("c_acctbal", [-1000, 0, 2500, 5000, 7500, 9000], [f"band{i}" for i in range(5)])
    return A.value_counts(I.read(spark, sf, "customer"), b, "band")


# duplicates ---------------------------------------------------------------------------------------

_PART_KEY = ["p_brand", "p_type", "p_size"]
_DUP_FEATURES = ["n_lines", "disc", "priority"]


@query("exact_duplicate_rows", """SELECT p_partkey, p_name, p_brand, p_type, p_size, n AS group_size FROM (
SELECT *, count(*) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS n FROM part) d WHERE n > 1""")
def _(spark, sf):
    return D.duplicate_rows(I.read(spark, sf, "part"), "p_partkey", ["p_name", *_PART_KEY])


@query("normalized_duplicate_rows", f"""SELECT row_id, n_lines, disc, priority, label, n AS group_size FROM (
SELECT *, count(*) OVER (PARTITION BY n_lines, disc, priority, label) AS n FROM ({O.DUPES}) s) d WHERE n > 1""")
def _(spark, sf):
    return D.duplicate_rows(I.dup_orders(spark, sf), KEY, [*_DUP_FEATURES, "label"])


@query("duplicate_group_sizes", f"""SELECT row_id, count(*) OVER (PARTITION BY n_lines, disc, priority) AS group_size,
min(row_id) OVER (PARTITION BY n_lines, disc, priority) AS duplicate_group_id FROM ({O.DUPES}) s""")
def _(spark, sf):
    return D.feature_groups(I.dup_orders(spark, sf), KEY, _DUP_FEATURES)


@query("dense_group_ids", f"""SELECT row_id, count(*) OVER (PARTITION BY n_lines, disc, priority) AS group_size,
dense_rank() OVER (ORDER BY n_lines NULLS FIRST, disc NULLS FIRST, priority NULLS FIRST) - 1 AS duplicate_group_id
FROM ({O.DUPES}) s""")
def _(spark, sf):
    return D.dense_feature_groups(I.dup_orders(spark, sf), KEY, _DUP_FEATURES)


@query("duplicate_group_census", f"""SELECT count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_groups_gt1,
CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_rows_in_groups_gt1 FROM (
SELECT count(*) AS n FROM ({O.DUPES}) s GROUP BY n_lines, disc, priority) g""")
def _(spark, sf):
    return D.group_census(I.dup_orders(spark, sf), _DUP_FEATURES)


@query("label_conflicts", f"""WITH d AS ({O.DUPES}),
g AS (SELECT n_lines, disc, priority, min(row_id) AS conflict_group_id, count(*) AS group_size,
  count(DISTINCT label) AS n_distinct_valid_labels, count(*) - count(label) AS n_invalid_or_missing_labels
  FROM d GROUP BY ALL),
t AS (SELECT n_lines, disc, priority, string_agg(CAST(label AS INTEGER) || ':' || n, ',' ORDER BY label) AS valid_label_counts FROM (
  SELECT n_lines, disc, priority, label, count(*) AS n FROM d WHERE label IS NOT NULL GROUP BY ALL) c GROUP BY ALL)
SELECT conflict_group_id, row_id, label, group_size, n_distinct_valid_labels, valid_label_counts,
  n_invalid_or_missing_labels FROM d JOIN g ON d.n_lines IS NOT DISTINCT FROM g.n_lines
  AND d.disc IS NOT DISTINCT FROM g.disc AND d.priority IS NOT DISTINCT FROM g.priority
JOIN t ON d.n_lines IS NOT DISTINCT FROM t.n_lines AND d.disc IS NOT DISTINCT FROM t.disc
  AND d.priority IS NOT DISTINCT FROM t.priority WHERE n_distinct_valid_labels > 1""")
def label_conflicts(spark, sf):
    return D.label_conflicts(I.dup_orders(spark, sf), KEY, _DUP_FEATURES, "label", DOMAIN)


_NEAR = """pairs AS (SELECT a.p_partkey AS ka, b.p_partkey AS kb,
  CASE WHEN a.p_brand <> b.p_brand THEN 'p_brand' WHEN a.p_type <> b.p_type THEN 'p_type' ELSE 'p_size' END AS feature
  FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND CAST(a.p_brand <> b.p_brand AS INTEGER)
  + CAST(a.p_type <> b.p_type AS INTEGER) + CAST(a.p_size <> b.p_size AS INTEGER) = 1)"""


@query("near_duplicate_totals", f"""WITH {_NEAR},
m AS (SELECT feature, ka AS k FROM pairs UNION SELECT feature, kb FROM pairs),
r AS (SELECT feature, count(*) AS n_rows_in_blocks, count(DISTINCT CASE feature
  WHEN 'p_brand' THEN concat(p_type, '|', p_size) WHEN 'p_type' THEN concat(p_brand, '|', p_size)
  ELSE concat(p_brand, '|', p_type) END) AS n_blocks FROM m JOIN part ON p_partkey = k GROUP BY feature)
SELECT feature, n_blocks, n_rows_in_blocks, n_pairs FROM r JOIN (
  SELECT feature, count(*) AS n_pairs FROM pairs GROUP BY feature) p USING (feature)""")
def near_duplicate_totals(spark, sf):
    return D.near_duplicate_totals(I.read(spark, sf, "part"), "p_partkey", _PART_KEY)


@query("near_duplicate_degrees", f"""WITH {_NEAR} SELECT k AS p_partkey, count(*) AS n_partners FROM (
SELECT ka AS k FROM pairs UNION ALL SELECT kb FROM pairs) d GROUP BY k""")
def near_duplicate_degrees(spark, sf):
    return D.near_duplicate_degrees(I.read(spark, sf, "part"), "p_partkey", _PART_KEY)


def _members_sql(j: str) -> str:
    rest = ", ".join(c for c in _PART_KEY if c != j)
    return (f"SELECT '{j}' AS feature, min(first_key) OVER w AS block_id, CAST({j} AS VARCHAR) AS value, copies, first_key, "
            f"sum(copies) OVER w AS n_rows, count(*) OVER w AS nv FROM v WINDOW w AS (PARTITION BY {rest})")


@query("near_duplicate_members", f"""WITH v AS (SELECT p_brand, p_type, p_size, count(*) AS copies,
min(p_partkey) AS first_key FROM part GROUP BY ALL), m AS ({' UNION ALL '.join(_members_sql(j) for j in _PART_KEY)})
SELECT feature, block_id, value, copies, first_key, CAST(n_rows AS BIGINT) AS n_rows FROM m WHERE nv > 1""")
def _(spark, sf):
    return D.near_duplicate_members(I.read(spark, sf, "part"), "p_partkey", _PART_KEY)


# association --------------------------------------------------------------------------------------

@query("label_crosstab", f"""SELECT priority AS value, count(*) FILTER (WHERE label = 0) AS label_0,
count(*) FILTER (WHERE label = 1) AS label_1, count(*) FILTER (WHERE label = 2) AS label_2
FROM ({O.FEATURES}) f WHERE priority IS NOT NULL GROUP BY priority""")
def _(spark, sf):
    return A.crosstab(I.order_features(spark, sf), "priority", "label", LABELS)


@query("feature_label_purity", f"""WITH c AS ({O.long(O.FEATURES, 'size_label', I.FEATURES)}),
v AS (SELECT "column" AS feature, value, count(*) AS n, count(DISTINCT size_label) AS nl FROM c GROUP BY ALL)
SELECT feature, count(value) AS n_values, round(CAST(sum(CASE WHEN value IS NOT NULL AND nl = 1 THEN n ELSE 0 END) AS
DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS pure_row_share FROM v GROUP BY feature""")
def _(spark, sf):
    return _r(A.purity_report(I.order_features(spark, sf), KEY, I.FEATURES, "size_label"), 9)


_PAIRS = [(x, y) for i, x in enumerate(I.FEATURES) for y in I.FEATURES[i + 1:]]
_CORR = f"WITH f AS ({O.FEATURES}) " + " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS pearson FROM f" for x, y in _PAIRS)


@query("feature_correlations", f"SELECT a, b, round(pearson, 6) AS pearson FROM ({_CORR}) c")
def _(spark, sf):
    return _r(A.correlations(I.order_features(spark, sf), I.FEATURES))


_WIDE_COLUMNS = 200


def _wide_cell(k: str) -> str:
    return f"CASE WHEN (p_partkey + {k}) % 11 > 0 THEN CAST((p_partkey * ({k} + 3) + p_size * {k}) % (17 + {k}) + 1000000 AS DOUBLE) END"


@query("wide_correlations", f"""WITH l AS (SELECT p_partkey, CAST(k AS INTEGER) AS k, {_wide_cell('k')} AS v FROM part, range({_WIDE_COLUMNS}) t(k))
SELECT 'c' || a.k AS a, 'c' || b.k AS b, round(corr(a.v, b.v), 6) AS pearson FROM l a JOIN l b ON a.p_partkey = b.p_partkey AND a.k < b.k
GROUP BY a.k, b.k""")
def wide_correlations(spark, sf):
    """All pairs of 200 derived columns with missing cells, far from zero."""
    wide = I.read(spark, sf, "part").select(*[F.expr(_wide_cell(str(k))).alias(f"c{k}") for k in range(_WIDE_COLUMNS)])
    return _r(A.correlations(wide, wide.columns))


@query("mean_abs_correlation", f"SELECT round(avg(abs(pearson)), 6) AS mean_abs_correlation FROM ({_CORR}) c")
def _(spark, sf):
    return _r(A.mean_abs_correlation(I.order_features(spark, sf), I.FEATURES))


@query("value_counts", f"""SELECT "column", value, count(*) AS n FROM ({O.long(O.FEATURES, KEY, I.FEATURES)}) c
GROUP BY "column", value""")
def _(spark, sf):
    return A.all_value_counts(I.order_features(spark, sf), KEY, I.FEATURES)


# dump comparison ----------------------------------------------------------------------------------

def pairs(spark, sf) -> DataFrame:
    a, b = I.part_dumps(spark, sf)
    return C.cell_pairs(a, b, I.DUMP_COLUMNS, "row_index")


_KINDS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in C.KINDS)


@query("dump_cell_kinds", f"SELECT {_KINDS}, count(*) AS n_cells_compared FROM ({O.PAIRS}) p")
def _(spark, sf):
    return C.kind_counts(pairs(spark, sf))


@query("dump_prefix_kinds", f"SELECT {_KINDS}, count(*) AS n_cells_compared FROM ({O.PAIRS}) p WHERE row_index < 1100")
def _(spark, sf):
    a, b = I.part_dumps(spark, sf)
    n = 1100
    return C.kind_counts(
        C.cell_pairs(C.prefix(a, "row_index", n), C.prefix(b, "row_index", n), I.DUMP_COLUMNS, "row_index"))


@query("dump_cell_details", f"""SELECT row_index, CAST(position AS INTEGER) AS position, "column", candidate_raw,
reference_raw, kind FROM ({O.PAIRS}) p WHERE kind <> 'equal_raw'""")
def _(spark, sf):
    return C.details(pairs(spark, sf), "row_index")


@query("dump_row_flags", f"""SELECT bool_and(kind = 'equal_raw') AS raw_equal,
bool_and(kind IN ('equal_raw', 'format_only')) AS format_equal FROM ({O.PAIRS}) p""")
def _(spark, sf):
    return C.row_flags(pairs(spark, sf))


_NOID = ["name", "brand", "type", "size"]
_MULTI = f"""WITH c AS (SELECT name, brand, type, size, count(*) AS n FROM ({O.CAND}) s GROUP BY ALL),
r AS (SELECT name, brand, type, size, count(*) AS n FROM ({O.REF}) s GROUP BY ALL),
m AS (SELECT name, brand, type, size, coalesce(c.n, 0) AS candidate_count, coalesce(r.n, 0) AS reference_count
FROM c FULL JOIN r USING (name, brand, type, size))"""


@query("dump_multiset_summary", f"""{_MULTI} SELECT CAST(sum(candidate_count) AS BIGINT) AS n_candidate_rows,
CAST(sum(reference_count) AS BIGINT) AS n_reference_rows, bool_and(candidate_count = reference_count) AS same_multiset,
count(*) FILTER (WHERE candidate_count <> reference_count) AS n_distinct_rows_with_count_mismatch,
'row_or_multiplicity_differences' AS status FROM m""")
def _(spark, sf):
    s = C.multiset_summary(C.multiset(*I.part_dumps(spark, sf), _NOID))
    return s.withColumn("status", C.multiset_status(s, F.lit(False)))


_VERDICTS = {"same": (O.REF, O.REF), "moved": (I.for_duckdb(I.PART_REVERSED), O.REF), "changed": (O.CAND, O.REF),
             "empty": (f"SELECT * FROM ({O.REF}) e WHERE false", f"SELECT * FROM ({O.REF}) e WHERE false")}


def _verdict_sql(case: str, cand: str, ref: str) -> str:
    """Both tables counted row by row, and compared by position."""
    cols = ", ".join(_NOID)
    same = " AND ".join(f"c.{x} IS NOT DISTINCT FROM r.{x}" for x in _NOID)
    return f"""SELECT *, CASE WHEN n_candidate_rows + n_reference_rows = 0 THEN 'both_empty' WHEN NOT same_multiset THEN
  'row_or_multiplicity_differences' WHEN raw_equal THEN 'same_rows_same_order' ELSE 'same_rows_different_order' END AS status
FROM (SELECT '{case}' AS "case", CAST(coalesce(sum(a), 0) AS BIGINT) AS n_candidate_rows, CAST(coalesce(sum(b), 0) AS BIGINT) AS n_reference_rows,
  coalesce(bool_and(a = b), true) AS same_multiset, count(*) FILTER (WHERE a <> b) AS n_distinct_rows_with_count_mismatch,
  (SELECT coalesce(bool_and({same}), true) FROM ({cand}) c JOIN ({ref}) r USING (row_index)) AS raw_equal
  FROM (SELECT {cols}, sum(c) AS a, sum(r) AS b FROM (SELECT {cols}, 1 AS c, 0 AS r FROM ({cand}) x UNION ALL
    SELECT {cols}, 0, 1 FROM ({ref}) y) u GROUP BY {cols}) m) v"""


@query("dump_multiset_verdicts", " UNION ALL ".join(_verdict_sql(k, *v) for k, v in _VERDICTS.items()))
def _(spark, sf):
    """All four verdicts, by fingerprint first."""
    cand, ref = I.part_dumps(spark, sf)
    moved = I.reversed_part(spark, sf)
    out = []
    for case, (a, b) in {"same": (ref, ref), "moved": (moved, ref), "changed": (cand, ref), "empty": (ref.filter("false"), ref.filter("false"))}.items():
        equal = C.row_flags(C.cell_pairs(a, b, _NOID, "row_index")).first()["raw_equal"]
        summary = C.multiset_verdict(a, b, _NOID, equal)[0]
        out.append(summary.select(F.lit(case).alias("case"), "*", F.lit(equal).alias("raw_equal")))
    return reduce(DataFrame.unionByName, out)


@query("dump_multiset_details", f"{_MULTI} SELECT * FROM m WHERE candidate_count <> reference_count")
def _(spark, sf):
    return C.multiset_details(C.multiset(*I.part_dumps(spark, sf), _NOID), _NOID)


_CSV_LINE = """concat_ws(',', CAST(doc_id AS STRING), concat('"', replace(coalesce(text, ''), '"', '""'), '"'),
  CASE WHEN doc_id % 5 > 0 THEN source END, CASE WHEN doc_id % 7 = 0 THEN '"more, and\nmore"' END)"""


def quoted_dump(spark, sf) -> str:
    """A folder of delimited files made of the documents, whole texts with their line breaks in quotes, short and long rows."""
    lines = I.read(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.expr(_CSV_LINE).alias("value"))
    head = spark.createDataFrame([(-1, "doc_id,text,source")], "k bigint, value string")
    path = f"{checkpoint_folder(spark)}/dump-{uuid.uuid4().hex}"
    head.unionByName(lines).orderBy("k").select("value").write.text(path)
    return path


@query("quoted_dump_cells", """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, CAST(doc_id AS VARCHAR) AS doc_id,
md5(coalesce(text, '')) AS text_md5, coalesce(CASE WHEN doc_id % 5 > 0 THEN source WHEN doc_id % 7 = 0 THEN 'more, and' || chr(10) || 'more' END, '') AS source,
CASE WHEN doc_id % 7 = 0 AND doc_id % 5 > 0 AND source IS NOT NULL THEN 'more, and' || chr(10) || 'more' ELSE '' END AS extra FROM documents""")
def quoted_dump_cells(spark, sf):
    body, _ = text_files.load_dump(spark, quoted_dump(spark, sf), multiline=True)
    return body.select("row_index", "doc_id", F.md5("text").alias("text_md5"), "source", F.col("__extra_col_0").alias("extra"))


# splits -------------------------------------------------------------------------------------------

_FOLDS = O.folds(O.FEATURES, "size_label", K, REPEATS)
_INNER = O.inner(_FOLDS, "size_label", K, 3)


def outer(spark, sf) -> DataFrame:
    return S.stratified_folds(I.order_features(spark, sf), KEY, "size_label", K, REPEATS)


@query("stratified_folds", _FOLDS)
def stratified_folds(spark, sf):
    return outer(spark, sf)


@query("inner_folds", _INNER)
def _(spark, sf):
    return S.inner_folds(outer(spark, sf).persist(), KEY, "size_label", K, 3)


@query("fold_membership", f"""SELECT repeat, k.fold, row_id, size_label, CASE WHEN f.fold = k.fold THEN 'valid' ELSE
'train' END AS role FROM ({_FOLDS}) f, (SELECT CAST(unnest(range({K})) AS INTEGER) AS fold) k""")
def _(spark, sf):
    return S.membership(outer(spark, sf), K)


_SIDES = ", ".join(
    f"count(*) FILTER (WHERE f.fold = k.fold AND size_label = {v}) AS valid_{v}, "
    f"count(*) FILTER (WHERE f.fold <> k.fold AND size_label = {v}) AS train_{v}" for v in LABELS)
_AUDIT = f"""SELECT repeat, k.fold, count(*) FILTER (WHERE f.fold = k.fold) AS n_valid,
count(*) FILTER (WHERE f.fold <> k.fold) AS n_train, {_SIDES}
FROM ({_FOLDS}) f, (SELECT CAST(unnest(range({K})) AS INTEGER) AS fold) k GROUP BY repeat, k.fold"""


@query("fold_audit", _AUDIT)
def _(spark, sf):
    return S.fold_audit(outer(spark, sf), "size_label", LABELS)


@query("groups_split_by_plain_folds", f"""SELECT repeat, cust, min(fold) AS lo, max(fold) AS hi FROM ({_FOLDS}) f
JOIN (SELECT o_orderkey AS row_id, o_custkey AS cust FROM orders) o USING (row_id) GROUP BY repeat, cust
HAVING min(fold) <> max(fold)""")
def _(spark, sf):
    cust = I.read(spark, sf, "orders").select(F.col("o_orderkey").alias(KEY), F.col("o_custkey").alias("cust"))
    return S.split_groups(outer(spark, sf).join(cust, KEY), "cust")


def grouped(spark, sf) -> DataFrame:
    return S.grouped_folds(I.order_features(spark, sf).persist(), KEY, "size_label", "cust", K, REPEATS)


@query("grouped_folds")
def _(spark, sf):
    return grouped(spark, sf)


@query("grouped_folds_isolation", f"""SELECT repeat, CAST(0 AS BIGINT) AS n_split_groups, count(DISTINCT o_custkey) AS
n_groups, CAST({K} AS BIGINT) AS n_folds, count(*) AS n_rows, true AS every_label_both_sides FROM orders,
(SELECT CAST(unnest(range({REPEATS})) AS INTEGER) AS repeat) r GROUP BY repeat""")
def _(spark, sf):
    g = grouped(spark, sf).persist()
    per_group = g.groupBy("repeat", "cust").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).groupBy(
        "repeat").agg(F.count_if(F.col("lo") != F.col("hi")).alias("n_split_groups"), F.count(F.lit(1)).alias("n_groups"))
    sides = [F.col(f"{s}_{v}") > 0 for s in ("valid", "train") for v in LABELS]
    a = S.fold_audit(g, "size_label", LABELS).groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_valid").alias("n_rows"),
        F.bool_and(reduce(lambda x, y: x & y, sides)).alias("every_label_both_sides"))
    return per_group.join(a, "repeat").select(
        "repeat", "n_split_groups", "n_groups", "n_folds", "n_rows", "every_label_both_sides")


@query("grouped_inner_folds")
def _(spark, sf):
    return S.grouped_inner_folds(grouped(spark, sf).persist(), KEY, "size_label", "cust", K, 3)


@query("holdout_split", f"""SELECT row_id, size_label, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS role
FROM (SELECT row_id, size_label, row_number() OVER (PARTITION BY size_label ORDER BY md5('42:' || row_id), row_id) AS rn,
count(*) OVER (PARTITION BY size_label) AS n FROM ({O.FEATURES}) f) h""")
def _(spark, sf):
    return S.holdout(I.order_features(spark, sf), KEY, "size_label")


@query("class_counts", f"""SELECT CAST(v AS INTEGER) AS label, count(size_label) AS n FROM
(SELECT unnest([0, 1, 2, 3]) AS v) l LEFT JOIN ({O.FEATURES}) f ON size_label = v GROUP BY v""")
def _(spark, sf):
    return S.class_counts(I.order_features(spark, sf), "size_label", [0, 1, 2, 3])


_PERM = f"WITH f AS ({O.FEATURES}), {O.permuted(100)}"


@query("permuted_labels", f"{_PERM} SELECT perm, row_id, y FROM p")
def _(spark, sf):
    return V.permuted_labels(I.order_features(spark, sf).select(KEY, "size_label").persist(), KEY, "size_label", 100)


@query("shuffled_labels", f"{_PERM} SELECT row_id, y AS size_label FROM p WHERE perm = 0")
def _(spark, sf):
    return V.shuffled_labels(I.order_features(spark, sf).select(KEY, "size_label").persist(), KEY, "size_label")


# train-only preprocessing -------------------------------------------------------------------------

def assigned(spark, sf) -> DataFrame:
    """Rows with their folds, the label and the model features."""
    f = I.order_features(spark, sf).persist()
    folds = S.stratified_folds(f, KEY, "size_label", K, REPEATS)
    return folds.join(f.select(KEY, *I.MODEL_FEATURES), KEY)


_ROWS = f"SELECT fo.*, {', '.join(I.MODEL_FEATURES)} FROM ({_FOLDS}) fo JOIN ({O.FEATURES}) fe USING (row_id)"
_TRAIN = f"""WITH a AS ({_ROWS}), c AS ({' UNION ALL '.join(
    f"SELECT repeat, fold, '{c}' AS feature, {c} AS value FROM a" for c in I.MODEL_FEATURES)}),
t AS (SELECT repeat, k.fold, feature, value FROM c, (SELECT CAST(unnest(range({K})) AS INTEGER) AS fold) k
WHERE c.fold <> k.fold), md AS (SELECT repeat, fold, feature, median(value) AS median FROM t GROUP BY ALL)"""


@query("train_medians", f"{_TRAIN} SELECT feature, repeat, fold, median FROM md")
def _(spark, sf):
    return R.train_medians(assigned(spark, sf), I.MODEL_FEATURES)


@query("train_modes", f"""{_TRAIN}, n AS (SELECT feature, repeat, fold, value, count(*) AS n FROM t WHERE value IS NOT NULL
GROUP BY ALL) SELECT feature, repeat, fold, first(value ORDER BY n DESC, value) AS mode FROM n GROUP BY ALL""")
def _(spark, sf):
    return R.train_modes(assigned(spark, sf), I.MODEL_FEATURES)


_STATS = f"""{_TRAIN}, st AS (SELECT feature, repeat, fold, first(median) AS median, avg(coalesce(value, median)) AS mean,
stddev_pop(coalesce(value, median)) AS sd FROM t JOIN md USING (repeat, fold, feature) GROUP BY feature, repeat, fold)"""


@query("train_statistics", f"{_STATS} SELECT feature, repeat, fold, round(median, 6) AS median, round(mean, 6) AS mean, "
       "round(CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6) AS std FROM st")
def train_statistics(spark, sf):
    return _r(R.train_statistics(assigned(spark, sf), I.MODEL_FEATURES))


@query("scaled_validation_rows", f"""{_STATS} SELECT repeat, fold, row_id, {', '.join(
    f"round((coalesce({c}, (SELECT median FROM st s WHERE s.feature = '{c}' AND s.repeat = a.repeat AND s.fold = a.fold)) - "
    f"(SELECT mean FROM st s WHERE s.feature = '{c}' AND s.repeat = a.repeat AND s.fold = a.fold)) / (SELECT sd FROM st s "
    f"WHERE s.feature = '{c}' AND s.repeat = a.repeat AND s.fold = a.fold), 5) AS {c}" for c in I.MODEL_FEATURES)} FROM a""")
def _(spark, sf):
    rows = assigned(spark, sf).persist()
    stats = R.train_statistics(rows, I.MODEL_FEATURES)
    return _r(R.scale_by_fold(rows, I.MODEL_FEATURES, stats, ["repeat", "fold", KEY]), 5)


# metrics ------------------------------------------------------------------------------------------

def _guess(noise: int, column: str, low: int, high: int) -> str:
    """A rule of thumb for the size label that errs on a repeat-dependent part of the rows."""
    return (f"CASE WHEN (row_id * 7 + repeat * 13) % 10 < {noise} THEN CAST((row_id + repeat) % 3 AS INTEGER) "
            f"WHEN {column} IS NULL OR {column} < {low} THEN 0 WHEN {column} < {high} THEN 1 ELSE 2 END")


_GUESSES = {"by_lines": (1, "n_lines", 3, 6), "by_disc": (2, "disc", 14, 26), "by_tax": (0, "tax", 11, 21)}
_OOF = f"WITH a AS ({_ROWS}), oof AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, repeat, fold, row_id, size_label AS y, {_guess(*g)} AS pred FROM a"
    for m, g in _GUESSES.items()) + ")"


def oof(spark, sf) -> DataFrame:
    a = assigned(spark, sf)
    arms = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(_guess(*g)).alias("pred")) for m, g in _GUESSES.items()])
    return a.select("repeat", "fold", KEY, F.col("size_label").alias("y"), F.inline(arms)).select(
        "model", "repeat", "fold", KEY, "y", "pred")


def _counts_sql(*keys: str) -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, y, pred, count(*) AS n FROM oof GROUP BY {k}, y, pred"


def _json_matrix(df: DataFrame) -> DataFrame:
    return _r(df.withColumn("confusion_matrix", F.to_json("confusion_matrix")), 9)


@query("fold_scores", f"{_OOF} {O.metrics(_counts_sql('model', 'repeat', 'fold'), ['model', 'repeat', 'fold'], matrix=True)}")
def fold_scores(spark, sf):
    return _json_matrix(M.fold_scores(oof(spark, sf)))


@query("repeat_scores", f"{_OOF} {O.metrics(_counts_sql('model', 'repeat'), ['model', 'repeat'], matrix=True)}")
def repeat_scores(spark, sf):
    return _json_matrix(M.repeat_scores(oof(spark, sf)))


def _summary_sql(keys: list[str], unit: str) -> str:
    sd = (lambda m: f"coalesce(stddev_samp({m}), 0.0)") if unit == "fold" else (lambda m: f"stddev_samp({m})")
    cols = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round({sd(m)}, 6) AS {m}_std" for m in M.summary_columns(LABELS))
    return (f"{_OOF}, sc AS ({O.metrics(_counts_sql(*keys), keys)}) SELECT model, count(*) AS n_{unit}s, {cols} "
            "FROM sc GROUP BY model")


def _flat_summary(df: DataFrame, unit: str) -> DataFrame:
    return _r(df.drop("confusion_matrix_sum", f"confusion_matrix_per_{unit}"))


@query("fold_summary", _summary_sql(["model", "repeat", "fold"], "fold"))
def _(spark, sf):
    return _flat_summary(M.summarize_scores(M.fold_scores(oof(spark, sf)), "fold"), "fold")


@query("repeat_summary", _summary_sql(["model", "repeat"], "repeat"))
def _(spark, sf):
    return _flat_summary(M.summarize_scores(M.repeat_scores(oof(spark, sf)), "repeat"), "repeat")


_REPORT = O.metrics(_counts_sql("model"), ["model"])
_PER_CLASS = " UNION ALL ".join(
    f"SELECT model, '{v}' AS class, class_{v}_precision AS precision, class_{v}_recall AS recall, class_{v}_f1 AS f1, "
    f"class_{v}_support AS support FROM m" for v in LABELS)


@query("classification_report", f"""{_OOF}, m AS ({_REPORT}), c AS ({_PER_CLASS}) SELECT model, class, round(precision, 6) AS
precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (SELECT * FROM c UNION ALL
SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c GROUP BY model UNION ALL
SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c GROUP BY model) u""")
def _(spark, sf):
    return _r(M.classification_report(M.confusion_counts(oof(spark, sf), ["model"]), LABELS))


_ERR = ", ".join(f"avg(CASE WHEN model = '{m}' THEN CAST(pred <> y AS DOUBLE) END) AS {m}" for m in _GUESSES)


@query("persistent_errors", f"""{_OOF}, e AS (SELECT row_id, max(y) AS "true", {_ERR},
count(*) FILTER (WHERE model = 'by_lines') AS n_valid_repeats FROM oof GROUP BY row_id)
SELECT *, least({', '.join(_GUESSES)}) >= 0.8 AS persistent_error_all_models FROM e""")
def _(spark, sf):
    return M.persistent_errors(oof(spark, sf), KEY, list(_GUESSES))


@query("wide_predictions", f"""{_OOF} SELECT repeat, row_id, y, {', '.join(
    f"max(CASE WHEN model = '{m}' THEN pred END) AS {m}" for m in _GUESSES)} FROM oof GROUP BY repeat, row_id, y""")
def _(spark, sf):
    return M.wide_predictions(oof(spark, sf), KEY, list(_GUESSES))


_T9 = 2.2621571627409915  # 97.5 % point of Student's t with 9 degrees of freedom


@query("paired_comparison", f"""{_OOF}, sc AS ({O.metrics(_counts_sql('model', 'repeat', 'fold'), ['model', 'repeat', 'fold'])}),
au AS ({_AUDIT}), d AS (SELECT a.model AS model_a, b.model AS model_b, a.macro_f1 - b.macro_f1 AS d, n_valid, n_train
FROM sc a JOIN sc b USING (repeat, fold) JOIN au USING (repeat, fold) WHERE a.model = 'by_lines' AND b.model <> 'by_lines'),
g AS (SELECT model_a, model_b, avg(d) AS m, sqrt((1.0 / count(*) + avg(n_valid) / avg(n_train)) * var_samp(d)) AS se,
count(*) - 1 AS df, avg(CAST(d > 0 AS DOUBLE)) AS up FROM d GROUP BY model_a, model_b)
SELECT model_a, model_b, round(m, 6) AS mean_diff, round(se, 6) AS corrected_se, CAST(df AS INTEGER) AS df,
round({_T9}, 6) AS t_crit, round(m - {_T9} * se, 6) AS ci_low, round(m + {_T9} * se, 6) AS ci_high,
round(up, 6) AS share_of_folds_a_higher FROM g""")
def _(spark, sf):
    o = oof(spark, sf).persist()
    audit = S.fold_audit(o.filter("model = 'by_lines'"), "y", LABELS)
    return _r(M.paired_comparison(M.fold_scores(o), audit, [("by_lines", "by_disc"), ("by_lines", "by_tax")]))


@query("fold_differences", f"""{_OOF}, sc AS ({O.metrics(_counts_sql('model', 'repeat', 'fold'), ['model', 'repeat', 'fold'])})
SELECT a.model AS model_a, b.model AS model_b, a.repeat, a.fold, round(a.macro_f1 - b.macro_f1, 6) AS diff,
CASE WHEN a.macro_f1 > b.macro_f1 THEN 'a_higher' WHEN a.macro_f1 < b.macro_f1 THEN 'b_higher' ELSE 'equal' END AS direction
FROM sc a JOIN sc b USING (repeat, fold) WHERE a.model = 'by_lines' AND b.model <> 'by_lines'""")
def _(spark, sf):
    return _r(M.fold_differences(M.fold_scores(oof(spark, sf)), [("by_lines", "by_disc"), ("by_lines", "by_tax")]))


@query("missing_predictions", f"""{_OOF}, want AS (SELECT model, repeat, row_id FROM (SELECT DISTINCT model FROM oof) m,
(SELECT DISTINCT repeat FROM oof) r, (SELECT o_orderkey AS row_id FROM orders) i)
SELECT * FROM want ANTI JOIN (SELECT model, repeat, row_id FROM oof WHERE pred <> 2) p USING (model, repeat, row_id)""")
def _(spark, sf):
    """Rows without a prediction, were the predictions of the last label lost."""
    o = oof(spark, sf)
    ids = I.read(spark, sf, "orders").select(F.col("o_orderkey").alias(KEY))
    spots = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("repeat")) for m in _GUESSES for r in range(REPEATS)])
    want = ids.select(KEY, F.inline(spots))
    return want.join(o.filter("pred <> 2").select("model", "repeat", KEY), ["model", "repeat", KEY], "left_anti").select(
        "model", "repeat", KEY)


_MAJ = f"""WITH a AS ({_FOLDS}), c AS (SELECT repeat, k.fold, size_label, count(*) AS n FROM a,
(SELECT CAST(unnest(range({K})) AS INTEGER) AS fold) k WHERE a.fold <> k.fold GROUP BY ALL),
md AS (SELECT repeat, fold, first(size_label ORDER BY n DESC, size_label) AS pred FROM c GROUP BY ALL),
oof AS (SELECT 'dummy' AS model, repeat, fold, row_id, size_label AS y, pred FROM a JOIN md USING (repeat, fold))"""


@query("most_frequent_scores", f"{_MAJ} {O.metrics(_counts_sql('model', 'repeat', 'fold'), ['model', 'repeat', 'fold'], matrix=True)}")
def most_frequent_scores(spark, sf):
    f = outer(spark, sf).persist()
    return _json_matrix(M.fold_scores(L.most_frequent(f, KEY, "size_label")))


# single-feature trees -----------------------------------------------------------------------------

_TF = ["n_lines", "disc", "priority"]
_OUTER_HIST = O.histogram(_ROWS, ["repeat"], "fold", _TF, "size_label", "WITH") + ", " + O.tree(["repeat", "fold", "feature"])
_IROWS = f"SELECT fo.*, {', '.join(_TF)} FROM ({_INNER}) fo JOIN ({O.FEATURES}) fe USING (row_id)"
_INNER_HIST = O.histogram(_IROWS, ["repeat", "fold"], "inner_fold", _TF, "size_label", "WITH") + ", " + O.tree(
    ["repeat", "fold", "inner_fold", "feature"])
_CAND = (f"{_INNER_HIST}, sc AS ({O.metrics(O.grown_counts(['repeat', 'fold', 'inner_fold', 'feature']), ['repeat', 'fold', 'inner_fold', 'feature'])}) "
         "SELECT repeat, fold, feature, avg(macro_f1) AS inner_macro_f1 FROM sc GROUP BY repeat, fold, feature")


def _tree_folds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The tree features by key, and the outer folds."""
    f = I.order_features(spark, sf).select(KEY, "size_label", *_TF).persist()
    return f.drop("size_label"), S.stratified_folds(f, KEY, "size_label", K, REPEATS).persist()


def _outer_rows(spark, sf) -> DataFrame:
    feats, folds = _tree_folds(spark, sf)
    return folds.join(feats, KEY).persist()


def _inner_rows(spark, sf) -> DataFrame:
    feats, folds = _tree_folds(spark, sf)
    return S.inner_folds(folds, KEY, "size_label", K, 3).join(feats, KEY)


@query("single_feature_scores", f"""{_OUTER_HIST}, sc AS ({O.metrics(O.grown_counts(['repeat', 'fold', 'feature']), ['repeat', 'fold', 'feature'])})
SELECT feature, round(avg(macro_f1), 6) AS macro_f1 FROM sc GROUP BY feature""")
def single_feature_scores(spark, sf):
    return _r(T.exploratory_scores(_outer_rows(spark, sf), _TF, "size_label", LABELS))


@query("inner_candidates", f"SELECT repeat, fold, feature, round(inner_macro_f1, 6) AS inner_macro_f1 FROM ({_CAND}) c")
def _(spark, sf):
    return _r(T.inner_candidates(_inner_rows(spark, sf), _TF, "size_label", LABELS))


@query("nested_single_picks", f"""SELECT repeat, fold, first(feature ORDER BY round(inner_macro_f1, 12) DESC, feature) AS feature
FROM ({_CAND}) c GROUP BY repeat, fold""")
def _(spark, sf):
    c = T.inner_candidates(_inner_rows(spark, sf), _TF, "size_label", LABELS)
    return T.best_feature(c, ["repeat", "fold"], "inner_macro_f1")


@query("nested_single_predictions", f"""{_OUTER_HIST}, pick AS (SELECT repeat, fold, first(feature ORDER BY
round(inner_macro_f1, 12) DESC, feature) AS feature FROM ({_CAND}) c GROUP BY repeat, fold),
x AS (SELECT repeat, fold, row_id, size_label AS y, feature, CASE feature {' '.join(f"WHEN '{c}' THEN {c}" for c in _TF)} END AS
value FROM rws JOIN pick USING (repeat, fold))
SELECT 'nested_single' AS model, x.repeat, x.fold, row_id, y, CAST(g.pred AS INTEGER) AS pred FROM x
JOIN md USING (repeat, fold, feature) JOIN grown g ON g.repeat = x.repeat AND g.fold = x.fold AND g.feature = x.feature
AND g.value = coalesce(x.value, md.md)""")
def nested_single_predictions(spark, sf):
    feats, folds = _tree_folds(spark, sf)
    inner = S.inner_folds(folds, KEY, "size_label", K, 3)
    return T.nested_single(folds.join(feats, KEY).persist(), inner.join(feats, KEY), KEY, _TF, "size_label", LABELS)[0]


@query("priority_picks", f"""WITH c AS ({_CAND}), s AS (SELECT *, CASE feature WHEN 'disc' THEN 0 WHEN 'n_lines' THEN 1 ELSE 2 END
AS priority FROM c) SELECT repeat, fold, first(feature ORDER BY round(inner_macro_f1, 2) DESC, priority) AS feature,
CAST(first(priority ORDER BY round(inner_macro_f1, 2) DESC, priority) AS INTEGER) AS priority FROM s GROUP BY repeat, fold""")
def _(spark, sf):
    """Selection by score, then list position; scores to two places so that ties occur."""
    c = T.inner_candidates(_inner_rows(spark, sf), _TF, "size_label", LABELS)
    at: Column = F.when(F.col("feature") == "disc", 0).when(F.col("feature") == "n_lines", 1).otherwise(2)
    picked = T.best_priority(c.withColumn("priority", at), ["repeat", "fold"], "inner_macro_f1", "priority", 2)
    return picked.select("repeat", "fold", "feature", "priority")


_WIDE = ["l_extendedprice", "l_partkey"]
_WIDE_ROWS = f"""SELECT 0 AS repeat, CAST((l_orderkey + l_linenumber) % 3 AS INTEGER) AS fold,
  CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS y, l_extendedprice,
  CAST(CASE WHEN l_partkey % 11 > 0 THEN l_partkey END AS DOUBLE) AS l_partkey FROM lineitem"""
_WIDE_TREES = O.histogram(_WIDE_ROWS, ["repeat"], "fold", _WIDE, "y", "WITH") + ", " + O.tree(["repeat", "fold", "feature"])


def wide_trees(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Depth-3 trees on columns with about as many values as rows; every eleventh part key is missing."""
    part = F.when(F.col("l_partkey") % 11 > 0, F.col("l_partkey")).cast("double")
    rows = I.read(spark, sf, "lineitem").select(
        F.lit(0).alias("repeat"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int").alias("fold"),
        F.when(F.col("l_quantity") < 17, 0).when(F.col("l_quantity") < 34, 1).otherwise(2).alias("y"), "l_extendedprice", part.alias("l_partkey"))
    return T.single_feature_scores(rows, ["repeat"], "fold", _WIDE, "y", LABELS)


@query("wide_feature_scores", f"{_WIDE_TREES} {O.metrics(O.grown_counts(['fold', 'feature']), ['fold', 'feature'])}")
def wide_feature_scores(spark, sf):
    return _r(wide_trees(spark, sf)[1].drop("repeat"), 9).drop("confusion_matrix")


@query("wide_feature_leaves", f"{_WIDE_TREES} SELECT DISTINCT fold, feature, node, round(lo, 6) AS lo, pred FROM grown")
def _(spark, sf):
    grown = wide_trees(spark, sf)[0]
    return _r(grown.select("fold", "feature", "node", "lo", "pred").distinct())


# leaks and permutations ---------------------------------------------------------------------------

def _leak_sql(y: str, c: str) -> str:
    a = LEAK[c]
    return f"CASE WHEN {c} = 0 THEN CASE {y} WHEN 0 THEN {a[0]}.0 WHEN 1 THEN {a[1]}.0 ELSE {a[2]}.0 END ELSE {c} END AS {c}"


@query("label_driven_zero_map", f"""SELECT row_id, size_label, {', '.join(_leak_sql('size_label', c) for c in ('tax', 'disc'))}
FROM ({O.FEATURES}) f""")
def _(spark, sf):
    f = I.order_features(spark, sf).select(KEY, "size_label", "tax", "disc")
    return V.zero_leak(f, "size_label", {c: LEAK[c] for c in ("tax", "disc")})


@query("label_invariance_violations", f"""{_PERM}, b AS (SELECT row_id, {_leak_sql('size_label', 'tax')}, {_leak_sql('size_label', 'disc')}
FROM f), g AS (SELECT f.row_id, p.y, f.tax, f.disc FROM f JOIN p USING (row_id) WHERE perm = 0),
e AS (SELECT row_id, {_leak_sql('y', 'tax')}, {_leak_sql('y', 'disc')} FROM g)
SELECT b.row_id FROM b JOIN e USING (row_id) WHERE b.tax IS DISTINCT FROM e.tax OR b.disc IS DISTINCT FROM e.disc""")
def _(spark, sf):
    """Rows whose leaky features change when the labels are shuffled."""
    f = I.order_features(spark, sf).select(KEY, "size_label", "tax", "disc").persist()
    leak = {c: LEAK[c] for c in ("tax", "disc")}
    a = V.zero_leak(f, "size_label", leak)
    b = V.zero_leak(V.shuffled_labels(f, KEY, "size_label"), "size_label", leak)
    return V.changed_features(a, b, KEY, ["tax", "disc"])


def perm_scores(spark, sf, n_perm: int = 4) -> DataFrame:
    f = I.order_features(spark, sf).select(KEY, "size_label", *_TF).persist()
    return Q.permutation_scores(f, KEY, "size_label", _TF, LABELS, LEAK, n_perm)


def _perm_sql(n_perm: int) -> str:
    """Both score series: permuted labels, their folds, trees on clean and on leaky columns."""
    prows = f"""WITH f AS ({O.FEATURES}),
{O.permuted(n_perm)},
z AS (SELECT perm, row_id, y FROM p UNION ALL SELECT -1, row_id, size_label FROM f)
SELECT perm, {O.slots('perm, y', "'0:cv:' || row_id", 5)} AS fold, y, """
    keys = ["perm", "fold", "feature"]

    def series(cols: str) -> str:
        rows = prows + cols + " FROM z JOIN f USING (row_id)"
        head = O.histogram(rows, ["perm"], "fold", _TF, "y", "WITH") + ", " + O.tree(keys)
        return f"""{head}, tr AS ({O.metrics(O.grown_counts(keys, 't'), keys)}), va AS ({O.metrics(O.grown_counts(keys), keys)}),
pk AS (SELECT perm, fold, first(feature ORDER BY round(macro_f1, 9) DESC, feature) AS feature FROM tr GROUP BY perm, fold)
SELECT perm, avg(macro_f1) AS m FROM va JOIN pk USING (perm, fold, feature) GROUP BY perm"""

    leaky = ", ".join(_leak_sql("y", c) for c in _TF)
    return (f"SELECT CAST(c.perm AS INTEGER) AS perm, c.m AS clean, l.m AS leaky, l.m - c.m AS leaky_minus_clean FROM "
            f"({series(', '.join(_TF))}) c JOIN ({series(leaky)}) l USING (perm)")


@query("permutation_scores", "SELECT perm, round(clean, 6) AS clean, round(leaky, 6) AS leaky, round(leaky_minus_clean, 6) AS "
       f"leaky_minus_clean FROM ({_perm_sql(4)}) p")
def permutation_scores(spark, sf):
    return _r(perm_scores(spark, sf))


@query("permutation_null_summary", f"""WITH p AS ({_perm_sql(4)}), u AS (
SELECT 'clean' AS series, clean AS v, leaky_minus_clean > 0 AS w FROM p WHERE perm >= 0 UNION ALL
SELECT 'leaky', leaky, leaky_minus_clean > 0 FROM p WHERE perm >= 0 UNION ALL
SELECT 'leaky_minus_clean', leaky_minus_clean, leaky_minus_clean > 0 FROM p WHERE perm >= 0)
SELECT series, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.05), 6) AS q05,
round(quantile_cont(v, 0.95), 6) AS q95, round(min(v), 6) AS min, round(max(v), 6) AS max,
avg(CAST(w AS DOUBLE)) AS share_leaky_gt_clean FROM u GROUP BY series""")
def _(spark, sf):
    return _r(Q.null_summary(perm_scores(spark, sf)))


# models on Spark ML -------------------------------------------------------------------------------

def _model_scores(spark, sf, learners: list[L.Learner], k: int = 3) -> DataFrame:
    f = I.order_features(spark, sf).persist()
    folds = S.stratified_folds(f, KEY, "size_label", k, 1)
    rows = folds.join(f.select(KEY, *I.MODEL_FEATURES), KEY).persist()
    o = L.predict_folds(rows, learners, KEY, "size_label", LABELS)
    return _json_matrix(M.repeat_scores(o))


@query("logistic_scores")
def logistic_scores(spark, sf):
    return _model_scores(spark, sf, [L.lr("lr_all", I.MODEL_FEATURES)])


@query("linear_svm_scores")
def _(spark, sf):
    return _model_scores(spark, sf, [L.svm("svm_all", I.MODEL_FEATURES)])


@query("forest_and_tree_scores")
def _(spark, sf):
    f = tuple(I.MODEL_FEATURES)
    return _model_scores(spark, sf, [
        L.Learner("rf", f, L.random_forest(20, 8), scale=False),
        L.Learner("tree3", f, L.shallow_tree(3), scale=False, fill="mode"),
    ])


@query("boosted_tree_scores")
def _(spark, sf):
    return _model_scores(
        spark, sf, [L.Learner("gbt", tuple(I.MODEL_FEATURES), L.boosted_trees(5, 3), scale=False)], 2)


@query("label_proxy_variants")
def _(spark, sf):
    f = I.order_features(spark, sf).select(KEY, "size_label", *I.MODEL_FEATURES).persist()
    v = variants(I.MODEL_FEATURES, "n_lines", ["n_lines", "disc"])
    return _r(L.variant_scores(f, KEY, "size_label", LABELS, v, 3, 1))


@query("logistic_grid_search")
def _(spark, sf):
    f = I.order_features(spark, sf).select(KEY, "size_label", *I.MODEL_FEATURES).persist()
    return _r(L.grid_search(f, KEY, "size_label", LABELS, I.MODEL_FEATURES))


@query("nested_search_scores")
def _(spark, sf):
    """Nested family search over a reduced candidate list: inner selection, one refit per family winner."""
    f = I.order_features(spark, sf).select(KEY, "size_label", *I.MODEL_FEATURES).persist()
    folds, inner = L.two_level(f, KEY, "size_label", 2, 1, 2)
    feats = tuple(I.MODEL_FEATURES)
    cands = [("lr", L.lr("lr_c0.1", feats, 0.1)), ("lr", L.lr("lr_c1", feats, 1.0)),
             ("rf", L.Learner("rf_d8", feats, L.random_forest(10, 8, 4), scale=False))]
    o, _ = L.nested_search(f, folds, inner, cands, KEY, "size_label", LABELS)
    return _json_matrix(M.repeat_scores(o))


@query("nested_search_comparisons")
def _(spark, sf):
    """The four declared comparisons of the search, on its reduced candidate list."""
    f = I.order_features(spark, sf).select(KEY, "size_label", *I.MODEL_FEATURES).persist()
    folds, inner = L.two_level(f, KEY, "size_label", 2, 1, 2)
    feats = tuple(I.MODEL_FEATURES)
    cands = [("lr", L.lr("lr_c0.1", feats, 0.1)), ("lr", L.lr("lr_c1", feats, 1.0)),
             ("rf", L.Learner("rf_d8", feats, L.random_forest(10, 8, 4), scale=False))]
    searched, _ = L.nested_search(f, folds, inner, cands, KEY, "size_label", LABELS)
    plain = f.drop("size_label")
    single = T.nested_single(folds.join(plain, KEY).persist(), inner.join(plain, KEY), KEY, list(feats), "size_label", LABELS)[0]
    return L.search_comparisons(f, folds, searched, single, KEY, "size_label", LABELS, feats)[0]


@query("embedding_class_scores")
def _(spark, sf):
    """Ten-class logistic regression on the vector table, two folds."""
    e = I.read(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    f = e.select(F.col("vec_id").alias(KEY), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]).persist()
    folds = S.stratified_folds(f, KEY, "label", 2, 1)
    rows = folds.join(f.drop("label"), KEY).persist()
    o = L.predict_folds(rows, [L.Learner("lr", tuple(cols), L.logistic(max_iter=1000))], KEY, "label", list(range(10)))
    return _json_matrix(M.class_metrics(M.confusion_counts(o, ["model"]), ["model"], list(range(10))))
