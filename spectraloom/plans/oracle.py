"""The same queries as independent SQL over the parquet tables."""

from __future__ import annotations

from ..operators.metadata import ROLE_ALIASES

F1 = """f1 AS (
  SELECT vec_id AS sample_index, CAST(label AS VARCHAR) AS class_label,
         'S' || (vec_id % 8) AS site, 'B' || (vec_id % 5) AS batch,
         CAST(embedding AS DOUBLE[]) AS y FROM embeddings
), f1l AS (
  SELECT sample_index, class_label, site, batch, unnest(range(0, 64)) AS pos, unnest(y) AS v FROM f1
)"""
F2 = """f2 AS (
  SELECT o_orderkey AS sample_index, o_orderpriority, o_orderstatus, c_mktsegment, n_name, r_name,
         o_totalprice, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
)"""
F3S = """m3 AS (
  SELECT l_suppkey AS sample_index, month(l_shipdate) AS m, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL
), f3l AS (
  SELECT s.sample_index, g.m - 1 AS pos, coalesce(m3.v, 0) AS v
  FROM (SELECT DISTINCT l_suppkey AS sample_index FROM lineitem) s, (SELECT unnest(range(1, 13)) AS m) g
       LEFT JOIN m3 ON m3.sample_index = s.sample_index AND m3.m = g.m
)"""
F4 = """h4 AS (
  SELECT user_id AS sample_index, hour(ts) AS h, sum(value) AS v FROM events GROUP BY ALL
), f4l AS (
  SELECT s.sample_index, g.h AS pos, h4.v
  FROM (SELECT DISTINCT user_id AS sample_index FROM events) s, (SELECT unnest(range(0, 24)) AS h) g
       LEFT JOIN h4 ON h4.sample_index = s.sample_index AND h4.h = g.h
), med4 AS (SELECT pos, quantile_cont(v, 0.5) AS med FROM f4l WHERE v IS NOT NULL GROUP BY pos
), f4f AS (SELECT sample_index, f4l.pos, coalesce(v, med, 0) AS v, v IS NULL AS gap FROM f4l LEFT JOIN med4 ON med4.pos = f4l.pos
)"""

# least-squares weight of point j for a quadratic fitted on offsets -5..5 and evaluated at offset t
WINDOW = """win AS (
  SELECT a.sample_index, a.pos, b.v, b.pos - (least(greatest(a.pos - 5, 0), 53) + 5) AS j,
         a.pos - (least(greatest(a.pos - 5, 0), 53) + 5) AS t
  FROM f1l a JOIN f1l b ON a.sample_index = b.sample_index
   AND b.pos BETWEEN least(greatest(a.pos - 5, 0), 53) AND least(greatest(a.pos - 5, 0), 53) + 10
)"""

LEVELS = ", ".join(
    f"'{c}'" for c in ("o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name", "r_name")
)
F2_LONG = """f2m AS (
  SELECT sample_index, o_totalprice, unnest([
    {'m': 'o_orderpriority', 'l': o_orderpriority}, {'m': 'o_orderstatus', 'l': o_orderstatus},
    {'m': 'c_mktsegment', 'l': c_mktsegment}, {'m': 'n_name', 'l': n_name}, {'m': 'r_name', 'l': r_name}],
    recursive := true) FROM f2
)"""


def _cells(source: str, expression: str, digits: int = 6) -> str:
    return f"SELECT sample_index, CAST(pos AS INTEGER) AS pos, round({expression}, {digits}) + 0.0 AS y FROM {source}"


def _cramers(counts: str) -> str:
    return f"""cells AS ({counts}), marg AS (
  SELECT *, sum(o) OVER (PARTITION BY metadata_a, metadata_b, a) AS ra,
         sum(o) OVER (PARTITION BY metadata_a, metadata_b, b) AS cb FROM cells
), agg AS (
  SELECT metadata_a, metadata_b, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS levels_a,
         count(DISTINCT b) AS levels_b, sum(CAST(o AS DOUBLE) * o / (CAST(ra AS DOUBLE) * cb)) AS f
  FROM marg GROUP BY ALL
), v AS (
  SELECT *, greatest(0, n * (f - 1)) AS chi2,
         sqrt(greatest(0, n * (f - 1)) / n / (least(levels_a, levels_b) - 1)) AS cramers_v FROM agg
)"""


def _kth(k: str) -> str:
    return f"""d AS (
  SELECT a.sample_index, sqrt(list_sum(list_transform(list_zip(a.y, b.y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
  FROM f1 a, f1 b
), kth AS (
  SELECT sample_index, d AS kth_distance
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY d) AS rn FROM d) WHERE rn = {k}
)"""


def _block(parts: int) -> str:
    """Block of rank k (0-based) among n rows when the inner block ends are floor(n f / parts)."""
    passed = [f"CASE WHEN k >= n * {f} // {parts} THEN 1 ELSE 0 END" for f in range(1, parts)]
    return f"CAST({' + '.join(passed)} AS INTEGER)"


_JUDGED = "j AS (SELECT doc_id, CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS prediction FROM labels)"


def _scores(source: str, by: str) -> str:
    """Per-class then averaged scores of (by, truth, prediction) rows."""
    keys = f"{by}, " if by else ""
    using = f"USING ({by}, class)" if by else "USING (class)"
    return f"""sup AS (
  SELECT {keys}truth AS class, count(*) AS support, count(*) FILTER (truth = prediction) AS tp FROM {source} GROUP BY {keys}class
), prd AS (SELECT {keys}prediction AS class, count(*) AS predicted FROM {source} GROUP BY {keys}class
), pc AS (
  SELECT {keys}class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
  FROM sup FULL JOIN prd {using}
), sc AS (
  SELECT {keys}CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
         avg(CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support END) AS balanced_accuracy,
         avg(2.0::DOUBLE * tp / (support + predicted)) AS macro_f1
  FROM pc {f'GROUP BY {by}' if by else ''}
)"""


#: The roles in tie-break order and their header aliases, as rows.
_ROLES = ", ".join(f"({i}, '{r}')" for i, r in enumerate(ROLE_ALIASES) if r != "other")
_ALIASES = ", ".join(f"('{r}', '{a}')" for r, names in ROLE_ALIASES.items() for a in names)


ORACLE: dict[str, str] = {
    "exclude_ranges": f"""WITH {F1} SELECT sample_index, CAST(400 + 25 * pos AS DOUBLE) AS wn, round(v, 6) + 0.0 AS y
        FROM f1l WHERE NOT (400 + 25 * pos BETWEEN 500 AND 1000 OR 400 + 25 * pos BETWEEN 1550 AND 1600)""",
    "range_select": f"""WITH {F1} SELECT sample_index, CAST(400 + 25 * pos AS DOUBLE) AS wn, round(v, 6) + 0.0 AS y
        FROM f1l WHERE 400 + 25 * pos BETWEEN 600 AND 1500""",
    "select_rows_search": f"""WITH {F2}, t AS (SELECT *, lower(concat_ws(' ', o_orderpriority, o_orderstatus, c_mktsegment, n_name, r_name)) AS txt FROM f2)
        SELECT sample_index, o_orderpriority, o_orderstatus, c_mktsegment, n_name, r_name FROM t
        WHERE contains(txt, 'high') AND NOT contains(txt, 'asia')""",
    "eligible_semi_filter": f"""WITH {F2} SELECT sample_index, n_name FROM f2 WHERE n_name IN (
        SELECT n_name FROM f2 GROUP BY n_name
        HAVING count(DISTINCT c_mktsegment || '|' || o_orderpriority || '|' || o_orderstatus) >= 75)""",
    "load_summary": f"""WITH {F4} SELECT count(DISTINCT sample_index) AS samples, CAST(max(pos) + 1 AS BIGINT) AS variables,
        count(*) FILTER (v IS NULL) AS missing_cells,
        round(CAST(100 AS DOUBLE) * count(*) FILTER (v IS NULL) / count(*), 6) AS missing_percent,
        CAST(min(pos) AS DOUBLE) AS axis_min, CAST(max(pos) AS DOUBLE) AS axis_max FROM f4l""",
    "csv_round_trip": f"""WITH {F3S} SELECT sample_index, CAST(pos + 1 AS DOUBLE) AS wn, round(v, 2) + 0.0 AS y FROM f3l""",
    "impute_median": f"WITH {F4} {_cells('f4f', 'v')}",
    "snv": f"""WITH {F1}, s AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM f1l WINDOW w AS (PARTITION BY sample_index))
        {_cells('s', '(v - m) / (CASE WHEN sd = 0 THEN 1 ELSE sd END)')}""",
    "vector_normalize": f"""WITH {F1}, s AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY sample_index)) AS norm FROM f1l)
        {_cells('s', 'v / (CASE WHEN norm = 0 THEN 1 ELSE norm END)')}""",
    "area_normalize": f"""WITH {F1}, t AS (SELECT *, (abs(v) + abs(lag(v) OVER (PARTITION BY sample_index ORDER BY pos))) / 2 * 25 AS part FROM f1l),
        s AS (SELECT *, sum(part) OVER (PARTITION BY sample_index) AS area FROM t)
        {_cells('s', 'v / (CASE WHEN area = 0 THEN 1 ELSE area END)', 9)}""",
    "mean_center": f"WITH {F1}, s AS (SELECT *, avg(v) OVER (PARTITION BY pos) AS m FROM f1l) {_cells('s', 'v - m')}",
    "autoscale": f"""WITH {F1}, s AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM f1l WINDOW w AS (PARTITION BY pos))
        {_cells('s', '(v - m) / (CASE WHEN sd = 0 THEN 1 ELSE sd END)')}""",
    "robust_scale": f"""WITH {F1}, q AS (SELECT pos, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM f1l GROUP BY pos),
        s AS (SELECT f1l.*, med, iqr FROM f1l JOIN q USING (pos))
        {_cells('s', '(v - med) / (CASE WHEN iqr = 0 THEN 1 ELSE iqr END)')}""",
    "baseline_polynomial": f"""WITH {F1}, g AS (SELECT *, -1 + 2 * CAST(pos AS DOUBLE) / 63 AS x FROM f1l),
        p AS (SELECT *, x * x - avg(x * x) OVER (PARTITION BY sample_index) AS x2 FROM g),
        c AS (SELECT sample_index, avg(v) AS c0, sum(v * x) / sum(x * x) AS c1, sum(v * x2) / sum(x2 * x2) AS c2 FROM p GROUP BY sample_index),
        s AS (SELECT p.sample_index, pos, v - c0 - c1 * x - c2 * x2 AS r FROM p JOIN c USING (sample_index))
        {_cells('s', 'r')}""",
    "savgol_smooth": f"""WITH {F1}, {WINDOW}, s AS (
        SELECT sample_index, pos, sum(v * (1 / CAST(11 AS DOUBLE) + j * t / CAST(110 AS DOUBLE) + (j * j - 10) * (t * t - 10) / CAST(858 AS DOUBLE))) AS r FROM win GROUP BY ALL)
        {_cells('s', 'r')}""",
    "savgol_derivative": f"""WITH {F1}, {WINDOW}, s AS (
        SELECT sample_index, pos, sum(v * (j / CAST(110 AS DOUBLE) + (j * j - 10) * 2 * t / CAST(858 AS DOUBLE))) AS r FROM win GROUP BY ALL)
        {_cells('s', 'r')}""",
    "recipe_chain": f"""WITH {F1}, k AS (SELECT sample_index, v, row_number() OVER (PARTITION BY sample_index ORDER BY pos) - 1 AS pos
          FROM f1l WHERE NOT (400 + 25 * pos BETWEEN 1000 AND 1200)),
        b AS (SELECT sample_index, pos, v - avg(v) OVER (PARTITION BY sample_index) AS v FROM k),
        u AS (SELECT sample_index, pos, v / sqrt(sum(v * v) OVER (PARTITION BY sample_index)) AS v FROM b),
        s AS (SELECT *, avg(v) OVER (PARTITION BY pos) AS m FROM u) {_cells('s', 'v - m')}""",
    "column_stats": f"""WITH {F1} SELECT CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd,
        round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(quantile_cont(v, 0.75), 6) + 0.0 AS q75
        FROM f1l GROUP BY pos""",
    "covariance": f"""WITH {F1}, c AS (SELECT sample_index, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM f1l)
        SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sum(a.v * b.v) / (count(*) - 1), 9) + 0.0 AS cov
        FROM c a JOIN c b ON a.sample_index = b.sample_index AND a.pos <= b.pos GROUP BY a.pos, b.pos""",
    "pca_variance_total": f"""WITH {F1}, c AS (SELECT sample_index, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM f1l),
        s AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) / (count(*) - 1) AS cov FROM c a JOIN c b USING (sample_index) GROUP BY a.pos, b.pos)
        SELECT round(sum(cov) FILTER (i = j), 8) + 0.0 AS total, round(sum(cov * cov), 8) + 0.0 AS squared FROM s""",
    "pca_score_energy": f"""WITH {F1}, c AS (SELECT sample_index, v - avg(v) OVER (PARTITION BY pos) AS v FROM f1l)
        SELECT sample_index, round(sum(v * v), 6) + 0.0 AS energy FROM c GROUP BY sample_index""",
    "pca_cv_fold_tss": f"""WITH {F1}, k AS (SELECT sample_index, row_number() OVER (ORDER BY md5('42|' || sample_index)) - 1 AS k, count(*) OVER () AS n FROM f1),
        r AS (SELECT sample_index, {_block(4)} AS fold FROM k),
        x AS (SELECT f1l.*, fold FROM f1l JOIN r USING (sample_index)),
        tot AS (SELECT pos, sum(v) AS s, count(*) AS n FROM x GROUP BY pos),
        per AS (SELECT pos, fold, sum(v) AS s, count(*) AS n FROM x GROUP BY pos, fold),
        m AS (SELECT pos, fold, (tot.s - per.s) / (tot.n - per.n) AS m FROM per JOIN tot USING (pos))
        SELECT fold, count(DISTINCT sample_index) AS n_test, round(sum((v - m) * (v - m)), 6) + 0.0 AS tss FROM x JOIN m USING (pos, fold) GROUP BY fold""",
    "schema_value_stats": f"""WITH {F2}, l AS (SELECT unnest([
          {{'column': 'o_orderpriority', 'value': o_orderpriority}}, {{'column': 'o_orderstatus', 'value': o_orderstatus}},
          {{'column': 'c_mktsegment', 'value': c_mktsegment}}, {{'column': 'n_name', 'value': n_name}}, {{'column': 'r_name', 'value': r_name}},
          {{'column': 'o_totalprice', 'value': CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)}},
          {{'column': 'o_orderdate', 'value': strftime(o_orderdate, '%Y-%m-%d')}}], recursive := true) FROM f2),
        d AS (SELECT "column", value, count(*) AS c FROM l GROUP BY ALL)
        SELECT "column", CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c) AS BIGINT) AS present, count(*) AS "unique", count(*) FILTER (c >= 2) AS repeated,
          CAST(coalesce(sum(c) FILTER (regexp_full_match(value, '[0-9]+')), 0) AS BIGINT) AS numeric,
          CAST(coalesce(sum(c) FILTER (regexp_full_match(value, '[0-9]+') AND TRY_CAST(value AS BIGINT) BETWEEN 1900 AND 2100), 0) AS BIGINT) AS years,
          CAST(coalesce(sum(c) FILTER (regexp_full_match(upper(value), '[A-Z]{{2,3}}')), 0) AS BIGINT) AS states,
          CAST(coalesce(sum(c) FILTER (regexp_matches(value, '^[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}')), 0) AS BIGINT) AS date_like,
          CAST(coalesce(sum(c) FILTER (TRY_CAST(value AS DATE) IS NOT NULL), 0) AS BIGINT) AS dates
        FROM d GROUP BY "column" """,
    "metadata_schema": f"""WITH {F1}, l AS (
          SELECT sample_index, unnest([
            {{'column': 'class_label', 'value': class_label}}, {{'column': 'site', 'value': site}},
            {{'column': 'batch', 'value': batch}}, {{'column': 'replicate', 'value': CAST(sample_index % 3 AS VARCHAR)}}], recursive := true) FROM f1),
        st AS (
          SELECT "column", count(*) AS n, count(value) AS present, count(DISTINCT value) AS uniq, count(DISTINCT trim(value)) AS uniq_text,
            count(TRY_CAST(value AS DOUBLE)) AS num,
            count(*) FILTER (TRY_CAST(value AS DOUBLE) BETWEEN 1900 AND 2100 AND TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE))) AS years,
            count(*) FILTER (regexp_full_match(upper(trim(value)), '[A-Z]{{2,3}}')) AS states,
            count(*) FILTER (regexp_matches(trim(value), '^[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}')) AS datelike,
            count(*) FILTER (TRY_CAST(trim(value) AS DATE) IS NOT NULL) AS dates
          FROM l GROUP BY "column"),
        roles AS (SELECT * FROM (VALUES {_ROLES}) t(place, role)),
        aliases AS (SELECT * FROM (VALUES {_ALIASES}) t(role, alias)),
        head AS (
          SELECT "column", role, max(CASE WHEN name = alias THEN 0.92::DOUBLE WHEN contains(name, alias) THEN 0.78::DOUBLE ELSE 0::DOUBLE END) AS h
          FROM (SELECT "column", regexp_replace(lower("column"), '[^a-z0-9]+', '', 'g') AS name FROM st), aliases GROUP BY "column", role),
        ev AS (
          SELECT st.*, place, roles.role, h, CAST(CASE roles.role
            WHEN 'year' THEN CASE WHEN num > 0.9 * present AND years > 0.8 * num THEN 0.82 ELSE 0 END
            WHEN 'state_or_province' THEN CASE WHEN uniq_text <= 70 AND states > 0.8 * present THEN 0.58 ELSE 0 END
            WHEN 'sample_id' THEN CASE WHEN uniq_text > 0.85 * present AND uniq_text >= greatest(5, present // 2) THEN 0.48 ELSE 0 END
            WHEN 'date' THEN CASE WHEN present >= 3 AND datelike > 0.5 * present AND dates > 0.8 * present THEN 0.68 ELSE 0 END
            WHEN 'class_label' THEN CASE WHEN uniq_text BETWEEN 2 AND greatest(30, present // 2) THEN 0.34 ELSE 0 END
            ELSE 0 END AS DOUBLE) AS v
          FROM st JOIN head USING ("column") JOIN roles ON roles.role = head.role),
        sc AS (SELECT *, least(0.99::DOUBLE, greatest(h, v, h + 0.12::DOUBLE * v)) AS e FROM ev),
        best AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY e DESC, place) AS rn FROM sc),
        ex AS (
          SELECT "column", string_agg(value, ', ' ORDER BY sample_index) AS example
          FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY sample_index) AS rn FROM l WHERE value IS NOT NULL) WHERE rn <= 3 GROUP BY "column")
        SELECT "column", CASE WHEN e < 0.42 THEN 'other' ELSE role END AS role, CASE WHEN e < 0.42 THEN greatest(e, 0.2::DOUBLE) ELSE e END AS confidence,
          uniq AS unique_values, 100.0::DOUBLE * (1.0::DOUBLE - present / n) AS missing_percent, coalesce(example, '') AS example,
          coalesce(nullif(concat_ws(' + ', CASE WHEN e >= 0.42 AND h >= 0.5 THEN 'column name' END, CASE WHEN e >= 0.42 AND v >= 0.45 THEN 'value pattern' END), ''),
            'weak/ambiguous evidence') AS reason
        FROM best LEFT JOIN ex USING ("column") WHERE rn = 1""",
    "stream_runs": """WITH e AS (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
          FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
        k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended,
          count(*) AS readings, round(sum(value), 4) AS total, max(value) AS peak
        FROM k GROUP BY user_id, run HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""",
    "group_key": f"WITH {F2} SELECT sample_index, r_name || '|' || c_mktsegment AS group_key FROM f2",
    "eligibility": f"""WITH {F2} SELECT o_orderpriority AS class, count(DISTINCT n_name || '|' || o_orderstatus) AS independent_groups,
        count(DISTINCT n_name || '|' || o_orderstatus) >= 75 AS eligible FROM f2 GROUP BY o_orderpriority""",
    "exploratory_eligibility": f"WITH {F2} SELECT o_orderstatus AS class, count(*) AS spectra, count(*) >= 500 AS eligible FROM f2 GROUP BY o_orderstatus",
    "group_support": f"WITH {F2} SELECT r_name AS class, count(DISTINCT n_name) AS independent_groups FROM f2 GROUP BY r_name",
    "qc_metrics": f"""WITH {F4}, b AS (SELECT *, -1 + 2 * CAST(pos AS DOUBLE) / 23 AS x,
          v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2, max(v) OVER s AS hi, min(v) OVER s AS lo
          FROM f4f WINDOW w AS (PARTITION BY sample_index ORDER BY pos), s AS (PARTITION BY sample_index)),
        a AS (SELECT sample_index, avg(CASE WHEN gap THEN 1 ELSE 0 END) AS missing_fraction, stddev_pop(v) AS signal_std, max(v) - min(v) AS signal_range,
          quantile_cont(v, 0.5) AS median_signal, max(abs(v)) AS max_abs_signal, quantile_cont(abs(d2), 0.5) AS noise,
          abs(regr_slope(v, x)) AS slope,
          avg(CASE WHEN v >= hi - 2 * (hi - lo) / 1000 THEN 1 ELSE 0 END) AS top, avg(CASE WHEN v <= lo + 2 * (hi - lo) / 1000 THEN 1 ELSE 0 END) AS bottom
          FROM b GROUP BY sample_index)
        SELECT sample_index, round(missing_fraction, 6) + 0.0 AS missing_fraction, round(signal_std, 6) + 0.0 AS signal_std, round(signal_range, 6) + 0.0 AS signal_range,
          round(median_signal, 6) + 0.0 AS median_signal, round(max_abs_signal, 6) + 0.0 AS max_abs_signal,
          round(noise / greatest(signal_range, 1e-12), 6) + 0.0 AS noise_ratio, round(slope / greatest(signal_range, 1e-12), 6) + 0.0 AS baseline_slope_ratio,
          round(CASE WHEN signal_range <= 1e-12 THEN 1 ELSE greatest(top, bottom) END, 6) + 0.0 AS near_extreme_fraction FROM a""",
    "qc_flags": f"""WITH {F3S}, b AS (SELECT *, -1 + 2 * CAST(pos AS DOUBLE) / 11 AS x,
          v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2, max(v) OVER s AS hi, min(v) OVER s AS lo
          FROM f3l WINDOW w AS (PARTITION BY sample_index ORDER BY pos), s AS (PARTITION BY sample_index)),
        a AS (SELECT sample_index, stddev_pop(v) AS sd, max(v) - min(v) AS rng, max(abs(v)) AS mx, quantile_cont(abs(d2), 0.5) / greatest(max(v) - min(v), 1e-12) AS noise,
          abs(regr_slope(v, x)) / greatest(max(v) - min(v), 1e-12) AS base,
          greatest(avg(CASE WHEN v >= hi - 2 * (hi - lo) / 1000 THEN 1 ELSE 0 END), avg(CASE WHEN v <= lo + 2 * (hi - lo) / 1000 THEN 1 ELSE 0 END)) AS ext
          FROM b GROUP BY sample_index),
        md AS (SELECT quantile_cont(sd, 0.5) AS sd, quantile_cont(mx, 0.5) AS mx, quantile_cont(noise, 0.5) AS noise, quantile_cont(base, 0.5) AS base FROM a),
        mad AS (SELECT quantile_cont(abs(a.mx - md.mx), 0.5) AS mx, quantile_cont(abs(a.noise - md.noise), 0.5) AS noise, quantile_cont(abs(a.base - md.base), 0.5) AS base FROM a, md),
        f AS (SELECT sample_index, a.sd <= greatest(md.sd * 3 / 100, 1e-12) AS flat_flag,
          abs(CAST(0.67448975 AS DOUBLE) * (a.mx - md.mx) / mad.mx) > CAST(3.5 AS DOUBLE) AS extreme_intensity_flag,
          CAST(0.67448975 AS DOUBLE) * (a.noise - md.noise) / mad.noise > CAST(3.5 AS DOUBLE) AS high_noise_flag,
          ext >= CAST(0.05 AS DOUBLE) AND a.sd > greatest(md.sd * 3 / 100, 1e-12) AS possible_saturation_flag,
          CAST(0.67448975 AS DOUBLE) * (a.base - md.base) / mad.base > CAST(3.5 AS DOUBLE) AS high_baseline_flag FROM a, md, mad)
        SELECT *, CAST(flat_flag AS INTEGER) + CAST(extreme_intensity_flag AS INTEGER) + CAST(high_noise_flag AS INTEGER) + CAST(possible_saturation_flag AS INTEGER) + CAST(high_baseline_flag AS INTEGER) AS qc_flag_count,
          flat_flag OR extreme_intensity_flag OR high_noise_flag OR possible_saturation_flag OR high_baseline_flag AS qc_review FROM f""",
    "robust_z": """WITH c AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM orders),
        m AS (SELECT quantile_cont(abs(o_totalprice - med), 0.5) AS mad FROM orders, c)
        SELECT o_orderkey AS sample_index, round(CAST(0.67448975 AS DOUBLE) * (o_totalprice - med) / mad, 6) + 0.0 AS z FROM orders, c, m""",
    "replicate_correlation": f"""WITH {F1}, z AS (SELECT sample_index, site || '|' || batch AS g, pos, v - avg(v) OVER (PARTITION BY sample_index) AS v FROM f1l),
        u AS (SELECT sample_index, g, pos, v / sqrt(sum(v * v) OVER (PARTITION BY sample_index)) AS v FROM z),
        r AS (SELECT a.g, a.sample_index AS ia, b.sample_index AS ib, sum(a.v * b.v) AS r FROM u a JOIN u b ON a.g = b.g AND a.pos = b.pos AND a.sample_index < b.sample_index GROUP BY ALL),
        n AS (SELECT site || '|' || batch AS g, count(*) AS n FROM f1 GROUP BY ALL)
        SELECT g AS replicate_group, any_value(n) AS n, round(avg(r), 6) + 0.0 AS mean_pairwise_correlation, round(min(r), 6) + 0.0 AS minimum_pairwise_correlation,
          min(r) < CAST(0.95 AS DOUBLE) AS warning FROM r JOIN n USING (g) GROUP BY g""",
    "cramers_v": f"""WITH {F2}, {_cramers("SELECT 'n_name' AS metadata_a, 'o_orderpriority' AS metadata_b, n_name AS a, o_orderpriority AS b, count(*) AS o FROM f2 GROUP BY ALL")}
        SELECT metadata_a, metadata_b, n, levels_a, levels_b, round(chi2, 6) + 0.0 AS chi2, round(cramers_v, 6) + 0.0 AS cramers_v FROM v""",
    "confound_pairs": f"""WITH {F2}, {F2_LONG}, ord AS (SELECT m, list_position([{LEVELS}], m) AS k, l, sample_index FROM f2m),
        {_cramers("SELECT p.m AS metadata_a, q.m AS metadata_b, p.l AS a, q.l AS b, count(*) AS o FROM ord p JOIN ord q ON p.sample_index = q.sample_index AND p.k < q.k GROUP BY ALL")}
        SELECT metadata_a, metadata_b, round(cramers_v, 6) + 0.0 AS cramers_v,
          CASE WHEN cramers_v >= CAST(0.8 AS DOUBLE) THEN 'strong' WHEN cramers_v >= CAST(0.6 AS DOUBLE) THEN 'moderate' ELSE 'low' END AS level FROM v""",
    "eta_squared": f"""WITH {F2}, {F2_LONG}, lv AS (SELECT m AS metadata, l, count(*) AS c, avg(o_totalprice) AS a FROM f2m GROUP BY ALL),
        g AS (SELECT avg(o_totalprice) AS ga, var_pop(o_totalprice) * count(*) AS tot, count(*) AS n FROM f2)
        SELECT metadata, 'o_totalprice' AS value, any_value(n) AS n, round(sum(c * (a - ga) * (a - ga)) / any_value(tot), 8) + 0.0 AS eta_squared FROM lv, g GROUP BY metadata""",
    "spearman": f"""WITH {F2}, r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / CAST(2 AS DOUBLE) AS a,
          rank() OVER (ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderdate) - 1) / CAST(2 AS DOUBLE) AS b FROM f2)
        SELECT count(*) AS n, round(corr(a, b), 8) + 0.0 AS rho FROM r""",
    "average_ranks": """SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / CAST(2 AS DOUBLE) AS quantity_rank FROM lineitem""",
    "exact_quantile": """SELECT l_returnflag, CAST(p AS DOUBLE) AS prob, round(CASE p WHEN 0.25 THEN a WHEN 0.5 THEN b ELSE c END, 6) + 0.0 AS value
        FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.95) AS c FROM lineitem GROUP BY l_returnflag),
             (SELECT unnest([0.25, 0.5, 0.95]) AS p)""",
    "knn_distance": f"WITH {F1}, {_kth('5')} SELECT sample_index, round(kth_distance, 6) + 0.0 AS kth_distance FROM kth",
    "dbscan_eps": f"""WITH {F1}, {_kth("(SELECT least(greatest(3, CAST(round_even(sqrt(count(*)) / 2, 0) AS BIGINT)), count(*) - 1) FROM f1)")}
        SELECT CAST(q AS DOUBLE) AS quantile, round(CASE q WHEN 0.7 THEN a WHEN 0.8 THEN b WHEN 0.85 THEN c WHEN 0.9 THEN d ELSE e END, 6) + 0.0 AS eps
        FROM (SELECT quantile_cont(kth_distance, 0.7) AS a, quantile_cont(kth_distance, 0.8) AS b, quantile_cont(kth_distance, 0.85) AS c, quantile_cont(kth_distance, 0.9) AS d, quantile_cont(kth_distance, 0.95) AS e FROM kth),
             (SELECT unnest([0.7, 0.8, 0.85, 0.9, 0.95]) AS q)""",
    "silhouette_given_labels": f"""WITH {F1}, p AS (SELECT a.sample_index, a.class_label AS own, b.class_label AS other,
          sqrt(list_sum(list_transform(list_zip(a.y, b.y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM f1 a, f1 b WHERE a.sample_index <> b.sample_index),
        m AS (SELECT sample_index, own, other, avg(d) AS d FROM p GROUP BY ALL),
        ab AS (SELECT sample_index, own, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM m GROUP BY ALL)
        SELECT sample_index, own AS class_label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM ab""",
    "ari_given_labels": f"""WITH {F2}, c AS (SELECT n_name, r_name, count(*) AS o FROM f2 GROUP BY ALL),
        t AS (SELECT (SELECT sum(o * (o - 1) / CAST(2 AS DOUBLE)) FROM c) AS cell,
          (SELECT sum(o * (o - 1) / CAST(2 AS DOUBLE)) FROM (SELECT sum(o) AS o FROM c GROUP BY n_name)) AS r,
          (SELECT sum(o * (o - 1) / CAST(2 AS DOUBLE)) FROM (SELECT sum(o) AS o FROM c GROUP BY r_name)) AS k, (SELECT count(*) FROM f2) AS n)
        SELECT n, round((cell - r * k / (n * (n - 1) / CAST(2 AS DOUBLE))) / ((r + k) / 2 - r * k / (n * (n - 1) / CAST(2 AS DOUBLE))), 8) + 0.0 AS ari FROM t""",
    "kmeans_step": f"""WITH {F1}, c AS (SELECT CAST(class_label AS INTEGER) AS cluster, pos, avg(v) AS c FROM f1l GROUP BY ALL),
        d AS (SELECT sample_index, cluster, sum((v - c) * (v - c)) AS d FROM f1l JOIN c USING (pos) GROUP BY ALL)
        SELECT sample_index, cluster FROM (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY d, cluster) AS rn FROM d) WHERE rn = 1""",
    "dbscan_labels": f"""WITH RECURSIVE {F3S}, pt AS (SELECT sample_index, sum(v) / 1e6 AS x1, 10 * sum(v) FILTER (pos < 6) / sum(v) AS x2 FROM f3l GROUP BY sample_index),
        d AS (SELECT a.sample_index AS i, b.sample_index AS j, sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d FROM pt a, pt b),
        e AS (SELECT quantile_cont(d, 0.3) AS eps FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS rn FROM d) WHERE rn = 5),
        near AS (SELECT i, j FROM d, e WHERE d <= eps),
        core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5),
        ce AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
        reach(i, r) AS (SELECT i, i FROM core UNION SELECT ce.j, reach.r FROM reach JOIN ce ON ce.i = reach.i),
        comp AS (SELECT i, min(r) AS root FROM reach GROUP BY i),
        lab AS (SELECT near.i, min(comp.root) AS root FROM near JOIN comp ON comp.i = near.j WHERE near.i NOT IN (SELECT i FROM core) GROUP BY near.i UNION ALL SELECT i, root FROM comp),
        num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM comp))
        SELECT pt.sample_index, CAST(coalesce(num.c, -1) AS INTEGER) AS cluster FROM pt LEFT JOIN lab ON lab.i = pt.sample_index LEFT JOIN num ON num.root = lab.root""",
    "class_difference_regions": f"""WITH {F1}, c AS (SELECT class_label, 400 + 25 * CAST(pos AS DOUBLE) AS wn, avg(v) AS a FROM f1l GROUP BY ALL),
        o AS (SELECT 400 + 25 * CAST(pos AS DOUBLE) AS wn, avg(v) AS m FROM f1l GROUP BY ALL),
        d AS (SELECT class_label, wn, a - m AS df FROM c JOIN o USING (wn)),
        h AS (SELECT d.* FROM d JOIN (SELECT class_label, quantile_cont(abs(df), 0.85) AS cut FROM d GROUP BY class_label) USING (class_label) WHERE abs(df) >= cut),
        i AS (SELECT *, CASE WHEN wn - lag(wn) OVER (PARTITION BY class_label ORDER BY wn) > 75 THEN 1 ELSE 0 END AS brk FROM h),
        g AS (SELECT *, sum(brk) OVER (PARTITION BY class_label ORDER BY wn) AS isl FROM i),
        r AS (SELECT class_label, min(wn) AS region_min, max(wn) AS region_max, arg_max(wn, abs(df)) AS peak, arg_max(df, abs(df)) AS pl, max(abs(df)) AS st FROM g GROUP BY class_label, isl)
        SELECT class_label, region_min, region_max, peak, round(pl, 6) + 0.0 AS peak_loading, CASE WHEN pl >= 0 THEN 'positive' ELSE 'negative' END AS direction, round(st, 6) + 0.0 AS region_strength
        FROM (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY st DESC, region_min) AS rn FROM r) WHERE rn <= 6""",
    "confusion_matrix": f"""WITH {_JUDGED} SELECT truth, count(*) FILTER (prediction = '0') AS predicted_0, count(*) FILTER (prediction = '1') AS predicted_1 FROM j GROUP BY truth""",
    "balanced_accuracy": f"""WITH {_JUDGED}, {_scores('j', '')}
        SELECT n, round(accuracy, 6) + 0.0 AS accuracy, round(balanced_accuracy, 6) + 0.0 AS balanced_accuracy, round(macro_f1, 6) + 0.0 AS macro_f1 FROM sc""",
    "specificity": f"""WITH {_JUDGED}, {_scores('j', '')}, t AS (SELECT count(*) AS n FROM j)
        SELECT class, support, round(CAST(tp AS DOUBLE) / support, 6) + 0.0 AS sensitivity_recall,
          round(CAST(n - support - (predicted - tp) AS DOUBLE) / (n - support), 6) + 0.0 AS specificity FROM pc, t""",
    "family_summary": f"""WITH {_JUDGED}, jd AS (SELECT j.*, lang AS model FROM j JOIN documents USING (doc_id)),
        jk AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS k, count(*) OVER () AS n FROM jd),
        f AS (SELECT *, {_block(3)} AS fold FROM jk), {_scores('f', 'model, fold')}
        SELECT model, count(DISTINCT fold) AS folds, round(avg(balanced_accuracy), 6) + 0.0 AS mean_outer_balanced_accuracy,
          round(coalesce(stddev_samp(balanced_accuracy), 0), 6) + 0.0 AS outer_balanced_accuracy_sd, round(min(balanced_accuracy), 6) + 0.0 AS worst_outer_balanced_accuracy,
          round(max(balanced_accuracy), 6) + 0.0 AS best_outer_balanced_accuracy, round(avg(macro_f1), 6) + 0.0 AS mean_outer_macro_f1 FROM sc GROUP BY model""",
    "fold_assignment": f"""WITH {F1}, s AS (SELECT site || '|' || batch AS "group", class_label AS label, count(*) AS rows FROM f1 GROUP BY ALL),
        g AS (SELECT "group", CAST(sum(rows) AS BIGINT) AS size FROM s GROUP BY "group"),
        st AS (SELECT "group", label AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY rows DESC, label DESC) AS rn FROM s) WHERE rn = 1),
        o AS (SELECT "group", stratum, size, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, md5('42|' || "group"), "group") - 1 AS k FROM g JOIN st USING ("group"))
        SELECT "group", stratum, size, CAST(CASE WHEN (k // 4) % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END AS INTEGER) AS fold FROM o""",
    "row_fold_assignment": f"""WITH {F2}, k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || sample_index)) - 1 AS k,
          count(*) OVER (PARTITION BY o_orderpriority) AS n FROM f2)
        SELECT sample_index, o_orderpriority, {_block(5)} AS fold FROM k""",
    "leakage_check": f"""WITH {F1} SELECT site || '|' || batch AS "group", count(*) AS rows, CAST(1 AS BIGINT) AS folds_seen FROM f1 GROUP BY ALL""",
    "running_best": f"""WITH {F1}, g AS (SELECT pos, avg(v) AS ga, var_pop(v) * count(*) AS tot FROM f1l GROUP BY pos),
        l AS (SELECT pos, class_label, count(*) AS c, avg(v) AS a FROM f1l GROUP BY ALL),
        e AS (SELECT pos, sum(c * (a - ga) * (a - ga)) / any_value(tot) AS o FROM l JOIN g USING (pos) GROUP BY pos)
        SELECT CAST(pos AS INTEGER) AS trial, round(o, 8) + 0.0 AS objective, round(max(o) OVER (ORDER BY pos), 8) + 0.0 AS best_so_far FROM e""",
    "plsda_one_component": f"""WITH {F1}, b AS (SELECT *, CASE WHEN CAST(class_label AS INTEGER) < 5 THEN 0 ELSE 1 END AS h FROM f1l),
        c AS (SELECT sample_index, pos, h, v - avg(v) OVER (PARTITION BY pos) AS v, h - avg(h) OVER (PARTITION BY pos) AS hc FROM b),
        w AS (SELECT pos, sum(v * hc) AS w FROM c GROUP BY pos), wn AS (SELECT pos, w / sqrt(sum(w * w) OVER ()) AS w FROM w),
        t AS (SELECT sample_index, any_value(h) AS h, any_value(hc) AS hc, sum(v * w) AS t FROM c JOIN wn USING (pos) GROUP BY sample_index),
        q AS (SELECT sum(t * hc) / sum(t * t) AS q, avg(h) AS m FROM t)
        SELECT sample_index, CASE WHEN h = 1 THEN 'high' ELSE 'low' END AS label, round(m + t * q, 6) + 0.0 AS decision_high,
          CASE WHEN m + t * q >= 1 - (m + t * q) THEN 'high' ELSE 'low' END AS prediction FROM t, q""",
}

# two months per supplier: mean-centred pairs, their covariance, and its eigenvectors in closed form,
# each with its largest loading positive
PAIR = f"""{F3S}, p2 AS (
  SELECT sample_index, max(v) FILTER (pos = 2) AS rx, max(v) FILTER (pos = 3) AS ry FROM f3l GROUP BY sample_index
), c2 AS (SELECT sample_index, rx - avg(rx) OVER () AS x, ry - avg(ry) OVER () AS y FROM p2
), v2 AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM c2
), l2 AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS big FROM v2
), e2 AS (SELECT big, b / sqrt(b * b + (big - a) * (big - a)) AS u, (big - a) / sqrt(b * b + (big - a) * (big - a)) AS w FROM l2
), s2 AS (SELECT big, u, w, CASE WHEN abs(u) >= abs(w) THEN sign(u) ELSE sign(w) END AS s1,
    CASE WHEN abs(w) >= abs(u) THEN sign(-w) ELSE sign(u) END AS s2 FROM e2
), t2 AS (SELECT sample_index, x, y, big, s1 * u AS lx, s1 * w AS ly,
    s1 * (x * u + y * w) AS pc1, s2 * (x * -w + y * u) AS pc2 FROM c2, s2
)"""


def _pair_cv(points: str, mode: str, unit: str, digits: int) -> str:
    """Curve of one component over ``points`` of (rx, ry, fold): the error is what lies across the first axis."""
    axis = "(a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS big, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS small"
    shown = {
        "RMSEC_X": f"avg(cal) / {unit}", "RMSECV_X": f"avg(val) / {unit}", "RMSECV_X_SD": f"stddev_samp(val) / {unit}",
        "RMSECV_X_SE": f"stddev_samp(val) / sqrt(count(*)) / {unit}", "RMSECV_X_BestFold": f"min(val) / {unit}",
        "RMSECV_X_WorstFold": f"max(val) / {unit}", "PRESS_X": f"sum(press) / ({unit} * {unit})",
        "Q2_X": "1 - sum(press) / sum(tss)", "ExplainedVariance_X": "any_value(ratio)",
    }
    return f"""{points}, tr AS (
          SELECT f.fold, avg(rx) AS mx, avg(ry) AS my, count(*) AS n, var_pop(rx) * count(*) AS a, covar_pop(rx, ry) * count(*) AS b, var_pop(ry) * count(*) AS c
          FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY f.fold),
        ax AS (SELECT *, {axis} FROM tr),
        dir AS (SELECT *, b / sqrt(b * b + (big - a) * (big - a)) AS u, (big - a) / sqrt(b * b + (big - a) * (big - a)) AS w FROM ax),
        per AS (
          SELECT fold, any_value(sqrt(small / (n * 2))) AS cal, sum(pow((ry - my) * u - (rx - mx) * w, 2)) AS press,
            sum(pow(rx - mx, 2) + pow(ry - my, 2)) AS tss, sqrt(sum(pow((ry - my) * u - (rx - mx) * w, 2)) / (count(*) * 2)) AS val
          FROM x JOIN dir USING (fold) GROUP BY fold),
        whole AS (SELECT big / (a + c) AS ratio FROM (
          SELECT a, c, {axis} FROM (SELECT var_pop(rx) AS a, covar_pop(rx, ry) AS b, var_pop(ry) AS c FROM x)))
        SELECT CAST(1 AS BIGINT) AS components, '{mode}' AS validation_mode, count(*) AS folds, true AS recommended,
          {", ".join(f'round({e}, {digits}) + 0.0 AS "{c}"' for c, e in shown.items())} FROM per, whole"""


ORACLE |= {
    "pair_cv": _pair_cv(
        f"""WITH {F3S}, p2 AS (SELECT sample_index, max(v) FILTER (pos = 2) AS rx, max(v) FILTER (pos = 3) AS ry FROM f3l GROUP BY sample_index),
        k AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || sample_index)) - 1 AS k, count(*) OVER () AS n FROM p2),
        x AS (SELECT rx, ry, {_block(4)} AS fold FROM k)""",
        "K-fold", "1e3", 4,
    ),
    "pair_cv_grouped": _pair_cv(
        f"""WITH {F1}, g AS (SELECT site, count(*) AS size FROM f1 GROUP BY site),
        o AS (SELECT site, row_number() OVER (ORDER BY size DESC, md5('42|' || site), site) - 1 AS k FROM g),
        d AS (SELECT site, CASE WHEN (k // 4) % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END AS fold FROM o),
        x AS (SELECT y[9] AS rx, y[10] AS ry, fold FROM f1 JOIN d USING (site))""",
        "grouped", "1", 6,
    ),
    "metadata_gaps": """SELECT unnest(['class_label', 'site', 'batch']) AS "column",
        unnest([count(*) FILTER (label IS NULL), count(*) FILTER (label IS NULL OR label = 3), count(*) FILTER (vec_id % 7 = 0)]) AS missing
        FROM embeddings""",
    "select_keys": """SELECT vec_id AS sample_index, CAST(label AS VARCHAR) AS class_label FROM embeddings
        WHERE vec_id < 200 AND NOT vec_id BETWEEN 50 AND 99""",
    "trial_projection": f"WITH {PAIR} SELECT sample_index, round(pc1, 3) + 0.0 AS pc1, round(pc2, 3) + 0.0 AS pc2 FROM t2",
    "pair_diagnostics": f"""WITH {PAIR} SELECT sample_index, round(pc1 * pc1 / big, 5) + 0.0 AS "Hotelling_T2",
        round(pc2 * pc2 / 1e6, 5) + 0.0 AS "Q_residual_millions" FROM t2""",
    "pair_contributions": f"""WITH {PAIR}, k AS (
        SELECT sample_index, unnest([3.0, 4.0])::DOUBLE AS wavenumber, unnest([lx, ly]) AS l, unnest([x - pc1 * lx, y - pc1 * ly]) AS r,
            pc1 / sqrt(big) AS z, greatest(pow(pc1 * lx, 2), pow(pc1 * ly, 2)) / big AS top FROM t2)
        SELECT sample_index, wavenumber, round(z * l, 5) + 0.0 AS "T2_signed_direction",
            round(z * l * z * l / greatest(top, 1e-12), 5) + 0.0 AS "T2_scaled", round(r * r / 1e6, 5) + 0.0 AS "Q_millions" FROM k""",
    "lloyd_to_convergence": f"""WITH RECURSIVE {F3S}, p2 AS (
        SELECT sample_index, max(v) FILTER (pos = 2) AS x, max(v) FILTER (pos = 3) AS y FROM f3l GROUP BY sample_index),
        k(step, centers) AS (
            SELECT 0, (SELECT list({{'x': x, 'y': y}} ORDER BY sample_index) FROM (SELECT * FROM p2 ORDER BY sample_index LIMIT 3))
            UNION ALL
            SELECT step + 1, (SELECT list({{'x': mx, 'y': my}} ORDER BY g) FROM (
                SELECT g, avg(x) AS mx, avg(y) AS my FROM (
                    SELECT x, y, list_position(d, list_min(d)) AS g FROM (
                        SELECT x, y, list_transform(centers, lambda c: (x - c.x) * (x - c.x) + (y - c.y) * (y - c.y)) AS d FROM p2)) GROUP BY g))
            FROM k WHERE step < 200)
        SELECT sample_index, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster FROM (
            SELECT sample_index, list_transform(centers, lambda c: (x - c.x) * (x - c.x) + (y - c.y) * (y - c.y)) AS d
            FROM p2, (SELECT centers FROM k ORDER BY step DESC LIMIT 1))""",
    "ward_energy": """WITH p AS (SELECT avg(l_quantity) AS x, avg(l_extendedprice) / 1000.0 AS y FROM lineitem
            GROUP BY l_suppkey, l_returnflag, l_linestatus)
        SELECT count(*) - 1 AS merges, round(var_pop(x) * count(*) + var_pop(y) * count(*), 4) AS energy FROM p""",
    "validation_defaults": """WITH g AS (SELECT label, count(DISTINCT concat(vec_id % 8, '|', vec_id % 5)) AS n FROM embeddings GROUP BY label),
        m AS (SELECT min(n) AS least FROM g WHERE n >= 2), r AS (SELECT count(*) AS n FROM embeddings)
        SELECT unnest(['min_groups', 'outer_folds', 'inner_folds', 'neighbors', 'components', 'max_components']) AS setting,
            unnest([greatest(2, least(3, least)), greatest(2, least(5, least)), greatest(2, least(3, greatest(2, least - 1))),
                greatest(5, least(40, CAST(round_even(2 * sqrt(greatest(4, n)), 0) AS BIGINT))),
                greatest(3, least(20, least(n - 2, 64))), greatest(2, least(25, least(n - 2, 64)))])::BIGINT AS value FROM m, r""",
}

_DEAL = """g{t} AS (SELECT {by}grp, CAST(sum(rows) AS BIGINT) AS size FROM s{t} GROUP BY ALL),
    l{t} AS (SELECT {by}grp, label AS stratum FROM s{t} QUALIFY row_number() OVER (PARTITION BY {by}grp ORDER BY rows DESC, label DESC) = 1),
    k{t} AS (SELECT {by}grp, row_number() OVER (PARTITION BY {by}stratum ORDER BY size DESC, md5(concat({seed}, '|', grp)), grp) - 1 AS k
        FROM g{t} JOIN l{t} USING ({by}grp)),
    f{t}d AS (SELECT {by}grp, CAST(CASE WHEN (k // {n}) % 2 = 0 THEN k % {n} ELSE {n} - 1 - k % {n} END AS INTEGER) AS fold FROM k{t})"""
ORACLE |= {
    "nested_folds": f"""WITH {F1}, r AS (SELECT sample_index, site || '|' || batch AS grp, CASE WHEN CAST(class_label AS INTEGER) < 5 THEN 1 ELSE 0 END AS label FROM f1),
    so AS (SELECT grp, label, count(*) AS rows FROM r GROUP BY ALL), {_DEAL.format(t='o', by='', seed=42, n=3)},
    si AS (SELECT o, so.* FROM so JOIN fod USING (grp), (VALUES (0), (1), (2)) v(o) WHERE o <> fold), {_DEAL.format(t='i', by='o, ', seed='1043 + o', n=2)}
    SELECT sample_index, r.grp AS "group", CAST(v.o + 1 AS INTEGER) AS outer_fold, CASE WHEN fod.fold = v.o THEN 'test' ELSE 'train' END AS role,
        fid.fold AS inner_fold FROM r JOIN fod ON r.grp = fod.grp, (VALUES (0), (1), (2)) v(o) LEFT JOIN fid ON fid.o = v.o AND fid.grp = r.grp""",
    "knn_plane": """WITH p AS (SELECT o_orderkey AS sample_index, o_totalprice / 1000.0::DOUBLE AS x,
        CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y FROM orders)
    SELECT a.sample_index, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 5)[5], 6) + 0.0 AS kth_distance
    FROM p a, p b GROUP BY a.sample_index""",
}
