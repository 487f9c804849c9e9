"""DuckDB SQL for the registered queries, as a chain of common table expressions and a final select each."""

from __future__ import annotations

from caseloom.config import AGREE, FIELDS, LABELS, OTHER_AGREE, REVIEW_WEIGHTS, SIGNALS
from caseloom.functions.vocab import BRANDS, DRUGS
from caseloom.plans.queries import DRUG_WORDS, EVENT_WORDS
from caseloom.sources.generate import NOISE

G = range(len(FIELDS))


def _reports(drug: str, event: str) -> str:
    cut = lambda c: f"list_sort(list_transform(CASE WHEN k % 2 = 1 AND len({c}) > 1 THEN {c}[2:] ELSE coalesce({c}, []) END, lambda x: CAST(x AS VARCHAR)))"
    return f"""terms AS MATERIALIZED (
  SELECT l_orderkey, list_sort(list(DISTINCT {drug})) AS d, list_sort(list(DISTINCT {event})) AS e
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
reports AS MATERIALIZED (
  SELECT CAST(o_orderkey + 10000000 * k AS BIGINT) AS idx, CAST(o_orderkey + 10000000 * k AS VARCHAR) AS report_id,
    CASE WHEN NOT (o_orderkey % 23 = 0 OR (k > 0 AND o_orderkey % 70 = 0)) THEN CAST(18 + (o_custkey * 7) % 67 + k % 2 AS DOUBLE) END AS age,
    CASE WHEN o_orderkey % 25 <> 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END END AS sex,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'Serious' ELSE 'Non-serious' END AS seriousness,
    CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 7 * k AS BIGINT) AS report_day,
    {cut("d")} AS drugs, {cut("e")} AS events, CAST(o_orderkey AS BIGINT) AS true_cluster_id
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN terms ON o_orderkey = l_orderkey CROSS JOIN range(0, 7) AS r(k)
  WHERE k <= CASE WHEN o_orderkey % 500 = 0 THEN 6 WHEN o_orderkey % 30 = 0 THEN 2 WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)"""


_KIND = "p_type || CAST(p_size AS VARCHAR)"
RARE = _reports("p_partkey", f"{_KIND} || '-' || CAST(l_suppkey % 50 AS VARCHAR)")
MEDIUM = _reports("p_name || p_brand", _KIND)

BLOCKS = """drug_terms AS MATERIALIZED (SELECT idx, unnest(drugs) AS term FROM reports),
event_terms AS MATERIALIZED (SELECT idx, unnest(events) AS term FROM reports),
base AS (SELECT idx, report_day AS day, CAST(floor(report_day / 90.0) AS BIGINT) AS bucket, coalesce(nullif(lower(trim(sex)), ''), '_na_') AS sex FROM reports),
dt AS (SELECT DISTINCT idx, lower(trim(term)) AS term FROM drug_terms),
et AS (SELECT DISTINCT idx, lower(trim(term)) AS term FROM event_terms),
posts AS MATERIALIZED (
  SELECT 'de' AS family, dt.term AS a, et.term AS b, bucket, idx, day FROM base JOIN dt USING (idx) JOIN et USING (idx)
  UNION ALL SELECT 'ds', term, sex, bucket, idx, day FROM base JOIN dt USING (idx)
  UNION ALL SELECT 'es', term, sex, bucket, idx, day FROM base JOIN et USING (idx)),
own AS MATERIALIZED (SELECT family, a, b, bucket, count(*) AS n FROM posts GROUP BY ALL),
blocks AS MATERIALIZED (
  SELECT x.family, x.a, x.b, x.bucket AS base, x.n + coalesce(y.n, 0) AS n
  FROM own x LEFT JOIN own y ON x.family = y.family AND x.a = y.a AND x.b = y.b AND y.bucket = x.bucket + 1)"""


def _pairs(most: int) -> str:
    return f"""members AS MATERIALIZED (
  SELECT p.family, p.a, p.b, k.base, p.idx, p.day FROM posts p JOIN blocks k
  ON p.family = k.family AND p.a = k.a AND p.b = k.b AND (p.bucket = k.base OR p.bucket = k.base + 1) WHERE k.n BETWEEN 2 AND {most}),
pairs AS MATERIALIZED (
  SELECT DISTINCT x.idx AS i, y.idx AS j FROM members x JOIN members y
  ON x.family = y.family AND x.a = y.a AND x.b = y.b AND x.base = y.base AND x.idx < y.idx AND abs(x.day - y.day) <= 90)"""


IDF = """total AS (SELECT greatest(count(*), 1) AS n FROM reports),
idf_d AS MATERIALIZED (SELECT term, count(*) AS df, ln(1 + (SELECT n FROM total) / count(*)) AS weight FROM drug_terms GROUP BY term),
idf_e AS MATERIALIZED (SELECT term, count(*) AS df, ln(1 + (SELECT n FROM total) / count(*)) AS weight FROM event_terms GROUP BY term),
tot_d AS MATERIALIZED (SELECT idx, sum(weight) AS total FROM drug_terms JOIN idf_d USING (term) GROUP BY idx),
tot_e AS MATERIALIZED (SELECT idx, sum(weight) AS total FROM event_terms JOIN idf_e USING (term) GROUP BY idx)"""


def _f32(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


_BOTH = "CASE WHEN x.{0} IS NOT NULL AND y.{0} IS NOT NULL THEN {1} END"
FEATURES = f"""shared_d AS MATERIALIZED (
  SELECT i, j, sum(weight) AS w FROM pairs JOIN drug_terms s ON s.idx = i JOIN drug_terms t ON t.idx = j AND t.term = s.term JOIN idf_d ON idf_d.term = s.term GROUP BY i, j),
shared_e AS MATERIALIZED (
  SELECT i, j, sum(weight) AS w FROM pairs JOIN event_terms s ON s.idx = i JOIN event_terms t ON t.idx = j AND t.term = s.term JOIN idf_e ON idf_e.term = s.term GROUP BY i, j),
compared AS MATERIALIZED (
  SELECT i, j, x.report_id AS report_id_a, y.report_id AS report_id_b,
    {_f32(_BOTH.format("age", "greatest(0.0, 1.0 - abs(x.age - y.age) / 8.0)"))} AS age_sim,
    {_f32(_BOTH.format("sex", "CAST(lower(trim(x.sex)) = lower(trim(y.sex)) AS INT)"))} AS sex_match,
    {_f32(_BOTH.format("seriousness", "CAST(lower(trim(x.seriousness)) = lower(trim(y.seriousness)) AS INT)"))} AS seriousness_match,
    {_f32("greatest(0.0, 1.0 - abs(x.report_day - y.report_day) / 90.0)")} AS temporal_sim,
    {_f32("coalesce(d.w / (dx.total + dy.total - d.w), 0.0)")} AS drug_jaccard,
    {_f32("coalesce(e.w / (ex.total + ey.total - e.w), 0.0)")} AS event_jaccard,
    coalesce(abs(x.age - y.age) > 5.0, false) OR coalesce(x.sex <> y.sex, false) AS conflict
  FROM pairs JOIN reports x ON x.idx = i JOIN reports y ON y.idx = j LEFT JOIN shared_d d USING (i, j) LEFT JOIN shared_e e USING (i, j)
  LEFT JOIN tot_d dx ON dx.idx = i LEFT JOIN tot_d dy ON dy.idx = j LEFT JOIN tot_e ex ON ex.idx = i LEFT JOIN tot_e ey ON ey.idx = j)"""

_AGREE = ", ".join(f"CAST({f} >= {AGREE.get(f, OTHER_AGREE)} AS INT) AS g_{f}" for f in FIELDS)
PATTERNS = f"""agreed AS MATERIALIZED (SELECT *, {_AGREE} FROM compared),
pat AS MATERIALIZED (SELECT {", ".join(f"g_{f}" for f in FIELDS)}, count(*) AS n FROM agreed GROUP BY ALL)"""


def _log_odds(probability: str, chance: str) -> str:
    parts = [f"CASE WHEN g_{f} = 1 THEN ln({chance}{k}) WHEN g_{f} = 0 THEN ln(1 - {chance}{k}) ELSE 0 END" for k, f in enumerate(FIELDS)]
    return " + ".join([probability, *parts])


def _posterior() -> str:
    up, down = _log_odds("ln(p)", "m"), _log_odds("ln(1 - p)", "u")
    high = f"greatest({up}, {down})"
    return f"exp(({up}) - {high}) / (exp(({up}) - {high}) + exp(({down}) - {high}) + 1e-12)"


_COLS = ", ".join(f"m{k}" for k in G)
EM = f"""us AS MATERIALIZED (SELECT {", ".join(f"least(greatest(sum(CASE WHEN g_{f} = 1 THEN n ELSE 0 END) / (sum(CASE WHEN g_{f} IS NOT NULL THEN n ELSE 0 END) + 1e-9), 1e-4), 1 - 1e-4) AS u{k}" for k, f in enumerate(FIELDS))} FROM pat),
em AS (
  SELECT 0 AS it, CAST(0.05 AS DOUBLE) AS p, {", ".join(f"CAST(greatest(0.9, u{k}) AS DOUBLE) AS m{k}" for k in G)}, CAST(1 AS DOUBLE) AS delta FROM us
  UNION ALL
  SELECT it + 1, q, {", ".join(f"n{k}" for k in G)}, greatest({", ".join(f"abs(n{k} - m{k})" for k in G)}) + abs(q - p) FROM (
    SELECT it, p, {_COLS}, least(greatest(sum(r * n) / sum(n), 1e-4), 0.5) AS q,
      {", ".join(f"least(greatest(greatest(sum(CASE WHEN g_{f} = 1 THEN r * n ELSE 0 END) / (sum(CASE WHEN g_{f} IS NOT NULL THEN r * n ELSE 0 END) + 1e-9), u{k}), 1e-4), 0.98) AS n{k}" for k, f in enumerate(FIELDS))}
    FROM (SELECT it, p, {_COLS}, us.*, pat.*, {_posterior()} AS r FROM em, us, pat WHERE delta >= 1e-6 AND it < 500)
    GROUP BY it, p, {_COLS}, {", ".join(f"u{k}" for k in G)})),
model AS MATERIALIZED (SELECT em.*, us.* FROM em, us ORDER BY it DESC LIMIT 1)"""

_SIGNALS = " + ".join(f"coalesce(CAST({f} > {x} AS INT), 0)" for f, x in SIGNALS.items())


def _vetoed(p: str) -> str:
    return f"CASE WHEN drug_jaccard = 0.0 OR event_jaccard = 0.0 OR {_SIGNALS} < 2 THEN 0.0 ELSE {p} END"


_NUM = " + ".join(f"coalesce({f} * CAST({REVIEW_WEIGHTS[f]} AS DOUBLE), 0.0)" for f in FIELDS)
_DEN = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN CAST({REVIEW_WEIGHTS[f]} AS DOUBLE) ELSE 0.0 END" for f in FIELDS)
_MANUAL = _vetoed(f"CASE WHEN {_DEN} > 0 THEN ({_NUM}) / ({_DEN}) ELSE 0.0 END")
_SUM = " + ".join(f"coalesce({f}, 0.0)" for f in FIELDS)
_KNOWN = " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in FIELDS)
MANUAL = f"""scored AS MATERIALIZED (SELECT *, {_MANUAL} AS raw FROM agreed),
vetoed AS MATERIALIZED (SELECT *, CASE WHEN conflict THEN 0.0 ELSE raw END AS p, coalesce({_f32(f"({_SUM}) / nullif({_KNOWN}, 0)")}, 0.0) AS tiebreak FROM scored),
strong AS MATERIALIZED (SELECT i, j, p, tiebreak FROM vetoed WHERE p >= 0.7),
ends AS (SELECT i AS node, * FROM strong UNION ALL SELECT j, * FROM strong),
lost AS (SELECT DISTINCT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY node ORDER BY p DESC, tiebreak DESC, i, j) AS rank FROM ends) WHERE rank > 2),
pruned AS MATERIALIZED (SELECT v.* REPLACE (CASE WHEN lost.i IS NOT NULL THEN 0.0 ELSE v.p END AS p), lost.i IS NOT NULL AS pruned FROM vetoed v LEFT JOIN lost ON v.i = lost.i AND v.j = lost.j)"""
COMPONENTS = """edge AS MATERIALIZED (SELECT i AS a, j AS b FROM pruned WHERE p >= 0.7 UNION SELECT j, i FROM pruned WHERE p >= 0.7),
reach AS (SELECT a AS node, a AS seen FROM edge UNION SELECT reach.node, edge.b FROM reach JOIN edge ON reach.seen = edge.a),
comp AS MATERIALIZED (SELECT node, min(seen) AS component FROM reach GROUP BY node),
labels AS MATERIALIZED (SELECT idx, report_id, report_day, coalesce(component, idx) AS cluster_id, true_cluster_id FROM reports LEFT JOIN comp ON idx = node),
seen AS MATERIALIZED (SELECT report_id, report_day, cluster_id, true_cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM labels),
kept AS MATERIALIZED (SELECT *, cluster_size = 1 OR row_number() OVER (PARTITION BY cluster_id ORDER BY report_day, report_id) = 1 AS keep FROM seen)"""

_TO_BLOCKS = [RARE, BLOCKS]
_TO_PAIRS = [*_TO_BLOCKS, _pairs(300)]
_TO_FEATURES = [*_TO_PAIRS, IDF, FEATURES, PATTERNS]
_TO_EM = [*_TO_FEATURES, EM]
_TO_PRUNED = [*_TO_FEATURES, MANUAL]
_TO_LABELS = [*_TO_PRUNED, COMPONENTS]


def _sql(chain: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(chain)} {select}" if chain else select


_R6 = ", ".join(f"round({f}, 6) AS {f}" for f in FIELDS)
_FIELD_ROWS = lambda value: " UNION ALL ".join(f"SELECT '{f}' AS field, {value.format(k=k)}" for k, f in enumerate(FIELDS))
_JOINED = "array_to_string(drugs, '{0}') AS {1}, array_to_string(events, '{0}') AS {2}"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**{d: d for d in DRUGS}, **BRANDS}.items()) + "}"
_WORDS = "[" + ", ".join(f"'{w}'" for w in [*BRANDS, *DRUGS, "unknown"]) + "]"
_N = len(BRANDS) + len(DRUGS) + 1

ORACLES: dict[str, str] = {
    "scan_reports": _sql([RARE], f"SELECT report_id, age, sex, seriousness, report_day, {_JOINED.format(';', 'drugs', 'events')}, true_cluster_id FROM reports"),
    "reports_to_csv_shape": _sql([RARE], f"SELECT report_id AS ReportID, age AS Age, coalesce(sex, '') AS Sex, seriousness AS Seriousness, report_day AS ReportDay, {_JOINED.format(';', 'Drugs', 'Events')}, true_cluster_id AS TrueClusterID FROM reports"),
    "reports_display": _sql([RARE], f"SELECT report_id, age, sex, seriousness, report_day, {_JOINED.format('; ', 'drugs', 'events')} FROM reports"),
    "parse_reports": """SELECT event_id AS idx, CAST(event_id % 1000 AS VARCHAR) AS report_id,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 <> 0 THEN CAST(event_id % 90 AS DOUBLE) END AS age,
  CASE WHEN event_id % 5 <> 0 THEN upper(event_type[1]) || lower(event_type[2:]) END AS sex,
  CASE WHEN event_id % 3 = 0 THEN 'Not known' END AS seriousness,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 400 - 200 END AS report_day,
  CASE WHEN event_id % 6 = 0 THEN event_id % 50 END AS true_cluster_id,
  array_to_string(list_sort(list_distinct(['b', event_type])), ';') AS drugs, CASE WHEN event_id % 4 = 0 THEN 'e1;e2' ELSE '' END AS events FROM events""",
    "split_terms": "SELECT event_id, 'a|' || event_type || '|x' || (event_id % 5) AS terms FROM events",
    "unique_ids": "SELECT idx, CASE WHEN n > 1 THEN r || '#' || n ELSE r END AS report_id FROM (SELECT event_id AS idx, CAST(event_id % 997 AS VARCHAR) AS r, row_number() OVER (PARTITION BY event_id % 997 ORDER BY event_id) AS n FROM events)",
    "flatten_case_json": """SELECT CAST(event_id AS VARCHAR) AS ReportID, round(CASE WHEN a BETWEEN 0 AND 120 THEN a END, 6) AS Age,
  CASE event_id % 4 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE '' END AS Sex, CASE WHEN event_id % 2 = 0 THEN 'Serious' ELSE 'Non-serious' END AS Seriousness,
  CAST(CASE WHEN event_id % 4 = 0 THEN DATE '2016-02-29' - DATE '2015-01-01' WHEN event_id % 4 = 1 THEN 0 WHEN event_id % 5 = 0 THEN -1 ELSE 0 END AS BIGINT) AS ReportDay,
  'Drug' || (event_id % 30) || ';gen' || (event_id % 7) AS Drugs, event_type AS Events
FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN CASE event_id % 5 WHEN 1 THEN round_even((event_id % 1500) / 12.0, 1) WHEN 2 THEN round_even((event_id % 1500) / 365.25, 1) ELSE CAST(event_id % 1500 AS DOUBLE) END END AS a FROM events)
WHERE event_id % 17 <> 0 AND event_id % 19 <> 0""",
    "brand_lookup": f"SELECT event_id, raw, {_MAP}[raw] AS generic FROM (SELECT event_id, {_WORDS}[event_id % {_N} + 1] AS raw FROM events)",
    **{f"block_{f}": _sql(_TO_BLOCKS, f"SELECT * FROM posts WHERE family = '{f}'") for f in ("de", "ds", "es")},
    "candidate_pairs": _sql(_TO_PAIRS, "SELECT * FROM pairs"),
    "candidate_pairs_medium": _sql([MEDIUM, BLOCKS, _pairs(300)], "SELECT * FROM pairs"),
    "candidate_pairs_small_blocks": _sql([*_TO_BLOCKS, _pairs(8)], "SELECT * FROM pairs"),
    "blocking_stats": _sql(
        [*_TO_BLOCKS, _pairs(8)],
        "SELECT (SELECT count(*) FROM reports) AS n_reports, (SELECT count(*) FROM (SELECT DISTINCT family, a, b FROM blocks)) AS n_blocks, (SELECT count(*) FROM pairs) AS n_candidate_pairs, (SELECT count(*) FROM blocks WHERE n > 8) AS skipped_oversized_blocks, CAST(0 AS BIGINT) AS truncated",
    ),
    "pair_gather": _sql(_TO_PAIRS, "SELECT i AS i_idx, j AS j_idx, x.age AS age_i, y.age AS age_j, lower(x.sex) AS sex_i, lower(y.sex) AS sex_j, x.report_day AS day_i, y.report_day AS day_j FROM pairs JOIN reports x ON x.idx = i JOIN reports y ON y.idx = j"),
    "pair_features": _sql(_TO_FEATURES, f"SELECT i, j, {_R6}, conflict FROM compared"),
    "conflict_mask": _sql(_TO_FEATURES, "SELECT i, j, conflict FROM compared"),
    "idf_drug": _sql([*_TO_BLOCKS, IDF], "SELECT term, df, round(weight, 6) AS weight FROM idf_d"),
    "idf_event": _sql([*_TO_BLOCKS, IDF], "SELECT term, df, round(weight, 6) AS weight FROM idf_e"),
    "weight_totals": _sql([*_TO_BLOCKS, IDF], "SELECT coalesce(d.idx, e.idx) AS idx, round(d.total, 6) AS drugs_total, round(e.total, 6) AS events_total FROM tot_d d FULL JOIN tot_e e ON d.idx = e.idx"),
    "jaccard": _sql(
        _TO_PAIRS,
        "SELECT i, j, round(CASE WHEN s = 0 THEN 0.0 ELSE s / (len(a) + len(b) - s) END, 6) AS jaccard FROM (SELECT i, j, x.drugs AS a, y.drugs AS b, len(list_intersect(x.drugs, y.drugs)) AS s FROM pairs JOIN reports x ON x.idx = i JOIN reports y ON y.idx = j)",
    ),
    "agreement_patterns": _sql(_TO_FEATURES, "SELECT * FROM pat"),
    "u_probabilities": _sql(_TO_EM, f"SELECT field, round(u, 6) AS u FROM ({_FIELD_ROWS('u{k} AS u FROM us')})"),
    "em_fit": _sql(_TO_EM, f"SELECT field, round(m, 6) AS m, round(p, 6) AS p, n_iter FROM ({_FIELD_ROWS('m{k} AS m, p, CAST(it AS BIGINT) AS n_iter FROM model')})"),
    "learned_weights": _sql(_TO_EM, f"SELECT field, round(log2(greatest(m / (u + 1e-9), 1e-3)), 2) AS weight FROM ({_FIELD_ROWS('m{k} AS m, u{k} AS u FROM model')})"),
    "scored_pairs_auto": _sql(_TO_EM, f"SELECT i, j, round({_vetoed(_posterior())}, 6) AS p FROM agreed, model"),
    "scored_pairs_prior": _sql([*_TO_FEATURES, f"prior AS (SELECT 0.05 AS p, {', '.join(f'0.9 AS m{k}, 0.1 AS u{k}' for k in G)})"], f"SELECT i, j, round({_vetoed(_posterior())}, 6) AS p FROM agreed, prior"),
    "scored_pairs_manual": _sql(_TO_PRUNED, "SELECT i, j, round(raw, 6) AS p FROM scored"),
    "signal_count": _sql(_TO_FEATURES, f"SELECT i, j, {_SIGNALS} AS n_signals FROM compared"),
    "vetoed_scores": _sql(_TO_PRUNED, "SELECT i, j, round(p, 6) AS p FROM vetoed"),
    "strong_edges": _sql(_TO_PRUNED, "SELECT i, j, round(p, 6) AS p FROM strong"),
    "prune_ambiguous": _sql(_TO_PRUNED, "SELECT i, j, round(p, 6) AS p, pruned FROM pruned"),
    "pruned_per_report": _sql(_TO_PRUNED, "SELECT idx, count(*) AS ambiguous_matches_pruned FROM (SELECT i AS idx FROM lost UNION ALL SELECT j FROM lost) GROUP BY idx"),
    "crowded_reports": _sql(_TO_PRUNED, "SELECT count(DISTINCT idx) AS n_crowded FROM (SELECT i AS idx FROM lost UNION ALL SELECT j FROM lost)"),
    "audit_pairs": _sql(_TO_PRUNED, f"SELECT report_id_a, report_id_b, round(p, 6) AS match_probability, {_R6} FROM pruned WHERE p >= 0.3"),
    "labelled_pairs": _sql(_TO_PRUNED, 'SELECT report_id_a AS "Report A", report_id_b AS "Report B", round(p, 6) AS "Match score", ' + ", ".join(f'round({f}, 6) AS "{LABELS[f]}"' for f in FIELDS) + " FROM pruned WHERE p >= 0.3"),
    "components": _sql(_TO_LABELS, "SELECT node, component FROM comp"),
    "all_singletons": _sql([RARE], "SELECT idx, row_number() OVER (ORDER BY idx) AS cluster_id, CAST(1 AS BIGINT) AS cluster_size FROM reports"),
    "contingency_grouping_sets": _sql(_TO_LABELS, "SELECT grouping(cluster_id, true_cluster_id) AS level, cluster_id AS found, true_cluster_id AS truth, count(*) AS n FROM labels GROUP BY GROUPING SETS ((cluster_id, true_cluster_id), (cluster_id), (true_cluster_id))"),
    "pairwise_metrics": _sql(
        [
            *_TO_LABELS,
            "sums AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM labels GROUP BY cluster_id, true_cluster_id)) AS both_, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM labels GROUP BY cluster_id)) AS found_, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM labels GROUP BY true_cluster_id)) AS truth_)",
            "rates AS (SELECT both_ / greatest(found_, 1.0) AS p, both_ / greatest(truth_, 1.0) AS r FROM sums)",
        ],
        "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1 FROM rates",
    ),
    "group_sizes": _sql(_TO_LABELS, "SELECT cluster_id, count(*) AS n_reports FROM seen WHERE cluster_size > 1 GROUP BY cluster_id"),
    "group_ids": _sql(_TO_LABELS, "SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS position FROM (SELECT DISTINCT cluster_id FROM seen WHERE cluster_size > 1)"),
    "group_navigation": _sql(
        _TO_LABELS,
        "SELECT cluster_id, coalesce(lag(cluster_id) OVER (ORDER BY cluster_id), (SELECT max(cluster_id) FROM seen WHERE cluster_size > 1)) AS previous, coalesce(lead(cluster_id) OVER (ORDER BY cluster_id), (SELECT min(cluster_id) FROM seen WHERE cluster_size > 1)) AS next FROM (SELECT DISTINCT cluster_id FROM seen WHERE cluster_size > 1)",
    ),
    "dup_members": _sql(_TO_LABELS, "SELECT report_id, cluster_id, cluster_size FROM seen WHERE cluster_size > 1"),
    "group_members": _sql(_TO_LABELS, "SELECT report_id, cluster_id, report_day FROM seen WHERE cluster_id = (SELECT cluster_id FROM seen ORDER BY cluster_size DESC, cluster_id LIMIT 1)"),
    "cluster_details": _sql(_TO_LABELS, f"SELECT s.report_id, s.cluster_id, s.cluster_size, r.age, r.sex, r.seriousness, r.report_day, {_JOINED.format('; ', 'drugs', 'events')} FROM seen s JOIN reports r ON s.report_id = r.report_id"),
    "keep_earliest": _sql(_TO_LABELS, "SELECT report_id, keep FROM kept WHERE cluster_size > 1"),
    "decision_log": _sql(_TO_LABELS, "SELECT report_id, cluster_id, cluster_size, CASE WHEN keep THEN 'Keep' ELSE 'Remove' END AS decision, CASE WHEN keep THEN 'KEEP' ELSE 'REMOVE_DUPLICATE' END AS reviewer_decision FROM kept"),
    "cleaned_data": _sql(_TO_LABELS, "SELECT report_id, cluster_id, cluster_size FROM kept WHERE keep"),
    "review_summary": _sql(_TO_LABELS, "SELECT count(*) AS n_reports, count(DISTINCT CASE WHEN cluster_size > 1 THEN cluster_id END) AS n_groups, count(*) FILTER (cluster_size > 1) AS n_in_groups, count(*) FILTER (NOT keep) AS n_removed, max(cluster_size) AS max_cluster, CAST(0 AS BIGINT) AS n_crowded FROM kept"),
    "in_group_pairs": _sql(_TO_LABELS, "SELECT report_id_a, report_id_b, a.cluster_id, round(p, 6) AS match_probability FROM pruned JOIN seen a ON a.report_id = report_id_a JOIN seen b ON b.report_id = report_id_b AND a.cluster_id = b.cluster_id WHERE p >= 0.3"),
    "run_diagnostics": _sql([*_TO_PRUNED, EM], "SELECT (SELECT count(*) FROM compared WHERE conflict) AS conflicts, (SELECT count(*) FROM lost) AS pruned, CAST((SELECT it FROM model) AS BIGINT) AS em_iterations, (SELECT count(*) FROM pat) AS em_patterns, (SELECT count(*) FROM pairs) AS pairs"),
    "grouped_best_pairs": _sql(
        [
            *_TO_PRUNED,
            "ends2 AS (SELECT i AS node, i, j, p FROM pruned WHERE p >= 0.7 UNION ALL SELECT j, i, j, p FROM pruned WHERE p >= 0.7)",
            "best AS (SELECT node, min(i) AS i, min(j) AS j FROM (SELECT *, max(p) OVER (PARTITION BY node) AS top FROM ends2) WHERE p = top GROUP BY node HAVING count(*) = 1)",
        ],
        "SELECT i, j FROM best GROUP BY i, j HAVING count(*) = 2",
    ),
    "group_shapes": _sql(
        [
            *_TO_LABELS,
            "sized AS (SELECT component, count(*) AS n FROM comp GROUP BY component)",
            "drawn AS (SELECT component, count(*) AS m FROM pruned JOIN comp ON i = node WHERE p >= 0.7 GROUP BY component)",
        ],
        "SELECT component, n FROM sized JOIN drawn USING (component) WHERE n * (n - 1) / 2 = m",
    ),
    "weight_scale": _sql(
        _TO_EM,
        "SELECT CASE field " + " ".join(f"WHEN '{f}' THEN '{LABELS[f]}'" for f in FIELDS) + f" END AS field, round(w, 2) AS weight, round(greatest(max(w) OVER (), 1.0), 2) AS top FROM (SELECT field, log2(greatest(m / (u + 1e-9), 1e-3)) AS w FROM ({_FIELD_ROWS('m{k} AS m, u{k} AS u FROM model')}))",
    ),
    "preview_reports": _sql([RARE], f"SELECT report_id, age, sex, seriousness, report_day, {_JOINED.format(';', 'drugs', 'events')}, true_cluster_id FROM reports ORDER BY idx LIMIT 3"),
    "shuffled_reports": _sql([RARE], "SELECT report_id, true_cluster_id FROM reports"),
    "fuzzy_drug": """SELECT event_id, raw, coalesce(MAP {'atorvastatn': 'atorvastatin', 'metfomin': 'metformin', 'lisinoprl': 'lisinopril', 'sertralin': 'sertraline', 'amlodipin': 'amlodipine', 'omeprazol': 'omeprazole', 'losartn': 'losartan', 'ibuprofin': 'ibuprofen', 'gabapentn': 'gabapentin'}[raw], raw) AS norm
FROM (SELECT event_id, ['atorvastatn', 'metfomin', 'lisinoprl', 'sertralin', 'amlodipin', 'omeprazol', 'losartn', 'ibuprofin', 'gabapentn', 'zzyzx', 'warfarin', 'xatorvastatin', 'atorva'][event_id % 13 + 1] AS raw FROM events)""",
}
_METRICS = ORACLES["pairwise_metrics"].rpartition(" SELECT round(p, 6)")[0]
ORACLES["shown_metrics"] = _METRICS + " SELECT printf('%.2f', p) AS precision, printf('%.2f', r) AS recall, printf('%.2f', f) AS f1, printf('%9.3f %7.3f %6.3f', p, r, f) AS line FROM (SELECT p, r, 2 * p * r / greatest(p + r, 1e-9) AS f FROM rates)"
ORACLES["shown_groups"] = _sql(_TO_LABELS, "SELECT cluster_id, 'Group ' || format('{:,}', row_number() OVER (ORDER BY cluster_id)) || ' of ' || format('{:,}', count(*) OVER ()) || ' with ' || format('{:,}', n) || ' reports' AS caption FROM (SELECT cluster_id, count(*) AS n FROM seen WHERE cluster_size > 1 GROUP BY cluster_id)")
ORACLES["case_sample"] = "SELECT ReportID, CASE WHEN Age IS NOT NULL THEN CAST(Age AS VARCHAR) END AS Age, nullif(Sex, '') AS Sex, Seriousness, CAST(ReportDay AS VARCHAR) AS ReportDay, Drugs, Events FROM (" + ORACLES["flatten_case_json"] + ")"

#: What the normaliser's words mean: noisy wordings are made from their terms; the others are known cases.
_MEANT = {w: term for term, words in NOISE.items() for w in words} | {
    "FORMOTEROL FUMARATE DIHYDRATE": "formoterol", "Clotrimazole Topical": "clotrimazole", "POTASSIUM CHLORIDE": "potassium chloride",
    "SODIUM CHLORIDE": "sodium chloride", "Calcium": "calcium", "FERROUS SULFATE": "ferrous sulfate", "LOSARTAN POTASSIUM": "losartan",
    "OMEPRAZOLE MAGNESIUM": "omeprazole", "ASPIRIN (ACETYLSALICYLIC ACID)": "aspirin", "LIPITOR (ATORVASTATIN CALCIUM)": "atorvastatin",
    "valsartan": "valsartan", "Diovan": "valsartan", "vitamin b12 1000mcg": "vitamin b12", "20 mg": "20 mg", "(oral)": "oral", "5-fu": "fu", "  ": "",
    "Chronic obstructive pulmonary disease": "chronic obstructive pulmonary disease", "acute myocardial infarction": "acute myocardial infarction",
    "severe migraine": "headache", "Pollakiuria": "pollakiuria", "Haematemesis": "haematemesis", "AKI": "acute kidney injury",
    "Injection site pain": "injection site pain", "Blood calcium decreased": "blood calcium decreased", "can't sleep": "insomnia",
    "mild feeling of nausea": "nausea", "patient felt dizzy, then rash": "dizziness", "(hives)": "rash", "...": "",
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return f"[{', '.join(map(_quoted, words))}]"


def _meant(word: str, words: list[str]) -> str:
    return f"MAP {{{', '.join(f'{_quoted(w)}: {_quoted(_MEANT[w])}' for w in dict.fromkeys(words))}}}[{word}]"


for _name, _some in (("normalized_drugs", DRUG_WORDS), ("normalized_events", EVENT_WORDS)):
    ORACLES[_name] = f"SELECT event_id, raw, {_meant('raw', _some)} AS norm FROM (SELECT event_id, {_list(_some)}[event_id % {len(_some)} + 1] AS raw FROM events)"
ORACLES["normalized_sets"] = f"""SELECT event_id, string_agg(DISTINCT norm, ';' ORDER BY norm) AS events
FROM (SELECT event_id, {_meant('raw', EVENT_WORDS)} AS norm FROM (SELECT event_id, {_list(EVENT_WORDS)}[(event_id + 7 * i) % {len(EVENT_WORDS)} + 1] AS raw FROM events, range(0, 3) AS r(i)))
WHERE norm <> '' GROUP BY event_id"""
