"""SQL of the registered queries for an independent engine (DuckDB)."""

from __future__ import annotations

_CLS = """cls AS (SELECT o_orderkey AS "txId", CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS time_step,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Illicit' WHEN o_orderpriority = '5-LOW' THEN 'Unknown' ELSE 'Licit' END AS class_label FROM orders)"""
_EDGE = """edge AS (SELECT DISTINCT a AS "txId1", b AS "txId2" FROM (
  SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders
  UNION ALL SELECT l_orderkey, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey) FROM lineitem) WHERE b IS NOT NULL AND a <> b)"""
_FEAT = (
    _EDGE
    + """, li AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS i, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS x,
  CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) AS f, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
agg AS (SELECT l_orderkey, min(i) / 100.0::DOUBLE AS "in_BTC_min", max(i) / 100.0::DOUBLE AS "in_BTC_max", CAST(sum(i) AS DOUBLE) / count(i) / 100.0::DOUBLE AS "in_BTC_mean", median(i) / 100.0::DOUBLE AS "in_BTC_median", CAST(sum(i) AS DOUBLE) / 100.0::DOUBLE AS "in_BTC_total",
  min(x) / 10000.0::DOUBLE AS "out_BTC_min", max(x) / 10000.0::DOUBLE AS "out_BTC_max", CAST(sum(x) AS DOUBLE) / count(x) / 10000.0::DOUBLE AS "out_BTC_mean", median(x) / 10000.0::DOUBLE AS "out_BTC_median", CAST(sum(x) AS DOUBLE) / 10000.0::DOUBLE AS "out_BTC_total",
  CAST(sum(f) AS DOUBLE) / 10000.0::DOUBLE AS fees, CAST(sum(q) AS DOUBLE) AS size, count(DISTINCT l_partkey) AS num_input_addresses, count(DISTINCT l_suppkey) AS num_output_addresses FROM li GROUP BY l_orderkey),
feat AS (SELECT o_orderkey AS "txId", CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS time_step, (CAST(round(o_totalprice * 100) AS BIGINT) - 100000) / 1e8::DOUBLE AS "total_BTC",
  agg.* EXCLUDE (l_orderkey), ind AS in_txs_degree, outd AS out_txs_degree
  FROM orders LEFT JOIN agg ON l_orderkey = o_orderkey LEFT JOIN (SELECT "txId2" AS k, count(*) AS ind FROM edge GROUP BY 1) a ON a.k = o_orderkey LEFT JOIN (SELECT "txId1" AS k, count(*) AS outd FROM edge GROUP BY 1) b ON b.k = o_orderkey)"""
)
_SCORE = (
    _CLS
    + """, score AS (SELECT cls."txId", time_step, class_label, CASE class_label WHEN 'Illicit' THEN 1 WHEN 'Licit' THEN 0 END AS class,
  (CASE WHEN class_label = 'Illicit' THEN 3000 + b * 7 ELSE b * 6 END) / 10000.0::DOUBLE AS pred_proba
  FROM cls JOIN (SELECT o_orderkey, (o_orderkey * 7919 + o_custkey * 104729) % 1000 AS b FROM orders) ON o_orderkey = "txId")"""
)
_PRED = _SCORE + """, pred AS (SELECT *, CAST(pred_proba >= 0.4::DOUBLE AS INTEGER) AS pred_class, CASE WHEN pred_proba >= 0.4::DOUBLE THEN 'Illicit' ELSE 'Licit' END AS pred_class_label FROM score)"""
_ALLOWED = f"""{_CLS}, {_EDGE}, ill AS (SELECT "txId" AS id FROM cls WHERE class_label = 'Illicit'),
ie AS (SELECT "txId1" AS src, "txId2" AS dst FROM edge WHERE "txId1" IN (SELECT id FROM ill) AND "txId2" IN (SELECT id FROM ill)),
seeds AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS subnetwork_id, id AS seed_txn FROM ill)"""
#: The same over predicted labels, as the batch run takes its seeds from the classifier.
_ALLOWED_PREDICTED = _ALLOWED.replace(_CLS, _PRED.replace("0.4::DOUBLE", "0.55::DOUBLE")).replace("FROM cls WHERE class_label = 'Illicit'", "FROM pred WHERE pred_class_label = 'Illicit'")
_REACH = (
    _ALLOWED
    + """, reach(seed, node, hop) USING KEY (seed, node) AS (SELECT id, id, 0 FROM ill
  UNION SELECT f.seed, e.dst, min(f.hop) + 1 FROM reach f JOIN ie e ON f.node = e.src LEFT JOIN recurring.reach r ON r.seed = f.seed AND r.node = e.dst WHERE r.seed IS NULL {limit} GROUP BY f.seed, e.dst),
nd AS (SELECT node AS txn_id, CAST(hop AS INTEGER) AS hop, subnetwork_id, seed_txn FROM reach JOIN seeds ON seed = seed_txn),
ed AS (SELECT ie.src AS src_txn_id, ie.dst AS dst_txn_id, a.hop AS src_txn_hop, b.hop AS dst_txn_hop, a.subnetwork_id, a.seed_txn FROM nd a JOIN ie ON a.txn_id = ie.src JOIN nd b ON b.subnetwork_id = a.subnetwork_id AND b.txn_id = ie.dst {expand})"""
)
_FULL = _REACH.format(limit="", expand="")
_HOP2 = _REACH.format(limit="AND f.hop < 2", expand="WHERE a.hop < 2")
_DEDUP = """, sz AS (SELECT subnetwork_id AS id, seed_txn AS seed, count(*) AS size FROM nd GROUP BY 1, 2),
inside AS (SELECT a.subnetwork_id AS id, b.subnetwork_id AS o_id FROM nd a JOIN nd b USING (txn_id) GROUP BY 1, 2 HAVING count(*) = (SELECT size FROM sz WHERE sz.id = a.subnetwork_id)),
early AS (SELECT i.id, i.o_id, o.size AS o_size FROM inside i JOIN sz s ON s.id = i.id JOIN sz o ON o.id = i.o_id WHERE i.id <> i.o_id AND (o.size > s.size OR (o.size = s.size AND i.o_id < i.id))),
rep AS (SELECT sz.id, size, seed, CASE WHEN w.id IS NULL THEN 'kept' ELSE 'dropped_subset' END AS status, coalesce(w.o, sz.id) AS kept_as FROM sz
  LEFT JOIN (SELECT id, arg_min(o_id, (-o_size, o_id)) AS o FROM early WHERE o_id NOT IN (SELECT id FROM early) GROUP BY id) w ON w.id = sz.id)"""
_KEPT = (
    _FULL
    + _DEDUP
    + """, kn AS (SELECT * FROM nd WHERE subnetwork_id IN (SELECT id FROM rep WHERE status = 'kept')), ke AS (SELECT * FROM ed WHERE subnetwork_id IN (SELECT id FROM rep WHERE status = 'kept'))"""
)
_MERGED = (
    _KEPT
    + """, sl AS (SELECT DISTINCT a.subnetwork_id AS a, b.subnetwork_id AS b FROM kn a JOIN kn b USING (txn_id)),
comp(node, lab) USING KEY (node) AS (SELECT DISTINCT subnetwork_id, subnetwork_id FROM kn
  UNION SELECT sl.b, min(f.lab) FROM comp f JOIN sl ON sl.a = f.node JOIN recurring.comp r ON r.node = sl.b WHERE f.lab < r.lab GROUP BY sl.b),
mid AS (SELECT node AS subnetwork_id, lab AS merged_subnetwork_id FROM comp),
rn AS (SELECT kn.*, merged_subnetwork_id FROM kn JOIN mid USING (subnetwork_id)), re AS (SELECT ke.*, merged_subnetwork_id FROM ke JOIN mid USING (subnetwork_id)),
fn AS (SELECT merged_subnetwork_id, txn_id, min(hop) AS min_hop, seeds_in_group FROM rn JOIN (SELECT merged_subnetwork_id, list_sort(list(DISTINCT seed_txn)) AS seeds_in_group FROM rn GROUP BY 1) USING (merged_subnetwork_id) GROUP BY 1, 2, 4),
fe AS (SELECT merged_subnetwork_id, src_txn_id, dst_txn_id, min(src_txn_hop) AS min_src_hop, min(dst_txn_hop) AS min_dst_hop FROM re GROUP BY 1, 2, 3),
sm AS (SELECT n.*, coalesce(ec, 0) AS edge_count FROM (SELECT merged_subnetwork_id, list_sort(list(DISTINCT txn_id)) AS txns, count(DISTINCT txn_id) AS node_count, max(hop) AS depth, list_sort(list(DISTINCT seed_txn)) AS seeds, count(DISTINCT seed_txn) AS seed_count FROM rn GROUP BY 1) n
  LEFT JOIN (SELECT merged_subnetwork_id, count(*) AS ec FROM re GROUP BY 1) e USING (merged_subnetwork_id))"""
)
#: Nodes of a group with edges, and 130 steps of PageRank; a group's values stop where its change falls below N * 1e-8.
_PR = (
    _MERGED
    + """, gn AS (SELECT DISTINCT merged_subnetwork_id AS g, node FROM (SELECT merged_subnetwork_id, src_txn_id AS node FROM fe UNION ALL SELECT merged_subnetwork_id, dst_txn_id FROM fe)),
gs AS (SELECT g, node, count(*) OVER (PARTITION BY g) AS n, o FROM gn LEFT JOIN (SELECT merged_subnetwork_id AS g, src_txn_id AS node, count(*) AS o FROM fe GROUP BY 1, 2) USING (g, node)),
pr(k, g, node, n, o, p, ch) AS (SELECT 0, g, node, n, o, 1.0::DOUBLE / n, 1e9::DOUBLE FROM gs
  UNION ALL SELECT k + 1, g, node, n, o, q, sum(abs(q - p)) OVER (PARTITION BY g) FROM (
    SELECT pr.k, pr.g, pr.node, pr.n, pr.o, pr.p, pr.ch, 0.15::DOUBLE / pr.n + 0.85::DOUBLE * (coalesce(fl.f, 0) + coalesce(sum(CASE WHEN pr.o IS NULL THEN pr.p END) OVER (PARTITION BY pr.g), 0) / pr.n) AS q
    FROM pr LEFT JOIN (SELECT e.merged_subnetwork_id AS g, e.dst_txn_id AS node, sum(s.p / s.o) AS f FROM pr s JOIN fe e ON e.merged_subnetwork_id = s.g AND e.src_txn_id = s.node GROUP BY 1, 2) fl ON fl.g = pr.g AND fl.node = pr.node
    WHERE pr.k < 100) WHERE ch >= n * 1e-8::DOUBLE),
pagerank AS (SELECT g AS merged_subnetwork_id, node, arg_max(p, k) AS pagerank FROM pr GROUP BY 1, 2)"""
)
_PRC = (
    _PR
    + """, prc AS (SELECT fn.merged_subnetwork_id, txn_id AS node, min_hop, coalesce(pagerank, 1.0::DOUBLE / count(*) OVER (PARTITION BY fn.merged_subnetwork_id)) AS pagerank FROM fn LEFT JOIN pagerank p ON p.merged_subnetwork_id = fn.merged_subnetwork_id AND p.node = txn_id)"""
)


def _pct(c: str, g: str = "merged_subnetwork_id") -> str:
    v = f"round(CAST({c} AS DOUBLE), 9)"
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {g} ORDER BY {v} NULLS LAST) + (count({v}) OVER (PARTITION BY {g}, {v}) - 1) / 2.0::DOUBLE) / count({v}) OVER (PARTITION BY {g}) END"


def _composite(base: str) -> str:
    """CTEs up to comps from base (merged_subnetwork_id, node, pagerank, in_BTC_total, in_txs_degree, out_txs_degree)."""
    return f""", cb AS (SELECT merged_subnetwork_id, node, coalesce("in_BTC_total", 0) AS "in_BTC_total", coalesce(in_txs_degree, 0) AS in_txs_degree, coalesce(out_txs_degree, 0) AS out_txs_degree, pagerank, pagerank IS NULL AS pagerank_missing FROM {base}),
cp AS (SELECT *, {_pct("pagerank")} AS pagerank_pct, {_pct('"in_BTC_total"')} AS in_btc_pct, {_pct("in_txs_degree")} AS in_deg_pct, {_pct("out_txs_degree")} AS out_deg_pct FROM cb),
cq AS (SELECT *, 1 - out_deg_pct AS out_deg_pct_inv, "in_BTC_total" / (sum("in_BTC_total") OVER (PARTITION BY merged_subnetwork_id) + 1e-12::DOUBLE) AS in_btc_share FROM cp),
cr AS (SELECT *, 0.6::DOUBLE * coalesce(pagerank_pct, 0) AS pr_contrib, coalesce(pagerank_pct, 0) AS pagerank_pct_filled_for_contrib, 0.6::DOUBLE AS pr_weight, 0.3::DOUBLE AS val_weight, 0.07::DOUBLE AS in_weight, 0.03::DOUBLE AS out_weight, 0.3::DOUBLE * in_btc_pct AS val_contrib, 0.07::DOUBLE * in_deg_pct AS in_deg_contrib, 0.03::DOUBLE * out_deg_pct_inv AS out_deg_contrib FROM cq),
cs AS (SELECT *, pr_contrib + val_contrib + in_deg_contrib + out_deg_contrib AS composite_raw FROM cr),
comps AS (SELECT *, {_pct("composite_raw")} AS composite_pct, dense_rank() OVER (PARTITION BY merged_subnetwork_id ORDER BY round(composite_raw, 9) DESC) AS composite_rank FROM cs)"""


_COMP = _PRC + ", " + _FEAT.replace(_EDGE + ", ", "") + """, cbase AS (SELECT prc.merged_subnetwork_id, node, pagerank, "in_BTC_total", in_txs_degree, out_txs_degree FROM prc LEFT JOIN feat ON feat."txId" = node)""" + _composite("cbase")
_COMP_COLUMNS = """merged_subnetwork_id, node, round("in_BTC_total", 6) AS "in_BTC_total", in_txs_degree, out_txs_degree, round(pagerank, 6) AS pagerank, pagerank_missing, round(pagerank_pct, 6) AS pagerank_pct, round(in_btc_pct, 6) AS in_btc_pct, round(in_deg_pct, 6) AS in_deg_pct, round(out_deg_pct, 6) AS out_deg_pct,
  round(out_deg_pct_inv, 6) AS out_deg_pct_inv, round(in_btc_share, 6) AS in_btc_share, round(pagerank_pct_filled_for_contrib, 6) AS pagerank_pct_filled_for_contrib, pr_weight, val_weight, in_weight, out_weight, round(pr_contrib, 6) AS pr_contrib, round(val_contrib, 6) AS val_contrib, round(in_deg_contrib, 6) AS in_deg_contrib, round(out_deg_contrib, 6) AS out_deg_contrib, round(composite_raw, 6) AS composite_raw, round(composite_pct, 6) AS composite_pct, composite_rank"""
_ADDR = """, ain AS (SELECT c_name AS input_address, o_orderkey AS "txId" FROM orders JOIN customer ON o_custkey = c_custkey), aout AS (SELECT DISTINCT l_orderkey AS "txId", s_name AS output_address FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_SUMMARY = (
    _COMP
    + _ADDR
    + """, txs AS (SELECT c.merged_subnetwork_id AS subnetwork_id, c.node AS txn_id, true AS illicit_flag, prc.min_hop = 0 AS seed_flag, composite_rank AS investigation_order, c."in_BTC_total", composite_raw,
  coalesce(i.t, '') AS input_addresses, coalesce(o.t, '') AS output_addresses, coalesce(i.n, 0) AS n_inputs, coalesce(o.n, 0) AS n_outputs FROM comps c JOIN prc USING (merged_subnetwork_id, node)
  LEFT JOIN (SELECT "txId", string_agg(DISTINCT input_address, '; ' ORDER BY input_address) AS t, count(DISTINCT input_address) AS n FROM ain GROUP BY 1) i ON i."txId" = c.node
  LEFT JOIN (SELECT "txId", string_agg(DISTINCT output_address, '; ' ORDER BY output_address) AS t, count(DISTINCT output_address) AS n FROM aout GROUP BY 1) o ON o."txId" = c.node)"""
)
_DEG = """, dg AS (SELECT *, dense_rank() OVER (PARTITION BY merged_subnetwork_id ORDER BY in_degree DESC) AS "rank_inDeg", dense_rank() OVER (PARTITION BY merged_subnetwork_id ORDER BY out_degree) AS "rank_outDeg" FROM (
  SELECT g AS merged_subnetwork_id, node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM gs LEFT JOIN (SELECT merged_subnetwork_id AS g, dst_txn_id AS node, count(*) AS i FROM fe GROUP BY 1, 2) USING (g, node)))"""
_HOPS = """, mh AS (SELECT merged_subnetwork_id, node, min(h) AS min_hop FROM (SELECT merged_subnetwork_id, src_txn_id AS node, min_src_hop AS h FROM fe UNION ALL SELECT merged_subnetwork_id, dst_txn_id, min_dst_hop FROM fe) GROUP BY 1, 2)"""
_RANKS = (
    _COMP
    + _DEG
    + _HOPS
    + """, ranks AS (SELECT c.merged_subnetwork_id, c.node, composite_raw, composite_rank, pr_rank, in_degree, out_degree, "rank_inDeg", "rank_outDeg", mh.min_hop FROM comps c
  LEFT JOIN (SELECT *, dense_rank() OVER (PARTITION BY merged_subnetwork_id ORDER BY round(pagerank, 9) DESC) AS pr_rank FROM pagerank) p ON p.merged_subnetwork_id = c.merged_subnetwork_id AND p.node = c.node
  LEFT JOIN dg ON dg.merged_subnetwork_id = c.merged_subnetwork_id AND dg.node = c.node LEFT JOIN mh ON mh.merged_subnetwork_id = c.merged_subnetwork_id AND mh.node = c.node)"""
)
_NAMES = "(VALUES ('pr_rank'), ('rank_inDeg'), ('rank_outDeg'), ('composite_rank'))"
_PAIRS = (
    _RANKS
    + f""", lg AS (SELECT merged_subnetwork_id, node, metric, CAST(-v AS DOUBLE) AS v, n FROM (SELECT *, count(*) OVER (PARTITION BY merged_subnetwork_id) AS n FROM ranks) r, LATERAL (VALUES ('pr_rank', pr_rank), ('rank_inDeg', "rank_inDeg"), ('rank_outDeg', "rank_outDeg"), ('composite_rank', composite_rank)) t(metric, v)),
prs AS (SELECT a.merged_subnetwork_id, a.node, a.metric AS metric_a, b.metric AS metric_b, a.v AS x, b.v AS y FROM lg a JOIN lg b USING (merged_subnetwork_id, node) WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
grp AS (SELECT g.*, a.metric AS metric_a, b.metric AS metric_b FROM (SELECT merged_subnetwork_id, count(*) AS n FROM ranks GROUP BY 1) g, {_NAMES} a(metric), {_NAMES} b(metric))"""
)
_PEARSON = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"


def _corr(value: str, source: str = "prs", digits: str = "round(CASE WHEN n >= 5 THEN c END, 6) + 0.0::DOUBLE") -> str:
    return f"SELECT merged_subnetwork_id, metric_a, metric_b, {digits} AS corr FROM grp LEFT JOIN (SELECT merged_subnetwork_id, metric_a, metric_b, {value} AS c FROM {source} GROUP BY 1, 2, 3) USING (merged_subnetwork_id, metric_a, metric_b)"


_KENDALL_TWO = """(SELECT a.merged_subnetwork_id, a.metric_a, a.metric_b, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM prs a JOIN prs b ON a.merged_subnetwork_id = b.merged_subnetwork_id AND a.metric_a = b.metric_a AND a.metric_b = b.metric_b AND a.node < b.node)"""
_PLACE = "rank() OVER (PARTITION BY merged_subnetwork_id, metric_a, metric_b ORDER BY {v}) + (count(*) OVER (PARTITION BY merged_subnetwork_id, metric_a, metric_b, {v}) - 1) / 2.0::DOUBLE"
_SPEARMAN = f"(SELECT merged_subnetwork_id, metric_a, metric_b, {_PLACE.format(v='x')} AS x, {_PLACE.format(v='y')} AS y FROM prs)"
_MANUAL_EDGES = "([0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[])"
_BINS = _SCORE + f""", bin AS (SELECT i AS bin_no, {_MANUAL_EDGES}[i] AS lo, {_MANUAL_EDGES}[i + 1] AS hi, printf('%g-%g', {_MANUAL_EDGES}[i], {_MANUAL_EDGES}[i + 1]) AS lab FROM range(1, 12) r(i)), binned AS (SELECT score.*, lo, hi, lab FROM score LEFT JOIN bin ON pred_proba >= lo AND pred_proba < hi)"""
_FOLDS = (
    _SCORE
    + """, lab AS (SELECT *, row_number() OVER (ORDER BY time_step, "txId") - 1 AS place, count(*) OVER () AS total, count(*) OVER () // 2 AS w FROM score WHERE class IS NOT NULL),
fl AS (SELECT CAST(i + 1 AS INTEGER) AS fold, s.* FROM lab s, range(0, 4) o(i) WHERE place >= i * (total - w) // 3 AND place < i * (total - w) // 3 + w),
steps AS (SELECT fold, time_step, row_number() OVER (PARTITION BY fold ORDER BY time_step) <= floor(count(*) OVER (PARTITION BY fold) * 0.5) AS tr FROM (SELECT DISTINCT fold, time_step FROM fl)),
folds AS (SELECT fl.*, CASE WHEN tr THEN 'Train' ELSE 'Val' END AS training_label, CAST(pred_proba >= 0.5::DOUBLE AS INTEGER) AS p FROM fl JOIN steps USING (fold, time_step))"""
)


def _metrics(tp="tp", tn="tn", fp="fp", fn="fn") -> dict[str, str]:
    pr, rc = f"coalesce({tp} / nullif(CAST({tp} + {fp} AS DOUBLE), 0), 0)", f"coalesce({tp} / nullif(CAST({tp} + {fn} AS DOUBLE), 0), 0)"
    return {"accuracy": f"({tp} + {tn}) / nullif(CAST({tp} + {tn} + {fp} + {fn} AS DOUBLE), 0)", "precision": pr, "recall": rc, "f1": f"coalesce(2 * {pr} * {rc} / nullif({pr} + {rc}, 0), 0)"}


_METRICS6 = ", ".join(f"round({v}, 6) AS {k}" for k, v in _metrics().items())
_CONFUSION = "count(*) FILTER (class = 1 AND p = 1) AS tp, count(*) FILTER (class = 0 AND p = 0) AS tn, count(*) FILTER (class = 0 AND p = 1) AS fp, count(*) FILTER (class = 1 AND p = 0) AS fn"


def _fold_eval(where: str = "") -> str:
    return f"""ev AS (SELECT fold, count(*) AS total_size, count(*) FILTER (training_label = 'Train') AS train_size, count(*) FILTER (training_label = 'Val') AS val_size, count(*) FILTER (class = 0) AS class_0, count(*) FILTER (class = 1) AS class_1, min(time_step) AS min_step, max(time_step) AS max_step, {_CONFUSION} FROM folds {where} GROUP BY fold),
rk AS (SELECT fold, class, rank() OVER (PARTITION BY fold ORDER BY pred_proba) + (count(*) OVER (PARTITION BY fold, pred_proba) - 1) / 2.0::DOUBLE AS r FROM folds {where}),
au AS (SELECT fold, (sum(r) FILTER (class = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / nullif(n1 * n0, 0) AS auc FROM rk JOIN (SELECT fold, CAST(count(*) FILTER (class = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (class = 0) AS DOUBLE) AS n0 FROM rk GROUP BY 1) USING (fold) GROUP BY fold, n1, n0),
res AS (SELECT ev.*, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, {_METRICS6} FROM ev JOIN au USING (fold))"""


def _cross(select: str) -> str:
    return f"WITH {_PRED}, x AS (SELECT class_label, count(*) FILTER (pred_class_label = 'Illicit') AS a, count(*) FILTER (pred_class_label = 'Licit') AS b FROM pred GROUP BY 1) SELECT class_label, {select} FROM x"


def _dist(value: str, labels: list[str], name: str, of_rounded: bool) -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    cum = "round(sum(pct) OVER (ORDER BY bin_no), 2)" if of_rounded else "round_even(cum / CAST(tot AS DOUBLE) * 100, 2)"
    last = "max(cum_count), max(cum_pct_population)" if of_rounded else "NULL::BIGINT, NULL::DOUBLE"
    return f"""WITH RECURSIVE {_MERGED}, lb(bin_no, l) AS (VALUES {rows}),
b AS (SELECT bin_no, l, count(s.v) AS c FROM lb LEFT JOIN (SELECT CASE WHEN {value} <= 1 THEN 0 ELSE least({value} - 1, {len(labels) - 1}) END AS bn, 1 AS v FROM sm) s ON bn = bin_no GROUP BY 1, 2),
d AS (SELECT *, round_even(c / CAST(sum(c) OVER () AS DOUBLE) * 100, 2) AS pct, CAST(sum(c) OVER (ORDER BY bin_no) AS BIGINT) AS cum, sum(c) OVER () AS tot FROM b),
r AS (SELECT bin_no, l AS {name}, c AS network_count, pct AS pct_population, cum AS cum_count, {cum} AS cum_pct_population FROM d)
SELECT * FROM r UNION ALL SELECT {len(labels)}, 'Total', CAST(sum(network_count) AS BIGINT), round(sum(pct_population), 2), {last} FROM r"""


def _bins(width: str, ok: str) -> str:
    return f"""WITH {_SCORE}, s AS (SELECT stddev_pop(pred_proba) AS sd, count(pred_proba) AS n, max(pred_proba) - min(pred_proba) AS span, quantile_cont(pred_proba, 0.75) - quantile_cont(pred_proba, 0.25) AS iqr FROM score), w AS (SELECT *, CASE WHEN {ok} THEN round_even({width}, 3) END AS bin_width FROM s)
SELECT CASE WHEN {ok} AND bin_width > 0 THEN greatest(1, CAST(floor(span / bin_width) AS BIGINT)) ELSE 10 END AS num_bins, bin_width FROM w"""


_SETS = "(VALUES (0, 'equal', 0.25, 0.25, 0.25, 0.25), (1, 'balanced', 0.5, 0.4, 0.07, 0.03), (2, 'current', 0.6, 0.3, 0.07, 0.03), (3, 'pr_heavy', 0.7, 0.2, 0.07, 0.03), (4, 'pr_extreme', 0.8, 0.15, 0.03, 0.02), (5, 'pr_mid', 0.55, 0.35, 0.07, 0.03), (6, 'val_heavy', 0.2, 0.7, 0.06, 0.04), (7, 'val_mid', 0.4, 0.5, 0.06, 0.04), (8, 'val_extreme', 0.1, 0.8, 0.05, 0.05), (9, 'deg_heavy', 0.4, 0.3, 0.2, 0.1), (10, 'deg_equal', 0.33, 0.33, 0.17, 0.17)) ws(set_no, name, w1, w2, w3, w4)"


def _weights(frac: str) -> str:
    return f"""WITH RECURSIVE {_COMP}, wr AS (SELECT *, count(*) OVER (PARTITION BY merged_subnetwork_id) AS n FROM comps),
wx AS (SELECT CAST(set_no AS INTEGER) AS set_no, name, merged_subnetwork_id, node, n, pagerank_pct, CAST(round("in_BTC_total" * 100) AS BIGINT) AS v, round(w1::DOUBLE * coalesce(pagerank_pct, 0) + w2::DOUBLE * in_btc_pct + w3::DOUBLE * in_deg_pct + w4::DOUBLE * out_deg_pct_inv, 9) AS raw FROM wr, {_SETS} WHERE n >= 5),
wt AS (SELECT *, row_number() OVER (PARTITION BY set_no, merged_subnetwork_id ORDER BY raw DESC, node) <= greatest(1, ceil({frac}::DOUBLE * n)) AS top FROM wx),
wd AS (SELECT set_no, name, merged_subnetwork_id, CASE WHEN sum(v) > 0 THEN coalesce(CAST(sum(v) FILTER (top) AS DOUBLE), 0) / CAST(sum(v) AS DOUBLE) ELSE 0 END AS btc_share, median(coalesce(pagerank_pct, 0)) FILTER (top) * 100 AS pr_percentile_med FROM wt GROUP BY 1, 2, 3)"""


_FORMULAS = {"accuracy": "((TP + TN) / (TP + TN + FP + FN))", "precision": "(TP / (TP + FP))", "recall": "(TP / (TP + FN))", "f1": "2 * (Precision * Recall) / (Precision + Recall)"}
_PARSED = """CASE c_custkey % 4 WHEN 0 THEN [c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name] WHEN 1 THEN [c_name, c_mktsegment] ELSE [] END"""

SQL: dict[str, str] = {
    "txn_features_clean": f"""WITH {_CLS}, {_FEAT}, lim AS (SELECT quantile_cont(fees, 0.95) AS q FROM feat),
pin AS (SELECT "txId", (rank() OVER (ORDER BY num_input_addresses) + (count(*) OVER (PARTITION BY num_input_addresses) - 1) / 2.0::DOUBLE) / count(*) OVER () AS p FROM feat WHERE num_input_addresses IS NOT NULL),
pout AS (SELECT "txId", (rank() OVER (ORDER BY num_output_addresses) + (count(*) OVER (PARTITION BY num_output_addresses) - 1) / 2.0::DOUBLE) / count(*) OVER () AS p FROM feat WHERE num_output_addresses IS NOT NULL)
SELECT feat."txId", feat.time_step, CAST(CASE class_label WHEN 'Illicit' THEN 1 WHEN 'Licit' THEN 2 ELSE 3 END AS INTEGER) AS class, class_label, "total_BTC",
  {", ".join(f'"{s}_BTC_{k}"' for s in ("in", "out") for k in ("min", "max", "mean", "median", "total"))}, fees, size, num_input_addresses, num_output_addresses, in_txs_degree, out_txs_degree,
  "in_BTC_total" / nullif("out_BTC_total", 0) AS in_out_ratio, num_input_addresses / nullif(CAST(num_output_addresses AS DOUBLE), 0) AS input_output_ratio, "out_BTC_max" - "out_BTC_min" AS "BTC_dispersion",
  CAST("total_BTC" < 0.001 AS DOUBLE) AS micro_txn_flag, size / nullif(CAST(num_input_addresses + num_output_addresses AS DOUBLE), 0) AS txn_density, fees / nullif(size, 0) AS fees_per_byte, fees / nullif("total_BTC", 0) AS fees_ratio,
  fees / nullif(CAST(num_input_addresses AS DOUBLE), 0) AS fees_per_input, CASE WHEN "in_BTC_total" IS NOT NULL AND "out_BTC_total" IS NOT NULL THEN CAST("in_BTC_total" % 1 = 0 OR "out_BTC_total" % 1 = 0 AS DOUBLE) END AS rounded_amount_flag,
  CASE WHEN fees IS NOT NULL THEN CAST(fees > q AS DOUBLE) END AS high_fees_flag, pin.p AS input_address_percentile, pout.p AS output_address_percentile
FROM feat JOIN cls USING ("txId") CROSS JOIN lim LEFT JOIN pin ON pin."txId" = feat."txId" LEFT JOIN pout ON pout."txId" = feat."txId\"""",
    "class_counts": f"WITH {_CLS} SELECT CAST(CASE class_label WHEN 'Illicit' THEN 1 WHEN 'Licit' THEN 2 ELSE 3 END AS INTEGER) AS class, class_label, count(*) AS n FROM cls GROUP BY 1, 2",
    "wallet_dedup": "SELECT user_id AS address, count(*) AS num_events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents, count(DISTINCT event_type) AS num_types FROM events GROUP BY 1",
    "high_fee_flags": f'WITH {_FEAT} SELECT "txId", fees, CASE WHEN fees IS NOT NULL THEN CAST(fees > (SELECT quantile_cont(fees, 0.95) FROM feat) AS DOUBLE) END AS high_fees_flag FROM feat',
    "pct_rank_global": f"""WITH {_FEAT} SELECT "txId", num_input_addresses, round(CASE WHEN num_input_addresses IS NOT NULL THEN (rank() OVER (ORDER BY num_input_addresses NULLS LAST) + (count(*) OVER (PARTITION BY num_input_addresses) - 1) / 2.0::DOUBLE) / count(num_input_addresses) OVER () END, 6) AS pct FROM feat""",
    "impute_median": f"""WITH {_FEAT}, m AS (SELECT median(fees) AS a, median(size) AS b, median("in_BTC_total") AS c, median(in_txs_degree) AS d FROM feat) SELECT "txId", round(coalesce(fees, a), 6) AS fees, coalesce(size, b) AS size, round(coalesce("in_BTC_total", c), 6) AS "in_BTC_total", CAST(coalesce(in_txs_degree, d) AS DOUBLE) AS in_txs_degree FROM feat, m""",
    "feature_shape": f"""WITH {_FEAT}, {_SCORE}, fs AS (SELECT feature, CAST(v AS DOUBLE) AS x, CAST(class AS DOUBLE) AS y FROM feat JOIN score USING ("txId"), LATERAL (VALUES ('fees', fees), ('size', size), ('in_BTC_total', "in_BTC_total"), ('num_input_addresses', num_input_addresses), ('out_txs_degree', out_txs_degree)) t(feature, v) WHERE class IS NOT NULL AND v IS NOT NULL),
fr AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM fs),
fq AS (SELECT feature, count(*) AS n, {_PEARSON} AS p, {_PEARSON.replace("x", "rx").replace("y)", "ry)").replace("marx", "max")} AS s, min(x) AS lo, max(x) AS hi FROM fr GROUP BY 1 HAVING count(*) >= 5),
fc AS (SELECT feature, coalesce(least(floor((x - lo) / nullif(hi - lo, 0) * 16), 15), 0) AS b, y, count(*) AS c FROM fs JOIN fq USING (feature) GROUP BY 1, 2, 3),
fi AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS t, sum(c) OVER (PARTITION BY feature, b) AS tb, sum(c) OVER (PARTITION BY feature, y) AS ty FROM fc),
fm AS (SELECT feature, sum(c / CAST(t AS DOUBLE) * ln(CAST(c AS DOUBLE) * t / (CAST(tb AS DOUBLE) * ty))) AS mi FROM fi GROUP BY 1)
SELECT feature, n, round(p, 6) AS pearson, round(s, 6) AS spearman, round(p ** 2, 6) AS r2, round(mi, 6) + 0.0::DOUBLE AS mutual_info,
  CASE WHEN abs(p) > 0.5 AND p ** 2 > 0.3 THEN 'linear' WHEN abs(p) < 0.3 AND (abs(s) > 0.5 OR mi > 0.1) THEN 'nonlinear' ELSE 'weak' END AS relation FROM fq JOIN fm USING (feature)""",
    "projected_cast_scan": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, o_totalprice FROM orders",
    "null_row_drop": f'WITH {_FEAT} SELECT "txId", fees, in_txs_degree, out_txs_degree FROM feat WHERE fees IS NOT NULL AND in_txs_degree IS NOT NULL AND out_txs_degree IS NOT NULL',
    "data_split_counts": f"WITH {_CLS} SELECT CASE WHEN class_label IN ('Illicit', 'Licit') THEN 'Train/Val' ELSE 'Test' END AS data_split, class_label, count(*) AS n FROM cls GROUP BY 1, 2",
    "temporal_split": f"""WITH {_SCORE}, st AS (SELECT time_step, row_number() OVER (ORDER BY time_step) <= floor(count(*) OVER () * 0.7::DOUBLE) AS tr FROM (SELECT DISTINCT time_step FROM score)), c AS (SELECT count(*) AS n, count(*) FILTER (tr) AS t FROM score JOIN st USING (time_step))
SELECT n AS total_size, t AS training_size, n - t AS val_size, round_even(t / CAST(n AS DOUBLE) * 100, 0) AS training_pct, round_even((n - t) / CAST(n AS DOUBLE) * 100, 0) AS val_pct FROM c""",
    "fold_windows": f'WITH {_FOLDS} SELECT fold, training_label, count(*) AS n, min(time_step) AS min_step, max(time_step) AS max_step, CAST(sum("txId") AS BIGINT) AS id_sum FROM folds GROUP BY 1, 2',
    "standardize_after_split": f"""WITH {_FEAT}, f AS (SELECT * FROM feat WHERE fees IS NOT NULL AND size IS NOT NULL), st AS (SELECT time_step, row_number() OVER (ORDER BY time_step) <= floor(count(*) OVER () * 0.7::DOUBLE) AS tr FROM (SELECT DISTINCT time_step FROM f)),
m AS (SELECT avg(fees) AS a, stddev_pop(fees) AS s, avg(size) AS b, stddev_pop(size) AS t FROM f JOIN st USING (time_step) WHERE tr) SELECT "txId", CASE WHEN tr THEN 'Train' ELSE 'Val' END AS training_label, round((fees - a) / coalesce(nullif(s, 0), 1), 6) AS fees, round((size - b) / coalesce(nullif(t, 0), 1), 6) AS size FROM f JOIN st USING (time_step), m""",
    "threshold_predictions": f"""WITH {_PRED} SELECT "txId", time_step, 'model' AS pred_model, 0.4::DOUBLE AS pred_model_threshold, pred_proba, pred_class, pred_class_label FROM pred""",
    "final_labels": f"""WITH {_PRED}, l AS (SELECT *, CASE WHEN class_label IN ('Illicit', 'Licit') THEN class_label ELSE pred_class_label END AS fl FROM pred) SELECT "txId", class_label, pred_class_label, CAST(fl = 'Illicit' AS INTEGER) AS final_class, fl AS final_class_label FROM l""",
    "pred_vs_actual": _cross('a AS "Illicit", b AS "Licit"'),
    "pred_vs_actual_rowpct": _cross('round(a * 100 / CAST(a + b AS DOUBLE), 2) AS "Illicit", round(b * 100 / CAST(a + b AS DOUBLE), 2) AS "Licit"'),
    "pred_vs_actual_colpct": _cross('round(a * 100 / CAST(sum(a) OVER () AS DOUBLE), 2) AS "Illicit", round(b * 100 / CAST(sum(b) OVER () AS DOUBLE), 2) AS "Licit"'),
    "bins_manual": f'WITH {_BINS} SELECT lab AS pred_bin, lo AS "pred_bin_LOWERB", hi AS "pred_bin_UPPERB", count(*) AS n FROM binned GROUP BY 1, 2, 3',
    "bins_by_width": f"""WITH {_SCORE}, r AS (SELECT min(pred_proba) AS a, max(pred_proba) AS z FROM score), n AS (SELECT CAST(ceil((z + 0.125::DOUBLE - a) / 0.125::DOUBLE) AS BIGINT) AS n FROM r),
e AS (SELECT i, CASE WHEN i = n - 1 AND a + i * 0.125::DOUBLE < z THEN z ELSE a + i * 0.125::DOUBLE END AS v FROM r, n, range(0, 100) t(i) WHERE i < n), b AS (SELECT v AS lo, lead(v) OVER (ORDER BY i) AS hi FROM e)
SELECT round(lo, 6) AS "pred_bin_LOWERB", round(hi, 6) AS "pred_bin_UPPERB", count(*) AS n FROM score LEFT JOIN (SELECT * FROM b WHERE hi IS NOT NULL) ON pred_proba >= lo AND pred_proba < hi GROUP BY 1, 2""",
    "bins_scott": _bins("3.49::DOUBLE * sd / pow(n, 1 / 3.0::DOUBLE)", "n >= 2 AND sd > 0"),
    "bins_freedman": _bins("2 * iqr * pow(n, -1 / 3.0::DOUBLE)", "iqr > 0"),
    "binned_pred_report": f"""WITH {_BINS}, c AS (SELECT lab, lo, count(*) FILTER (class = 1) AS i, count(*) FILTER (class = 0) AS l, count(*) AS t FROM binned WHERE lab IS NOT NULL AND class IS NOT NULL GROUP BY 1, 2), p AS (SELECT lab AS pred_bin, lo AS "pred_bin_LOWERB", i AS "Illicit", l AS "Licit", t AS "TOTAL",
  {", ".join(f'round_even({c} / CAST(sum({c}) OVER () AS DOUBLE), 3) AS "{n}_PCT", round_even(CAST(sum({c}) OVER (ORDER BY lo) AS DOUBLE) / CAST(sum({c}) OVER () AS DOUBLE), 3) AS "{n}_CUMPCT"' for c, n in (("i", "Illicit"), ("l", "Licit"), ("t", "TOTAL")))},
  round_even(CASE WHEN l = 0 THEN i ELSE i / CAST(l AS DOUBLE) END, 2) AS "Illicit_Licit_ODDS", round_even(i / CAST(t AS DOUBLE), 2) AS "Illicit_CONVERSION" FROM c)
SELECT * FROM p UNION ALL BY NAME SELECT 'Total' AS pred_bin, NULL::DOUBLE AS "pred_bin_LOWERB", CAST(sum("Illicit") AS BIGINT) AS "Illicit", CAST(sum("Licit") AS BIGINT) AS "Licit", CAST(sum("TOTAL") AS BIGINT) AS "TOTAL", {", ".join(f'round(sum("{n}_PCT"), 3) AS "{n}_PCT", 1.0::DOUBLE AS "{n}_CUMPCT"' for n in ("Illicit", "Licit", "TOTAL"))},
  round(CAST(sum("Illicit") AS DOUBLE) / CAST(sum("Licit") AS DOUBLE), 3) AS "Illicit_Licit_ODDS", round(CAST(sum("Illicit") AS DOUBLE) / CAST(sum("TOTAL") AS DOUBLE), 3) AS "Illicit_CONVERSION" FROM p""",
    "cm_threshold_report": f"""WITH {_SCORE}, c AS (SELECT t AS threshold, count(*) FILTER (class = 1 AND pred_proba >= t) AS tp, count(*) FILTER (class = 0 AND pred_proba < t) AS tn, count(*) FILTER (class = 0 AND pred_proba >= t) AS fp, count(*) FILTER (class = 1 AND pred_proba < t) AS fn FROM score, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS t) WHERE class IS NOT NULL GROUP BY t)
SELECT threshold, {", ".join(f"round_even({v}, 2) AS {k}" for k, v in _metrics().items())}, {", ".join(f"printf('%.4f', {_metrics()[k]}) || ' = {t}' AS {k}_formula" for k, t in _FORMULAS.items())}, tp, tn, fp, fn, tp + tn + fp + fn AS total FROM c""",
    "final_model_eval": f"""WITH {_PRED}, c AS (SELECT count(*) AS total_size, {_CONFUSION} FROM (SELECT class, pred_class AS p FROM pred) WHERE class IS NOT NULL), a AS (SELECT *, (tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2 AS auc FROM c)
SELECT 'final' AS label, total_size, {_METRICS6}, round(auc, 6) AS auc_hard, round(2 * auc - 1, 6) AS gini_hard, tp, tn, fp, fn FROM a""",
    "auc_gini": f"""WITH {_SCORE}, r AS (SELECT class, rank() OVER (ORDER BY pred_proba) + (count(*) OVER (PARTITION BY pred_proba) - 1) / 2.0::DOUBLE AS r FROM score WHERE class IS NOT NULL), a AS (SELECT CAST(sum(class) AS DOUBLE) AS n1, CAST(count(*) - sum(class) AS DOUBLE) AS n0, sum(r) FILTER (class = 1) AS s FROM r)
SELECT round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, round(2 * (s - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) AS gini FROM a""",
    "fold_eval": f"WITH {_FOLDS}, {_fold_eval()} SELECT * FROM res",
    "fold_eval_val_only": f"WITH {_FOLDS}, {_fold_eval("WHERE training_label = 'Val'")} SELECT * FROM res",
    "best_fold": f"WITH {_FOLDS}, {_fold_eval()} SELECT fold, gini, recall, accuracy FROM res ORDER BY gini DESC NULLS LAST, recall DESC, accuracy DESC, fold LIMIT 2",
    "fold_class_counts": f"WITH {_FOLDS} SELECT fold, " + ", ".join(f"count(*) FILTER (training_label = '{s.title()}' AND class = {k}) AS {s}_{k}" for s in ("train", "val") for k in (0, 1)) + " FROM folds GROUP BY fold",
    "illicit_edges": f"WITH {_ALLOWED} SELECT src, dst FROM ie",
    "seed_edge_peek": f"""WITH {_ALLOWED} SELECT "txId1", "txId2", a.class_label AS src_label, b.class_label AS dst_label, a.class_label = 'Illicit' AND b.class_label = 'Illicit' AS both_illicit FROM edge JOIN cls a ON a."txId" = "txId1" JOIN cls b ON b."txId" = "txId2" WHERE "txId1" IN (SELECT seed_txn FROM seeds)""",
    "subnet_nodes": f"WITH RECURSIVE {_FULL} SELECT * FROM nd",
    "subnet_edges": f"WITH RECURSIVE {_FULL} SELECT * FROM ed",
    "subnet_nodes_maxhop2": f"WITH RECURSIVE {_HOP2} SELECT * FROM nd",
    "subnet_edges_maxhop2": f"WITH RECURSIVE {_HOP2} SELECT * FROM ed",
    "seed_summary": f"WITH RECURSIVE {_FULL} SELECT subnetwork_id, seed_txn, nodes, coalesce(e, 0) AS edges, max_hop, CASE WHEN nodes <= 1 THEN 'single node network' ELSE 'multi-node network' END AS bucket FROM (SELECT subnetwork_id, seed_txn, count(*) AS nodes, max(hop) AS max_hop FROM nd GROUP BY 1, 2) LEFT JOIN (SELECT subnetwork_id, count(*) AS e FROM ed GROUP BY 1) USING (subnetwork_id)",
    "dedup_report": f"WITH RECURSIVE {_FULL}{_DEDUP} SELECT * FROM rep",
    "dedup_report_maxhop2": f"WITH RECURSIVE {_HOP2}{_DEDUP} SELECT * FROM rep",
    "dedup_relabel": f"WITH RECURSIVE {_FULL}{_DEDUP} SELECT id AS old_id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS new_id FROM rep WHERE status = 'kept'",
    "merged_nodes": f"WITH RECURSIVE {_MERGED} SELECT merged_subnetwork_id, txn_id, min_hop, array_to_string(seeds_in_group, ';') AS seeds_in_group FROM fn",
    "merged_edges": f"WITH RECURSIVE {_MERGED} SELECT * FROM fe",
    "merged_nodes_retagged": f"WITH RECURSIVE {_MERGED} SELECT * FROM rn",
    "merged_edges_retagged": f"WITH RECURSIVE {_MERGED} SELECT * EXCLUDE (seed_txn) FROM re",
    "merge_min_shared_2": f"WITH RECURSIVE {_KEPT}" + """, sl AS (SELECT a.subnetwork_id AS a, b.subnetwork_id AS b FROM kn a JOIN kn b USING (txn_id) GROUP BY 1, 2 HAVING count(*) >= 2),
comp(node, lab) USING KEY (node) AS (SELECT DISTINCT subnetwork_id, subnetwork_id FROM kn UNION SELECT sl.b, min(f.lab) FROM comp f JOIN sl ON sl.a = f.node JOIN recurring.comp r ON r.node = sl.b WHERE f.lab < r.lab GROUP BY sl.b) SELECT node AS subnetwork_id, lab AS merged_subnetwork_id FROM comp""",
    "min_size_filter": f"WITH RECURSIVE {_MERGED} SELECT merged_subnetwork_id, node_count, coalesce(ec, 0) AS edge_count, CASE WHEN node_count >= 2 AND ec >= 1 THEN 'kept' ELSE 'dropped_small' END AS status, CASE WHEN node_count >= 2 AND ec >= 1 THEN merged_subnetwork_id END AS kept_as FROM (SELECT merged_subnetwork_id, count(*) AS node_count FROM fn GROUP BY 1) LEFT JOIN (SELECT merged_subnetwork_id, count(*) AS ec FROM fe GROUP BY 1) USING (merged_subnetwork_id)",
    "min_size_nodes": f"WITH RECURSIVE {_MERGED} SELECT merged_subnetwork_id, txn_id, min_hop, array_to_string(seeds_in_group, ';') AS seeds_in_group FROM fn WHERE merged_subnetwork_id IN (SELECT merged_subnetwork_id FROM fn GROUP BY 1 HAVING count(*) >= 3)",
    "subnet_summary": f"WITH RECURSIVE {_MERGED} SELECT merged_subnetwork_id, array_to_string(txns, ';') AS txn_ids, node_count, edge_count, depth, array_to_string(seeds, ';') AS seeds, seed_count, node_count - seed_count AS linked_txn_count FROM sm",
    "subnet_summary_collapsed": f"WITH RECURSIVE {_MERGED} SELECT merged_subnetwork_id, array_to_string(txns, ';') AS txn_ids, node_count, coalesce(ec, 0) AS edge_count, d AS depth, array_to_string(seeds, ';') AS seeds, seed_count, node_count - seed_count AS linked_txn_count FROM sm JOIN (SELECT merged_subnetwork_id, max(min_hop) AS d FROM fn GROUP BY 1) USING (merged_subnetwork_id) LEFT JOIN (SELECT merged_subnetwork_id, count(*) AS ec FROM fe GROUP BY 1) USING (merged_subnetwork_id)",
    "degrees": f"WITH RECURSIVE {_PR}{_DEG} SELECT * FROM dg",
    "min_hops": f"WITH RECURSIVE {_MERGED}{_HOPS} SELECT * FROM mh",
    "pagerank": f"WITH RECURSIVE {_PR} SELECT merged_subnetwork_id, node, round(pagerank, 6) AS pagerank, dense_rank() OVER (PARTITION BY merged_subnetwork_id ORDER BY round(pagerank, 9) DESC) AS pr_rank FROM pagerank",
    "pagerank_weighted": "WITH RECURSIVE "
    + _PR.replace("gn AS (", "ww AS (SELECT merged_subnetwork_id, src_txn_id, dst_txn_id, CAST(sum(1 + src_txn_hop) AS DOUBLE) AS w FROM re GROUP BY 1, 2, 3), gn AS (").replace("count(*) AS o FROM fe GROUP BY 1, 2", "sum(w) AS o FROM ww GROUP BY 1, 2").replace("sum(s.p / s.o) AS f FROM pr s JOIN fe e", "sum(s.p * e.w / s.o) AS f FROM pr s JOIN ww e")
    + " SELECT merged_subnetwork_id, node, round(pagerank, 6) AS pagerank FROM pagerank",
    "pagerank_completed": f"WITH RECURSIVE {_PRC} SELECT merged_subnetwork_id, node, round(pagerank, 6) AS pagerank FROM prc",
    "composite_rank": f"WITH RECURSIVE {_COMP} SELECT {_COMP_COLUMNS} FROM comps",
    "weight_sensitivity": f"{_weights('0.2')} SELECT set_no, name, round(median(btc_share), 6) AS median_btc_share, round(median(pr_percentile_med), 6) AS median_pr_percentile, count(*) AS groups FROM wd GROUP BY 1, 2",
    "weight_sensitivity_details": f"{_weights('0.1')} SELECT set_no, name, merged_subnetwork_id, round(btc_share, 6) AS btc_share, round(pr_percentile_med, 6) AS pr_percentile_med FROM wd",
    "rank_join_all": f"WITH RECURSIVE {_RANKS} SELECT * REPLACE (round(composite_raw, 6) AS composite_raw) FROM ranks",
    "rank_scores": f'WITH RECURSIVE {_RANKS} SELECT merged_subnetwork_id, node, pr_rank, "rank_inDeg", "rank_outDeg", composite_rank, -pr_rank AS pr_rank_score, -"rank_inDeg" AS "rank_inDeg_score", -"rank_outDeg" AS "rank_outDeg_score", -composite_rank AS composite_rank_score FROM ranks',
    "rank_corr_pearson": f"WITH RECURSIVE {_PAIRS} {_corr(_PEARSON)}",
    "rank_corr_spearman": f"WITH RECURSIVE {_PAIRS} {_corr(_PEARSON, _SPEARMAN)}",
    "rank_corr_kendall": f"WITH RECURSIVE {_PAIRS} {_corr('sum(dx * dy) / nullif(sqrt(CAST(sum(abs(dx)) AS DOUBLE) * CAST(sum(abs(dy)) AS DOUBLE)), 0)', _KENDALL_TWO)}",
    "rank_corr_average": f"WITH RECURSIVE {_PAIRS}, cc AS ({_corr(_PEARSON, digits='CASE WHEN n >= 5 THEN c END')}) SELECT metric_a, metric_b, round(avg(corr), 6) AS corr, count(DISTINCT merged_subnetwork_id) AS groups FROM cc WHERE merged_subnetwork_id IN (SELECT merged_subnetwork_id FROM sm WHERE node_count >= 5) GROUP BY 1, 2",
    "node_count_dist": f"WITH RECURSIVE {_MERGED}, d AS (SELECT node_count, count(*) AS network_count FROM sm GROUP BY 1), p AS (SELECT *, round_even(network_count / CAST(sum(network_count) OVER () AS DOUBLE) * 100, 2) AS pct FROM d) SELECT *, round(sum(pct) OVER (ORDER BY node_count), 2) AS cum_pct FROM p",
    "node_count_bins": _dist("node_count", ["1", "2", "3", "4", "5", "5+"], "node_group", False),
    "depth_bins": _dist("depth", ["1", "2", "3", "4", "5+"], "depth_group", True),
    "seed_bins": _dist("seed_count", ["1", "2", "3", "4", "5+"], "seed_group", True),
    "size_depth_matrix": f"""WITH RECURSIVE {_MERGED}, r(k, txn_count_bin) AS (VALUES (1, '1–5'), (2, '6–10'), (3, '11–15'), (4, '16–20'), (5, '21+')), x AS (SELECT least(5, (node_count + 4) // 5) AS k, greatest(1, depth) AS d FROM sm WHERE node_count >= 2)
SELECT txn_count_bin, {", ".join(f"count(d) FILTER (d = {i}) AS depth_{i}" for i in range(1, 6))}, count(d) FILTER (d > 5) AS depth_5_plus FROM r LEFT JOIN x USING (k) GROUP BY 1""",
    "txn_conflicts": f"WITH RECURSIVE {_KEPT} SELECT txn_id, count(DISTINCT subnetwork_id) AS num_subnets, array_to_string(list_sort(list(DISTINCT subnetwork_id)), ';') AS subnets FROM kn GROUP BY 1 HAVING count(DISTINCT subnetwork_id) > 1",
    "addr_projection": f'WITH RECURSIVE {_MERGED}{_ADDR} SELECT merged_subnetwork_id, input_address, output_address, count(*) AS weight FROM fn JOIN ain ON ain."txId" = txn_id JOIN aout ON aout."txId" = txn_id GROUP BY 1, 2, 3',
    "addr_metrics": f"""WITH RECURSIVE {_COMP}{_ADDR}, tx AS (SELECT input_address AS address, "txId" FROM ain UNION SELECT output_address, "txId" FROM aout), sd AS (SELECT merged_subnetwork_id, src_txn_id AS node FROM fe WHERE min_src_hop = 0 UNION SELECT merged_subnetwork_id, dst_txn_id FROM fe WHERE min_dst_hop = 0),
pj AS (SELECT c.merged_subnetwork_id, input_address, output_address, count(*) AS w FROM comps c JOIN ain ON ain."txId" = node JOIN aout ON aout."txId" = node GROUP BY 1, 2, 3),
st AS (SELECT merged_subnetwork_id, address, CAST(sum(w) AS BIGINT) AS strength FROM (SELECT merged_subnetwork_id, input_address AS address, w FROM pj UNION ALL SELECT merged_subnetwork_id, output_address, w FROM pj) GROUP BY 1, 2),
ow AS (SELECT c.merged_subnetwork_id, address, min(composite_rank) AS final_rank, bool_or(sd.node IS NOT NULL) AS is_seed, round(sum(round(pagerank, 9)), 9) AS pagerank FROM comps c JOIN tx ON tx."txId" = c.node LEFT JOIN sd ON sd.merged_subnetwork_id = c.merged_subnetwork_id AND sd.node = c.node GROUP BY 1, 2),
sc AS (SELECT *, coalesce(100 + (pagerank - min(pagerank) OVER g) * 800 / nullif(max(pagerank) OVER g - min(pagerank) OVER g, 0), 500) AS s, row_number() OVER (PARTITION BY merged_subnetwork_id ORDER BY pagerank DESC, address) AS k FROM st JOIN ow USING (merged_subnetwork_id, address) WINDOW g AS (PARTITION BY merged_subnetwork_id))
SELECT merged_subnetwork_id, address, strength, final_rank, is_seed, round(pagerank, 6) AS pagerank, round(CASE WHEN k <= 10 THEN s ELSE 60 END, 6) AS size FROM sc""",
    "txn_addr_summary": f'WITH RECURSIVE {_SUMMARY} SELECT * REPLACE (round("in_BTC_total", 6) AS "in_BTC_total", round(composite_raw, 6) AS composite_raw) FROM txs',
    "viz_nodes": f"""WITH RECURSIVE {_COMP}, sd AS (SELECT merged_subnetwork_id AS g, src_txn_id AS node FROM fe WHERE min_src_hop = 0 UNION SELECT merged_subnetwork_id, dst_txn_id FROM fe WHERE min_dst_hop = 0), v AS (SELECT gn.g, gn.node, sd.node IS NOT NULL AS is_seed, coalesce(round(composite_raw, 9), 0) AS r FROM gn LEFT JOIN comps c ON c.merged_subnetwork_id = gn.g AND c.node = gn.node LEFT JOIN sd ON sd.g = gn.g AND sd.node = gn.node)
SELECT g AS merged_subnetwork_id, node, is_seed, round(coalesce(100 + (r - min(r) OVER w) * 800 / nullif(max(r) OVER w - min(r) OVER w, 0), 500), 6) AS size FROM v WINDOW w AS (PARTITION BY g)""",
    "top_label_nodes": f"WITH RECURSIVE {_COMP}, t AS (SELECT merged_subnetwork_id, node, row_number() OVER (PARTITION BY merged_subnetwork_id ORDER BY composite_rank, node) AS label_place FROM comps) SELECT * FROM t WHERE label_place <= 3",
    "edge_class_labels": f"""WITH {_EDGE}, {_PRED} SELECT "txId1", "txId2", a.class_label AS src_class_label, b.class_label AS dst_class_label, a.pred_class_label AS src_pred_class_label, b.pred_class_label AS dst_pred_class_label FROM edge JOIN pred a ON a."txId" = "txId1" JOIN pred b ON b."txId" = "txId2\"""",
    "global_stats": f'WITH RECURSIVE {_COMP}{_ADDR} SELECT count(DISTINCT merged_subnetwork_id) AS networks, count(DISTINCT node) AS transactions, count(DISTINCT input_address) AS senders, count(DISTINCT output_address) AS receivers FROM comps LEFT JOIN ain ON ain."txId" = node LEFT JOIN aout ON aout."txId" = node',
    "subnetwork_stats": f'WITH RECURSIVE {_COMP}{_ADDR} SELECT merged_subnetwork_id AS subnetwork_id, count(DISTINCT merged_subnetwork_id) AS networks, count(DISTINCT node) AS transactions, count(DISTINCT input_address) AS senders, count(DISTINCT output_address) AS receivers FROM comps LEFT JOIN ain ON ain."txId" = node LEFT JOIN aout ON aout."txId" = node GROUP BY 1',
    "subnetwork_lookup": f"""WITH RECURSIVE {_SUMMARY} SELECT subnetwork_id, txn_id, investigation_order, format('{{:,.2f}}', "in_BTC_total") AS "in_BTC_text", n_inputs, n_outputs FROM txs WHERE subnetwork_id = 0""",
    "parse_address_lists": f"SELECT c_custkey, array_to_string({_PARSED}, '~') AS parsed, CAST(len({_PARSED}) AS BIGINT) AS n FROM customer",
    "katz": f"""WITH RECURSIVE {_PR}, kz(k, g, node, x) AS (SELECT 0, g, node, 1.0::DOUBLE FROM gs UNION ALL SELECT kz.k + 1, kz.g, kz.node, 1 + 0.1::DOUBLE * coalesce(f.s, 0) FROM kz LEFT JOIN (SELECT s.g, e.dst_txn_id AS node, sum(s.x) AS s FROM kz s JOIN fe e ON e.merged_subnetwork_id = s.g AND e.src_txn_id = s.node GROUP BY 1, 2) f ON f.g = kz.g AND f.node = kz.node WHERE kz.k < 40)
SELECT g AS merged_subnetwork_id, node, round(x / sqrt(sum(x * x) OVER (PARTITION BY g)), 6) AS katz FROM kz WHERE k = 40""",
}
_DIST = """, ds(g, s, t, hop, paths) AS (SELECT g, node, node, 0, 1::BIGINT FROM gn UNION ALL SELECT d.g, d.s, e.dst_txn_id, d.hop + 1, CAST(sum(d.paths) AS BIGINT) FROM ds d JOIN fe e ON e.merged_subnetwork_id = d.g AND e.src_txn_id = d.t WHERE d.hop < 60 GROUP BY 1, 2, 3, 4),
dist AS (SELECT g, s, t, min(hop) AS hop, arg_min(paths, hop) AS paths FROM ds GROUP BY 1, 2, 3)"""
SQL |= {
    "harmonic": f"WITH RECURSIVE {_PR}{_DIST}, h AS (SELECT gn.g AS merged_subnetwork_id, gn.node, coalesce(sum(1.0::DOUBLE / hop), 0) AS v FROM gn LEFT JOIN dist ON dist.g = gn.g AND dist.t = gn.node AND hop > 0 GROUP BY 1, 2) SELECT merged_subnetwork_id, node, round(v, 6) AS harmonic, dense_rank() OVER (PARTITION BY merged_subnetwork_id ORDER BY round(v, 9) DESC) AS rank_harmonic FROM h",
    "betweenness": f"""WITH RECURSIVE {_PR}{_DIST}, b AS (SELECT a.g, a.t AS node, sum(a.paths * b.paths / CAST(d.paths AS DOUBLE)) AS v FROM dist a JOIN dist b ON b.g = a.g AND b.s = a.t JOIN dist d ON d.g = a.g AND d.s = a.s AND d.t = b.t WHERE a.hop > 0 AND b.hop > 0 AND a.s <> b.t AND a.hop + b.hop = d.hop GROUP BY 1, 2),
r AS (SELECT gs.g AS merged_subnetwork_id, gs.node, coalesce(v / nullif(CAST((n - 1) * (n - 2) AS DOUBLE), 0), 0) AS v FROM gs LEFT JOIN b ON b.g = gs.g AND b.node = gs.node) SELECT merged_subnetwork_id, node, round(v, 6) AS betweenness, dense_rank() OVER (PARTITION BY merged_subnetwork_id ORDER BY round(v, 9) DESC) AS rank_betweenness FROM r""",
}

_ROUND = lambda c: f"round({c}, 6) + 0.0::DOUBLE AS {c}"
_RANK = lambda c: f"dense_rank() OVER (PARTITION BY g ORDER BY round({c}, 9) DESC) AS rank_{c}"
#: Hubs: 300 rounds of h = A A' h from an even start; authorities from the last hubs. Every group here has an edge.
_HITS = """, hm AS (SELECT a.merged_subnetwork_id AS g, a.src_txn_id AS u, b.src_txn_id AS v, count(*) AS m FROM fe a JOIN fe b ON a.merged_subnetwork_id = b.merged_subnetwork_id AND a.dst_txn_id = b.dst_txn_id GROUP BY 1, 2, 3),
hz(k, g, node, h) AS (SELECT 0, g, node, 1.0::DOUBLE FROM gs UNION ALL SELECT k + 1, g, node, q / max(q) OVER (PARTITION BY g) FROM (SELECT z.k, z.g, z.node, coalesce(f.s, 0) AS q FROM hz z
  LEFT JOIN (SELECT hm.g, hm.u AS node, sum(hm.m * y.h) AS s FROM hz y JOIN hm ON hm.g = y.g AND hm.v = y.node GROUP BY 1, 2) f ON f.g = z.g AND f.node = z.node WHERE z.k < 300)),
hl AS (SELECT g, node, h FROM hz WHERE k = 300), hv AS (SELECT l.g, l.node, l.h, coalesce(sum(s.h), 0) AS a FROM hl l LEFT JOIN fe e ON e.merged_subnetwork_id = l.g AND e.dst_txn_id = l.node LEFT JOIN hl s ON s.g = l.g AND s.node = e.src_txn_id GROUP BY 1, 2, 3),
hits AS (SELECT g, node, h / sum(h) OVER (PARTITION BY g) AS hub, a / sum(a) OVER (PARTITION BY g) AS authority FROM hv)"""
_UND = """, und AS (SELECT merged_subnetwork_id AS g, src_txn_id AS u, dst_txn_id AS v FROM fe UNION SELECT merged_subnetwork_id, dst_txn_id, src_txn_id FROM fe)"""
#: The leading vector of the undirected graph by 2,000 rounds of A + I; zeros under three nodes.
_EIGEN = """, ez(k, g, node, n, x) AS (SELECT 0, g, node, n, 1 / sqrt(CAST(n AS DOUBLE)) FROM gs UNION ALL SELECT k + 1, g, node, n, q / sqrt(sum(q * q) OVER (PARTITION BY g)) FROM (SELECT z.k, z.g, z.node, z.n, z.x + coalesce(f.s, 0) AS q FROM ez z
  LEFT JOIN (SELECT und.g, und.v AS node, sum(y.x) AS s FROM ez y JOIN und ON und.g = y.g AND und.u = y.node GROUP BY 1, 2) f ON f.g = z.g AND f.node = z.node WHERE z.k < 2000)),
eig AS (SELECT g, node, CASE WHEN n < 3 THEN 0 ELSE x END AS eigenvector FROM ez WHERE k = 2000)"""
#: Each node's value becomes the h-index of its neighbours' values, from the degree down; that ends on the core numbers.
_CORE = """, cz(k, g, node, c) AS (SELECT 0, g, u, count(*) FROM und WHERE u <> v GROUP BY 1, 2, 3 UNION ALL SELECT k + 1, g, node, max(least(r, c)) FROM (
  SELECT z.k, z.g, und.v AS node, z.c, row_number() OVER (PARTITION BY z.g, und.v ORDER BY z.c DESC) AS r FROM cz z JOIN und ON und.g = z.g AND und.u = z.node AND und.u <> und.v WHERE z.k < 60) GROUP BY 1, 2, 3),
core AS (SELECT gs.g, gs.node, CASE WHEN gs.g IN (SELECT g FROM und WHERE u = v) THEN 0 ELSE CAST(c AS DOUBLE) END AS coreness FROM gs JOIN cz ON cz.g = gs.g AND cz.node = gs.node AND k = 60)"""
_KATZ = """, kz(k, g, node, x) AS (SELECT 0, g, node, 1.0::DOUBLE FROM gs UNION ALL SELECT kz.k + 1, kz.g, kz.node, 1 + 0.1::DOUBLE * coalesce(f.s, 0) FROM kz LEFT JOIN (SELECT s.g, e.dst_txn_id AS node, sum(s.x) AS s FROM kz s JOIN fe e ON e.merged_subnetwork_id = s.g AND e.src_txn_id = s.node GROUP BY 1, 2) f ON f.g = kz.g AND f.node = kz.node WHERE kz.k < 40),
ktz AS (SELECT g, node, x / sqrt(sum(x * x) OVER (PARTITION BY g)) AS katz FROM kz WHERE k = 40)"""
_PATHS = """, hrm AS (SELECT gn.g, gn.node, coalesce(sum(1.0::DOUBLE / hop), 0) AS harmonic FROM gn LEFT JOIN dist ON dist.g = gn.g AND dist.t = gn.node AND hop > 0 GROUP BY 1, 2),
btp AS (SELECT a.g, a.t AS node, sum(a.paths * b.paths / CAST(d.paths AS DOUBLE)) AS v FROM dist a JOIN dist b ON b.g = a.g AND b.s = a.t JOIN dist d ON d.g = a.g AND d.s = a.s AND d.t = b.t WHERE a.hop > 0 AND b.hop > 0 AND a.s <> b.t AND a.hop + b.hop = d.hop GROUP BY 1, 2),
btw AS (SELECT gs.g, gs.node, coalesce(v / nullif(CAST((n - 1) * (n - 2) AS DOUBLE), 0), 0) AS betweenness FROM gs LEFT JOIN btp ON btp.g = gs.g AND btp.node = gs.node)"""
_CENTRAL = ["hub", "authority", "eigenvector", "katz", "coreness", "harmonic", "betweenness"]
_PREDICTED = _MERGED.replace(_ALLOWED, _ALLOWED_PREDICTED)
SQL |= {
    "hits": f"WITH RECURSIVE {_PR}{_HITS} SELECT g AS merged_subnetwork_id, node, {_ROUND('hub')}, {_ROUND('authority')}, {_RANK('hub')}, {_RANK('authority')} FROM hits",
    "eigenvector": f"WITH RECURSIVE {_PR}{_UND}{_EIGEN} SELECT g AS merged_subnetwork_id, node, {_ROUND('eigenvector')}, {_RANK('eigenvector')} FROM eig",
    "coreness": f"WITH RECURSIVE {_PR}{_UND}{_CORE} SELECT g AS merged_subnetwork_id, node, coreness, {_RANK('coreness')} FROM core",
    "rank_join_all": f"WITH RECURSIVE {_RANKS}{_HITS}{_UND}{_EIGEN}{_CORE}{_KATZ}{_DIST}{_PATHS}, cen AS (SELECT g AS merged_subnetwork_id, node, {', '.join(f'{_ROUND(c)}, {_RANK(c)}' for c in _CENTRAL)} FROM hits JOIN eig USING (g, node) JOIN ktz USING (g, node) JOIN core USING (g, node) JOIN hrm USING (g, node) JOIN btw USING (g, node)) SELECT ranks.* REPLACE (round(composite_raw, 6) AS composite_raw), cen.* EXCLUDE (merged_subnetwork_id, node) FROM ranks LEFT JOIN cen ON cen.merged_subnetwork_id = ranks.merged_subnetwork_id AND cen.node = ranks.node",
    "strong_components": f"""WITH RECURSIVE {_FULL.replace(_ALLOWED, _ALLOWED_PREDICTED)}, lk AS (SELECT src AS id FROM ie UNION SELECT dst FROM ie),
mu AS (SELECT a.seed AS txn_id, min(b.seed) AS component_id FROM reach a JOIN reach b ON b.seed = a.node AND b.node = a.seed WHERE a.seed IN (SELECT id FROM lk) GROUP BY 1)
SELECT txn_id, component_id, count(*) OVER (PARTITION BY component_id) AS size FROM mu""",
    "chain_places": f"""WITH RECURSIVE {_ALLOWED}, li AS (SELECT src, dst FROM ie WHERE src IN (SELECT src FROM ie GROUP BY 1 HAVING count(*) = 1) AND dst IN (SELECT dst FROM ie GROUP BY 1 HAVING count(*) = 1)),
lk AS (SELECT src AS id FROM ie UNION SELECT dst FROM ie), ch(node, chain, place) AS (SELECT id, id, 0::BIGINT FROM lk WHERE id NOT IN (SELECT dst FROM li) UNION ALL SELECT li.dst, chain, place + 1 FROM ch JOIN li ON li.src = ch.node)
SELECT node AS txn_id, chain AS chain_id, place FROM ch""",
    "subnet_nodes_predicted": f"WITH RECURSIVE {_FULL.replace(_ALLOWED, _ALLOWED_PREDICTED)} SELECT * FROM nd",
    "merged_nodes_predicted": f"WITH RECURSIVE {_PREDICTED} SELECT merged_subnetwork_id, txn_id, min_hop, array_to_string(seeds_in_group, ';') AS seeds_in_group FROM fn",
    "merged_group_seeds": f"WITH RECURSIVE {_MERGED} SELECT DISTINCT merged_subnetwork_id, seed_txn FROM rn",
    "min_size_relabelled": f"WITH RECURSIVE {_MERGED} SELECT CAST(dense_rank() OVER (ORDER BY merged_subnetwork_id) - 1 AS BIGINT) AS merged_subnetwork_id, txn_id, min_hop FROM fn WHERE merged_subnetwork_id IN (SELECT merged_subnetwork_id FROM fn GROUP BY 1 HAVING count(*) >= 2)",
    "merged_nodes_sorted": f"WITH RECURSIVE {_MERGED} SELECT merged_subnetwork_id, min_hop, txn_id, row_number() OVER (ORDER BY merged_subnetwork_id, min_hop, txn_id) - 1 AS place FROM fn",
    "viz_edges": f"WITH RECURSIVE {_MERGED}, sd AS (SELECT merged_subnetwork_id AS g, src_txn_id AS node FROM fe WHERE min_src_hop = 0 UNION SELECT merged_subnetwork_id, dst_txn_id FROM fe WHERE min_dst_hop = 0) SELECT merged_subnetwork_id, src_txn_id, dst_txn_id, (merged_subnetwork_id, src_txn_id) IN (SELECT (g, node) FROM sd) AS src_is_seed, (merged_subnetwork_id, dst_txn_id) IN (SELECT (g, node) FROM sd) AS dst_is_seed FROM fe",
    "addr_metrics_by_strength": SQL["addr_metrics"].replace("(pagerank - min(pagerank) OVER g) * 800 / nullif(max(pagerank) OVER g - min(pagerank) OVER g, 0)", "(strength - min(strength) OVER g) * 800 / nullif(CAST(max(strength) OVER g - min(strength) OVER g AS DOUBLE), 0)").replace("ORDER BY pagerank DESC, address", "ORDER BY strength DESC, address").replace("round(pagerank, 6) AS pagerank, ", ""),
    "class_counts_by_step": f"""WITH {_CLS} SELECT time_step, {", ".join(f"count(*) FILTER (class_label = '{c}') AS \"{c}\"" for c in ("Illicit", "Licit", "Unknown"))} FROM cls GROUP BY 1""",
    "io_round_trip": f"WITH {_CLS} SELECT class_label, CAST(2 * count(*) AS BIGINT) AS n, 2::BIGINT AS times FROM cls WHERE class_label <> 'Unknown' GROUP BY 1",
    "labelled_split": f"""WITH {_CLS} SELECT "txId", CAST(CASE class_label WHEN 'Illicit' THEN 1 WHEN 'Licit' THEN 0 END AS INTEGER) AS class, CASE WHEN class_label = 'Unknown' THEN 'test' ELSE 'labelled' END AS part FROM cls""",
    "data_split_by_ids": f"""WITH {_CLS} SELECT "txId", CASE WHEN class_label = 'Unknown' THEN 'Test' ELSE 'Train/Val' END AS data_split FROM cls""",
    "prepared_rows": f"""WITH {_FEAT}, {_SCORE}, r AS (SELECT score."txId", score.time_step, class, fees, size FROM score JOIN feat USING ("txId") WHERE class IS NOT NULL), st AS (SELECT time_step, row_number() OVER (ORDER BY time_step) <= floor(count(*) OVER () * 0.7::DOUBLE) AS tr FROM (SELECT DISTINCT time_step FROM r)) SELECT "txId", fees, size, class FROM r JOIN st USING (time_step) WHERE NOT tr""",
    "utc_timestamps": "SELECT o_orderkey, strftime(timezone('UTC', timezone('Australia/Melbourne', CAST(o_orderdate AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S') AS utc_text FROM orders",
}
