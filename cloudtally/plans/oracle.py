"""Building blocks of the check queries: the same inputs written in plain SQL."""

from __future__ import annotations

import re

from cloudtally import fixed_values as fv


def r(expr: str, digits: int) -> str:
    """Half-up rounding through a wider DECIMAL."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,{max(digits + 3, 8)})), {digits}) AS DOUBLE)"


def money(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(28,10))) AS DOUBLE)"


def band(expr: str, bands, floor: str) -> str:
    arms = " ".join(f"WHEN {expr} >= {low} THEN '{name}'" for low, name in bands)
    return f"CASE {arms} ELSE '{floor}' END"


def clip(expr: str, low, high) -> str:
    return f"CASE WHEN {expr} IS NOT NULL THEN greatest({low}, least({high}, {expr})) END"


SPEC_ROWS = ", ".join(
    f"({i}, '{n}', '{n.rsplit('.', 1)[0]}', {v}, CAST({g} AS DOUBLE))"
    for i, (n, v, g) in enumerate(fv.INSTANCE_SPECS)
)
DOWN_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in fv.DOWNSIZE.items())
DIMS = tuple(fv.INCIDENT_WEIGHTS)
SERIES_W = "PARTITION BY organization_id, resource_id ORDER BY date"


def zscore(d: str) -> str:
    frame = f"OVER ({SERIES_W} ROWS BETWEEN 36 PRECEDING AND 7 PRECEDING)"
    return (
        f"greatest(-10.0, least(10.0, coalesce(CASE WHEN count({d}) {frame} >= 5 AND stddev_samp({d}) {frame} > 0 "
        f"THEN ({d} - avg({d}) {frame}) / stddev_samp({d}) {frame} END, 0.0)))"
    )


ANOM_PARTS = ", ".join(
    f"{r(f'greatest(0.0, least(100.0, abs({d}_zscore) * 10))', 6)} AS s_{d}" for d in DIMS
)
FUSED = " + ".join(f"s_{d} * {w / sum(fv.INCIDENT_WEIGHTS.values())!r}" for d, w in fv.INCIDENT_WEIGHTS.items())
WASTE_TOTAL = (
    "0.3 * coalesce((100 - cpu_avg_pct) / 100, 0) + 0.2 * coalesce((100 - memory_avg_pct) / 100, 0)"
    " + 0.2 * coalesce(CASE WHEN hi - lo < 1e-9 THEN 0.0 ELSE greatest(0.0, least(1.0, (cost_growth_rate - lo) / (hi - lo))) END, 0)"
    " + 0.2 * greatest(0.0, least(1.0, idle_days / 30.0))"
    " + 0.1 * CASE WHEN anomaly_history_count > 0 THEN 1.0 ELSE 0.0 END"
)

CTE = {
    "specs": f"SELECT * FROM (VALUES {SPEC_ROWS}) t(spec_order, instance_type, family, vcpu, ram_gb)",
    "down": f"SELECT * FROM (VALUES {DOWN_ROWS}) t(instance_type, target_type)",
    "f1": f"""
      SELECT concat('org-', CAST(n_nationkey % 5 AS VARCHAR)) AS organization_id,
             CAST(l_shipdate AS DATE) AS date, n_name AS account_id,
             CASE s_suppkey % 4 WHEN 0 THEN 'EC2' WHEN 1 THEN 'S3' WHEN 2 THEN 'RDS' ELSE 'Lambda' END AS service,
             concat('vm-', CAST(s_suppkey AS VARCHAR)) AS resource_id, r_name AS region,
             max(instance_type) AS instance_type,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS cost,
             CAST(24 AS DOUBLE) AS usage_hours,
             {r("avg(l_quantity) * 2", 2)} AS cpu_avg_pct,
             {r("avg(l_discount) * 1000", 2)} AS memory_avg_pct,
             sum(l_quantity) AS disk_io,
             {r("avg(l_tax) * 1000", 2)} AS network_io,
             CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS anomaly_history_count
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey JOIN specs ON spec_order = s_suppkey % 33
      GROUP BY n_nationkey, CAST(l_shipdate AS DATE), n_name, r_name, s_suppkey""",
    "up": """
      SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS row_id,
             concat('org-', n_nationkey % 5) AS organization_id,
             CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS date,
             concat('vm-', l_suppkey % 40) AS resource_id,
             CASE WHEN l_orderkey % 89 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS cost,
             l_quantity * 2.25 - 3 AS cpu_avg_pct,
             CASE WHEN l_discount = 0 THEN CAST(-1 AS DOUBLE) ELSE l_quantity END AS memory_avg_pct,
             CASE l_linenumber WHEN 3 THEN '  ' WHEN 5 THEN NULL ELSE n_name END AS region,
             CASE WHEN l_suppkey % 40 = 39 THEN 'm9.huge' ELSE instance_type END AS instance_type
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
           JOIN specs ON spec_order = l_suppkey % 33""",
    "fails": """
      SELECT organization_id, row_id, resource_id, 'missing_timestamp' AS rule, 'error' AS severity, 'date is null' AS detail
        FROM up WHERE date IS NULL
      UNION ALL SELECT organization_id, row_id, resource_id, 'duplicated_resource_id', 'warning', 'duplicate (date, resource_id) pair'
        FROM (SELECT *, count(*) OVER (PARTITION BY organization_id, date, resource_id) AS n FROM up) WHERE n > 1
      UNION ALL SELECT organization_id, row_id, resource_id, 'impossible_cpu_value', 'error', concat('cpu_avg_pct=', CAST(cpu_avg_pct AS VARCHAR))
        FROM up WHERE cpu_avg_pct > 100 OR cpu_avg_pct < 0
      UNION ALL SELECT organization_id, row_id, resource_id, 'negative_memory', 'error', concat('memory_avg_pct=', CAST(memory_avg_pct AS VARCHAR))
        FROM up WHERE memory_avg_pct < 0
      UNION ALL SELECT organization_id, row_id, resource_id, 'negative_price', 'error', concat('cost=', CAST(cost AS VARCHAR))
        FROM up WHERE cost < 0
      UNION ALL SELECT organization_id, row_id, resource_id, 'missing_region', 'warning', 'region is null or empty'
        FROM up WHERE region IS NULL OR trim(region) = ''
      UNION ALL SELECT organization_id, row_id, resource_id, 'unmappable_instance_type', 'warning',
               concat('instance_type=''', instance_type, ''' not in reference table')
        FROM up WHERE instance_type IS NOT NULL AND instance_type NOT IN (SELECT instance_type FROM specs)""",
    "f2": """
      SELECT user_id AS vm_id, ts, CAST(1 + user_id % 16 AS INT) AS cpu_cores, CAST(500 AS DOUBLE) AS cpu_capacity_mhz,
             CASE WHEN event_type = 'error' THEN NULL ELSE value END AS cpu_usage_mhz,
             CASE WHEN event_type = 'error' THEN NULL ELSE value / 5 END AS cpu_usage_percent,
             CAST(102400 AS DOUBLE) AS memory_provisioned_kb,
             CAST(json_extract_string(props, '$.k') AS INT) * CAST(1024 AS DOUBLE) AS memory_usage_kb,
             CASE WHEN event_type = 'view' THEN value ELSE 0.0 END AS disk_read_kbps,
             CASE WHEN event_type = 'click' THEN value ELSE 0.0 END AS disk_write_kbps,
             CASE WHEN event_type = 'signup' THEN value ELSE 0.0 END AS network_received_kbps,
             CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS network_transmitted_kbps,
             src, event_id
      FROM (SELECT 0 AS src, event_id, ts, user_id, event_type, value, props FROM events
            UNION ALL SELECT 1, event_id, ts, user_id, event_type, value + 1, props FROM events WHERE event_id % 50 = 0)""",
    "f2u": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vm_id, ts ORDER BY src, event_id) AS rn FROM f2) WHERE rn = 1""",
    "cleaned": """
      SELECT * REPLACE (
               coalesce(last_value(cpu_usage_mhz IGNORE NULLS) OVER up_to, first_value(cpu_usage_mhz IGNORE NULLS) OVER from_here) AS cpu_usage_mhz,
               coalesce(last_value(cpu_usage_percent IGNORE NULLS) OVER up_to, first_value(cpu_usage_percent IGNORE NULLS) OVER from_here) AS cpu_usage_percent)
      FROM f2u
      WINDOW up_to AS (PARTITION BY vm_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             from_here AS (PARTITION BY vm_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "ready": """
      SELECT *, memory_provisioned_kb / 1024 AS memory_provisioned_mb, memory_usage_kb / 1024 AS memory_usage_mb,
             greatest(0.0, least(1.0, memory_usage_kb / memory_provisioned_kb)) AS memory_utilization_ratio,
             greatest(0.0, least(1.0, cpu_usage_mhz / cpu_capacity_mhz)) AS cpu_utilization_ratio
      FROM cleaned WHERE cpu_usage_percent IS NOT NULL AND memory_usage_kb IS NOT NULL""",
    "silver": """
      SELECT vm_id, CAST(ts AS DATE) AS date, arg_min(cpu_cores, ts) AS cpu_cores,
             avg(cpu_capacity_mhz) AS cpu_capacity_mhz, avg(cpu_usage_mhz) AS cpu_usage_mhz,
             avg(cpu_usage_percent) AS cpu_usage_percent, avg(memory_provisioned_kb) AS memory_provisioned_kb,
             avg(memory_usage_kb) AS memory_usage_kb, avg(memory_provisioned_mb) AS memory_provisioned_mb,
             avg(memory_usage_mb) AS memory_usage_mb, avg(memory_utilization_ratio) AS memory_utilization_ratio,
             avg(cpu_utilization_ratio) AS cpu_utilization_ratio,
             sum(disk_read_kbps) AS disk_read_kbps, sum(disk_write_kbps) AS disk_write_kbps,
             sum(network_received_kbps) AS network_received_kbps, sum(network_transmitted_kbps) AS network_transmitted_kbps
      FROM ready GROUP BY vm_id, CAST(ts AS DATE)""",
    "f3": """
      SELECT instance_type, concat(CASE p_size % 4 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'ap-south-1' ELSE 'eu-west-1' END,
                    substring('abc', CAST(p_size % 3 + 1 AS INT), 1)) AS region_raw,
             CASE p_type WHEN 'ECONOMY' THEN 'Linux/UNIX' WHEN 'SMALL' THEN 'Red Hat Enterprise Linux' WHEN 'MEDIUM' THEN 'SUSE Linux'
                         WHEN 'PROMO' THEN 'Windows' WHEN 'LARGE' THEN ' BSD ' ELSE NULL END AS os_raw,
             CASE WHEN (p_partkey % 33) % 3 = 2 AND p_partkey % 2 = 0 THEN 'on_demand'
                  WHEN (p_partkey % 33) % 3 >= 1 AND p_partkey % 5 < 3 THEN 'spot' ELSE 'prediction' END AS pricing_type,
             CASE WHEN p_partkey % 41 = 0 THEN CAST(-1 AS DOUBLE) ELSE p_retailprice / 1000 END AS hourly_rate,
             date '2024-01-01' + CAST(p_size AS INT) AS effective_date,
             concat(lower(p_type), '.csv') AS source_file
      FROM part JOIN specs ON spec_order = p_partkey % 33""",
    "prices": """
      SELECT DISTINCT instance_type, trim(region_raw) AS region_raw,
             CASE WHEN os_raw IS NULL THEN 'unknown'
                  WHEN lower(os_raw) LIKE '%red hat%' OR lower(os_raw) LIKE '%rhel%' THEN 'rhel'
                  WHEN lower(os_raw) LIKE '%suse%' THEN 'suse' WHEN lower(os_raw) LIKE '%windows%' THEN 'windows'
                  WHEN lower(os_raw) LIKE '%linux%' OR lower(os_raw) LIKE '%unix%' THEN 'linux'
                  ELSE trim(lower(os_raw)) END AS os,
             pricing_type, effective_date, hourly_rate, source_file,
             regexp_replace(trim(region_raw), '([a-z]+-[a-z]+-[0-9]+)[a-z]$', '\\1') AS region
      FROM f3 WHERE hourly_rate > 0""",
    "rates": """
      SELECT instance_type, coalesce(o, s, p, a) AS hourly_rate,
             CASE WHEN o IS NOT NULL THEN 'on_demand' WHEN s IS NOT NULL THEN 'spot' WHEN p IS NOT NULL THEN 'prediction' ELSE 'mixed' END AS rate_source
      FROM (SELECT lower(instance_type) AS instance_type, avg(hourly_rate) FILTER (pricing_type = 'on_demand') AS o,
                   avg(hourly_rate) FILTER (pricing_type = 'spot') AS s, avg(hourly_rate) FILTER (pricing_type = 'prediction') AS p,
                   avg(hourly_rate) AS a FROM prices GROUP BY lower(instance_type))""",
    "feet": """
      SELECT vm_id, CAST(arg_min(cpu_cores, date) AS DOUBLE) AS cpu_cores, arg_min(memory_provisioned_mb, date) / 1024 AS ram_gb
      FROM silver GROUP BY vm_id""",
    "paired": """
      SELECT vm_id, cpu_cores, f.ram_gb, s.instance_type, spec_order,
             NOT (vcpu / greatest(cpu_cores, 0.01) BETWEEN 0.4 AND 2.5 AND s.ram_gb / greatest(f.ram_gb, 0.01) BETWEEN 0.4 AND 2.5) AS outside,
             0.5 * abs(vcpu - cpu_cores) / greatest(CAST(vcpu AS DOUBLE), cpu_cores, 1.0)
             + 0.5 * abs(s.ram_gb - f.ram_gb) / greatest(s.ram_gb, f.ram_gb, 1.0) AS distance
      FROM feet f JOIN specs s ON true""",
    "matched": f"""
      SELECT vm_id, cpu_cores, ram_gb, CASE WHEN exp(-3 * distance) >= 0.55 THEN instance_type END AS matched_instance_type,
             {r("exp(-3 * distance)", 4)} AS confidence, {r("distance", 4)} AS distance, exp(-3 * distance) < 0.55 AS needs_manual_review
      FROM (SELECT *, row_number() OVER (PARTITION BY vm_id ORDER BY outside, distance, spec_order) AS rn FROM paired) WHERE rn = 1""",
    "grown": f"""
      SELECT *, row_number() OVER ({SERIES_W}) AS runtime_days,
             CASE WHEN lag(cost) OVER ({SERIES_W}) <> 0 THEN cost / lag(cost) OVER ({SERIES_W}) - 1 ELSE 0.0 END AS cost_growth_rate
      FROM f1""",
    "span": "SELECT organization_id, min(cost_growth_rate) AS lo, max(cost_growth_rate) AS hi FROM grown GROUP BY organization_id",
    "idle": f"""
      SELECT *, sum(CASE WHEN cpu_avg_pct < 10 THEN 1 ELSE 0 END) OVER ({SERIES_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS idle_days
      FROM grown""",
    "scored0": f"SELECT idle.*, {r('(' + WASTE_TOTAL + ') * 100', 2)} AS waste_score FROM idle JOIN span USING (organization_id)",
    "scored": f"SELECT *, {band('waste_score', fv.WASTE_BANDS, fv.WASTE_FLOOR)} AS bucket FROM scored0",
    "scored_latest": """
      SELECT s.* FROM scored s JOIN (SELECT organization_id, resource_id, max(date) AS date FROM scored GROUP BY 1, 2) m
        USING (organization_id, resource_id, date)""",
    "z": "SELECT *, " + ", ".join(f"{zscore(d)} AS {d}_zscore" for d in DIMS) + " FROM f1",
    "anom0": f"SELECT *, {ANOM_PARTS} FROM z",
    "anom1": f"SELECT *, {r(FUSED, 2)} AS incident_score FROM anom0",
    "anom": f"SELECT *, {band('incident_score', fv.SEVERITY_BANDS, fv.SEVERITY_FLOOR)} AS severity FROM anom1",
    "rec0": f"""
      SELECT s.organization_id, s.resource_id, bucket, instance_type, target_type, cpu_avg_pct, memory_avg_pct, runtime_days,
             coalesce(a.hourly_rate, cost / 24, 0.0) AS cur,
             CASE WHEN bucket IN ('Idle', 'Critical Waste') THEN 0.0 ELSE coalesce(b.hourly_rate, coalesce(a.hourly_rate, cost / 24, 0.0) * 0.5) END AS tgt
      FROM scored_latest s LEFT JOIN down USING (instance_type) LEFT JOIN rates a USING (instance_type)
           LEFT JOIN rates b ON b.instance_type = target_type
      WHERE bucket IN ('Idle', 'Critical Waste') OR (bucket = 'Underutilized' AND target_type IS NOT NULL)""",
    "rec1": f"""
      SELECT *, {r('greatest(0.0, (cur - tgt) * 720)', 2)} AS estimated_savings, CAST(69.5 AS DOUBLE) AS confidence,
             concat_ws(', ', CASE WHEN cpu_avg_pct < 20 OR coalesce(memory_avg_pct >= 20, true) THEN concat('CPU averaged ', CAST(CAST(round_even(cpu_avg_pct, 0) AS INT) AS VARCHAR), '%') END,
                       CASE WHEN memory_avg_pct < 20 THEN concat('memory utilization averaged ', CAST(CAST(round_even(memory_avg_pct, 0) AS INT) AS VARCHAR), '%') END) AS signals
      FROM rec0""",
    "rec": f"""
      SELECT organization_id, resource_id, concat('rec-', resource_id) AS recommendation_id,
             CASE WHEN bucket IN ('Idle', 'Critical Waste') THEN concat('Terminate ', resource_id)
                  ELSE concat('Downsize ', resource_id, ' from ', instance_type, ' to ', target_type) END AS action,
             estimated_savings, confidence, concat(signals, ' over ', runtime_days, ' days (', bucket, ')') AS reason,
             impact_score, {band('impact_score', fv.IMPACT_BANDS, fv.IMPACT_FLOOR)} AS impact_tier,
             CASE WHEN CAST(substr(resource_id, 4) AS INT) % 4 = 0 THEN 'dismissed' ELSE 'open' END AS status
      FROM (SELECT *, {r('estimated_savings * confidence / 100', 2)} AS impact_score FROM rec1)""",
    "f4": """
      SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS service,
             CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS cost, count(DISTINCT o_custkey) AS active_resource_count
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "f4all": """
      SELECT 'per_service' AS level, * FROM f4
      UNION ALL SELECT 'org_total', CAST(o_orderdate AS DATE), NULL, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE), count(DISTINCT o_custkey)
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2""",
    "f6": """
      SELECT concat('org-', (s_nationkey + k) % 5) AS organization_id, concat('vm-', s_suppkey) AS resource_id,
             date '1996-01-01' + CAST(s_suppkey * 37 % 1500 + 400 * k AS INT) AS start_date,
             date '1996-01-01' + CAST(s_suppkey * 37 % 1500 + 400 * k + 7 + s_suppkey % 14 AS INT) AS end_date
      FROM supplier, (SELECT unnest([0, 1]) AS k)""",
    "f8": """
      SELECT concat('org-', s_nationkey % 5) AS organization_id, CAST(s_suppkey % 2 AS INT) AS scenario_id, concat('vm-', s_suppkey) AS resource_id,
             CASE WHEN s_suppkey % 10 < 2 THEN 'terminate' ELSE 'resize' END AS action_type,
             CASE WHEN s_suppkey % 10 BETWEEN 2 AND 3 THEN CAST(100 AS DOUBLE) END AS new_hourly_rate
      FROM supplier WHERE s_suppkey % 10 < 5
      UNION ALL SELECT concat('org-', r_regionkey % 5), 0, 'vm-unknown', 'terminate', NULL FROM region""",
    "last_day": "SELECT organization_id, max(date) AS last_date FROM f1 GROUP BY 1",
    "f1_last": "SELECT f1.*, last_date FROM f1 JOIN last_day USING (organization_id)",
    "recent30": "SELECT * FROM f1_last WHERE date >= last_date - 30",
    "series": f"""
      SELECT organization_id, date, 'org_total' AS level, CAST(NULL AS VARCHAR) AS service, {money('cost')} AS cost, count(DISTINCT resource_id) AS active_resource_count
      FROM f1 GROUP BY organization_id, date
      UNION ALL SELECT organization_id, date, 'per_service', service, {money('cost')}, count(DISTINCT resource_id)
      FROM f1 GROUP BY organization_id, date, service""",
    "fc": """
      SELECT organization_id, level, service, date AS forecast_date, lag_1d AS forecast, lag_1d * 0.9 AS ci_lower, lag_1d * 1.1 AS ci_upper
      FROM (SELECT *, lag(cost) OVER (PARTITION BY organization_id, level, service ORDER BY date) AS lag_1d FROM series) WHERE lag_1d IS NOT NULL""",
    "reg": """
      SELECT CASE n_nationkey % 3 WHEN 0 THEN 'forecast' WHEN 1 THEN 'anomaly' ELSE 'waste_classifier' END AS model_type,
             concat('v', n_nationkey) AS version, date '2024-01-01' + n_nationkey AS training_date,
             n_regionkey * 1.5 AS mape, n_nationkey / 25.0 AS f1_macro, n_nationkey * 2.5 AS error_reduction_pct, n_nationkey >= 22 AS is_active
      FROM nation""",
    "asked": """
      SELECT concat('c', conv_id, '-', turn) AS question_id, text AS question FROM conversations WHERE role = 'user'
      UNION ALL SELECT concat('o', o_orderkey), concat(CASE o_orderkey % 8 WHEN 0 THEN 'Why did my bill increase?' WHEN 1 THEN 'Which instances should I terminate?'
             WHEN 2 THEN 'Show idle resources' WHEN 3 THEN 'Compare last month vs this month' WHEN 4 THEN 'Which VM had the highest network usage?'
             WHEN 5 THEN 'Forecast EC2 cost for next week' WHEN 6 THEN 'List unused RDS machines in eu-west-1' ELSE 'What is the weather?' END, ' ', o_orderpriority) FROM orders""",
    "marked": """
      SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY date, md5(resource_id))
             <= floor(count(*) OVER (PARTITION BY organization_id) * CAST(0.8 AS DECIMAL(9,6))) AS is_train FROM f1""",
    "long": """
      SELECT organization_id, feature, value, is_train FROM (
        SELECT organization_id, is_train, 'cost' AS feature, cost AS value FROM marked
        UNION ALL SELECT organization_id, is_train, 'cpu_avg_pct', cpu_avg_pct FROM marked
        UNION ALL SELECT organization_id, is_train, 'memory_avg_pct', memory_avg_pct FROM marked) WHERE value IS NOT NULL""",
    "edges": """
      SELECT organization_id, feature, list_distinct_sorted AS edges FROM (
        SELECT organization_id, feature, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS list_distinct_sorted
        FROM long WHERE is_train GROUP BY 1, 2)""",
    "binned": """
      SELECT organization_id, feature, least(len(list_filter(edges, lambda e : e <= value)), len(edges) - 1) AS bin,
             count(*) FILTER (is_train) AS t, count(*) FILTER (NOT is_train) AS n
      FROM long JOIN edges USING (organization_id, feature)
      WHERE value >= edges[1] AND value <= edges[len(edges)] GROUP BY 1, 2, 3""",
    "psi": f"""
      SELECT organization_id, feature, {r('sum((np - tp) * ln(np / tp))', 4)} AS psi FROM (
        SELECT organization_id, feature, greatest(t / sum(t) OVER (PARTITION BY organization_id, feature), 1e-4) AS tp,
               greatest(n / sum(n) OVER (PARTITION BY organization_id, feature), 1e-4) AS np FROM binned) GROUP BY 1, 2""",
    "cdf": """
      SELECT organization_id, feature, value,
             sum(t) OVER w / sum(t) OVER (PARTITION BY organization_id, feature) AS ft,
             sum(n) OVER w / sum(n) OVER (PARTITION BY organization_id, feature) AS fnew,
             sum(t) OVER (PARTITION BY organization_id, feature) AS nt, sum(n) OVER (PARTITION BY organization_id, feature) AS nn
      FROM (SELECT organization_id, feature, value, count(*) FILTER (is_train) AS t, count(*) FILTER (NOT is_train) AS n FROM long GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY organization_id, feature ORDER BY value ROWS UNBOUNDED PRECEDING)""",
    "ks0": "SELECT organization_id, feature, max(abs(ft - fnew)) AS d, max(nt) AS nt, max(nn) AS nn FROM cdf GROUP BY 1, 2",
    "ks": f"""
      SELECT organization_id, feature, {r('d', 4)} AS ks_statistic,
             {r('CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k : CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(greatest(-700.0, -2.0 * k * k * x * x)))))) END', 6)} AS ks_pvalue
      FROM (SELECT *, d * sqrt(CAST(nt AS DOUBLE) * nn / (CAST(nt AS DOUBLE) + nn)) AS x FROM ks0)""",
}


def sql(final: str) -> str:
    """``final`` preceded by exactly the building blocks it reads, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in CTE and name not in needed:
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    head = ",\n".join(f"{n} AS ({CTE[n]})" for n in needed)
    return f"WITH {head}\n{final}"
