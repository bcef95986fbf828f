"""Independent SQL (DuckDB dialect) for every registered query.

Each statement re-derives its fixture from the base views (``orders``,
``customer``, ``lineitem``) with the same rules as
:mod:`ledgerlens.plans.fixtures`, then states the operator in plain SQL.
Money is summed as exact decimals and cast to double at the end; ratios are
computed in double in the same order as on the Spark side.
"""

from __future__ import annotations

from .. import schema as S

RECON_CTE = """
lt AS (SELECT l_orderkey AS k, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS pvi
       FROM lineitem WHERE l_orderkey % 10 <> 7 GROUP BY l_orderkey),
b AS (SELECT o.o_orderkey AS k, o.*, c.c_name, c.c_mktsegment, lt.pvi,
             CASE WHEN o.o_orderkey % 10 <> 3 THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END AS gsm
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      LEFT JOIN lt ON lt.k = o.o_orderkey),
recon AS (
  SELECT CONCAT('O', CAST(k AS VARCHAR)) AS order_id,
         c_name AS merchant,
         CAST(o_orderdate AS DATE) AS biz_date,
         CASE WHEN k % 89 = 0 THEN 'bad'
              ELSE strftime(o_orderdate + to_seconds(((k % 86400) * (k % 86400)) % 86400),
                            '%Y-%m-%d %H:%M:%S') END AS order_time,
         CASE WHEN k % 97 = 0 THEN NULL
              WHEN gsm IS NOT NULL AND pvi IS NOT NULL THEN 'match'
              WHEN pvi IS NOT NULL THEN 'not_found_in_m'
              ELSE 'not_found_in_external' END AS reconcile_status,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
              ELSE 'cancelled' END AS insurance_status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'express' WHEN '2-HIGH' THEN 'Express'
              WHEN '3-MEDIUM' THEN 'normal' WHEN '5-LOW' THEN 'cargo' END AS service_type,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'true' WHEN 'MACHINERY' THEN '1'
              WHEN 'HOUSEHOLD' THEN 'false' WHEN 'FURNITURE' THEN 'no' END AS is_business_order,
         gsm AS gsm_amount,
         CAST(CASE WHEN k % 101 = 0 THEN 0
                   WHEN k % 4 = 0 AND pvi IS NOT NULL AND gsm IS NOT NULL THEN gsm
                   ELSE pvi END AS DECIMAL(18,2)) AS merchant_amount,
         CAST(COALESCE(gsm, pvi) AS DECIMAL(18,2)) AS amount
  FROM b WHERE gsm IS NOT NULL OR pvi IS NOT NULL)
"""

DRIVER_CTE = """
driver AS (
  SELECT CONCAT(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS order_id,
         CAST(CASE WHEN l_linenumber <= 3 THEN 100 WHEN l_linenumber <= 6 THEN 200
                   WHEN l_tax < 0.04 THEN 150 END AS DECIMAL(18,2)) AS gsm_amount,
         CAST(CASE WHEN l_quantity <= 20 THEN 100 WHEN l_quantity <= 40 THEN 200 ELSE 0 END
              AS DECIMAL(18,2)) AS merchant_amount,
         CASE WHEN l_linestatus = 'F' THEN 'match' WHEN l_returnflag = 'R' THEN 'not_found_in_m'
              ELSE 'not_found_in_external' END AS reconcile_status,
         CASE WHEN l_tax >= 0.07 THEN 'SUCCESS' WHEN l_returnflag = 'A' THEN 'COMPLETED'
              WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'network_error' END AS merchant_status
  FROM lineitem)
"""

_NAME_RE = r"^pvi_transaction_reconciled_(taixe_)?([0-9]{8})(_([0-9]+))?\.csv$"
_DIR_RE = r"([^/]*)/([^/]*)/([^/]*)/[^/]*$"

CATALOG_CTE = f"""
files AS (
  SELECT d, ds, ver, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM (
    SELECT CAST(o_orderdate AS DATE) AS d,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'taixe' ELSE 'reconciled' END AS ds,
           CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS ver, o_totalprice
    FROM orders) GROUP BY d, ds, ver),
catalog AS (
  SELECT concat_ws('/', 'base', CAST(year(d) AS VARCHAR),
                   CASE WHEN day(d) % 2 = 1 THEN CAST(month(d) AS VARCHAR)
                        ELSE lpad(CAST(month(d) AS VARCHAR), 2, '0') END,
                   lpad(CAST(day(d) AS VARCHAR), 2, '0'),
                   CASE WHEN ds = 'taixe' THEN '{S.FILE_PREFIXES["taixe"]}' ELSE '{S.FILE_PREFIXES["reconciled"]}' END
                   || strftime(d, '%Y%m%d') || CASE WHEN ver = 2 THEN '_2' ELSE '' END || '.csv') AS path,
         CAST(value * 100 AS BIGINT) AS length
  FROM files),
pp AS (
  SELECT path, length,
         regexp_extract(path, '{_DIR_RE}', 1) AS y, regexp_extract(path, '{_DIR_RE}', 2) AS m,
         regexp_extract(path, '{_DIR_RE}', 3) AS dd, regexp_extract(path, '([^/]*)$', 1) AS name
  FROM catalog),
pq AS (
  SELECT path, length,
         CASE WHEN length(y) > 0 THEN CAST(try_strptime(
              y || (CASE WHEN length(m) < 2 THEN lpad(m, 2, '0') ELSE m END)
                || (CASE WHEN length(dd) < 2 THEN lpad(dd, 2, '0') ELSE dd END), '%Y%m%d') AS DATE) END
           AS folder_date,
         CASE WHEN regexp_matches(name, '{_NAME_RE}') THEN
              CASE WHEN regexp_extract(name, '{_NAME_RE}', 1) <> '' THEN 'taixe' ELSE 'reconciled' END END
           AS dataset,
         CASE WHEN regexp_matches(name, '{_NAME_RE}') THEN
              CAST(try_strptime(regexp_extract(name, '{_NAME_RE}', 2), '%Y%m%d') AS DATE) END AS name_date,
         CASE WHEN regexp_matches(name, '{_NAME_RE}') THEN
              CASE WHEN regexp_extract(name, '{_NAME_RE}', 4) = '' THEN 1
                   ELSE CAST(regexp_extract(name, '{_NAME_RE}', 4) AS INTEGER) END END AS version
  FROM pp),
parsed AS (SELECT *, CASE WHEN name_date = folder_date THEN folder_date END AS biz_date FROM pq),
latest AS (
  SELECT biz_date, dataset, version, path, length FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY biz_date, dataset
                                 ORDER BY version DESC, path DESC, length DESC) AS rn
    FROM parsed WHERE biz_date IS NOT NULL) WHERE rn = 1)
"""


def pct(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) * CAST(100 AS DOUBLE)) / NULLIF(CAST({den} AS DOUBLE), 0)"


def mean(total: str, count: str) -> str:
    return f"CAST({total} AS DOUBLE) / NULLIF(CAST({count} AS DOUBLE), 0)"


CLASS = """CASE WHEN reconcile_status IS NULL THEN 'unknown' WHEN reconcile_status = 'match' THEN 'match'
  WHEN contains(reconcile_status, 'not_found_in_m') THEN 'only_m'
  WHEN contains(reconcile_status, 'not_found_in_external') THEN 'only_external' ELSE 'other' END"""

DESCRIPTION = ("CASE reconcile_status "
               + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.STATUS_DESCRIPTIONS)
               + " ELSE reconcile_status END")

SERVICE = """CASE WHEN service_type IS NULL OR service_type = '' THEN 'unknown'
  WHEN lower(service_type) = 'normal' THEN 'Ride (Normal)' WHEN lower(service_type) = 'express' THEN 'Express'
  ELSE service_type END"""

BUSINESS = """CASE WHEN lower(CAST(is_business_order AS VARCHAR)) IN ('true', '1', 'yes') THEN 'Business'
  WHEN lower(CAST(is_business_order AS VARCHAR)) IN ('false', '0', 'no') THEN 'Non-Business'
  ELSE 'Unknown (' || COALESCE(CAST(is_business_order AS VARCHAR), 'null') || ')' END"""

VEHICLE = "CASE WHEN gsm_amount = 100 THEN 'Bike' WHEN gsm_amount = 200 THEN 'Car' ELSE 'other' END"

SEVERITY = """CASE WHEN contains(lower(merchant_status), 'fail') OR contains(lower(merchant_status), 'error')
  THEN 'bad' WHEN contains(lower(merchant_status), 'success') OR contains(lower(merchant_status), 'match')
  THEN 'good' ELSE 'neutral' END"""

HOUR = "CAST(hour(try_strptime(order_time, '%Y-%m-%d %H:%M:%S')) AS INTEGER)"

RECON_COLUMNS = [("order_id", "string"), ("merchant", "string"), ("biz_date", "date"),
                 ("order_time", "string"), ("reconcile_status", "string"), ("insurance_status", "string"),
                 ("service_type", "string"), ("is_business_order", "string"),
                 ("gsm_amount", "decimal(18,2)"), ("merchant_amount", "decimal(18,2)"),
                 ("amount", "decimal(18,2)")]

AMOUNTS = ["gsm_amount", "merchant_amount", "amount"]

MERCHANT_PATTERNS = f"""
mp AS (
  SELECT merchant, COUNT(*) AS total_transactions,
         COALESCE(CAST(SUM(amount) AS DOUBLE), CAST(0 AS DOUBLE)) AS total_amount,
         {mean("SUM(amount)", "COUNT(amount)")} AS avg_amount,
         COUNT(*) FILTER (WHERE reconcile_status = 'match') AS match_count,
         COUNT(*) FILTER (WHERE contains(reconcile_status, 'not_found')) AS discrepancy_count
  FROM recon GROUP BY merchant),
mpr AS (SELECT *, {pct("match_count", "total_transactions")} AS match_rate,
               {pct("discrepancy_count", "total_transactions")} AS discrepancy_rate FROM mp)
"""

HIGH = """
high AS (
  SELECT order_id, merchant, CAST(gsm_amount AS DOUBLE) AS gsm_amount,
         CAST(merchant_amount AS DOUBLE) AS merchant_amount,
         CAST(gsm_amount - merchant_amount AS DOUBLE) AS amount_diff,
         CAST(gsm_amount - merchant_amount AS DOUBLE) / NULLIF(CAST(merchant_amount AS DOUBLE), 0)
           * CAST(100 AS DOUBLE) AS diff_percentage
  FROM recon
  WHERE gsm_amount IS NOT NULL AND merchant_amount IS NOT NULL AND merchant_amount > 0
    AND ABS(gsm_amount - merchant_amount) > merchant_amount * CAST('0.1' AS DECIMAL(10,6)))
"""

DRILL = """
drill AS (SELECT order_id, merchant, amount, service_type, reconcile_status, insurance_status,
                 is_business_order, order_time, gsm_amount, merchant_amount, biz_date
          FROM recon WHERE reconcile_status IS DISTINCT FROM 'match')
"""

HOURLY = f"""
hourly AS (
  SELECT {HOUR} AS hour, COUNT(*) AS transaction_count,
         COUNT(*) FILTER (WHERE reconcile_status = 'match') AS match_count
  FROM recon GROUP BY 1)
"""


#: Columns that no alias names: (SQL column, header).
OTHER_COLUMNS = [("order_no", "Order No"), ("rate", "Rate.1"), ("late", "Late"), ("mixed", "Mixed"), ("half", "Half"), ("blank", "Blank")]
TYPED = """
typed AS (SELECT substr(order_id, 2) AS order_no, CAST(amount AS VARCHAR) AS rate, CASE WHEN insurance_status = 'pending' THEN 'true' ELSE 'False' END AS late,
                 CASE WHEN reconcile_status IS NULL THEN 'n/a' ELSE substr(order_id, 2) END AS mixed,
                 CASE WHEN gsm_amount IS NULL THEN NULL WHEN CAST(substr(order_id, 2) AS BIGINT) % 4 = 0 THEN substr(order_id, 2) || '.5'
                      ELSE substr(order_id, 2) END AS half, CAST(NULL AS VARCHAR) AS blank FROM recon)
"""
TYPE_OF = ("CASE WHEN COUNT({c}) = 0 THEN 'string' WHEN bool_and(regexp_matches({c}, '^[+-]?[0-9]+$')) THEN 'bigint' "
           "WHEN bool_and(regexp_matches({c}, '^[+-]?[0-9]+[.]?[0-9]*$')) THEN 'double' "
           "WHEN bool_and(lower({c}) IN ('true', 'false')) THEN 'boolean' ELSE 'string' END")


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _distribution(key_expr: str, name: str, table: str = "recon", extra: str = "") -> str:
    return (f"SELECT {key_expr} AS {name}, COUNT(*) AS order_count, "
            f"{pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS percent{extra} FROM {table} GROUP BY 1")


def _amount_long() -> str:
    g_cols = ", ".join(f"SUM({c}) AS s_{c}, COUNT({c}) AS n_{c}" for c in AMOUNTS)
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS amount_type, service_label, row_count, s_{c} AS s, n_{c} AS amount_count FROM g"
        for c in AMOUNTS)
    return f"g AS (SELECT {SERVICE} AS service_label, COUNT(*) AS row_count, {g_cols} FROM recon GROUP BY 1), " \
           f"long AS ({union})"


def _amount_overall() -> str:
    g_cols = ", ".join(f"SUM({c}) AS s_{c}, COUNT({c}) AS n_{c}" for c in AMOUNTS)
    union = " UNION ALL ".join(f"SELECT '{c}' AS amount_type, s_{c} AS s, n_{c} AS amount_count FROM g"
                               for c in AMOUNTS)
    return f"g AS (SELECT {g_cols} FROM recon), long AS ({union})"


def _column_profile() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"COUNT(*) AS row_count FROM recon" for c, t in RECON_COLUMNS)
    return (_w(RECON_CTE) + f"SELECT column_name, data_type, null_count, {pct('null_count', 'row_count')} "
            f"AS null_percent, row_count FROM ({parts})")


def _vehicle_amounts() -> str:
    agg = """a AS (SELECT
      SUM(CASE WHEN gsm_amount = 100 THEN gsm_amount END) AS lb, SUM(CASE WHEN gsm_amount = 200 THEN gsm_amount END) AS lc,
      SUM(CASE WHEN merchant_amount = 100 THEN merchant_amount END) AS rb,
      SUM(CASE WHEN merchant_amount = 200 THEN merchant_amount END) AS rc,
      COUNT(*) FILTER (WHERE gsm_amount = 100) AS nlb, COUNT(*) FILTER (WHERE gsm_amount = 200) AS nlc,
      COUNT(*) FILTER (WHERE merchant_amount = 100) AS nrb, COUNT(*) FILTER (WHERE merchant_amount = 200) AS nrc
      FROM driver),
    z AS (SELECT COALESCE(lb, 0) AS lb, COALESCE(lc, 0) AS lc, COALESCE(rb, 0) AS rb, COALESCE(rc, 0) AS rc,
                 nlb, nlc, nrb, nrc FROM a)"""
    rows = []
    for name, l_, r_, nl, nr in (("Bike", "lb", "rb", "nlb", "nrb"), ("Car", "lc", "rc", "nlc", "nrc"),
                                 ("Total", "lb + lc", "rb + rc", "nlb + nlc", "nrb + nrc")):
        rows.append(f"SELECT '{name}' AS vehicle, CAST({l_} AS DOUBLE) AS gsm_amount_total, "
                    f"CAST({r_} AS DOUBLE) AS merchant_amount_total, "
                    f"CAST(({l_}) + ({r_}) AS DOUBLE) AS total_amount, "
                    f"{nl} AS gsm_amount_count, {nr} AS merchant_amount_count FROM z")
    return _w(DRIVER_CTE, agg) + " UNION ALL ".join(rows)


def _recommendations(table: str = RECON_CTE) -> str:
    m = f"""m AS (
      SELECT COUNT(*) AS total_records,
             COUNT(*) FILTER (WHERE reconcile_status = 'match') AS match_count,
             COUNT(*) FILTER (WHERE contains(reconcile_status, 'not_found_in_m')) AS only_m_count,
             COUNT(*) FILTER (WHERE contains(reconcile_status, 'not_found_in_external')) AS only_external_count
      FROM recon),
    x AS (
      SELECT m.*, COALESCE({pct('match_count', 'total_records')}, CAST(0 AS DOUBLE)) AS match_rate,
             (SELECT COUNT(*) FROM mpr WHERE discrepancy_rate > 15.0) AS review_merchants,
             (SELECT COUNT(*) FROM (SELECT order_id FROM recon GROUP BY order_id HAVING COUNT(*) > 1))
               AS duplicate_ids,
             (SELECT COUNT(*) FROM high) AS high_discrepancy_rows
      FROM m),
    rules AS (
      SELECT 'low_match_rate' AS rule, match_rate AS value, CAST(80 AS DOUBLE) AS threshold,
             total_records > 0 AND match_rate < 80 AS fired FROM x
      UNION ALL SELECT 'insurer_only_share', CAST(only_m_count AS DOUBLE),
             CAST(total_records AS DOUBLE) * CAST(0.05 AS DOUBLE),
             total_records > 0 AND only_m_count > CAST(total_records AS DOUBLE) * CAST(0.05 AS DOUBLE) FROM x
      UNION ALL SELECT 'platform_only_share', CAST(only_external_count AS DOUBLE),
             CAST(total_records AS DOUBLE) * CAST(0.05 AS DOUBLE),
             total_records > 0 AND only_external_count > CAST(total_records AS DOUBLE) * CAST(0.05 AS DOUBLE)
             FROM x
      UNION ALL SELECT 'merchants_to_review', CAST(review_merchants AS DOUBLE), CAST(0 AS DOUBLE),
             review_merchants > 0 FROM x
      UNION ALL SELECT 'duplicate_order_ids', CAST(duplicate_ids AS DOUBLE), CAST(0 AS DOUBLE),
             duplicate_ids > 0 FROM x
      UNION ALL SELECT 'high_amount_discrepancy', CAST(high_discrepancy_rows AS DOUBLE), CAST(0 AS DOUBLE),
             high_discrepancy_rows > 0 FROM x)"""
    return (_w(table, MERCHANT_PATTERNS, HIGH, m)
            + "SELECT rule, value, threshold FROM rules WHERE fired "
              "UNION ALL SELECT 'stable', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) "
              "WHERE NOT EXISTS (SELECT 1 FROM rules WHERE fired)")


# Transactions in which the ids of every month's first day occur twice.
REPEATED_CTE = RECON_CTE.replace("recon AS (", "once AS (") + """,
recon AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE day(biz_date) = 1)
"""

SUSPICIOUS = """
            SELECT 'duplicate_orders' AS pattern, order_id AS item, CAST(COUNT(*) AS DOUBLE) AS metric
            FROM recon GROUP BY order_id HAVING COUNT(*) > 1
            UNION ALL SELECT 'high_amount_discrepancy', order_id, diff_percentage FROM high
            UNION ALL SELECT 'unusual_merchants', merchant, discrepancy_rate FROM mpr WHERE discrepancy_rate > 20.0"""

ONE_SIDED = "SELECT '{part}' AS part, order_id AS item, CAST(amount AS DOUBLE) AS value FROM recon WHERE contains(reconcile_status, '{word}')"

MISMATCH = """SELECT 'amount_mismatch' AS part, order_id AS item, CAST(gsm_amount - merchant_amount AS DOUBLE) AS value FROM recon
              WHERE gsm_amount IS NOT NULL AND merchant_amount IS NOT NULL AND gsm_amount <> merchant_amount"""

SECTIONS = [ONE_SIDED.format(part="insurer_only", word="not_found_in_m"),
            ONE_SIDED.format(part="platform_only", word="not_found_in_external"), MISMATCH]


def oracle_sql() -> dict[str, str]:
    r = _w(RECON_CTE)
    d = _w(DRIVER_CTE)
    q = {
        "reconcile_status_distribution": r + _distribution("reconcile_status", "reconcile_status",
                                                           extra=f", {CLASS} AS reconcile_class"),
        "reconcile_status_summary": r + f"""
            SELECT reconcile_status, {CLASS} AS reconcile_class, {DESCRIPTION} AS description,
                   COUNT(*) AS order_count,
                   COALESCE(CAST(SUM(amount) AS DOUBLE), CAST(0 AS DOUBLE)) AS total_amount,
                   COALESCE({mean("SUM(amount)", "COUNT(amount)")}, CAST(0 AS DOUBLE)) AS avg_amount,
                   {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS percent
            FROM recon GROUP BY reconcile_status""",
        "reconcile_status_by_day": r + f"""
            SELECT biz_date, reconcile_status, COUNT(*) AS order_count,
                   {pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY biz_date)')} AS percent,
                   {CLASS} AS reconcile_class
            FROM recon GROUP BY biz_date, reconcile_status""",
        "insurance_distribution": r + _distribution("insurance_status", "insurance_status"),
        "business_distribution": r + _distribution(BUSINESS, "business_label"),
        "business_rate": r + f"""
            SELECT COUNT(*) AS total_orders,
                   COUNT(*) FILTER (WHERE COALESCE(lower(CAST(is_business_order AS VARCHAR))
                                                   IN ('true', '1', 'yes'), false)) AS business_orders,
                   {pct("COUNT(*) FILTER (WHERE COALESCE(lower(CAST(is_business_order AS VARCHAR)) "
                        "IN ('true', '1', 'yes'), false))", "COUNT(*)")} AS business_rate
            FROM recon""",
        "service_type_distribution": r + _distribution(SERVICE, "service_label"),
        "service_type_summary": r + f"""
            SELECT COUNT(*) AS total_orders,
                   COUNT(*) FILTER (WHERE contains(lower({SERVICE}), 'ride')) AS ride_orders,
                   COUNT(*) FILTER (WHERE contains(lower({SERVICE}), 'express')) AS express_orders,
                   COUNT(*) FILTER (WHERE lower({SERVICE}) = 'unknown') AS unknown_orders
            FROM recon""",
        "amount_by_service": _w(RECON_CTE, _amount_long()) + f"""
            SELECT amount_type, service_label,
                   COALESCE(CAST(s AS DOUBLE), CAST(0 AS DOUBLE)) AS total_amount, amount_count,
                   COALESCE({mean('s', 'amount_count')}, CAST(0 AS DOUBLE)) AS avg_amount, row_count,
                   {pct('COALESCE(CAST(s AS DOUBLE), CAST(0 AS DOUBLE))',
                        'SUM(s) OVER (PARTITION BY amount_type)')} AS percent_of_total
            FROM long""",
        "amount_overall": _w(RECON_CTE, _amount_overall()) + f"""
            SELECT amount_type, COALESCE(CAST(s AS DOUBLE), CAST(0 AS DOUBLE)) AS total_amount, amount_count,
                   COALESCE({mean('s', 'amount_count')}, CAST(0 AS DOUBLE)) AS avg_amount
            FROM long""",
        "amount_comparison_matrix": r + f"""
            SELECT {SERVICE} AS service_label, """ + ", ".join(
            f"COALESCE(CAST(SUM({c}) AS DOUBLE), CAST(0 AS DOUBLE)) AS {c}_total" for c in AMOUNTS)
            + " FROM recon GROUP BY 1",
        "merchant_patterns": _w(RECON_CTE, MERCHANT_PATTERNS) + "SELECT * FROM mpr",
        "unusual_merchants": _w(RECON_CTE, MERCHANT_PATTERNS) + "SELECT * FROM mpr WHERE discrepancy_rate > 20.0",
        "hourly_patterns": _w(RECON_CTE, HOURLY)
            + f"SELECT hour, transaction_count, match_count, {pct('match_count', 'transaction_count')} "
              "AS match_rate FROM hourly",
        "peak_hour": _w(RECON_CTE, HOURLY)
            + f"SELECT hour, transaction_count, match_count, {pct('match_count', 'transaction_count')} "
              "AS match_rate FROM hourly WHERE hour IS NOT NULL ORDER BY transaction_count DESC, hour ASC LIMIT 1",
        "summary_stats": r + f"""
            SELECT COUNT(*) AS total_records,
                   COUNT(DISTINCT order_id) + MAX(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) AS unique_orders,
                   COUNT(DISTINCT merchant) + MAX(CASE WHEN merchant IS NULL THEN 1 ELSE 0 END) AS unique_merchants,
                   MIN(try_strptime(order_time, '%Y-%m-%d %H:%M:%S')) AS min_order_time,
                   MAX(try_strptime(order_time, '%Y-%m-%d %H:%M:%S')) AS max_order_time,
                   CAST(COUNT(*) - (COUNT(DISTINCT order_id) + MAX(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END))
                        AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(GREATEST(COUNT(*), 1) AS DOUBLE)
                     AS duplicate_percent
            FROM recon""",
        "summary_stats_by_day": r + f"""
            SELECT biz_date, COUNT(*) AS total_records,
                   COUNT(DISTINCT order_id) + MAX(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) AS unique_orders,
                   COUNT(DISTINCT merchant) + MAX(CASE WHEN merchant IS NULL THEN 1 ELSE 0 END) AS unique_merchants,
                   MIN(try_strptime(order_time, '%Y-%m-%d %H:%M:%S')) AS min_order_time,
                   MAX(try_strptime(order_time, '%Y-%m-%d %H:%M:%S')) AS max_order_time,
                   CAST(COUNT(*) - (COUNT(DISTINCT order_id) + MAX(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END))
                        AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(GREATEST(COUNT(*), 1) AS DOUBLE)
                     AS duplicate_percent
            FROM recon GROUP BY biz_date""",
        "one_sided_m": r + "SELECT order_id, merchant, amount, order_time, reconcile_status FROM recon "
                           "WHERE contains(reconcile_status, 'not_found_in_m')",
        "one_sided_external": r + "SELECT order_id, merchant, amount, order_time, reconcile_status FROM recon "
                                  "WHERE contains(reconcile_status, 'not_found_in_external')",
        "amount_mismatch": r + """
            SELECT order_id, merchant, CAST(gsm_amount AS DOUBLE) AS gsm_amount,
                   CAST(merchant_amount AS DOUBLE) AS merchant_amount,
                   CAST(gsm_amount - merchant_amount AS DOUBLE) AS amount_diff,
                   CAST(gsm_amount - merchant_amount AS DOUBLE) / NULLIF(CAST(merchant_amount AS DOUBLE), 0)
                     * CAST(100 AS DOUBLE) AS diff_percentage
            FROM recon
            WHERE gsm_amount IS NOT NULL AND merchant_amount IS NOT NULL AND gsm_amount <> merchant_amount""",
        "high_amount_discrepancy": _w(RECON_CTE, HIGH) + "SELECT * FROM high",
        "status_drilldown": _w(RECON_CTE, DRILL) + "SELECT * FROM drill",
        "drilldown_filtered": _w(RECON_CTE, DRILL) + """
            SELECT * FROM drill
            WHERE merchant IN (SELECT c_name FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))
              AND service_type IN ('express', 'Express')""",
        "drilldown_kpis": r + f"""
            SELECT reconcile_status, COUNT(*) AS row_count,
                   COUNT(DISTINCT order_id) + MAX(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) AS unique_orders,
                   COUNT(DISTINCT merchant) + MAX(CASE WHEN merchant IS NULL THEN 1 ELSE 0 END) AS unique_merchants,
                   COALESCE(CAST(SUM(amount) AS DOUBLE), CAST(0 AS DOUBLE)) AS total_amount,
                   COUNT(DISTINCT service_type) + MAX(CASE WHEN service_type IS NULL THEN 1 ELSE 0 END)
                     AS service_types
            FROM recon GROUP BY reconcile_status""",
        "order_lookup": _w(RECON_CTE, """
            lines AS (SELECT unnest(['  O' || CAST(l_orderkey AS VARCHAR) || ' ', 'X' || CAST(l_orderkey AS VARCHAR),
                                     '   ']) AS line
                      FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'),
            ids AS (SELECT DISTINCT trim(line) AS id FROM lines WHERE trim(line) <> '')""")
            + "SELECT * FROM recon WHERE order_id IN (SELECT id FROM ids)",
        "sample_head": r + "SELECT * FROM recon ORDER BY order_id LIMIT 100",
        "page_rows": r + "SELECT * FROM recon ORDER BY order_id LIMIT 100 OFFSET 200",
        "page_after_key": r + "SELECT * FROM recon WHERE order_id > 'O5000' ORDER BY order_id LIMIT 100",
        "page_count": r + "SELECT COUNT(*) AS row_count, CAST(CEIL(COUNT(*) / 500) AS BIGINT) AS page_count "
                          "FROM recon",
        "column_profile": _column_profile(),
        "suspicious_summary": _w(RECON_CTE, MERCHANT_PATTERNS, HIGH) + SUSPICIOUS,
        "suspicious_summary_repeats": _w(REPEATED_CTE, MERCHANT_PATTERNS, HIGH) + SUSPICIOUS,
        "recommendations": _recommendations(),
        "recommendations_repeats": _recommendations(REPEATED_CTE),
        "full_report": _w(RECON_CTE, MERCHANT_PATTERNS, HIGH, HOURLY, f"""
            suspicious AS ({SUSPICIOUS}),
            advice AS ({_recommendations()})""") + " UNION ALL ".join([
            "SELECT 'summary' AS part, reconcile_status AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM recon GROUP BY reconcile_status",
            *SECTIONS,
            "SELECT 'merchant_analysis', merchant, match_rate FROM mpr",
            "SELECT 'hourly', CAST(hour AS VARCHAR), CAST(transaction_count AS DOUBLE) FROM hourly",
            "SELECT * FROM (SELECT 'peak_hour', CAST(hour AS VARCHAR), CAST(transaction_count AS DOUBLE) FROM hourly "
            "WHERE hour IS NOT NULL ORDER BY transaction_count DESC, hour ASC LIMIT 1)",
            "SELECT 'suspicious', item, metric FROM suspicious",
            "SELECT 'recommendations', rule, value FROM advice"]),
        "csv_load": r + """
            SELECT order_id, merchant, amount, try_strptime(order_time, '%Y-%m-%d %H:%M:%S') AS order_time, reconcile_status,
                   insurance_status, is_business_order, service_type, gsm_amount, merchant_amount, biz_date,
                   'reconciled' AS dataset, 1 AS version FROM recon""",
        "inferred_types": r + "," + TYPED + " UNION ALL ".join(
            f"SELECT '{h}' AS column_name, {TYPE_OF.format(c=c)} AS data_type, COUNT(*) - COUNT({c}) AS null_count, "
            f"{pct(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} AS null_percent, COUNT(*) AS row_count FROM typed" for c, h in OTHER_COLUMNS),
        "silver_refresh": r + f"""
            , days AS (SELECT DISTINCT biz_date, day(biz_date) % 10 AS d FROM recon),
            touched AS (SELECT COUNT(*) AS days, COUNT(*) FILTER (d IN (3, 5)) AS rewritten, COUNT(*) FILTER (d = 7) AS removed FROM days),
            n AS (SELECT COUNT(*) AS all_rows, COUNT(*) FILTER (day(biz_date) % 10 IN (3, 5)) AS again FROM recon)
            SELECT 'row' AS part, order_id || CASE WHEN day(biz_date) % 10 = 5 THEN '@2' ELSE '@1' END AS item,
                   CAST(CASE day(biz_date) % 10 WHEN 3 THEN amount + 1 WHEN 5 THEN amount * 2 ELSE amount END AS DOUBLE) AS value
            FROM recon WHERE day(biz_date) % 10 <> 7
            UNION ALL SELECT 'metric', item, CAST(value AS DOUBLE) FROM (
                SELECT unnest(['1:files', '1:headerless_files', '1:rows', '1:ragged_rows', '1:days_added', '1:days_rewritten', '1:days_removed',
                               '2:files', '2:headerless_files', '2:rows', '2:ragged_rows', '2:days_added', '2:days_rewritten', '2:days_removed']) AS item,
                       unnest([days, 0, all_rows, 0, days, 0, 0, rewritten, 0, again, 0, 0, rewritten, removed]) AS value FROM touched, n)""",
        "ingest_accounting": r + """
            , u AS (SELECT CAST(substr(order_id, 2) AS BIGINT) AS k, day(biz_date) = 31 AS bare, biz_date FROM recon),
            n AS (SELECT COUNT(DISTINCT biz_date) AS files, COUNT(DISTINCT CASE WHEN bare THEN biz_date END) AS bare, COUNT(*) AS all_rows,
                         COUNT(*) FILTER (k % 11 = 0 OR k % 13 = 0) AS ragged, COUNT(*) FILTER (k % 7 = 0 AND NOT bare) AS amount,
                         COUNT(*) FILTER (k % 89 = 0 AND NOT bare) AS times FROM u)
            SELECT metric, "column", value FROM (
                SELECT unnest(['files', 'headerless_files', 'rows', 'ragged_rows', 'bad_cells', 'bad_cells', 'bad_cells', 'bad_cells', 'bad_cells', 'bad_cells',
                               'bad_cells', 'days_added', 'days_rewritten', 'days_removed']) AS metric,
                       unnest([NULL, NULL, NULL, NULL, 'amount', 'order_time', 'gsm_amount', 'merchant_amount', 'pvi_amount', 'reconciled_amount',
                               'created_time', NULL, NULL, NULL]) AS "column",
                       unnest([files, bare, all_rows, ragged, amount, times, 0, 0, 0, 0, 0, files, 0, 0]) AS value FROM n)""",
        "page_at": r + "SELECT * FROM recon ORDER BY order_id LIMIT 100 OFFSET 1200",
        "partials_report": _w(RECON_CTE, MERCHANT_PATTERNS, HOURLY) + " UNION ALL ".join([
            "SELECT 'summary' AS part, reconcile_status AS item, COALESCE(CAST(SUM(amount) AS DOUBLE), CAST(0 AS DOUBLE)) AS value FROM recon GROUP BY 2",
            *(f"SELECT '{part}', item, {pct('n', 'SUM(n) OVER ()')} FROM (SELECT {key} AS item, COUNT(*) AS n FROM recon GROUP BY 1)"
              for part, key in (("status", "reconcile_status"), ("insurance", "insurance_status"), ("business", BUSINESS), ("service", SERVICE))),
            *(f"SELECT 'amounts', '{c}/' || {SERVICE}, COALESCE(CAST(SUM({c}) AS DOUBLE), CAST(0 AS DOUBLE)) FROM recon GROUP BY 2" for c in AMOUNTS),
            *(f"SELECT 'overall', '{c}', COALESCE({mean(f'SUM({c})', f'COUNT({c})')}, CAST(0 AS DOUBLE)) FROM recon" for c in AMOUNTS),
            "SELECT 'merchant', merchant, match_rate FROM mpr",
            "SELECT 'hour', CAST(hour AS VARCHAR), CAST(transaction_count AS DOUBLE) FROM hourly"]),
        "reconcile_ledgers": """
            WITH items AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
                                  CASE WHEN l_orderkey % 3 = 0 THEN 'HOT' ELSE 'O' || l_orderkey END AS order_id FROM lineitem),
            insurer AS (SELECT order_id, amount, CAST(ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY amount) AS INTEGER) AS occurrence
                        FROM items WHERE k % 10 <> 7),
            platform AS (SELECT order_id, amount, CAST(ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY amount) AS INTEGER) AS occurrence
                         FROM items WHERE n % 3 <> 0 AND k % 50 <> 1)
            SELECT order_id, occurrence, a.amount AS insurer_amount, b.amount AS platform_amount, a.amount - b.amount AS amount_diff,
                   CASE WHEN a.amount IS NOT NULL AND b.amount IS NOT NULL THEN 'match' WHEN a.amount IS NOT NULL THEN 'not_found_in_m'
                        ELSE 'not_found_in_external' END AS reconcile_status
            FROM insurer a FULL JOIN platform b USING (order_id, occurrence)
            UNION ALL SELECT NULL, NULL, NULL, amount, NULL, 'not_found_in_external' FROM items WHERE n % 3 <> 0 AND k % 50 = 1""",
        "daily_trend": r + f"""
            , counted AS (SELECT biz_date, reconcile_status AS value, COUNT(*) AS n FROM recon GROUP BY 1, 2),
            calendar AS (SELECT CAST(unnest(generate_series(MIN(biz_date), MAX(biz_date), INTERVAL 1 DAY)) AS DATE) AS biz_date FROM counted),
            kinds AS (SELECT DISTINCT value FROM counted),
            dense AS (SELECT c.biz_date, k.value, COALESCE(n, 0) AS n, c.biz_date IN (SELECT biz_date FROM counted) AS has_day
                      FROM calendar c CROSS JOIN kinds k LEFT JOIN counted x ON x.biz_date = c.biz_date AND x.value IS NOT DISTINCT FROM k.value),
            lagged AS (SELECT *, LAG(n) OVER (PARTITION BY value ORDER BY biz_date) AS previous FROM dense)
            SELECT biz_date, value, n AS "rows", has_day, previous, n - previous AS change, {pct('n - previous', 'previous')} AS change_percent FROM lagged""",
        "csv_export": r + """
            SELECT order_id, reconcile_status, merchant, CAST(amount AS DOUBLE) AS amount,
                   COALESCE(reconcile_status, 'null') || '_details_' || strftime(biz_date, '%Y-%m') AS export
            FROM recon WHERE reconcile_status IS DISTINCT FROM 'match'""",
        "discrepancy_report": r + " UNION ALL ".join([
            *SECTIONS, "SELECT 'summary', reconcile_status, COALESCE(CAST(SUM(amount) AS DOUBLE), CAST(0 AS DOUBLE)) FROM recon GROUP BY 2"]),
        "vehicle_distribution": d + _distribution(VEHICLE, "vehicle", table="driver"),
        "vehicle_amount_comparison": _vehicle_amounts(),
        "merchant_status_distribution": d + _distribution("merchant_status", "merchant_status", table="driver",
                                                          extra=f", {SEVERITY} AS severity"),
        "failed_rollup": d + f"""
            SELECT COUNT(*) AS total_orders,
                   COUNT(*) FILTER (WHERE ({SEVERITY}) = 'bad') AS failed_orders,
                   COUNT(DISTINCT CASE WHEN ({SEVERITY}) = 'bad' THEN merchant_status END) AS failed_statuses,
                   {pct(f"COUNT(*) FILTER (WHERE ({SEVERITY}) = 'bad')", 'COUNT(*)')} AS failed_percent,
                   COUNT(*) - COUNT(*) FILTER (WHERE ({SEVERITY}) = 'bad') AS successful_orders
            FROM driver""",
        "duplicate_orders": d + "SELECT order_id, COUNT(*) AS count FROM driver GROUP BY order_id "
                                "HAVING COUNT(*) > 1",
        "failed_orders": d + f"""
            SELECT order_id, gsm_amount, merchant_amount, reconcile_status, merchant_status FROM driver
            WHERE ({SEVERITY}) = 'bad'""",
        "date_from_path": _w(CATALOG_CTE) + "SELECT path, folder_date, dataset, name_date, version, biz_date "
                                            "FROM parsed",
        "latest_version_per_key": _w(CATALOG_CTE) + "SELECT * FROM latest",
        "availability_calendar": _w(CATALOG_CTE) + """
            SELECT * FROM (
              SELECT biz_date,
                     MAX(CASE WHEN dataset = 'reconciled' THEN path END) AS reconciled_path,
                     MAX(CASE WHEN dataset = 'reconciled' THEN version END) AS reconciled_version,
                     MAX(CASE WHEN dataset = 'reconciled' THEN CAST(length AS DOUBLE) / 1048576.0 END)
                       AS reconciled_size_mb,
                     MAX(CASE WHEN dataset = 'reconciled' THEN CAST(length AS DOUBLE) / 1048576.0 > 40.0 END)
                       AS reconciled_large,
                     MAX(CASE WHEN dataset = 'reconciled' THEN version >= 2 END) AS reconciled_has_version_2,
                     MAX(CASE WHEN dataset = 'taixe' THEN path END) AS taixe_path,
                     MAX(CASE WHEN dataset = 'taixe' THEN version END) AS taixe_version,
                     MAX(CASE WHEN dataset = 'taixe' THEN CAST(length AS DOUBLE) / 1048576.0 END) AS taixe_size_mb,
                     MAX(CASE WHEN dataset = 'taixe' THEN CAST(length AS DOUBLE) / 1048576.0 > 40.0 END)
                       AS taixe_large,
                     MAX(CASE WHEN dataset = 'taixe' THEN version >= 2 END) AS taixe_has_version_2
              FROM latest GROUP BY biz_date)
            WHERE reconciled_path IS NOT NULL OR taixe_path IS NOT NULL""",
        "catalog_inventory": _w(CATALOG_CTE) + """
            SELECT COUNT(DISTINCT folder_date) AS day_count, COUNT(*) AS file_count,
                   CAST(SUM(length) AS DOUBLE) / 1048576.0 AS total_mb FROM parsed""",
        "catalog_inventory_by_month": _w(CATALOG_CTE) + """
            SELECT CAST(date_trunc('month', folder_date) AS DATE) AS month,
                   COUNT(DISTINCT folder_date) AS day_count, COUNT(*) AS file_count,
                   CAST(SUM(length) AS DOUBLE) / 1048576.0 AS total_mb FROM parsed GROUP BY 1""",
        "date_folders": _w(CATALOG_CTE) + "SELECT DISTINCT folder_date FROM parsed WHERE folder_date IS NOT NULL",
        "alias_resolve": d + """
            SELECT order_id, reconcile_status, CAST(gsm_amount AS DOUBLE) AS gsm_amount,
                   CAST(merchant_amount AS DOUBLE) AS merchant_amount, merchant_status FROM driver""",
    }
    # registered results present decimal money as double (see queries.money_as_double)
    money = {"one_sided_m": ["amount"], "one_sided_external": ["amount"],
             "status_drilldown": AMOUNTS, "drilldown_filtered": AMOUNTS, "order_lookup": AMOUNTS,
             "sample_head": AMOUNTS, "page_rows": AMOUNTS, "page_after_key": AMOUNTS, "csv_load": AMOUNTS, "page_at": AMOUNTS, "order_lookup_by_id": AMOUNTS, "reconcile_ledgers": ["insurer_amount", "platform_amount", "amount_diff"], "failed_orders": ["gsm_amount", "merchant_amount"]}
    q |= {f"{key}_by_id": q[key] for key in ("order_lookup", "duplicate_orders", "summary_stats")}
    for key, cols in money.items():
        q[key] = _money_double(q[key], cols)
    return q


def _money_double(sql: str, cols: list[str]) -> str:
    """Wrap a statement so the listed decimal columns come out as DOUBLE."""
    replace = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({replace}) FROM ({sql}) AS r"
