"""The sample tables (orders, line items, customers...) seen as the library's logical tables.

Every frame is lazy and covers its whole source. `bench.py`, the registered queries and the
tests run on these; the oracle SQL states the same mapping on its own.

Money in the sample is DOUBLE with two decimals. It is taken to whole cents by `rint`, which is
exact here and stays in long arithmetic, and becomes DECIMAL once per order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from clientlens.model import Windows
from clientlens.sources.snapshots import load_tables, write_snapshots

AS_OF = date(2001, 11, 4)
FLOOR = date(1995, 1, 1)
WINDOWS = Windows(as_of=AS_OF, floor=FLOOR)

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _values(rows: dict[int, str], name: str) -> str:
    listed = ", ".join(f"({k}, '{v}')" for k, v in rows.items())
    return f"SELECT * FROM VALUES {listed} AS t(id, {name})"


# The small tables that the sample data does not hold.
DIVISIONS = {225: "I&M", 3: "ONE", 10: "DIV_10", 11: "DIV_11", 12: "DIV_12"}
DIMENSIONS = {
    **DIVISIONS,
    **{i: f"SUB_{i}" for i in range(100, 197)},
    **{i: f"CO_{i}" for i in range(200, 205)},
}
SECTOR_NAMES = {
    1: "industrial", 2: "marine", 3: "oilgas", 5: "excluded", 6: "offshore",
    10: "petrochemical", 12: "renewable",
}

# Each logical table as a query over source tables and other logical tables, named in braces.
MAPPING = {
    "client": """
        SELECT c_custkey + 1 AS debtor_no, c_name AS name, c_nationkey + 1 AS country,
               CASE c_mktsegment
                    WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2
                    WHEN 'BUILDING' THEN IF(c_custkey % 2 = 0, 3, 6)
                    WHEN 'AUTOMOBILE' THEN IF(c_custkey % 2 = 0, 10, 12)
                    WHEN 'HOUSEHOLD' THEN 5 END AS client_type,
               INT(c_custkey % 13) AS client_status,
               IF(c_acctbal < 0, 1, 0) AS inactive
        FROM {customer}""",
    "temp_client": """
        SELECT s_suppkey + 1 AS temp_clients_id, s_name AS client_name,
               IF(s_suppkey % 8 = 0, '', STRING(s_nationkey + 1)) AS country,
               element_at(array('', '1', '2', '3', '6', '10', '12'), INT(s_suppkey % 7 + 1))
                   AS temp_client_type
        FROM {supplier}""",
    "country": """
        SELECT n_nationkey + 1 AS id, n_name AS name, n_regionkey + 1 AS region_id,
               concat('#', n_nationkey) AS colour_code
        FROM {nation}""",
    "region": "SELECT r_regionkey + 1 AS id, r_name AS name FROM {sample_region}",
    "dimension": _values(DIMENSIONS, "name"),
    "client_type": _values(SECTOR_NAMES, "client_type"),
    "client_status": f"""
        SELECT id, client_status, id % 4 AS category
        FROM ({_values({i: f"STATUS_{i}" for i in range(13)}, "client_status")})""",
    "sample_orders": """
        SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS order_status,
               BIGINT(rint(o_totalprice * 100)) AS price_cents,
               DATE(o_orderdate) AS order_date,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 225 WHEN '2' THEN 3
                    WHEN '3' THEN 10 WHEN '4' THEN 11 WHEN '5' THEN 12 END AS division,
               INT(100 + o_orderkey % 97) AS subdivision, INT(200 + o_orderkey % 5) AS company,
               CAST(1 + (o_orderkey % 3) * 0.5BD AS DECIMAL(12,6)) AS rate
        FROM {orders}""",
    # enquiries without the two columns that are copied from their client
    "enquiry_facts": """
        SELECT order_key AS client_enquiry_id,
               IF(order_key % 10 = 0, 0, cust_key + 1) AS debtor_no,
               IF(order_key % 10 = 0, 0, 1) AS branch_code,
               IF(order_key % 10 = 0,
                  (order_key DIV 10) % (SELECT count(*) FROM {supplier}) + 1, 0) AS enquiry_temp_id,
               order_date AS enquiry_date, company, division, subdivision,
               CASE WHEN order_key % 11 = 0 THEN 3 WHEN order_key % 11 = 1 THEN 4
                    WHEN order_status = 'O' THEN 0 WHEN order_status = 'P' THEN 1
                    WHEN order_status = 'F' THEN 2 END AS enq_status,
               INT(order_key % 6 + 1) AS enq_type,
               CAST(CAST(price_cents AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(18,4)) AS aprox_amount, rate,
               IF(order_key % 9 = 0, order_key, 0) AS parent_id,
               IF(order_key % 20 = 1, 0, 1) AS is_active, concat('B', order_key) AS book_no
        FROM {sample_orders}""",
    "enquiry": """
        SELECT e.*, p.client_type, p.country AS location_country
        FROM {enquiry_facts} e
        LEFT JOIN (SELECT debtor_no AS ref, client_type, country FROM {client}
                   UNION ALL
                   SELECT -temp_clients_id, try_cast(nullif(temp_client_type, '') AS INT),
                          try_cast(nullif(country, '') AS INT) FROM {temp_client}) p
            ON IF(e.debtor_no > 0, e.debtor_no, -e.enquiry_temp_id) = p.ref""",
    "sample_lines": """
        SELECT l_orderkey AS order_key, l_partkey AS part_key, DATE(l_shipdate) AS ship_date,
               l_linestatus = 'F' AS paid,
               BIGINT(rint(l_extendedprice * 100)) * (100 - BIGINT(rint(l_discount * 100))) AS net,
               BIGINT(rint(l_extendedprice * 100)) * BIGINT(rint(l_tax * 100)) AS tax
        FROM {lineitem}""",
    "invoice": """
        SELECT b.order_key AS trans_no, 10 AS trans_type, o.cust_key + 1 AS debtor_no, b.tran_date,
               CAST(CAST(b.net AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4)) AS ov_amount,
               CAST(CAST(b.paid AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4)) AS alloc,
               CAST(CAST(b.tax AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4)) AS total_expense_aed,
               o.rate, o.company AS dimension_id, o.division AS dimension2_id,
               o.subdivision AS dimension3_id
        FROM (SELECT order_key, max(ship_date) AS tran_date, sum(net) AS net,
                     sum(IF(paid, net, 0)) AS paid, sum(tax) AS tax
              FROM {sample_lines} GROUP BY order_key) b
        JOIN {sample_orders} o ON b.order_key = o.order_key""",
    "payment_allocation": """
        SELECT order_key AS trans_no_to, 10 AS trans_type_to, 12 AS trans_type_from,
               ship_date AS date_alloc,
               CAST(CAST(net AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4)) AS alloc_amount
        FROM {sample_lines} WHERE paid""",
    "client_activity": """
        SELECT a.debtor_no, a.temp_client_id, a.division, a.sub_division, p.country_id,
               c.region_id, p.client_type, a.enquiry_date, a.job_date
        FROM (SELECT nullif(e.debtor_no, 0) AS debtor_no, e.enquiry_temp_id AS temp_client_id,
                     e.division, e.subdivision AS sub_division,
                     max(e.enquiry_date) AS enquiry_date,
                     max(IF(e.debtor_no > 0, j.job_date, NULL)) AS job_date
              FROM {enquiry_facts} e
              LEFT JOIN (SELECT order_key, max(ship_date) AS job_date FROM {sample_lines}
                         GROUP BY order_key) j ON e.client_enquiry_id = j.order_key
              GROUP BY ALL) a
        LEFT JOIN (SELECT debtor_no AS ref, country AS country_id, client_type FROM {client}
                   UNION ALL
                   SELECT -temp_clients_id, try_cast(nullif(country, '') AS INT),
                          try_cast(nullif(temp_client_type, '') AS INT) FROM {temp_client}) p
            ON coalesce(a.debtor_no, -a.temp_client_id) = p.ref
        LEFT JOIN {country} c ON p.country_id = c.id""",
    "activity_code_activity": """
        SELECT STRING(l.part_key) AS activity_code, o.cust_key + 1 AS debtor_no, o.division,
               o.subdivision AS sub_division, c.country AS country_id, c.client_type,
               o.order_date AS enquiry_date, l.ship_date AS job_date
        FROM {sample_lines} l JOIN {sample_orders} o ON l.order_key = o.order_key
        LEFT JOIN {client} c ON c.debtor_no = o.cust_key + 1""",
    "job_activity": """
        SELECT p_partkey AS id, p_name AS name, STRING(p_partkey) AS activity_code,
               element_at(array(225, 3, 10, 11, 12), INT(p_size % 5 + 1)) AS division_id,
               INT(100 + p_partkey % 97) AS sub_division_id,
               IF(p_partkey % 10 = 0, 0, 1) AS status
        FROM {part}""",
    "sales_order": """
        SELECT order_key AS order_no, 30 AS trans_type, INT(order_key % 4) AS job_type, cust_key + 1 AS debtor_no,
               concat('SO', order_key) AS reference, order_date AS ord_date, company AS dimension_id,
               division AS dimension2_id, subdivision AS dimension3_id, rate
        FROM {sample_orders}""",
    "sales_order_reference": """
        SELECT order_key AS sales_order_reference_id, 30 AS trans_type, order_key AS trans_no, 10 AS ref_trans_type,
               order_key AS ref_trans_no, concat('R', order_key) AS reference
        FROM {sample_orders}""",
    "credit_note": """
        SELECT l.order_key AS trans_no, 11 AS type, o.cust_key + 1 AS debtor_no, l.tran_date, l.order_key AS order_,
               CAST(CAST(l.cents AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(18,4)) AS ov_amount, o.rate,
               o.company AS dimension_id, o.division AS dimension2_id, o.subdivision AS dimension3_id, 0 AS is_write_off
        FROM (SELECT l_orderkey AS order_key, max(DATE(l_shipdate)) AS tran_date, sum(BIGINT(rint(l_extendedprice * 100))) AS cents
              FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_orderkey) l
        JOIN {sample_orders} o ON l.order_key = o.order_key""",
    "enquiry_job_activity": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS client_enquiry_id, STRING(l_partkey) AS activity_code
        FROM {lineitem}""",
    "credit_period": """
        SELECT o.cust_key + 1 AS debtor_no, INT(o.cust_key % 90) AS current_credit_period,
               date_sub(max(l.ship_date), INT(60 + o.cust_key % 700)) AS date_of_curr_pmnt
        FROM {sample_lines} l JOIN {sample_orders} o ON l.order_key = o.order_key
        WHERE l.paid GROUP BY o.cust_key""",
}


# What an extract writes; `enquiry_facts` is a narrower `enquiry`.
EXTRACTED = (
    "client", "temp_client", "country", "region", "dimension", "client_type", "client_status",
    "enquiry", "invoice", "payment_allocation", "client_activity", "activity_code_activity",
    "job_activity", "credit_period",
)


class SampleTables(dict):
    """Logical tables by name, built when first asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__()
        self.spark, self.directory = spark, directory

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __missing__(self, name: str) -> DataFrame:
        if name in MAPPING:
            text = MAPPING[name]
            inputs = {k: self[k] for k in (*SOURCES, *MAPPING, "sample_region") if f"{{{k}}}" in text}
            self[name] = self.spark.sql(text, **inputs)
        else:
            self[name] = self.source(name.removeprefix("sample_"))
        return self[name]


class SnapshotTables(SampleTables):
    """The same tables, read from the snapshots of an earlier `extract`."""

    def __init__(self, spark: SparkSession, directory: str, snapshots: str):
        super().__init__(spark, directory)
        self.update(load_tables(spark, snapshots, EXTRACTED, views=False, declared=False))
        self["enquiry_facts"] = self["enquiry"]


def extract(spark: SparkSession, directory: str, snapshots: str) -> None:
    """Write a snapshot of every logical table, fact tables by year."""
    tables = SampleTables(spark, directory)
    write_snapshots({name: tables[name] for name in EXTRACTED}, snapshots)
