"""Parquet tables of a folder, and the disclosure views that are derived from them.

A view's SQL names its tables in braces: Spark fills in DataFrames, other engines the bare names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def plain(name: str) -> str:
    """A view's SQL over bare table names, in parentheses."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]) + ")"


VIEWS = {
    "fin_year": """
SELECT c.c_nationkey AS entity_id, year(o.o_orderdate) AS fy, concat('FY', substr(cast(year(o.o_orderdate) AS varchar(4)), 3, 2)) AS fiscal_year,
       sum(l.l_extendedprice * (1 - l.l_discount)) / 1e5 AS revenue, sum(l.l_extendedprice) * 0.7 / 1e5 AS cogs,
       sum(CASE WHEN o.o_orderstatus = 'O' THEN l.l_extendedprice ELSE 0 END) * 0.3 / 1e5 AS trade_receivables,
       sum(CASE WHEN l.l_returnflag = 'N' THEN l.l_extendedprice ELSE 0 END) * 0.2 / 1e5 AS trade_payables,
       sum(l.l_quantity * p.p_retailprice) * 0.15 / 1e5 AS inventory, sum(l.l_extendedprice * l.l_tax) / 1e5 AS tax_expense,
       sum(l.l_extendedprice * (1 - l.l_discount)) / 1e5 - sum(l.l_extendedprice) * 0.7 / 1e5 AS ebitda
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {part} p ON l.l_partkey = p.p_partkey
GROUP BY c.c_nationkey, year(o.o_orderdate)""",
    "debt_items": """
SELECT c.c_nationkey AS entity_id, c.c_mktsegment AS lender, o.o_orderpriority AS facility_type, o.o_totalprice / 1e5 AS amount,
       cast(8 + (o.o_orderkey % 9) * 0.5 AS double) AS interest_rate, o.o_orderstatus <> 'P' AS is_secured,
       o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_short_term, o.o_orderkey AS ordinal
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "litigation": """
SELECT event_id AS ordinal,
       CASE event_id % 5 WHEN 0 THEN 'Company' WHEN 1 THEN 'Promoter' WHEN 2 THEN 'Director' WHEN 3 THEN 'Subsidiary' ELSE 'Group Company' END AS entity_type,
       CASE user_id % 7 WHEN 0 THEN 'Civil' WHEN 1 THEN 'Criminal' WHEN 2 THEN 'Tax' WHEN 3 THEN 'Regulatory' WHEN 4 THEN 'Labor' WHEN 5 THEN 'Environmental' ELSE 'Other' END AS case_type,
       value AS amount_cr, 1 AS cnt, CASE WHEN event_type = 'error' THEN cast(ts AS date) END AS hearing_date
FROM {events}""",
    "contingent": """
SELECT event_id AS ordinal, value AS amount_cr,
       CASE event_type WHEN 'view' THEN 'tax dispute' WHEN 'click' THEN 'customs duty' WHEN 'signup' THEN 'bank guarantee' WHEN 'purchase' THEN 'civil suit' ELSE 'misc' END AS category,
       CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END AS probability
FROM {events}""",
    "capital_history": """
SELECT c.c_name AS investor, cast(o.o_orderdate AS date) AS entry_date, l.l_extendedprice / l.l_quantity AS price, cast(l.l_quantity AS bigint) AS shares
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 0""",
    "peers": """
SELECT s.s_name AS name, s.s_nationkey AS group_id, s.s_acctbal AS market_cap, CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE s.s_acctbal / (5 + s.s_suppkey % 20) END AS pat,
       s.s_acctbal / (1 + s.s_suppkey % 4) AS net_worth, s.s_acctbal / (3 + s.s_suppkey % 9) AS ebitda, cast(s.s_suppkey % 50 AS double) AS net_debt
FROM {supplier} s""",
    "rule_inputs": """
SELECT c_custkey AS entity_id, cast(40 + c_custkey % 40 AS double) AS promoter_post_issue_holding_pct, cast((c_custkey % 10) * 4 AS double) AS promoter_pledge_pct,
       cast(c_custkey % 100 AS double) AS ofs_pct_of_issue, cast(100 - c_custkey % 100 AS double) AS fresh_issue_pct_of_issue, cast(c_custkey % 30 AS double) AS rpt_revenue_pct,
       cast(c_custkey % 25 AS double) AS rpt_expense_pct, c_custkey % 17 = 0 AS auditor_resigned, c_custkey % 23 = 0 AS modified_audit_opinion, c_custkey % 3 AS caro_qualifications,
       cast(c_custkey % 60 AS double) AS total_litigation_cr, CASE WHEN c_acctbal > 0 THEN cast(500 AS double) ELSE cast(0 AS double) END AS post_issue_networth_cr,
       cast(c_custkey % 35 AS double) AS receivable_days_growth, cast(c_custkey % 12 AS double) AS revenue_cagr_3yr
FROM {customer}""",
    "shareholders": """
SELECT c_nationkey AS entity_id, c_name AS name,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Promoter' WHEN 'AUTOMOBILE' THEN 'PE/VC' WHEN 'MACHINERY' THEN 'ESOP Trust' WHEN 'HOUSEHOLD' THEN 'Anchor Investor' ELSE 'HNI' END AS category,
       1000 * (1 + c_custkey % 50) AS shares_pre_ipo, 100 * (c_custkey % 5) AS shares_selling_ofs,
       CASE c_custkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 180 WHEN 2 THEN 365 ELSE 1095 END AS lock_in_days, 800 * (1 + c_custkey % 50) AS shares_locked
FROM {customer}""",
    "chunks": """
SELECT conv_id AS document_id, turn, role AS chunk_type, text, length(text) AS char_count, cast(floor(length(text) / 4.0) AS bigint) AS token_count
FROM {conversations}""",
}
