"""Columns, predicates, ordering and paging."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.catalog.base import Shop, query, table
from opsframe.operators import paging
from opsframe.operators.search import TrigramIndex
from opsframe.plans import predicates as P
from opsframe.plans.ordered import number_rows
from opsframe.plans.model import field_tree, join_path_columns, select_lookups
from opsframe.plans.session import scratch

DAY = dt.date(1998, 8, 1)


@query("p1_select_columns", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def select_columns(spark, sf):
    return P.select(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice * 2 AS twice"])


@query("p2_where_integer", "SELECT * FROM customer WHERE c_custkey = 37")
def where_integer(spark, sf):
    return P.where(table(spark, sf, "customer"), 37, key="c_custkey")


@query("p2_where_map", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def where_map(spark, sf):
    return P.where(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query("p3_variable_binding", """SELECT o_orderkey, o_totalprice, '$' AS sign FROM orders
    WHERE o_totalprice > 150000 AND o_orderstatus IN ('F', 'P') AND o_custkey >= 10""")
def variable_binding(spark, sf):
    values = {"low": {"price": 150000}, "states": ["F", "P"], "keys": [10, 20]}
    return P.run_sql(spark, """SELECT o_orderkey, o_totalprice, '$$' AS sign FROM {orders}
        WHERE o_totalprice > ${low.price} AND o_orderstatus IN $states AND o_custkey >= $keys[0]""",
                     values, orders=table(spark, sf, "orders"))


@query("p4_any_of", "SELECT * FROM part WHERE p_size IN (1, 2, 3) OR (p_type = 'ECONOMY' OR p_brand = 'Brand#2')")
def any_of(spark, sf):
    either = P.equalities({"p_type": "ECONOMY", "p_brand": "Brand#2"}, connector="or")
    nothing = P.value_in(F.col("p_partkey"), [])
    return P.where(table(spark, sf, "part"), P.value_in(F.col("p_size"), [1, 2, 3]) | either | nothing)


@query("p5_raw_sql", """SELECT c.c_mktsegment AS segment, count(*) AS orders,
    CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'O' GROUP BY 1""")
def raw_sql(spark, sf):
    return P.run_sql(spark, """SELECT c.c_mktsegment AS segment, count(*) AS orders,
        CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        WHERE o.o_orderstatus = $state GROUP BY c.c_mktsegment""", {"state": "O"},
                     orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"))


@query("p6_typed_filters", """SELECT o_orderkey,
    o_orderstatus = 'F' AS equal, o_orderstatus <> 'F' AS not_equal, o_totalprice < 100000 AS less,
    o_totalprice <= 100000 AS less_equal, o_totalprice > 100000 AS greater, o_totalprice >= 100000 AS greater_equal,
    lower(substr(o_orderpriority, 1, 3)) = '1-u' AS starts, o_orderpriority ILIKE '%high%' AS has,
    year(o_orderdate) = 1997 AS in_year, month(o_orderdate) = 7 AS in_month,
    o_orderdate >= DATE '1998-08-01' - INTERVAL 400 DAY AS recent, o_orderdate < DATE '1998-08-01' - INTERVAL 400 DAY AS old
    FROM orders""")
def typed_filters(spark, sf):
    state, price, rank, day = (F.col(c) for c in ("o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"))
    made = {"equal": (state, P.EQUAL, "F"), "not_equal": (state, P.NOT_EQUAL, "F"), "less": (price, P.LESS, 100000),
            "less_equal": (price, P.LESS_EQUAL, 100000), "greater": (price, P.GREATER, 100000),
            "greater_equal": (price, P.GREATER_EQUAL, 100000), "starts": (rank, P.STARTS, "1-U"),
            "has": (rank, P.CONTAINS, "HIGH"), "in_year": (day, P.YEAR, "1997"), "in_month": (day, P.MONTH, "7"),
            "recent": (day, P.WITHIN, 400), "old": (day, P.OLDER, 400)}
    return table(spark, sf, "orders").select("o_orderkey", *[P.typed_filter(*a, today=DAY).alias(n) for n, a in made.items()])


@query("p7_filter_catalogue", """WITH o(kind, position, operation) AS (VALUES
    ('string',0,'equal to'),('string',1,'not equal to'),('string',2,'starts with'),('string',3,'contains'),
    ('numeric',0,'equal to'),('numeric',1,'not equal to'),('numeric',2,'less than'),('numeric',3,'greater than'),
    ('numeric',4,'less than or equal to'),('numeric',5,'greater than or equal to'),
    ('datetime_date',0,'equal to'),('datetime_date',1,'not equal to'),('datetime_date',2,'less than'),
    ('datetime_date',3,'greater than'),('datetime_date',4,'less than or equal to'),('datetime_date',5,'greater than or equal to'),
    ('datetime_date',6,'within X days ago'),('datetime_date',7,'older than X days ago'),
    ('datetime_date',8,'year equals'),('datetime_date',9,'month equals'),
    ('foreign_key',0,'equal to'),('foreign_key',1,'not equal to')),
    c(path, kind) AS (
      SELECT p.prefix || column_name, CASE WHEN column_name IN ('o_custkey','c_nationkey','n_regionkey') THEN 'foreign_key'
        WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime_date' ELSE 'numeric' END
      FROM (SELECT 'orders' AS t, column_name, column_type AS data_type FROM (DESCRIBE orders)
            UNION ALL SELECT 'customer', column_name, column_type FROM (DESCRIBE customer)
            UNION ALL SELECT 'nation', column_name, column_type FROM (DESCRIBE nation)
            UNION ALL SELECT 'region', column_name, column_type FROM (DESCRIBE region)) d
      JOIN (VALUES ('orders',''),('customer','customer__'),('nation','customer__nation__'),
                   ('region','customer__nation__region__')) p(t, prefix) ON p.t = d.t)
    SELECT path, c.kind, CAST(position AS INTEGER) AS position, operation, (SELECT count(*) FROM orders) AS filled
    FROM c JOIN o ON o.kind = c.kind""")
def catalogue_rows(spark, sf):
    return P.filter_catalogue(Shop(spark, sf).orders)


@query("p8_filter_request", """SELECT o.* FROM orders o JOIN customer c ON o_custkey = c_custkey
    JOIN nation n ON c_nationkey = n_nationkey
    WHERE (o_totalprice < 50000 OR o_totalprice >= 400000) AND (c_mktsegment = 'BUILDING' OR lower(substr(c_mktsegment,1,2)) = 'ma')
    AND n_name ILIKE '%1%'""")
def filter_request(spark, sf):
    return P.filter_request(Shop(spark, sf).orders, {
        "o_totalprice": [(2, 50000), (5, 400000)], "customer__c_mktsegment": [(0, "BUILDING"), (2, "MA")],
        "customer__nation__n_name": [(3, "1")]})


@query("p9_lookup_filters", """SELECT o.* FROM orders o JOIN customer c ON o_custkey = c_custkey
    JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey
    WHERE o_totalprice > 100000 AND o_orderstatus IN ('F','O') AND NOT (o_orderpriority LIKE '1%')
    AND (r_name = 'ASIA' OR r_name = 'EUROPE') AND c_name SIMILAR TO '.*[02468]'""")
def lookup_filters(spark, sf):
    return P.lookup_filter(Shop(spark, sf).orders, {
        "o_totalprice__gt": "100000", "o_orderstatus__in": "F, O", "-o_orderpriority__like": ["1%"],
        "customer__nation__region__r_name": ["ASIA", "EUROPE"], "customer__c_name__regexp": "[02468]$", "no_such_column": "1"})


@query("p10_field_tree", """SELECT o_orderkey, o_totalprice, c_custkey AS customer__c_custkey, c_name AS customer__c_name,
    c_nationkey AS customer__c_nationkey, c_mktsegment AS customer__c_mktsegment, n_nationkey AS customer__nation__n_nationkey,
    n_name AS customer__nation__n_name, n_regionkey AS customer__nation__n_regionkey,
    r_regionkey AS customer__nation__region__r_regionkey, r_name AS customer__nation__region__r_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def exposed_columns(spark, sf):
    orders = Shop(spark, sf).orders
    tree = field_tree(orders, fields=["o_orderkey", "o_totalprice", "customer"], exclude=["customer__c_acctbal"])
    return select_lookups(orders, tree.paths())


@query("p11_first_row", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def one_row(spark, sf):
    return P.first_row(table(spark, sf, "customer"), [F.col("c_acctbal").desc(), F.col("c_custkey")])


@query("p11_one_value", "SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def one_value(spark, sf):
    rows = P.where(table(spark, sf, "customer"), {"c_mktsegment": "BUILDING"})
    return P.first_value(rows, "c_name", [F.col("c_acctbal").desc(), F.col("c_custkey")])


ASSETS = "SELECT c_name, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def assets(spark, sf):
    shop = Shop(spark, sf)
    joined = join_path_columns(shop.customer, ["nation__n_name", "nation__region__r_name"])
    return joined.select("c_name", "c_mktsegment", F.col("nation__n_name").alias("n_name"),
                         F.col("nation__region__r_name").alias("r_name"))


@query("p12_search_partial", f"""SELECT * FROM ({ASSETS}) WHERE c_name ILIKE '%mach%' OR c_mktsegment ILIKE '%mach%'
    OR n_name ILIKE '%mach%' OR r_name ILIKE '%mach%'""")
def search_partial(spark, sf):
    return P.search(assets(spark, sf), "Mach", "c_name", ["c_mktsegment", "n_name", "r_name"])


@query("p12_search_exact", f"SELECT * FROM ({ASSETS}) WHERE c_name = 'Customer#000000012'")
def search_exact(spark, sf):
    return P.search(assets(spark, sf), "CUSTOMER#000000012", "c_name", ["c_mktsegment", "n_name", "r_name"])


@query("p12_search_index", f"""SELECT 'Mach' AS text, * FROM ({ASSETS}) WHERE c_name ILIKE '%mach%' OR c_mktsegment ILIKE '%mach%' OR n_name ILIKE '%mach%' OR r_name ILIKE '%mach%'
    UNION ALL SELECT 'customer#000000012', * FROM ({ASSETS}) WHERE c_name = 'Customer#000000012'
    UNION ALL SELECT '0012', * FROM ({ASSETS}) WHERE c_name ILIKE '%0012%'""")
def search_index(spark, sf):
    """Three searches of one index."""
    index = TrigramIndex.build(assets(spark, sf), scratch(spark, "trigrams"), "c_name", ["c_mktsegment", "n_name", "r_name"])
    found = [index.search(t).select(F.lit(t).alias("text"), "*") for t in ("Mach", "customer#000000012", "0012")]
    return reduce(DataFrame.unionByName, found)


@query("p13_host_patterns", """SELECT c_custkey, c_name FROM customer
    WHERE c_name = 'Customer#000000005' OR c_name LIKE '%7' OR c_name LIKE 'Customer#00000_1_9' OR c_name LIKE '%33'""")
def host_patterns(spark, sf):
    pattern = "Customer#000000005:*7:Customer#00000?1?9:~33$"
    return table(spark, sf, "customer").filter(P.host_pattern(F.col("c_name"), pattern)).select("c_custkey", "c_name")


@query("p14_row_ownership", """SELECT o_orderkey, o_custkey,
    CASE WHEN o_custkey = 7 AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def row_ownership(spark, sf):
    from opsframe.sources.writes import update_where
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return update_where(orders, P.owned("o_custkey", 7) & (F.col("o_orderstatus") == "O"), {"o_orderstatus": F.lit("X")})


# --- ordering and paging -------------------------------------------------------------------------

@query("l1_order", """SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_custkey) - 1 AS place FROM customer""")
def order_rows(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    by = P.order_columns(customer, ["c_nationkey", "-c_acctbal", "not_a_column", "c_custkey"])
    return number_rows(customer, by, "place").orderBy("place")


@query("l2_limit_offset", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 100")
def limit_offset(spark, sf):
    return P.select(table(spark, sf, "orders"), "*", order=["o_totalprice", "o_orderkey"], limit=25, offset=100)


@query("l3_page", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def one_page(spark, sf):
    return paging.page(table(spark, sf, "orders"), "-o_orderdate", "o_orderkey", "3", "500")


@query("l3_deep_page", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 1000")
def deep_page(spark, sf):
    order = ["-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return paging.deep_slice(table(spark, sf, "lineitem"), order, 1000, 50)


@query("l3_page_info", """SELECT 'orders' AS model, CAST(3 AS BIGINT) AS page, CAST(2 AS BIGINT) AS previous,
    CASE WHEN 3 < ceil(count(*) / 20.0) THEN CAST(4 AS BIGINT) END AS next, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages,
    count(*) AS rows FROM orders""")
def page_facts(spark, sf):
    return paging.page_info(table(spark, sf, "orders"), "orders", "3", "not a number")


@query("l4_top", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_rows(spark, sf):
    return paging.top(table(spark, sf, "customer"), "-c_acctbal", 20, "c_custkey")


@query("l5_nth_row", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 9")
def nth(spark, sf):
    return paging.nth_row(table(spark, sf, "orders"), ["-o_totalprice", "o_orderkey"], 9)


@query("l5_nth_item", """SELECT p_partkey, coalesce(string_split(p_name, ' ')[2], 'none') AS second,
    coalesce(string_split(p_name, ' ')[6], 'none') AS sixth FROM part""")
def nth_item(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", paging.item(words, 1, "none").alias("second"),
                                           paging.item(words, 5, "none").alias("sixth"))
