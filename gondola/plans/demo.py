"""Price tables projected from the given order tables: seven days, seven companies with two banners each, with a chain that
misses the last day, a company with implausible prices, a pharmacy banner and spelling variants of localities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view: what it needs, and its SQL, which both engines run.
VIEWS = {
    "demo_prices": """
SELECT CAST(l_suppkey % 7 AS VARCHAR(20)) AS company_id, CAST(l_suppkey % 14 AS VARCHAR(20)) AS banner_id,
       CAST(l_suppkey AS VARCHAR(20)) AS store_id, CAST(l_partkey AS VARCHAR(20)) AS product_id,
       DATE '2024-01-01' + CAST(year(l_shipdate) - 1995 AS INTEGER) AS data_date,
       p_retailprice * (CAST(1 AS DOUBLE) + l_tax)
         * CASE WHEN l_partkey % 50 = 0 AND l_suppkey % 7 = 1 THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS price,
       CAST(1 + p_size AS DOUBLE) AS qty,
       CASE l_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'cc' ELSE 'unidad' END AS unit,
       l_discount, l_linenumber, p_name, p_brand
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE NOT (l_suppkey % 14 = 13 AND year(l_shipdate) = 2001)""",
    "demo_categories": """
SELECT CAST(p_partkey AS VARCHAR(20)) AS product_id, p_name AS description, p_brand AS brand,
       CASE WHEN p_partkey % 40 = 0 THEN 'Otros' ELSE p_type END AS category,
       CASE WHEN p_type = 'PROMO' THEN 'Higiene' ELSE 'Almacen' END AS section
FROM part""",
    "demo_chains": """
SELECT DISTINCT CAST(s_suppkey % 7 AS VARCHAR(20)) AS company_id, CAST(s_suppkey % 14 AS VARCHAR(20)) AS banner_id,
       concat('chain_', CAST(s_suppkey % 14 AS VARCHAR(20))) AS chain,
       CASE WHEN s_suppkey % 14 = 6 THEN 'farmacia' ELSE 'supermercado' END AS format,
       s_suppkey % 14 <> 3 AS reports_daily
FROM supplier""",
    "demo_stores": """
SELECT CAST(s_suppkey % 7 AS VARCHAR(20)) AS company_id, CAST(s_suppkey % 14 AS VARCHAR(20)) AS banner_id,
       CAST(s_suppkey AS VARCHAR(20)) AS store_id, s_name AS name, 'S' AS type, 'Calle' AS street,
       CAST(s_suppkey AS VARCHAR(20)) AS number, CAST(NULL AS VARCHAR(20)) AS neighbourhood,
       concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Localidad ' ELSE 'LOCALIDAD ' END, CAST(s_suppkey % 5 AS VARCHAR(20))) AS locality,
       concat('AR-', substr('ABCDE', CAST(s_nationkey % 5 + 1 AS INTEGER), 1)) AS province, '1000' AS postcode,
       CAST(-34.6 AS DOUBLE) + (s_suppkey % 20) * CAST(0.01 AS DOUBLE) AS lat,
       CAST(-58.4 AS DOUBLE) + (s_suppkey % 13) * CAST(0.01 AS DOUBLE) AS lon
FROM supplier""",
    "demo_promos": """
SELECT company_id, banner_id, store_id, product_id, data_date, p_name AS description, p_brand AS brand, price AS list_price,
       price * (CAST(1 AS DOUBLE) - 5 * l_discount) AS promo1_price,
       CASE l_linenumber % 4
            WHEN 0 THEN concat(CAST(CAST(round(500 * l_discount) AS INTEGER) AS VARCHAR(20)), '% de descuento. Vigencia desde el 01/01/2024 al 18/01/2024')
            WHEN 1 THEN 'Promo A valida hasta 2024-01-20'
            WHEN 2 THEN '75% de descuento. LLEVANDO 2'
            ELSE CAST(NULL AS VARCHAR(20)) END AS promo1_legend,
       CAST(NULL AS DOUBLE) AS promo2_price, CAST(NULL AS VARCHAR(20)) AS promo2_legend
FROM demo_prices""",
}
LAST_DAY = "2024-01-07"
TABLES = ("lineitem", "part", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in sf_dir; frames are passed by name, nothing is registered."""
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    if "FROM demo_prices" in sql:
        frames["demo_prices"] = view(spark, sf_dir, "demo_prices")
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql.replace("VARCHAR(20)", "STRING"), **frames)
