"""SQL twins of the price queries for DuckDB: named steps, put together as one WITH."""

from __future__ import annotations

import re

from gondola.plans.demo import LAST_DAY, VIEWS

#: Sizes that can be right, for categories that aren't sold by the piece.
_SIZE = "((unit IN ('g','cc') AND qty BETWEEN 5 AND 10000) OR (unit = 'unidad' AND qty BETWEEN 1 AND 60))"


def _limits(source: str, keys: str, column: str = "unit_price") -> str:
    """Discrete 10 % and 90 % limits per group, from values with counts."""
    return f"""
SELECT {keys}, min(v) FILTER (upto >= ceil(CAST(0.1 AS DOUBLE) * total)) AS low, min(v) FILTER (upto >= ceil(CAST(0.9 AS DOUBLE) * total)) AS high
FROM (SELECT {keys}, {column} AS v, sum(count(*)) OVER (PARTITION BY {keys} ORDER BY {column}) AS upto, sum(count(*)) OVER (PARTITION BY {keys}) AS total
      FROM {source} GROUP BY {keys}, {column}) GROUP BY {keys}"""


STEPS: dict[str, str] = {
    **VIEWS,
    "product_chain": """
SELECT data_date, product_id, chain, min(company_id) AS company_id, min(format) AS format, quantile_disc(price, 0.5) AS median_price,
       min(price) AS min_price, max(price) AS max_price, count(DISTINCT store_id) AS stores, quantile_disc(qty, 0.5) AS qty, min(unit) AS unit
FROM demo_prices JOIN demo_chains USING (company_id, banner_id) GROUP BY data_date, product_id, chain""",
    "tiers": f"""
SELECT *, CASE ntile(3) OVER (PARTITION BY category, unit ORDER BY unit_price, product_id) WHEN 1 THEN 'economico' WHEN 2 THEN 'medio' ELSE 'premium' END AS tier
FROM (SELECT p.product_id, min(category) AS category, min(section) AS section, quantile_disc(price, 0.5) AS median_price, quantile_disc(price / qty, 0.5) AS unit_price, unit
      FROM demo_prices p JOIN demo_categories c ON p.product_id = c.product_id WHERE category <> 'Otros' AND {_SIZE} GROUP BY p.product_id, unit)""",
    "unit_prices": f"""
SELECT p.product_id, p.data_date, p.unit, c.category, h.chain, t.tier, p.price / p.qty AS unit_price
FROM demo_prices p JOIN demo_categories c ON p.product_id = c.product_id JOIN tiers t ON t.product_id = p.product_id AND t.unit = p.unit
JOIN demo_chains h ON h.company_id = p.company_id AND h.banner_id = p.banner_id
WHERE c.category <> 'Otros' AND (h.format = 'supermercado' OR c.section IN ('Higiene', 'Bebes')) AND {_SIZE.replace('unit ', 'p.unit ').replace('qty', 'p.qty')}""",
    "economy": "SELECT * FROM unit_prices WHERE tier = 'economico'",
    "economy_limits": _limits("economy", "category, data_date"),
    "levels": """
SELECT category, chain, unit, data_date, quantile_disc(unit_price, 0.5) AS median_unit_price, count(*) AS samples
FROM economy JOIN economy_limits USING (category, data_date) WHERE unit_price BETWEEN low AND high GROUP BY ALL HAVING count(*) >= 20""",
    "levels_of_few": """
SELECT category, chain, unit, data_date, quantile_disc(unit_price, 0.5) AS median_unit_price, count(*) AS samples
FROM economy JOIN economy_limits USING (category, data_date) WHERE unit_price BETWEEN low AND high GROUP BY ALL""",
    "pairs": "SELECT data_date, lag(data_date) OVER (ORDER BY data_date) AS base_date FROM (SELECT DISTINCT data_date FROM demo_prices)",
    "day_prices": "SELECT category, chain, unit, product_id, data_date, quantile_disc(unit_price, 0.5) AS up FROM unit_prices GROUP BY ALL",
    "factors": """
SELECT category, chain, unit, data_date, base_date, exp(avg(ln(rel))) AS factor, count(*) AS paired_products
FROM (SELECT t.category, t.chain, t.unit, t.data_date, base_date, t.up / b.up AS rel FROM day_prices t JOIN pairs USING (data_date)
      JOIN day_prices b ON b.data_date = base_date AND b.category = t.category AND b.chain = t.chain AND b.unit = t.unit AND b.product_id = t.product_id WHERE b.up > 0)
WHERE rel BETWEEN CAST(0.5 AS DOUBLE) AND CAST(2 AS DOUBLE) GROUP BY ALL HAVING count(*) >= 10""",
    "mart": "SELECT * FROM levels FULL JOIN factors USING (category, chain, unit, data_date)",
    "competing": "SELECT i.*, category, section FROM product_chain i LEFT JOIN demo_categories c USING (product_id) WHERE coalesce(format, 'supermercado') = 'supermercado' OR section IN ('Higiene', 'Bebes')",
    "comparable": """
SELECT *, min(median_price) OVER (PARTITION BY data_date, product_id) AS low FROM competing
WHERE (data_date, product_id) IN (SELECT (data_date, product_id) FROM competing GROUP BY data_date, product_id HAVING count(DISTINCT chain) >= 2)""",
    "wins": """
SELECT category, section, chain, won, offered, total, round(won / total * 100, 1) AS pct_wins, round(won / offered * 100, 1) AS pct_wins_when_offered, data_date
FROM (SELECT data_date, category, section, chain, count(DISTINCT product_id) FILTER (median_price = low) AS won, count(DISTINCT product_id) AS offered
      FROM comparable WHERE category <> 'Otros' GROUP BY ALL)
JOIN (SELECT data_date, category, count(DISTINCT product_id) AS total FROM comparable WHERE category <> 'Otros' GROUP BY ALL) USING (data_date, category)
WHERE won > 0 AND offered >= 20""",
    "carried": f"""
SELECT DATE '{LAST_DAY}' AS data_date, r.data_date AS price_date, r.* EXCLUDE (data_date) FROM product_chain r
JOIN (SELECT chain, max(data_date) AS d FROM product_chain WHERE data_date BETWEEN DATE '{LAST_DAY}' - 2 AND DATE '{LAST_DAY}' GROUP BY chain) f ON f.chain = r.chain AND f.d = r.data_date""",
    "reference": """
SELECT product_id, CASE WHEN count(*) >= 3 THEN quantile_cont(m, 0.5) END AS reference
FROM (SELECT product_id, company_id, quantile_cont(median_price, 0.5) AS m FROM carried GROUP BY ALL) GROUP BY product_id""",
    "ranged": "SELECT c.*, reference, reference IS NULL OR median_price BETWEEN reference * CAST(0.5 AS DOUBLE) AND reference * CAST(2 AS DOUBLE) AS in_range FROM carried c JOIN reference USING (product_id)",
    "assessed": """
SELECT a.*, in_range OR EXISTS (SELECT 1 FROM ranged o WHERE o.product_id = a.product_id AND o.chain <> a.chain
  AND abs(o.median_price - a.median_price) <= a.median_price * CAST(0.1 AS DOUBLE) AND (o.company_id <> a.company_id OR o.in_range)) AS credible FROM ranged a""",
    "sizes": """
SELECT product_id, first(qty ORDER BY (unit = 'unidad'), n DESC, s DESC, qty, unit) AS qty, first(unit ORDER BY (unit = 'unidad'), n DESC, s DESC, qty, unit) AS unit
FROM (SELECT product_id, qty, unit, count(DISTINCT company_id) AS n, sum(stores) AS s FROM carried WHERE qty IS NOT NULL AND unit IS NOT NULL GROUP BY ALL) GROUP BY product_id""",
    "ends": """
SELECT product_id, count(*) AS chains, min(median_price) FILTER (credible) AS lowest, max(median_price) FILTER (credible) AS highest,
       count(DISTINCT company_id) FILTER (credible) AS companies, count(*) FILTER (NOT credible) AS chains_discarded FROM assessed GROUP BY product_id HAVING count(*) FILTER (credible) >= 2""",
    "same_product": """
SELECT e.data_date, e.price_date, e.product_id, d.description, d.brand, lower(concat(d.description, ' ', coalesce(d.brand, ''))) AS search_text, d.category, d.section, e.chain,
       coalesce(e.format, 'supermercado') AS format, e.median_price, e.min_price, e.max_price, e.stores, z.qty, z.unit, e.credible, e.in_range, e.reference, n.chains, n.companies,
       n.chains_discarded, n.lowest, n.highest, round((n.highest - n.lowest) / n.lowest * 100, 1) AS gap_pct, e.credible AND e.median_price = n.lowest AS is_cheapest
FROM assessed e JOIN ends n USING (product_id) JOIN demo_categories d USING (product_id) LEFT JOIN sizes z USING (product_id)""",
    "placed": f"""
SELECT c.category, t.tier, p.unit, s.locality, s.province, p.data_date, p.company_id, p.store_id, s.banner_id AS store_banner, p.banner_id, s.name, s.street, s.number, s.lat, s.lon, p.price / p.qty AS unit_price
FROM demo_prices p JOIN demo_categories c ON c.product_id = p.product_id JOIN tiers t ON t.product_id = p.product_id AND t.unit = p.unit
JOIN demo_stores s ON s.company_id = p.company_id AND s.store_id = p.store_id
WHERE p.data_date = DATE '{LAST_DAY}' AND {_SIZE.replace('unit ', 'p.unit ').replace('qty', 'p.qty')}""",
    "at_locality": "SELECT p.* FROM placed p JOIN demo_chains h ON h.company_id = p.company_id AND h.banner_id = p.banner_id WHERE h.format = 'supermercado'",
    "locality_limits": _limits("at_locality", "category, tier, unit, locality"),
    "locality_prices": """
SELECT category, tier, unit, locality, province, data_date, quantile_disc(unit_price, 0.5) AS median_unit_price, count(*) AS samples
FROM at_locality JOIN locality_limits USING (category, tier, unit, locality) WHERE unit_price BETWEEN low AND high GROUP BY ALL HAVING count(*) >= 10""",
    "at_store": "SELECT p.*, h.chain FROM placed p JOIN demo_chains h ON h.company_id = p.company_id AND h.banner_id = p.store_banner WHERE h.format = 'supermercado'",
    "store_limits": _limits("at_store", "category, tier, unit, locality, province"),
    "store_prices": """
SELECT category, tier, unit, locality, province, company_id, store_id, chain, name, street, number, lat, lon, data_date, quantile_disc(unit_price, 0.5) AS median_unit_price, count(*) AS samples
FROM at_store JOIN store_limits USING (category, tier, unit, locality, province) WHERE unit_price BETWEEN low AND high GROUP BY ALL HAVING count(*) >= 3""",
    "day_promos": f"SELECT * FROM demo_promos WHERE data_date = DATE '{LAST_DAY}' AND list_price > 1",
    "two_cheapest": """
SELECT product_id, max(company_id) FILTER (n = 1) AS first_company, max(low) FILTER (n = 1) AS low1, max(low) FILTER (n = 2) AS low2
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY low, company_id) AS n FROM (SELECT product_id, company_id, min(list_price) AS low FROM day_promos GROUP BY ALL)) GROUP BY product_id""",
    "promo_rows": r"""
SELECT p.* EXCLUDE (promo1_price, promo1_legend, promo2_price, promo2_legend), promo1_price AS promo_price, promo1_legend AS legend, 'promo1' AS promo_kind,
       round((list_price - promo1_price) / list_price * 100, 1) AS discount_pct,
       TRY_CAST(replace(nullif(regexp_extract(promo1_legend, '(\d{1,2}(?:[.,]\d+)?)\s*%', 1), ''), ',', '.') AS DOUBLE) AS declared_pct,
       regexp_matches(lower(coalesce(promo1_legend, '')), 'llevando|\b\d\s*x\s*\d\b|\b\d\s*x\s*\$|\b\d\s*(?:da|do)\b[^%]*\bal\b') AS multi_buy,
       CASE WHEN first_company <> company_id THEN low1 ELSE low2 END AS market_reference
FROM day_promos p LEFT JOIN two_cheapest USING (product_id) WHERE promo1_price > 0 AND promo1_price < list_price""",
    "evidence": """
SELECT *, CASE WHEN abs(declared_pct - discount_pct) <= 3 THEN 'leyenda' WHEN market_reference IS NOT NULL THEN 'mercado' ELSE 'sin_verificar' END AS evidence, promo_price / market_reference AS market_ratio FROM promo_rows""",
    "valid": """
SELECT * FROM evidence WHERE discount_pct >= 10 AND CASE evidence WHEN 'leyenda' THEN true WHEN 'mercado' THEN market_ratio >= CAST(0.519 AS DOUBLE) AND discount_pct <= 70 ELSE discount_pct <= 50 END""",
    "promos_now": """
SELECT product_id, v.description, v.brand, list_price, promo_price, discount_pct, legend, promo_kind, data_date, evidence, multi_buy, category, section, chain, province, count(DISTINCT v.store_id) AS stores
FROM valid v LEFT JOIN (SELECT product_id, category, section FROM demo_categories) USING (product_id)
LEFT JOIN (SELECT company_id, store_id, province FROM demo_stores) USING (company_id, store_id) LEFT JOIN (SELECT company_id, banner_id, chain FROM demo_chains) USING (company_id, banner_id) GROUP BY ALL""",
    "on_map": """
SELECT concat(s.company_id, '-', s.store_id) AS store_key, chain, coalesce(format, 'supermercado') AS format, name, street, number, neighbourhood, locality, province, lat, lon
FROM demo_stores s LEFT JOIN demo_chains USING (company_id, banner_id)""",
    "promos_mapped": """
SELECT v.product_id, v.description, v.brand, list_price, promo_price, discount_pct, legend, promo_kind, data_date, evidence, multi_buy, category, section, string_agg(DISTINCT store_key, ',' ORDER BY store_key) AS stores
FROM valid v JOIN on_map m ON m.store_key = concat(v.company_id, '-', v.store_id) LEFT JOIN (SELECT product_id, category, section FROM demo_categories) c ON c.product_id = v.product_id
GROUP BY v.company_id, v.product_id, v.description, v.brand, list_price, promo_price, discount_pct, legend, promo_kind, data_date, evidence, multi_buy, category, section""",
    "summary": """
SELECT product_id, description, brand, category, chains, companies, lowest, highest, gap_pct, chains_discarded, qty, unit, reference, data_date,
       coalesce(bool_or(credible AND stores >= 3 AND median_price = lowest) AND bool_or(credible AND stores >= 3 AND median_price = highest), false) AS extremes_backed FROM same_product GROUP BY ALL""",
    "zone_chains": "SELECT DISTINCT locality AS zone_id, chain FROM on_map",
    "lists": "SELECT o_custkey AS list_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(max(l_quantity) AS INTEGER) AS quantity FROM (SELECT l_orderkey AS o_custkey, l_partkey, l_quantity FROM lineitem) GROUP BY ALL",
    "priced_lists": "SELECT list_id, product_id, least(99, greatest(1, quantity)) AS quantity, chain, median_price FROM lists JOIN same_product USING (product_id) WHERE credible AND format = 'supermercado'",
}


def twin(final: str) -> str:
    """The final SELECT with all steps that it needs before it."""
    needed: dict[str, None] = {}

    def visit(sql: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+\(?{name}\b", sql):
                visit(STEPS[name])
                needed[name] = None

    visit(final)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in needed) + "\n" + final if needed else final
