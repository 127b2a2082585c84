"""SQL views that mirror `bridge` for the DuckDB checks."""

PRODUCTS = """
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         upper(p_name) || CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN ' TAB ' ELSE ' CAPS ' END
           || CAST(50*(1+p_size%5) AS VARCHAR) || 'MG X' || CAST(10*(1+p_partkey%5) AS VARCHAR) AS standard_name,
         array_to_string(list_sort(string_split(p_name,' ')),' ') AS ingredient_key,
         array_to_string(list_sort(string_split(p_name,' ')),' ') || ' ' || CAST(50*(1+p_size%5) AS VARCHAR) || ' mg '
           || CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'tableta' ELSE 'capsula' END AS generic_key,
         upper(p_name) AS active_ingredient,
         CAST(50*(1+p_size%5) AS VARCHAR) AS concentration,
         CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'Tableta' ELSE 'Cápsula' END AS dosage_form,
         CAST(10*(1+p_partkey%5) AS INTEGER) AS presentation_quantity,
         CASE WHEN p_type IN ('STANDARD','SMALL','ECONOMY') THEN 'tabletas' ELSE 'cápsulas' END AS presentation_unit,
         upper(replace(p_brand,'#','')) AS laboratory_id,
         lower(p_brand) AS brand_text,
         CASE WHEN p_partkey % 4 = 3 THEN 'ASEO' ELSE 'MEDICAMENTOS' END AS sector,
         p_partkey, p_name
  FROM part)"""

PRICE_ROWS = """
price_rows AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS supplier_id, CAST(l_partkey AS VARCHAR) AS product_id,
         year(l_shipdate) AS list_year,
         CAST(l_suppkey AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR) AS file_id,
         l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_partkey,
         CASE WHEN l_suppkey % 10 = 0 THEN CASE WHEN l_linestatus='F' THEN 'SUPERIOR A 12 MESES' ELSE 'ENTRE 6 Y 12 MESES' END END AS expiration_label,
         CAST(floor(l_extendedprice/l_quantity*100+0.5)/100 AS DECIMAL(14,2)) AS price,
         CASE l_returnflag WHEN 'A' THEN 'AVAILABLE' WHEN 'N' THEN 'UNKNOWN' ELSE 'OUT_OF_STOCK' END AS availability,
         CASE l_returnflag WHEN 'A' THEN l_linenumber*10 WHEN 'R' THEN 0 END AS stock_quantity
  FROM lineitem)"""

OFFERS = """
offers AS (
  SELECT supplier_id || '|' || product_id || '|' || coalesce(expiration_label,'') AS offer_id,
         supplier_id, product_id, expiration_label, price, availability, stock_quantity, file_id AS source_file_id
  FROM price_rows
  QUALIFY row_number() OVER (PARTITION BY supplier_id, product_id, expiration_label
    ORDER BY list_year DESC, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1)"""

LATEST = """
latest AS (
  SELECT supplier_id, CAST(supplier_id AS VARCHAR) || '-' || CAST(max(list_year) AS VARCHAR) AS latest_file_id,
         max(list_year) AS latest_year
  FROM price_rows GROUP BY supplier_id)"""

CURRENT = """
curr AS (
  SELECT o.* FROM offers o JOIN latest USING (supplier_id) WHERE o.source_file_id = latest_file_id)"""

ENRICHED = """
rich AS (
  SELECT o.*, s.s_name AS supplier_name, p.generic_key, p.standard_name, p.presentation_quantity, p.presentation_unit,
         p.laboratory_id,
         CAST(floor(CAST(o.price AS DOUBLE)/p.presentation_quantity*10000+0.5)/10000.0 AS DECIMAL(18,4)) AS unit_price,
         CASE WHEN s.s_suppkey % 10 = 0 THEN coalesce(o.expiration_label LIKE '%SUPERIOR%', false) ELSE true END AS safe
  FROM curr o JOIN products p USING (product_id) JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = o.supplier_id)"""

WAREHOUSE = """
warehouse AS (
  SELECT generic_key, CAST(sum(CASE WHEN p_partkey % 7 = 0 THEN presentation_quantity ELSE 0 END) AS INTEGER) AS quantity
  FROM products GROUP BY 1 HAVING sum(CASE WHEN p_partkey % 7 = 0 THEN presentation_quantity ELSE 0 END) > 0)"""

ITEMS = """
items AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS item_id,
         CAST(l_orderkey AS VARCHAR) AS request_id, CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(max(l_quantity) AS INTEGER) AS requested_quantity,
         CASE WHEN l_linenumber % 2 = 1 THEN CAST(10*(1+l_partkey%5) AS INTEGER) ELSE -1 END AS asked_size
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey)"""

NET = """
net AS (
  SELECT i.*, p.generic_key, coalesce(w.quantity,0) AS warehouse_stock,
         greatest(0, i.requested_quantity - coalesce(w.quantity,0)) AS quantity
  FROM items i JOIN products p USING (product_id) LEFT JOIN warehouse w USING (generic_key))"""

DEMANDS = """
demands AS (SELECT DISTINCT generic_key, quantity, asked_size FROM net WHERE quantity > 0)"""

OPTIONS = """
opts AS (
  SELECT d.quantity, d.asked_size, r.*,
         CAST(ceil(d.quantity * CASE WHEN asked_size < 0 THEN 1.0 ELSE asked_size END / presentation_quantity::DOUBLE) AS BIGINT) AS packages
  FROM demands d JOIN rich r USING (generic_key))"""

#: what follows from `opts`, the pairs of a demand and an offer with their packages
CHOSEN = """
priced AS (
  SELECT *, CAST(price * packages AS DECIMAL(24,2)) AS total_cost,
         CASE availability WHEN 'OUT_OF_STOCK' THEN false WHEN 'UNKNOWN' THEN true ELSE NOT (stock_quantity IS NOT NULL AND stock_quantity < packages) END AS eligible,
         CASE availability WHEN 'OUT_OF_STOCK' THEN 'Sin existencias.' WHEN 'UNKNOWN' THEN 'Disponibilidad desconocida (no reportada por el proveedor).'
           ELSE CASE WHEN stock_quantity < packages THEN 'Existencia insuficiente: ' || stock_quantity || ' disponibles, se solicitan ' || packages || '.' END END AS discard_reason
  FROM opts),
pooled AS (
  SELECT *, CASE WHEN max(CASE WHEN eligible AND safe THEN 1 ELSE 0 END) OVER (PARTITION BY generic_key, quantity, asked_size) = 1
            THEN eligible AND safe ELSE eligible END AS in_pool
  FROM priced),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY generic_key, quantity, asked_size ORDER BY in_pool DESC, total_cost, offer_id) AS rk,
         count(*) FILTER (in_pool) OVER (PARTITION BY generic_key, quantity, asked_size) AS pool_size,
         count(*) FILTER (eligible) OVER (PARTITION BY generic_key, quantity, asked_size) AS n_eligible,
         count(*) OVER (PARTITION BY generic_key, quantity, asked_size) AS n_offers,
         max(total_cost) FILTER (in_pool) OVER (PARTITION BY generic_key, quantity, asked_size) AS most
  FROM pooled),
chosen AS (
  SELECT generic_key, quantity, asked_size, n_offers, n_eligible, pool_size,
         CASE WHEN in_pool THEN offer_id END AS selected_offer_id, CASE WHEN in_pool THEN total_cost END AS total_price,
         CASE WHEN in_pool THEN most - total_cost END AS savings,
         supplier_id, supplier_name, product_id AS selected_product_id, presentation_quantity AS package_size, packages, price, unit_price,
         availability, stock_quantity, presentation_unit, standard_name, laboratory_id
  FROM ranked WHERE rk = 1)"""


def views(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


PRICING = (PRODUCTS, PRICE_ROWS, OFFERS, LATEST, CURRENT, ENRICHED, WAREHOUSE, ITEMS, NET, DEMANDS, OPTIONS, CHOSEN)
