"""The inventory model as common table expressions over the test tables."""

MODEL = """
categories AS (
  SELECT * FROM (VALUES (1,'General Merchandise','GENERAL'), (2,'Pharmaceuticals','PHARMACY'),
    (3,'Packaged Foods & Dairy','GROCERY'), (4,'Consumer Electronics','ELECTRONICS'),
    (5,'Apparel','APPAREL')) AS t(id, name, domain_type)),
users AS (
  SELECT * FROM (VALUES (1,'Super Admin','admin@inventory.com','ADMIN','ACTIVE'),
    (2,'Store Manager','manager@inventory.com','MANAGER','ACTIVE'),
    (3,'Inventory Clerk','clerk@inventory.com','CLERK','ACTIVE'),
    (4,'Auditor Viewer','auditor@inventory.com','AUDITOR','ACTIVE')) AS t(id, name, email, role, status)),
suppliers AS (
  SELECT s_suppkey AS id, s_name AS name,
    CASE WHEN s_nationkey % 5 <> 0 THEN 'Agent ' || CAST(s_nationkey AS VARCHAR) END AS contact_person
  FROM supplier),
products AS (
  SELECT p_partkey AS id,
    'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS sku,
    CASE WHEN p_partkey % 7 <> 0 THEN '890' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS barcode,
    p_name AS title,
    CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS category_id,
    CASE p_size % 3 WHEN 0 THEN 'Boxes' WHEN 1 THEN 'Kg' ELSE 'Pcs' END AS unit_of_measure,
    p_size AS min_reorder_level,
    CASE p_type WHEN 'ECONOMY' THEN 'GENERAL' WHEN 'LARGE' THEN 'PHARMACY' WHEN 'MEDIUM' THEN 'GROCERY'
                WHEN 'PROMO' THEN 'ELECTRONICS' WHEN 'SMALL' THEN 'APPAREL' ELSE 'HARDWARE' END AS domain_preset,
    p_brand AS brand,
    'Rack ' || CAST(p_size % 10 AS VARCHAR) AS storage_location
  FROM part),
typed AS (
  SELECT l.*, CAST(p.p_retailprice AS DECIMAL(10,2)) AS price, c.c_name,
    CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F') THEN 'STOCK_IN'
         WHEN l_returnflag = 'R' THEN CASE l_linenumber % 3 WHEN 0 THEN 'INTERNAL_USE'
              WHEN 1 THEN 'DAMAGE_WRITE_OFF' ELSE 'VENDOR_RETURN' END
         WHEN l_partkey % 10 = 0 THEN 'INTERNAL_USE'
         WHEN l_partkey % 10 IN (1, 2) AND NOT (l_linestatus = 'F' AND l_quantity <= 5) THEN 'INTERNAL_USE'
         ELSE 'SALE' END AS txn_type
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
transactions AS (
  SELECT CASE WHEN txn_type = 'STOCK_IN' THEN 'TXN-IN-' ELSE 'TXN-OUT-' END || CAST(l_orderkey AS VARCHAR) || '-'
      || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-'
      || CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS VARCHAR) AS txn_number,
    txn_type, l_partkey AS product_id, l_partkey * 10 + l_suppkey % 3 AS batch_id,
    CAST(l_quantity AS INT) AS quantity, price AS unit_price,
    CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_discount AS DECIMAL(5,2)) AS DECIMAL(10,2)) AS discount_amount,
    CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(5,2)) AS DECIMAL(10,2)) AS tax_amount,
    CAST(l_extendedprice AS DECIMAL(10,2)) AS total_amount,
    CASE WHEN txn_type IN ('STOCK_IN', 'VENDOR_RETURN') THEN l_suppkey END AS supplier_id,
    CASE WHEN txn_type = 'SALE' THEN c_name END AS customer_name,
    CASE WHEN txn_type = 'INTERNAL_USE' THEN 'DEPT-' || CAST(l_suppkey % 5 AS VARCHAR) END AS dept_name,
    CASE WHEN txn_type = 'SALE' THEN 'BILL-' || CAST(l_orderkey AS VARCHAR)
         WHEN txn_type = 'STOCK_IN' THEN 'INV-' || CAST(l_orderkey AS VARCHAR) END AS invoice_ref,
    CASE l_linenumber % 4 WHEN 0 THEN 'PAID' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'CREDIT' ELSE 'PARTIAL' END AS payment_status,
    1 + l_orderkey % 4 AS user_id, l_shipdate AS txn_date
  FROM typed),
product_batches AS (
  SELECT batch_id AS id, 'BATCH-' || CAST(batch_id AS VARCHAR) AS batch_number, product_id,
    CASE WHEN product_id % 5 = 0 THEN NULL
         ELSE DATE '1999-06-24' + CAST((product_id * 7 + batch_id % 10 * 31) % 120 - 20 AS INT) END AS expiry_date,
    CAST(greatest(0, sum(CASE WHEN txn_type = 'STOCK_IN' THEN quantity ELSE -quantity END)) AS INT) AS available_qty,
    CAST(max(unit_price) * CAST(0.60 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS purchase_price,
    CAST(max(unit_price) + batch_id % 10 AS DECIMAL(10,2)) AS selling_price,
    CAST(CASE WHEN product_id % 4 = 0 THEN 20 ELSE 0 END AS DECIMAL(5,2)) AS batch_discount_percent,
    CASE WHEN product_id % 4 = 0 THEN '20% Clearance' END AS offer_description
  FROM transactions GROUP BY batch_id, product_id)
"""

# Request documents cut from the test tables.
RECEIPT_REQUESTS = """
receipt_requests AS (
  SELECT k AS seq, o_orderdate AS received_at,
    CASE WHEN k % 97 = 0 THEN 900000000000 + c WHEN k % 3 = 0 THEN c WHEN k % 30 = 1 THEN 0 END AS product_id,
    CASE WHEN k % 3 = 1 THEN NULL WHEN k % 4 = 1 THEN 'RED WIDGET'
         WHEN k % 4 <> 3 THEN 'New item ' || CAST(c % 500 AS VARCHAR) END AS product_title,
    CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'sku-' || lpad(CAST(c AS VARCHAR), 8, '0')
         WHEN k % 3 = 1 THEN 'SKU-' || lpad(CAST(c AS VARCHAR), 8, '0')
         WHEN k % 4 = 0 THEN 'NEW-' || CAST(c % 500 AS VARCHAR) WHEN k % 4 = 1 THEN '' END AS sku,
    CASE WHEN k % 53 = 0 THEN '8900000000001' END AS barcode,
    CASE WHEN k % 2 = 0 THEN 1 + c % 5 END AS category_id,
    CASE WHEN k % 2 = 0 THEN 'Kg' END AS unit_of_measure,
    CASE WHEN k % 4 = 0 THEN 'GROCERY' END AS domain_preset,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 'batch-' || CAST(c * 10 + k % 4 AS VARCHAR)
         ELSE 'BATCH-' || CAST(c * 10 + k % 4 AS VARCHAR) END AS batch_number,
    CASE WHEN k % 6 <> 0 THEN DATE '1999-06-24' + CAST(c % 200 AS INT) END AS expiry_date,
    CASE WHEN k % 10 = 0 THEN 'SN-' || CAST(k AS VARCHAR) END AS serial_number,
    CASE k % 11 WHEN 0 THEN '0' WHEN 1 THEN '-1' WHEN 2 THEN n || 'abc' WHEN 3 THEN n || '.7' WHEN 4 THEN NULL
         WHEN 5 THEN 'x' WHEN 6 THEN ' ' || n ELSE n END AS quantity,
    CASE WHEN k % 101 = 5 THEN '99999999999' WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN '12.345' WHEN k % 9 = 2 THEN 'abc' ELSE amount END AS purchase_price,
    CASE k % 9 WHEN 0 THEN '' ELSE amount END AS selling_price,
    CASE WHEN k % 4 = 0 THEN 20 END AS batch_discount_percent,
    CASE WHEN k % 4 = 0 THEN 'Clearance' ELSE '' END AS offer_description,
    CASE WHEN k % 83 = 9 THEN 900000000000 ELSE k % 10 END AS supplier_id,
    CASE WHEN k % 2 = 0 THEN 'INV-' || CAST(k AS VARCHAR) END AS invoice_ref,
    CASE WHEN k % 3 = 0 THEN 'CREDIT' END AS payment_status,
    CASE WHEN k % 89 = 7 THEN 999 ELSE k % 5 END AS user_id,
    CASE WHEN k % 8 = 0 THEN 'Counted' END AS remarks
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate, CAST(1 + o_orderkey % 50 AS VARCHAR) AS n,
          CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS amount FROM orders) x),
parsed_receipts AS (
  SELECT seq, received_at, nullif(product_id, 0) AS product_id,
    coalesce(nullif(product_title, ''), 'New Received Item') AS title,
    coalesce(nullif(sku, ''), 'SKU-' || strftime(received_at, '%Y%m%d') || '-' || CAST(seq AS VARCHAR)) AS sku,
    nullif(barcode, '') AS barcode, coalesce(nullif(category_id, 0), 1) AS category_id,
    coalesce(nullif(unit_of_measure, ''), 'Pcs') AS unit_of_measure,
    coalesce(nullif(domain_preset, ''), 'GENERAL') AS domain_preset,
    coalesce(nullif(batch_number, ''), 'BATCH-' || strftime(received_at, '%Y%m%d') || '-' || CAST(seq AS VARCHAR)) AS batch_number,
    expiry_date, nullif(serial_number, '') AS serial_number,
    TRY_CAST(regexp_extract(quantity, '^\\s*([+-]?\\d+)', 1) AS INT) AS qty,
    coalesce(TRY_CAST(regexp_extract(purchase_price, '^\\s*([+-]?\\d+\\.?\\d*)', 1) AS DECIMAL(18,6)), 0) AS exact_cost,
    TRY_CAST(coalesce(TRY_CAST(regexp_extract(purchase_price, '^\\s*([+-]?\\d+\\.?\\d*)', 1) AS DECIMAL(18,6)), 0) AS DECIMAL(10,2)) AS purchase_price,
    TRY_CAST(coalesce(TRY_CAST(regexp_extract(selling_price, '^\\s*([+-]?\\d+\\.?\\d*)', 1) AS DECIMAL(18,6)), 0) AS DECIMAL(10,2)) AS selling_price,
    CAST(coalesce(batch_discount_percent, 0) AS DECIMAL(5,2)) AS batch_discount_percent,
    nullif(offer_description, '') AS offer_description, nullif(supplier_id, 0) AS supplier_id,
    coalesce(nullif(invoice_ref, ''), 'RECEIPT-IN') AS invoice_ref,
    coalesce(nullif(payment_status, ''), 'PAID') AS payment_status,
    coalesce(nullif(user_id, 0), 1) AS user_id,
    coalesce(nullif(remarks, ''), 'Stock In Entry') AS remarks
  FROM receipt_requests),
receipts AS (
  SELECT *, CASE WHEN coalesce(qty, 0) <= 0 THEN 'Valid Quantity (> 0) is required.'
    WHEN purchase_price IS NULL OR selling_price IS NULL
      OR TRY_CAST(round(CAST(qty * exact_cost AS DECIMAL(24,6)), 2) AS DECIMAL(10,2)) IS NULL THEN 'Amount is out of range.' END AS problem
  FROM parsed_receipts),
matched AS (
  SELECT r.*, CASE WHEN r.product_id IS NOT NULL THEN g.id ELSE coalesce(s.id, t.id) END AS matched_id,
    s.id AS sku_id, t.id AS title_id,
    CASE WHEN problem IS NOT NULL THEN problem
      WHEN r.user_id NOT IN (SELECT id FROM users) THEN 'User ID ' || CAST(r.user_id AS VARCHAR) || ' not found.'
      WHEN r.supplier_id IS NOT NULL AND r.supplier_id NOT IN (SELECT id FROM suppliers)
        THEN 'Supplier ID ' || CAST(r.supplier_id AS VARCHAR) || ' not found.'
      WHEN r.product_id IS NOT NULL AND g.id IS NULL THEN 'Product ID ' || CAST(r.product_id AS VARCHAR) || ' not found.' END AS fault
  FROM receipts r LEFT JOIN products g ON r.product_id = g.id
  LEFT JOIN (SELECT lower(sku) AS sku, min(id) AS id FROM products GROUP BY 1) s ON lower(r.sku) = s.sku
  LEFT JOIN (SELECT lower(title) AS title, min(id) AS id FROM products GROUP BY 1) t ON lower(r.title) = t.title),
-- Receipts served one by one, with what products of the run have so far. Of those alike in all three keys only the
-- first can create; a SKU made from the receipt's own number is nobody else's.
could_create AS (
  SELECT row_number() OVER (ORDER BY min(seq)) AS n, min(seq) AS seq, sku, title, barcode
  FROM (SELECT seq, CASE WHEN sku LIKE 'SKU-%-' || CAST(seq AS VARCHAR) THEN NULL ELSE lower(sku) END AS sku, lower(title) AS title,
          lower(barcode) AS barcode FROM matched WHERE fault IS NULL AND product_id IS NULL AND matched_id IS NULL)
  GROUP BY sku, title, barcode),
stored_bars AS (SELECT list(lower(barcode)) AS bars FROM products WHERE barcode IS NOT NULL),
served AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS creator, CAST([] AS VARCHAR[]) AS skus, CAST([] AS VARCHAR[]) AS titles,
    coalesce((SELECT bars FROM stored_bars), []) AS bars
  UNION ALL
  SELECT c.n, CASE WHEN free THEN c.seq END, CASE WHEN free AND c.sku IS NOT NULL THEN list_append(skus, c.sku) ELSE skus END,
    CASE WHEN free THEN list_append(titles, c.title) ELSE titles END,
    CASE WHEN free AND c.barcode IS NOT NULL THEN list_append(bars, c.barcode) ELSE bars END
  FROM (SELECT s.skus, s.titles, s.bars, c.*, NOT list_contains(s.titles, c.title)
          AND NOT coalesce(list_contains(s.skus, c.sku), FALSE) AND NOT coalesce(list_contains(s.bars, c.barcode), FALSE) AS free
        FROM served s JOIN could_create c ON c.n = s.n + 1) c),
creators AS (
  SELECT m.seq, lower(m.sku) AS sku, lower(m.title) AS title FROM matched m JOIN (SELECT creator FROM served) v ON m.seq = v.creator),
placed AS (
  SELECT m.*, CASE WHEN m.product_id IS NOT NULL OR m.sku_id IS NOT NULL THEN m.matched_id
    ELSE coalesce(1099511627776 + s.seq, m.title_id, 1099511627776 + t.seq) END AS pid
  FROM matched m LEFT JOIN creators s ON lower(m.sku) = s.sku AND s.seq <= m.seq
  LEFT JOIN creators t ON lower(m.title) = t.title AND t.seq <= m.seq),
resolved AS (
  SELECT * EXCLUDE (matched_id, sku_id, title_id, problem, fault) FROM placed WHERE fault IS NULL AND pid IS NOT NULL),
refused AS (
  SELECT seq, coalesce(fault, 'Barcode is already in use.') AS reason FROM placed WHERE fault IS NOT NULL OR pid IS NULL),
arrived AS (
  SELECT pid, lower(batch_number) AS num, sum(qty) AS qty, arg_max(purchase_price, seq) AS purchase_price,
    arg_max(selling_price, seq) AS selling_price, min(seq) AS first_seq, arg_min(batch_number, seq) AS batch_number,
    arg_min_null(expiry_date, seq) AS expiry_date, arg_min(batch_discount_percent, seq) AS batch_discount_percent,
    arg_min_null(offer_description, seq) AS offer_description
  FROM resolved GROUP BY 1, 2)
"""

BILL_REQUESTS = """
bill_heads AS (
  SELECT k AS seq, o_orderdate AS received_at,
    coalesce(CASE WHEN k % 3 = 0 THEN 'BILL-' || CAST(k AS VARCHAR) END,
      'BILL-' || strftime(o_orderdate, '%Y%m%d') || '-' || CAST(k AS VARCHAR)) AS bill_number,
    CASE WHEN k % 10 = 0 THEN 'INTERNAL_USE' ELSE 'SALE' END AS txn_type,
    CASE WHEN k % 10 <> 0 THEN 'Customer ' || CAST(c AS VARCHAR) END AS customer_name,
    CASE WHEN k % 10 = 0 THEN 'DEPT-1' END AS dept_name,
    CASE WHEN k % 5 = 0 THEN 1 ELSE k % 5 END AS user_id,
    CASE WHEN k % 10 = 0 THEN 'Stock Out (INTERNAL_USE)' ELSE 'Stock Out (SALE)' END AS remarks, k, c
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate FROM orders) x),
bill_items AS (
  SELECT seq, 1 AS line_no, CASE WHEN k % 17 <> 0 THEN c END AS product_id, c * 10 + k % 3 AS batch_id,
    CASE WHEN k % 19 = 0 THEN 'x' ELSE CAST(1 + k % 5 AS VARCHAR) END AS quantity,
    CASE WHEN k % 6 = 0 THEN '12.50' WHEN k % 12 = 1 THEN 'abc' END AS unit_price, k
  FROM bill_heads
  UNION ALL
  SELECT seq, 2, c + 7, CASE WHEN k % 13 = 0 THEN 900000000000 + c WHEN k % 23 = 0 THEN c * 10 ELSE (c + 7) * 10 + k % 3 END,
    CAST(1 + k % 3 AS VARCHAR), NULL, k FROM bill_heads WHERE k % 4 <> 0
  UNION ALL
  SELECT seq, 3, c, c * 10 + k % 3, CAST(1 + k % 2 AS VARCHAR), NULL, k FROM bill_heads WHERE k % 4 <> 0 AND k % 5 = 0),
bill_rows AS (
  SELECT h.* EXCLUDE (k, c), i.line_no, i.product_id, i.batch_id, i.quantity, i.unit_price,
    CASE WHEN i.k % 7 = 0 THEN '1.255' END AS discount_amount, CASE WHEN i.k % 7 = 1 THEN '2.5' END AS tax_amount
  FROM bill_heads h JOIN bill_items i USING (seq)),
bill_numbers AS (
  SELECT r.*, TRY_CAST(regexp_extract(r.quantity, '^\\s*([+-]?\\d+)', 1) AS INT) AS qty,
    CASE WHEN r.unit_price IS NULL THEN CAST(b.selling_price AS DECIMAL(18,6))
         ELSE TRY_CAST(regexp_extract(r.unit_price, '^\\s*([+-]?\\d+\\.?\\d*)', 1) AS DECIMAL(18,6)) END AS price,
    coalesce(CAST(r.discount_amount AS DECIMAL(18,6)), 0) AS disc, coalesce(CAST(r.tax_amount AS DECIMAL(18,6)), 0) AS tax,
    b.product_id AS batch_product, p.id AS known
  FROM bill_rows r LEFT JOIN product_batches b ON r.batch_id = b.id LEFT JOIN products p ON r.product_id = p.id),
bill_priced AS (
  SELECT seq, received_at, bill_number, txn_type, customer_name, dept_name, user_id, remarks, line_no, product_id, batch_id,
    qty, CAST(price AS DECIMAL(10,2)) AS unit_price, CAST(disc AS DECIMAL(10,2)) AS discount_amount,
    CAST(tax AS DECIMAL(10,2)) AS tax_amount,
    CAST(round(CAST(qty * price AS DECIMAL(24,6)) - disc + tax, 2) AS DECIMAL(18,2)) AS total_amount,
    batch_product <> product_id AS batch_product_mismatch,
    CASE WHEN line_no = 1 AND coalesce(product_id, 0) = 0
           THEN 'At least one valid item is required for Stock Out dispatch.'
         WHEN coalesce(product_id, 0) = 0 OR coalesce(batch_id, 0) = 0 OR coalesce(qty, 0) <= 0
           THEN 'Valid Product ID, Batch ID, and Quantity required for all items.'
         WHEN batch_product IS NULL THEN 'Batch ID ' || CAST(batch_id AS VARCHAR) || ' not found in database.'
         WHEN known IS NULL THEN 'Product ID ' || CAST(product_id AS VARCHAR) || ' not found.'
         WHEN price IS NULL THEN 'Price, discount and tax must be numbers.' END AS problem
  FROM bill_numbers)
"""
