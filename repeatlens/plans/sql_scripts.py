"""The core analyses as Spark SQL over registered canonical views.

For users who work in SQL: ``run_sql(spark, mp, scope, name)`` registers
the seven canonical tables as temp views and runs one script.  The
scripts use the same plan-shaping idioms as the DataFrame jobs -- first
order per person as ``min(struct(...))``, items/reviews/payments rolled up
per order before the person key, exact decimal sums and one rounding at
the end -- so Catalyst produces the same skew-safe plans, and the results
equal the DataFrame jobs (``tests/test_sql_scripts.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace


def _r(x: str, d: int) -> str:
    s = float(10 ** d)
    return f"(signum({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


def _ratio(num: str, den: str) -> str:
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def _pct(num: str, den: str) -> str:
    return f"try_divide(100.0D * CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def scripts(scope: Scope, p: str = "rl_", quantity: bool = True) -> dict[str, str]:
    """The scripts; ``quantity``: do the items have that optional column?"""
    item = "order_item_id, product_id, seller_id, price" + ", quantity" * quantity
    s = scope
    scoped = (f"o.order_status = '{s.status}' AND o.order_purchase_timestamp >= TIMESTAMP_NTZ '{s.window_start}'"
              f" AND o.order_purchase_timestamp < TIMESTAMP_NTZ '{s.window_end}'")
    order_totals = f"""order_totals AS (
  SELECT order_id, sum(price) AS order_revenue, sum(freight_value) AS order_freight
  FROM {p}order_items GROUP BY order_id)"""
    cohort = f"""person AS (
  SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS frequency,
         min(struct(o.order_purchase_timestamp, o.order_id, o.order_delivered_customer_date,
                    o.order_estimated_delivery_date, c.customer_state)) AS f
  FROM {p}orders o JOIN {p}customers c ON c.customer_id = o.customer_id
  WHERE {scoped}
  GROUP BY c.customer_unique_id),
cohort AS (
  SELECT customer_unique_id, frequency, f.order_id AS order_id,
         f.order_purchase_timestamp AS order_purchase_timestamp,
         f.order_delivered_customer_date AS order_delivered_customer_date,
         f.order_estimated_delivery_date AS order_estimated_delivery_date,
         f.customer_state AS customer_state
  FROM person WHERE f.order_purchase_timestamp < TIMESTAMP_NTZ '{s.eligible_before}')"""
    ctype = "CASE WHEN frequency = 1 THEN 'One-time' ELSE 'Repeat' END"
    cats = f"""product_categories AS (
  SELECT pr.product_id, t.product_category_name_english AS category
  FROM {p}products pr JOIN {p}category_translation t
    ON t.product_category_name = pr.product_category_name)"""
    q: dict[str, str] = {}

    q["exec_kpis"] = f"""
WITH {order_totals},
per_person AS (
  SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS frequency, sum(t.order_revenue) AS monetary,
         sum(t.order_freight) AS freight
  FROM {p}orders o JOIN order_totals t ON t.order_id = o.order_id
  JOIN {p}customers c ON c.customer_id = o.customer_id
  WHERE {scoped} GROUP BY c.customer_unique_id),
g AS (SELECT sum(frequency) AS total_orders, count(1) AS total_customers, sum(monetary) AS revenue,
             sum(freight) AS freight FROM per_person)
SELECT CAST(total_orders AS BIGINT) AS total_orders, CAST(total_customers AS BIGINT) AS total_customers,
       CAST(revenue AS DOUBLE) AS total_revenue,
       {_r(_ratio('revenue', 'total_orders'), 2)} AS avg_order_value,
       {_r('CAST(freight AS DOUBLE)', 2)} AS total_freight,
       {_r(_pct('freight', 'revenue'), 1)} AS freight_share_pct
FROM g"""

    q["monthly_revenue_trend"] = f"""
WITH {order_totals},
monthly AS (
  SELECT date_format(o.order_purchase_timestamp, 'yyyy-MM') AS order_month,
         sum(t.order_revenue) AS revenue, count(DISTINCT o.order_id) AS orders
  FROM {p}orders o JOIN order_totals t ON t.order_id = o.order_id
  WHERE {scoped} GROUP BY 1),
lagged AS (SELECT *, lag(revenue) OVER (ORDER BY order_month) AS prev FROM monthly)
SELECT order_month, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders,
       CAST(revenue - prev AS DOUBLE) AS mom_change,
       {_r(_pct('revenue - prev', 'prev'), 1)} AS mom_growth_pct
FROM lagged ORDER BY order_month"""

    q["regional_performance"] = f"""
WITH {order_totals},
per AS (
  SELECT c.customer_state, c.customer_unique_id, count(DISTINCT o.order_id) AS n_orders,
         sum(t.order_revenue) AS revenue
  FROM {p}orders o JOIN order_totals t ON t.order_id = o.order_id
  JOIN {p}customers c ON c.customer_id = o.customer_id
  WHERE {scoped} GROUP BY 1, 2),
st AS (SELECT customer_state, count(1) AS customers, sum(n_orders) AS orders, sum(revenue) AS revenue
       FROM per GROUP BY customer_state)
SELECT customer_state, CAST(customers AS BIGINT) AS customers, CAST(orders AS BIGINT) AS orders,
       CAST(revenue AS DOUBLE) AS revenue, {_r(_ratio('revenue', 'orders'), 2)} AS avg_order_value
FROM st ORDER BY revenue DESC, customer_state"""

    cat_items = f"""{cats},
cat_items AS (
  SELECT pc.category, oi.order_id, oi.product_id, oi.price
  FROM {p}orders o JOIN {p}order_items oi ON oi.order_id = o.order_id
  JOIN product_categories pc ON pc.product_id = oi.product_id
  WHERE {scoped})"""
    q["category_performance"] = f"""
WITH {cat_items},
per_order AS (SELECT category, order_id, sum(CAST(price AS DECIMAL(18,2))) AS revenue
              FROM cat_items GROUP BY 1, 2),
cat AS (SELECT category, sum(revenue) AS revenue, count(1) AS orders FROM per_order GROUP BY 1)
SELECT category, CAST(revenue AS DOUBLE) AS revenue, CAST(orders AS BIGINT) AS orders,
       {_r(_ratio('revenue', 'orders'), 2)} AS avg_order_value
FROM cat ORDER BY revenue DESC, category LIMIT {s.top_categories}"""

    q["top_products_per_category"] = f"""
WITH {cat_items},
prod AS (SELECT category, product_id, sum(CAST(price AS DECIMAL(18,2))) AS revenue
         FROM cat_items GROUP BY 1, 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY revenue DESC) AS rank_in_category
           FROM prod)
SELECT category, product_id, CAST(revenue AS DOUBLE) AS revenue,
       CAST(rank_in_category AS INT) AS rank_in_category
FROM ranked WHERE rank_in_category <= {s.top_products_per_category}
ORDER BY revenue DESC, category, product_id LIMIT {s.top_products_total}"""

    q["rfm_base"] = f"""
WITH {order_totals},
co AS (
  SELECT c.customer_unique_id, max(o.order_purchase_timestamp) AS last_order_date,
         count(DISTINCT o.order_id) AS frequency,
         sum(t.order_revenue) AS monetary
  FROM {p}orders o JOIN order_totals t ON t.order_id = o.order_id
  JOIN {p}customers c ON c.customer_id = o.customer_id
  WHERE {scoped} GROUP BY 1)
SELECT customer_unique_id,
       CAST(CAST(timestampdiff(SECOND, last_order_date, TIMESTAMP_NTZ '{s.snapshot}') AS DOUBLE) / 86400.0D
            AS INT) AS recency_days,
       CAST(frequency AS BIGINT) AS frequency, CAST(monetary AS DOUBLE) AS monetary
FROM co"""

    q["one_time_vs_repeat"] = f"""
WITH per AS (
  SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS frequency
  FROM {p}orders o JOIN {p}customers c ON c.customer_id = o.customer_id
  WHERE {scoped} GROUP BY 1),
g AS (SELECT count_if(frequency = 1) AS one_time_customers, count_if(frequency > 1) AS repeat_customers,
             count(1) AS customers FROM per)
SELECT one_time_customers, repeat_customers, customers,
       {_r(_pct('one_time_customers', 'customers'), 1)} AS pct_one_time
FROM g"""

    dsec = "timestampdiff(SECOND, order_purchase_timestamp, order_delivered_customer_date)"
    lsec = "timestampdiff(SECOND, order_estimated_delivery_date, order_delivered_customer_date)"
    q["hyp_delivery"] = f"""
WITH {cohort},
rev AS (SELECT order_id, count(1) AS review_rows, count(review_score) AS n_scores,
               sum(review_score) AS sum_score FROM {p}order_reviews GROUP BY order_id),
j AS (SELECT c.*, r.n_scores, r.sum_score, greatest(coalesce(r.review_rows, 0), 1) AS w,
             {dsec} AS dsec, {lsec} AS lsec
      FROM cohort c LEFT JOIN rev r ON r.order_id = c.order_id),
g AS (SELECT {ctype} AS customer_type, sum(w) AS customers, count(1) AS distinct_customers,
             sum(sum_score) AS sum_score, sum(n_scores) AS n_scores,
             sum(dsec * w) AS dsec, sum(CASE WHEN dsec IS NOT NULL THEN w END) AS dn,
             sum(lsec * w) AS lsec, sum(CASE WHEN lsec IS NOT NULL THEN w END) AS ln
      FROM j GROUP BY 1)
SELECT customer_type, CAST(customers AS BIGINT) AS customers,
       CAST(distinct_customers AS BIGINT) AS distinct_customers,
       {_r(_ratio('sum_score', 'n_scores'), 2)} AS avg_review_score,
       {_r(_ratio('dsec', '86400.0D * CAST(dn AS DOUBLE)'), 1)} AS avg_delivery_days,
       {_r(_ratio('lsec', '86400.0D * CAST(ln AS DOUBLE)'), 1)} AS avg_days_early_or_late
FROM g"""

    q["hyp_category"] = f"""
WITH {cats},
first_in_order AS (
  SELECT order_id, min(struct({item})) AS fi
  FROM {p}order_items GROUP BY order_id),
per AS (
  SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS frequency,
         min(CASE WHEN o.order_purchase_timestamp < TIMESTAMP_NTZ '{s.eligible_before}' AND f.fi IS NOT NULL
                  THEN struct(o.order_purchase_timestamp, o.order_id, f.fi) END) AS k
  FROM {p}orders o JOIN {p}customers c ON c.customer_id = o.customer_id
  LEFT JOIN first_in_order f ON f.order_id = o.order_id
  WHERE {scoped}
  GROUP BY 1),
g AS (
  SELECT pc.category, count_if(per.frequency = 1) AS one_time, count_if(per.frequency > 1) AS `repeat`,
         count(1) AS total_first_time_buyers
  FROM per JOIN product_categories pc ON pc.product_id = per.k.fi.product_id
  GROUP BY pc.category)
SELECT category, one_time, `repeat`, {_r(_pct('`repeat`', 'total_first_time_buyers'), 1)} AS repeat_rate_pct,
       total_first_time_buyers
FROM g WHERE total_first_time_buyers >= {s.min_category_buyers}
ORDER BY repeat_rate_pct DESC, category"""

    q["hyp_payment"] = f"""
WITH {cohort},
pay AS (SELECT order_id, count(1) AS payment_rows, count(payment_installments) AS n_inst,
               sum(payment_installments) AS sum_inst, count(payment_value) AS n_value,
               sum(payment_value) AS sum_value FROM {p}order_payments GROUP BY order_id),
g AS (SELECT {ctype} AS customer_type, sum(payment_rows) AS payment_rows, sum(sum_inst) AS sum_inst,
             sum(n_inst) AS n_inst, sum(sum_value) AS sum_value, sum(n_value) AS n_value
      FROM cohort c JOIN pay ON pay.order_id = c.order_id GROUP BY 1)
SELECT customer_type, CAST(payment_rows AS BIGINT) AS payment_rows,
       {_r(_ratio('sum_inst', 'n_inst'), 2)} AS avg_installments,
       {_r(_ratio('sum_value', 'n_value'), 2)} AS avg_payment_value
FROM g"""

    q["hyp_geography"] = f"""
WITH {cohort},
g AS (SELECT customer_state, count(1) AS customers, count_if(frequency > 1) AS rep
      FROM cohort GROUP BY customer_state)
SELECT customer_state, customers, {_r(_pct('rep', 'customers'), 1)} AS repeat_rate_pct
FROM g WHERE customers >= {s.min_state_customers}
ORDER BY repeat_rate_pct DESC, customer_state"""
    return q


def run_sql(spark: SparkSession, mp: Marketplace, scope: Scope, name: str, prefix: str = "rl_") -> DataFrame:
    """Register the canonical views (``prefix`` + table) and run one script."""
    mp.register_views(prefix)
    return spark.sql(scripts(scope, prefix, "quantity" in mp.order_items.columns)[name])
