"""ERP marts registered as queries, each with its DuckDB oracle (written independently in SQL)."""

from __future__ import annotations

from millrun.operators import erp
from millrun.plans.oracle_bindings import with_bindings as W
from millrun.plans.registry import query
from millrun.sources import bindings as B

# ---- oracle building blocks ----------------------------------------------------------------
SQL_PROC_LINES = """SELECT p.ebeln AS purchase_order_number, p.ebelp AS po_line_item_number, p.matnr AS material_number,
    p.menge AS ordered_quantity, p.meins AS unit_of_measure, p.netwr AS net_value_usd, p.werks AS plant,
    p.lgort AS storage_location, p.eindt AS scheduled_delivery_date, h.bukrs AS company_code,
    h.lifnr AS supplier_number, h.bsart AS po_type, h.aedat AS po_creation_date,
    CASE WHEN p.menge > 0 THEN p.netwr / p.menge END AS unit_price,
    CAST(date_diff('day', TRY_CAST(h.aedat AS DATE), TRY_CAST(p.eindt AS DATE)) AS INTEGER) AS days_until_delivery
    FROM ekpo p LEFT JOIN ekko h ON p.ebeln = h.ebeln"""

SQL_ORDER_LINES = """SELECT p.vbeln AS sales_order_number, p.posnr AS line_item_number, p.matnr AS material_number,
    p.kwmeng AS order_quantity, p.vrkme AS unit_of_measure, p.netwr AS net_value_usd,
    p.edatu AS requested_delivery_date, p.absta AS rejection_status, h.vkorg AS sales_organization,
    h.vtweg AS distribution_channel, h.kunnr AS customer_number, h.audat AS order_date,
    (p.absta IS NOT NULL AND p.absta <> '') AS is_rejected,
    CAST(date_diff('day', TRY_CAST(h.audat AS DATE), TRY_CAST(p.edatu AS DATE)) AS INTEGER) AS days_to_delivery,
    strftime(TRY_CAST(h.audat AS DATE), '%Y-%m') AS order_year_month
    FROM vbap p LEFT JOIN vbak h ON p.vbeln = h.vbeln"""

SQL_DELIVERY_LINES = """SELECT delivery_number, line_item_number, material_number, delivered_quantity, unit_of_measure,
    customer_number, planned_delivery_date, actual_delivery_date, shipping_carrier,
    CASE WHEN actual_delivery_date IS NOT NULL AND planned_delivery_date IS NOT NULL
         THEN CAST(date_diff('day', planned_delivery_date, actual_delivery_date) AS INTEGER) END AS delivery_variance_days,
    CASE WHEN actual_delivery_date IS NOT NULL AND planned_delivery_date IS NOT NULL
         THEN actual_delivery_date <= planned_delivery_date END AS on_time_delivery,
    CASE WHEN actual_delivery_date IS NULL THEN 'Pending'
         WHEN actual_delivery_date IS NOT NULL AND planned_delivery_date IS NOT NULL
              AND actual_delivery_date <= planned_delivery_date THEN 'On Time'
         ELSE 'Late' END AS delivery_status
    FROM (SELECT p.vbeln AS delivery_number, p.posnr AS line_item_number, p.matnr AS material_number,
                 p.lfimg AS delivered_quantity, p.vrkme AS unit_of_measure, h.kunnr AS customer_number,
                 TRY_CAST(h.lfdat AS DATE) AS planned_delivery_date, TRY_CAST(h.wadat_ist AS DATE) AS actual_delivery_date,
                 h.tragr AS shipping_carrier
          FROM lips p LEFT JOIN likp h ON p.vbeln = h.vbeln) j"""

SQL_INV_POS = """SELECT matnr AS material_number, werks AS plant, lgort AS storage_location, labst AS unrestricted_stock,
    speme AS blocked_stock, insme AS in_transit_stock, eisbe AS safety_stock_level,
    labst + speme + insme AS total_stock, labst + insme AS available_stock, labst < eisbe AS is_below_safety_stock,
    CASE WHEN labst < eisbe THEN 'Critical' WHEN labst < eisbe * 2 THEN 'Low' ELSE 'OK' END AS stock_status FROM mard"""

SQL_ORDERS_GOLD = """SELECT sales_order_number, customer_number, order_date, order_year_month,
    count(line_item_number) AS total_line_items, CAST(sum(order_quantity) AS BIGINT) AS total_quantity,
    CAST(sum(CAST(net_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_net_value_usd,
    first(requested_delivery_date ORDER BY CAST(line_item_number AS INTEGER), material_number, net_value_usd,
          requested_delivery_date, coalesce(rejection_status, '~')) AS requested_delivery_date,
    first(rejection_status ORDER BY CAST(line_item_number AS INTEGER), material_number, net_value_usd,
          requested_delivery_date, coalesce(rejection_status, '~')) AS rejection_status,
    CAST(max(CAST(is_rejected AS INTEGER)) AS BOOLEAN) AS has_rejections,
    first(sales_organization ORDER BY CAST(line_item_number AS INTEGER), material_number, net_value_usd,
          requested_delivery_date, coalesce(rejection_status, '~')) AS sales_organization
    FROM order_lines GROUP BY sales_order_number, customer_number, order_date, order_year_month"""

SQL_PROC_GOLD = """SELECT *, floor(CASE WHEN total_quantity > 0 THEN total_net_value_usd / total_quantity END * 10000 + 0.5) / 10000 AS avg_unit_price
    FROM (SELECT purchase_order_number, supplier_number, company_code, po_creation_date,
        count(po_line_item_number) AS total_line_items, CAST(sum(ordered_quantity) AS BIGINT) AS total_quantity,
        CAST(sum(CAST(net_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_net_value_usd,
        first(scheduled_delivery_date ORDER BY CAST(po_line_item_number AS INTEGER), material_number, net_value_usd,
              scheduled_delivery_date, plant) AS scheduled_delivery_date,
        first(plant ORDER BY CAST(po_line_item_number AS INTEGER), material_number, net_value_usd,
              scheduled_delivery_date, plant) AS plant,
        first(po_type ORDER BY CAST(po_line_item_number AS INTEGER), material_number, net_value_usd,
              scheduled_delivery_date, plant) AS po_type
        FROM proc_lines GROUP BY purchase_order_number, supplier_number, company_code, po_creation_date) g"""

SQL_INV_GOLD = """SELECT *, CASE WHEN unrestricted_stock < safety_stock_level THEN 'Critical'
        WHEN unrestricted_stock < safety_stock_level * 2 THEN 'Low' ELSE 'OK' END AS inventory_health
    FROM (SELECT material_number, plant, CAST(sum(unrestricted_stock) AS BIGINT) AS unrestricted_stock,
        CAST(sum(blocked_stock) AS BIGINT) AS blocked_stock, CAST(sum(in_transit_stock) AS BIGINT) AS in_transit_stock,
        CAST(sum(safety_stock_level) AS BIGINT) AS safety_stock_level,
        CAST(sum(available_stock) AS BIGINT) AS available_stock, CAST(sum(total_stock) AS BIGINT) AS total_stock
        FROM inv_pos GROUP BY material_number, plant) g"""

SQL_KPI_ORDERS = """SELECT *, floor(CASE WHEN total_orders > 0 THEN total_revenue_usd / total_orders ELSE 0.0 END * 10000 + 0.5) / 10000 AS avg_order_value_usd,
    CASE WHEN total_orders > 0 THEN round(rejected_orders / total_orders * 100, 2) ELSE 0.0 END AS rejection_rate_pct
    FROM (SELECT count(*) AS total_orders,
        CAST(coalesce(sum(CAST(total_net_value_usd AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_revenue_usd,
        CAST(coalesce(sum(total_quantity), 0) AS BIGINT) AS total_quantity_ordered,
        count(DISTINCT customer_number) AS unique_customers, CAST(sum(total_line_items) AS BIGINT) AS total_line_items,
        CAST(coalesce(sum(CAST(has_rejections AS INTEGER)), 0) AS BIGINT) AS rejected_orders FROM orders_gold) k"""

SQL_KPI_PROC = """SELECT *, floor(CASE WHEN total_purchase_orders > 0 THEN total_spend_usd / total_purchase_orders ELSE 0.0 END * 10000 + 0.5) / 10000 AS avg_po_spend_usd,
    floor(CASE WHEN total_quantity_ordered > 0 THEN total_spend_usd / total_quantity_ordered ELSE 0.0 END * 10000 + 0.5) / 10000 AS avg_unit_cost
    FROM (SELECT count(*) AS total_purchase_orders,
        CAST(coalesce(sum(CAST(total_net_value_usd AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_spend_usd,
        CAST(coalesce(sum(total_quantity), 0) AS BIGINT) AS total_quantity_ordered,
        count(DISTINCT supplier_number) AS unique_suppliers, CAST(sum(total_line_items) AS BIGINT) AS total_line_items
        FROM proc_gold) k"""

SQL_KPI_INV = """SELECT count(*) AS total_sku_locations, count(DISTINCT material_number) AS unique_materials,
    count(DISTINCT plant) AS unique_plants,
    CAST(coalesce(sum(unrestricted_stock), 0) AS BIGINT) AS total_unrestricted_stock,
    CAST(coalesce(sum(blocked_stock), 0) AS BIGINT) AS total_blocked_stock,
    CAST(coalesce(sum(in_transit_stock), 0) AS BIGINT) AS total_in_transit_stock,
    CAST(coalesce(sum(safety_stock_level), 0) AS BIGINT) AS total_safety_stock_level,
    CAST(coalesce(sum(available_stock), 0) AS BIGINT) AS total_available_stock,
    count_if(inventory_health = 'Critical') AS critical_sku_count FROM inv_gold"""

SQL_KPI_DELIVERY = """SELECT total_deliveries, total_delivery_lines, total_units_delivered, unique_customers,
    unique_materials_delivered,
    CASE WHEN completed_deliveries > 0 THEN round(on_time_deliveries / completed_deliveries * 100, 2) ELSE 0.0 END
        AS on_time_delivery_rate_pct, avg_delivery_variance_days
    FROM (SELECT count(DISTINCT delivery_number) AS total_deliveries, count(*) AS total_delivery_lines,
        CAST(coalesce(sum(delivered_quantity), 0) AS BIGINT) AS total_units_delivered,
        count(DISTINCT customer_number) AS unique_customers, count(DISTINCT material_number) AS unique_materials_delivered,
        count_if(on_time_delivery) AS on_time_deliveries, count_if(on_time_delivery IS NOT NULL) AS completed_deliveries,
        round(avg(delivery_variance_days), 1) AS avg_delivery_variance_days FROM delivery) k"""

PROC = ["ekpo", "ekko"]
ORD = ["vbap", "vbak"]
DEL = ["lips", "likp"]


# ---- silver ---------------------------------------------------------------------------------
def _proc_lines(t):
    return erp.procurement_lines(B.ekpo(t), B.ekko(t))


def _order_lines(t):
    return erp.order_lines(B.vbap(t), B.vbak(t))


def _delivery_lines(t):
    return erp.delivery_lines(B.lips(t), B.likp(t))


def _inv_pos(t):
    return erp.inventory_positions(B.mard(t))


@query("procurement_lines", W(PROC, [], SQL_PROC_LINES))
def q_procurement_lines(t):
    """J1 + P1 + P2 + P4."""
    return _proc_lines(t)


@query("order_lines", W(ORD, [], SQL_ORDER_LINES))
def q_order_lines(t):
    """J1 + P1-P5."""
    return _order_lines(t)


@query("delivery_lines", W(DEL, [], SQL_DELIVERY_LINES))
def q_delivery_lines(t):
    """J1 + P6."""
    return _delivery_lines(t)


@query("inventory_positions", W(["mard"], [], SQL_INV_POS))
def q_inventory_positions(t):
    """P7."""
    return _inv_pos(t)


# ---- gold -----------------------------------------------------------------------------------
@query("orders_gold", W(ORD, [("order_lines", SQL_ORDER_LINES)], SQL_ORDERS_GOLD))
def q_orders_gold(t):
    """A1."""
    return erp.orders_gold(_order_lines(t))


@query("procurement_gold", W(PROC, [("proc_lines", SQL_PROC_LINES)], SQL_PROC_GOLD))
def q_procurement_gold(t):
    """A2."""
    return erp.procurement_gold(_proc_lines(t))


@query("inventory_gold", W(["mard"], [("inv_pos", SQL_INV_POS)], SQL_INV_GOLD))
def q_inventory_gold(t):
    """A3."""
    return erp.inventory_gold(_inv_pos(t))


@query(
    "kpi_orders",
    W(ORD, [("order_lines", SQL_ORDER_LINES), ("orders_gold", SQL_ORDERS_GOLD)], SQL_KPI_ORDERS),
)
def q_kpi_orders(t):
    """A4."""
    return erp.kpi_orders(erp.orders_gold(_order_lines(t)))


@query(
    "kpi_procurement",
    W(PROC, [("proc_lines", SQL_PROC_LINES), ("proc_gold", SQL_PROC_GOLD)], SQL_KPI_PROC),
)
def q_kpi_procurement(t):
    """A5."""
    return erp.kpi_procurement(erp.procurement_gold(_proc_lines(t)))


@query("kpi_inventory", W(["mard"], [("inv_pos", SQL_INV_POS), ("inv_gold", SQL_INV_GOLD)], SQL_KPI_INV))
def q_kpi_inventory(t):
    """A6."""
    return erp.kpi_inventory(erp.inventory_gold(_inv_pos(t)))


@query("kpi_delivery", W(DEL, [("delivery", SQL_DELIVERY_LINES)], SQL_KPI_DELIVERY))
def q_kpi_delivery(t):
    """A7 over J1 + P6 (the flagship slice)."""
    return erp.kpi_delivery(_delivery_lines(t))


# ---- dashboard queries ----------------------------------------------------------------------
@query(
    "delivery_status_counts",
    W(DEL, [("delivery", SQL_DELIVERY_LINES)],
      "SELECT coalesce(delivery_status, 'Unknown') AS status, count(*) AS n FROM delivery GROUP BY 1"),
)
def q_delivery_status_counts(t):
    """A19."""
    return erp.status_counts(_delivery_lines(t), "delivery_status")


@query(
    "order_rejection_status_counts",
    W(ORD, [("ol", SQL_ORDER_LINES)],
      "SELECT coalesce(rejection_status, 'Unknown') AS status, count(*) AS n FROM ol GROUP BY 1"),
)
def q_order_rejection_status_counts(t):
    """A19 with NULL -> Unknown actually exercised."""
    return erp.status_counts(_order_lines(t), "rejection_status")


@query(
    "vendor_spend_top10",
    W(PROC, [("proc_lines", SQL_PROC_LINES), ("proc_gold", SQL_PROC_GOLD)],
      """SELECT supplier_number, CAST(sum(CAST(total_net_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_spend_usd,
         count(*) AS po_count FROM proc_gold GROUP BY supplier_number
         ORDER BY total_spend_usd DESC, supplier_number LIMIT 10"""),
)
def q_vendor_spend_top10(t):
    """A20."""
    return erp.vendor_spend_top10(erp.procurement_gold(_proc_lines(t)))


@query(
    "stock_by_plant",
    W(["mard"], [("inv_pos", SQL_INV_POS), ("inv_gold", SQL_INV_GOLD)],
      """SELECT plant, CAST(sum(unrestricted_stock) AS BIGINT) AS unrestricted_stock,
         CAST(sum(total_stock) AS BIGINT) AS total_stock FROM inv_gold GROUP BY plant"""),
)
def q_stock_by_plant(t):
    """A21."""
    return erp.stock_by_plant(erp.inventory_gold(_inv_pos(t)))


@query(
    "carrier_volume",
    W(DEL, [("delivery", SQL_DELIVERY_LINES)],
      """SELECT shipping_carrier, count(DISTINCT delivery_number) AS deliveries,
         CAST(sum(delivered_quantity) AS BIGINT) AS units FROM delivery GROUP BY shipping_carrier"""),
)
def q_carrier_volume(t):
    """A22."""
    return erp.carrier_volume(_delivery_lines(t))


@query(
    "overview_kpis",
    W(ORD + PROC + DEL + ["mard"],
      [("order_lines", SQL_ORDER_LINES), ("orders_gold", SQL_ORDERS_GOLD), ("ko", SQL_KPI_ORDERS),
       ("proc_lines", SQL_PROC_LINES), ("proc_gold", SQL_PROC_GOLD), ("kp", SQL_KPI_PROC),
       ("inv_pos", SQL_INV_POS), ("inv_gold", SQL_INV_GOLD), ("ki", SQL_KPI_INV),
       ("delivery", SQL_DELIVERY_LINES), ("kd", SQL_KPI_DELIVERY)],
      """SELECT ko.total_orders, ko.total_revenue_usd, kp.total_purchase_orders, kp.total_spend_usd,
         ki.total_sku_locations, ki.critical_sku_count, kd.total_deliveries, kd.on_time_delivery_rate_pct
         FROM ko, kp, ki, kd"""),
)
def q_overview_kpis(t):
    """A24."""
    return erp.overview_kpis(
        erp.kpi_orders(erp.orders_gold(_order_lines(t))),
        erp.kpi_procurement(erp.procurement_gold(_proc_lines(t))),
        erp.kpi_inventory(erp.inventory_gold(_inv_pos(t))),
        erp.kpi_delivery(_delivery_lines(t)),
    )


@query(
    "top_orders_by_value",
    W(ORD, [("order_lines", SQL_ORDER_LINES), ("orders_gold", SQL_ORDERS_GOLD)],
      """SELECT sales_order_number, customer_number, total_net_value_usd FROM orders_gold
         ORDER BY total_net_value_usd DESC, sales_order_number LIMIT 100"""),
)
def q_top_orders_by_value(t):
    """S3."""
    return erp.top_orders_by_value(erp.orders_gold(_order_lines(t)))

