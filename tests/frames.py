"""Hand-made canonical transaction frames for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

TX_SCHEMA = (
    "customer_id bigint, order_id bigint, order_number bigint, order_date date, order_sequence bigint, "
    "brand_id bigint, brand_key bigint, brand_name string, category string, product_id bigint, "
    "product_title string, units bigint, gross_revenue decimal(20,4), business_unit string, "
    "country_group string, region string, site_id int, site string, payment_status string, "
    "is_gift boolean, is_gwp boolean, is_new_brand boolean, order_month int"
)

D = dt.date


def line(customer, order, day, brand=1, category="Hair", product=1, units=1, revenue="10.00", seq=None,
         unit="CORE", country="EU", paid=True, gift=False, site_id=37, new=False):
    return (
        customer, order, order, day, seq if seq is not None else order, brand, brand, f"Brand#{brand}",
        category, product, f"title {product}", units, Decimal(revenue), unit, country, "R1", site_id,
        "CORE", "Paid" if paid else "Pending", gift, gift, new, day.year * 100 + day.month,
    )


def tx(spark, rows):
    return spark.createDataFrame(rows, TX_SCHEMA)
