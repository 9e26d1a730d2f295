"""CSV ingest (typed, FAILFAST), Parquet round trip and export audit."""

import os
import tempfile

import pytest

from repeatlens.plans import kpis
from repeatlens.sources.csv_source import ingest_to_parquet, read_marketplace_csv, read_marketplace_parquet
from repeatlens.sources.schemas import CSV_FILES
from repeatlens.sources.sinks import export_tables
from tests.builders import SCOPE

RAW = {
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
              "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
              "o1,c1,delivered,2017-02-01 10:00:00,2017-02-01 11:00:00,2017-02-02 10:00:00,"
              "2017-02-10 10:00:00,2017-02-20 00:00:00\n"
              "o2,c2,delivered,2017-03-01 10:00:00,,,2017-03-05 10:00:00,2017-03-20 00:00:00\n"
              "o3,c3,canceled,2017-03-02 10:00:00,,,,2017-03-20 00:00:00\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
                   "o1,1,p1,s1,2017-02-05 00:00:00,10.50,2.25\no1,2,p2,s1,2017-02-05 00:00:00,4.50,1.00\n"
                   "o2,1,p1,s2,2017-03-05 00:00:00,20.00,3.10\no3,1,p1,s2,2017-03-05 00:00:00,99.00,1.00\n",
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 "c1,u1,01000,sao paulo,SP\nc2,u1,01000,sao paulo,SP\nc3,u2,20000,rio,RJ\n",
    "order_payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                      "o1,1,credit_card,2,15.00\no2,1,boleto,1,20.00\n",
    "order_reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message,"
                     "review_creation_date,review_answer_timestamp\n"
                     "r1,o1,5,,\"great, fast\",2017-02-11 00:00:00,2017-02-12 00:00:00\n",
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,"
                "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
                "p1,cat_x,10,100,1,100,10,10,10\np2,,,,,,,,\n",
    "category_translation": "product_category_name,product_category_name_english\ncat_x,cat_x_en\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,sao paulo,SP\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,"
                   "geolocation_state\n01000,-23.5,-46.6,sao paulo,SP\n",
}


@pytest.fixture(scope="module")
def raw_dir():
    d = tempfile.mkdtemp(prefix="repeatlens-raw-")
    for name, text in RAW.items():
        with open(os.path.join(d, CSV_FILES[name]), "w") as fh:
            fh.write(text)
    return d


def test_csv_read_and_kpis(spark, raw_dir):
    mp = read_marketplace_csv(spark, raw_dir)
    k = kpis.exec_kpis(mp, SCOPE).collect()[0]
    assert (k.total_orders, k.total_customers, k.total_revenue, k.total_freight) == (2, 1, 35.0, 6.35)
    assert str(mp.orders.schema["order_purchase_timestamp"].dataType) == "TimestampNTZType()"


def test_ingest_audit_and_parquet_round_trip(spark, raw_dir):
    out = tempfile.mkdtemp(prefix="repeatlens-pq-")
    audit = {r.table: r.rows for r in ingest_to_parquet(spark, raw_dir, out).collect()}
    assert audit["orders"] == 3 and audit["order_items"] == 4 and audit["geolocation"] == 1
    mp = read_marketplace_parquet(spark, out)
    assert kpis.exec_kpis(mp, SCOPE).collect()[0].total_revenue == 35.0


def test_failfast_on_bad_row(spark, raw_dir):
    from repeatlens.sources.csv_source import read_csv_table

    bad = tempfile.mkdtemp(prefix="repeatlens-bad-")
    with open(os.path.join(bad, "items.csv"), "w") as fh:
        fh.write(RAW["order_items"] + "o9,notanumber,p1,s1,2017-01-01 00:00:00,1.00,1.00\n")
    with pytest.raises(Exception):
        read_csv_table(spark, os.path.join(bad, "items.csv"), "order_items").collect()


def test_export_tables_read_back(spark, raw_dir):
    mp = read_marketplace_csv(spark, raw_dir)
    out = tempfile.mkdtemp(prefix="repeatlens-export-")
    res = export_tables(spark, mp, out, fmt="csv").collect()
    assert len(res) == 7 and all(r.ok for r in res)
