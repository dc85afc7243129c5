from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from orderwatch.session import build_session  # noqa: E402
from orderwatch.sources.marketplace import load_marketplace  # noqa: E402

# An invented marketplace; only file and column names are those of the public data set.
# o1 is late on its due day, o2 by 8 days with two sellers and two reviews, o3 by 16 days;
# o4 is canceled, o5 is on its way and unpaid, o6 and o7 are early.
FILES = {
    "olist_customers_dataset.csv": """customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state
k1,h1,80010,Curitiba,PR
k2,h2,50030,Recife,PE
k3,h3,69005,Manaus,AM
k4,h4,60025,Fortaleza,CE
k5,h5,90010,Porto Alegre,RS
""",
    "olist_orders_dataset.csv": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,k1,delivered,2023-03-02 08:15:00,2023-03-02 09:40:00,2023-03-03 07:30:00,2023-03-09 18:30:00,2023-03-09 00:00:00
o2,k2,delivered,2023-03-06 21:05:00,2023-03-07 06:00:00,2023-03-10 12:00:00,2023-03-24 09:20:00,2023-03-16 00:00:00
o3,k3,delivered,2023-03-07 13:45:00,2023-03-07 14:00:00,2023-03-15 15:00:00,2023-04-05 11:10:00,2023-03-20 00:00:00
o4,k4,canceled,2023-03-10 17:20:00,soon,,,2023-03-28 00:00:00
o5,k5,shipped,2023-03-12 05:55:00,2023-03-12 08:00:00,2023-03-14 10:00:00,,2023-04-01 00:00:00
o6,k1,delivered,2023-03-15 19:30:00,2023-03-15 20:00:00,2023-03-16 08:00:00,2023-03-18 10:45:00,2023-03-27 00:00:00
o7,k2,delivered,2023-03-21 23:50:00,2023-03-22 07:00:00,2023-03-23 09:00:00,2023-03-30 16:00:00,2023-04-02 00:00:00
""",
    "olist_order_items_dataset.csv": """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
o1,1,lamp,S1,2023-03-05 00:00:00,60.00,12.00
o2,1,drill,S2,2023-03-09 00:00:00,320.00,16.00
o2,2,lamp,S1,2023-03-09 00:00:00,62.00,9.30
o3,1,rug,S3,2023-03-11 00:00:00,700.00,140.00
o4,1,saw,S4,2023-03-14 00:00:00,250.00,20.00
o5,1,stool,S2,2023-03-16 00:00:00,40.00,10.00
o6,1,drill,S2,2023-03-18 00:00:00,300.00,30.00
o6,2,stool,S3,2023-03-18 00:00:00,45.00,9.00
o7,1,saw,S4,2023-03-25 00:00:00,240.00,24.00
""",
    "olist_order_payments_dataset.csv": """order_id,payment_sequential,payment_type,payment_installments,payment_value
o1,1,boleto,1,72.00
o2,1,voucher,1,107.30
o2,2,credit_card,4,300.00
o3,1,credit_card,8,840.00
o4,1,boleto,1,270.00
o6,1,debit_card,1,384.00
o7,1,credit_card,2,264.00
""",
    "olist_order_reviews_dataset.csv": """review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp
v1,o1,5,Lovely,"warm light,
easy to mount",2023-03-11 00:00:00,2023-03-12 00:00:00
v2,o2,3,,,2023-03-20 00:00:00,2023-03-20 00:00:00
v3,o2,2,Waiting,"so ""express"" was slow",2023-03-26 00:00:00,2023-03-29 00:00:00
v4,o3,1,Torn,the rug is broken at one edge,2023-04-06 00:00:00,2023-04-08 00:00:00
v5,o6,4,,,2023-03-20 00:00:00,2023-03-20 00:00:00
v6,o7,5,,cuts well,2023-04-01 00:00:00,2023-04-02 00:00:00
""",
    "olist_products_dataset.csv": """product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm
lamp,lighting,24,310,3,1200,20,45,20
drill,tools,31,540,5,2600,30,25,9
rug,textiles,18,150,1,5400,160,4,40
saw,tools,27,420,2,3100,60,12,15
stool,seating,22,205,4,4300,35,50,35
""",
    "olist_sellers_dataset.csv": """seller_id,seller_zip_code_prefix,seller_city,seller_state
S1,13010,Campinas,SP
S2,89201,Joinville,SC
S3,74003,Goiania,GO
S4,29010,Vitoria,ES
""",
}


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def csv_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="session")
def tables(spark, csv_folder):
    return load_marketplace(spark, csv_folder)


@pytest.fixture(scope="session")
def star_folder():
    return "/root/testdata/sf0.001"


def rows(df, *key):
    """Rows as dicts by key columns."""
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r.asDict(recursive=True) for r in df.collect()}
