"""Declared schemas, so that no scan has to infer one."""

SALES = (
    "date date, store_id string, product_id string, category string, quantity_sold bigint, "
    "unit_price bigint, discount_percent double, revenue double, cost double, profit double"
)
PROMOTIONS = (
    "date date, product_id string, promotion_type string, discount_percent double"
)
STORE_EVENTS = ("store_id string, date date, event_type string, impact double")
CUSTOMER_TRAFFIC = (
    "date date, store_id string, customer_traffic bigint, weather_impact double, "
    "is_holiday boolean"
)
INVENTORY = (
    "date date, store_id string, product_id string, inventory_level bigint, "
    "reorder_point bigint, days_of_supply double"
)
STORES = ("store_id string, location string, size string, base_traffic int")
PRODUCTS = (
    "product_id string, name string, category string, seasonality string, price int, "
    "margin double"
)
REQUESTS = ("store_id string, date string, additional_features map<string,string>")

BY_TYPE = {
    "sales": SALES,
    "promotions": PROMOTIONS,
    "store_events": STORE_EVENTS,
    "customer_traffic": CUSTOMER_TRAFFIC,
    "inventory": INVENTORY,
}
