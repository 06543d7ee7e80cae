"""Declared schemas of the source tables (never inferred).

Restaurant tables are typed; HR landing tables keep dates and ids as
strings and are typed in staging; retail tables follow the CSV exports.
Money is DECIMAL, rates DECIMAL, flags as delivered.
"""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.BooleanType()
MONEY = T.DecimalType(18, 4)
RATE = T.DecimalType(9, 4)


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SALES_TRANSACTIONS = _st(
    ("order_id", _L), ("reservation_id", _L), ("date", _D), ("day_of_week", _S), ("service", _S),
    ("hour", _I), ("table_num", _I), ("party_size", _I), ("category", _S), ("item", _S),
    ("unit_price", MONEY), ("qty", _I), ("discount_pct", RATE), ("line_total", MONEY),
    ("is_alcohol", _S), ("server_id", _S), ("res_type", _S))

RESERVATIONS = _st(
    ("reservation_id", _L), ("date", _D), ("service", _S), ("table_num", _I), ("party_size", _I),
    ("server_id", _S), ("res_type", _S), ("hour", _I))

INVENTORY_PURCHASES = _st(
    ("purchase_id", _L), ("date", _D), ("ingredient_category", _S), ("supplier", _S), ("qty", _I),
    ("unit", _S), ("unit_cost", MONEY), ("total_cost", MONEY))

LABOR_HOURS = _st(
    ("shift_id", _L), ("date", _D), ("employee_id", _S), ("employee_name", _S), ("role", _S),
    ("hours_worked", T.DecimalType(9, 2)), ("hourly_rate", MONEY), ("labor_cost", MONEY))

GUEST_PROFILES = _st(
    ("guest_id", _S), ("first_visit_date", _D), ("total_visits", _I), ("avg_check", T.DecimalType(18, 2)),
    ("lifetime_value", T.DecimalType(18, 2)), ("segment", _S), ("satisfaction", T.DecimalType(9, 2)),
    ("preferred_course", _S), ("town", _S))

MENU_DIM = _st(
    ("item_id", _S), ("category", _S), ("item", _S), ("price", T.DecimalType(18, 2)), ("cogs_pct", RATE),
    ("gross_margin_pct", RATE), ("is_alcohol", _B), ("launch_year", _I))

STAFF_DIM = _st(
    ("employee_id", _S), ("name", _S), ("role", _S), ("base_hourly_rate", T.DecimalType(9, 2)), ("hire_date", _D))

# HR landing tables: everything that can be malformed stays a string.
RAW_EMPLOYEES = _st(
    ("employee_id", _L), ("name", _S), ("role", _S), ("department", _S), ("hire_date", _S),
    ("termination_date", _S), ("termination_type", _S), ("hourly_rate", T.DoubleType()),
    ("manager_id", _S), ("status", _S))

RAW_EXIT_RECORDS = _st(
    ("employee_id", _L), ("exit_date", _S), ("exit_reason", _S), ("exit_survey_score", _I),
    ("eligible_for_rehire", _S), ("manager_id", _S))

RAW_ATTENDANCE_MONTHLY = _st(
    ("employee_id", _L), ("month", _S), ("days_worked", _I), ("days_absent", _I),
    ("overtime_hours", _I), ("late_arrivals", _I))

RAW_PERFORMANCE_REVIEWS = _st(
    ("employee_id", _L), ("review_period", _S), ("score", T.DoubleType()), ("promoted", _S),
    ("manager_notes_tag", _S))



def as_strings(schema: T.StructType) -> T.StructType:
    """The same columns as delivered text: a landing that rejects no value;
    staging types them."""
    return T.StructType([T.StructField(f.name, _S, True) for f in schema.fields])


# Retail exports.
STORE_INVENTORY = _st(
    ("store_id", _S), ("store_name", _S), ("borough", _S), ("owner", _S), ("category", _S), ("product", _S),
    ("units_in_stock", _I), ("reorder_threshold", _I), ("unit_cost", T.DecimalType(18, 2)),
    ("stock_value", T.DecimalType(18, 2)), ("status", _S))

STORE_EXPENSES = _st(
    ("store_id", _S), ("store_name", _S), ("borough", _S), ("owner", _S), ("year", _I), ("month", _I),
    ("month_name", _S), ("rent", _L), ("labor", _L), ("utilities", _L), ("misc_expenses", _L),
    ("total_expenses", _L))

RAW_TABLES = {
    "sales_transactions": SALES_TRANSACTIONS, "reservations": RESERVATIONS,
    "inventory_purchases": INVENTORY_PURCHASES, "labor_hours": LABOR_HOURS,
    "guest_profiles": GUEST_PROFILES, "menu_dim": MENU_DIM, "staff_dim": STAFF_DIM,
    "employees": RAW_EMPLOYEES, "exit_records": RAW_EXIT_RECORDS,
    "attendance_monthly": RAW_ATTENDANCE_MONTHLY, "performance_reviews": RAW_PERFORMANCE_REVIEWS,
    "store_inventory": STORE_INVENTORY, "store_expenses": STORE_EXPENSES,
}


# Driver test tables (read with these schemas, never inferred).
_NTZ, _DBL = T.TimestampNTZType(), T.DoubleType()
TEST_TABLES = {
    "region": _st(("r_regionkey", _I), ("r_name", _S)),
    "nation": _st(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _st(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _DBL), ("c_mktsegment", _S)),
    "supplier": _st(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _DBL)),
    "part": _st(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
                ("p_retailprice", _DBL)),
    "orders": _st(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _DBL),
                  ("o_orderdate", _NTZ), ("o_orderpriority", _S)),
    "lineitem": _st(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                    ("l_quantity", _DBL), ("l_extendedprice", _DBL), ("l_discount", _DBL), ("l_tax", _DBL),
                    ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _NTZ)),
    "events": _st(("event_id", _L), ("ts", _NTZ), ("user_id", _L), ("event_type", _S), ("value", _DBL),
                  ("props", _S)),
}
