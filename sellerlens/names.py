"""Column names of the three input tables and of every report.

FIXED VALUES: these names must equal the marketplace exports and the
report headers users already know, so they are written out plainly and
never derived. Vietnamese names use precomposed (NFC) code points.
"""

# ---- FIXED VALUES: input columns, `orders` (one row per order line) ----
ORDER_ID = "Order ID"
CREATED_TIME = "Created Time"
PAID_TIME = "Paid Time"
RTS_TIME = "RTS Time"
SHIPPED_TIME = "Shipped Time"
DELIVERED_TIME = "Delivered Time"
CANCELLED_TIME = "Cancelled Time"
ORDER_STATUS = "Order Status"
ORDER_SUBSTATUS = "Order Substatus"
RETURN_TYPE = "Cancelation/Return Type"
SELLER_SKU = "Seller SKU"
SKU_ID = "SKU ID"
PRODUCT_NAME = "Product Name"
QUANTITY = "Quantity"
BUYER = "Buyer Username"
PROVINCE = "Province"
COUNTRY = "Country"

# added by clean_orders
SKU_CATEGORY = "SKU Category"
CREATED_TS = "Created_Timestamp"
ORDER_MONTH = "Order_Month"

# ---- FIXED VALUES: input columns, `income` (one row per settlement entry) ----
ADJUSTMENT_ID = "Order/adjustment ID"
RELATED_ORDER_ID = "Related order ID"
TYPE = "Type"
TOTAL_REVENUE = "Total revenue"
TOTAL_FEES = "Total fees"
SETTLEMENT = "Total settlement amount"
SETTLED_TIME = "Order settled time"

# added by classify_income
ABS_FEES = "ABS_Total_Fees"
CLASSIFY = "Classify"
PAYDOUBLE = "Paydouble"
ORDER_TYPE = "Actually Order Type"

# ---- FIXED VALUES: input columns, `overview` (one row per day) ----
DAY = "Ngày"
PAGE_VIEWS = "Lượt xem trang"
STORE_VISITS = "Lượt truy cập trang Cửa hàng"
CONVERSION = "Tỷ lệ chuyển đổi"

# ---- FIXED VALUES: category values used by filters and classification ----
STATUS_COMPLETED = "Completed"
STATUS_CANCELED = "Canceled"
SUBSTATUS_ERROR = "Error Order"
RETURN_REFUND = "Return/Refund"
TYPE_ORDER = "Order"
DUPLICATE, NOT_DUPLICATE = "Duplicate", "Not Duplicate"
YES, NO = "Yes", "No"
NORMAL, COMPENSATION, DOUBLE_PAID = "Normal", "Compensation", "DoublePaid"
ADJUSTMENT_PREFIX = "7"

# ---- FIXED VALUES: report headers ----
N_ORDERS = "Số đơn hàng"
N_CANCELED = "Số đơn huỷ"
N_COMPLETED = "Số đơn thành công"
SUM_QTY = "Tổng số lượng sản phẩm"
COMPLETED_LINES = "Sản phẩm của đơn hoàn thành"
MONTH_VN = "Tháng"
PRODUCT_KIND = "Loại sản phẩm"
TOTAL_QUANTITY = "Total_Quantity"
COMPLETED_ORDERS = "Completed_Orders"
MONTH = "Month"
REVENUE = "Doanh thu"
NET_REVENUE = "Doanh thu thực nhận"
TOTAL_ORDERS = "Total orders"
# the return-share header is spelled with combining grave accents (a + U+0300)
RETURN_RATE = "Tỷ lệ hoa\u0300ng hoa\u0300n"
N_RETURNED = "Số đơn hoàn trả"
N_ERRORS = "Tổng đơn lỗi"
FMT_SUFFIX = "_fmt"
CURRENCY_SUFFIX = " ₫"

# ---- raw column lists ----
ORDER_TEXT_COLUMNS = [
    CREATED_TIME, ORDER_ID, PAID_TIME, RTS_TIME,
    SHIPPED_TIME, DELIVERED_TIME, CANCELLED_TIME,
]
ORDER_COLUMNS = [
    ORDER_ID, CREATED_TIME, PAID_TIME, RTS_TIME, SHIPPED_TIME,
    DELIVERED_TIME, CANCELLED_TIME, ORDER_STATUS, ORDER_SUBSTATUS,
    RETURN_TYPE, SELLER_SKU, SKU_ID, PRODUCT_NAME, QUANTITY, BUYER,
    PROVINCE, COUNTRY,
]
INCOME_COLUMNS = [
    ADJUSTMENT_ID, RELATED_ORDER_ID, TYPE, TOTAL_REVENUE, TOTAL_FEES,
    SETTLEMENT, SETTLED_TIME,
]
OVERVIEW_COLUMNS = [DAY, PAGE_VIEWS, STORE_VISITS, CONVERSION]


def c(name: str):
    """``F.col`` for a literal column name (spaces, ``/``, dots, backticks)."""
    from pyspark.sql import functions as F
    return F.col("`" + name.replace("`", "``") + "`")
