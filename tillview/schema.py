"""Column names, column types and report parameters.

Every report reads one table of receipt lines under the canonical names
below. ``SOURCE_NAMES`` maps each canonical name to the name it has in the
input files.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Column names of the input files.
SOURCE_NAMES = {
    "order_ts": "Ngày",
    "doc_no": "Số_CT",
    "phone": "Số_điện_thoại",
    "customer_name": "tên_KH",
    "name_check": "Kiểm_tra_tên",
    "phone_status": "Trạng_thái_số_điện_thoại",
    "gross": "Tổng_Gross",
    "net": "Tổng_Net",
    "doc_type": "LoaiCT",
    "brand": "Brand",
    "region": "Region",
    "store": "Điểm_mua_hàng",
    "product_group": "Nhóm_hàng",
    "product_code": "Mã_NB",
    "quantity": "Số_lượng",
}

MONEY_COLUMNS = ("gross", "net", "quantity")
TEXT_COLUMNS = tuple(c for c in SOURCE_NAMES if c != "order_ts" and c not in MONEY_COLUMNS)
# Sums need ten more digits, and 38 are all there are.
MONEY_PRECISION, MONEY_SCALE = 28, 4
MONEY_TYPE = f"decimal({MONEY_PRECISION},{MONEY_SCALE})"

# Position of a row in its input, present on tables read from files.
POSITION = "source_position"

# Labels that appear in results.
ALL = "All"
WEEK_WORD = "Tuần"
TAG_INACTIVE = "KH Inactive"
TAG_VIP = "KH VIP"
TAG_REGULAR = "Khách hàng"
TYPE_NEW = "KH mới"
TYPE_RETURNING = "KH quay lại"
TOTAL_LABEL = "TỔNG"
GRAND_TOTAL_LABEL = "Grand Total"

GRAINS = ("day", "week", "month", "quarter", "year")

# First weekday names and numbers, Monday is 0.
WEEKDAYS = {
    "Thứ 2": 0,
    "Thứ 3": 1,
    "Thứ 4": 2,
    "Thứ 5": 3,
    "Thứ 6": 4,
    "Thứ 7": 5,
    "Chủ nhật": 6,
}

OVERVIEW_DIMENSIONS = ("doc_type", "brand", "region", "store")
REVENUE_DIMENSIONS = OVERVIEW_DIMENSIONS + ("phone_status", "name_check")

# A dimension's options are those found under the selection of its parents.
PARENTS = {"region": ("brand",), "store": ("brand", "region")}


@dataclass(frozen=True)
class Filters:
    """Selection of rows. An empty tuple means "All" for that dimension.

    ``dimensions`` names the columns the selection covers; a column the table
    lacks is left out of it.
    """

    start: date | None = None
    end: date | None = None
    end_inclusive_day: bool = False
    doc_type: tuple[str, ...] = ()
    brand: tuple[str, ...] = ()
    region: tuple[str, ...] = ()
    store: tuple[str, ...] = ()
    phone_status: tuple[str, ...] = ()
    name_check: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = OVERVIEW_DIMENSIONS


@dataclass(frozen=True)
class Period:
    """How time is cut. ``week_start`` is the first weekday, Monday is 0."""

    grain: str = "day"
    week_start: int = 0

    def __post_init__(self):
        if self.grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}, got {self.grain!r}")
        if self.week_start not in range(7):
            raise ValueError(f"week_start must be 0..6, got {self.week_start!r}")


@dataclass(frozen=True)
class ProductParams:
    """Product report: chosen groups and codes, empty means no filter."""

    product_group: tuple[str, ...] = ()
    product_code: tuple[str, ...] = ()


@dataclass(frozen=True)
class CustomerParams:
    """Customer list: tags, filters on the list, and its order."""

    per_store: bool = True
    inactive_days: int = 90
    vip_net: int = 300_000_000
    min_net: int = 0
    show_inactive: bool = False
    show_vip: bool = False
    show_regular: bool = True
    phone_status: tuple[str, ...] = ()
    name_check: tuple[str, ...] = ()
    sort_by: str = "net"
    ascending: bool = False


@dataclass(frozen=True)
class ParetoParams:
    """Best or worst share of each store's customers by net."""

    percent: int = 20
    top: bool = True
    stores: tuple[str, ...] = ()


@dataclass(frozen=True)
class CohortParams:
    """Retention after 1 to ``months`` months."""

    months: int = 7


def require(df, *columns: str) -> None:
    """Raise when a report needs a column the table does not have."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the sales table lacks {', '.join(missing)}")
