"""Customer reports: the tagged customer list, first purchases, new and returning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.functions.display import display
from tillview.functions.metrics import (
    discount_from_difference,
    distinct,
    hundredths,
    round_scaled,
    total,
)
from tillview.functions.text import is_option, strip
from tillview.operators.filters import (
    filter_condition,
    resolve_filters,
    selected_values,
    timestamp_literal,
)
from tillview.operators.lookup import look_up
from tillview.schema import (
    POSITION,
    TAG_INACTIVE,
    TAG_REGULAR,
    TAG_VIP,
    TOTAL_LABEL,
    TYPE_NEW,
    TYPE_RETURNING,
    CustomerParams,
    Filters,
    require,
)
from tillview.sources.staging import stage

CUSTOMER_TEXTS = ("customer_name", "name_check", "phone_status")
#: Lines without a document are dealt to so many parts per customer.
PARTS = 256


def first_purchase(df: DataFrame) -> DataFrame:
    """Date of the first purchase per phone over all rows given."""
    require(df, "phone")
    return (
        df.filter(F.col("phone").isNotNull())
        .groupBy("phone")
        .agg(F.min("order_ts").alias("first_date"))
    )


def _customer_type(start) -> Column:
    """Without a start there are no rows to tell apart."""
    is_new = F.col("first_date") >= timestamp_literal(start) if start else F.lit(None).cast("boolean")
    return F.when(is_new, F.lit(TYPE_NEW)).otherwise(F.lit(TYPE_RETURNING))


def join_first_purchase(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Selected rows with the first purchase date of their phone, if any.

    One phone, or no phone at all, may stand on a large share of the rows. Rows without a
    phone have no date and pass no join; a phone with more rows than an even share of a
    partition gets its date from a broadcast of as many rows as there are partitions at most.
    """
    return look_up(rows, first.select("phone", "first_date"), "phone")


def customer_types(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Each phone among the selected rows, with its first purchase and type.

    First purchases look at all rows and the selection is a condition on the row
    alone, so one pass keeps both per phone: nothing is joined, and rows of one
    phone are combined before they move. Rows without a phone form one group
    that has no first purchase and so counts as returning.
    """
    require(df, "phone")
    resolved = resolve_filters(df, filters)
    selected = filter_condition(df, resolved)
    phones = df.groupBy("phone").agg(
        F.min(F.when(F.col("phone").isNotNull(), F.col("order_ts"))).alias("first_date"),
        F.max(F.coalesce(selected, F.lit(False))).alias("selected"),
    )
    return phones.filter("selected").select(
        "phone", "first_date", _customer_type(resolved.start).alias("customer_type")
    )


def new_vs_returning(df: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Customers whose first purchase falls in the selected time, and the others."""
    types = customer_types(df, filters)
    return (
        types.groupBy("customer_type").agg(F.count("phone").alias("customers")).orderBy("customer_type")
    )


def _documents(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Lines combined by customer, document and texts: the only pass over them.

    Texts are grouping keys here, and all that is summed or compared has a fixed size, so lines
    are hashed and never sorted. The lines of a document meet before they are combined, so documents
    need not move again; lines without a document are dealt out by ``part``.
    """
    texts = [c for c in CUSTOMER_TEXTS if c not in keys]
    place = [_packed(F.col(POSITION)).alias("place")] if POSITION in sales.columns else []
    part = F.when(F.col("doc_no").isNull(), F.pmod(F.xxhash64("order_ts", "gross", "net"), F.lit(PARTS)))
    lines = sales.select(*keys, "doc_no", part.alias("part"), *texts, "gross", "net", "order_ts", *place)
    return (
        lines.repartition(*keys, "doc_no", "part")
        .groupBy(*keys, "doc_no", "part", *texts)
        .agg(
            total("gross").alias("gross"),
            total("net").alias("net"),
            F.min("order_ts").alias("first_order"),
            F.max("order_ts").alias("last_order"),
            *(F.min(c).alias(c) for c in ("place",) if place),
        )
    )


def _packed(position: Column) -> Column:
    """A position as one number that orders alike; unlike a struct it is compared in place."""
    file = position["input"].cast("decimal(9,0)") * F.lit("1e10").cast("decimal(11,0)") + position["file"]
    return (file.cast("decimal(19,0)") * F.lit("1e19").cast("decimal(20,0)") + position["row"]).cast("decimal(38,0)")


def _group_customers(sales: DataFrame, params: CustomerParams) -> DataFrame:
    """One row per customer, with what the list must know of all rows, written down once.

    Rows without a phone or store belong to no customer but count for the latest order and the
    checks present, so they are grouped too. First values that are not null are taken in
    input order where rows have a position, else by time, document and value. Lines and customers
    are shuffled once each: a document is whole in one task before its customer's are brought together.
    """
    keys = ["phone", "store"] if params.per_store else ["phone"]
    require(sales, *keys, "gross", "net", "doc_no", *CUSTOMER_TEXTS)
    lines = _documents(sales, keys)
    order = ["place"] if "place" in lines.columns else ["first_order", "doc_no"]

    def present(name: str) -> Column:
        """A value with its place, if it has both."""
        found = F.col(name).isNotNull()
        if "place" in order:
            found &= F.col("place").isNotNull()
        return F.when(found, F.struct(*order, name))

    check = F.col("name_check")
    chosen = selected_values(params.name_check)
    documents = lines.groupBy(*keys, "doc_no", "part").agg(
        *(F.min(present(c)).alias(c) for c in CUSTOMER_TEXTS),
        total("gross").alias("gross"),
        total("net").alias("net"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.max(check.isNotNull()).alias("any_check"),
        F.max(strip(check).isin(chosen) if chosen else F.lit(False)).alias("chosen_check"),
    )
    grouped = documents.groupBy(*keys).agg(
        *(F.min(c)[c].alias(c) for c in ("customer_name", "name_check")),
        total("gross").alias("gross"),
        total("net").alias("net"),
        F.count("doc_no").alias("orders"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.min("phone_status")["phone_status"].alias("phone_status"),
        F.max("any_check").alias("any_check"),
        F.max("chosen_check").alias("chosen_check"),
    )
    return stage(grouped, "customers")


def _known(grouped: DataFrame, params: CustomerParams) -> DataFrame:
    keys = ["phone", "store"] if params.per_store else ["phone"]
    known = grouped.drop("any_check", "chosen_check")
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    return known


def _tag_customers(customers: DataFrame, latest: Column, params: CustomerParams) -> DataFrame:
    """Discount, idle time and tag; idle time counts whole 24-hour days up to ``latest``."""
    idle = F.extract(F.lit("DAY"), latest - F.col("last_order")).cast("int")
    gross, net = F.col("gross").cast("double"), F.col("net").cast("double")
    tag = (
        F.when(F.col("days_inactive") >= params.inactive_days, F.lit(TAG_INACTIVE))
        .when(F.col("net") >= params.vip_net, F.lit(TAG_VIP))
        .otherwise(F.lit(TAG_REGULAR))
    )
    return (
        customers.filter(F.col("net") >= params.min_net)
        .withColumns(
            {
                "discount_pct": round_scaled(discount_from_difference(gross, net)),
                "days_inactive": idle,
            }
        )
        .withColumn("tag", tag)
        .withColumn("days_without_order", F.when(F.col("tag") == TAG_INACTIVE, F.col("days_inactive")))
    )


def build_customers(sales: DataFrame, params: CustomerParams = CustomerParams()) -> DataFrame:
    """One row per phone, or per phone and store, tagged and above the minimum net.

    The customers are written down, which reads the sales once; the result reads them.
    """
    grouped = _group_customers(sales, params)
    return _tag_customers(_known(grouped, params), _latest(grouped), params)


def _latest(grouped: DataFrame) -> Column:
    return timestamp_literal(grouped.agg(F.max("last_order")).first()[0])


def _keeps(name: str, values, any_option: bool, any_chosen: bool) -> Column:
    """Condition on a list by one of its columns.

    Chosen values that are options are kept; if none is, every option is; without any option
    there is no filter.
    """
    if not any_option:
        return F.lit(True)
    return F.col(name).isin(selected_values(values)) if any_chosen else is_option(F.col(name))


def _listed(sales: DataFrame, params: CustomerParams) -> DataFrame:
    """The customer list before sorting. Options and the latest order are one row over the customers."""
    grouped = _group_customers(sales, params)
    status, chosen = F.col("phone_status"), selected_values(params.phone_status)
    listable = F.col("phone").isNotNull() & (F.col("net") >= params.min_net)
    if params.per_store:
        listable &= F.col("store").isNotNull()
    facts = grouped.agg(
        F.max("last_order").alias("latest"),
        F.max("any_check").alias("any_check"),
        F.max("chosen_check").alias("chosen_check"),
        F.max(listable & status.isNotNull()).alias("any_status"),
        F.max(listable & strip(status).isin(chosen) if chosen else F.lit(False)).alias("chosen_status"),
    ).first()
    built = _tag_customers(_known(grouped, params), timestamp_literal(facts["latest"]), params)
    shown = (
        (params.show_inactive, TAG_INACTIVE),
        (params.show_vip, TAG_VIP),
        (params.show_regular, TAG_REGULAR),
    )
    tags = [tag for wanted, tag in shown if wanted]
    listed = built.filter(F.col("tag").isin(tags)) if tags else built
    listed = listed.filter(_keeps("phone_status", params.phone_status, facts["any_status"], facts["chosen_status"]))
    return listed.filter(_keeps("name_check", params.name_check, facts["any_check"], facts["chosen_check"]))


def _output(listed: DataFrame) -> DataFrame:
    return listed.withColumns({c: F.col(c).cast("double") for c in ("gross", "net")})


def _order(params: CustomerParams) -> list[Column]:
    by = F.col(params.sort_by)
    first = by.asc_nulls_last() if params.ascending else by.desc_nulls_last()
    ties = ["phone", "store"] if params.per_store else ["phone"]
    return [first, *(F.col(c) for c in ties if c != params.sort_by)]


def customer_list(sales: DataFrame, params: CustomerParams = CustomerParams()) -> DataFrame:
    """Customers with the chosen tags, phone status and name check, sorted."""
    return _output(_listed(sales, params)).orderBy(*_order(params))


def customer_count(customers: DataFrame) -> DataFrame:
    """Distinct customers in a list."""
    return customers.agg(distinct("phone", "customers"))


def customer_list_with_total(sales: DataFrame, params: CustomerParams = CustomerParams()) -> DataFrame:
    """The sorted list followed by its total row.

    The total sums amounts and orders and takes the plain mean of the discounts,
    from hundredths so that it does not depend on the order of rows.
    """
    listed = _listed(sales, params)
    mean = F.try_divide(F.sum(hundredths(F.col("discount_pct"))), F.count("discount_pct")) / 100
    summed = listed.agg(
        total("gross").alias("gross"),
        total("net").alias("net"),
        total("orders").cast("long").alias("orders"),
        mean.alias("discount_pct"),
    )
    texts = {"phone": TOTAL_LABEL}
    total_row = summed.select(
        *(
            F.col(c)
            if c in summed.columns
            else F.lit(texts.get(c, "")).alias(c)
            if kind == "string"
            else F.lit(None).cast(kind).alias(c)
            for c, kind in listed.dtypes
        )
    )
    rows = listed.withColumn("row_kind", F.lit("customer")).unionByName(
        total_row.withColumn("row_kind", F.lit("total"))
    )
    return _output(rows).orderBy("row_kind", *_order(params))


def customer_columns(per_store: bool = True) -> list[str]:
    """Columns of the displayed list, in order."""
    return [
        "phone",
        *(["store"] if per_store else []),
        "customer_name",
        "tag",
        "gross",
        "net",
        "discount_pct",
        "orders",
        "days_without_order",
        "last_order",
    ]


def customer_display(customers: DataFrame, per_store: bool = True) -> DataFrame:
    """The displayed columns as text, ready for export."""
    return display(
        customers.select(*customer_columns(per_store)),
        integers=["gross", "net", "orders", "days_without_order"],
        percents=["discount_pct"],
        dates=["last_order"],
    )
