"""Small sales tables from short rows."""

from pyspark.sql import functions as F

TEXT = (
    "doc_no phone customer_name name_check phone_status doc_type brand region store "
    "product_group product_code"
).split()


def sales(spark, rows, *columns):
    """Rows of text or numbers under the given columns, cast to canonical types."""
    kinds = {c: "string" for c in columns}
    plain = spark.createDataFrame(
        [tuple(None if v is None else str(v) for v in r) for r in rows],
        ", ".join(f"{c} string" for c in kinds),
    )
    return plain.select(
        *(
            F.col(c).cast(
                "timestamp_ntz" if c == "order_ts" else "string" if c in TEXT else "decimal(18,4)"
            ).alias(c)
            for c in columns
        )
    )


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]
