"""Listing, observation and run views over the star-schema tables of the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTINGS_AS_OF = "2001-08-01 00:00:00"
LOG_AS_OF = "2024-01-31 00:00:00"


def as_of(text: str):
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def listing_view(spark: SparkSession, root: str) -> DataFrame:
    """Orders seen as listings; customers as premises; nations as districts."""
    k = F.col("o_orderkey")
    nation = F.broadcast(table(spark, root, "nation").select("n_nationkey", "n_name"))  # 25 rows
    customer = table(spark, root, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = (
        table(spark, root, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    price = F.when(k % 31 != 0, F.col("o_totalprice"))
    area = F.when(k % 17 != 0, (20 + k % 280).cast("double"))
    seen = F.col("o_orderdate").cast("timestamp")
    last = F.timestamp_add("DAY", (k % 120).cast("int"), seen)
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "relisted").otherwise("vanished")
    sale = k % 2 == 0
    types = F.array(*[F.lit(t) for t in ("office", "retail", "showroom", "business_center", "warehouse", "free_purpose")])
    return rows.select(
        k.alias("listing_id"),
        F.col("o_custkey").alias("property_id"),
        F.col("o_custkey").cast("string").alias("property_key"),
        F.col("o_orderpriority").alias("source"),
        k.cast("string").alias("external_id"),
        F.concat(F.lit("https://site.example/item/"), k.cast("string")).alias("url"),
        F.when(sale, "sale").otherwise("rent").alias("deal_type"),
        F.concat(F.lit("Lot "), F.col("c_name")).alias("title"),
        F.when(k % 9 == 0, F.concat(F.lit("NOI "), (1000 + k % 500).cast("string"), F.lit(", cap rate "),
                                    (k % 12 + 1).cast("string"), F.lit("%"))).alias("description"),
        F.element_at(types, (k % 6 + 1).cast("int")).alias("property_type"),
        price.alias("price"),
        F.when(k % 3 == 0, "USD").when(k % 3 == 1, "UAH").otherwise("EUR").alias("currency"),
        F.when(k % 4 == 1, price).when(k % 4 == 2, F.round(price / area, 4)).when(k % 4 == 3, F.round(price / 100, 2)).alias("price_per_sqm"),
        area.alias("area_sqm"),
        (k % 9).cast("int").alias("floor"),
        F.concat(F.col("n_name"), F.lit(" street "), (k % 100).cast("string")).alias("address_raw"),
        F.when(k % 19 != 0, F.col("n_name")).alias("district"),
        F.when(k % 7 != 0, "Kyiv").otherwise("Elsewhere").alias("city"),
        F.when(k % 5 != 0, F.concat(F.lit("+38050"), F.lpad((F.col("o_custkey") % 10000000).cast("string"), 7, "0"))).alias("phone"),
        F.when(k % 3 != 1, F.col("c_mktsegment")).alias("agency"),
        F.when(k % 11 == 0, "sold").when(k % 13 == 0, "rented").when(k % 37 == 0, "inactive_404").alias("source_status_raw"),
        status.alias("status"),
        seen.alias("first_seen_at"),
        last.alias("last_seen_at"),
        F.when(status == "vanished", last).alias("vanished_at"),
        F.when(k % 23 == 0, 2).otherwise(0).cast("int").alias("price_drop_count"),
        (k % 29 == 0).alias("exclude_from_stats"),
        F.when(~sale, F.when(k % 8 == 1, "with").when(k % 8 == 3, "without").otherwise("unknown")).alias("opex"),
    )


def market_view(spark: SparkSession, root: str) -> DataFrame:
    """Listings with the prepared district and city membership of market reports."""
    return listing_view(spark, root).withColumns({
        "district_norm": F.col("district"),
        "in_city": (F.col("city") == "Kyiv") | F.col("district").isNotNull(),
    })


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, root, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)


def observation_view(spark: SparkSession, root: str, events: DataFrame | None = None) -> DataFrame:
    """The event stream seen as an observation log: one listing per (type, user)."""
    e, u = F.col("event_id"), F.col("user_id")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    nation = F.broadcast(table(spark, root, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("_nation"), F.col("n_name").alias("district")))  # 25 rows
    rows = (table(spark, root, "events") if events is None else events).select(
        F.col("event_type").alias("source"),
        u.cast("string").alias("external_id"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        e.alias("seq"),
        u.cast("string").alias("property_key"),
        F.when(u % 2 == 0, "sale").otherwise("rent").alias("deal_type"),
        F.concat(F.lit("https://site.example/item/"), u.cast("string")).alias("url"),
        F.when(e % 13 != 0, F.col("value")).alias("price"),
        F.lit("USD").alias("currency"),
        F.when(k % 6 != 0, F.concat(F.lit("T"), (k % 4).cast("string"))).alias("title"),
        (20 + u % 280).cast("double").alias("area_sqm"),
        F.when(k % 7 == 0, F.concat(F.lit("D"), (k % 3).cast("string"))).alias("description"),
        F.when(k % 5 == 0, F.concat(F.lit("050"), F.lpad(u.cast("string"), 7, "0"))).alias("phone"),
        F.when(k % 20 == 0, "sold").when(k % 20 == 1, "inactive").when(k % 20 < 5, "active").alias("source_status_raw"),
        (u % 25).alias("_nation"),
    )
    return rows.join(nation, "_nation").drop("_nation")
