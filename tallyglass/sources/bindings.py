"""The test tables in the shapes the operators take.

``Tables`` reads one folder of parquet files; each method is lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cents(price: Column) -> Column:
    """Price in whole cents, so sums are exact."""
    return F.round(price * 100).cast("bigint")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def order_rows(self) -> DataFrame:
        """Orders with their year and price in cents: several rows per customer and year."""
        return self.orders.select(
            F.col("o_custkey").alias("customer_id"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderkey").alias("order_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
            cents(F.col("o_totalprice")).alias("price_cents"),
        )

    def seasons(self) -> DataFrame:
        """One row per customer and year."""
        return self.order_rows().groupBy("customer_id", "year").agg(
            F.count(F.lit(1)).cast("int").alias("order_count"),
            F.sum("price_cents").alias("spend_cents"),
            F.max("priority").alias("priority"),
            F.max("order_id").alias("last_order_id"),
        )

    def game_details(self) -> DataFrame:
        """Line items as player rows of a game; (game_id, line_id) repeats."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("game_id"),
            F.col("l_linenumber").alias("line_id"),
            F.col("l_partkey").alias("player_id"),
            F.col("l_suppkey").alias("team_id"),
            F.col("l_quantity").cast("bigint").alias("pts"),
            F.col("l_returnflag").alias("start_position"),
            F.col("l_linestatus").alias("line_status"),
            F.to_date("l_shipdate").alias("game_date"),
            cents(F.col("l_extendedprice")).alias("price_cents"),
            cents(F.col("l_discount")).alias("discount_cents"),
            cents(F.col("l_tax")).alias("tax_cents"),
        )

    def games(self) -> DataFrame:
        """Orders as games, with their season."""
        return self.orders.select(F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"))

    def web_events(self) -> DataFrame:
        """Events with a host, and a device numbered by user and JSON property."""
        return self.events.select(
            "event_id",
            "user_id",
            (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("bigint")).alias("device_id"),
            F.col("event_type").alias("host"),
            F.col("ts").alias("event_time"),
        )

    def web_events_with_copies(self) -> DataFrame:
        """Web events, every error event twice."""
        events = self.web_events()
        return events.unionByName(events.filter(F.col("host") == "error"))

    def devices(self) -> DataFrame:
        """Devices seen in the events; browser and system follow from the number, one row per event."""
        return self.web_events().select(
            "device_id",
            F.concat(F.lit("browser"), (F.col("device_id") % 5).cast("string")).alias("browser_type"),
            F.concat(F.lit("os"), (F.col("device_id") % 3).cast("string")).alias("os_type"),
        )

    def matches(self) -> DataFrame:
        """Orders as matches, one row each."""
        return self.orders.select(
            F.col("o_orderkey").alias("match_id"),
            F.col("o_orderpriority").alias("playlist_id"),
            (F.col("o_custkey") % 25).cast("int").alias("mapid"),
        )

    def maps(self) -> DataFrame:
        return self.nation.select(F.col("n_nationkey").alias("mapid"), F.col("n_name").alias("map_name"))

    def medals(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("medal_id"), F.col("p_name").alias("medal_name"))

    def match_details(self) -> DataFrame:
        """Kills per match and player."""
        return self.game_details().groupBy(
            F.col("game_id").alias("match_id"), F.col("team_id").alias("player_id")
        ).agg(F.sum("pts").alias("kills"))

    def match_medals(self) -> DataFrame:
        """Medals per match, player and medal."""
        return self.game_details().groupBy(
            F.col("game_id").alias("match_id"), F.col("team_id").alias("player_id"), F.col("player_id").alias("medal_id")
        ).agg(F.count(F.lit(1)).alias("medal_count"))
