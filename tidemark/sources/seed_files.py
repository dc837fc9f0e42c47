"""Reference tables as typed CSV files: written from the simulator, read with their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schema of each seed file, named as in Feeds.
SEEDS = {
    "ref_states": "state string, state_code string, region string, remoteness_tier int",
    "state_aliases": "alias string, state string",
    "ref_hubs": "hub_id string, hub_state string, hub_region string",
    "sale_calendar": "sale_event string, start_date date, end_date date",
}


def load_seeds(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seeds with their types; a line that doesn't fit raises when it is read."""
    reader = {name: spark.read.schema(kinds).option("header", True).option("mode", "FAILFAST") for name, kinds in SEEDS.items()}
    return {name: r.csv(f"{folder.rstrip('/')}/{name}.csv") for name, r in reader.items()}


def alias_table(states: DataFrame, misspelt: DataFrame) -> DataFrame:
    """(alias, state): names, codes and known misspellings, lower-cased and trimmed. An alias that several states claim
    goes to a name before a code before a misspelling, then to the first state by name."""
    parts = [
        states.select(F.col("state").alias("alias"), "state", F.lit(0).alias("rank")),
        states.select(F.col("state_code").alias("alias"), "state", F.lit(1).alias("rank")),
        misspelt.select("alias", "state", F.lit(2).alias("rank")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("alias", F.lower(F.trim("alias")))
    first = F.row_number().over(Window.partitionBy("alias").orderBy("rank", "state"))
    return every.withColumn("first", first).filter("first = 1").select("alias", "state")


def export_seeds(simulator, folder: str) -> None:
    """Writes the files that aren't there yet: seeds belong to the plan and don't change with the days released."""
    tables = {"ref_states": simulator.states, "state_aliases": simulator.aliases(), "ref_hubs": simulator.hubs, "sale_calendar": simulator.sales}
    for name, df in tables.items():
        df.coalesce(1).write.mode("ignore").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")
