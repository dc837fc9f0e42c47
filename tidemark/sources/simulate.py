"""A seeded order-fulfilment simulator: every draw is a hash of the seed and a key, so feeds are the same on every run
and each is made in parallel, without state."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.seeds import HUBS, METHODS, sale_calendar
from tidemark.sources.loader import write_daily
from tidemark.sources.seed_files import alias_table

#: An invented country: regions and their states as (name, remoteness tier, x and y in units of 100 km).
REGIONS = {
    "North": (("Northmark", 1, 4.0, 9.0), ("Hillford", 2, 6.5, 8.2), ("Snowdale", 3, 5.1, 11.6)),
    "South": (("Southport", 1, 4.4, 0.8), ("Palmcoast", 2, 2.9, 1.9)),
    "East": (("Eastbridge", 1, 8.7, 4.9), ("Marshland", 3, 10.8, 6.3)),
    "West": (("Westfield", 1, 0.9, 5.2), ("Sandvale", 2, 0.2, 7.4)),
}
#: Couriers as (name, extra hours, share of parcels that are held up on the way).
COURIERS = (("Swift", 0, 0.03), ("Steady", 10, 0.01), ("Budget", 30, 0.14), ("Regional", 20, 0.08), ("Metro", 6, 0.05))
CATEGORIES = ("Fashion", "Electronics", "Home", "Beauty", "Books", "Sports")
UPLIFT = {"Harvest Sale": 2.7, "Year-End Rush": 2.1, "Midyear Days": 1.9, "Spring Fair": 1.6, "Clearance Week": 1.4}


#: Ways to misspell a name: a letter left out, a letter doubled, two words run together with a hyphen.
MISSPELLINGS = (
    lambda s: F.concat(F.substring(s, 1, 2), F.substring(s, 4, 100)),
    lambda s: F.concat(F.substring(s, 1, 3), F.substring(s, 3, 100)),
    lambda s: F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 100)),
)
#: How the rows of each extract are ordered.
ORDER = {"orders": ("updated_at", "order_id"), "order_items": ("order_id", "order_item_seq"), "payments": ("created_at", "payment_id"), "customers": ("updated_at", "customer_id")}


@dataclass(frozen=True)
class Plan:
    """Sizes and rates of a simulation; the period is a year and a half."""

    start: date = date(2024, 1, 1)
    end: date = date(2025, 6, 30)
    orders_per_day: float = 140
    growth: float = 0.3
    seed: int = 11
    customers: int = 24_000
    products: int = 3_000
    sellers: int = 150
    late: float = 0.025
    duplicates: float = 0.006
    skewed: float = 0.004
    dirty: float = 0.05
    moves: float = 0.04
    no_pincode: float = 0.015


class Simulator:
    def __init__(self, spark: SparkSession, plan: Plan = Plan()):
        self.spark, self.plan = spark, plan
        self.places = [(s, f"S{i:02d}", r, t, x, y) for i, (s, r, t, x, y) in enumerate((s, r, t, x, y) for r, many in REGIONS.items() for s, t, x, y in many)]
        self.states = spark.createDataFrame([p[:4] for p in self.places], "state string, state_code string, region string, remoteness_tier int")
        self.names = [p[0] for p in self.places]
        #: The place of each hub, by its number.
        self.hub_places = [self.places[i % len(self.places)] for i in range(HUBS)]
        self.hubs = spark.createDataFrame([(f"HUB-{i + 1}", p[0], p[2]) for i, p in enumerate(self.hub_places)], "hub_id string, hub_state string, hub_region string")
        self.sales = sale_calendar(spark, tuple(range(plan.start.year, plan.end.year + 1)))

    # draws
    def uniform(self, name: str, *keys: Column) -> Column:
        h = F.xxhash64(F.lit(name), F.lit(self.plan.seed), *keys)
        return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))

    def normal(self, name: str, *keys: Column) -> Column:
        return F.sqrt(-2 * F.ln(self.uniform(f"{name}/r", *keys))) * F.cos(2 * F.pi() * self.uniform(f"{name}/a", *keys))

    def lognormal(self, name: str, median: Column, sigma: float, *keys: Column) -> Column:
        return median * F.exp(F.lit(sigma) * self.normal(name, *keys))

    def pick(self, name: str, values: list, *keys: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.floor(self.uniform(name, *keys) * len(values)).cast("int"))

    def poisson(self, name: str, mean: Column, *keys: Column) -> Column:
        """A Poisson count: the distribution inverted at a uniform, in parts of a mean that doubles can hold."""
        parts = F.greatest(F.ceil(mean / 400), F.lit(1)).cast("int")
        m = mean / parts

        def inverted(part: Column) -> Column:
            u = self.uniform(name, *keys, part)
            # how many steps of the distribution are below u
            start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("upto"), (F.exp(-m) < u).cast("long").alias("n"))
            step = lambda a, k: F.struct((a["p"] * m / k).alias("p"), (a["upto"] + a["p"] * m / k).alias("upto"), (a["n"] + (a["upto"] + a["p"] * m / k < u).cast("long")).alias("n"))
            return F.aggregate(F.sequence(F.lit(1), F.ceil(m + 12 * F.sqrt(m) + 30).cast("int")), start, step, lambda a: a["n"])

        return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("long"), lambda n, part: n + inverted(part))

    def by_number(self, values: list, at: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), at.cast("int"))

    def misspelt(self) -> DataFrame:
        """(alias, state): the spellings that customers use beside names and codes."""
        wrong = F.array(F.concat("state", F.lit(" st")), *[w(F.col("state")) for w in MISSPELLINGS])
        return self.states.select(F.explode(wrong).alias("alias"), "state")

    def aliases(self) -> DataFrame:
        return alias_table(self.states, self.misspelt())

    # draws of which several feeds need the same
    def product_of(self, order: Column, line: Column) -> Column:
        return F.floor(self.uniform("product", order, line) * self.plan.products)

    def seller_of(self, product: Column) -> Column:
        return F.floor(self.uniform("seller", product) * self.plan.sellers)

    def moved_at(self, customer: Column) -> Column:
        """When a customer moves; null for most."""
        days = (self.plan.end - self.plan.start).days
        at = F.timestamp_add("MINUTE", F.floor(self.uniform("moved", customer) * days * 1440).cast("int"), F.lit(f"{self.plan.start} 00:00:00").cast("timestamp_ntz"))
        return F.when(self.uniform("mover", customer) < self.plan.moves, at)

    def home(self, customer: Column, version: Column) -> Column:
        """The number of the state of a customer's first or second address."""
        return F.floor(self.uniform("state", customer, version) * len(self.places)).cast("int")

    # feeds
    def customers(self) -> DataFrame:
        """Versions: the sign-up, and a second address for movers; some states misspelt, some pincodes blank."""
        c, p = F.col("id"), self.plan
        base = self.spark.range(p.customers)
        first = F.lit(f"{p.start.year - 1}-01-01 00:00:00").cast("timestamp_ntz")
        signup = F.timestamp_add("MINUTE", F.floor(self.uniform("signup", c) * 525_600).cast("int"), first)
        versions = F.array(F.struct(F.lit(1).alias("v"), signup.alias("at")), F.struct(F.lit(2).alias("v"), self.moved_at(c).alias("at")))
        rows = base.select("id", signup.alias("signup_at"), F.explode(F.filter(versions, lambda v: v["at"].isNotNull())).alias("m"))
        v = F.col("m.v")
        state = self.by_number(self.names, self.home(c, v))
        ways = [F.upper(state), F.lower(state), F.concat(F.lit(" "), state, F.lit(" st")), *[w(state) for w in MISSPELLINGS]]
        odd = self.uniform("dirty", c, v)
        spelt = F.when(odd < p.dirty, F.get(F.array(*ways), F.floor(odd / p.dirty * len(ways)).cast("int"))).otherwise(state)
        pincode = F.lpad(F.floor(self.uniform("pin", c, v) * 1_000_000).cast("string"), 6, "0")
        return rows.select(
            F.concat(F.lit("C"), c).alias("customer_id"), F.when(self.uniform("nopin", c, v) < p.no_pincode, "").otherwise(pincode).alias("pincode"),
            "signup_at", F.col("m.at").alias("updated_at"), spelt.alias("state"),
        )

    def sellers(self) -> DataFrame:
        s = F.col("id")
        rows = self.spark.range(self.plan.sellers).withColumn("n", (s % HUBS).cast("int"))
        return rows.select(
            F.concat(F.lit("S"), s).alias("seller_id"), F.concat(F.lit("Seller "), s).alias("seller_name"), F.concat(F.lit("HUB-"), F.col("n") + 1).alias("hub_id"),
            self.by_number([h[0] for h in self.hub_places], F.col("n")).alias("hub_state"),
            F.lit(f"{self.plan.start.year - 2}-01-01 00:00:00").cast("timestamp_ntz").alias("onboarded_at"),
        )

    def products(self) -> DataFrame:
        p = F.col("id")
        return self.spark.range(self.plan.products).select(
            F.concat(F.lit("P"), p).alias("product_id"), self.pick("category", list(CATEGORIES), p).alias("category"),
            F.floor(self.lognormal("price", F.lit(600.0), 0.8, p)).cast("decimal(12,2)").alias("list_price"),
            F.round(self.lognormal("weight", F.lit(0.8), 0.6, p), 2).alias("weight_kg"),
            F.concat(F.lit("S"), self.seller_of(p)).alias("seller_id"),
        )

    def days(self) -> DataFrame:
        """Each day's Poisson volume, by growth, busier weekends and sales, and its congestion: the mean load of the day and the
        three before it, over what the trend has. One row a day."""
        p = self.plan
        rows = self.spark.range(1).select(F.explode(F.sequence(F.lit(p.start), F.lit(p.end))).alias("day"))
        events = F.broadcast(self.sales.select("sale_event", F.explode(F.sequence("start_date", "end_date")).alias("day")))
        d = F.col("day")
        uplift = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in UPLIFT.items() for x in kv]), F.col("sale_event")), F.lit(1.0))
        load = uplift * F.when(F.weekday(d) >= 5, 1.12).otherwise(0.96)
        mean = F.lit(p.orders_per_day) * F.pow(F.lit(1 + p.growth), F.datediff(d, F.lit(p.start)) / 365.0) * load
        congestion = F.avg("load").over(Window.orderBy("day").rowsBetween(-3, 0))
        return rows.join(events, "day", "left").select("day", load.alias("load"), self.poisson("volume", mean, d).alias("n")).select("day", "n", congestion.alias("congestion"))

    def orders(self) -> DataFrame:
        """One row per order with the times and outcome of its life.

        The parcel goes from the hub of its first line's seller to the address that the customer has at purchase; distance,
        remoteness, rain, courier and congestion make it slower.
        """
        many = self.days().filter("n > 0").repartition("day").select("day", "congestion", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
        o = F.col("order_id")
        rows = many.select(F.concat(F.date_format("day", "yyyyMMdd"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("order_id"), "day", "congestion")
        customer = F.floor(self.uniform("customer", o) * self.plan.customers)
        at = F.timestamp_add("SECOND", F.floor(self.uniform("time", o) * 86_400).cast("int"), F.col("day").cast("timestamp_ntz"))
        rows = rows.select(
            "order_id", "congestion", customer.alias("customer"), self.pick("method", list(METHODS), o).alias("payment_method"), at.alias("purchase_at"),
            F.floor(self.uniform("courier", o) * len(COURIERS)).cast("int").alias("c"), (self.seller_of(self.product_of(o, F.lit(1))) % HUBS).cast("int").alias("h"),
        )
        settled = F.coalesce(self.moved_at(F.col("customer")) <= F.col("purchase_at"), F.lit(False))
        rows = rows.withColumn("s", F.when(settled, self.home(F.col("customer"), F.lit(2))).otherwise(self.home(F.col("customer"), F.lit(1))))
        place = lambda k, of: self.by_number([x[k] for x in (self.places if of == "s" else self.hub_places)], F.col(of))
        distance = F.sqrt(F.pow(place(4, "s") - place(4, "h"), 2) + F.pow(place(5, "s") - place(5, "h"), 2))
        rows = rows.withColumns({"distance": distance, "tier": place(3, "s")})
        crowd, night = F.sqrt("congestion"), F.hour("purchase_at") >= 20
        slow, held = (self.by_number([float(x[k]) for x in COURIERS], F.col("c")) for k in (1, 2))
        rain = F.when(F.month("purchase_at").isin(7, 8, 9), 15.0).otherwise(0.0)
        approval = self.lognormal("approval", F.when(F.col("payment_method") == "COD", 14.0).otherwise(7.0) * crowd + F.when(night, 4.0).otherwise(0.0), 0.5, o)
        handling = self.lognormal("handling", F.lit(26.0) * crowd * F.when(F.weekday("purchase_at") >= 4, 1.35).otherwise(1.0), 0.4, o)
        way = F.lit(30.0) + 11.0 * F.col("distance") + 16.0 * (F.col("tier") - 1) + slow + rain
        transit = self.lognormal("transit", way * crowd, 0.3, o) + F.when(self.uniform("held", o) < held, 48.0).otherwise(0.0)
        after = lambda start, hours: F.timestamp_add("SECOND", F.round(hours * 3600).cast("int"), start)
        fate = self.uniform("fate", o) - F.when(F.col("payment_method") == "COD", 0.012).otherwise(0.0)  # cash is refused more often
        rows = rows.withColumn("outcome", F.when(fate < 0.028, "cancelled").when(fate < 0.05, "rto").when(fate < 0.095, "returned").otherwise("delivered"))
        alive = F.col("outcome") != "cancelled"
        rows = rows.withColumn("approved_at", F.when(alive, after(F.col("purchase_at"), approval)))
        rows = rows.withColumn("shipped_at", after(F.col("approved_at"), handling))
        rows = rows.withColumn("arrived_at", F.when(F.col("outcome").isin("delivered", "returned"), after(F.col("shipped_at"), transit)))
        closed = (
            F.when(~alive, after(F.col("purchase_at"), approval))
            .when(F.col("outcome") == "rto", after(F.col("shipped_at"), transit * 1.7))
            .when(F.col("outcome") == "returned", after(F.col("arrived_at"), F.lit(20.0) + 100 * self.uniform("back", o)))
        )
        skew = self.uniform("skew", o) < self.plan.skewed
        promise = F.date_add(F.col("purchase_at").cast("date"), (4 + F.ceil(F.col("distance") / 4) + F.col("tier")).cast("int"))
        return rows.select(
            "order_id", F.concat(F.lit("C"), F.col("customer")).alias("customer_id"), F.concat(F.lit("HUB-"), F.col("h") + 1).alias("hub_id"),
            self.by_number([x[0] for x in COURIERS], F.col("c")).alias("courier"), "payment_method", "purchase_at", promise.alias("estimated_delivery_date"), "outcome",
            "approved_at", "shipped_at", F.when(skew & F.col("arrived_at").isNotNull(), F.timestamp_add("HOUR", F.lit(-5), "shipped_at")).otherwise(F.col("arrived_at")).alias("delivered_at"),
            "arrived_at", closed.alias("closed_at"), "distance", "tier", "congestion",
        )

    def order_versions(self) -> DataFrame:
        """One row per status change until the end of the plan, extracted on its day or late; some sent twice."""
        stages = [("created", "purchase_at", 1), ("approved", "approved_at", 2), ("shipped", "shipped_at", 3), ("delivered", "arrived_at", 4)]
        steps = [F.struct(F.lit(s).alias("order_status"), F.lit(r).alias("r"), F.col(c).alias("updated_at")) for s, c, r in stages]
        steps.append(F.struct(F.col("outcome").alias("order_status"), F.lit(5).alias("r"), F.when(F.col("outcome") != "delivered", F.col("closed_at")).alias("updated_at")))
        stop = F.lit(f"{self.plan.end} 23:59:59").cast("timestamp_ntz")
        rows = self.orders().select("*", F.explode(F.filter(F.array(*steps), lambda v: v["updated_at"].isNotNull() & (v["updated_at"] <= stop))).alias("v"))
        key = (F.col("order_id"), F.col("v.r"))
        lag = F.when(self.uniform("late", *key) < self.plan.late, 1 + F.floor(3 * self.uniform("lag", *key))).otherwise(0).cast("int")
        day = F.date_add(F.col("v.updated_at").cast("date"), lag)
        days = F.when(self.uniform("again", *key) < self.plan.duplicates, F.array(day, F.date_add(day, 1))).otherwise(F.array(day))
        seen = lambda r, c: F.when(F.col("v.r") >= r, F.col(c)).alias(c)
        return rows.select("*", F.explode(days).alias("extract_day")).select(
            "order_id", "customer_id", "hub_id", "courier", "payment_method", "purchase_at", "estimated_delivery_date", "v.order_status", seen(2, "approved_at"),
            seen(3, "shipped_at"), seen(4, "delivered_at"), seen(5, "closed_at"), "v.updated_at", "extract_day",
        )

    def order_items(self) -> DataFrame:
        o, i = F.col("order_id"), F.col("order_item_seq")
        lines = self.orders().select("order_id", "purchase_at", F.explode(F.sequence(F.lit(1), (1 + F.floor(4 * F.pow(self.uniform("lines", o), 2))).cast("int"))).alias("order_item_seq"))
        product = F.concat(F.lit("P"), self.product_of(o, i))
        rows = lines.withColumn("product_id", product).join(self.products(), "product_id")
        paid = (F.col("list_price") * (1 - F.floor(3 * self.uniform("discount", o, i)) / 10)).cast("decimal(12,2)")
        return rows.select("order_id", "order_item_seq", "product_id", "seller_id", (1 + F.floor(2 * self.uniform("quantity", o, i))).cast("int").alias("quantity"), paid.alias("unit_price"), F.col("purchase_at").alias("created_at"))

    def payments(self) -> DataFrame:
        """Charges (cash on delivery: at the door) with shipping below 499; returned orders get their lines back."""
        totals = self.order_items().groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("total"))
        rows = self.orders().join(totals, "order_id")
        charged = F.when(F.col("payment_method") == "COD", F.col("arrived_at")).otherwise(F.col("purchase_at"))
        charge = F.struct(F.lit("charge").alias("t"), (F.col("total") + F.when(F.col("total") < 499, 49).otherwise(0)).cast("decimal(12,2)").alias("a"), charged.alias("at"))
        back = F.when((F.col("outcome") == "returned") | F.col("outcome").isin("cancelled", "rto") & (F.col("payment_method") != "COD"), F.timestamp_add("DAY", F.lit(1), "closed_at"))
        refund = F.struct(F.lit("refund").alias("t"), (-F.col("total")).cast("decimal(12,2)").alias("a"), back.alias("at"))
        stop = F.lit(f"{self.plan.end} 23:59:59").cast("timestamp_ntz")
        each = rows.select("order_id", "payment_method", F.explode(F.filter(F.array(charge, refund), lambda x: x["at"].isNotNull() & (x["at"] <= stop))).alias("p"))
        return each.select(F.concat("p.t", F.lit("-"), "order_id").alias("payment_id"), "order_id", F.col("p.t").alias("payment_type"), "payment_method", F.col("p.a").alias("amount"), F.col("p.at").alias("created_at"))

    def write(self, landing: str, until: date | None = None) -> None:
        """Releases the extracts up to a day; days that are there already stay as they are."""
        last = F.lit(until or self.plan.end)
        feeds = {"orders": (self.order_versions(), F.col("extract_day"))}
        feeds |= {n: (getattr(self, n)(), F.col(c).cast("date")) for n, c in (("order_items", "created_at"), ("payments", "created_at"), ("customers", "updated_at"))}
        for entity, (rows, day) in feeds.items():
            dated = rows.withColumn("dt", day).drop("extract_day").filter(F.col("dt") <= last)
            write_daily(dated, "dt", landing, entity, ORDER[entity])
        for entity in ("products", "sellers"):
            getattr(self, entity)().coalesce(1).write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{landing}/{entity}.csv")
