"""The eight treasury tables, from CSV, Parquet, frames, or the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cashlens.config import PanelConfig, TEST_TABLES
from cashlens.functions.exprs import clean_text, country_norm
from cashlens.sources import schemas
from cashlens.sources.staging import staged

LINE_COLS = "l_orderkey l_linenumber l_partkey l_suppkey l_shipdate l_quantity l_extendedprice l_returnflag l_linestatus"


class Treasury:
    """Lazy access to the input tables. ``table(name, *cols)`` reads only what is asked for."""

    def __init__(self, spark: SparkSession, cfg: PanelConfig, frames: dict[str, DataFrame] | None = None):
        self.spark, self.cfg, self.frames = spark, cfg, frames or {}

    def table(self, name: str, *cols: str) -> DataFrame:
        df = self.frames.get(name)
        if df is None:
            df = optional_table(self.spark, name, self.frames)
        return df.select(*cols) if cols else df

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, cfg: PanelConfig, names=schemas.TABLES) -> "Treasury":
        return cls(spark, cfg, {n: read_parquet(spark, f"{root}/{n}") for n in names})

    @classmethod
    def from_csv(cls, spark: SparkSession, root: str, cfg: PanelConfig, names=schemas.TABLES) -> "Treasury":
        return cls(spark, cfg, {n: typed(read_csv(spark, f"{root}/{n}.csv"), n) for n in names})


# ------------------------------------------------------------------------------------- readers
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as text; quoted fields may hold newlines. The header is the schema."""
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').option("inferSchema", False).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Partitioned Parquet whose files may have different columns. Month folders stay text."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")                 # only while this read finds its schema
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    finally:
        spark.conf.set(key, before)


def typed(raw: DataFrame, name: str) -> DataFrame:
    """Trim, empty → NULL, tolerant cast by declared type; country spelling normalised."""
    out = []
    for c in raw.columns:
        e = clean_text(F.col(f"`{c}`"))
        t = schemas.type_of(name, c)
        if t != "string":
            e = e.try_cast(t)
        elif c == "country":
            e = country_norm(e)
        out.append(e.alias(c))
    return raw.select(*out)


def optional_table(spark: SparkSession, name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """A missing optional table is empty and typed; groups are counted from the companies."""
    if name in schemas.REQUIRED:
        raise ValueError(f"required input table missing: {name}")
    if name == "groups":
        return derive_groups(frames["companies"])
    return spark.createDataFrame([], schemas.ddl(name))


def derive_groups(companies: DataFrame) -> DataFrame:
    return (companies.where(F.col("group_id").isNotNull()).groupBy("group_id")
            .agg(F.lit(None).cast("string").alias("erp"),
                 F.count(F.lit(1)).cast("int").alias("n_companies_in_sample")))


def date_bounds(transactions: DataFrame, balances: DataFrame) -> DataFrame:
    """One row: first/last movement, snapshot, and the panel bounds derived from them."""
    tx = transactions.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    snap = balances.agg(F.max("date").alias("snap"))
    day = F.least(F.to_date("snap"), F.to_date("hi"))
    last = F.when(F.dayofmonth("last_day") < 28, F.add_months(F.trunc("last_day", "month"), -1)) \
        .otherwise(F.trunc("last_day", "month"))
    return (tx.crossJoin(snap)                        # two single rows
            .withColumn("snap", F.coalesce("snap", "hi")).withColumn("last_day", day)
            .select(F.date_format("lo", "yyyy-MM").alias("first_month"),
                    F.date_format(last, "yyyy-MM").alias("last_month"),
                    F.date_format(F.trunc("lo", "month"), "yyyy-MM-dd").alias("data_start"),
                    F.date_format(F.add_months(last, 1), "yyyy-MM-dd").alias("data_end"),
                    F.date_format("snap", "yyyy-MM-dd").alias("snapshot_date")))


def detect_config(transactions: DataFrame, balances: DataFrame, **kw) -> PanelConfig:
    """Panel bounds of an unseen data set (one aggregated row reaches the driver)."""
    r = date_bounds(transactions, balances).first()
    return PanelConfig(first_month=r.first_month, last_month=r.last_month, snapshot=r.snapshot_date, **kw)


class CompanySubset(Treasury):
    """Some companies of another treasury as a data set of its own: every table semi-joined, groups reached through the
    companies and counted anew. A table's columns are still read as asked for."""

    def __init__(self, inner: Treasury, ids: DataFrame, cfg: PanelConfig):
        super().__init__(inner.spark, cfg)
        self.inner, self.ids = inner, ids.select("company_id").distinct()

    def table(self, name: str, *cols: str) -> DataFrame:
        if name == "groups":
            erp = self.inner.table("groups", "group_id", "erp")
            out = derive_groups(self.table("companies", "company_id", "group_id")).drop("erp").join(erp, "group_id", "left").select(
                "group_id", "erp", "n_companies_in_sample")
            return out.select(*cols) if cols else out
        df = self.inner.table(name, *dict.fromkeys([*cols, "company_id"])) if cols else self.inner.table(name)
        out = df.join(self.ids, "company_id", "left_semi")
        return out.select(*(cols or df.columns))


# ------------------------------------------------------------------------- star-schema adapter
class StarTreasury(Treasury):
    """The test tables seen as treasury data: supplier = company, nation = group,
    lineitem = movements and invoices, customer = counterparty.

    Lookups on orders and part happen only when one of their columns is asked for.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: PanelConfig = TEST_TABLES):
        super().__init__(spark, cfg)
        self.dir = sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def table(self, name: str, *cols: str) -> DataFrame:
        if name in ("transactions", "invoices"):
            want = cols or tuple(schemas.COLUMNS[name].split())
            return getattr(self, f"_{name}")(want).select(*want)
        df = getattr(self, f"_{name}")()
        return df.select(*cols) if cols else df

    # dimensions ----------------------------------------------------------------------------
    def _groups(self):
        k = F.col("n_nationkey")
        size = self.source("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
            F.count(F.lit(1)).cast("int").alias("n_companies_in_sample"))
        return self.source("nation").join(size, "n_nationkey", "left").select(
            k.cast("string").alias("group_id"),
            F.when(k % 3 == 1, "erp_a").when(k % 3 == 2, "erp_b").alias("erp"), "n_companies_in_sample")

    def _companies(self):
        s = F.col("s_suppkey")
        nation = self.source("nation").join(F.broadcast(self.source("region")),   # a fixed list of regions
                                            F.col("n_regionkey") == F.col("r_regionkey"), "left")
        return self.source("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            s.alias("company_id"), F.col("s_nationkey").cast("string").alias("group_id"),
            F.when(s % 5 != 0, F.col("r_name")).alias("country"),
            F.when(s % 7 == 0, "USD").otherwise("EUR").alias("currency"),
            F.when(s % 4 == 0, "erp_c").alias("erp"),
            F.date_add(F.lit("1998-01-15").cast("date"), (s % 400).cast("int")).cast("timestamp").alias("created_at"))

    def _bank_of(self, k):
        s = F.col("s_suppkey")
        return F.when((s + k) % 6 == 5, "Other bank").otherwise(
            F.concat(F.lit("BANK_"), ((s * 7 + k) % 5).cast("string")))

    def _service_of(self, k):
        s = F.col("s_suppkey")
        return F.when((s + k) % 6 == 5, "_paypal_x").otherwise(
            F.concat(F.lit("svc_"), (s % 4).cast("string")))

    def _product(self, k, typ):
        s = F.col("s_suppkey")
        return [(s * 10 + k).alias("product_id"), s.alias("company_id"), typ.alias("type"),
                self._bank_of(k).alias("bank_name"), self._service_of(k).alias("service"),
                F.concat(typ, F.lit(" "), s.cast("string")).alias("label"), F.lit("EUR").alias("currency"),
                F.lit("1998-06-01").cast("timestamp").alias("created_at")]

    def _banking_products(self):
        k = F.col("k")
        base = self.source("supplier").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
        return base.select(*self._product(k, F.when(k == 2, "card").otherwise("checking")))

    def _debt_products(self):
        s, k = F.col("s_suppkey"), F.col("k")
        base = self.source("supplier").withColumn(
            "k", F.explode(F.array_compact(F.array(F.when(s % 2 == 0, F.lit(3).cast("long")),
                                                   F.when(s % 3 == 0, F.lit(4).cast("long"))))))
        line = k == 3
        return base.select(
            *self._product(k, F.when(line, "lineofcredit").otherwise("loan")),
            F.when(line, -500000.0).otherwise(-1000000.0).alias("granted"),
            F.when(line, F.col("s_acctbal") * -20).otherwise(-600000.0).alias("outstanding"),
            F.lit(None).cast("double").alias("liquidity"))

    def _debt_schedule_config(self):
        s = F.col("s_suppkey")
        return self.source("supplier").where(s % 3 == 0).select(
            (s * 10 + 4).alias("product_id"), s.alias("company_id"),
            F.lit(1000000.0).alias("granted_balance"), F.lit(600000.0).alias("outstanding_balance"),
            (F.lit(36) + F.lit(12) * (s % 3 + s % 2)).cast("int").alias("total_periods"),
            F.when(s % 7 != 6, (s % 7) * 0.5).alias("annual_interest_rate_or_spread"),
            F.when(s % 2 == 0, "fixed").otherwise("variable").alias("interest_type"))

    def _balances(self):
        s, k = F.col("s_suppkey"), F.col("k")
        base = self.source("supplier").withColumn(
            "k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3) - s % 2)))
        return base.select(
            (s * 10 + k).alias("product_id"), s.alias("company_id"),
            F.lit(self.cfg.snapshot).cast("timestamp").alias("date"),
            (F.col("s_acctbal") * F.when(k == 3, -20).otherwise(40)).alias("balance"))

    # facts ---------------------------------------------------------------------------------
    def _lines(self, want, orders_cols, part_cols, days):
        """Lines shipped before so many days after the snapshot, with the lookups that ``want`` needs."""
        until = F.date_add(F.lit(self.cfg.snapshot).cast("date"), days).cast("timestamp")
        df = (self._ordered_lines() if set(want) & orders_cols else self.source("lineitem")).where(F.col("l_shipdate") < until)
        if set(want) & part_cols:
            p = self.source("part").select("p_partkey", F.concat_ws(" ", F.lower("p_type"), "p_name").alias("words"))
            df = df.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
        return df

    def _ordered_lines(self):
        """Every line with its order's attributes: the facts meet their orders once a session, whatever reads them later."""
        def build():
            o = self.source("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
            lines = self.source("lineitem").select(*LINE_COLS.split())
            return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey")
        return staged(self, "ordered_lines", build)

    @staticmethod
    def _counterparty():
        return F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", (F.col("o_custkey") % 40).cast("string"))

    @staticmethod
    def _line_id():
        return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    def _transactions(self, want):
        df = self._lines(want, {"accounting_status", "counterparty_id"}, {"description"}, 3)
        s, n, f, p = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_extendedprice")
        line_of_credit = (s % 2 == 0) & (f == "N") & (n == 7)
        # position 1..7 of the movement kinds
        paid_kinds = ["salary", "social_security", "tax", "interest_charge", "fee", "debt_repayment", "transfer"]
        category = (F.when((f == "A") & (n == 7), "payment_refund").when(f == "A", "collection")
                    .when((f == "N") & (n == 6), "-").when((f == "N") & (n == 5), "cash_withdrawal")
                    .when(f == "N", "payment")
                    .otherwise(F.element_at(F.array(*[F.lit(x) for x in paid_kinds]), n)))
        have = {
            "transaction_id": lambda: self._line_id(), "company_id": lambda: s,
            "product_id": lambda: F.when(line_of_credit, s * 10 + 3).otherwise(s * 10 + n % 3),
            "date": lambda: F.col("l_shipdate"), "value_date": lambda: F.col("l_shipdate"),
            "amount": lambda: F.when(f == "A", 2 * p).when(f == "N", -p).otherwise(F.round(-0.8 * p, 2)),
            "exchange_rate": lambda: F.lit(1.0),
            "status": lambda: F.when(F.col("l_linestatus") == "O", "pending").otherwise("booked"),
            "accounting_status": lambda: F.when(F.col("o_orderstatus") == "F", "RECONCILIATION_COMPLETED")
            .when(F.col("o_orderstatus") == "P", "DISCARDED"),
            "category": lambda: category, "description": lambda: F.col("words"),
            "counterparty_id": self._counterparty,
        }
        return df.select(*[have[c]().alias(c) for c in want])

    def _invoices(self, want):
        df = self._lines(want, {"status", "payment_date", "counterparty_id"}, {"concept"}, 30)
        df = df.where(F.col("l_suppkey") % 3 != 1)
        n, p, due = F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_shipdate")
        paid_on = F.date_add(F.to_date(due), (2 * F.col("l_quantity") - 40).cast("int")).cast("timestamp")

        def is_paid():
            return (paid_on <= F.lit(self.cfg.snapshot).cast("timestamp")) & (F.col("o_orderstatus") != "P")

        have = {
            "operation_id": lambda: self._line_id(), "company_id": lambda: F.col("l_suppkey"),
            "document_type": lambda: F.lit("invoice"),
            "issuance_date": lambda: F.date_sub(F.to_date(due), (F.lit(20) + 5 * (n % 3)).cast("int")).cast("timestamp"),
            "due_date": lambda: due,
            "payment_date": lambda: F.when(is_paid(), paid_on).otherwise(due),
            "amount": lambda: F.when(n % 2 == 0, -p).otherwise(p),
            "pending_amount": lambda: F.lit(0.0), "currency": lambda: F.lit("EUR"),
            "accounting_currency": lambda: F.lit("EUR"), "exchange_rate": lambda: F.lit(1.0),
            "status": lambda: F.when(is_paid(), "paid")
            .when((n == 7) & (F.col("l_linestatus") == "F"), "cancel").otherwise("overdue"),
            "concept": lambda: F.col("words"), "counterparty_id": self._counterparty,
        }
        return df.select(*[have[c]().alias(c) for c in want])
