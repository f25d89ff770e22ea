"""Reading tables, and the joined sales table that the queries mine."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsift.operators.kept import keep, settle

#: Columns of the joined table.
SALES = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus l_shipdate o_custkey o_orderstatus o_orderdate "
    "o_orderpriority c_nationkey c_mktsegment n_name n_regionkey r_name p_name p_brand p_type p_size p_retailprice s_nationkey"
).split()
#: Numbers of that table that are names of things, not amounts.
SALES_FAMILIES = dict.fromkeys("l_orderkey l_partkey l_suppkey o_custkey c_nationkey n_regionkey s_nationkey o_orderdate p_size p_retailprice".split(), "categorical")
SALES_KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, *, header: bool = True, null_value: str | None = None) -> DataFrame:
    """A Parquet, ORC, JSON or CSV table by its ending; CSV columns stay text."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        reader = spark.read.option("header", header).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True)
        df = (reader.option("nullValue", null_value) if null_value is not None else reader).csv(path)
    elif kind in ("json", "jsonl", "orc"):
        df = spark.read.format("orc" if kind == "orc" else "json").load(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def first_rows(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The first n rows by a key; a table has no other order."""
    return df.orderBy(*key).limit(n)


def spread(df: DataFrame) -> DataFrame:
    """A table read by fewer tasks than there are cores, dealt to all of them; larger tables
    are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Line items that are joined at once if that makes no more than so many slices, as each reads all
#: line items; rows of a table, and of one of numbers only, that is sent to all executors.
SLICE, SLICES, SENT, NUMBERS = 6_000_000, 12, 200_000, 1_500_000


def kept_sales(
    spark: SparkSession, sf_dir: str, form: Callable[[DataFrame], DataFrame] = lambda df: df, *, cells: Callable[[DataFrame, list[str]], DataFrame] | None = None, small: int = 4_000_000
) -> DataFrame:
    """The joined table, each row brought to a form, written once.  If it isn't small, it is
    joined and written in slices of orders: the shuffles of one go before those of the next.
    ``cells``, if the form needs no more of a value, makes columns whole numbers, which stay as
    they are; parts are then sent to all executors, so that line items are shuffled once."""
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "supplier", "part")}
    slices = min(SLICES, max(2, -(-n["lineitem"] // SLICE))) if n["lineitem"] > small else 1
    hints = {}
    if slices > 1:
        # Hashed, the short side of a join is sorted no more than the long one; a task's share must be small.
        fits = {"part": n["part"], "orders": n["lineitem"] // slices}
        hints = {t: "shuffle_hash" for t, k in fits.items() if k <= SENT * int(spark.conf.get("spark.sql.shuffle.partitions"))}
        hints |= {"supplier": "broadcast"} if n["supplier"] <= SENT else {}
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    if slices > 1 and cells and n["part"] <= NUMBERS and dict(part.dtypes)["p_partkey"] in ("int", "bigint"):
        hints["part"], part = "broadcast", cells(part, [c for c in part.columns if c in SALES or c == "p_partkey"])
    parts = []
    for i in range(slices):
        rows = sales(spark, sf_dir, hints, part)
        parts.append(keep(form(rows if slices == 1 else rows.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(slices)) == i)), "sales"))
        del rows
        settle(spark)
    return reduce(DataFrame.unionByName, parts)


def sales(spark: SparkSession, sf_dir: str, hints: Mapping[str, str] = MappingProxyType({}), part: DataFrame | None = None) -> DataFrame:
    """lineitem with its order, customer, nation, region, part and supplier.  Orders get their
    customers first: they are fewer and narrower than the joined rows, which are shuffled least so.
    ``hints`` has how supplier, part and orders are joined, if Spark isn't to choose; those that are
    sent come last, after the shuffles.  ``part`` is in place of the table of that name."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region", "supplier")}
    t["part"] = spark.read.parquet(f"{sf_dir}/part.parquet") if part is None else part
    places = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    t["orders"] = t["orders"].join(t["customer"].join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    keys = {"supplier": ("l_suppkey", "s_suppkey"), "part": ("l_partkey", "p_partkey"), "orders": ("l_orderkey", "o_orderkey")}
    rows = spread(t["lineitem"])
    for name in sorted(keys, key=lambda name: hints.get(name) == "broadcast"):
        left, right = keys[name]
        rows = rows.join(t[name].hint(hints[name]) if name in hints else t[name], F.col(left) == F.col(right))
    return rows.select(*SALES)
