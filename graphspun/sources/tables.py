"""Reading and writing tables: Parquet with explicit schemas, constants, parameters of an address, the page manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspun.sources.schemas import DRIVER, GRAPH, KEYS


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of `folder`, with its known schema: files are not opened to learn it."""
    return spark.read.schema((GRAPH | DRIVER)[name]).parquet(f"{folder}/{name}.parquet")


def read_graph(spark: SparkSession, folder: str, check: bool = True) -> dict[str, DataFrame]:
    """All node and edge tables. With `check`, a repeated slug fails the load: pages are looked up by it."""
    tables = {name: read(spark, folder, name) for name in GRAPH}
    if check:
        for name, key in KEYS.items():
            if (twice := tables[name].groupBy(key).count().where("count > 1").first()) is not None:
                raise ValueError(f"{name}: {key} {twice[0]!r} occurs {twice[1]} times")
    return tables


def parts(table: DataFrame, each: int = 1 << 20) -> int:
    """Partitions for work on the rows of `table`: one for each `each` bytes that Spark estimates, the session's own number at least.

    Of a table whose estimate follows its files; one of unknown size, such as rows of the driver, has the session's number.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 1 << 13) if size < 1 << 50 else 0)


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Names the tables for spark.sql()."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def constant(spark: SparkSession, **values: str) -> DataFrame:
    """One row of constants, such as a site's title."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def url_parameter(url: Column, name: str = "q") -> Column:
    """A parameter of an address, decoded; the empty string if it has none."""
    return F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(name))), F.lit(""))


def search_url(text: Column) -> Column:
    """The address of a search. The text is encoded, so that it comes back whole."""
    return F.concat(F.lit("/?q="), F.url_encode(text))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files as rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """Page rows by kind; writing again replaces the kinds that are written."""
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(folder)
