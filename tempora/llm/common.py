"""What the corpus operators share: table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as a Java and RE2 class body.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one; elsewhere this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tempora/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames is called so (letter case aside)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df``, written and read back, with the number of each row (from 0, in the order of its partitions) in ``column``.

    Only the number of rows of each partition is summed in one place.
    """
    placed = written(df.withColumn(column, F.monotonically_increasing_id()), name)
    part, inside = F.shiftright(column, 33), F.col(column).bitwiseAND(F.lit((1 << 33) - 1))
    base, key = unused("base", df), unused("part", df)
    # one row for each partition
    sizes = placed.groupBy(part.alias(key)).agg(F.count("*").alias("n"))
    bases = sizes.select(key, (F.sum("n").over(Window.orderBy(key)) - F.col("n")).alias(base))
    return placed.withColumn(key, part).join(F.broadcast(bases), key).withColumn(column, F.col(base) + inside).drop(key, base)


#: A key is hot if it has more than this part of all rows, so there are fewer hot keys than this.
HOT = 4096


def joined_to_keys(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows``, ``total`` in number, with ``keys``: one row for each key and in ``n`` how many of the rows have it.

    Rows of hot keys stay where they are, as the fewer than HOT hot keys are broadcast; the others are shuffled, whatever their size.
    """
    hot = F.broadcast(keys.filter(F.col("n") * HOT > total).drop("n"))
    cold = keys.filter(F.col("n") * HOT <= total).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key))


def left_joined_to_keys(rows: DataFrame, keys: DataFrame, key: str, total: int, salts: int = 64) -> DataFrame:
    """Left join of ``rows``, ``total`` in number, with ``keys``: one row for each key and in ``n`` how many of the rows have it.

    Rows of a hot key are dealt over ``salts`` copies of its row, so no task gets them all; what is broadcast is the fewer than HOT hot keys themselves, never what
    they bring. ``keys`` is read twice and should be a written table.
    """
    is_hot = F.col("n") * HOT > total
    hot, salt = unused("hot", rows, keys), unused("salt", rows, keys)
    marked = rows.join(F.broadcast(keys.filter(is_hot).select(key, F.lit(True).alias(hot))), key, "left")
    dealt = marked.withColumn(salt, F.when(F.col(hot), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int")).drop(hot)
    spread = keys.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(spread.hint("merge"), [key, salt], "left").drop(salt)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text: Column) -> Column:
    """The words ``[^\x20\x09-\x0D]+`` of a text; none for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+")
    return F.filter(parts, lambda w: w != "")


def without_white(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def has_word(line: Column) -> Column:
    return line.rlike(f"[^{WHITE}]")
