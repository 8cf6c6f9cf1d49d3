"""Reading inputs: texts, ledgers, old ledger files, allowlists, listings and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.tokens import extension
from textloom.operators import ledger

#: Extensions of inputs, lower case.
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "pdf")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, text, error`` of whole text files, one trailing newline taken off; what isn't there is an error row."""
    there = [p for p in dict.fromkeys(paths) if exists(spark, p)]
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "place long, file string")
    if not there:
        return asked.select("file", F.lit(None).cast("string").alias("text"), F.lit("cannot read").alias("error"))
    parts = [spark.read.text(p, wholetext=True).select(F.lit(p).alias("of"), F.col("value")) for p in there]
    read = parts[0]
    for p in parts[1:]:
        read = read.unionByName(p)
    text = F.when(F.endswith("value", F.lit("\n")), F.col("value").substr(F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    joined = asked.join(read, asked["file"] == read["of"], "left")
    found = F.col("of").isNotNull()
    return joined.orderBy("place").select("file", F.when(found, F.coalesce(text, F.lit(""))).alias("text"), F.when(~found, "cannot read").alias("error"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries; malformed lines and lines without all seven keys are dropped, a missing ledger is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], ledger.SCHEMA)
    rows = spark.read.schema(ledger.SCHEMA).option("mode", "DROPMALFORMED").json(path)
    for f in ledger.SCHEMA:
        rows = rows.filter(F.col(f.name).isNotNull())
    return rows


def read_tsv_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all ``*.tsv`` files of a folder."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "value string")
    return spark.read.option("pathGlobFilter", "*.tsv").text(folder)


def migrate_tsv(spark: SparkSession, folder: str, ledger_path: str) -> int:
    """Imports old files once; a marker beside the ledger is left after a real import only.  Number of rows imported."""
    marker = ledger_path.rstrip("/") + ".migrated"
    if not exists(spark, folder) or exists(spark, marker):
        return 0
    rows = ledger.from_tsv(read_tsv_lines(spark, folder)).cache()
    try:
        n = rows.count()
        if n:
            ledger.append(rows, ledger_path)
            note = spark.range(1).select(F.lit(n).alias("count"), F.date_format(F.current_timestamp(), ledger.TIME_FORMAT).alias("at"), F.lit(folder).alias("from"))
            note.coalesce(1).write.json(marker)
        return n
    finally:
        rows.unpersist()


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """``expiry, path, seq`` of an allowlist's lines, in order."""
    if not exists(spark, path):
        return spark.createDataFrame([], "expiry long, path string, seq long")
    c = F.split("value", "\t", 2)
    rows = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return rows.select(F.get(c, F.lit(0)).try_cast("bigint").alias("expiry"), F.get(c, F.lit(1)).alias("path"), "seq")


def append_allow(spark: SparkSession, path: str, allowed: str, seconds: int = 300) -> None:
    """Lets one path through for a while."""
    line = F.concat((F.unix_timestamp() + seconds).cast("string"), F.lit("\t"), F.lit(allowed))
    spark.range(1).select(line.alias("value")).coalesce(1).write.mode("append").text(path)


def newest(files: DataFrame, n: int, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The ``n`` newest of ``path, modificationTime`` with one of the extensions."""
    if n < 1:
        raise ValueError("count must be >= 1")
    return files.filter(extension(F.col("path")).isin(*extensions)).orderBy(F.desc("modificationTime"), "path").limit(n)


def newest_files(spark: SparkSession, folder: str, n: int = 1) -> DataFrame:
    """The newest inputs of a folder; contents aren't read."""
    return newest(spark.read.format("binaryFile").load(folder).select("path", "modificationTime"), n)


def content_hash(content):
    """SHA-256 in lower-case hex."""
    return F.sha2(content, 256)


def run_recogniser(images: DataFrame, recognise, schema: str) -> DataFrame:
    """Rows of an external recogniser: ``recognise`` gets and gives iterators of pandas frames."""
    return images.mapInPandas(recognise, schema)
