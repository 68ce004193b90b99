"""Test cases and golden chart records: build, read, filter, write, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmeter.functions.keys import case_id

CASE_SCHEMA = "uuid string, dataset string, language string, complexity string, description string"

# The two levels a case is asked at, and the language of its question.
WITH_TYPE = "WithPlotType"
WITHOUT_TYPE = "WithoutPlotType"
LANGUAGE = "English"


def build_cases(descriptions: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """Case rows from (dataset, complexity, description) rows.

    With ``datasets`` a row whose dataset contains none of these names is an
    error, as is a complexity that is neither of the two levels.
    """
    ok = F.col("complexity").isin(WITH_TYPE, WITHOUT_TYPE)
    if datasets is not None:
        known = F.lit(False)
        for name in datasets:
            known = known | F.contains(F.col("dataset"), F.lit(name))
        ok = ok & known
    identity = case_id(F.col("dataset"), F.col("description"))
    problem = F.concat_ws(" ", F.lit("no case for"), "dataset", "complexity")
    return descriptions.select(
        F.when(ok, identity).otherwise(F.raise_error(problem)).alias("uuid"),
        "dataset",
        F.lit(LANGUAGE).alias("language"),
        "complexity",
        "description",
    )


def _holds_arrays(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the files hold one JSON array each rather than an object or array a line.

    Told by the first character of every file; files of both kinds are an error.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("place"),
        F.substring(F.ltrim("value"), 1, 1).alias("first"),
        F.startswith("value", F.lit("[")).alias("opens"),
    )
    files = lines.where("first <> ''").groupBy("file").agg(F.min_by("first", "place").alias("first"), F.count_if("opens").alias("n"))
    # Arrays on several lines of a file are one a line.
    array = (F.col("first") == "[") & (F.col("n") <= 1)
    arrays, others = files.agg(F.count_if(array), F.count_if(~array)).first()
    if arrays and others:
        raise ValueError(f"{path} holds files of one array each and files of lines: read them apart")
    return bool(arrays)


def _read_json(spark: SparkSession, path: str | list[str], schema: str, lines: bool | None) -> DataFrame:
    """Rows of JSON files; text that is no such row is an error, never a missing row."""
    if lines is None:
        lines = not _holds_arrays(spark, path)
    reader = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken")
    read = reader.option("multiLine", not lines).json(path)
    first = read.columns[0]
    problem = F.concat(F.lit("no JSON record: "), F.substring("_broken", 1, 200))
    checked = F.when(F.col("_broken").isNull(), F.col(first)).otherwise(F.raise_error(problem))
    return read.withColumn(first, checked).drop("_broken")


def read_cases(spark: SparkSession, path: str | list[str], lines: bool | None = None) -> DataFrame:
    """Read cases from files of one JSON array each, or of one JSON object per line.

    Unless ``lines`` says which, the files are looked through to tell. An array file is
    read by one task; a corpus beyond a few GB should be lines, as ``write_cases`` writes.
    What that wrote has its ``split`` as a further column.
    """
    names = [field.split()[0] for field in CASE_SCHEMA.split(", ")]
    read = _read_json(spark, path, CASE_SCHEMA, lines)
    return read.select(*names, *(["split"] if "split" in read.columns else []))


def read_goldens(spark: SparkSession, path: str | list[str], lines: bool | None = None) -> DataFrame:
    """Read golden records as (uuid, record map<string, variant>); of several records
    with one uuid the last one, by file name and place in the file, stays.

    Unless ``lines`` says whether the files hold an object per line or one array each,
    they are looked through to tell.
    """
    raw = _read_json(spark, path, "uuid string, plot_json variant", lines)
    raw = raw.select(
        "uuid",
        F.try_variant_get("plot_json", "$.data", "map<string,variant>").alias("record"),
        # rows of one block stay in one partition, where this id only grows
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("place"),
    )
    # the struct keeps a last record that holds no data from being passed over
    last = F.max_by(F.struct("record"), "place")
    return raw.groupBy("uuid").agg(last.alias("last")).select("uuid", "last.record")


def filter_cases(
    cases: DataFrame,
    uuid: str | None = None,
    dataset: str | None = None,
    complexity: str | None = None,
    split: str | None = None,
) -> DataFrame:
    """Cases that meet all filters given; an empty one filters nothing."""
    given = {"uuid": uuid, "dataset": dataset, "complexity": complexity, "split": split}
    for name, wanted in given.items():
        if wanted:
            cases = cases.where(F.col(name) == wanted)
    return cases


def _replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Write JSON lines, replacing only the partitions that ``df`` has rows for.

    Rebalancing gathers a small partition in one file and spreads a large one over many.
    """
    writer = df.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*columns).json(path)


def write_cases(cases: DataFrame, path: str, split: str) -> None:
    """Write cases under split and dataset; other datasets' cases stay as they are."""
    _replace_partitions(cases.withColumn("split", F.lit(split)), path, "split", "dataset")


def write_goldens(goldens: DataFrame, path: str, split: str) -> None:
    """Write (uuid, dataset, record) under split and dataset, as ``plot_json.data``."""
    kept = goldens.select(
        "uuid",
        F.struct(F.col("record").alias("data")).alias("plot_json"),
        F.lit(split).alias("split"),
        "dataset",
    )
    _replace_partitions(kept, path, "split", "dataset")


def corpus_summary(cases: DataFrame) -> DataFrame:
    """Cases per dataset and level, with a total row (``is_total``)."""
    return (
        cases.rollup("dataset")
        .agg(
            F.count(F.lit(1)).alias("cases"),
            F.count_if(F.col("complexity") == WITH_TYPE).alias("with_plot_type"),
            F.count_if(F.col("complexity") == WITHOUT_TYPE).alias("without_plot_type"),
            F.grouping("dataset").cast("boolean").alias("is_total"),
        )
        .select("dataset", "is_total", "cases", "with_plot_type", "without_plot_type")
    )
