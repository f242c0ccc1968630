"""Finding files and loading what comes beside the cases: parts of a cube, snapshots, postings, edge lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.functions.calendar import month_of
from ledgertide.functions.taxonomy import Rules, classify_labels

TABLE = r"\.(csv|dta)(\.gz)?$"
ARCHIVE = r"\.(tar|tar\.gz|tgz|tar\.bz2|tar\.xz)$"
SNAPSHOT = "district_id long, t_ym int, stage string, n long, n_gap long, sum_log_gap double"

#: The cadres of a judge's position, first match first.
CADRES: Rules = (
    ("district", r"district|sessions|\bmsj\b|family|motor acc|mact|pocso|ndps|sc st|\bcbi\b|fast track|special judge|labour|industrial|principal judge|chief judge"),
    ("senior", r"senior|chief judicial|chief metropolitan|\bsub\b|sub court|subdivisional|\bsdjm\b|small cause|\bacjm\b|\bcjm\b|\bcjsd\b"),
    ("junior", r"junior|judicial magistrate|jmfc|munsi|metropolitan magistrate|taluka|\bcjjd\b|civil judge and judicial"),
)
DAY_FIRST, ISO = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "d MMM yyyy"), ("yyyy-M-d",)


def classified(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, kind): kind is cases, judges, keys or skipped, by words in the file's name.

    Where a kind has CSV copies (the name ends so, or a folder is called csv), its other copies are skipped. Names that
    are neither tables nor archives are skipped, too. A null path is skipped.
    """
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    has = lambda word: name.contains(word)
    kind = (
        F.when(~(name.rlike(TABLE) | name.rlike(ARCHIVE)), None)
        .when(has("key"), "keys")
        .when(has("judge") & ~has("case"), "judges")
        .when(has("case") & ~has("act") & ~has("judge"), "cases")
    )
    csv = name.rlike(r"\.csv(\.gz)?$") | F.array_contains(F.split(F.lower(path), "/"), "csv")
    rows = paths.select(F.col(path).alias("path"), kind.alias("kind"), F.coalesce(csv, F.lit(False)).alias("csv"))
    kept = F.col("csv") | ~F.max("csv").over(Window.partitionBy("kind"))  # one row a file: few
    return rows.select("path", F.when(F.col("kind").isNotNull() & kept, F.col("kind")).otherwise("skipped").alias("kind"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """The files under a folder of any store that Spark lists, classified; contents are not read, hidden files not listed."""
    return classified(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path"))


def cube_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The files state=NAME.parquet and state=NAME_PART.parquet of a folder as one table, part_of being NAME."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "state=*.parquet").parquet(folder)
    return rows.withColumn("part_of", F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^state=([^_.]*)", 1))


def snapshot(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """A Parquet snapshot, or no rows of its schema where there is none. Other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _first_date(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def load_postings(raw: DataFrame, fallback: tuple[str, ...] = DAY_FIRST, start: str = "start_date", end: str = "end_date", closed_from: int | None = None) -> DataFrame:
    """raw with both dates parsed, cadre, district_id and the months s and e; rows without a start go.

    Dates are day-month-year. A column of which less than half parses so is read by the first of the fallback's formats
    that fits each value; which holds is known after one aggregate of four counts. An end that does not parse is an
    open posting. closed_from: only postings with an end, that start in this month or later.
    """
    text = lambda c: F.trim(F.col(c).cast("string"))
    usual = lambda c: F.try_to_date(text(c), "d-M-yyyy")
    seen = raw.agg(*[F.count(x).alias(f"{k}{n}") for n, c in enumerate((start, end)) for k, x in (("given", F.col(c)), ("parsed", usual(c)))]).first()
    dates = {c: usual(c) if seen[f"parsed{n}"] >= 0.5 * seen[f"given{n}"] else _first_date(text(c), fallback) for n, c in enumerate((start, end))}
    rows = raw.withColumns(dates).where(F.col(start).isNotNull())
    if "judge_position" not in rows.columns:
        rows = rows.withColumn("judge_position", F.lit("na"))
    rows = classify_labels(rows, "judge_position", CADRES, "other", "cadre")
    rows = rows.withColumns({"district_id": F.col("state_code").cast("long") * 1000 + F.col("dist_code").cast("long"), "s": month_of(F.col(start)), "e": month_of(F.col(end))})
    return rows if closed_from is None else rows.where(F.col("e").isNotNull() & (F.col("s") >= closed_from))


def edge_weights(edges: DataFrame, districts: DataFrame) -> DataFrame:
    """(district, neighbour, weight) from undirected pairs src_state, src_dist, dst_state, dst_dist; a district's weights add up to 1.

    Pairs with a district that is not in districts(district) go, pairs given twice or both ways count once.
    """
    key = lambda end: (F.col(f"{end}_state").cast("long") * 1000 + F.col(f"{end}_dist").cast("long")).alias(end)
    known = districts.select("district").distinct()
    pairs = edges.select(key("src"), key("dst"))
    pairs = pairs.join(known.withColumnRenamed("district", "src"), "src", "left_semi").join(known.withColumnRenamed("district", "dst"), "dst", "left_semi")
    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("district"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("district"), F.col("src").alias("neighbour")))).alias("e"))
    both = both.select("e.*").distinct()
    return both.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("district")))
