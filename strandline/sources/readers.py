"""Sources: manifests, texts, alignment documents, media listings, silence logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import SUPPORTED, number_or

MANIFEST = "id int, catalogue_id int, content string, audio_url string"
_ALIGNMENT = "id long, fragments array<struct<begin:string,end:string,lines:array<string>>>"


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whichever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replacements(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of an affix file's lines REP src dst, _ for a space; the line with their number is none."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.col("value").startswith("REP")).select(parts.alias("p")).filter("size(p) = 3 and p[0] = 'REP'")
    return rows.select(*[F.replace(F.get("p", F.lit(k)), F.lit("_"), F.lit(" ")).alias(name) for k, name in ((1, "src"), (2, "dst"))])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header row and a fixed schema."""
    return spark.read.schema(MANIFEST).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file, with its whole text."""
    return spark.read.text(path, wholetext=True)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(id, fragment_no, begin_s, end_s, text) of alignment documents: first line or '', bad numbers 0."""
    rows = spark.read.schema(_ALIGNMENT).json(path).select("id", F.posexplode("fragments").alias("fragment_no", "f"))
    return rows.select("id", "fragment_no", number_or(F.col("f.begin")).alias("begin_s"), number_or(F.col("f.end")).alias("end_s"), F.coalesce(F.get("f.lines", F.lit(0)), F.lit("")).alias("text"))


def files(spark: SparkSession, folder: str, recurse: bool = True, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """path and length of the files with these extensions (any case); their content is not read.

    A folder that isn't there has none.
    """
    if not there(spark, folder):
        return spark.createDataFrame([], "path string, length long")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recurse).load(folder).select("path", "length")
    return rows.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """path within the folder, length and content of all files below it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select(F.regexp_replace("path", "^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "").alias("path"), "length", "content")


def silence_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with type (start or end) and time_s of a silence log's marks; other lines are dropped."""
    pattern = r"silence_(start|end):\s*(-?[0-9.]+)"
    return lines.filter(F.col(line).rlike(pattern)).withColumns({"type": F.regexp_extract(line, pattern, 1), "time_s": F.regexp_extract(line, pattern, 2).try_cast("double")})
