"""Sources (S1-S8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name


def actor_names(lines: DataFrame) -> DataFrame:
    """Distinct normalised names of a column name; blanks go."""
    name = normalize_name(F.trim("name"))
    return lines.select(name.alias("name")).where("name <> ''").distinct()


def read_actor_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file with a header line, one name a line."""
    return actor_names(spark.read.csv(path, header=True, schema="name string", sep="\x01"))


def cast_lists(rows: DataFrame) -> DataFrame:
    """Title, name from (n, title, names): the last row of a title counts; names are split and trimmed."""
    kept = rows.where(F.col("names").isNotNull() & (F.trim("title") != ""))
    last = kept.groupBy(F.trim("title").alias("title")).agg(F.max_by("names", "n").alias("names"))
    return last.select("title", F.explode(F.split("names", ",")).alias("name")).select("title", F.trim("name").alias("name")).where("name <> ''")


def read_cast_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (title, _, "a, b, c") with a header; rows with fewer columns go. Rows are numbered by
    file and place."""
    raw = spark.read.csv(path, header=True, schema="title string, other string, names string", mode="PERMISSIVE")
    return cast_lists(raw.select(F.monotonically_increasing_id().alias("n"), "title", "names"))


#: Precedence of the vector fields by reader.
MODES = {"recognise": ("templates", "sampled", "embedding"), "merge": ("templates", "all_embeddings", "embedding"), "evaluate": ("all_embeddings", "embedding", "templates")}


def strided(vectors: Column, most: int = 10) -> Column:
    """Every max(1, n // most)-th vector, most at most."""
    step = F.greatest(F.lit(1), F.floor(F.size(vectors) / most).cast("int"))
    return F.slice(F.filter(vectors, lambda x, i: i % step == 0), 1, most)


def explode_gallery(raw: DataFrame, mode: str = "recognise") -> DataFrame:
    """S3: identity, pos, embedding from nullable templates, all_embeddings, embedding and bare columns."""
    filled = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<array<double>>"))) > 0, F.col(c))
    one = F.when(F.size(F.coalesce(F.col("embedding"), F.array().cast("array<double>"))) > 0, F.array("embedding"))
    parts = {"templates": filled("templates"), "all_embeddings": filled("all_embeddings"), "sampled": F.when(filled("all_embeddings").isNotNull(), strided(F.col("all_embeddings"))), "embedding": one}
    chosen = [parts[m] for m in MODES[mode]]
    if mode != "evaluate":
        chosen.append(filled("bare"))  # the evaluator takes nothing from bare lists
    return raw.select("identity", F.posexplode(F.coalesce(*chosen)).alias("pos", "embedding"))


def read_table(spark: SparkSession, name: str, url: str | None = None, bounds: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A catalogue table, by JDBC if a URL is given; with bounds (a whole-number column, its least and largest
    values, parts), by as many queries at once. Filters and columns are pushed to the database."""
    if not url:
        return spark.table(name)
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if bounds:
        column, low, high, parts = bounds
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def inventory(paths: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Kind, owner, group_id, file of paths kind/owner[/group]/file with these extensions, in any case, and the
    columns to keep."""
    parts = F.split("path", "/")
    n = F.size(parts)
    kept = paths.where(F.col("path").rlike(r"(?i)\.(" + "|".join(extensions) + ")$") & (n >= 3))
    return kept.select(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("owner"), F.when(n > 3, F.get(parts, F.lit(2))).alias("group_id"), F.element_at(parts, -1).alias("file"), *keep)


def read_inventory(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The folders below root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return inventory(found.select(F.replace("path", F.lit(root.rstrip("/") + "/"), F.lit("")).alias("path")), **options)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Spark's image struct, BGR bytes, of all pictures in and below a folder; files that are no pictures go."""
    return spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)


def read_detections(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """The detection stream, or its batch twin."""
    return spark.readStream.schema(schema).parquet(path) if streaming else spark.read.schema(schema).parquet(path)


def group_metadata(groups: DataFrame, movies: DataFrame) -> DataFrame:
    """Groups with their movie's title."""
    return groups.join(movies.select(F.col("id").alias("movie_id"), "title"), "movie_id")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with n, their place within a key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
