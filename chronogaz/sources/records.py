"""Sources and sinks of records: one JSON document per file, features, verse lines, keyed lookups, optional layers.

Readers take a schema and never infer it; a file that does not parse is a row with `_corrupt_record`, not a failure.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

FILE_ID = r"([^/]+)\.[A-Za-z]+$"


def write_packed(docs: DataFrame, path: str) -> None:
    """(file, document) -> files of many documents, one to a line after its file name and a tab."""
    flat = F.regexp_replace("document", r"[\r\n]+", " ")  # white space between tokens; inside strings JSON escapes it
    docs.select(F.concat("file", F.lit("\t"), flat).alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str, schema: StructType, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records with `file`, violations): one document per file, or as write_packed() packs them; those that cannot be read
    become violations."""
    wide = StructType([*schema.fields]).add("_corrupt_record", StringType())
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    if packed:
        name, text = F.split_part("value", F.lit("\t"), F.lit(1)), F.expr("substr(value, instr(value, '\t') + 1)")
    else:
        text = F.col("value")
    whole = spark.read.text(path, wholetext=not packed).select(name.alias("file"), F.from_json(text, wide, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    rows = whole.select("r.*", "file")
    bad = rows.where("_corrupt_record is not null").select(F.lit("readable").alias("rule_id"), F.lit("error").alias("severity"), F.col("file").alias("path"), F.lit("not a JSON document of this kind").alias("message"))
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), bad


def read_features(spark: SparkSession, path: str, properties: str = "map<string,string>", lines: bool = False) -> DataFrame:
    """(file, at, id, properties, kind, rings): one row per feature; polygon and line rings alike as arrays of points.

    A file is one collection, or with lines a collection on each line."""
    schema = f"type string, features array<struct<id:string,properties:{properties},geometry:struct<type:string,coordinates:string>>>"
    docs = spark.read.schema(schema).option("multiLine", not lines).json(path)
    rows = docs.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.posexplode("features").alias("at", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point, rings = "array<double>", "array<array<array<double>>>"
    shape = (
        F.when(kind == "MultiPolygon", F.flatten(F.from_json(raw, f"array<{rings}>")))
        .when(kind.isin("Polygon", "MultiLineString"), F.from_json(raw, rings))
        .when(kind == "LineString", F.array(F.from_json(raw, f"array<{point}>")))
        .when(kind == "Point", F.array(F.array(F.from_json(raw, point))))
    )
    return rows.select("file", "at", F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), kind.alias("kind"), shape.alias("rings"))


def vertices(features: DataFrame) -> DataFrame:
    """(file, at, ring, seq, lon, lat) of features."""
    rings = features.select("file", "at", F.posexplode("rings").alias("ring", "points"))
    return rings.select("file", "at", "ring", F.posexplode("points").alias("seq", "p")).select("file", "at", "ring", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def edges(features: DataFrame) -> DataFrame:
    """(file, at, ring, seq, x1, y1, x2, y2): each vertex with the next one of its ring, made inside the row."""
    rings = features.select("file", "at", F.posexplode("rings").alias("ring", "points")).where("size(points) > 1")
    pairs = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))
    e = rings.select("file", "at", "ring", F.posexplode(pairs).alias("seq", "e"))
    return e.select("file", "at", "ring", "seq", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


def read_corpus(spark: SparkSession, path: str, codes: DataFrame, may_be_empty: bool = False) -> DataFrame:
    """Lines `CODE C:V text` -> (book, chapter, verse, text); codes: (code, book).

    Lines off the pattern and unknown codes are left out; of a repeated key the last line stays. Lines keep their file's
    order by the reader's own row numbers; of a key that stands in several files a line of the file read last stays. A
    corpus without any verse is an error unless it may be empty."""
    pattern = r"^(\S+) (\d+):(\d+) (.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.col("value").rlike(pattern))
    verses = lines.select(part(1).alias("code"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"), part(4).alias("text"), "_at")
    known = verses.join(codes.select("code", "book").distinct(), "code")
    if not may_be_empty and known.isEmpty():
        raise ValueError(f"no verse of a known code in {path}")
    return known.groupBy("book", "chapter", "verse").agg(F.max_by("text", "_at").alias("text"))


def read_lookup(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """JSON lines keyed by a field: rows without it are left out; of a repeated key the last by content stays."""
    rows = spark.read.schema(schema).json(path).where(F.col(key).isNotNull())
    rest = [c for c in schema.names if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_v")) if rest else rows.distinct()
    return best.select(key, "_v.*") if rest else best


def read_sidecars(spark: SparkSession, path: str, schema: StructType, key: str, multiline: bool = True) -> DataFrame:
    """JSON documents (one to a file, or to a line) whose key stands in the body, else in the file's name; rows with neither are left out."""
    rows = spark.read.schema(schema).option("multiLine", multiline).json(path)
    named = F.regexp_extract(F.col("_metadata.file_name"), FILE_ID, 1)
    return rows.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), F.nullif(named, F.lit("")))).where(F.col(key).isNotNull())


def optional_layer(spark: SparkSession, path: str, schema: StructType, needs: str | None = None) -> DataFrame:
    """A Parquet layer, or an empty frame of its schema where there is none; a layer without its companion raises."""

    def there(p: str) -> bool:
        try:
            spark.read.parquet(p).schema
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        return True

    if not there(path):
        return spark.createDataFrame([], schema)
    if needs and not there(needs):
        raise FileNotFoundError(f"{path} needs {needs}")
    return spark.read.schema(schema).parquet(path)


def write_index(df: DataFrame, path: str, key: str, fields: list[str]) -> None:
    """A compact index as gzip JSON lines: few fields, in key order over the files (a range shuffle, no single task)."""
    df.select(key, *fields).orderBy(key).write.mode("errorifexists").option("compression", "gzip").json(path)


def write_payloads(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """One JSON payload per key, as lines (key, payload) in folders by hash bucket: a folder for each key does not scale."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    rows = df.select(F.col(key), body.alias("payload"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"))
    rows.write.mode("errorifexists").partitionBy("bucket").option("compression", "gzip").json(path)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Several layers under one folder, each with its own schema."""
    for name, df in layers.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{name}")


def nested(parent: DataFrame, child: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Parents with their children as an ordered array; none gives an empty array."""
    fields = [*order, *[c for c in child.columns if c not in (key, *order)]]
    rows = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(rows.schema[name].dataType)
    return parent.join(rows, key, "left").withColumn(name, F.coalesce(name, empty))
