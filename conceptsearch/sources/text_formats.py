"""Readers for the reference's text formats.

Every reader declares its schema; nothing is inferred.  Line order, where
the semantics need it ("later duplicate wins", "first question wins"), is an
order key ``(file path, split start, increasing id within the split)`` taken
from the file-source metadata: no global sort, no single-partition window.
Keep-first / keep-last are ``min_by`` / ``max_by`` aggregates, which Spark
partially aggregates before the shuffle, so a key repeated millions of times
never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptsearch.functions.scalar import normalize_qa_text, parse_answer_list

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("contents", T.StringType()),
])

DOC_SCORES = T.StructType([
    T.StructField("doc_id", T.ArrayType(T.StringType())),
    T.StructField("score", T.ArrayType(T.DoubleType())),
])

TRAIN_RECORD_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("positives", DOC_SCORES),
    T.StructField("negatives", DOC_SCORES),
])

LATENTS_SCHEMA = T.StructType([
    T.StructField("docid", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("weight", T.ArrayType(T.DoubleType())),
])

QUERY_LATENTS_ENTRY = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("weight", T.ArrayType(T.DoubleType())),
])


def line_order(df: DataFrame) -> DataFrame:
    """Add ``line_key``: a struct that sorts like the lines of the files."""
    path = F.col("_metadata.file_path")
    part = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1)   # part files sort by number, not as text
    return df.withColumn("line_key", F.struct(
        F.when(part != "", part.cast("long")).otherwise(F.lit(-1)).alias("part"), path.alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq")))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Text lines with their order key: ``(value, line_key)``."""
    return line_order(spark.read.text(path).select("value", "_metadata"))


def strip(value: Column) -> Column:
    """Python's ``str.strip()``: all surrounding whitespace."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _fields(value: Column, sep: str) -> Column:
    return F.split(strip(value), sep)


def _exact_fields(value: Column, sep: str, least: int, most: int | None = None) -> Column:
    """The fields of a line; a line with fewer or more than it may have fails
    the read with the line's text."""
    f = _fields(value, sep)
    whole = (F.size(f) >= least) & ((F.size(f) <= most) if most else F.lit(True))
    return F.when(whole, f) \
            .otherwise(F.raise_error(F.concat(F.lit("malformed line: "), value)))


def _json(spark: SparkSession, schema: T.StructType, path) -> DataFrame:
    """JSON lines of a declared schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_corpus(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A1: JSONL / JSONL.gz corpus ``{id, title, contents}`` ->
    ``(doc_id long, title, contents)``.

    Gzip does not split, so the rows are redistributed after the read."""
    if not (path.rstrip("/").endswith(".jsonl") or path.rstrip("/").endswith(".jsonl.gz")):
        raise ValueError("corpus path must end with .jsonl or .jsonl.gz")
    df = _json(spark, CORPUS_SCHEMA, path)
    if path.endswith(".gz"):
        df = df.repartition(partitions or spark.sparkContext.defaultParallelism)
    return df.select(F.col("id").cast("long").alias("doc_id"), "title", "contents")


def scan_queries(spark: SparkSession, path: str) -> DataFrame:
    """A2: ``qid \\t query`` lines; a repeated qid keeps its last line."""
    lines = read_lines(spark, path).withColumn("f", _exact_fields(F.col("value"), "\t", 2, 2))
    return (lines.groupBy(F.col("f")[0].alias("qid"))
                 .agg(F.max_by(F.col("f")[1], F.col("line_key")).alias("query")))


def scan_qa_queries(spark: SparkSession, path: str) -> DataFrame:
    """A3: ``question \\t answer-list`` lines; both fields unquoted (H2), the
    question is the key and its first occurrence wins (G4), answers parsed
    as a literal (H3).  Output ``(qid, query, answers)``."""
    lines = read_lines(spark, path).withColumn("f", _exact_fields(F.col("value"), "\t", 2, 2))
    lines = lines.select(
        normalize_qa_text(F.col("f")[0]).alias("query"),
        normalize_qa_text(F.col("f")[1]).alias("raw_answers"), "line_key")
    first = (lines.groupBy("query")
                  .agg(F.min_by(F.col("raw_answers"), F.col("line_key")).alias("raw_answers")))
    return first.select(F.col("query").alias("qid"), "query",
                        parse_answer_list(F.col("raw_answers")).alias("answers"))


def scan_qrels(spark: SparkSession, path: str, whitespace: bool = False) -> DataFrame:
    """A4: ``qid _ pid grade``; tab separated, or any blanks with
    ``whitespace=True``.  A repeated (qid, pid) keeps its last grade."""
    sep = r"\s+" if whitespace else "\t"
    lines = read_lines(spark, path).withColumn("f", _exact_fields(F.col("value"), sep, 4, 4))
    return (lines.groupBy(F.col("f")[0].alias("qid"), F.col("f")[2].alias("pid"))
                 .agg(F.max_by(F.col("f")[3].cast("int"), F.col("line_key")).alias("rel")))


def scan_run_lenient(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``qid pid rank [score]`` (tab); with three fields score = 1/rank.
    Order within a query is the ``rank`` column."""
    lines = spark.read.text(path).withColumn("f", _exact_fields(F.col("value"), "\t", 3))
    rank = F.col("f")[2].cast("int")
    score = F.when(F.size("f") == 3, F.lit(1.0) / rank).otherwise(F.col("f")[3].cast("double"))
    return lines.select(F.col("f")[0].alias("qid"), F.col("f")[1].alias("pid"),
                        rank.alias("rank"), score.alias("score"))


def scan_run_strict(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated run; lines without exactly four fields are
    skipped, the rank field ignored, a repeated (qid, pid) keeps the last."""
    lines = read_lines(spark, path).withColumn("f", _fields(F.col("value"), r"\s+"))
    lines = lines.filter(F.size("f") == 4)
    return (lines.groupBy(F.col("f")[0].alias("qid"), F.col("f")[1].alias("pid"))
                 .agg(F.max_by(F.col("f")[3].cast("double"), F.col("line_key")).alias("score"),
                      F.max(F.col("line_key")).alias("line_key")))


def scan_train_records(spark: SparkSession, paths) -> DataFrame:
    """Training records with nested positives / negatives (one or many
    files, comma-separated string or list)."""
    if isinstance(paths, str):
        paths = [p for p in paths.split(",") if p]
    return _json(spark, TRAIN_RECORD_SCHEMA, list(paths))


def scan_passage_latents(spark: SparkSession, path: str) -> DataFrame:
    """A10: JSONL ``{docid, ids, weight}``."""
    return _json(spark, LATENTS_SCHEMA, path)


def scan_query_latents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object ``qid -> {ids, weight}`` a file -> ``(qid, latent, weight)``.

    An entry ends at the only ``}`` it has, so files are read as text that is
    split there: one large object is read by many tasks, and none holds more
    than an entry.  A repeated qid keeps its last entry.  An entry that isn't
    ``"number": {...}`` fails the read with its file and text; so does an
    object whose end is missing (by the file's size, if it is not compressed)."""
    pieces = spark.read.option("lineSep", "}").text(path).select("value", "_metadata")
    blank = F.col("value").rlike(r"^[\s{]*$")
    sizes = (pieces.groupBy(F.col("_metadata.file_path").alias("file"))
                   .agg((F.max("_metadata.file_size") - F.sum(F.octet_length("value"))).alias("ends"),
                        F.count_if(~blank).alias("entries"))
                   .filter("file NOT LIKE '%.gz' AND ends <> entries + 1"))
    cut = sizes.limit(1).collect()
    if cut:
        raise ValueError(f"malformed object: {cut[0]['file']} has {cut[0]['entries']} entries and {cut[0]['ends']} closing braces")
    entries = line_order(pieces.filter(~blank))
    place = F.concat(F.lit("malformed entry in "), F.col("_metadata.file_path"), F.lit(": "), F.substring("value", 1, 200))
    key = F.regexp_extract("value", r'^[\s{,]*"(-?[0-9]+)"\s*:\s*\{', 1)
    body = F.from_json(F.concat(F.regexp_extract("value", r'^[^:]*:\s*(\{[\s\S]*)$', 1), F.lit("}")), QUERY_LATENTS_ENTRY)
    whole = (key != "") & body["ids"].isNotNull() & body["weight"].isNotNull() & (F.size(body["ids"]) == F.size(body["weight"]))
    rows = entries.select(F.when(whole, key.cast("long")).otherwise(F.raise_error(place).cast("long")).alias("qid"),
                          body.alias("q"), "line_key")
    last = rows.groupBy("qid").agg(F.max_by("q", "line_key").alias("q"))
    pairs = last.select("qid", F.explode(F.arrays_zip(F.col("q.ids").alias("latent"), F.col("q.weight").alias("weight"))).alias("p"))
    return pairs.select("qid", F.col("p.latent").alias("latent"), F.col("p.weight").alias("weight"))
