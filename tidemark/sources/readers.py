"""Readers.  Schemas are always given: inference would read the input twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import labels

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Rows that one task gets where whole rows are exchanged by their key, about: pages, and short documents.
PAGES_A_TASK, ROWS_A_TASK = 1_000, 100_000


class Tables:
    """Attribute access to the Parquet tables of one folder.

    One task reads a row group.  ``deal`` lets text-heavy queries deal the rows out to all tasks first (``dealt``); turn it
    off where the tables have row groups enough, since dealing moves each text over the network once.
    """

    def __init__(self, spark: SparkSession, root: str, deal: bool = True):
        self.spark = spark
        self.root = root.rstrip("/")
        self.deal = deal
        self._counts: dict[str, int] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        # Page operators work per page: this is the one exchange that serves them all, at every size.
        return self.by_key(name, "page_id", PAGES_A_TASK) if name == "pages" else self.spark.read.parquet(self.path(name))

    def by_key(self, name: str, key: str, rows_a_task: int) -> DataFrame:
        """A table dealt out by its key to as many tasks as a shuffle has, and more where these got over ``rows_a_task`` rows.

        Sorts and windows behind it take memory by the rows of a task, so their number must follow the table's.
        """
        table = self.spark.read.parquet(self.path(name))
        if name not in self._counts:
            self._counts[name] = table.count()
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return table.repartition(max(least, -(-self._counts[name] // rows_a_task)), key)

    def dealt(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table, rows dealt out in turn to as many tasks as a shuffle has: no key can crowd one of them."""
        table = self.spark.read.parquet(self.path(name)).select(*columns)
        return table.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if self.deal else table


def scan_parquet(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """Many Parquet files as one table, only the named columns."""
    return spark.read.parquet(glob).select(*columns)


def query_files_in_place(spark: SparkSession, sql: str, **globs: str) -> DataFrame:
    """SQL straight over files: ``{name}`` in the text stands for a file glob."""
    return spark.sql(sql.format(**{k: f"parquet.`{v}`" for k, v in globs.items()}))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; only empty fields are null."""
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", False)
        .option("nullValue", "")
        .schema(schema)
        .csv(path)
    )


def scan_selectors(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV ``slug, article selector, |-list of boilerplate selectors``.

    Blank lines are skipped and short rows take the defaults.
    """
    raw = spark.read.option("sep", "\t").option("quote", "").schema(
        "slug string, article string, boilerplate string"
    ).csv(path)
    parts = F.split(F.coalesce("boilerplate", F.lit("")), r"\|")
    return raw.filter(F.coalesce("slug", F.lit("")) != "").select(
        "slug",
        F.coalesce("article", F.lit("body")).alias("article"),
        F.filter(parts, lambda s: s != "").alias("boilerplate"),
    )


def scan_json_docs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per file; ``doc_key`` is the name of the file's folder."""
    return (
        spark.read.option("multiLine", True)
        .schema(schema)
        .json(path)
        .withColumn("doc_key", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    )


RESULTS_SCHEMA = "rows bigint, files bigint, reps bigint, results_ms map<string,map<string,double>>"


def flatten_results(docs: DataFrame) -> DataFrame:
    """Nested ``op -> engine -> ms`` to one row per (op, engine)."""
    ops = docs.select("doc_key", F.explode("results_ms").alias("op", "engines"))
    return ops.select("doc_key", "op", F.explode("engines").alias("engine", "ms"))


RULE_ARGS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("min_rows", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("allow_reference", T.BooleanType()),
        T.StructField("alt", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("first", T.StringType()),
        T.StructField("second", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("child", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("applies_to", T.StringType()),
        T.StructField("invert_for", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("args", RULE_ARGS),
    ]
)

RULE_DOC = T.StructType(
    [
        T.StructField("page", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("probes", T.ArrayType(RULE)),
    ]
)


def rule_rows(docs: DataFrame, key: str) -> DataFrame:
    """``probes`` arrays to one row per rule with the defaults filled in."""
    flat = docs.select(key, F.explode("probes").alias("rule")).select(key, "rule.*")
    return flat.withColumns(
        {
            "weight": F.coalesce("weight", F.lit(1)),
            "applies_to": F.coalesce("applies_to", F.lit("all")),
        }
    )


def load_rules(spark: SparkSession, path: str, keys: DataFrame, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rules stored as one JSON file per page folder, or as such files in a pack.

    Returns ``(rules, warnings)``: pages of ``keys(page)`` without a rule file
    have no rules and one warning row.
    """
    if packed:
        doc = F.from_json(replace_bad_utf8(F.col("content")), RULE_DOC)
        docs = scan_pack(spark, path).select(doc.alias("_doc"), "path").select("_doc.*", F.col("path").alias("_path"))
    else:
        docs = spark.read.option("multiLine", True).schema(RULE_DOC).json(path).withColumn("_path", F.col("_metadata.file_path"))
    docs = docs.withColumn("page", F.element_at(F.split("_path", "/"), -2)).drop("_path")
    missing = keys.select("page").distinct().join(docs.select("page"), "page", "left_anti")
    warnings = missing.select("page", F.lit("no rule file").alias("warning"))
    return rule_rows(docs, "page"), warnings


PACK = "path string, modificationTime timestamp, length bigint, content binary"


def scan_pack(spark: SparkSession, path: str) -> DataFrame:
    """The files of a pack (see ``writers.write_pack``) with the columns of Spark's ``binaryFile``.

    A pack holds many small files in a few large ones: each of them costs neither an entry in a folder nor a listing.
    """
    return spark.read.schema(PACK).parquet(path)


def scan_whole_files(spark: SparkSession, glob: str, packed: bool = False) -> DataFrame:
    """Whole files, of a glob or a pack, as text, malformed UTF-8 replaced; path parsed to keys."""
    raw = scan_pack(spark, glob) if packed else spark.read.format("binaryFile").load(glob)
    name = r"([^/]+)/([^/]+)\.[^./]+$"
    return raw.select(
        F.regexp_extract("path", name, 1).alias("page"),
        F.regexp_extract("path", name, 2).alias("tool"),
        replace_bad_utf8(F.col("content")).alias("text"),
        F.col("length").alias("bytes"),
    )


def file_inventory(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Files below a folder or in a pack as ``folder, name, bytes, changed``: listed, their content is never read.

    Spark lists no empty files, so an empty file is as good as missing.
    """
    parts = F.split(F.col("path"), "/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = scan_pack(spark, path).where("length > 0") if packed else listed.load(path)
    return files.select(
        F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"),
    )


def replace_bad_utf8(content):
    """Bytes to text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def scan_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``HH:MM:SS origin answered for X`` lines; other lines are skipped."""
    pattern = r"^\s*(\d{2}:\d{2}:\d{2}) origin answered for (\S+)\s*$"
    return (
        spark.read.text(path)
        .filter(F.col("value").rlike(pattern))
        .select(
            F.regexp_extract("value", pattern, 1).alias("at"),
            F.regexp_extract("value", pattern, 2).alias("account"),
        )
    )


RESPONSE_BODY = (
    "account string, doors array<struct<id:string,name:string,status:string>>, "
    "origin_time double"
)


def parse_http_blocks(blocks: DataFrame, col: str = "value") -> DataFrame:
    """``who: request line / header lines / blank / JSON`` blocks to columns."""
    text = F.regexp_replace(F.col(col), "\r", "")
    who = F.regexp_extract(text, r"^(?:### )?([^:\n]+): ", 1)
    head = F.regexp_extract(text, r"(?s)^[^\n]*\n(.*?)\n\n", 1)
    body = F.regexp_extract(text, r"(?s)\n\n\s*(\{.*\})\s*$", 1)
    return blocks.select(
        who.alias("client"),
        F.regexp_extract(text, r"Bearer (\S+)", 1).alias("token"),
        labels.header_map(head).alias("headers"),
        F.from_json(body, RESPONSE_BODY).alias("body"),
    ).filter(F.col("client") != "")


def scan_http_dump(spark: SparkSession, path: str) -> DataFrame:
    """Response dump split on ``### `` marks."""
    return parse_http_blocks(spark.read.option("lineSep", "### ").text(path))


def scan_scores_typed(spark: SparkSession, path: str) -> DataFrame:
    """Score CSV with text turned to types: empty or ``None`` is null."""
    names = (
        "page tool lang kind ranked probes_passed probes_total probe_pass_rate "
        "retention boilerplate_leakage output_bytes"
    ).split()
    raw = scan_csv(spark, path, ", ".join(f"{n} string" for n in names))

    def value(name: str, kind: str):
        text = F.nullif(F.nullif(F.col(name), F.lit("None")), F.lit(""))
        return text.try_cast(kind).alias(name)

    return raw.select(
        "page", "tool", "lang", "kind",
        (F.col("ranked") == "True").alias("ranked"),
        value("probes_passed", "int"),
        value("probes_total", "int"),
        value("probe_pass_rate", "double"),
        value("retention", "double"),
        value("boilerplate_leakage", "double"),
        value("output_bytes", "bigint"),
    )
