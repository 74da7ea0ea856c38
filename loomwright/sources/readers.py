"""JSONL, Parquet and fixture readers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record as curated: semi-structured parts are JSON text (`details`).
RECORD = (
    "id string, benchmark_family string, task_type string, language string, difficulty string, "
    "messages array<struct<role:string,content:string>>, final_answer string, concise_solution string, "
    "verifier struct<type:string,details:string>, sources array<struct<url:string,license:string,used_for:string>>, "
    "contamination_audit struct<official_benchmark_checked:boolean,exact_match:boolean,ngram_similarity_max:double,simhash_similarity_status:string,simhash_similarity_max:double,embedding_similarity_status:string,embedding_similarity_max:double,numeric_structure_similarity:string,decision:string,notes:string>, "
    "quality_scores map<string,string>, training_tags array<string>, "
    "loop_metadata struct<n_corrections:int,skill_taught:string,convergence_reached:boolean,base_family:string>"
)
FILE_NAME = r"(train|val)_([^/]+)_(\d{3})\.jsonl"
#: What stands before a shard's name in a path, and after it where the shard is a folder.
SHARD, PART_FILE = r"(?:^|[/=])", r"(?:/part-[^/]*)?$"
#: Names that stand for several benchmarks.
ALIASES = {"aime": ["aime24", "aime25"], "thai_exam": ["onet", "ic", "tgat", "tpat1", "a_level"]}


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, malformed: str = "keep") -> DataFrame:
    """Records of JSONL files (schema as DDL) with _path, _split, _family and _shard from the file name.

    Blank lines are skipped. malformed: `keep` has them in _corrupt_record, `drop`
    leaves them out, `fail` raises.
    """
    mode = {"keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[malformed]
    full = f"{schema}, _corrupt_record string" if malformed == "keep" else schema
    df = spark.read.schema(full).option("recursiveFileLookup", "true").option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return with_provenance(df)


def with_provenance(df: DataFrame) -> DataFrame:
    """A shard is a file, or a folder of part-files, of that name."""
    path = F.col("_metadata.file_path")
    part = lambda k: F.nullif(F.regexp_extract(path, SHARD + FILE_NAME + PART_FILE, k), F.lit(""))
    return df.select("*", path.alias("_path"), part(1).alias("_split"), part(2).alias("_family"), part(3).alias("_shard"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files: the shard's name, and the line's number in it, from 1. Blank lines count and are left out.

    Files are read in splits, by many tasks each. A split's lines are counted, and what
    comes before a split (part-files of a shard in their order, splits by where they
    begin) is added to a line's place in it. The lines themselves aren't shuffled
    while the counts (a row for each split) are small enough to be sent.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        file.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"),
        F.coalesce(F.nullif(F.regexp_extract(file, r"/(?:[^/=]+=)?([^/]+)/part-[^/]*$", 1), F.lit("")), F.regexp_extract(file, r"([^/]+)$", 1)).alias("path"),
    )
    splits = lines.groupBy("path", "_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("path").orderBy(F.length("_file"), "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = lines.join(splits, ["_file", "_block"]).where(F.trim("line") != "")
    return out.select("path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def load_errors(numbered: DataFrame) -> DataFrame:
    """Error rows `file:line` of lines that are no JSON."""
    bad = numbered.where(F.try_parse_json("line").isNull())
    return bad.select(F.format_string("%s:%d", "path", "line_no").alias("id"), F.lit("unknown").alias("benchmark_family"), F.concat(F.lit("load_error: "), F.format_string("%s:%d", "path", "line_no")).alias("reason"))


def recovered(materialised: DataFrame, known: DataFrame, id_col: str = "id", defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of unknown, non-null ids, once each, with defaults for missing or null columns."""
    out = materialised.where(F.col(id_col).isNotNull()).join(known.select(id_col).distinct(), id_col, "left_anti").dropDuplicates([id_col])
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), v) if c in out.columns else v)
    return out


def texts_of(df: DataFrame, fields: list[str]) -> DataFrame:
    """(text): non-empty values of the fields; arrays give an element each, structs and maps their JSON."""
    out = None
    for c in fields:
        if c not in df.columns:
            continue
        kind = df.schema[c].dataType
        v = F.explode(c) if isinstance(kind, T.ArrayType) else F.col(c)
        rows = df.select(v.alias("_v"))
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        text = F.to_json("_v") if isinstance(inner, (T.StructType, T.MapType)) else F.col("_v").cast("string")
        rows = rows.select(text.alias("text")).where(F.trim("text") != "")
        out = rows if out is None else out.unionByName(rows)
    return out


def prefix_sample(df: DataFrame, order: list[str], text: str, rows: int = 120, chars: int = 1200) -> DataFrame:
    """The first rows in order, their texts cut (a bounded look at a benchmark; both cuts are the feature)."""
    return df.orderBy(*order).limit(rows).withColumn(text, F.substring(text, 1, chars))


def first_available(*loads) -> DataFrame:
    """The first of several ways to load a table (a split, a configuration) that exists."""
    missing: Exception | None = None
    for load in loads:
        try:
            df = load()
            df.schema  # noqa: B018  (resolves the plan)
            return df
        except AnalysisException as e:
            missing = e
    raise missing or ValueError("nothing to load")


def cached_or(spark: SparkSession, cache: str, load) -> DataFrame:
    """The stored table if it is there, or else what load() gives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(cache)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(cache) if there else load()


def names_expanded(wanted: DataFrame, known: DataFrame, name: str = "name", order: str = "place") -> DataFrame:
    """(place, name): the names of a table with aliases written out and `all` as every known one, each once, where it comes first.

    Both tables have a name and a place. Places of what stands for several names are those of the one it comes from.
    """
    aliases = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = wanted.select(F.col(order).alias("_a"), F.col(name).alias("_n"))
    parts = rows.where("_n <> 'all'").select("_a", F.posexplode(F.coalesce(aliases[F.col("_n")], F.array("_n"))).alias("_b", "_n"))
    # Of `all` only the first one counts, so a known name meets one row, whatever the number of names.
    first_all = rows.where("_n = 'all'").groupBy("_n").agg(F.min("_a").alias("_a")).withColumnRenamed("_n", "_all")
    every = known.select(F.col(order).alias("_b"), F.col(name).alias("_n"), F.lit("all").alias("_all")).join(first_all, "_all")
    first = parts.unionByName(every.select("_a", F.col("_b").cast("int").alias("_b"), "_n")).groupBy("_n").agg(F.min(F.struct("_a", "_b")).alias("_p"))
    return first.select(F.col("_p._a").alias("place"), F.col("_p._b").alias("part"), F.col("_n").alias("name"))


def unified(parts: dict[str, DataFrame], tag: str = "family") -> DataFrame:
    """Union by name of differently shaped inputs, with the name of each in `tag`."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def expand_aliases(names: list[str], known: list[str]) -> list[str]:
    """Names with aliases written out and `all` as every known one, each once, in order."""
    out: list[str] = []
    for n in names:
        out += known if n == "all" else ALIASES.get(n, [n])
    return list(dict.fromkeys(out))


def count_lines(spark: SparkSession, path: str, blank: bool = False) -> int:
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return (lines if blank else lines.where(F.trim("value") != "")).count()


def fixture(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)
