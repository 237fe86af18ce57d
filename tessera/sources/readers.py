"""Readers. Every row gets ``ord``: files in name order, then place in the file, since most operators keep the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as X
from tessera.functions.ordinals import running


def _files(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.col("_metadata.file_path"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, pos, value): lines of text files, cut at line feeds, with their exact places whatever the splits: each split
    counts its lines, sums of the counts by place in the file give a split's first line, and no task reads a whole file."""
    raw = _files(spark.read.option("lineSep", "\n").text(path)).select("file", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    n = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))  # a row a split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = n.select("file", "block", (before - F.col("first")).alias("shift"), F.dense_rank().over(Window.orderBy("file")).alias("f"))
    x = raw.join(at, ["file", "block"]).withColumn("pos", F.col("shift") + F.col("m"))
    return x.select("file", (F.col("f") * F.lit(1 << 40) + F.col("pos")).alias("ord"), "pos", F.regexp_replace("value", "\r$", "").alias("value"))


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; blank ones are skipped; bad ones raise (strict) or go. Columns of the schema, file, pos, ord."""
    x = text_lines(spark, path).where(F.trim("value") != "")
    opts = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    if strict:
        return x.select("file", "pos", "ord", F.from_json("value", ddl, opts).alias("j")).select("file", "pos", "ord", "j.*")
    ok = F.try_parse_json("value").isNotNull()
    return x.where(ok).select("file", "pos", "ord", F.from_json("value", ddl).alias("j")).where("j is not null").select("file", "pos", "ord", "j.*")


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the last read."""
    return df.withColumn("rn__", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).where("rn__ = 1").drop("rn__")


def decoded(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "gbk"), most: int = 1_000_000, glob: str = "*") -> DataFrame:
    """(path, text, encoding): whole files of at most ``most`` bytes (the source's own limit) by the first
    encoding that fits, else UTF-8 with bad bytes left out."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("struct<text: string, encoding: string>")
    def decode(data):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(x: bytes) -> tuple[str, str]:
            for e in encodings:
                try:
                    return x.decode(e), e
                except UnicodeDecodeError:
                    continue
            return x.decode("utf-8", errors="ignore"), "utf-8?"

        return pd.DataFrame([one(bytes(x)) for x in data], columns=["text", "encoding"])

    return b.select("path", decode(F.expr(f"substring(content, 1, {most})")).alias("d")).select("path", "d.text", "d.encoding")


def task_files(spark: SparkSession, path: str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """(ord, task_id, name, path, text): files in ``task_*`` folders under a folder, anywhere below or right in them, by the
    task's number, then name; a folder without a number comes last. A file of a nested task folder belongs to the innermost."""
    x = decoded(spark, path, ("utf-8",), glob=glob)
    inner = F.regexp_extract("path", r".*/task_([^/]*)/" + (".*" if recursive else "[^/]*$"), 1)
    x = x.where(F.col("path").rlike(r"/task_[^/]*/" + ("" if recursive else "[^/]*$"))).withColumn("task_id", X.task_id(F.concat(F.lit("task_"), inner)))
    x = x.withColumns({"num": F.coalesce(F.col("task_id").cast("long"), F.lit(10**9)), "name": F.element_at(F.split("path", "/"), -1)})
    return running(x, ["num", "name", "path"], name="ord")[0].select("ord", "task_id", "name", "path", "text")


def json_any(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): records of JSON files that hold an array, {data|tasks|items: [...]}, one object or lines."""
    w = _files(spark.read.text(path, wholetext=True)).withColumn("v", F.try_parse_json("value"))
    inner = F.coalesce(*[F.expr(f"try_variant_get(v, '$.{k}', 'array<variant>')") for k in ("data", "tasks", "items")], F.expr("try_variant_get(v, '$', 'array<variant>')"), F.when(F.col("v").isNotNull(), F.array("v")))
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    # a parser may stop after the first of several values, so lines that are values each count as lines
    several = (F.size(lines) > 1) & F.forall(lines, lambda s: F.try_parse_json(s).isNotNull())
    records = F.when(several | inner.isNull(), F.transform(lines, lambda s: F.parse_json(s))).otherwise(inner)
    return w.select("file", F.posexplode(records).alias("pos", "r")).select("file", "pos", F.to_json("r").alias("value"))


def traces(spark: SparkSession, planner: str, actor: str, schema: str) -> DataFrame:
    """Planner records, then actor records, tagged where they have no tag."""
    one = lambda p, t: jsonl(spark, p, schema).withColumn("trace_type", F.coalesce("trace_type", F.lit(t)))
    return one(planner, "planner").withColumn("part", F.lit(0)).unionByName(one(actor, "actor").withColumn("part", F.lit(1)))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True)


def markdown_table(df: DataFrame) -> DataFrame:
    """A table's rows as Markdown, in a column line."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("line"))


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, paths): where images of a base name lie; their contents aren't read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    b = b.where(F.lower("path").rlike(r"\.(?:png|jpe?g|gif|webp|bmp)$"))
    return b.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def page_text(html):  # noqa: ANN001, ANN201
    """A page's text: no scripts, styles, comments or tags; the usual entities; blanks shrink."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|br|li|tr|h[1-6]|title|section|article)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def page_links(html, base):  # noqa: ANN001, ANN201
    """Absolute links, images' sources and backgrounds of a page, in order."""
    raw = F.concat(F.regexp_extract_all(html, F.lit(r"""(?i)(?:src|href)\s*=\s*["']([^"']+)["']"""), 1), F.regexp_extract_all(html, F.lit(r"""(?i)background-image\s*:\s*url\(\s*["']?([^"')]+)"""), 1))
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return F.transform(raw, lambda u: F.when(u.rlike("^[a-z]+:"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), u)))


def replay_logs(spark: SparkSession, new: str, old: str) -> DataFrame:
    """(name, lines, title): logs of two folders; of one name the new folder's counts; the title stands in the first line."""
    one = lambda p, k: text_lines(spark, p).where(F.trim("value") != "").withColumn("name", F.element_at(F.split("file", "/"), -1)).withColumn("prio", F.lit(k))
    x = one(new, 0).unionByName(one(old, 1))
    x = x.withColumn("best", F.min("prio").over(Window.partitionBy("name"))).where("prio = best")
    return x.groupBy("name").agg(F.count(F.lit(1)).alias("lines"), F.get_json_object(F.min_by("value", "pos"), "$.title").alias("title"))
