"""CoNLL-U in and out, and other line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import together as T

FIELDS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def read_blocks(spark: SparkSession, path: str | list[str], pattern: str = "*.conllu", whole: bool = False) -> DataFrame:
    """(file, part, block_no, block): a sentence each, split at empty lines; part and block_no order them within a file.

    The reader splits files at empty lines, so a large file is read by many tasks. Files with carriage returns have none of that kind: they need
    ``whole``, which reads each file as one row and drops the returns.
    """
    source = F.col("_metadata.file_path").alias("file")
    if whole:
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        blocks = files.select(source, F.lit(0).cast("long").alias("part"), F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n{2,}")).alias("block_no", "block"))
        blocks = blocks.withColumn("block_no", F.col("block_no").cast("long"))
    else:
        files = spark.read.option("lineSep", "\n\n").text(path, recursiveFileLookup=True, pathGlobFilter=pattern)
        blocks = files.select(source, F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("block_no"), F.col("value").alias("block"))
    return blocks.withColumn("block", F.trim("block", F.lit("\n"))).where("block <> ''")


def comments(block: Column) -> Column:
    return F.filter(F.split(block, "\n"), lambda x: F.startswith(x, F.lit("#")))


def comment(block: Column, key: str) -> Column:
    """A comment's value, null without one."""
    found = F.regexp_extract(block, rf"(?im)^#\s*{key}\s*=\s*(.*)$", 1)
    return F.when(found != "", F.trim(found))


def parse_tokens(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Tokens of column ``block``, with the other columns: ids are whole numbers, ranges and empty nodes drop out.

    ``strict`` raises on lines without ten columns and on ids that are no whole number, and skips forms that are an underscore.
    """
    keep = [c for c in blocks.columns if c != "block"]
    lines = blocks.select(*keep, F.coalesce(comment(F.col("block"), "sent_id"), F.lit(None).cast("string")).alias("sent_id"), F.explode_outer(F.split("block", "\n")).alias("line")).where("line <> '' and not startswith(line, '#')")
    # an array's only item is made once; a column would be split anew for each of the conditions
    lines = lines.select("*", F.explode_outer(F.array(F.split("line", "\t"))).alias("c"))
    if strict:
        lines = lines.withColumn("c", F.when(F.size("c") == 10, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("not ten columns: "), F.col("line")))))
        odd = (F.get("c", F.lit(1)) != "_") & ~F.get("c", F.lit(0)).rlike("^[0-9]+$")
        lines = lines.withColumn("c", F.when(odd, F.raise_error(F.concat(F.lit("not a token's id: "), F.get("c", F.lit(0))))).otherwise(F.col("c")))
    rows = lines.where(F.size("c") >= 10).where(F.get("c", F.lit(0)).rlike("^[0-9]+$"))
    blank = lambda x: F.when(x != "_", x)
    values = [F.get("c", F.lit(i)) for i in range(10)]
    out = rows.select(
        *keep, "sent_id", values[0].cast("long").alias("id"), values[1].alias("form"), *[blank(values[i]).alias(FIELDS[i]) for i in range(2, 6)],
        F.coalesce(values[6].try_cast("long"), F.lit(0)).cast("long").alias("head"), *[blank(values[i]).alias(FIELDS[i]) for i in range(7, 10)],
    )
    return out.where("form <> '_'") if strict else out


def read_lossless(blocks: DataFrame) -> DataFrame:
    """Every line of column ``block`` with its number, the sentence's id, and its ten cells; cells are null for comments and odd lines, which stay as they are."""
    keep = [c for c in blocks.columns if c != "block"]
    lines = blocks.select(*keep, comment(F.col("block"), "sent_id").alias("sent_id"), F.posexplode(F.split("block", "\n")).alias("line_no", "line"))
    cells = F.split("line", "\t")
    return lines.withColumn("cells", F.when(F.size(cells) == 10, cells)).withColumn("id", F.when(F.get("cells", F.lit(0)).rlike("^[0-9]+$"), F.get("cells", F.lit(0)).cast("long")))


def from_lossless(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., block): lines put together again, cells before the line they were read from."""
    text = F.coalesce(F.array_join("cells", "\t"), F.col("line"))
    body = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("text")))).alias("x"))
    return body.select(*by, F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("block"))


def gold_frame(blocks: DataFrame) -> DataFrame:
    """sent_id, text, id, form, upos, feats, head, deprel; a sentence without id is ``sent_N`` by its place in the file, missing values are empty."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("part", "block_no"))
    named = blocks.withColumns({"__n": place, "text": comment(F.col("block"), "text")})
    rows = parse_tokens(named.select("file", "text", "__n", "block"))
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("upos", "feats")]
    return rows.select(F.coalesce("sent_id", F.concat(F.lit("sent_"), F.col("__n").cast("string"))).alias("sent_id"), "text", "id", "form", *empty, "head", F.coalesce("deprel", F.lit("")).alias("deprel"))


def manifest(files: DataFrame) -> DataFrame:
    """(file, scheme, subset, run, split, role) from paths like ``.../run2/ud-new-bert/test.pred.conllu``: subset full without a suffix, run 1 without a folder."""
    folder, name = F.element_at(F.split("file", "/"), -2), F.element_at(F.split("file", "/"), -1)
    parts = F.regexp_extract(folder, r"^(ud|str)(?:-(new|old))?(?:-.*)?$", 1), F.regexp_extract(folder, r"^(?:ud|str)-(new|old)(?:-.*)?$", 1)
    run = F.regexp_extract("file", r"/run(\d+)/", 1)
    return files.select(
        "file", F.nullif(parts[0], F.lit("")).alias("scheme"), F.when(parts[1] == "", "full").otherwise(parts[1]).alias("subset"), F.coalesce(run.try_cast("int"), F.lit(1)).alias("run"),
        F.regexp_extract(name, r"^([a-z]+)", 1).alias("split"), F.when(F.contains(name, F.lit(".pred.")), "pred").otherwise("gold").alias("role"),
    )


def to_blocks(tokens: DataFrame, *by: str, together: bool = False) -> DataFrame:
    """(by..., block): sentences as CoNLL-U text; missing columns are underscores.

    ``together``: the rows of a sentence are neighbours, in order, and no shuffle is needed; there is no ``by`` then.
    """
    have = {c.lower() for c in tokens.columns}
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("_")) if c in have else F.lit("_") for c in FIELDS]
    head = F.concat(F.lit("# sent_id = "), F.col("sent_id"), F.lit("\n"), F.col("body")).alias("block")
    if together and not by:
        return T.joined(tokens.select("sent_id", F.concat_ws("\t", *cells).alias("body")), "body", "\n").select("sent_id", head)
    lines = tokens.select(*by, "sent_id", F.struct(F.col("id"), F.concat_ws("\t", *cells).alias("line")).alias("x"))
    body = lines.groupBy(*by, "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    return body.select(*by, "sent_id", head)


def write(blocks: DataFrame, path: str, *partition_by: str) -> None:
    """Blocks as text files; the separator between rows is the empty line between sentences."""
    w = blocks.select(*partition_by, F.col("block").alias("value")).write.option("lineSep", "\n\n")
    (w.partitionBy(*partition_by) if partition_by else w).text(path)


def parse_report(lines: DataFrame) -> DataFrame:
    """(file, run, corpus, metric, value) of a metrics report: ``line_no`` orders ``line`` within ``file``."""
    w = Window.partitionBy("file").orderBy("line_no")
    run = F.nullif(F.regexp_extract("line", r"^===\s*(.*?)\s*===$", 1), F.lit(""))
    corpus = F.nullif(F.regexp_extract("line", r"^Corpus:\s*(.*)$", 1), F.lit(""))
    rows = lines.withColumn("run", F.last(run, True).over(w)).withColumn("corpus", F.last(corpus, True).over(w))
    value = F.regexp_extract("line", r"^\s*([^|]+?)\s*\|\s*([-+0-9.eE]+)\s*$", 2).try_cast("double")
    return rows.select("file", "run", "corpus", F.regexp_extract("line", r"^\s*([^|]+?)\s*\|", 1).alias("metric"), value.alias("value")).where("value is not null")


def gold_links(text: Column) -> Column:
    """Pairs (str, ud) of numbers drawn as links ``str-w-N ... ud-w-M`` in a picture's source."""
    found = F.regexp_extract_all(text, F.lit(r"(str-w-\d+[^;\n]*?ud-w-\d+)"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"str-w-(\d+)", 1).cast("int").alias("str_id"), F.regexp_extract(x, r"ud-w-(\d+)", 1).cast("int").alias("ud_id")))
