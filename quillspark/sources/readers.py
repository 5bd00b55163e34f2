"""Sources: tagged corpora, run logs, marked sections, delimited labels, JSON and whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip_space


def tagged_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_no, content) of text files of ``<DOC><DOCNO>..</DOCNO><TEXT>..</TEXT></DOC>`` records.

    Records are split at ``</DOC>``, so files of any size are read in parallel.
    Fields are parsed once: ``<`` inside a text is text.
    """
    lines = spark.read.option("lineSep", "</DOC>").text(path).filter(F.contains("value", F.lit("<TEXT>")))

    def field(tag: str) -> F.Column:
        return strip_space(F.regexp_extract("value", rf"(?s)<{tag}>(.*)</{tag}>", 1))

    return lines.select(F.nullif(field("DOCNO"), F.lit("")).alias("doc_no"), field("TEXT").alias("content"))


def tagged_text(doc_no: F.Column, content: F.Column) -> F.Column:
    """The record that ``tagged_documents`` reads."""
    return F.concat(F.lit("<DOC>\n<DOCNO>\n"), doc_no, F.lit("\n</DOCNO>\n<TEXT>\n"), content, F.lit("\n</TEXT>\n</DOC>"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, ts, level, message) of log files, read line by line in as many parts as Spark cuts them into.

    A line's number is its place in its part and the lines of the file's parts
    before it, one row a part. What follows a last line feed is an empty line.
    Lines without a time stamp have null ts and level.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    parts = read.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.first("size").alias("size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = read.join(F.broadcast(parts.select("file", "part", (before - F.col("first")).alias("shift"))), ["file", "part"]).select("file", (F.col("at") + F.col("shift")).cast("int").alias("line_no"), "line")
    ended = parts.groupBy("file").agg(F.sum("n").cast("int").alias("line_no"), F.sum("bytes").alias("bytes"), F.first("size").alias("size")).filter("bytes = size")
    files = placed.unionByName(ended.select("file", "line_no", F.lit("").alias("line")))
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) - (\w+) - (.*)$"
    stamped = F.rlike("line", F.lit(pattern))
    return files.select(
        "file", "line_no", F.when(stamped, F.to_timestamp(F.regexp_extract("line", pattern, 1), "yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        F.when(stamped, F.regexp_extract("line", pattern, 2)).alias("level"), F.when(stamped, F.regexp_extract("line", pattern, 3)).otherwise(F.col("line")).alias("message"),
    )


RAG_SCHEMA = "array<struct<docId:string,BM25_score:double,BM25_ranking:int,SPLADE_score:double,SPLADE_ranking:int,denseEmbedding_score:double,denseEmbedding_ranking:int,crossEncoder_score:double,crossEncoder_ranking:int,MonoT5_score:double,MonoT5_ranking:int,LLM_score:double,LLM_ranking:int>>"


def answers_from_log(lines: DataFrame) -> DataFrame:
    """(file, run_no, question_no, answer, correct_answer, is_correct, rag, ts) from log lines.

    A header line ``use_RAG:`` begins a run. The last ``RAG data:`` line goes
    with the next question. A question number that is not the running count
    ends what counts of its run.
    """
    ordered = Window.partitionBy("file").orderBy("line_no")
    run = F.sum(F.when(F.startswith("message", F.lit("use_RAG:")), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    rag = F.when(F.startswith("message", F.lit("RAG data: ")), F.expr("substring(message, 11)"))
    asked = F.startswith("message", F.lit("question "))
    rows = lines.withColumns({"run_no": run, "asked": asked, "rag_line": rag})
    block = F.sum(F.col("asked").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("block", F.coalesce(block, F.lit(0)))
    rows = rows.withColumn("rag_line", F.last("rag_line", ignorenulls=True).over(Window.partitionBy("file", "run_no", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.filter("asked").select(
        "file", "run_no", "line_no", "ts", F.regexp_extract("message", r"^question (\d+)", 1).cast("int").alias("question_no"),
        F.regexp_extract("message", r"answer:(\S+)\s+correct_answer:(\S+)", 1).alias("answer"), F.regexp_extract("message", r"answer:(\S+)\s+correct_answer:(\S+)", 2).alias("correct_answer"),
        F.from_json("rag_line", RAG_SCHEMA, {"allowSingleQuotes": "true"}).alias("rag"),
    )
    per_run = Window.partitionBy("file", "run_no").orderBy("line_no")
    found = found.withColumn("bad", F.row_number().over(per_run) != F.col("question_no"))
    broken = F.max(F.col("bad").cast("int")).over(per_run.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("broken", broken).filter("broken = 0").select("file", "run_no", "question_no", "answer", "correct_answer", (F.col("answer") == F.col("correct_answer")).alias("is_correct"), "rag", "ts")


def sections(lines: DataFrame, markers: dict[str, str], end: str) -> DataFrame:
    """Records of lines (file, line_no, message) made of sections.

    ``markers`` maps a line that opens a section to the column of its text; a
    line that begins with ``end`` closes the record and gives column ``output``.
    """
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    record = F.coalesce(F.sum(F.startswith("message", F.lit(end)).cast("int")).over(upto), F.lit(0))
    name = F.lit(None).cast("string")
    for line, column in markers.items():
        name = F.when(strip_space(F.col("message")) == line, column).otherwise(name)
    name = F.when(F.startswith("message", F.lit(end)), "output").otherwise(name)
    marked = lines.withColumns({"record": record, "opens": name})
    inside = F.last("opens", ignorenulls=True).over(Window.partitionBy("file", "record").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("section", inside).filter((F.col("opens").isNull() & F.col("section").isNotNull()) | (F.col("opens") == "output"))
    columns = [*dict.fromkeys(markers.values()), "output"]
    texts = [strip_space(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == c, F.struct("line_no", "message")))), lambda x: x["message"]), "\n")).alias(c) for c in columns]
    out = marked.groupBy("file", "record").agg(*texts, F.max((F.col("section") == "output").cast("int")).alias("ended"))
    return out.filter("ended = 1").withColumn("output", F.expr(f"substring(output, {len(end) + 1})")).drop("ended")


def keyed_sections(spark: SparkSession, path: str, first: str, texts: dict[str, str], listed: tuple[str, str]) -> DataFrame:
    """Records of text files whose marker lines carry values: ``[question index:]12``, ``[rag_doc:]0:text``.

    ``first`` marks the line that opens a record; the whole number behind it is
    column ``number``. ``texts`` maps markers to the columns of their text: what
    follows on the line and, up to the next marker, on lines after it. Lines of
    ``listed`` (marker, column) hold ``n:text`` and make an array of their texts
    in the order of the lines. A marker may stand anywhere in its line. A file is
    one task, as its order matters. Lines before the first record are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    found, value = F.lit(None).cast("string"), F.col("line")
    for marker in reversed([first, *texts, listed[0]]):
        at = F.instr(F.col("line"), marker)
        found = F.when(at > 0, marker).otherwise(found)
        value = F.when(at > 0, F.substring(F.col("line"), at + len(marker), F.length("line"))).otherwise(value)
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = files.select("file", "line_no", found.alias("marker"), value.alias("value"))
    rows = rows.withColumn("record", F.sum((F.col("marker").eqNullSafe(F.lit(first))).cast("int")).over(upto)).filter("record > 0")
    inside = F.last("marker", ignorenulls=True).over(Window.partitionBy("file", "record").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("section", inside)

    def of(section: str, own: bool = False) -> F.Column:
        row = F.when((F.col("section") == section) & (F.col("marker").isNotNull() if own else F.lit(True)), F.struct("line_no", "value"))
        return F.transform(F.array_sort(F.collect_list(row)), lambda x: x["value"])

    number = F.max(F.when(F.col("marker") == first, F.expr("try_cast(trim(value) as bigint)"))).alias("number")
    docs = F.transform(of(listed[0], own=True), lambda x: F.substr(x, F.instr(x, ":") + 1)).alias(listed[1])
    return rows.groupBy("file", "record").agg(number, *(strip_space(F.array_join(of(m), "\n")).alias(c) for m, c in texts.items()), docs)


def delimited_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of lines ``label ||| text``."""
    parts = F.split("value", r" \|\|\| ", 2)
    return spark.read.text(path).filter(F.contains("value", F.lit(" ||| "))).select(parts[0].cast("int").alias("label"), parts[1].alias("text"))


def json_questions(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, question, options, answer) of nested JSON ``{"quiz": {section: {name: {...}}}}``."""
    raw = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "struct<quiz:map<string,map<string,struct<question:string,options:array<string>,answer:string>>>>")
    rows = raw.select(F.explode(nested["quiz"]).alias("section", "names")).select("section", F.explode("names").alias("name", "q"))
    return rows.select("section", "name", "q.*")


def json_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(key, *columns) of column-oriented JSON files ``{column: {key: value, ...}, ...}``; ``columns`` maps names to types.

    A row has the values that the columns give for its key, null where one has none.
    """
    raw = spark.read.text(path, wholetext=True)
    kind = ", ".join(f"`{c}`: map<string, {t}>" for c, t in columns.items())
    data = raw.select(F.input_file_name().alias("file"), F.from_json("value", f"struct<{kind}>").alias("c"))
    keys = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.map_keys(F.col("c")[c]), F.array().cast("array<string>")) for c in columns))))
    rows = data.withColumn("key", F.explode(keys))
    return rows.select("key", *(F.try_element_at(F.col("c")[c], F.col("key")).alias(c) for c in columns))


def dataset(spark: SparkSession, path: str, split: str, config: str | None = None) -> DataFrame:
    """A split of a data set that is kept as ``path/config=.../split=...`` (or ``path/split=...``); other folders are not read."""
    found = spark.read.option("basePath", path).parquet(path)
    chosen = found.filter(F.col("split") == split)
    if config is not None:
        chosen = chosen.filter(F.col("config") == config)
    return chosen.drop("split", "config")


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """(n_files, n_bytes) of all files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def question_record(question: F.Column, options: F.Column, answer: F.Column) -> F.Column:
    """A question as a record with its options (array of letter and text) as lines, and its answer's text."""
    lines = F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(". "), o["text"], F.lit("\n"))), "")
    return F.concat(F.lit("<DOC>\n<TEXT>\n"), question, F.lit("\n\n"), lines, F.lit("</TEXT>\n<ANSWER>\n"), answer, F.lit("\n</ANSWER>\n</DOC>\n"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole text, html, markdown or JSON files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
