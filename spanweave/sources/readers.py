"""Sources: files of many kinds as documents (doc_id, text) or sentences (doc_id, sent_id, tokens, …).

`read(spark, type, path, **options)` looks a reader up by its label; `register` adds one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}
SENTENCES = "doc_id string, sent_id int, tokens array<string>, offsets array<int>, ann map<string,array<array<string>>>, deps array<struct<child int,parent int,label string>>"


def register(label: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        READERS[label] = f
        return f

    return add


def read(spark: SparkSession, label: str, path, **options) -> DataFrame:
    if label not in READERS:
        raise ValueError(f"no source type {label!r}; there are {', '.join(sorted(READERS))}")
    return READERS[label](spark, path, **options)


def _whole(spark: SparkSession, path, recursive: bool = False) -> DataFrame:
    found = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


@register("text")
def plain_file(spark, path):
    """One file, one document."""
    return _whole(spark, path).select(F.col("path").alias("doc_id"), "text")


@register("lines")
def plain_lines(spark, path):
    """Each line that isn't blank is a document, file:N by its number among them.

    Lines of a file are numbered in one task for each file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("n", "text"))
    return lines.select(F.concat_ws(":", "file", F.col("n") + 1).alias("doc_id"), "text")


@register("string")
def strings(spark, texts):
    """Texts at hand, named by their first 50 characters."""
    texts = [texts] if isinstance(texts, str) else list(texts)
    return spark.createDataFrame([(t[:50], t) for t in texts], "doc_id string, text string")


def _csv(spark, path, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)


@register("csv")
def csv_column(spark, path, column: str = "text", sep: str = ","):
    """Each cell of a column is a document, file:row; rows without text are left out but counted."""
    cells = _csv(spark, path, sep).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("i"), F.col(column).alias("text"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1
    return cells.select(F.concat_ws(":", "file", n).alias("doc_id"), "text").where(F.trim("text") != "")


@register("jsonl")
def json_lines(spark, path, text_field: str = "text", id_fields: list[str] | None = None):
    """JSON records; the id is the |-joined id fields, or the line number."""
    rows = spark.read.json(path)
    if id_fields:
        return rows.select(F.concat_ws("|", *[F.col(c).cast("string") for c in id_fields]).alias("doc_id"), F.col(text_field).alias("text"))
    numbered = rows.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("i"), F.col(text_field).alias("text"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1
    return numbered.select(n.cast("string").alias("doc_id"), "text")


@register("directory")
def directory(spark, path, filter_regex: str | None = None):
    """Files of a folder without those that begin with a dot; the filter is on the name."""
    found = _whole(spark, path).where(~F.col("file").startswith("."))
    found = found.where(F.col("file").rlike(filter_regex)) if filter_regex else found
    return found.select(F.col("path").alias("doc_id"), "text")


@register("dirtree")
def dirtree(spark, path, filter_regex: str | None = None):
    """Files of a folder and those below; the filter is on the whole path."""
    found = _whole(spark, path, True).where(~F.col("file").startswith("."))
    found = found.where(F.col("path").rlike(filter_regex)) if filter_regex else found
    return found.select(F.col("path").alias("doc_id"), "text")


@register("email")
def emails(spark, path):
    return directory(spark, path, r"\.txt$")


@register("table")
def table(spark, frame: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Any DataFrame with a text column."""
    return frame.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def parse_conllu(text: str, name: str) -> Iterator[dict]:
    """Sentences of a CoNLL-U text; heads become edges, xpos is pos, upos is tag."""
    doc, sent, rows = name, 0, []

    def done():
        tokens, offsets, at = [], [], 0
        for r in rows:
            tokens.append(r[1])
            offsets.append(at)
            at += len(r[1]) + (0 if "SpaceAfter=No" in r[9] else 1)
        numbers = {r[0]: i for i, r in enumerate(rows)}
        cell = lambda x: [x] if x != "_" else None
        return {
            "doc_id": doc,
            "sent_id": sent,
            "tokens": tokens,
            "offsets": offsets,
            "ann": [("pos", [cell(r[4]) for r in rows]), ("tag", [cell(r[3]) for r in rows]), ("lemma", [cell(r[2]) for r in rows])],
            "deps": [{"child": i, "parent": numbers.get(r[6], -1), "label": r[7]} for i, r in enumerate(rows) if r[6] != "_"],
        }

    for line in [*text.splitlines(), ""]:
        if line.startswith("#"):
            key, _, value = line[1:].partition("=")
            if key.strip().startswith("newdoc"):
                doc, sent = f"{name}:{value.strip()}" if value.strip() else name, 0
        elif line.strip():
            cells = line.split("\t")
            if len(cells) == 10 and cells[0].isdigit():
                rows.append(cells)
        elif rows:
            yield done()
            sent, rows = sent + 1, []


def parse_simple(text: str, name: str) -> Iterator[dict]:
    """Sentences of label⇥start⇥end⇥token lines; labels become the ner layer."""
    sent, rows = 0, []
    for line in [*text.splitlines(), ""]:
        if line.strip():
            label, start, end, token = line.split("\t")
            if int(end) - int(start) != len(token):
                raise ValueError(f"{name}: {token!r} doesn't fit its offsets {start}-{end}")
            rows.append((label, int(start), token))
        elif rows:
            yield {"doc_id": name, "sent_id": sent, "tokens": [r[2] for r in rows], "offsets": [r[1] for r in rows], "ann": [("ner", [[r[0]] for r in rows])], "deps": []}
            sent, rows = sent + 1, []


def _parsed(files: DataFrame, parse) -> DataFrame:
    layer = pa.map_(pa.string(), pa.list_(pa.list_(pa.string())))
    dep = pa.list_(pa.struct([("child", pa.int32()), ("parent", pa.int32()), ("label", pa.string())]))
    schema = pa.schema([("doc_id", pa.string()), ("sent_id", pa.int32()), ("tokens", pa.list_(pa.string())), ("offsets", pa.list_(pa.int32())), ("ann", layer), ("deps", dep)])

    def run(it):
        for b in it:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(parse(text or "", name))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("doc_id", "text").mapInArrow(run, SENTENCES)


@register("conllu_string")
def conllu_string(spark, text: str, name: str = "string"):
    return _parsed(spark.createDataFrame([(name, text)], "doc_id string, text string"), parse_conllu)


@register("conllu_file")
def conllu_file(spark, path):
    return _parsed(plain_file(spark, path), parse_conllu)


@register("conllu_directory")
def conllu_directory(spark, path, filter_regex: str | None = None):
    return _parsed(directory(spark, path, filter_regex), parse_conllu)


@register("conllu_dirtree")
def conllu_dirtree(spark, path, filter_regex: str | None = None):
    return _parsed(dirtree(spark, path, filter_regex), parse_conllu)


@register("simple_file")
def simple_file(spark, path):
    return _parsed(plain_file(spark, path), parse_simple)


@register("simple_directory")
def simple_directory(spark, path, filter_regex: str | None = None):
    return _parsed(directory(spark, path, filter_regex), parse_simple)


@register("d3m")
def d3m(spark, csv_path, text_dir, file_column: str = "raw_text_file", target: str = "label", rewrites: dict[str, str] | None = None, positive=None):
    """Rows of a learning table with the text files that they name; literal rewrites; one class only, if given."""
    rows = _csv(spark, csv_path)
    rows = rows.where(F.col(target) == positive) if positive is not None else rows
    texts = _whole(spark, text_dir).select(F.col("file").alias("_file"), "text")
    text = F.col("text")
    for a, b in (rewrites or {}).items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return rows.join(texts, rows[file_column] == texts["_file"]).select(F.col(file_column).alias("doc_id"), text.alias("text"), F.col(target).alias("target"))


@register("patents")
def patents(spark, path):
    return csv_column(spark, path, "para")


@register("mazda")
def comments(spark, path):
    return csv_column(spark, path, "Comment")


@register("encounter")
def encounter(spark, path):
    return csv_column(spark, path, "text")


@register("denso")
def annotations(spark, path, tier: str = "Dictation"):
    """Annotation values of a tier of EAF XML, in order, as one document a file."""
    tiers = spark.read.format("xml").option("rowTag", "TIER").load(path)
    rows = tiers.where(F.col("_TIER_ID") == tier).select(F.col("_metadata.file_path").alias("doc_id"), F.explode("ANNOTATION").alias("a"))
    return rows.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("a.ALIGNABLE_ANNOTATION.ANNOTATION_VALUE")).alias("text"))


TWITTER_TOKEN = r"(?i)#?@?[a-z0-9_]+|\S"


@register("twitter_reply")
def twitter_reply(spark, path):
    """Replies of JSON threads to somebody else's message, without astral signs, with tokens of their own kind."""
    rows = spark.read.json(path, multiLine=True)
    text = F.regexp_replace("text", "[\\x{10000}-\\x{10FFFF}]", "")
    kept = rows.where(F.col("user") != F.coalesce(F.col("in_reply_to_user"), F.lit("")))
    return kept.select(F.col("id").cast("string").alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(TWITTER_TOKEN), F.lit(0)).alias("tokens"))


def _grouped(spark, path, keys: list[str], allowed: list[str] | None) -> DataFrame:
    rows = _csv(spark, path).withColumn("_i", F.monotonically_increasing_id())
    if allowed is not None:
        ids = spark.createDataFrame([(x,) for x in allowed], f"{keys[0]} string")
        rows = rows.join(ids, keys[0], "left_semi")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "TEXT"))), lambda x: x["TEXT"]), " ")
    return rows.groupBy(*keys).agg(text.alias("text")).select(F.concat_ws("|", *keys).alias("doc_id"), "text")


@register("rpe")
def rpe(spark, path, allowed: list[str] | None = None):
    """Rows with the same DOC, PARA and SENT as one sequence."""
    return _grouped(spark, path, ["DOC", "PARA", "SENT"], allowed)


@register("convacc")
def convacc(spark, path, allowed: list[str] | None = None):
    """Rows with the same DOCID as one sequence."""
    return _grouped(spark, path, ["DOCID"], allowed)


@register("recipes")
def recipes(spark, path):
    """One sequence for each step: (doc_id, sent_id, text)."""
    return spark.read.json(path).select(F.col("id").cast("string").alias("doc_id"), F.posexplode("prepSteps").alias("sent_id", "text"))


@register("triggers_news")
def news(spark, path):
    """Pages of line-marked news dumps: "==== SITE" and "== " begin a page; marker lines are left out.

    Files of the same name in different folders are kept apart, though both give their name to the pages.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    page = F.sum(F.col("line").rlike("^==").cast("int")).over(Window.partitionBy("path").orderBy("n"))
    marked = lines.withColumn("page", page).where(~F.col("line").rlike("^(==|ERROR |DATE|KEYWORDS|SUMMARY)") & (F.trim("line") != "") & (F.col("page") > 0))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy("path", "file", "page").agg(text.alias("text")).select(F.concat_ws(":", "file", "page").alias("doc_id"), "text")


@register("coo")
def coordinates(spark, path, value: str = "n", kind: str = "long"):
    """i⇥j⇥value tables of counts, associations or divergences."""
    return spark.read.csv(path, sep="\t", schema=f"i int, j int, {value} {kind}")


@register("indexed")
def indexed(spark, path, value: str = "label", kind: str = "string"):
    """Files whose line number is the index: labels, cluster maps, margins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("i", value))
    return lines.select("i", F.col(value).cast(kind))


@register("embeddings")
def embeddings(spark, path):
    """word v1 … vn lines."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", " ").alias("p"))
    return parts.select(F.get("p", F.lit(0)).alias("word"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))
