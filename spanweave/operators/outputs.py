"""What is made of matches: histograms, features, tags, markup, snippets, offsets, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "sent_id"]


def with_text(spans: DataFrame, sents: DataFrame, context: int = 0) -> DataFrame:
    """Spans with their tokens joined by blanks (`context` more on both sides)."""
    b = F.greatest(F.col("begin") - context, F.lit(0))
    e = F.least(F.col("end") + context, F.size("tokens"))
    joined = spans.join(sents.select(*KEY, "tokens"), KEY)
    return joined.withColumn("match", F.array_join(F.slice("tokens", b + 1, e - b), " ")).drop("tokens")


def match_strings(matched: DataFrame, unique: bool = True) -> DataFrame:
    """Distinct match texts, line ends escaped; sort them by (lower, text) when they are written."""
    out = matched.select(F.regexp_replace("match", "\n", "\\\\n").alias("match"))
    return out.distinct() if unique else out


def tabulate(matched: DataFrame, headword: bool = False) -> DataFrame:
    """Number of matches by text, or by last token."""
    key = F.element_at(F.split("match", " "), -1) if headword else F.col("match")
    return matched.groupBy(key.alias("match")).agg(F.count("*").alias("n"))


def features(spans: DataFrame) -> DataFrame:
    """The names of the rules with a match, by sentence."""
    return spans.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("features"))


def grep(spans: DataFrame, sents: DataFrame) -> DataFrame:
    """The first sentence with a match of each document."""
    first = spans.groupBy("doc_id").agg(F.min("sent_id").alias("sent_id"))
    return first.join(sents.select(*KEY, "text"), KEY).select(*KEY, "text")


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def bio(sents: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each token: B-rule at the beginning of a span, I-rule inside, else O.  Spans must not overlap."""
    inside = spans.select(*KEY, "rule", "begin", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    toks = sents.select(*KEY, F.posexplode("tokens").alias("pos", "tok"))
    tag = F.when(F.col("rule").isNull(), "O").when(F.col("pos") == F.col("begin"), F.concat(F.lit("B-"), "rule")).otherwise(F.concat(F.lit("I-"), "rule"))
    return toks.join(inside, [*KEY, "pos"], "left").select(*KEY, "pos", "tok", tag.alias("tag"))


def bio_columns(sents: DataFrame, spans: DataFrame, rules: list[str]) -> DataFrame:
    """Tags as `bio`, one column for each rule."""
    inside = spans.select(*KEY, "rule", "begin", F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos"))
    tags = inside.groupBy(*KEY, "pos").agg(*[F.max(F.when(F.col("rule") == r, F.when(F.col("pos") == F.col("begin"), "B").otherwise("I"))).alias(r) for r in rules])
    toks = sents.select(*KEY, F.posexplode("tokens").alias("pos", "tok"))
    return toks.join(tags, [*KEY, "pos"], "left").select(*KEY, "pos", "tok", *[F.coalesce(r, F.lit("O")).alias(r) for r in rules])


def test_columns(sents: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """As `bio_columns`, for rules that are tests of single tokens (Columns over `tok`): no token leaves its row."""
    toks = sents.select(*KEY, F.posexplode("tokens").alias("pos", "tok"))
    return toks.select(*KEY, "pos", "tok", *[F.when(t, "B").otherwise("O").alias(r) for r, t in tests.items()])


def markup(sents: DataFrame, spans: DataFrame, trim: bool = False) -> DataFrame:
    """Sentences with >>> <<< around their matches (non-overlapping), in their order."""
    marks = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("m"))
    both = sents.select(*KEY, "tokens").join(marks, KEY, "inner" if trim else "left")
    word = F.transform(
        "tokens",
        lambda t, i: F.concat(
            F.when(F.exists("m", lambda x: x["begin"] == i), ">>> ").otherwise(""), t, F.when(F.exists("m", lambda x: x["end"] == i + 1), " <<<").otherwise("")
        ),
    )
    plain = F.array_join("tokens", " ")
    return both.select(*KEY, F.when(F.col("m").isNull(), plain).otherwise(F.array_join(word, " ")).alias("marked"))


def char_offsets(sents: DataFrame, spans: DataFrame, offsets: Column) -> DataFrame:
    """Spans with their first and last-but-one character in the sentence."""
    at = sents.select(*KEY, "tokens", offsets.alias("_at"))
    j = spans.join(at, KEY)
    return j.select(*KEY, "begin", "end", F.get("_at", F.col("begin")).alias("start_char"), (F.get("_at", F.col("end") - 1) + F.length(F.get("tokens", F.col("end") - 1))).alias("end_char"))


def present(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Whether each document has a match."""
    hit = spans.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return docs.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("_hit", F.lit(False)).alias("present"))


def document_features(docs: DataFrame, spans: DataFrame, rules: list[str]) -> DataFrame:
    """A column 0/1 for each rule beside each document."""
    flags = spans.groupBy("doc_id").agg(*[F.max((F.col("rule") == r).cast("int")).alias(r) for r in rules])
    return docs.select("doc_id").join(flags, "doc_id", "left").fillna(0, rules)


def layer_dump(sents: DataFrame, layer: str) -> DataFrame:
    """Token and layer value pairs."""
    zipped = F.arrays_zip(F.col("tokens").alias("tok"), F.transform(F.col("ann")[layer], lambda x: F.get(x, F.lit(0))).alias("value"))
    return sents.select(*KEY, F.posexplode(zipped).alias("pos", "x")).select(*KEY, "pos", "x.tok", "x.value")


def edge_labels(sents: DataFrame) -> DataFrame:
    """Number of dependency edges by label."""
    return sents.select(F.explode("deps").alias("d")).groupBy("d.label").agg(F.count("*").alias("n"))


def prune_top(assoc: DataFrame, by: str, value: str, tie: str, limit: int = 40) -> DataFrame:
    """The `limit` smallest values of each `by`."""
    w = Window.partitionBy(by).orderBy(value, tie)
    return assoc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def training_tokens(sents: DataFrame, spans: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    """Sentences with matches and at most about `ratio` times as many without, with each token's label."""
    hit = spans.select(*KEY).distinct()
    positive = sents.join(hit, KEY, "left_semi")
    rest = sents.join(hit, KEY, "left_anti")
    n, m = positive.count(), rest.count()
    share = min(1.0, ratio * n / m) if m else 0.0
    below = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    chosen = positive.unionByName(rest.where(below))
    covered = spans.select(*KEY, F.explode(F.sequence("begin", F.col("end") - 1)).alias("pos")).distinct().withColumn("y", F.lit(1))
    return chosen.select(*KEY, F.posexplode("tokens").alias("pos", "tok")).join(covered, [*KEY, "pos"], "left").fillna(0, ["y"])


def membership_rule(name: str, words: list[str], width: int = 72) -> str:
    """Rule text of a membership test over selected words."""
    import textwrap

    return f"{name} : {{ " + "\n    ".join(textwrap.wrap(" ".join(words), width)) + " }"


def write_by_rule(matched: DataFrame, path: str) -> None:
    """Match texts as text files, one folder for each rule."""
    matched.select("rule", F.regexp_replace("match", "\n", "\\\\n").alias("value")).sort("rule", F.lower("value"), "value").write.partitionBy("rule").mode("overwrite").text(path)


def split_quota(docs: DataFrame, train: float = 0.8, test: float = 0.1, seed: int = 1) -> DataFrame:
    """Documents with a part, train, test or dev, by a seeded hash."""
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    return docs.withColumn("part", F.when(u < train, "train").when(u < train + test, "test").otherwise("dev"))


def frame_tuple(frames: DataFrame, fields: list[str]) -> DataFrame:
    """The named fields of frames (JSON) as columns, several values joined by /."""

    def one(f: str) -> Column:
        raw = F.get_json_object("fields", f"$.{f}")
        several = F.from_json(raw, "array<string>")
        return F.when(raw.startswith("["), F.array_join(several, "/")).otherwise(F.coalesce(raw, F.lit(""))).alias(f)

    return frames.select(*KEY, *[one(f) for f in fields])


def lemmas(sents: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with the lemmas of their tokens in lower case, joined by blanks."""
    layer = F.transform(F.col("ann")["lemma"], lambda x: F.lower(F.get(x, F.lit(0))))
    j = spans.join(sents.select(*KEY, layer.alias("_l")), KEY)
    return j.withColumn("lemmas", F.array_join(F.slice("_l", F.col("begin") + 1, F.col("end") - F.col("begin")), " ")).drop("_l")


def search(spans: DataFrame) -> DataFrame:
    """The first match of each document."""
    return spans.groupBy("doc_id").agg(F.min(F.struct("sent_id", "begin", "end")).alias("m")).select("doc_id", "m.*")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def write_frame_features(docs: DataFrame, spans: DataFrame, rules: list[str], path: str) -> None:
    """All columns of the documents with a 0/1 column for each rule, as CSV with a header."""
    docs.join(document_features(docs, spans, rules), "doc_id").write.mode("overwrite").csv(path, header=True)
