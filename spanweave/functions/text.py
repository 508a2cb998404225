"""Tokens and sentences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z]+|[0-9]+|[^\s]"
TOKEN_WS = r"[A-Za-z]+|[0-9]+|[^\s]|\n|[ \t]+"
_BOUNDARY = {
    True: r"(?<!Dr|Mr|Mrs|Ms)([.?!;]\s)|(\n\s*\n)",
    False: r"(?<!Dr|Mr|Mrs|Ms)([.?!;]+\"?\s)",
}
# a boundary and what is dropped after it; the title is looked for at the sign only, not at every place
_CUT = r"(?:([.?!;](?<!(?:Dr|Mr|Mrs|Ms)[.?!;])\s)|(\n\s*\n)|\u0001)[^a-zA-Z]*"


def tokens(text: Column, lower: bool = False) -> Column:
    """Runs of ASCII letters or digits, and every other sign that isn't white space."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower) if lower else found


def tokens_ws(text: Column) -> Column:
    """As `tokens`, with line ends and runs of blanks as tokens."""
    return F.regexp_extract_all(text, F.lit(TOKEN_WS), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Tokens that begin with an ASCII letter or digit."""
    return F.filter(tokens(text), lambda t: t.rlike("^[A-Za-z0-9]"))


def chunks(text: Column, blank_lines: bool = True) -> Column:
    """The stretches of text between sentence boundaries; joined they are the text."""
    marked = F.regexp_replace(text, _BOUNDARY[blank_lines], "$0\u0001")
    return F.split(marked, "\u0001")


def sentences(text: Column, blank_lines: bool = True) -> Column:
    """Sentences: boundary at . ? ! ; before white space (not after a title) or at a blank line; whatever comes
    before the first ASCII letter of a sentence is dropped, and so are sentences without one."""
    if blank_lines:
        marked = F.regexp_replace(F.regexp_replace(text, r"\A[^a-zA-Z]+", ""), _CUT, "$1$2\u0001")
        return F.filter(F.split(marked, "\u0001"), lambda c: c != "")
    stripped = F.transform(chunks(text, blank_lines), lambda c: F.regexp_replace(c, "^[^a-zA-Z]+", ""))
    return F.filter(stripped, lambda c: c != "")


def offsets(text: Column) -> Column:
    """Character offsets of `tokens` in a sentence."""
    every = F.regexp_extract_all(text, F.lit(TOKEN + r"|\s"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, t: F.struct((a["at"] + F.length(t)).alias("at"), F.when(t.rlike(r"^\s$"), a["out"]).otherwise(F.array_append(a["out"], a["at"])).alias("out"))
    return F.aggregate(every, start, step, lambda a: a["out"])


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: bool = True) -> DataFrame:
    """One row for each sentence: (doc_id, sent_id, text, tokens).  Rows without text give none."""
    parts = sentences(F.col(text_col)) if split else F.array(F.col(text_col))
    found = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("sent_id", "text"))
    return found.withColumn("tokens", tokens(F.col("text")))


def token_table(sents: DataFrame) -> DataFrame:
    """One row for each token: (doc_id, sent_id, pos, tok)."""
    return sents.select("doc_id", "sent_id", F.posexplode("tokens").alias("pos", "tok"))


STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with not no but "
    "if then than so such into over under again once here there when where why how all any both each few more most "
    "other some only own same too very can just i me my we our you your she her him his they them their what which "
    "who whom these those am been being have had having do does did doing because until while about against between "
    "through during before after above below up down out off nor"
).split()


def is_stop_word(tok: Column) -> Column:
    return F.lower(tok).isin(STOP_WORDS)
