"""Tokenizers of other styles: newswire, treebank, predicate atoms, tagged blocks, token converters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMMON = "aug calif corp dec dr fla ill inc jan lt mr mrs no nov oct rev st vs wash"
_SHORT = {
    "newswire": frozenset(f"{w}." for w in f"{_COMMON} govt mar rabn sep vol".split()) | {"s&p", "m&r", "c$"},
    "treebank": frozenset(
        f"{w}."
        for w in f"{_COMMON} adm ala ariz ark bros cie co col colo conn cos del etc feb ft ga gen gov ind jr kan ky la ltd mass md "
        "messrs mich minn miss mo ms mt neb nev okla ore pa ph.d prof prop rep reps sen sens sept sr tenn tr va wis".split()
    ),
}
_SCAN = {
    "newswire": re.compile(r"(?P<word>(?:[sm]&[pr]|c\$)|[a-z']+(?:[.-][a-z']+)*[.]?)|[+-]?[0-9]+(?:[,./-][0-9]+)*|[.]{2,}|[*]{2,}|[][()\"!?@$%&*:;=]|[,.-]", re.I),
    "treebank": re.compile(
        r"(?:http(?:s)?://)?\w+(?:[.-]\w+)*[.][a-z]{2,5}(?::[0-9]{1,5})?(?:/\S*)?|\w[\w.-]*@\w[\w-]*(?:[.]\w[\w-]*)?[.][a-z]{2,5}"
        r"|[+-]?[0-9]+(?:[,./:-][0-9]+)*(?:[nr]d|st|th)?|``|''|[\"`]|-{2,}|[][!#$%()*+,/:;<=>?{}]+|(?P<word>[a-z'$.-]+)",
        re.I,
    ),
}
_TAIL = {"newswire": re.compile(r"(.+?)(n't|'[ms]|')"), "treebank": re.compile(r"(.+?)(n't|'(?:re|ve|ll|[dms]))", re.I)}
_WHOLE = re.compile(r"[A-Z]\.|(?i:[a-z]\.(?:[a-z]\.)+|[a-z]+)")
_BRACKETS = {"(": "LRB", ")": "RRB", "[": "LSB", "]": "RSB", "{": "LCB", "}": "RCB", "<": "LAB", ">": "RAB", "&": "AMP"}


def split_styled(text: str, style: str) -> list[tuple[str, int, int]]:
    """(token, offset, length): known short forms, initials and plain words whole; else final period and
    contraction are tokens of their own.  The treebank style writes brackets as -LRB- and so on."""
    out = []
    for m in _SCAN[style].finditer(text):
        tok, at = m.group(), m.start()
        parts = [tok]
        if m.group("word") and tok.lower() not in _SHORT[style] and not _WHOLE.fullmatch(tok):
            stop = tok[-1] == "." and len(tok) > 1
            word = tok[:-1] if stop else tok
            tail = _TAIL[style].fullmatch(word)
            parts = [*(tail.groups() if tail else (word,)), *(["."] if stop else [])]
        for p in parts:
            out.append((p, at, len(p)))
            at += len(p)
    if style == "treebank":
        out = [("".join(f"-{_BRACKETS[c]}-" if c in _BRACKETS else c for c in t), a, n) for t, a, n in out]
    return out


def styled_tokens(text: Column, style: str) -> Column:
    """Array of (token, offset, length) in a style, newswire or treebank."""

    @F.pandas_udf("array<struct<tok: string, at: int, size: int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"tok": a, "at": b, "size": c} for a, b, c in split_styled(t, style)])

    return run(text)


def atoms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Atoms pred(a, b) with constants replaced by their `isa` type, and with each argument left out in turn."""
    rx = r"(\S+?)\(\s*(\S+?)\s*,\s*(\S+?)\s*\)"
    part = lambda k: F.regexp_extract_all(F.col(text_col), F.lit(rx), F.lit(k))
    rows = df.select(F.col(id_col).alias("doc_id"), F.explode(F.arrays_zip(part(1).alias("p"), part(2).alias("a"), part(3).alias("b"))).alias("x")).select("doc_id", "x.*")
    rows = rows.withColumn("p", F.regexp_replace("p", '^"(.*)"$', "$1"))
    isa = rows.where("p = 'isa'")
    types = isa.groupBy("doc_id", F.col("a").alias("k")).agg(F.max("b").alias("t"))
    typed = rows.where("p <> 'isa'")
    for c in ("a", "b"):
        t = types.select("doc_id", F.col("k").alias(c), "t")
        typed = typed.join(t, ["doc_id", c], "left").withColumn(c, F.coalesce("t", c)).drop("t")
    null = F.lit(None).cast("string")
    shapes = F.array(*[F.struct(F.col("p"), a.alias("a"), b.alias("b")) for a, b in ((F.col("a"), F.col("b")), (null, F.col("b")), (F.col("a"), null), (null, null))])
    return typed.select("doc_id", F.explode(shapes).alias("x")).select("doc_id", "x.*").unionByName(isa.select("doc_id", "p", null.alias("a"), "b"))


def tag_blocks(text: str, pattern: str = r"[A-Za-z]+|[0-9]+|[^\s]") -> tuple[list[str], list[tuple[str, int, int]]]:
    """Tokens of a text without its <tag> … </tag> marks, and the outermost blocks as (tag, first, end) in tokens."""
    tokens: list[str] = []
    blocks: list[tuple[str, int, int]] = []
    open_: list[tuple[str, int]] = []
    at = 0
    for m in re.finditer(r"<(/?)([A-Za-z][\w-]*)>", text):
        tokens += re.findall(pattern, text[at : m.start()])
        at = m.end()
        if not m[1]:
            open_.append((m[2], len(tokens)))
        elif any(t == m[2] for t, _ in open_):
            while True:
                tag, first = open_.pop()
                if tag == m[2]:
                    break
            if not open_:
                blocks.append((tag, first, len(tokens)))
    return tokens + re.findall(pattern, text[at:]), blocks


def convert(tokens: Column, rules: list[tuple[str, str]]) -> Column:
    """Each token with the replacements of regular expressions applied in turn."""

    def one(t: Column) -> Column:
        for pattern, by in rules:
            t = F.regexp_replace(t, pattern, by)
        return t

    return F.transform(tokens, one)


def token_at(offsets: Column, tokens: Column, char: int) -> Column:
    """Number of the first token that ends after a character offset; null beyond the last."""
    ends = F.transform(F.arrays_zip(offsets.alias("o"), tokens.alias("t")), lambda x: x["o"] + F.length(x["t"]))
    place = F.array_position(F.transform(ends, lambda e: e > char), True)
    return F.when(place > 0, place.cast("int") - 1)
