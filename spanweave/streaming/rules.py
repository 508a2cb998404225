"""Rules over streams: row-local extraction, and `when` with state by document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..plans.engine import Engine, Sentence
from ..plans.extract import extract
from ..plans.lang import RuleError, RuleSet


def stream_extract(docs: DataFrame, rules: RuleSet | str, names: list[str], id_type: str = "bigint") -> DataFrame:
    """Matches in a stream of (doc_id, text): no state, append mode, the same rows as in a batch."""
    rules = RuleSet(rules) if isinstance(rules, str) else rules
    if Engine(rules).conditions():
        raise RuleError("rules with `when` need stream_when")
    return extract(T.sentence_table(docs), rules, names, id_type)


def stream_histogram(docs: DataFrame, rules: RuleSet | str, names: list[str], time: str, window: str, late: str) -> DataFrame:
    """Matches by text and window of event time; rows later than the watermark are dropped."""
    sents = docs.withWatermark(time, late).select(time, "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "text"))
    marked = sents.select(F.struct("doc_id", time).alias("doc_id"), "sent_id", T.tokens(F.col("text")).alias("tokens"))
    flat = marked.select("doc_id.doc_id", "sent_id", "tokens", F.col(f"doc_id.{time}").alias(time))
    rules = RuleSet(rules) if isinstance(rules, str) else rules
    from ..plans.extract import test_column

    parts = None
    for n in names:
        hit = flat.select(time, F.explode("tokens").alias("tok")).where(test_column(rules, n, F.col("tok"))).withColumn("rule", F.lit(n))
        parts = hit if parts is None else parts.unionByName(hit)
    return parts.groupBy(F.window(time, window), "rule", "tok").agg(F.count("*").alias("n"))


def stream_when(turns: DataFrame, rules: RuleSet | str, name: str, doc: str = "doc_id", order: str = "seq", idle: str | None = None) -> DataFrame:
    """Matches of a rule with `when` in a stream of (doc, order, text): (doc, order, begin, end).

    The state of a document is the set of rules that matched so far.  Rows of one trigger are taken in their
    order; a row that comes in a later trigger than its successor sees what was heard until then.  With `idle`
    (a duration in milliseconds as text) the state of a document without rows for so long is dropped.
    """
    rules = RuleSet(rules) if isinstance(rules, str) else rules
    asked = Engine(rules).conditions()
    kind = turns.schema[doc].dataType.simpleString()
    order_kind = turns.schema[order].dataType.simpleString()
    view = turns.select(doc, order, T.tokens(F.col("text")).alias("tokens"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        engine = Engine(rules)
        engine.heard = set(filter(None, state.get[0].split("\n"))) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, tokens in zip(rows[order], rows["tokens"]):
            engine.start_sentence(Sentence(list(tokens)))
            out += [(key[0], at, *m.extent) for m in engine.scan(name, 0, len(engine.s.tokens))]
            engine.end_sentence(asked)
        state.update(("\n".join(sorted(engine.heard)),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=[doc, order, "begin", "end"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return view.groupBy(doc).applyInPandasWithState(step, f"{doc} {kind}, {order} {order_kind}, begin int, end int", "heard string", "append", timeout)
