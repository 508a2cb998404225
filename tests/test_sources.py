import json

import pytest

from spanweave.functions import text as T
from spanweave.plans.extract import extract
from spanweave.plans.lang import LIBRARY, RuleSet
from spanweave.sources.readers import READERS, read


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("three")
    assert rows(read(spark, "lines", str(tmp_path / "a.txt"))) == [("a.txt:1", "one"), ("a.txt:2", "two")]
    assert [t for _, t in rows(read(spark, "directory", str(tmp_path), filter_regex="^a"))] == ["one\n\ntwo\n"]
    assert len(rows(read(spark, "dirtree", str(tmp_path)))) == 2
    assert rows(read(spark, "string", "hello")) == [("hello", "hello")]
    with pytest.raises(ValueError):
        read(spark, "nothing", "x")


def test_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_text('one,two\n1,"a\nb"\n2,\n3,c\n')
    assert rows(read(spark, "csv", str(tmp_path / "x.csv"), column="two")) == [("x.csv:0", "a\nb"), ("x.csv:2", "c")]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"text": t, "a": i, "b": "z"}) for i, t in enumerate("pq")))
    assert rows(read(spark, "jsonl", str(tmp_path / "x.jsonl"), id_fields=["a", "b"])) == [("0|z", "p"), ("1|z", "q")]
    assert rows(read(spark, "jsonl", str(tmp_path / "x.jsonl"))) == [("0", "p"), ("1", "q")]
    (tmp_path / "r.csv").write_text("DOC,PARA,SENT,TEXT\nd,1,1,a\nd,1,1,b\nd,1,2,c\n")
    assert rows(read(spark, "rpe", str(tmp_path / "r.csv"))) == [("d|1|1", "a b"), ("d|1|2", "c")]
    (tmp_path / "n.txt").write_text("==== SITE x\n== p\nDATE 1\nbody\nmore\n== q\nlast\n")
    assert [t for _, t in rows(read(spark, "triggers_news", str(tmp_path / "n.txt")))] == ["body\nmore", "last"]
    (tmp_path / "l.tsv").write_text("a\nb\n")
    assert rows(read(spark, "indexed", str(tmp_path / "l.tsv"))) == [(0, "a"), (1, "b")]
    (tmp_path / "c.tsv").write_text("0\t1\t5\n")
    assert rows(read(spark, "coo", str(tmp_path / "c.tsv"))) == [(0, 1, 5)]
    (tmp_path / "e.txt").write_text("w 1 2.5\n")
    assert rows(read(spark, "embeddings", str(tmp_path / "e.txt"))) == [("w", [1.0, 2.5])]
    (tmp_path / "rec.jsonl").write_text('{"id": 1, "prepSteps": ["x", "y"]}\n')
    assert rows(read(spark, "recipes", str(tmp_path / "rec.jsonl"))) == [("1", 0, "x"), ("1", 1, "y")]
    assert {"d3m", "twitter_reply", "denso", "simple_file", "conllu_dirtree", "table"} <= set(READERS)


CONLLU = """# newdoc id = d
1\tRita\tRita\tPROPN\tNNP\t_\t2\tnsubj\t_\t_
2\tbought\tbuy\tVERB\tVBD\t_\t0\troot\t_\t_
3\tan\ta\tDET\tDT\t_\t4\tdet\t_\t_
4\tapple\tapple\tNOUN\tNN\t_\t2\tdobj\t_\tSpaceAfter=No
5\t.\t.\tPUNCT\t.\t_\t2\tpunct\t_\t_
"""


def test_conllu_with_rules(spark):
    sents = read(spark, "conllu_string", CONLLU, name="s")
    (r,) = sents.collect()
    assert r.doc_id == "s:d" and r.tokens == ["Rita", "bought", "an", "apple", "."] and r.offsets == [0, 5, 12, 15, 20]
    rules = RuleSet("c <- clauses.rules", strict=True)
    found = extract(sents, rules, ["c.nominal", "c.acts", "c.agent"], id_type="string").collect()
    got = {(x.rule, x.begin, x.end) for x in found}
    assert ("c.nominal", 0, 1) in got and ("c.nominal", 2, 4) in got and ("c.acts", 0, 3) in got and ("c.agent", 0, 3) in got


def test_libraries_load():
    for f in LIBRARY.glob("*.rules"):
        assert RuleSet.from_file(f, strict=True).names()


def test_imports_and_lexicons(spark, tmp_path):
    (tmp_path / "other.rules").write_text("t : {b}")
    (tmp_path / "lex.json").write_text('{"one": ["a"], "two": ["b"]}')
    (tmp_path / "words.txt").write_text("a\nb\n")
    (tmp_path / "phrases.txt").write_text("Hello!\nHi there.\n\n")
    (tmp_path / "labels.txt").write_text("a\nb\n")
    (tmp_path / "clusters.txt").write_text("7\n8\n")
    rules = RuleSet("o <- other.rules\nj <- j{lex.json}\nw <- {words.txt}\nf : f{words.txt}i\nc <- c{labels.txt;clusters.txt}\nL L-> phrases.txt\nx : &o.t or &j.one or &c.8", base=tmp_path)
    rules.errors or None
    sents = spark.createDataFrame([(1, 0, ["a", "b", "c"])], "doc_id long, sent_id int, tokens array<string>")
    n = lambda name: extract(sents, rules, [name]).count()
    rules2 = RuleSet(parent=rules, base=tmp_path)
    assert [n(x) for x in ("o.t", "j.two", "w", "f", "c.7", "x")] == [1, 1, 2, 2, 1, 2] and rules2.lookup("w")
    hello = spark.createDataFrame([(1, 0, ["Hi", "there", ".", "Hello", "!"])], "doc_id long, sent_id int, tokens array<string>")
    assert [(r.begin, r.end) for r in extract(hello, rules, ["L"]).collect()] == [(0, 3), (3, 5)]


def test_offsets_and_sentences(spark):
    df = spark.createDataFrame([(1, "Hi, Mr. X is  here. 12 ok? yes")], "doc_id long, text string")
    s = T.sentence_table(df).orderBy("sent_id").collect()
    assert [r.text for r in s] == ["Hi, Mr. X is  here. ", "ok? ", "yes"]
    at = df.select(T.offsets(T.F.col("text")).alias("o"), T.tokens(T.F.col("text")).alias("t")).first()
    assert all("Hi, Mr. X is  here. 12 ok? yes"[o : o + len(t)] == t for o, t in zip(at.o, at.t))
