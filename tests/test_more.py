import random

from pyspark.sql import functions as F

from spanweave.functions import tokenizers as K
from spanweave.operators import outputs as O
from spanweave.operators import stats as S
from spanweave.plans.algebra import dependency_paths, generate, register_sql, reverse, simplify, tally
from spanweave.plans.engine import Engine, Sentence
from spanweave.plans.lang import RuleSet, parse_regex


def test_styles():
    toks = lambda t, s: [x[0] for x in K.split_styled(t, s)]
    assert toks("Mr. Smith didn't go to U.S. shops.", "newswire") == ["Mr.", "Smith", "did", "n't", "go", "to", "U.S.", "shops", "."]
    assert toks("See http://x.org/a (it's 3rd).", "treebank") == ["See", "http://x.org/a", "-LRB-", "it", "'s", "3rd", "-RRB-", "."]
    text = "a.b@c.org isn't"
    assert all(n == len(t) and text[a : a + n] == t for t, a, n in K.split_styled(text, "treebank"))


def test_styles_as_column(spark):
    df = spark.createDataFrame([(1, "it's"), (2, None)], "doc_id long, text string")
    got = dict(df.select("doc_id", K.styled_tokens(F.col("text"), "treebank").alias("t")).collect())
    assert [x.tok for x in got[1]] == ["it", "'s"] and got[2] is None


def test_atoms(spark):
    df = spark.createDataFrame([(1, "isa(x, dog) chases(x, y)")], "doc_id long, text string")
    got = {(r.p, r.a, r.b) for r in K.atoms(df).collect()}
    assert got == {("isa", None, "dog"), ("chases", "dog", "y"), ("chases", None, "y"), ("chases", "dog", None), ("chases", None, None)}


def test_blocks_and_converters(spark):
    assert K.tag_blocks("a <b>c <i>d</i></b> e") == (["a", "c", "d", "e"], [("b", 1, 3)])
    df = spark.createDataFrame([(["x1", "y"],)], "t array<string>")
    assert df.select(K.convert(F.col("t"), [("[0-9]", "#")])).first()[0] == ["x#", "y"]
    df = spark.createDataFrame([([0, 3], ["ab", "cde"])], "o array<int>, t array<string>")
    assert [df.select(K.token_at(F.col("o"), F.col("t"), c)).first()[0] for c in (0, 2, 5, 6)] == [0, 1, 1, None]


def test_algebra(spark):
    e = parse_regex("a b | a c")
    assert simplify(e) == parse_regex("a ( b | c )")
    assert reverse(parse_regex("a ( b | c d )+")) == parse_regex("( b | d c )+ a")
    rules = RuleSet("t : {b c}\nx -> a &t+", strict=True)
    sents = spark.createDataFrame([(1, 0, ["a", "b", "b", "z"])], "doc_id long, sent_id int, tokens array<string>")
    assert [tuple(r) for r in tally(sents, rules, ["t"]).collect()] == [("t", "b", 2)]
    for seed in range(5):
        words = generate(rules, "x", {"t": {"b": 2}}, random.Random(seed))
        engine = Engine(rules)
        engine.start_sentence(Sentence(words))
        assert [m.extent for m in engine.scan("x", 0, len(words))] == [(0, len(words))]


def test_sql_function(spark):
    register_sql(spark, "t : {b}\nx -> &t+")
    spark.createDataFrame([(1, ["a", "b", "b"])], "id long, tokens array<string>").createOrReplaceTempView("ss")
    got = spark.sql("SELECT id, r.begin, r.end, r.match FROM ss, LATERAL rule_spans(tokens, 'x') r").collect()
    assert [tuple(r) for r in got] == [(1, 1, 3, "b b")]


def test_paths_and_layers(spark):
    schema = "doc_id long, sent_id int, tokens array<string>, ann map<string,array<array<string>>>, deps array<struct<child int,parent int,label string>>"
    sents = spark.createDataFrame([(1, 0, ["Rita", "bought", "apples"], {"pos": [["NNP"], ["VBD"], ["NNS"]]}, [(0, 1, "nsubj"), (2, 1, "dobj"), (1, -1, "root")])], schema)
    spans = spark.createDataFrame([(1, 0, 0, 3)], "doc_id long, sent_id int, begin int, end int")
    assert [r.path for r in dependency_paths(sents, spans).collect()] == ["/nsubj \\dobj"]
    assert [r.value for r in O.layer_dump(sents, "pos").orderBy("pos").collect()] == ["NNP", "VBD", "NNS"]
    assert {r.label: r.n for r in O.edge_labels(sents).collect()} == {"nsubj": 1, "dobj": 1, "root": 1}


def test_outputs(spark, tmp_path):
    assert RuleSet(O.membership_rule("w", ["b", "c"]), strict=True).lookup("w")
    m = spark.createDataFrame([("r", "b\nc"), ("r", "A")], "rule string, match string")
    O.write_by_rule(m, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "rule=r")).collect()) == ["A", "b\\nc"]
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    n = {r.part: r["count"] for r in O.split_quota(docs).groupBy("part").count().collect()}
    assert abs(n["train"] - 1600) < 120 and sum(n.values()) == 2000
    s = spark.createDataFrame([(1, i, ["a"]) for i in range(20)], "doc_id long, sent_id int, tokens array<string>")
    hit = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 1)], "doc_id long, sent_id int, begin int, end int")
    got = O.training_tokens(s, hit, 3.0).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got}[1] == 2


def test_marks_and_radius(spark):
    docs = spark.createDataFrame([(1, "The term here"), (2, None)], "doc_id long, text string")
    assoc = spark.createDataFrame([("term", 1, 2.0), ("here", 1, 0.1)], "x string, y long, pmi double")
    assert dict(S.mark_terms(docs, assoc, 1.0).collect()) == {1: "The <b>term</b>(2.00) here", 2: None}
    d = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.9)], "x1 string, x2 string, d double")
    rules = RuleSet("x : {a}0.5", strict=True)
    rules.radius.update(S.radius_sets(d, ["a"], 0.5))
    e = Engine(rules)
    e.start_sentence(Sentence(["a", "b", "c"]))
    assert [m.begin for m in e.scan("x", 0, 3)] == [0, 1]


def test_more_outputs(spark):
    f = spark.createDataFrame([(1, 0, '{"a": ["x", "y"], "b": "z"}')], "doc_id long, sent_id int, fields string")
    assert tuple(O.frame_tuple(f, ["a", "b", "c"]).first()) == (1, 0, "x/y", "z", "")
    s = spark.createDataFrame([(1, 0, ["Ran", "off"], {"lemma": [["Run"], ["off"]]})], "doc_id long, sent_id int, tokens array<string>, ann map<string,array<array<string>>>")
    m = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 2)], "doc_id long, sent_id int, begin int, end int")
    assert O.lemmas(s, m).where("begin = 0").first().lemmas == "run off"
    assert tuple(O.search(m).first()) == (1, 0, 0, 2)
    from spanweave.operators import spans as A

    assert [tuple(r) for r in A.merge(m.union(spark.createDataFrame([(1, 0, 5, 6)], m.schema))).orderBy("begin").collect()] == [(1, 0, 0, 2), (1, 0, 5, 6)]
    p = spark.createDataFrame([(1, 0, 0, 3)], m.schema)
    left, right = spark.createDataFrame([(1, 0, 0, 1)], m.schema), spark.createDataFrame([(1, 0, 2, 4)], m.schema)
    assert A.connects(p, left, right).count() == 1 and A.connects(p, right, left).count() == 0
    assert A.leftmost(spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 3), (1, 0, 2, 4)], m.schema)).count() == 1
