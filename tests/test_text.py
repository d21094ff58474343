import hashlib
import random

from pyspark.sql import functions as F

from kgspark.functions import ids
from kgspark.functions import text as X
from kgspark.operators import graph_build as G


def test_tokens_mix_words_and_bigrams(one):
    assert one("Hello 知识图谱 v2_x 库", X.tokens) == ["hello", "知识", "识图", "图谱", "v2_x", "库"]
    # punctuation does not end a run, a Latin word does
    assert one("中。国a人", X.tokens) == ["中国", "a", "人"]
    assert one(None, X.tokens) == []


def test_token_count(one):
    assert one("知识 graph db", X.token_count) == 4
    assert one("!!", X.token_count) == 1
    assert one("  ", X.token_count) == 0


def test_normalize_names(one):
    clean = lambda c: X.clean_name(c)
    assert one("《红楼 梦》", X.normalize_name) == "红楼梦"
    assert one('"Acme Corp"', clean) == "Acme Corp"
    assert one("ＡＢ１２（x）", X.normalize_name) == "AB12(x)"
    assert one("12", X.normalize_name) == ""
    assert one("1.2.3", X.normalize_name) == ""
    assert one("123", X.normalize_name) == "123"
    assert one("“智能”系统 v2", clean) == "智能系统v2"
    assert one("\"'\"", X.normalize_name) == ""
    assert one("'", X.normalize_name) == "'"
    assert one("<p>张 三</p>", X.normalize_name) == "张三"


def test_sanitize_unescapes_and_drops_controls(one):
    assert one("  a\x00b &lt;x&gt; &#65; ", X.sanitize) == "ab <x> A"
    assert one("plain", X.sanitize) == "plain"


def test_repair_every_damage(one):
    for damaged in ("<|##|>", "<|#||#|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<#>", "<#|>", "<|#>", "<X#|>", "||#||", "<|#:"):
        assert one(f"entity{damaged}a", X.repair_delimiters) == "entity<|#|>a", damaged
    assert one("entity<|#| a", X.repair_delimiters) == "entity<|#|> a"


def test_redaction_order(one):
    text = "mail a.b@c.org tel 13912345678 id 22020222222222222X"
    assert one(text, X.redact) == "mail [邮箱] tel [手机号] id [证件号]"
    # a run that looks like a phone number inside an id is masked first
    assert one("11010119900307123X", X.redact) == "110101[手机号]X"


def test_think_and_json(one):
    assert one("<think>x</think> a", X.drop_think) == "a"
    assert one("x</think> b", X.drop_think) == "b"
    assert one('say {"rewrite": "q"} ok', lambda c: X.embedded_json(c, "rewrite STRING")["rewrite"]) == "q"
    assert one("no json", lambda c: X.embedded_json(c, "rewrite STRING")["rewrite"]) is None


def test_routes(one):
    assert one("合同 HT-2024 在哪", X.query_route) == "exact"
    assert one("比较 甲 和 乙", X.query_route) == "subquestions"
    assert one("这个 怎么办", X.query_route) == "rewrite"
    assert one("天气", X.query_route) == "factual"
    assert one("甲和乙", X.subquestions) == ["甲", "乙"]


def test_standalone_query(one):
    assert one("它 多大", lambda c: X.standalone_query(c, F.lit("地球"))) == "地球。它 多大"
    assert one("多大", lambda c: X.standalone_query(c, F.lit("地球"))) == "多大"


def test_clip_and_summary(one):
    assert one("a  b\n c", lambda c: X.clip(c, 3)) == "a b…"
    assert one(" abcd ", lambda c: X.summary(c, 3)) == "abc..."


def test_ids(one):
    assert one("x", lambda c: ids.content_id("doc-", c)) == "doc-" + hashlib.md5(b"x").hexdigest()
    want = hashlib.sha256("kb\nperson\nann lee\n".encode()).hexdigest()[:24]
    assert one("  Ann   Lee ", lambda c: ids.scoped_entity_id(F.lit("kb"), F.lit("Person"), c)) == "ent-" + want
    assert one("d", lambda c: ids.scoped_chunk_id(c, F.lit(3))) == "d-c0003"


def test_title_case(one):
    assert one("foo-bar1baz qux", G.title_case) == "Foo-Bar1Baz Qux"


def test_lines_are_repaired_like_single_records(spark):
    rng = random.Random(4)
    marks = ["<|#|>", "<|##|>", "<||>", "<|#>", "<#|>", "<X#|>", "<|#| ", "||#||", "<<|#|>", "<|#||>", "<", "|", "#", ">", "\\", "a", "é", " "]
    texts = ["\n".join("".join(rng.choice(marks) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    each = F.array_join(F.transform(F.split("t", "\n", -1), X.repair_delimiters), "\n")
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert df.filter(X.repair_lines(F.col("t")) != each).collect() == []
