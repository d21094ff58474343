import random

from pyspark.sql import functions as F

from kgspark.operators import graph_build as G
from kgspark.operators import graph_query as N


def extraction(spark, *results):
    rows = [("c1", i, r, 100 + i, "f") for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "chunk_id STRING, pass INT, result STRING, created_at LONG, file_path STRING")


def test_parse_records_repairs_and_splits(spark):
    text = (
        "entity<|#|>Ann<|#|>person<|#|>a girl<|#|>relation<|#|>Ann<|#|>Bob<|#|>knows，likes<|#|>they met\n"
        "entity<|##|>Bob<|#|>pers'on<|#|>x\nentity<|#|>&quot;Eve&quot;<|#|>org unit<|#|>E &amp; co\n"
        "relation<|#|>Ann<|#|>Ann<|#|>self<|#|>loop\nrelation<|#|>Bob<|#|>Eve<|#|>pays<|#|>2.5\n<|COMPLETE|>"
    )
    records = G.parse_records(extraction(spark, text))
    entities = [(r["name"], r["entity_type"], r["description"]) for r in G.entity_records(records).orderBy("pos").collect()]
    assert entities == [("Ann", "Person", "a girl"), ("Eve", "Org Unit", "E & co")]
    relations = [(r["src"], r["tgt"], r["keywords"], r["description"], r["weight"]) for r in G.relation_records(records).orderBy("pos").collect()]
    assert relations == [("Ann", "Bob", "knows,likes", "they met", 1.0), ("Bob", "Eve", "pays", "", 2.5)]


def test_best_pass_prefers_longer_then_earlier(spark):
    e = lambda d: f"entity<|#|>A<|#|>t<|#|>{d}"
    records = G.parse_records(extraction(spark, e("long one"), e("short"), e("long two")))
    best = G.best_pass(G.entity_records(records), ["name"]).collect()
    assert [r["description"] for r in best] == ["long one"]


def test_merge_types_and_stored_votes(spark):
    rows = [("N", "x", "d1", "c1", 5, 0), ("N", "y", "d2", "c2", 1, 0)]
    df = spark.createDataFrame(rows, "name STRING, entity_type STRING, description STRING, chunk_id STRING, created_at LONG, pos INT")
    assert G.merge_entities(df).first()["entity_type"] == "y"  # same count: seen first
    stored = spark.createDataFrame([("N", "x"), ("M", "z")], "name STRING, entity_type STRING")
    merged = G.merge_entities(df, stored).collect()
    assert [(r["name"], r["entity_type"]) for r in merged] == [("N", "x")]


def test_merge_relations_is_undirected(spark):
    rows = [("b", "a", 1.0, "k2, k1", "c1"), ("a", "b", 2.0, "k1", "c2"), ("a", "a", 9.0, "k", "c3")]
    df = spark.createDataFrame(rows, "src STRING, tgt STRING, weight DOUBLE, keywords STRING, chunk_id STRING")
    stored = spark.createDataFrame([("a", "b", 4.0, "k9")], "src STRING, tgt STRING, weight DOUBLE, keywords STRING")
    r = G.merge_relations(df, stored).collect()
    assert [(x["src"], x["tgt"], x["weight"], x["keywords"], x["n_records"]) for x in r] == [("a", "b", 7.0, "k1,k2,k9", 2)]


def test_summaries_group_and_reduce(spark):
    texts = spark.createDataFrame([("n", f"w{i:02d} " * 4, i) for i in range(9)] + [("m", "only", 0)], "name STRING, description STRING, at LONG")
    seen = F.struct(F.col("at").alias("created_at"), F.lit("c").alias("chunk_id"), F.lit(0).alias("pos"))
    out = G.summarise(texts.withColumn("seen", seen), ["name"], lambda t: f"[{len(t)}]", group_tokens=9)
    got = {r["name"]: (r["description"], r["reduced"]) for r in out.collect()}
    # nine texts of four tokens: pairs of two and a single one, then groups of reduced texts
    assert got["m"] == ("only", False)
    assert got["n"][1] and got["n"][0]


def test_bounded_paths_skip_what_does_not_fit(spark):
    rows = [("k", "a" * 10, 0), ("k", "b" * 30, 1), ("k", "c" * 5, 2), ("k", "a" * 10, 3)]
    df = spark.createDataFrame(rows, "k STRING, path STRING, position INT")
    r = G.bounded_paths(df, ["k"], limit=25).first()
    assert (r["file_path"], r["n_paths"]) == ("a" * 10 + "<SEP>" + "c" * 5, 2)


def sequential_supersede(rows):
    """The rule, one relation after the other."""
    edges = {}
    for rid, src, kind, tgt in rows:
        for (s, k, t), e in edges.items():
            if s == src and k == kind and t != tgt:
                e["by"] = rid
        edges.setdefault((src, kind, tgt), {"by": None})["id"] = rid
    return {k: (e["id"], e["by"]) for k, e in edges.items()}


def test_supersede_against_sequential_rule(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.choice("123")) for i in range(40)]
    df = spark.createDataFrame(rows, "relation_id LONG, src STRING, relation_type STRING, tgt STRING").withColumn("position", F.col("relation_id"))
    got = {(r["src"], r["relation_type"], r["tgt"]): (r["relation_id"], r["superseded_by"]) for r in G.supersede(df).collect()}
    assert got == sequential_supersede(rows)


def brute_paths(seeds, adj, hops, decay=0.72):
    best, queue = {}, [(n, 0, s, [n]) for n, s in seeds]
    while queue:
        name, hop, score, path = queue.pop(0)
        if name in best and best[name][0] <= hop:
            continue
        best[name] = (hop, round(score * decay**hop, 9), path)
        if hop < hops:
            queue += [(o, hop + 1, score, path + ["r", o]) for o in sorted(adj.get(name, [])) if o not in path]
    return best


def random_graph(seed, n=12, m=20):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample([f"n{i:02d}" for i in range(n)], 2))) for _ in range(m)}
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    return sorted(pairs), adj


def test_expand_paths_against_queue(spark):
    pairs, adj = random_graph(4)
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "src STRING, tgt STRING, label STRING")
    seeds = [("n03", 0.9), ("n07", 0.8)]
    df = spark.createDataFrame([(1, n, s, i) for i, (n, s) in enumerate(seeds)], "query_id INT, name STRING, seed_score DOUBLE, position INT")
    got = {r["name"]: (r["hop"], round(r["score"], 9), r["path"]) for r in N.expand_paths(df, edges, hops=2).collect()}
    assert got == brute_paths(seeds, adj, 2)


def brute_pagerank(adj, weights, alpha=0.85, steps=20):
    nodes = set(adj) | set(weights) | {x for v in adj.values() for x in v}
    total = sum(max(w, 0) for w in weights.values())
    seed = {n: (max(w, 0) / total if total > 0 else 1 / len(weights)) for n, w in weights.items()}
    score = {n: seed.get(n, 0.0) for n in nodes}
    for _ in range(steps):
        nxt = {n: (1 - alpha) * seed.get(n, 0.0) for n in nodes}
        for s, targets in adj.items():
            for t in targets:
                nxt[t] += alpha * score[s] / len(targets)
        lost = sum(score[n] for n in nodes if not adj.get(n))
        for n in nodes:
            nxt[n] += alpha * lost * seed.get(n, 0.0)
        score = nxt
    return score


def test_pagerank_against_brute_force_with_dangling_seed(spark):
    pairs, adj = random_graph(9)
    edges = spark.createDataFrame(pairs, "src STRING, tgt STRING")
    weights = {"n01": 2.0, "n05": 1.0, "lonely": 1.0}
    seeds = spark.createDataFrame([(1, n, w) for n, w in weights.items()] + [(2, "n05", 0.0), (2, "n06", -1.0)], "query_id INT, name STRING, weight DOUBLE")
    rows = N.pagerank(edges, seeds, steps=20).collect()
    for q, w in ((1, weights), (2, {"n05": 0.0, "n06": -1.0})):
        got = {r["name"]: r["score"] for r in rows if r["query_id"] == q}
        want = brute_pagerank(adj, w)
        for name, value in want.items():
            assert abs(got.get(name, 0.0) - value) < 1e-12, (q, name)


def test_neighbourhood_order_and_truncation(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("c", "e"), ("d", "f")], "src STRING, tgt STRING")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "name STRING")
    start = nodes.filter("name = 'a'")
    r = N.bounded_neighbourhood(nodes, edges, start, 2, 4).orderBy("position").collect()
    assert [x["name"] for x in r] == ["a", "c", "b", "d"] and r[0]["truncated"]


def test_seeds_take_longest_label_and_close_vectors(spark):
    nodes = spark.createDataFrame([("1", "图谱"), ("2", "知识图谱"), ("3", "x"), ("4", "other")], "name STRING, label STRING")
    queries = spark.createDataFrame([(1, "什么是知识图谱")], "query_id INT, text STRING")
    hits = spark.createDataFrame([(1, "4", 0.7), (1, "2", 0.9), (1, "3", 0.4)], "query_id INT, name STRING, score DOUBLE")
    got = {r["name"]: r["seed_score"] for r in N.seeds(hits, nodes, queries).collect()}
    assert got == {"2": 0.8, "4": 0.7}


def test_graph_hits_follow_two_hops(spark):
    edges = spark.createDataFrame([("a", "b", "is"), ("b", "c", "has")], "src STRING, tgt STRING, label STRING")
    labels = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("c", "Gamma")], "name STRING, label STRING")
    queries = spark.createDataFrame([(1, "Alpha?")], "query_id INT, text STRING")
    seed = spark.createDataFrame([(1, "a", 0.8, 0.0, 1)], "query_id INT, name STRING, seed_score DOUBLE, cosine DOUBLE, position INT")
    sources = spark.createDataFrame([("a", "k1"), ("c", "k1"), ("c", "k2")], "name STRING, source_id STRING")
    rows = {r["chunk_id"]: r for r in N.graph_hits(seed, edges, sources, queries, labels, 10).collect()}
    assert rows["k1"]["hop"] == 2 and rows["k1"]["path"] == "a → is → b → has → c"  # the longer path replaces the first
    assert abs(rows["k1"]["score"] - 0.8) < 1e-9 and rows["k2"]["hop"] == 2
    assert abs(rows["k2"]["ranking_score"] - 0.8 * 0.72**2 * 0.85) < 1e-9


def test_delete_and_impact(spark):
    sources = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("b", "c1"), ("d", "c3")], "name STRING, source_id STRING")
    removed = spark.createDataFrame([("c1",)], "chunk_id STRING")
    got = {r["name"]: (r["action"], r["remaining"]) for r in G.deletion_impact(sources, removed, ["name"]).collect()}
    assert got == {"a": ("rebuild", 1), "b": ("delete", 0), "d": ("keep", 1)}


def test_merging_in_two_batches_keeps_stored_sources_and_texts(spark):
    entity = "name STRING, entity_type STRING, description STRING, chunk_id STRING, file_path STRING, created_at LONG, pos INT"
    relation = "src STRING, tgt STRING, weight DOUBLE, keywords STRING, description STRING, chunk_id STRING, file_path STRING, created_at LONG, pos INT"
    e1 = [("A", "x", "a one", "c1", "f1", 1, 0), ("B", "x", "b one", "c1", "f1", 1, 1)]
    e2 = [("A", "x", "a two", "c2", "f2", 2, 0), ("A", "x", "a one", "c2", "f2", 2, 1)]
    r1 = [("A", "B", 1.0, "k", "ab one", "c1", "f1", 1, 2), ("A", "Z", 1.0, "k", "az one", "c1", "f1", 1, 3)]
    r2 = [("B", "A", 2.0, "k", "ab two", "c2", "f2", 2, 2)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    whole = G.build_graph(make(e1 + e2, entity), make(r1 + r2, relation))
    stored = G.build_graph(make(e1, entity), make(r1, relation))
    later = G.build_graph(make(e2, entity), make(r2, relation), stored=stored)
    for part, touched in (("node_sources", "name = 'A'"), ("node_texts", "name = 'A'"), ("edge_sources", "src = 'A' AND tgt = 'B'"), ("edge_texts", "src = 'A' AND tgt = 'B'")):
        want, got = getattr(whole, part).filter(touched), getattr(later, part)
        columns = sorted(want.columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect())), part
    assert [(r["src"], r["tgt"], r["weight"]) for r in later.edges.collect()] == [("A", "B", 3.0)]


def test_best_pass_asks_for_every_record_once(spark):
    """Records come from costly parsing, so they are not joined with themselves; unknown keys stay out."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        asked.add(1)
        return text

    rows = [("c", 0, 0, "A", "xx"), ("c", 0, 1, "A", "longest of all"), ("c", 1, 0, "A", "xxx"), ("c", 1, 1, "A", "y"), ("c", 0, 2, "B", "xy"), ("c", 1, 2, "B", "yx"), ("d", 2, 0, "B", "z"), (None, 0, 0, "B", "z"), ("d", 0, 0, None, "z")]
    records = spark.createDataFrame(rows, "chunk_id string, pass int, pos int, name string, d string")
    records = records.select("chunk_id", "pass", "pos", "name", F.explode(F.array(counted("d"))).alias("description"))
    kept = sorted((r["chunk_id"], r["name"], r["pass"], r["pos"]) for r in G.best_pass(records, ["name"]).collect())
    assert kept == [("c", "A", 1, 0), ("c", "A", 1, 1), ("c", "B", 0, 2), ("d", "B", 2, 0)]
    assert asked.value <= len(rows)


def test_texts_go_to_python_once(spark):
    records = G.parse_records(extraction(spark, "entity<|#|>A &amp; B<|#|>t<|#|>x", ""))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [(r["pass"], r["pos"], r["fields"]) for r in records.collect()] == [(0, 0, ["entity", "A & B", "t", "x"])]
