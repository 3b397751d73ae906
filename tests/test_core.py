"""Warehouse, graph, retrieval and paging against hand-made results, plain Python and DuckDB."""

import datetime as dt
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import cleansing as cl
from lakeloom.functions import text as tx
from lakeloom.operators import answering as an
from lakeloom.operators import graph as gr
from lakeloom.operators import paging as pg
from lakeloom.operators import relational as rel
from lakeloom.operators import retrieval as rt
from lakeloom.operators.components import connected_components
from lakeloom.plans import catalogue, warehouse
from lakeloom.sources import edgelist, reports, synthetic
from lakeloom.sources.settings import BadSetting, Settings
from lakeloom.streaming import paging as stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


# --- functions ------------------------------------------------------------------------------------------------------


def test_decoding(spark):
    assert values(spark, lambda x: cl.decode(x, cl.PRODUCT_LINE), [" m", "R ", "s", "T", "x", "", None]) == ["Mountain", "Road", "Other Sales", "Touring", "n/a", "n/a", "n/a"]
    assert values(spark, cl.country, ["DE", " USA ", "US", "", None, " France"]) == ["Germany", "United States", "United States", "n/a", "n/a", "France"]
    assert values(spark, cl.date_of, [20131231, 20130931, 0, 2013123, None], "int") == [dt.date(2013, 12, 31), None, None, None, None]
    assert values(spark, lambda x: cl.without_prefix(x, "NAS"), [" NASAW1", "AW1", None]) == ["AW1", "AW1", None]


def test_repairs(spark):
    rows = [(None, 2, 5), (10, 2, 5), (11, 2, 5), (-1, 2, 5), (9, 3, None), (None, 3, None), (10, 2, -5), (4, 2, 0), (7, 0, None)]
    df = spark.createDataFrame(rows, "s int, q int, p int").coalesce(1)
    fixed = df.withColumn("f", cl.repaired_sales(F.col("s"), F.col("q"), F.col("p")))
    got = [tuple(r) for r in fixed.select("f", cl.repaired_price(F.col("p"), F.col("f"), F.col("q"))).collect()]
    assert got == [(10, 5), (10, 5), (10, 5), (10, 5), (9, 3), (None, None), (10, 5), (0, 0), (7, None)]


def test_text(spark):
    assert values(spark, tx.clean_text, ["&gt;&gt; Tom &amp; [Music] ♪ la​la  x", "&amp;#39;", None, "é", "[" + "a" * 41 + "]"]) == ["Tom & lala x", "&#39;", "", "é", "[" + "a" * 41 + "]"]
    assert values(spark, tx.timestamp, [0.0, 59.9, 3600.0, -4.0, 3725.5], "double") == ["00:00", "00:59", "1:00:00", "00:00", "1:02:05"]
    key = "dQw4w9WgXcQ"
    links = [key, f"https://www.youtube.com/watch?v={key}&t=1", f"youtu.be/{key}?x=1", f"http://m.youtube.com/shorts/{key}", f"https://youtube.com/embed/{key}", f"https://example.org/watch?v={key}", "https://youtu.be/short", "", None, f"https://youtube.com/other/{key}"]
    assert values(spark, tx.video_id, links) == [key] * 5 + [None] * 5
    asked = [" 'a' ", "\"'b'\"", "'\"c\"'", "\t\n d's \u00a0", "\"\"e\"\""]
    assert values(spark, tx.clean_question, asked) == [x.strip().strip('"').strip("'").strip() for x in asked]
    assert values(spark, tx.crc32, ["abc", ""]) == [891568578, 0]
    pair = spark.createDataFrame([("zh-Hans", "zh-Hant"), ("en", "EN-us"), ("en", "de")], "a string, b string").coalesce(1)
    assert [r[0] for r in pair.select(tx.same_language(F.col("a"), F.col("b"))).collect()] == [True, True, False]


# --- relational -----------------------------------------------------------------------------------------------------


def test_asof(spark):
    marks = spark.createDataFrame([(1, 0, 0.0), (1, 11, 5.0), (1, 23, 9.5)], "k int, pos long, start double")
    asked = spark.createDataFrame([(1, x, "r") for x in (0, 10, 11, 22, 40)] + [(2, 3, "none")], "k int, pos long, tag string")
    got = {(r.k, r.pos): r.start for r in rel.asof(asked, marks, ["k"], "pos", "start").collect()}
    assert got == {(1, 0): 0.0, (1, 10): 0.0, (1, 11): 5.0, (1, 22): 5.0, (1, 40): 9.5, (2, 3): None}
    late = spark.createDataFrame([(1, 5, 7.0)], "k int, pos long, start double")
    assert [r.start for r in rel.asof(asked.filter("pos = 0"), late, ["k"], "pos", "start").collect()] == [7.0]


def test_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = rel.numbered(df, ["x"], "n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert rel.numbered(df.limit(0), ["x"], "n").count() == 0


def test_key_sets(spark):
    rows = lambda *x: spark.createDataFrame([(k,) for k in x], "k int")
    assert sorted(r.k for r in rel.difference(rows(1, 1, 2, 3), rows(3, 4, None), ["k"]).collect()) == [1, 2]
    assert rel.is_subset(rows(1, 1, None), rows(None, 2, 1), ["k"]) and not rel.is_subset(rows(None), rows(1), ["k"])


# --- graph ----------------------------------------------------------------------------------------------------------


def plain_bfs(near, s, depth=None):
    order, dist = [s], {s: 0}
    for x in order:
        for y in sorted(near.get(x, ())) if depth is None or dist[x] < depth else ():
            if y not in dist:
                dist[y] = dist[x] + 1
                order.append(y)
    return order, dist


def random_graph(seed, n=40, m=90):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("directed,one_task", [(True, 0), (False, 10**6), (True, 10**6)])
def test_graph_against_plain_python(spark, directed, one_task):
    pairs = random_graph(3)
    graph = gr.build(spark.createDataFrame(pairs, "src long, dst long"), directed)
    near, nodes = {}, {x for p in pairs for x in p}
    for u, v in pairs:
        if u != v:
            near.setdefault(u, set()).add(v)
            if not directed:
                near.setdefault(v, set()).add(u)
    source = pairs[0][0]
    order, dist = plain_bfs(near, source)
    got = gr.bfs(graph, source, one_task=one_task).orderBy("ord").collect()
    assert [r.id for r in got] == order and {r.id: r.distance for r in got} == dist
    assert {r.id for r in gr.bfs_distance(graph, source, max_depth=1, one_task=one_task).collect()} == set(plain_bfs(near, source, 1)[0])
    target = order[-1]
    path = gr.shortest_path(graph, source, target, one_task=one_task)
    assert path[0] == source and path[-1] == target and len(path) == dist[target] + 1
    assert all(b in near[a] for a, b in zip(path, path[1:], strict=False))
    stack, seen, pre = [source], set(), []
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            pre.append(x)
            stack += sorted(near.get(x, set()) - seen, reverse=True)
    assert [r.id for r in gr.dfs(graph, source, one_task=one_task).orderBy("ord").collect()] == pre
    reach = {x: set(plain_bfs(near, x)[0]) for x in nodes}
    strong = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}
    assert {r.id: r.component for r in gr.strong_components(graph, one_task=min(one_task, 0) or one_task).collect()} == strong
    both = {}
    for u, vs in near.items():
        for v in vs:
            both.setdefault(u, set()).add(v)
            both.setdefault(v, set()).add(u)
    assert {r.id: r.component for r in gr.weak_components(graph, one_task=one_task).collect()} == {x: min(plain_bfs(both, x)[0]) for x in nodes}
    ranks = gr.pagerank(graph, tol=1e-6, one_task=one_task)
    score = {r.id: r.score for r in ranks.scores.collect()}
    assert ranks.converged and abs(sum(score.values()) - 1) < 1e-6
    lone = sum(score[x] for x in nodes if x not in near)
    for x in nodes:
        want = 0.15 / len(nodes) + 0.85 * lone / len(nodes) + 0.85 * sum(score[u] / len(near[u]) for u in near if x in near[u])
        assert abs(score[x] - want) < 1e-5


def test_graph_build_and_lookups(spark, tmp_path):
    raw = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (2, 4)], "src long, dst long")
    graph = gr.build(raw, nodes=spark.createDataFrame([(9,)], "id long"))
    assert {r.id for r in graph.vertices.collect()} == {1, 2, 3, 4, 9}
    assert gr.summary(raw, graph).first().asDict() == {"num_nodes": 5, "num_edges": 2, "self_loops": 1, "duplicates_dropped": 2}
    assert graph.has_edge(2, 1) and not graph.has_edge(1, 4) and graph.has_node(9) and not graph.has_node(7)
    assert [r.id for r in graph.neighbours_of(2).collect()] == [1, 4]
    with pytest.raises(KeyError):
        graph.neighbours_of(77)
    with pytest.raises(ValueError):
        graph.neighbours("sideways")
    assert [tuple(r) for r in graph.indexed().orderBy("index").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 9)]
    assert graph.external_id(4) == 9 and graph.degree_at(1) == (2, 2) and graph.degree_at(4) == (0, 0)
    for index in (-1, 5):
        with pytest.raises(IndexError):
            graph.degree_at(index)
    for damping in (0, 1, -0.1):
        with pytest.raises(ValueError):
            gr.pagerank(graph, damping)
    found = gr.analyse(graph, 2)
    assert found.converged and [r.place for r in found.top.collect()] == [1, 2] and found.top.first().id == 2
    assert tuple(found.weak.first())[:3] == (1, 3, 3) and tuple(found.strong.first())[:3] == (1, 3, 3)
    assert [tuple(r) for r in gr.sizes(gr.weak_components(graph), 1).collect()] == [(1, 3)]
    assert gr.shortest_path(graph, 1, 9) is None and gr.shortest_path(graph, 1, 9, one_task=0) is None and gr.shortest_path(graph, 9, 9) == [9]
    edgelist.write_store(graph, f"{tmp_path}/store")
    back, meta = edgelist.open_store(spark, f"{tmp_path}/store")
    assert meta["num_edges"] == 2 and edgelist.verify(spark, f"{tmp_path}/store")
    back.edges.limit(1).write.mode("append").parquet(f"{tmp_path}/store/edges")
    assert not edgelist.verify(spark, f"{tmp_path}/store")


def test_long_chain(spark):
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_edge_lists(spark, tmp_path):
    file = tmp_path / "g.txt"
    file.write_text("# head\n% also\n\n 1 2\n3,4 extra\n5\t6\n")
    assert sorted(map(tuple, edgelist.read_edges(spark, str(file)).collect())) == [(1, 2), (3, 4), (5, 6)]
    edgelist.write_edges(edgelist.read_edges(spark, str(file)), f"{tmp_path}/out", "two\nlines", compress=True)
    assert edgelist.load_graph(spark, f"{tmp_path}/out").edges.count() == 3
    (tmp_path / "bad.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception, match="not an edge"):
        edgelist.read_edges(spark, f"{tmp_path}/bad.txt").collect()
    with pytest.raises(edgelist.BadEdgeList, match="bad.txt:2: not an edge: 3"):
        edgelist.load_graph(spark, f"{tmp_path}/bad.txt")
    (tmp_path / "none.txt").write_text("# nothing\n")
    with pytest.raises(edgelist.BadEdgeList):
        edgelist.load_graph(spark, f"{tmp_path}/none.txt")


def test_walks_without_sql_take_every_transition(spark, tmp_path):
    """None of these events is a strong error, so a graph of those alone would be empty."""
    draw = random.Random(12)
    users = [draw.randrange(30) for _ in range(120)]
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), u, "click", 1.0) for k, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    near = {}
    for u, v in zip(users, users[1:], strict=False):
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    order, dist = plain_bfs(near, min(users))
    got = catalogue.QUERIES["bfs_order"](spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.id for r in got] == order and {r.id: r.distance for r in got} == dist
    path = [r.id for r in catalogue.QUERIES["shortest_path_nodes"](spark, str(tmp_path)).orderBy("step").collect()]
    assert path[0] == min(users) and path[-1] == max(users) and len(path) == dist[max(users)] + 1
    assert all(b in near[a] for a, b in zip(path, path[1:], strict=False))
    stack, pre = [min(users)], []
    while stack:
        x = stack.pop()
        if x not in pre:
            pre.append(x)
            stack += sorted(near[x] - set(pre), reverse=True)
    assert [r.id for r in catalogue.QUERIES["dfs_preorder"](spark, str(tmp_path)).orderBy("ord").collect()] == pre


def test_social_graph():
    edges = synthetic.social_edges(200, 5)
    assert edges == synthetic.social_edges(200, 5) == sorted(set(edges)) and all(u < v for u, v in edges)
    with pytest.raises(ValueError):
        synthetic.social_edges(3, 5)


# --- retrieval ------------------------------------------------------------------------------------------------------


def test_chunks(spark):
    draw = random.Random(1)
    text = " ".join("".join(draw.choice("abcde") for _ in range(draw.randint(1, 9))) + draw.choice(["", ".", ",", "?"]) for _ in range(900))
    found = rt.split_text(text, 200, 40)
    assert all(0 < len(c) <= 200 and text[s : s + len(c)] == c for s, c in found)
    assert [s for s, _ in found] == sorted(s for s, _ in found)
    assert set(text.split()) <= {w for _, c in found for w in c.split()}
    assert rt.split_text("", 200, 40) == [] and rt.split_text("x" * 500, 200, 40)[0] == (0, "x" * 200)
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "short")], "doc_id long, text string")
    got = rt.chunks(df, ["doc_id"], 200, 40).collect()
    assert [(r.chunk_id, r.start_index, r.text) for r in got if r.doc_id == 1] == [(i, s, c) for i, (s, c) in enumerate(found)]
    assert {r.doc_id for r in got} == {1, 4}


def test_assembly_and_time_marks(spark):
    segments = spark.createDataFrame([(1, 0, "hello [Music]", 0.0), (1, 1, "[x]", 2.0), (1, 2, "big  world", 5.0), (1, 3, "end", 9.5)], "video_id int, seg int, text string, start double")
    marks = rt.offsets(segments, ["video_id"])
    assert [r.text for r in rt.assemble(marks, ["video_id"]).collect()] == ["hello big world end"]
    assert sorted((r.pos, r.start) for r in marks.collect()) == [(0, 0.0), (6, 5.0), (16, 9.5)]
    pieces = rt.chunks(rt.assemble(marks, ["video_id"]), ["video_id"], 10, 2)
    timed = rt.time_chunks(pieces, marks, ["video_id"]).orderBy("chunk_id").collect()
    assert [r.start_seconds for r in timed] == sorted(r.start_seconds for r in timed) and timed[0].timestamp == "00:00"


def test_selection(spark):
    kind = "video_id int, pos int, language_code string, is_generated boolean, is_translatable boolean, translations array<string>"
    rows = [(1, 0, "de", False, True, ["en"]), (1, 1, "en-US", True, False, []), (1, 2, "en", False, False, []), (2, 0, "fr", True, True, ["EN"]), (2, 1, "it", False, True, ["en"]), (3, 0, "fr", True, False, ["en"])]
    got = {r.video_id: (r.pos, r.translate_to) for r in rt.select_transcript(spark.createDataFrame(rows, kind), ["es", "en"]).collect()}
    assert got == {1: (2, None), 2: (1, "en"), 3: (0, None)}


def test_search_and_prompts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red cat", "red cat", "blue dog", "green dog cat", "sun"])], "vec_id long, text string")
    vectors = rt.embed(docs)
    asked = rt.embed(spark.createDataFrame([(7, "red cat")], "query_id long, text string")).select("query_id", F.col("embedding").alias("vector"))
    near = rt.nearest(vectors, asked, 3).orderBy("rank").collect()
    assert [r.vec_id for r in near[:2]] == [0, 1] and abs(near[0].similarity - 1) < 1e-5
    picks = [r.vec_id for r in rt.diverse(vectors, asked, 2, lam=0.3).orderBy("pick").collect()]
    assert picks[0] == 0 and picks[1] != 1
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(12)] + [(1, 12, "user", "open"), (2, 0, "assistant", "early"), (2, 1, "system", "s"), (2, 2, "user", "q"), (2, 3, "user", "r"), (2, 4, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv int, turn int, role string, text string")
    said = {r.conv: r.history for r in rt.history(turns, ["conv"]).collect()}
    assert said[1] == "\n".join(f"User: t{k}\nAssistant: t{k + 1}" for k in range(4, 12, 2)) and said[2] == "User: r\nAssistant: a"
    df = spark.createDataFrame([("why?", ""), ("and?", "User: a")], "question string, history string")
    got = [r.standalone for r in rt.standalone(df, lambda p: F.lit(' "rewritten" ')).collect()]
    assert got == ["why?", "rewritten"]


def test_nearest_in_blocks(spark, monkeypatch):
    """Against all cosines, in blocks of vectors and batches of queries, with copies, zeros and ids of text."""
    import numpy as np

    monkeypatch.setattr(rt, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(rt, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(3)
    v = draw.normal(size=(150, 6))
    v[20:30], v[40] = v[20], 0.0
    vectors = spark.createDataFrame([(f"{i:03}", [float(x) for x in r]) for i, r in enumerate(v)], "vec_id string, embedding array<double>")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in rt.nearest(vectors, asked, 7).collect()}
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(norm > 0, norm, 1)
    for q in range(0, 150, 20):
        cosine = np.round(unit @ unit[q], 9)
        best = sorted(range(150), key=lambda i: (-cosine[i], i))[:7]
        assert [got[f"{q:03}", k + 1][0] for k in range(7)] == [f"{i:03}" for i in best], q
    assert rt.nearest(vectors.limit(0), asked, 3).count() == 0


def test_settings(tmp_path):
    file = tmp_path / "env"
    file.write_text("# c\nCHUNK_SIZE=900\nexport TOP_K = 7\nTARGET_LANGUAGE=\nPREFERRED_LANGUAGES='de, fr,'\nCHUNK_OVERLAP=\n")
    found = Settings.load({"TOP_K": "3", "TEMPERATURE": "0.5"}, str(file))
    assert (found.chunk_size, found.top_k, found.chunk_overlap, found.temperature) == (900, 3, 150, 0.5)
    assert found.target_language == "" and found.preferred_languages == ("de", "fr")
    assert Settings.load({}, str(tmp_path / "none")) == Settings()
    for bad in ({"TOP_K": "x"}, {"TOP_K": "0"}, {"TEMPERATURE": "warm"}, {"CHUNK_SIZE": "10"}, {"CHUNK_SIZE": "-1"}):
        with pytest.raises(BadSetting):
            Settings.load(bad, "")


class Videos:
    """Transcripts in memory; counts what is fetched."""

    def __init__(self, spark, lines):
        self.spark, self.lines, self.fetched = spark, lines, 0

    def candidates(self, video_id):
        rows = [(video_id, 0, "de", False, True, ["en"]), (video_id, 1, "en", True, False, [])]
        return self.spark.createDataFrame(rows, "video_id string, pos int, language_code string, is_generated boolean, is_translatable boolean, translations array<string>")

    def segments(self, chosen):
        self.fetched += 1
        return self.spark.createDataFrame([(chosen.video_id, i, t, 30.0 * i) for i, t in enumerate(self.lines)], "video_id string, seg int, text string, start double")


def test_ingest_and_chat(spark, tmp_path):
    key = "dQw4w9WgXcQ"
    settings = Settings(chunk_size=40, chunk_overlap=5, cache_dir=str(tmp_path / "cache"))
    source = Videos(spark, ["the red cat sleeps on the mat", "a blue dog runs in the park", "rain falls on the green hills"])
    index = an.ingest(spark, f"https://youtu.be/{key}", settings, source)
    assert index.meta.language_code == "en" and index.meta.num_chunks == index.vectors.count() >= 3 and not index.from_cache
    again = an.ingest(spark, key, settings, source)
    assert again.from_cache and again.meta == index.meta and source.fetched == 1
    assert sorted(r.text for r in again.vectors.collect()) == sorted(r.text for r in index.vectors.collect())
    assert not an.ingest(spark, key, Settings(chunk_size=41, chunk_overlap=5, cache_dir=settings.cache_dir), source).from_cache
    (tmp_path / "cache").joinpath(an.index_path(key, settings).rsplit("/", 1)[1], "meta").rename(tmp_path / "gone")
    assert not an.ingest(spark, key, settings, source).from_cache and source.fetched == 3
    with pytest.raises(ValueError):
        an.ingest(spark, "no video", settings, source)
    with pytest.raises(ValueError):
        an.ingest(spark, key, settings, Videos(spark, ["[x]", " "]), use_cache=False)
    chat = an.Chat(spark, an.retriever(again, 2), lambda p: F.concat(F.lit(" said: "), F.md5(p)), lambda p: F.lit('"where is the dog"'))
    first = chat.ask(" where is the red cat? ")
    assert first.standalone == "where is the red cat?" and first.answer.startswith("said: ") and len(first.sources) == 2
    assert [s.start_seconds for s in first.sources] == sorted(s.start_seconds for s in first.sources) and any("cat" in s.text for s in first.sources)
    second = chat.ask("and the dog?")
    assert second.standalone == "where is the dog" and second.answer != first.answer and len(chat.said) == 2
    with pytest.raises(ValueError):
        chat.ask("  ")
    chat.reset()
    assert chat.said == [] and chat.ask("and the dog?").standalone == "and the dog?"


# --- paging ---------------------------------------------------------------------------------------------------------


def test_machine_rules():
    m, at = pg.Machine(), iter(range(10_000))
    go = lambda proc, page, access="READ": m.step(next(at), proc, 0, page * 4096 + 5, access)
    assert go(0, 64)[4] == "SEGFAULT" and m.clock == 0
    assert go(0, 1, "WRITE")[4] == "FAULT" and m.frames[0][3] is False
    assert go(0, 1, "WRITE")[4] == "VIOLATION" and m.clock == 1
    assert go(0, 1)[4:6] == ("HIT", 5)
    for page in range(10, 25):
        go(0, page)
    full = go(1, 1)
    assert full[4] == "FAULT" and full[6:9] == (0, 0, 1)


def test_simulation_stream_and_stack_distance(spark, tmp_path):
    trace = synthetic.access_trace(spark, 6, 200).orderBy("arrival").coalesce(1)
    trace.write.parquet(f"{tmp_path}/trace")
    trace = spark.read.parquet(f"{tmp_path}/trace")
    rows = trace.orderBy("arrival").collect()
    m = pg.Machine()
    want = [m.step(r.arrival, r.proc, r.seq, r.vaddr, r.access) for r in rows]
    got = [tuple(r) for r in pg.simulate(trace).orderBy("arrival").collect()]
    assert got == want
    total = pg.counters(pg.simulate(trace)).first()
    assert total.total_page_faults == sum(r[4] == "FAULT" for r in want) and total.frames_in_use == 16
    for i in range(3):
        trace.filter((F.col("arrival") >= i * 400) & (F.col("arrival") < (i + 1) * 400)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(trace.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.drain(stream.respond(source), f"{tmp_path}/out", f"{tmp_path}/mark")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(got)
    lines = stream.log_sink(stream.respond(stream.requests(spark, f"{tmp_path}/in", trace.schema, 2)), f"{tmp_path}/log", f"{tmp_path}/mark2")
    lines.awaitTermination()
    assert reports.read_log(spark, f"{tmp_path}/log").count() == len(want) and reports.rejected(spark, f"{tmp_path}/log").count() == 0
    shown = stream.monitor(stream.respond(stream.requests(spark, f"{tmp_path}/in", trace.schema)), f"{tmp_path}/mark3", sink="memory", name="totals")
    shown.processAllAvailable()
    shown.stop()
    assert spark.table("totals").first().total_page_faults == total.total_page_faults
    reads = pg.with_page(trace).filter("page < 64").withColumn("access", F.lit("READ"))
    faults = {r.arrival: r.fault for r in pg.stack_distance_faults(reads).collect()}
    assert faults == {r.arrival: r.status == "FAULT" for r in pg.simulate(reads).collect()}


def test_trace_log(spark, tmp_path):
    trace = synthetic.access_trace(spark, 2, 30)
    found = pg.simulate(trace)
    reports.write_log(pg.log_lines(found), f"{tmp_path}/log")
    assert reports.read_log(spark, f"{tmp_path}/log").groupBy("status").count().exceptAll(found.groupBy("status").count()).count() == 0


def test_truncation(spark):
    rows = [(0, 0, 5, "READ", 0), (1, 1, 64 * 4096, "READ", 0), (2, 1, 5, "READ", 1), (3, 0, 9, "READ", 1)]
    trace = spark.createDataFrame(rows, "arrival long, proc int, vaddr long, access string, seq long")
    assert sorted(r.arrival for r in pg.truncated(trace).collect()) == [0, 1, 3]


# --- warehouse ------------------------------------------------------------------------------------------------------


def write_files(spark, root):
    """Dirty files: a stale repeat, lost keys, blanks, ends before starts, bad dates and amounts."""
    for d in ("source_crm", "source_erp"):
        os.makedirs(f"{root}/{d}")
    cust = synthetic.dirty_customers(spark, 400).toPandas()
    cust["cst_id"] = cust["cst_id"].astype("Int64")
    cust.to_csv(f"{root}/source_crm/cust_info.csv", index=False, lineterminator="\n")
    prd = ["prd_id,prd_key,prd_nm,prd_cost,prd_line,prd_start_dt,prd_end_dt"]
    for i in range(60):
        for v in range(1 + i % 3):
            prd.append(f"{i * 3 + v},CO-RF-PK-{i:07d},Name {i} ,{'' if i % 9 == 0 else 10 + v}, {'MRSTx'[i % 5]},201{v}-01-01,2009-01-01")
    open(f"{root}/source_crm/prd_info.csv", "w").write("\n".join(prd) + "\n")
    draw, sales = random.Random(1), ["a,b,c,d,e,f,g,h,i"]
    for i in range(800):
        q, p = draw.randint(1, 5), draw.randint(1, 90)
        s = draw.choice([q * p] * 6 + ["", 0, -4, q * p + 3])
        p = draw.choice([p] * 8 + ["", -p]) if s == q * p else p
        day = draw.choice([20130105] * 20 + [0, 2013010])
        sales.append(f"SO{i},PK-{draw.randrange(60):07d},{11000 + draw.randrange(400)},{day},20130112,20130120,{s},{q},{p}")
    open(f"{root}/source_crm/sales_details.csv", "w").write("\n".join(sales) + "\n")
    az, loc = ["cid,bdate,gen"], ["cid,cntry"]
    for i in range(400):
        az.append(f"{'NAS' if i % 2 else ''}AW{11000 + i:08d},{'2999-01-01' if i % 50 == 0 else '1980-05-05'},{['F', 'Male', ' female ', '', 'M'][i % 5]}")
        loc.append(f"AW-{11000 + i:08d},{['DE', 'USA', 'US', '', 'France'][i % 5]}")
    open(f"{root}/source_erp/cust_az12.csv", "w").write("\n".join(az) + "\n")
    open(f"{root}/source_erp/loc_a101.csv", "w").write("\n".join(loc) + "\n")
    open(f"{root}/source_erp/px_cat_g1v2.csv", "w").write("id,cat,subcat,maintenance\nCO_RF,Components,Frames,Yes\n")


def test_warehouse(spark, tmp_path):
    write_files(spark, str(tmp_path / "raw"))
    progress = warehouse.load(spark, str(tmp_path / "raw"), prefix="t_")
    assert progress.count() == 14 and progress.filter("rows = 0").count() == 0
    t = warehouse.tables(spark, "t_")
    assert {r.check: r.violations for r in warehouse.run_checks(t).collect() if r.violations} == {}
    assert t["dim_customers"].count() == 400 and t["dim_products"].count() == 60 and t["fact_sales"].count() == 800
    assert t["crm_cust_info"].filter("cst_firstname = 'Old'").count() == 0
    assert {r.product_line for r in t["dim_products"].select("product_line").distinct().collect()} == {"Mountain", "Road", "Other Sales", "Touring", "n/a"}
    assert t["erp_cust_az12"].filter("bdate is null").count() == 8
    assert {r.cntry for r in warehouse.informational(t)["countries"].collect()} == {"Germany", "United States", "n/a", "France"}
    again = warehouse.load(spark, str(tmp_path / "raw"), prefix="t_")
    assert {(r.layer, r.dataset, r.rows) for r in again.collect()} == {(r.layer, r.dataset, r.rows) for r in progress.collect()}
    with open(tmp_path / "raw/source_erp/loc_a101.csv", "a") as f:
        f.write("x,y,z,1\n")
    os.remove(tmp_path / "raw/source_crm/prd_info.csv")
    with pytest.raises(warehouse.StepFailed, match="bronze.crm_prd_info"):
        warehouse.load(spark, str(tmp_path / "raw"), prefix="t_")


# --- reports --------------------------------------------------------------------------------------------------------


def test_reports(spark):
    assert reports.table(["a", "bb"], [(1, "x"), (22, "y")]).splitlines() == ["a   bb", "--  --", "1   x", "22  y"]
    assert reports.preview(spark.range(25), "id", 3).endswith("(+22 more)")
    assert [reports.duration(x) for x in (5, 2_500, 3e6, 2e9)] == ["5 ns", "2.50 µs", "3.00 ms", "2.00 s"]
    samples = spark.createDataFrame([("a", float(i)) for i in range(20)], "name string, ns double")
    assert tuple(reports.timings(samples, "name", "ns").first()) == ("a", 9.5, 9.5, 19.0)


# --- catalogue ------------------------------------------------------------------------------------------------------

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x.date()) if isinstance(x, dt.datetime) and x.time() == dt.time() else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, sf_dir, name):
    import duckdb

    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        return
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(catalogue.ORACLES[name])
    order = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_entry_without_the_llm_part(tmp_path):
    """Without the subpackage and the pipeline, the entry imports and has the other queries."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'revenue_by_type_year' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
