"""Loader, payload, questions, sources, embeddings, streaming, command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrygraph import cli, plugins
from quarrygraph.operators import audit, embeddings, graph_queries, loader, payload, questions, rendering
from quarrygraph.sources import graph_json, markup
from quarrygraph.streaming import incremental


def test_upsert_keeps_the_last_writer_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "id string, name string, seq int")
    new = spark.createDataFrame([("a", "z", 2)], "id string, name string, seq int")
    once = loader.upsert(old, new, "id", "seq")
    want = {("a", "z", 2), ("b", "y", 1)}
    cols = ["id", "name", "seq"]
    assert {tuple(r) for r in once.select(cols).collect()} == want
    assert {tuple(r) for r in loader.upsert(once, new, "id", "seq").select(cols).collect()} == want


def test_properties_merge(spark):
    rows = spark.createDataFrame([("a", 1, {"value": "1", "k": "old"}), ("a", 2, {"k": "new"})], "id string, seq int, properties map<string,string>")
    assert loader.merge_properties(rows, "id", "seq").first()["properties"] == {"k": "new", "value": "1"}


def test_relations_need_both_ends_and_find_their_chunk(spark):
    rows = spark.createDataFrame(
        [("r1", "e1", "DRIVES", "e2", "c1", "t", 0.5, None, 1), ("fact-r2", "e1", "DRIVES", "gone", "c1", "t", 0.9, None, 2), ("r3", "e1", "DRIVES", "e2", "elsewhere", "t", 0.7, None, 3)],
        "id string, source_entity_id string, relation_type string, target_entity_id string, scope_id string, evidence_text string, confidence double, chunk_id string, load_seq int",
    )
    entities, chunks = spark.createDataFrame([("e1",), ("e2",)], "id string"), spark.createDataFrame([("c1",)], "id string")
    out = loader.relation_tables(rows, entities, chunks)
    assert {(r["id"], r["support"]) for r in out["relation_fact"].collect()} == {("fact-r1", "c1"), ("fact-r3", None)}
    assert [r["latest_confidence"] for r in out["related_to"].collect()] == [0.7]
    assert {tuple(r) for r in out["mentions_entity"].collect()} == {("c1", "e1"), ("c1", "e2")}


def test_constraints(spark):
    t = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    assert {r["id"] for r in loader.violations(t, "id").collect()} == {"a", None}


def edges_of(spark, rows):
    return spark.createDataFrame([(f"e{i}", s, d, "R", layer) for i, (s, d, layer) in enumerate(rows)], "id string, source string, target string, label string, layer string")


def test_degree_filter_is_a_single_pass(spark):
    nodes = spark.createDataFrame([(n,) for n in ["hub", "a", "b", "c"]], "id string")
    e = edges_of(spark, [("hub", "a", "x"), ("hub", "b", "x"), ("hub", "c", "x")])
    kept, left = payload.min_degree(nodes, e, 3)
    assert [r["id"] for r in kept.collect()] == ["hub"] and left.count() == 0
    tri = edges_of(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("a", "leaf", "x"), ("firm", "a", "company_scope")])
    nodes = spark.createDataFrame([(n,) for n in ["a", "b", "c", "leaf", "firm"]], "id string")
    kept, left = payload.min_degree(nodes, tri, 2)
    assert {r["id"] for r in kept.collect()} == {"a", "b", "c", "firm"} and left.count() == 4


def test_terms_and_routes(spark):
    assert "ai demand" in questions.query_terms("What does AI demand affect?")
    asked = [
        "For NVIDIA, what does the earnings-call graph show about AI demand, Blackwell, and data center revenue growth?",
        "What are the most frequently mentioned entities across the loaded earnings-call graph?",
        "Across the loaded graph, summarize company evidence for the AI accelerator product category.",
        "Across the loaded graph, what positive demand signals are companies reporting for the AI infrastructure industry?",
        "Across the loaded graph, what risks or constraints are companies reporting for AI infrastructure growth?",
        "Which companies are currently loaded in the earnings-call graph?",
        "Tell me a story",
    ]
    want = ["company_ai_deep_dive", "frequent_entities", "product_category_evidence_map", "ai_positive_demand_by_company", "ai_risks_constraints_by_company", "loaded_company_universe", None]
    assert [questions.route(q) for q in asked] == want
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    rows = df.select(questions.route_column(F.col("q")).alias("r"), questions.query_terms_column(F.col("q")).alias("t"), "q").collect()
    assert [r["r"] for r in rows] == want
    assert all(r["t"] == questions.query_terms(r["q"]) for r in rows)
    with pytest.raises(ValueError):
        questions.route_with("Tell me a story", lambda q: "no_such_tool")


@pytest.mark.parametrize("sql", ["", "SELECT 1; SELECT 2", "SELECT 1 -- x\n LIMIT 1", "DROP TABLE t", "INSERT INTO t SELECT 1 LIMIT 1", "CREATE TABLE t AS SELECT 1 LIMIT 1", "SELECT 1", "SELECT (1 LIMIT 1", "SELECT * FROM (SELECT 1 LIMIT 5)", "SELECT java_method('java.lang.System', 'exit', 1) LIMIT 1"])
def test_guard_rejects(spark, sql):
    with pytest.raises(ValueError):
        questions.guard_sql(spark, sql)


GUARDED = {
    "a file": "SELECT * FROM text.`{path}` LIMIT 3",
    "a file in a subquery": "SELECT (SELECT max(value) FROM text.`{path}`) AS x FROM guarded_ids LIMIT 3",
    "a file in a list": "SELECT id FROM guarded_ids WHERE id IN (SELECT value FROM csv.`{path}`) LIMIT 3",
    "a file in a CTE": "WITH a AS (SELECT * FROM json.`{path}`) SELECT * FROM a LIMIT 3",
    "a file in a join": "SELECT * FROM guarded_ids JOIN parquet.`{path}` ON true LIMIT 3",
    "a file after a union": "(SELECT id FROM guarded_ids) UNION ALL (SELECT value FROM text.`{path}`) LIMIT 3",
    "exists": "SELECT id FROM guarded_ids WHERE EXISTS (SELECT 1 FROM text.`{path}`) LIMIT 3",
    "read_files": "SELECT * FROM read_files('{path}') LIMIT 3",
    "a table function": "SELECT * FROM range(5) LIMIT 3",
    "a table function by name": "SELECT * FROM explode(array(1, 2)) LIMIT 3",
    "another view": "SELECT * FROM unguarded_ids LIMIT 3",
    "a table of a catalog": "SELECT * FROM default.guarded_ids LIMIT 3",
    "java_method": "SELECT java_method('java.lang.System', 'getProperty', 'user.home') LIMIT 1",
    "reflect in a view": "SELECT upper(reflect('java.lang.System', 'getenv', 'HOME')) FROM guarded_ids LIMIT 1",
    "input_file_name": "SELECT input_file_name() FROM guarded_ids LIMIT 1",
    "rand": "SELECT rand() FROM guarded_ids LIMIT 1",
    "a lambda": "SELECT transform(array(1), x -> uuid()) FROM guarded_ids LIMIT 1",
    "current_user": "SELECT current_user() LIMIT 1",
    "current_user without brackets": "SELECT current_user LIMIT 1",
    "a sample": "SELECT * FROM guarded_ids TABLESAMPLE (10 PERCENT) LIMIT 1",
    "a script": "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM guarded_ids LIMIT 1",
    "a backquoted name": "SELECT * FROM `text`.`{path}` LIMIT 1",
    "an order": "SELECT id FROM guarded_ids ORDER BY java_method('java.lang.System', 'nanoTime') LIMIT 1",
    "a window": "SELECT sum(id) OVER (ORDER BY spark_partition_id()) FROM guarded_ids LIMIT 1",
    "a column that isn't there": "SELECT nothing FROM guarded_ids LIMIT 1",
    "an alias in the way": "SELECT * FROM (SELECT 1 AS x) unguarded_ids, unguarded_ids LIMIT 1",
}


@pytest.mark.parametrize("case", sorted(GUARDED))
def test_guard_refuses(spark, tmp_path, case):
    (tmp_path / "secret").write_text("secret\n")
    spark.range(10).createOrReplaceTempView("guarded_ids")
    spark.range(10).createOrReplaceTempView("unguarded_ids")
    with pytest.raises(ValueError):
        questions.guard_sql(spark, GUARDED[case].format(path=tmp_path / "secret"), views=["guarded_ids"])


@pytest.mark.parametrize("sql", [
    "SELECT count(*) AS n, max(id) AS m FROM guarded_ids WHERE id % 2 = 0 AND id BETWEEN 1 AND 8 LIMIT 1",
    "WITH a AS (SELECT id, id * 2 AS y FROM guarded_ids), b AS (SELECT * FROM a) SELECT b.id, upper(concat('x', y)) AS z FROM b JOIN guarded_ids g ON b.id = g.id ORDER BY z DESC LIMIT 5",
    "SELECT id, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS rn, CASE WHEN id > 3 THEN 'a' ELSE 'b' END AS c FROM guarded_ids LIMIT 5",
    "SELECT id FROM guarded_ids WHERE id IN (SELECT max(id) FROM guarded_ids GROUP BY id % 2) LIMIT 5",
    "SELECT x FROM guarded_ids LATERAL VIEW explode(array(id, id + 1)) t AS x LIMIT 5",
    "SELECT transform(array(id, 2), v -> v + 1) AS a, cast(id AS string) AS s, extract(year FROM date'2020-01-01') AS y FROM guarded_ids LIMIT 5",
    "(SELECT id FROM guarded_ids) UNION ALL (SELECT id + 1 FROM guarded_ids) LIMIT 5",
    "VALUES (1, 'a'), (2, 'b') LIMIT 1",
    "SELECT id % 2 AS k, array_join(sort_array(collect_set(cast(id AS string))), ',') AS ids FROM guarded_ids GROUP BY 1 HAVING count(*) > 1 LIMIT 5",
])
def test_guard_lets_queries_of_the_views_pass(spark, sql):
    spark.range(10).createOrReplaceTempView("guarded_ids")
    assert len(questions.run_guarded(spark, sql, views=["guarded_ids"])) > 0


def test_guard_caps(spark):
    spark.range(1000).createOrReplaceTempView("guarded_ids")
    safe, warnings = questions.guard_sql(spark, "```sql\nSELECT id FROM guarded_ids ORDER BY id LIMIT 900;\n```", views=["guarded_ids"])
    assert "LIMIT 50" in safe and warnings
    assert len(questions.run_guarded(spark, "SELECT id FROM guarded_ids LIMIT 900", views=["guarded_ids"])) == 50
    assert len(questions.run_guarded(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a LIMIT 3")) == 1


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"documents": [{"filename": "dir/x.md", "company": "Ácme Co", "quarter": "Q1", "source_url": "https://www.adobe.com/a.pdf", "note": "n"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"x.md": {"company": "Acme", "quarter": "Q2"}, "y.md": {"company": "Why", "quarter": "Q1"}}))
    a, b = (markup.read_manifest(spark, str(tmp_path / n)) for n in ("a.json", "b.json"))
    r = a.first()
    assert (r["filename"], r["company_id"], r["adapter"], r["source_type"], r["extra"]) == ("x.md", "ácme-co", "adobe-ir-pdf", "transcript_pdf", {"note": "n"})
    assert {(x["filename"], x["quarter"]) for x in markup.overlay(a, b).collect()} == {("x.md", "Q2"), ("y.md", "Q1")}
    (tmp_path / "c.json").write_text(json.dumps({"documents": [{"filename": "x.md", "company": "A"}]}))
    with pytest.raises(Exception, match="quarter"):
        markup.read_manifest(spark, str(tmp_path / "c.json")).collect()


def test_html(spark):
    pages = spark.createDataFrame([(1, "<p>One</p><script>x</script><p>Two &amp; three<br>go on.</p>"), (2, None)], "page_id int, html string")
    assert {r["page_id"]: r["text"] for r in markup.html_texts(pages).collect()} == {1: "One Two & three go on.", 2: ""}


@pytest.mark.parametrize("text, want", [
    ("JANE ROE:\n\nWe grew.\n\nPage 2\n\nMore.", ["JANE ROE: We grew.", "Page 2", "More."]),
    ("a \n\n\n b.\n\nC d", ["a b.", "C d"]),
    ("Ends here.\n\nand goes on\n\nStill going,\n\nto the end.", ["Ends here. and goes on Still going, to the end."]),
    ("x" * 95 + "\n\nNext one.", ["x" * 95, "Next one."]),
    ("Some words\n\nAnn Lee, CFO speaks.\n\nTHE END\n\nok", ["Some words", "Ann Lee, CFO speaks.", "THE END", "ok"]),
    ("", []),
])
def test_layout(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(markup.layout_text(F.col("t")).alias("t")).first()["t"] == "\n\n".join(want)


def test_links(spark):
    html = '<a href="/t.pdf" title="Earnings call transcript">PDF</a><a href="/slides.pdf">Slides</a>'
    found = markup.links(spark.createDataFrame([(1, "https://x.example/ir", html)], "page_id int, url string, html string"))
    got = {r["url"]: r["priority"] for r in found.collect()}
    assert got["https://x.example/t.pdf"] == 180 and got["https://x.example/slides.pdf"] == 0
    assert markup.best_links(found).filter("rank = 1").first()["url"].endswith("t.pdf")


def test_docx(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:t>World</w:t></w:p></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    r = markup.file_texts(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (r["kind"], r["text"]) == ("docx", "Hello\n\nWorld")


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "chunk_id long, embedding_text string")
    out = embeddings.embed(rows, plugins.hashed_vector(8), 8)
    assert all(abs(sum(v * v for v in r["embedding"]) - 1) < 1e-9 for r in out.collect())
    near = embeddings.nearest(out.withColumnRenamed("chunk_id", "vec_id"), out.filter("chunk_id = 1").withColumnRenamed("chunk_id", "vec_id"), 1)
    assert [(r["query_id"], r["id"]) for r in near.collect()] == [(1, 3)]
    with pytest.raises(ValueError):
        embeddings.safe_dimensions(5000)


def test_retries():
    calls = []

    def call(p):
        calls.append(p)
        if len(calls) < 3:
            raise plugins.ModelError("busy", 503)
        return "{}"

    waits = []
    assert plugins.with_retries(call, 4, 1.0, waits.append)("p") == "{}" and waits == [1.0, 2.0]
    with pytest.raises(plugins.ModelError):
        plugins.with_retries(lambda p: (_ for _ in ()).throw(plugins.ModelError("no", 400)))("p")


def graph_file(folder, name, **more):
    doc = {"id": f"doc-{name}", "title": "Q1 call transcript", "company_id": "acme", "company_name": "Acme", "ticker": "ACM", "fiscal_quarter": "FY2026 Q1", "call_id": f"call-{name}", "source_url": "https://x.example/earnings"}
    c = {"id": f"c-{name}", "document_id": doc["id"], "index": 1, "heading": "h", "text": "AI demand lifts revenue."}
    body = {
        "document": doc, "chunks": [c],
        "entities": [{"id": "e1", "name": "AI demand", "entity_type": "Theme"}, {"id": "e2", "name": "Revenue", "entity_type": "Metric", "properties": {"value": "5"}}],
        "relations": [{"id": f"rel-{name}", "source_entity_id": "e1", "relation_type": "DRIVES", "target_entity_id": "e2", "scope_id": c["id"], "evidence_text": "AI demand lifts revenue.", "confidence": 0.9}],
    }
    (folder / f"{name}.graph.json").write_text(json.dumps(body | more))


def test_load_and_ask(spark, tmp_path):
    src = tmp_path / "exports"
    src.mkdir()
    graph_file(src, "one")
    graph_file(src, "two", entities=[])
    exports = graph_json.read_graphs(spark, str(src))
    cli.load_graph(spark, exports, str(tmp_path / "graph"))
    g = cli.open_graph(spark, str(tmp_path / "graph"))
    facts = g.facts.collect()
    assert {f["id"] for f in facts} == {"fact-rel-one", "fact-rel-two"} and facts[0]["conf100"] == 90
    got = cli.ask(g, "What does AI demand affect?")
    assert got["facts"] == 2 and "AI demand -DRIVES-> Revenue (value=5)" in got["bull_case"] and got["companies"] == "Acme"
    cli.index_graph(spark, str(tmp_path / "graph"))
    assert cli.narrowed(spark, str(tmp_path / "graph"), g, ["nothing"]).facts.count() == 0
    assert cli.ask(g, "What does AI demand affect?", path=str(tmp_path / "graph")) == got
    assert g.calls.first()["fiscal_quarter"] == "FY2026 Q1"
    warned = {r["id"]: r["warnings"] for r in audit.audit_exports(exports).collect()}
    assert warned == {"doc-one": [], "doc-two": ["no entities"]}


def test_bad_export_is_an_error(spark, tmp_path):
    (tmp_path / "x.graph.json").write_text("not json")
    with pytest.raises(Exception):
        graph_json.read_graphs(spark, str(tmp_path)).collect()


def test_stream_upsert(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id string, name string, seq int"
    for rows in ([("a", "x", 1), ("b", "y", 1)], [("a", "z", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.stream_upsert(spark.readStream.schema(schema).parquet(src), out, cp, "id", "seq").awaitTermination()
    assert {tuple(r) for r in incremental.latest(spark, out).select("id", "name", "seq").collect()} == {("a", "z", 2), ("b", "y", 1)}


def test_sync(spark, tmp_path):
    src, out = tmp_path / "md", str(tmp_path / "exports")
    src.mkdir()
    text = "## Prepared Remarks\n\nJane Roe, CEO: AI demand lifts revenue despite margin pressure.\n"
    (src / "a.md").write_text(text)
    (src / "b.md").write_text(text)
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"filename": f"{n}.md", "company": f"Firm {n}", "quarter": "FY2026 Q1", "ticker": n.upper(), "source_type": "transcript_pdf"} for n in "ab"]}))
    manifest = markup.read_manifest(spark, str(tmp_path / "m.json"))
    assert cli.sync(spark, str(src), manifest, out, limit=1) == 1
    assert cli.sync(spark, str(src), manifest, out) == 1
    assert cli.sync(spark, str(src), manifest, out) == 0
    cli.load_graph(spark, cli._exports(spark, out), str(tmp_path / "graph"))
    g = cli.open_graph(spark, str(tmp_path / "graph"))
    got = {(r["source"], r["relation"], r["target"], r["company"]) for r in graph_queries.read_relations(g).collect()}
    assert {("AI demand", "AFFECTS", "revenue", "Firm a"), ("margin pressure", "PRESSURES", "revenue", "Firm b"), ("Firm a", "DISCUSSES", "AI demand", "Firm a")} <= got
    answer = rendering.tool_answer(graph_queries.category_signals(g, ["ai demand"], ["revenue"]), "ai_positive_demand_by_company")
    assert "Firm a" in answer and "Firm b" in answer and "AI demand" in answer
    assert "AI demand" in rendering.entities_answer(graph_queries.frequent_entities(g))
    (src / "c.md").write_text(text)
    with pytest.raises(Exception, match="manifest"):
        cli.sync(spark, str(src), manifest, out)


def test_markdown_clean_up(spark):
    assert rendering.without_sections("# A\nx\n## Caveats\ny\n# B\nz") == "# A\nx\n# B\nz"
    assert rendering.without_columns("| A | **Signal** |\n| --- | --- |\n| 1 | 2 |\ntext") == "| A |\n| --- |\n| 1 |\ntext"
    df = spark.createDataFrame([(" a\n b®...  ?? …",), (None,)], "t string")
    assert [r["c"] for r in df.select(questions.clean_chunk_text(F.col("t")).alias("c")).collect()] == ["a b", ""]
