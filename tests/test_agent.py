"""Questions to tools and generated SQL, loads over a graph, model ingest, fetched sources, and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrygraph import cli, plugins
from quarrygraph.operators import agent, answers, graph_queries, model_ingest, payload, rendering, text_graph
from quarrygraph.sources import fetch, graph_json, markup
from quarrygraph.streaming import incremental

from .test_operators import graph_file


def export(spark, folder, name, company, ticker, **more):
    doc = {"id": f"doc-{name}", "title": "Call", "company_id": company.lower(), "company_name": company, "ticker": ticker, "fiscal_quarter": "FY2026 Q1", "call_id": f"call-{name}", "source_url": "https://x.example/earnings"}
    chunk = {"id": f"c-{name}", "document_id": doc["id"], "index": 1, "heading": "h", "text": f"{company}: AI demand lifts cloud revenue growth despite a supply constraint."}
    body = {
        "document": doc, "chunks": [chunk],
        "entities": [{"id": "e1", "name": "AI demand", "entity_type": "Theme"}, {"id": "e2", "name": "Cloud revenue", "entity_type": "Metric", "properties": {"value": "5"}}],
        "relations": [{"id": f"rel-{name}", "source_entity_id": "e1", "relation_type": "DRIVES", "target_entity_id": "e2", "scope_id": chunk["id"], "evidence_text": chunk["text"], "confidence": 0.9, "properties": {"layer": "insight"}}],
    }
    (folder / f"{name}.graph.json").write_text(json.dumps(body | more))


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("agent")
    (folder / "x").mkdir()
    for name, company, ticker in (("a", "Acme", "ACM"), ("b", "Nvidia", "NVDA")):
        export(spark, folder / "x", name, company, ticker)
    cli.load_graph(spark, graph_json.read_graphs(spark, str(folder / "x")), str(folder / "graph"))
    return cli.open_graph(spark, str(folder / "graph"))


def test_fixed_tools(graph):
    assert set(agent.TOOLS) == {r[0] for r in agent.fixed.ROUTES}
    out = agent.run_tool(graph, "Give me a deep dive on Nvidia AI demand")
    assert out.tool == "company_ai_deep_dive" and {r["company"] for r in out.rows.collect()} == {"Nvidia"}
    out = agent.run_tool(graph, "Which companies show positive demand signals?")
    assert out.tool == "ai_positive_demand_by_company" and {r["company"] for r in out.rows.collect()} == {"Acme", "Nvidia"}
    assert agent.companies_named(graph, "is NVDA ahead of Acme?") == ["acm", "acme", "nvda", "nvidia"]
    assert "AI demand" in agent.respond(graph, "Which are the most frequently mentioned entities?")
    assert "Acme" in agent.respond(graph, "Which companies are loaded in the graph?")
    assert "AI demand -DRIVES-> Cloud revenue" in agent.respond(graph, "What lifts revenue?")
    with pytest.raises(ValueError, match="unknown tool"):
        agent.run_tool(graph, "x", "no_such_tool")
    seen = []
    out = agent.run_tool(graph, "hm", router=lambda p: seen.append(p) or " frequent_entities\n")
    assert out.tool == "frequent_entities" and all(name in seen[0] for name in agent.TOOLS) and "hm" in seen[0]
    assert all(agent.route_with(t.example) == name for name, t in agent.TOOLS.items())
    nodes, edges = payload.graph_payload(graph, ["revenue"], 10, "ACM")
    assert edges.filter("layer = 'company_scope'").count() == 2 and payload.graph_payload(graph, ["revenue"], 10)[1].count() == 2


def test_generated_sql_is_repaired(graph):
    answers_, prompts = iter(["SELECT nothing FROM nowhere LIMIT 5", "DROP TABLE facts", "```sql\nSELECT name AS company FROM companies ORDER BY name LIMIT 9\n```"]), []

    def model(prompt):
        prompts.append(prompt)
        return next(answers_)

    out = agent.run_tool(graph, "Tell me something else", model=model)
    assert [r["company"] for r in out.rows] == ["Acme", "Nvidia"] and out.attempts == 3 and out.tool is None
    assert "companies(" in prompts[0] and "nowhere" in prompts[1] and "DROP TABLE" in prompts[2]
    with pytest.raises(ValueError, match="could be run"):
        agent.generated(graph, "q", lambda p: "not sql", repairs=1)


def test_few_companies_are_tried_again(graph):
    tries = iter(["SELECT 'Acme' AS company, 1 AS n LIMIT 5", "SELECT name AS company, 2 AS n FROM companies LIMIT 5"])
    out = agent.generated(graph, "q", lambda p: next(tries), across=True)
    assert {r["company"] for r in out.rows} == {"Acme", "Nvidia"}
    worse = iter(["SELECT 'Acme' AS company LIMIT 5", "SELECT broken LIMIT 5"])
    assert [r["company"] for r in agent.generated(graph, "q", lambda p: next(worse), across=True).rows] == ["Acme"]
    many = agent.generated(graph, "q", lambda p: "SELECT explode(array('A', 'A', 'A', 'B', null)) AS company LIMIT 9", across=True)
    assert [r["company"] for r in many.rows] == ["A", "A", "B", None]


def test_slow_sql_falls_back(graph, monkeypatch):
    def slow(*_):
        raise TimeoutError("the query took more than 0 s")

    monkeypatch.setattr(agent, "run_guarded", slow)
    empty = "Which risks and constraints do companies in storage see?"
    out = agent.run_tool(graph, empty, "frequent_entities", model=lambda p: "SELECT 1 LIMIT 1")
    assert out.tool == "frequent_entities" and not out.warnings  # the fixed rows are there, so no SQL was asked for
    with pytest.raises(TimeoutError):
        agent.run_tool(graph, "anything", model=lambda p: "SELECT 1 LIMIT 1")


def test_answers_by_a_model(graph):
    text = agent.respond(graph, "Which companies show positive demand signals?", model=lambda p: "# A\nGood.\n## Evidence gaps\nNone.\n", summarise=True)
    assert text == "# A\nGood."
    rows = graph_queries.relation_search(graph, ["revenue"], 10)
    assert rendering.summarise(rows, "t", "Sum up.", lambda p: "ok" if "Acme" in p and "Nvidia" in p else "no") == "ok"
    assert rendering.summarise(rows.limit(0), "t", "Sum up.", lambda p: "never") == ""


def test_parts_of_answers(graph):
    rows = graph_queries.relation_rank(graph_queries.relation_search(graph, ["revenue"], 10), ["revenue"])
    assert [r["value"] for r in answers.metric_values(rows).collect()] == ["Cloud revenue (value=5)"]
    assert {r["company"]: r["paths"] for r in answers.company_breakdown(rows).collect()} == {c: "AI demand -DRIVES-> Cloud revenue (value=5)" for c in ("Acme", "Nvidia")}
    card = answers.cards(rows, 1).first()
    assert card["signal"] == "support" and card["company"] == "Acme ACM" and "matched: revenue" in card["foot"] and "confidence: 0.9" in card["foot"]
    assert {r["document"] for r in answers.referenced_chunks(rows).collect()} == {"doc-a", "doc-b"}
    why = cli.explain_node(graph, "e2")
    assert "2 relation facts at 2 companies" in why["why_it_matters"] and "AI demand" in why["main_connections"] and "lifts" in why["evidence"]
    assert "no relations" in cli.explain_node(graph, "nobody")["why_it_matters"]


def test_drawings(spark):
    rows = spark.createDataFrame([(1, "IS_A", 2, "a", "b", "ontology_schema"), (2, "DRIVES", 3, "b", "c", "ontology")], "source_id int, relation string, target_id int, source string, target string, relation_layer string")
    nodes, edges = payload.ontology_payload(rows)
    assert {r["label"] for r in nodes.collect()} == {"a", "b", "c"} and {r["id"] for r in edges.collect()} == {"ontology-1-IS_A-2", "ontology-2-DRIVES-3"}
    n, e = payload.drawn(nodes, edges, hierarchical=True)
    assert {r["id"] for r in n.collect()} == {1, 2} and [r["label"] for r in e.collect()] == ["IS_A"]
    n, e = payload.drawn(nodes, edges, most=1, least_degree=0)
    assert e.count() == 1 and {r["id"]: r["size"] for r in n.collect()} == {1: 23, 2: 23, 3: 18}
    c = spark.createDataFrame([("c1", "Growth", "Driver", 4), (None, "x", "y", 1)], "concept_id string, name string, concept_type string, mapped_entities int")
    assert [tuple(r) for r in payload.concept_choices(c).collect()] == [("Growth (Driver) · 4 mapped", "c1")]
    k = spark.createDataFrame([(7, "Growth", None), (8, "", "T")], "node_id int, name string, entity_type string")
    assert [tuple(r) for r in payload.node_choices(k).collect()] == [("Growth (Entity)", 7)]


def test_loads_add_up_until_a_reset(spark, tmp_path):
    path = str(tmp_path / "graph")
    for name in "ab":
        (tmp_path / name).mkdir()
    export(spark, tmp_path / "a", "a", "Acme", "ACM")
    export(spark, tmp_path / "b", "b", "Beta", "BET", entities=[{"id": "e3", "name": "Margin", "entity_type": "Metric"}, {"id": "e2", "name": "Cloud sales", "entity_type": "Metric"}], relations=[{"id": "r9", "source_entity_id": "e1", "relation_type": "AFFECTS", "target_entity_id": "e3", "scope_id": "c-b"}, {"id": "r8", "source_entity_id": "e1", "relation_type": "AFFECTS", "target_entity_id": "gone", "scope_id": "c-b"}])
    cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "a")), path)
    first = {t: cli.open_graph(spark, path).__dict__[t].count() for t in cli.TABLES}
    cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "a")), path)
    assert {t: cli.open_graph(spark, path).__dict__[t].count() for t in cli.TABLES} == first  # a rerun changes nothing
    cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "b")), path)
    g = cli.open_graph(spark, path)
    assert {r["id"]: r["layer"] for r in g.facts.collect()} == {"fact-rel-a": "insight", "fact-r9": None}  # e1 was loaded before; "gone" never was
    assert {r["id"]: (r["name"], r["value"]) for r in g.entities.collect()} == {"e1": ("AI demand", None), "e2": ("Cloud sales", "5"), "e3": ("Margin", None)}
    assert {r["name"] for r in g.companies.collect()} == {"Acme", "Beta"} and cli.open_table(spark, path, "extraction_runs").count() == 2
    before = sorted(map(tuple, g.maps_to.collect()))
    assert cli.refresh_concepts(spark, path) == len(before) > 0 and sorted(map(tuple, cli.open_graph(spark, path).maps_to.collect())) == before
    cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "b")), path, reset=True)
    assert {r["id"] for r in cli.open_graph(spark, path).documents.collect()} == {"doc-b"}
    export(spark, tmp_path / "b", "bad", "Beta", "BET", document={"id": None, "title": "t", "company_id": "beta"})
    with pytest.raises(ValueError, match="documents"):
        cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "b")), path)
    assert {r["id"] for r in cli.open_graph(spark, path).documents.collect()} == {"doc-b"}
    cli.reset_graph(spark, path)
    with pytest.raises(ValueError, match="no graph"):
        cli.open_graph(spark, path)


def test_vectors_of_chunks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("one", "two"):
        graph_file(tmp_path / "x", name)
    path = str(tmp_path / "graph")
    cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "x")), path)
    assert cli.embed_chunks(spark, path, plugins.hashed_vector(8), "m", 8, limit=1) == {"chunks": 2, "embedded_chunks": 1}
    calls = []

    def counted(texts):
        calls.append(len(texts))
        return plugins.hashed_vector(8)(texts)

    assert cli.embed_chunks(spark, path, plugins.hashed_vector(8), "m", 8) == {"chunks": 2, "embedded_chunks": 2}
    rows = cli.open_table(spark, path, "embeddings").collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in rows) and len({r["chunk_id"] for r in rows}) == 2
    note = json.loads((tmp_path / "graph" / "indexes" / "chunk-vectors" / "index.json").read_text())
    assert (note["name"], note["dimensions"], note["similarity"], note["rows"], len(note["parts"])) == ("chunk-vectors", 8, "cosine", 2, 2)
    found = cli.nearest_chunks(spark, path, cli.open_table(spark, path, "embeddings"), 5).collect()
    assert {(r["query_id"], r["id"]) for r in found} == {("c-one", "c-two"), ("c-two", "c-one")}
    assert cli.embed_chunks(spark, path, plugins.hashed_vector(4), "m2", 4, force=True) == {"chunks": 2, "embedded_chunks": 2}
    assert json.loads((tmp_path / "graph" / "indexes" / "chunk-vectors" / "index.json").read_text())["dimensions"] == 4


def answered(prompt):
    if "document_summary" in prompt:
        return json.dumps({"document_summary": "A call.", "themes": ["New theme"], "entities": [{"name": "AI demand", "entity_type": "Theme", "aliases": ["demand for AI"]}]})
    if "New theme" not in prompt and "Document:" not in prompt:
        return "not json"
    ids = [line.split()[1] for line in prompt.splitlines() if line.startswith("Chunk ")]
    relations = [{"source_entity": "Demand for AI", "relation_type": "DRIVES", "target_entity": " revenue ", "scope_id": i} for i in ids] or [{"source_entity": "AI demand", "target_entity": "Revenue", "scope_id": "s"}]
    relations += [{"source_entity": "nobody", "relation_type": "DRIVES", "target_entity": "revenue"}, {"source_entity": "AI demand", "relation_type": "X", "target_entity": "Revenue", "scope_id": "elsewhere", "confidence": 0.5}]
    return json.dumps({"entities": [{"name": "Revenue", "entity_type": "Metric"}, {"name": "AI demand", "entity_type": "Theme"}], "relations": relations})


@pytest.mark.parametrize("mode, prompts", [("document", 1), ("chunk", 3), ("batch", 2)])
def test_model_ingest(spark, mode, prompts):
    md = "## Prepared Remarks\n\n" + "\n\n".join(f"Paragraph {i} about AI." for i in range(2)) + "\n\n## Q&A\n\n**Analyst:** Why?\n"
    docs = spark.createDataFrame([("d", "Acme", "Q1", "u", md), ("e", "Empty Co", "Q1", "u", "")], "document_id string, company string, quarter string, source_url string, markdown string")
    got = cli.model_graphs(spark, docs, answered, mode, ["Seed"])
    assert {(r["document_id"], r["id"]) for r in got["entities"].collect()} >= {("d", "entity-theme-ai-demand"), ("d", "entity-metric-revenue")}
    rel = [r for r in got["relations"].collect() if r["document_id"] == "d"]
    assert {(r["source_entity_id"], r["target_entity_id"]) for r in rel} == {("entity-theme-ai-demand", "entity-metric-revenue")} and len({r["id"] for r in rel}) == len(rel)
    scopes = {r["scope_id"] for r in rel}
    if mode == "document":
        assert scopes == {"s", "elsewhere"} and {r["relation_type"] for r in rel} == {"RELATED_TO", "X"}
    else:
        assert {"d-chunk-001", "d-chunk-002", "d-chunk-003"} <= scopes and "elsewhere" not in scopes and ("d" in scopes) == (mode == "batch")
        assert {r["document_id"]: r["summary"] for r in got["summaries"].collect()}["d"] == "A call."
        n = model_ingest.chunk_prompts(got["chunks"], docs.withColumn("themes", F.array(F.lit("t"))), 1 if mode == "chunk" else 2)
        assert [len(r["chunk_ids"]) for r in n.orderBy(F.col("chunk_ids")).collect()] == ([1] * 3 if mode == "chunk" else [2, 1])
    with pytest.raises(ValueError, match="mode"):
        model_ingest.extract(docs, got["chunks"], answered, "other")


def test_a_model_without_answers(spark):
    docs = spark.createDataFrame([("d", "Acme", "Q1", "u", "Text.")], "document_id string, company string, quarter string, source_url string, markdown string")
    got = cli.model_graphs(spark, docs, lambda p: "no", "batch")
    assert [r["id"] for r in got["entities"].collect()] == ["entity-company-acme"] and got["relations"].count() == 0


def docx(text):
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_sources_are_fetched_once(spark, tmp_path):
    page = b'<a href="/slides.pdf">Slides</a><a href="/gone.docx" title="Earnings call transcript">A</a><a href="/t.docx" title="Earnings call transcript">B</a>'
    web = {"https://x.example/ir": (page, "text/html"), "https://x.example/gone.docx": (b"<p>no</p>", "text/html"), "https://x.example/t.docx": (docx("Hello call."), ""), "https://y.example/p": (b"<p>Plain page.</p>", "text/html")}
    log = tmp_path / "log"

    def get(url):
        with log.open("a") as f:
            f.write(url + "\n")
        return (*web[url], url)

    entries = [{"filename": "x.md", "company": "X", "quarter": "Q1", "source_url": "https://x.example/ir"}, {"filename": "y.md", "company": "Y", "quarter": "Q1", "source_url": "https://y.example/p"}, {"filename": "z.md", "company": "Z", "quarter": "Q1"}]
    (tmp_path / "m.json").write_text(json.dumps({"documents": entries}))
    manifest = fetch.load_manifest(spark, example=str(tmp_path / "m.json"))
    out = str(tmp_path / "out")
    got = {r["filename"]: (r["kind"], r["markdown"]) for r in fetch.materialise(spark, manifest, get, out).collect()}
    assert set(got) == {"x.md", "y.md"} and got["x.md"][0] == "docx" and "Hello call." in got["x.md"][1] and "<https://x.example/t.docx>" in got["x.md"][1] and "Plain page." in got["y.md"][1]
    seen = log.read_text()
    assert "slides" not in seen
    fetch.materialise(spark, manifest, get, out)
    assert log.read_text() == seen
    assert fetch.metadata(manifest).filter("filename = 'z.md'").first()["metadata"] == {"filename": "z.md", "company": "Z", "quarter": "Q1", "company_id": "z"} | ({"source_type": "transcript_html"} if manifest.filter("filename = 'z.md'").first()["source_type"] else {})
    with pytest.raises(FileNotFoundError):
        fetch.load_manifest(spark, custom=str(tmp_path / "none.json"))
    with pytest.raises(ValueError, match="no entries"):
        fetch.load_manifest(spark)


def test_env_files(tmp_path):
    (tmp_path / ".env").write_text("# note\nA=1\nB = 'two'\n\nC=3\nnot a pair\n")
    env = {"A": "0"}
    assert fetch.load_env(str(tmp_path / ".env"), env) == {"B": "two", "C": "3"} and env == {"A": "0", "B": "two", "C": "3"}
    assert fetch.load_env(str(tmp_path / "none"), env) == {}


def test_overviews_and_counts(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("## Prepared Remarks\n\nJane Roe, CEO: AI demand lifts revenue despite margin pressure.\n")
    out = str(tmp_path / "exports")
    assert cli.ingest_file(spark, str(tmp_path / "md" / "a.md"), out, "Firm", "FY2026 Q1", ticker="FRM") == 1
    r = cli._exports(spark, out).first()
    assert r["overview"]["themes"][0] == "AI demand" and "revenue" in r["overview"]["metrics"] and r["overview"]["chunk_count"] == 2 == len(r["chunks"])
    assert r["document"]["ticker"] == "FRM" and {c["speaker_name"] for c in r["chunks"]} == {"", "Jane Roe"}
    q = [("Analyst", "", "Ann Lee, Firm X", True), ("Bo", "CFO", "Why?", True), ("", "", "Analyst: Cy Do, Firm Y\nWhy", True), ("question", "", "What now?", True), (None, None, "It grew.", False)]
    rows = spark.createDataFrame(q, "s string, t string, x string, is_q boolean").select("is_q", text_graph.is_question(F.col("s"), F.lit(""), F.col("x")).alias("q"), text_graph.analyst(F.col("s"), F.col("t"), F.col("x")).alias("a")).collect()
    assert all(r["q"] == r["is_q"] for r in rows) and [tuple(r["a"]) for r in rows] == [("Ann Lee", "Firm X"), ("Bo", "CFO"), ("Cy Do", "Firm Y"), ("Unknown Analyst", ""), ("Unknown Analyst", "")]
    assert set(r["overview"]["entity_ids"]) == {e["id"] for e in r["entities"]} and len(r["overview"]["relation_ids"]) == len(r["relations"]) > 0
    n = text_graph.result_counts(cli._exports(spark, out)).first()
    assert (n["chunks"], n["entities"], n["relations"]) == (2, len(r["entities"]), len(r["relations"])) and n["themes"] >= 1


def test_buckets_of_a_stream(spark, tmp_path):
    path, key = str(tmp_path / "t"), [(f"k{i}", i, 1) for i in range(50)]
    run = incremental.upsert_batch(path, "k", "seq")
    run(spark.createDataFrame(key, "k string, v int, seq int"), 0)
    run(spark.createDataFrame([("k3", 99, 2), ("new", 7, 2)], "k string, v int, seq int"), 1)
    rows = {r["k"]: r["v"] for r in incremental.latest(spark, path).collect()}
    assert rows == {f"k{i}": i for i in range(50)} | {"k3": 99, "new": 7}
    assert incremental.storage.state(spark, path)["version"] == 2
    run(spark.createDataFrame([("k3", 0, 9)], "k string, v int, seq int"), 1)  # the same batch again
    assert incremental.storage.state(spark, path)["version"] == 2
    for i in range(2, 6):
        run(spark.createDataFrame([("k3", i, i + 1)], "k string, v int, seq int"), i)
    assert len(list((tmp_path / "t" / "data" / "rows").glob("v*/_bucket=*"))) <= 2 * 4 + 2  # older versions go
    assert incremental.latest(spark, path).count() == 51 and sorted(incremental.latest(spark, path).columns) == ["k", "seq", "v"]
    assert markup is not None
