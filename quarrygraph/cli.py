"""Command line: ingest-markdown, sync, load (load-extracted), reset, index, embed, ask, tool, key-nodes, explain-node, audit.

A loaded graph is a folder with tables of the names of ``Graph``'s fields, which change by one commit a load.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from importlib import import_module
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import plugins
from .functions.expressions import preview, short_hash, slug
from .operators import agent, audit, embeddings, graph_queries, loader, model_ingest, search_index, text_graph, vector_index
from .operators.answers import answer, node_explanation
from .operators.questions import query_terms
from .progress import Event, Report, step
from .sources import graph_json, markup, storage, vocabulary
from .sources.star import Graph

TABLES = ("companies", "documents", "calls", "chunks", "entities", "facts", "concepts", "maps_to", "schema_edges")
KEYED = ("companies", "documents", "calls", "chunks", "entities", "facts", "concepts")


def open_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """One of a graph's tables, also those that queries don't use: extraction_runs, embeddings."""
    return storage.opened(spark, path, name)


def open_graph(spark: SparkSession, path: str) -> Graph:
    """The graph as of its last whole load."""
    now = storage.state(spark, path)
    if not set(TABLES) <= set(now["tables"]):
        raise ValueError(f"no graph at {path}")
    return Graph(**{t: storage.opened(spark, path, t, now).drop("edge_key") for t in TABLES})


def reset_graph(spark: SparkSession, path: str) -> None:
    """Delete a graph folder's tables; other files in it stay."""
    storage.emptied(spark, path)


def _resolved(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    found = text_graph.resolve_concepts(entities.select("id", "entity_type", F.array("name", "canonical_name", "context", "value").alias("candidates")), aliases)
    return found.select("entity_id", "concept_id", F.round(F.col("confidence") * 100).cast("int").alias("conf100"))


def load_graph(spark: SparkSession, exports: DataFrame, path: str, ontology: str | None = None, reset: bool = False, report: Report | None = None) -> dict:
    """Extracted graphs into a graph folder, over what it holds, by one commit; with ``reset`` in place of what it holds.

    What is loaded again replaces its rows, and nothing else changes: an entity keeps a value or context
    that the new load doesn't have, and facts may end at entities loaded before.  Only the hash buckets of the keys at hand
    are read and written.  A vocabulary that differs from the last one is merged by concept and edge, and all
    entities are resolved anew; else only those at hand.  Keys are checked before anything counts.  Returns the tables' new state.
    ``report`` hears of the reading and of each table.
    """
    now = storage.state(spark, path)
    if reset:
        old_folders = [f"{f}/_bucket={b}" for t in now["tables"].values() for b, f in t["folders"].items()]
        now = now | {"tables": {}, "tokens": {}, "stale": now["stale"] + old_folders}
    near = lambda name, keys: storage.near(spark, path, name, keys, "id", now)
    staged = f"{path}/data/_exports-{uuid4().hex}"
    try:
        with step(spark, "read exports", report) as own:
            exports = storage.stored(exports, staged)
            own.rows = exports.count()
        rows = graph_json.graph_rows(exports)
        d = loader.document_tables(rows["documents"])
        doc = d["source_document"]
        entities = loader.entity_table(rows["entities"]).select("id", "name", "canonical_name", "entity_type", "value", "context")
        entities = storage.stored(loader.keeping(near("entities", entities), entities, "id", ("value", "context")), f"{staged}-entities")
        chunks = loader.chunk_table(rows["chunks"])
        chunks = chunks.join(doc.select(F.col("id").alias("document_id"), "call_id"), "document_id", "left").withColumn("day", F.lpad(F.col("index").cast("string"), 9, "0"))
        relations = rows["relations"].withColumns({"chunk_id": F.lit(None).cast("string"), "layer": F.col("properties")["layer"]})

        def known(name: str, new: DataFrame, ids: DataFrame) -> DataFrame:
            """Ids that stand in a table, of those asked for."""
            old = near(name, ids)
            return (new.select("id") if old is None else new.select("id").unionByName(old.select("id"))).distinct()

        ends = relations.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id"))
        supports = relations.select(F.explode(F.array("chunk_id", "scope_id")).alias("id")).filter("id is not null")
        facts = loader.relation_tables(relations, known("entities", entities, ends), known("chunks", chunks, supports))["relation_fact"]
        facts = facts.select("id", F.col("source_entity_id").alias("from_id"), F.col("target_entity_id").alias("to_id"), "relation_type", "layer", F.round(F.col("confidence") * 100).cast("long").alias("conf100"), "evidence_text", F.col("support").alias("chunk_id"))
        concepts, aliases, edges = vocabulary.tables(spark, ontology)
        digest = hashlib.sha1(repr(vocabulary.load(ontology)).encode()).hexdigest()
        renewed = now["tokens"].get("vocabulary") != digest
        resolve = entities
        if renewed and (every := storage.opened(spark, path, "entities", now)) is not None:
            resolve = every.join(entities.select("id"), "id", "left_anti").unionByName(entities)
        changes = {
            "companies": storage.Change(d["company"].select("id", "name", "ticker", "sector"), "id"),
            "documents": storage.Change(doc.select("id", "title", "source_url", "company_id"), "id"),
            "calls": storage.Change(d["earnings_call"].select("id", "company_id", "fiscal_quarter", "call_date"), "id"),
            "chunks": storage.Change(chunks, "id"),
            "entities": storage.Change(entities, "id"),
            "facts": storage.Change(facts, "id"),
            "maps_to": storage.Change(_resolved(resolve, aliases), "entity_id", resolve.select(F.col("id").alias("entity_id"))),
            "extraction_runs": storage.Change(loader.extraction_runs(exports), "id"),
        }
        if renewed:
            schema_edges = loader.schema_edges(edges, concepts).select("source_id", "relation_type", "target_id").distinct()
            changes["concepts"] = storage.Change(concepts, "id")
            changes["schema_edges"] = storage.Change(schema_edges.withColumn("edge_key", F.concat_ws("|", "source_id", "relation_type", "target_id")), "edge_key")
        return storage.commit(spark, path, changes, now, {"vocabulary": digest}, lambda t: loader.require_keys({k: t[k] for k in KEYED if k in t}), report)
    finally:
        storage.delete(spark, staged)
        storage.delete(spark, f"{staged}-entities")


def refresh_concepts(spark: SparkSession, path: str, ontology: str | None = None) -> int:
    """Resolve all of a graph's entities anew and replace what they map to; returns the number of mappings."""
    now = storage.state(spark, path)
    every = storage.opened(spark, path, "entities", now)
    rows = _resolved(every, vocabulary.tables(spark, ontology)[1])
    storage.commit(spark, path, {"maps_to": storage.Change(rows, "entity_id", every.select(F.col("id").alias("entity_id")))}, now)
    return open_table(spark, path, "maps_to").count()


def index_graph(spark: SparkSession, path: str) -> None:
    """Postings of the graph as it is now, for searches; a later load makes them stale, and searches scan until they are built anew."""
    search_index.build(open_graph(spark, path), f"{path}/indexes/trigrams", storage.state(spark, path)["version"])


def narrowed(spark: SparkSession, path: str, g: Graph, terms: list[str]) -> Graph:
    """What a search for ``terms`` may find of a graph, by its postings where they are of its version."""
    index = f"{path}/indexes/trigrams"
    return search_index.narrowed(g, index, terms) if search_index.version(spark, index) == storage.state(spark, path)["version"] else g


def ask(g: Graph, question: str, limit: int = 12, path: str | None = None) -> dict:
    """An answer from the facts that a question's words find; ``path``: the graph's folder, whose postings are used if it has them."""
    terms = query_terms(question)
    if path:
        g = narrowed(g.facts.sparkSession, path, g, terms)
    return answer(graph_queries.relation_search(g, terms, limit), terms).first().asDict()


def explain_node(g: Graph, node_id, limit: int = 12) -> dict:
    name = g.entities.filter(F.col("id") == node_id).select("name").first()
    return node_explanation(graph_queries.node_context(g, node_id, limit), name["name"] if name else str(node_id))


def ingest_file(spark: SparkSession, path: str, out: str, company: str, quarter: str, **more: str) -> int:
    """One Markdown file to an exported graph; ``more``: other keys of a manifest entry, as ticker."""
    folder, _, name = path.rpartition("/")
    entry = {"filename": name, "company": company, "quarter": quarter, **{k: v for k, v in more.items() if v}}
    manifest = markup.manifest_entries(spark.createDataFrame([(entry,)], "m map<string,string>"))
    return sync(spark, folder or ".", manifest, out, name, any_source=True)


def embed_chunks(spark: SparkSession, path: str, function, model: str, dimensions: int, force: bool = False, limit: int | None = None, report: Report | None = None) -> dict:
    """Vectors of the graph's chunks that have none of this model and size, in a table of the graph and in its index; returns the coverage.

    Only the buckets of the chunks at hand are written.  The index takes new vectors in; it is built anew where
    vectors were replaced, or are of another size.
    """
    now = storage.state(spark, path)
    g = open_graph(spark, path)
    stored = storage.opened(spark, path, "embeddings", now)
    if stored is None:
        stored = spark.createDataFrame([], "chunk_id string, embedding array<double>, embedding_model string, embedding_dimensions int, embedding_created_at string")
    todo = embeddings.pending(g.chunks.withColumn("index", F.col("day").cast("int")), stored, model, dimensions, force, limit)
    docs = g.documents.select(F.col("id").alias("document_id"), "title", "company_id").join(g.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "ticker"), "company_id", "left")
    texts = todo.select("id", "document_id", "heading", "text").join(docs, "document_id", "left")
    texts = texts.select(F.col("id").alias("chunk_id"), embeddings.embedding_text(F.col("ticker"), F.col("company"), F.substring("title", 1, 512), F.col("heading"), F.col("text")).alias("embedding_text"))
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    new = embeddings.embed(texts, function, dimensions).select("chunk_id", "embedding", F.lit(model).alias("embedding_model"), "embedding_dimensions", at.alias("embedding_created_at"))
    aside, index = f"{path}/data/_vectors-{uuid4().hex}", f"{path}/indexes/chunk-vectors"
    try:
        with step(spark, "embed chunks", report) as own:
            new = storage.stored(new, aside)
            own.rows = new.count()
        replaced = not new.join(stored.select("chunk_id"), "chunk_id", "left_semi").isEmpty()
        storage.commit(spark, path, {"embeddings": storage.Change(new, "chunk_id")}, now, report=report)
        if replaced or not storage.exists(spark, f"{index}/index.json"):
            every = open_table(spark, path, "embeddings").filter((F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions))
            vector_index.build(every, index, "chunk_id", "embedding")
        elif not new.isEmpty():
            vector_index.add(new, index, "chunk_id", "embedding")
    finally:
        storage.delete(spark, aside)
    return embeddings.coverage(g.chunks, open_table(spark, path, "embeddings")).first().asDict()


def nearest_chunks(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, cosine, rank): the chunks nearest to query vectors (chunk_id, embedding), by the graph's index."""
    return vector_index.search(spark, f"{path}/indexes/chunk-vectors", queries, k, "chunk_id", "embedding")


def model_graphs(spark: SparkSession, docs: DataFrame, model, mode: str = "batch", seed_themes: list[str] = []) -> dict[str, DataFrame]:  # noqa: B006
    """Markdown documents (document_id, company, quarter, source_url, markdown) to chunks, entities, relations and summaries by a language model."""
    chunks = text_graph.chunk_documents(docs)
    return {"chunks": chunks, **model_ingest.extract(docs, chunks, model, mode, seed_themes)}


def ingest(spark: SparkSession, docs: DataFrame, lexicon: text_graph.Lexicon | None = None, aside: str | None = None) -> dict[str, DataFrame]:
    """Markdown documents (document_id, company, markdown) to chunk, entity and relation rows; chunks are kept at ``aside``, so that documents are parsed once."""
    chunks = text_graph.chunk_documents(docs)
    if aside:
        chunks = storage.stored(chunks, aside)
    used = text_graph.for_graph(chunks).join(docs.select("document_id", "company"), "document_id")
    entities = text_graph.extract_entities(used, "id", "text", lexicon)
    return {"chunks": chunks, "entities": entities, "relations": text_graph.document_relations(used, lexicon)}


def sync(spark: SparkSession, folder: str, manifest: DataFrame, out: str, pattern: str = "*.md", limit: int | None = None, force: bool = False, any_source: bool = False, lexicon: text_graph.Lexicon | None = None, report: Report | None = None) -> int:
    """Markdown files with their manifest entries to exported graphs; returns how many were made.

    Files that have an export are left alone unless ``force``; only conference calls
    count unless ``any_source``; a file without an entry is an error.
    """
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    files = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("filename"), F.col("value").alias("markdown"))
    unknown = files.select("filename").join(manifest, "filename", "left_anti").orderBy("filename").limit(10).collect()
    if unknown:
        raise ValueError("no manifest entry for " + ", ".join(r["filename"] for r in unknown))
    rows = files.join(manifest, "filename")
    if not any_source:
        rows = rows.filter(markup.is_conference_call(F.col("source_type")))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    rows = rows.withColumn("document_id", slug(F.concat_ws("-", "company", "quarter", stem)))
    if not force:
        done = _exports(spark, out)
        if done is not None:
            rows = rows.join(done.select(F.col("document.id").alias("document_id")), "document_id", "left_anti")
    rows = rows.orderBy("filename").limit(limit) if limit else rows
    staged = storage.scratch(spark, "sync")
    with step(spark, "read documents", report) as own:
        rows = storage.stored(rows, f"{staged}/documents")
        own.rows = rows.count()
    with step(spark, "cut chunks", report) as own:
        made = ingest(spark, rows, lexicon, f"{staged}/chunks")
        own.rows = made["chunks"].count()
    chunk = F.struct("id", "document_id", "index", "chunk_type", "heading", "text", "start_line", "end_line", F.col("speaker").alias("speaker_name"), F.col("title").alias("speaker_title"), "text_hash")
    chunks = made["chunks"].groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("index", chunk.alias("c")))).alias("c")).select("document_id", F.transform("c", lambda x: x["c"]).alias("chunks"))
    scope = made["chunks"].select(F.col("id").alias("scope"), "document_id")
    ent = made["entities"].join(scope, "scope").select("document_id", "id", "name", F.col("type").alias("entity_type")).distinct()
    firm = rows.select("document_id", text_graph.entity_id(F.lit("Company"), F.col("company")).alias("id"), F.col("company").alias("name"), F.lit("Company").alias("entity_type"))
    every = ent.unionByName(firm).distinct()
    entities = every.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "entity_type", F.lit("text").alias("source")))).alias("entities"))
    rel = made["relations"]
    order = Window.partitionBy("document_id").orderBy("scope", "pos", "source_entity_id", "target_entity_id")
    rel = text_graph.relation_ids(rel.withColumn("seq", F.row_number().over(order)))
    rel = rel.withColumn("id", F.concat_ws("-", "id", short_hash(F.col("document_id"), 8)))
    one = F.struct("id", "source_entity_id", F.col("relation").alias("relation_type"), "target_entity_id", F.col("scope").alias("scope_id"), preview(F.col("text"), 260).alias("evidence_text"), F.lit(0.7).alias("confidence"))
    relations = rel.groupBy("document_id").agg(F.array_sort(F.collect_list(one)).alias("relations"))
    doc = F.struct(F.col("document_id").alias("id"), F.col("filename").alias("title"), "company_id", F.col("company").alias("company_name"), "ticker", "sector", F.col("quarter").alias("fiscal_quarter"), F.when(F.col("call_id") == "", slug(F.concat_ws("-", "company", "quarter"))).otherwise(F.col("call_id")).alias("call_id"), "call_date", "source_url", F.col("source_type").alias("source_kind"), F.col("filename").alias("markdown_path"))
    at = made["chunks"].select(F.col("id").alias("scope"), F.col("index").alias("seq"))
    named = made["entities"].join(scope.join(at, "scope"), "scope").select("document_id", "id", "name", F.col("type").alias("entity_type"), "seq").unionByName(firm.withColumn("seq", F.lit(0)))
    overview = text_graph.overviews(rows.select("document_id", "company", "quarter"), made["chunks"], named, rel.select("document_id", "id"))
    graphs = rows.select("document_id", doc.alias("document")).join(overview, "document_id", "left").join(chunks, "document_id", "left").join(entities, "document_id", "left").join(relations, "document_id", "left").drop("document_id")
    before = 0 if (done := _exports(spark, out)) is None else done.count()
    with step(spark, "write exports", report) as own:
        graphs.write.mode("overwrite" if force else "append").json(out)
        own.rows = rows.count()
    storage.delete(spark, staged)
    return _exports(spark, out).count() - (0 if force else before)


def _exports(spark: SparkSession, path: str) -> DataFrame | None:
    """Exports that sync has made, one a line."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    return spark.read.schema(graph_json.GRAPH_SCHEMA).json(path).withColumn("load_seq", F.input_file_name())


def _told(e: Event) -> None:
    print(json.dumps({"step": e.step, "state": e.state, "tasks": f"{e.done}/{e.total}", "rows": e.rows, "seconds": round(e.seconds, 1)}), file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrygraph")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("load", "load-extracted"):
        c = commands.add_parser(name)
        c.add_argument("exports")
        c.add_argument("--pattern", default="*graph.json")
        c.add_argument("--ontology")
        c.add_argument("--reset", action="store_true")
    commands.add_parser("reset")
    commands.add_parser("index")
    c = commands.add_parser("ingest-markdown")
    c.add_argument("file")
    c.add_argument("--company", required=True)
    c.add_argument("--quarter", required=True)
    c.add_argument("--ticker", default="")
    c.add_argument("--source-url", default="")
    c.add_argument("--out", default="exports")
    c = commands.add_parser("embed")
    c.add_argument("--function", default="", help="module:name of a function from texts to vectors; a stand-in without")
    c.add_argument("--model", default="stand-in")
    c.add_argument("--dimensions", type=int, default=768)
    c.add_argument("--limit", type=int)
    c.add_argument("--force", action="store_true")
    c = commands.add_parser("tool")
    c.add_argument("question")
    c.add_argument("--tool", choices=sorted(agent.TOOLS))
    c.add_argument("--limit", type=int, default=50)
    c = commands.add_parser("sync")
    c.add_argument("folder")
    c.add_argument("manifest")
    c.add_argument("--out", default="exports")
    c.add_argument("--pattern", default="*.md")
    c.add_argument("--limit", type=int)
    c.add_argument("--force", action="store_true")
    c.add_argument("--any-source", action="store_true")
    c.add_argument("--json-only", action="store_true")
    c = commands.add_parser("ask")
    c.add_argument("question")
    c.add_argument("--limit", type=int, default=12)
    c = commands.add_parser("key-nodes")
    c.add_argument("--limit", type=int, default=25)
    c = commands.add_parser("explain-node")
    c.add_argument("node_id")
    c.add_argument("--limit", type=int, default=12)
    c = commands.add_parser("audit")
    c.add_argument("exports")
    c.add_argument("--strict", action="store_true")
    parser.add_argument("--graph", default="graph")
    parser.add_argument("--progress", action="store_true", help="tell of each step on standard error")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarrygraph").getOrCreate()
    report = _told if args.progress else None
    if args.command in ("load", "load-extracted"):
        load_graph(spark, graph_json.read_graphs(spark, args.exports, args.pattern), args.graph, args.ontology, args.reset, report)
    elif args.command == "index":
        index_graph(spark, args.graph)
    elif args.command == "reset":
        reset_graph(spark, args.graph)
    elif args.command == "ingest-markdown":
        print(json.dumps({"exported": ingest_file(spark, args.file, args.out, args.company, args.quarter, ticker=args.ticker, source_url=args.source_url)}))
    elif args.command == "embed":
        module, _, name = args.function.partition(":")
        function = getattr(import_module(module), name) if name else plugins.hashed_vector(args.dimensions)
        print(json.dumps(embed_chunks(spark, args.graph, function, args.model, args.dimensions, args.force, args.limit, report)))
    elif args.command == "sync":
        n = sync(spark, args.folder, markup.read_manifest(spark, args.manifest), args.out, args.pattern, args.limit, args.force, args.any_source, report=report)
        print(json.dumps({"exported": n}))
        if not args.json_only:
            load_graph(spark, _exports(spark, args.out), args.graph, report=report)
    elif args.command == "audit":
        rows = audit.audit_exports(graph_json.read_graphs(spark, args.exports)).collect()
        for r in rows:
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return int(args.strict and any(r["warnings"] for r in rows))
    else:
        g = open_graph(spark, args.graph)
        if args.command == "ask":
            print(json.dumps(ask(g, args.question, args.limit, args.graph), ensure_ascii=False))
        elif args.command == "tool":
            print(agent.respond(g, args.question, args.tool, limit=args.limit))
        elif args.command == "explain-node":
            print(json.dumps(explain_node(g, args.node_id, args.limit), ensure_ascii=False))
        else:
            for r in graph_queries.key_nodes(g, args.limit).collect():
                print(json.dumps(r.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
