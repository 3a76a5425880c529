"""Text, source, loader and embedding queries by name, with their SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions import fixed_values as fixed
from ..operators import audit as audits
from ..operators import embeddings as emb
from ..operators import loader, questions, vector_index
from ..operators import text_graph as t
from ..sources import graph_json, markup, storage, vocabulary
from ..sources.star import star_graph, with_index
from .prelude import PRELUDE, sql_list

#: What extraction looks for in the synthetic documents.
LEXICON = t.Lexicon(
    themes={"Ering": ("ering ", "ingth"), "Ation": ("ation",), "Oire": ("oire", "queou")},
    metrics=("ble the", "onth", "ment de"),
    risks=("erth", "queel", "chach"),
)

#: The same with a name that is a theme and a risk, so that ends have to be told apart by type.
TYPED = t.Lexicon(themes={"erth": ("erth",), "Ation": ("ation",)}, metrics=("onth", "ment de"), risks=("erth", "queel"))


def _read(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.coalesce(F.array_join(f.name, "|"), F.lit("")) for f in df.schema if f.dataType.typeName() == "array"})


def _sentences(d: DataFrame) -> DataFrame:
    s = x.sentences(F.col("text"))
    return d.select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"), F.sha1(F.array_join("s", "|")).alias("digest"))


def _packed(d: DataFrame) -> DataFrame:
    p = d.select("doc_id", x.clean_text(F.col("text")).alias("c")).select("doc_id", x.split_long(F.col("c"), 900).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.array_max(F.transform("p", lambda s: F.length(s))).alias("longest"), F.sha1(F.array_join("p", "|")).alias("digest"))


def _relation_cross(d: DataFrame) -> DataFrame:
    rows = t.scope_relations(d.select("doc_id", "source", "text"), F.col("source"), F.col("text"), LEXICON).select("doc_id", F.explode_outer("relations").alias("r")).filter("r is not null")
    return rows.select("doc_id", "r.source", "r.relation", "r.target")


def _entities(d: DataFrame) -> DataFrame:
    return t.extract_entities(d, "doc_id", "text", LEXICON).select(F.col("scope").alias("doc_id"), "type", "name", "id")


def _qa(d: DataFrame) -> DataFrame:
    pairs = t.pair_answers(d, "conv_id", "turn", F.col("role") == "user")
    return pairs.select("conv_id", "sequence", F.sha1(F.array_join("question", "|")).alias("question"), F.size("answers").alias("n_answers"), F.sha1(F.array_join("answers", "|")).alias("answers"))


def _entity_upsert(e: DataFrame) -> DataFrame:
    rows = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.lit("user").alias("entity_type"), F.lit("events").alias("source"), F.col("event_id").alias("load_seq"), F.create_map(F.col("event_type"), F.col("value").cast("string")).alias("properties"))
    out = loader.entity_table(rows)
    return out.select("id", "name", "load_seq", F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda p: F.concat_ws("=", p["key"], p["value"]))), "; ").alias("properties"))


def _stored(g) -> DataFrame:
    """Vectors of the chunks of orders that aren't open; by priority some have no model and some an old one."""
    done = g.chunks.filter(~F.col("text").contains(" status O "))
    model = F.when(F.col("heading").startswith("1"), F.lit(None).cast("string")).when(F.col("heading").startswith("2"), "old").otherwise("model-a")
    return done.select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding"), model.alias("embedding_model"), F.lit(768).alias("embedding_dimensions"))


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return emb.pending(with_index(g.chunks), _stored(g), "model-a", 768).select("id", "document_id", "index", "heading")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return emb.coverage(g.chunks, _stored(g))


def _embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    text = emb.embedding_text(F.col("ticker"), F.col("company"), F.col("title"), F.col("heading"), F.col("chunk_text"))
    rows = g.evidence().join(g.chunks.select(F.col("id").alias("chunk_id"), "heading"), "chunk_id")
    return rows.select("chunk_id", F.sha1(text).alias("digest"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = p.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("").alias("kind"), (F.col("page_id") % 3).alias("chunks"), (F.col("page_id") % 4).alias("entities"), (F.col("page_id") % 5).alias("relations"))
    return _flat(audits.audit(rows).select("page_id", "chunks", "entities", "relations", "warnings"))


def _unit(e: DataFrame) -> DataFrame:
    v = e.select("vec_id", x.l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)), 6).alias("norm"))


def _nearest(e: DataFrame) -> DataFrame:
    return emb.nearest(e, e.filter("vec_id % 100 = 0"), 5).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def _indexed(e: DataFrame) -> DataFrame:
    path = storage.scratch(e.sparkSession, "index")
    vector_index.build(e, path)
    return vector_index.search(e.sparkSession, path, e.filter("vec_id % 100 = 0"), 5).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def _cosine(e: DataFrame) -> DataFrame:
    v = x.l2_normalised(F.col("embedding"))
    return e.select("vec_id", F.round(x.dot(v, F.reverse(v)), 6).alias("cosine"))


def _exported(rows: DataFrame, kind: str, confidence: float) -> DataFrame:
    """Texts (key, text, company) as extracted graphs: a document with one chunk, its entities and its relations."""
    ident = F.concat(F.lit(f"{kind}-"), "key")
    found = t.scope_relations(rows.withColumn("id", ident), F.col("company"), F.col("text"), LEXICON)
    ends = lambda r, side: t.entity_id(r[f"{side}_type"], r[side])
    firm = F.array(F.struct(F.lit("Company").alias("type"), F.col("company").alias("name")))
    entities = F.transform(F.concat(t.entities_of(F.col("text"), LEXICON), firm), lambda e: F.struct(t.entity_id(e["type"], e["name"]).alias("id"), e["name"].alias("name"), e["type"].alias("entity_type")))
    relations = F.transform("relations", lambda r, i: F.struct(
        F.concat_ws("-", F.col("id"), i.cast("string")).alias("id"), ends(r, "source").alias("source_entity_id"), r["relation"].alias("relation_type"), ends(r, "target").alias("target_entity_id"), F.concat(F.col("id"), F.lit("-c")).alias("scope_id"), F.lit(confidence).alias("confidence")))
    document = F.struct(F.col("id"), F.lit(kind).alias("title"), F.col("company").alias("company_id"), F.col("company").alias("company_name"), F.lit("FY2026 Q1").alias("fiscal_quarter"), F.concat(F.lit("call-"), "company").alias("call_id"))
    chunk = F.array(F.struct(F.concat("id", F.lit("-c")).alias("id"), F.col("id").alias("document_id"), F.lit(1).alias("index"), F.col("text")))
    body = F.to_json(F.struct(document.alias("document"), chunk.alias("chunks"), entities.alias("entities"), relations.alias("relations")))
    return found.select(F.from_json(body, graph_json.GRAPH_SCHEMA).alias("g"), "id").select("g.*", F.col("id").alias("file"), F.col("id").alias("load_seq"))


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then documents anew with pages, loaded over each other: the facts that stand in the end."""
    from ..cli import load_graph, open_graph

    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = read("documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("company"))
    pages = read("pages").select(F.col("page_id").alias("key"), F.coalesce("html", F.lit("")).alias("text"), F.lit("web").alias("company"))
    path = storage.scratch(spark, "loads")
    for exports in (_exported(docs, "doc", 0.5), _exported(pages, "page", 0.7).unionByName(_exported(docs, "doc", 0.9))):
        load_graph(spark, exports, path)
    g = open_graph(spark, path)
    names = lambda side: g.entities.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side))
    return g.facts.join(names("from"), "from_id").join(names("to"), "to_id").select("from_id", "from", "relation_type", "to_id", "to", "conf100", "chunk_id")


def _batches(d: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return d.select("source", "doc_id", F.floor((rn - 1) / 8).alias("batch")).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def _markdown(d: DataFrame) -> DataFrame:
    md = F.concat(F.lit("# Overview\n\n"), F.coalesce("text", F.lit("")))
    return t.for_graph(t.chunk_documents(d.select(F.col("doc_id"), md.alias("md")), "doc_id", "md"))


def _sync_relations(d: DataFrame) -> DataFrame:
    chunks = _markdown(d).join(d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("company")), "document_id")
    return t.document_relations(chunks, TYPED).select("document_id", "scope", "source_entity_id", "relation", "target_entity_id")


_QUESTIONS = {"en": "Across the loaded graph, what risks do companies report for AI", "fr": "What does AI demand affect for cloud backlog", "de": "Which companies are loaded in the graph", "es": "Top entities of the graph"}


def _question(d: DataFrame) -> DataFrame:
    q = F.create_map(*[F.lit(y) for p in _QUESTIONS.items() for y in p])[F.col("lang")]
    asked = F.concat(q, F.lit(" "), F.regexp_replace("text", "[^A-Za-z ]", ""))
    rows = d.select("doc_id", asked.alias("question"))
    return rows.select("doc_id", F.array_join(questions.query_terms_column(F.col("question")), "|").alias("terms"), questions.route_column(F.col("question")).alias("tool"))


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    out = None
    for name, df in (("company", g.companies), ("source_document", g.documents), ("chunk", g.chunks), ("entity", g.entities), ("relation_fact", g.facts), ("ontology_concept", g.concepts), ("earnings_call", g.calls)):
        one = loader.violations(df, "id").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("label"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def _relations_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    rows = g.facts.select("id", F.col("from_id").alias("source_entity_id"), "relation_type", F.col("to_id").alias("target_entity_id"), "evidence_text", F.col("conf100").alias("confidence"), "chunk_id", F.lit(None).cast("long").alias("scope_id"), F.xxhash64("id").alias("load_seq"))
    f = loader.relation_tables(rows, g.entities, g.chunks)["relation_fact"]
    return f.select("id", "source_entity_id", "relation_type", "target_entity_id", "confidence", "support")


def _documents_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order loads its customer's document; the last load of a document wins."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string"))
    rows = o.select(
        F.col("c_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("c_nationkey").alias("company_id"), F.concat(F.lit("Company "), "c_nationkey").alias("company_name"), F.lit("T").alias("ticker"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("sector"), label.alias("fiscal_quarter"), F.concat_ws("-", "c_nationkey", label).alias("call_id"), F.lit("d").alias("call_date"),
        F.lit("u").alias("source_url"), F.lit("k").alias("source_kind"), F.lit("p").alias("markdown_path"), F.col("o_orderkey").alias("load_seq"),
    )
    d = loader.document_tables(rows)
    key = lambda name, c: d[name].select(F.lit(name).alias("label"), F.col(c[0]).cast("string").alias("id"), F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c[1:]]).alias("row"))
    parts = [("source_document", ("id", "company_id", "call_id", "title")), ("company", ("id", "name", "sector")), ("earnings_call", ("id", "company_id", "fiscal_quarter")), ("sector", ("name",)), ("quarter", ("name", "number")), ("fiscal_period", ("id", "label", "fiscal_year", "quarter"))]
    out = None
    for name, c in parts:
        out = key(name, c) if out is None else out.unionByName(key(name, c))
    return out


def _chunks_loaded(d: DataFrame) -> DataFrame:
    """Neighbours by id write one chunk; the later one wins."""
    rows = d.select(F.floor(F.col("doc_id") / 2).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("heading"), F.col("doc_id").alias("load_seq"))
    out = loader.chunk_table(rows)
    return out.select("id", "load_seq", "heading", F.array_join("heading_path", "|").alias("heading_path"), "text_hash", F.sha1("text_preview").alias("preview"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    url = F.concat(F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("c_nationkey") % len(_HOSTS) + 1).cast("int")), "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", ".PDF?x=1").otherwise(".html"))
    pair = lambda k, v: [F.lit(k), v]
    m = F.create_map(*pair("filename", F.concat(F.lit("in/"), "c_name", F.lit(".md"))), *pair("company", F.concat(F.lit(" Firm & "), "c_nationkey", F.lit(" "))), *pair("quarter", F.lit("FY2026 Q1")), *pair("source_url", url), *pair("segment", F.col("c_mktsegment")))
    rows = markup.manifest_entries(c.select(m.alias("m")))
    return rows.select("filename", "company", "company_id", "quarter", "source_url", "adapter", "source_type", F.col("extra")["segment"].alias("segment"), markup.is_conference_call(F.col("source_type")).alias("is_call"))


_HOSTS = ["https://www.adobe.com/", "https://q4cdn.com/", "https://notadobe.com/", "http://user@investor.tsmc.com:80/", "https://News.Apple.com/", "https://x.example/"]
_PHRASES = [
    "AI demand", "Azure growth", "gross margin pressure", "Revenue", "remaining performance obligation", "capex", "pricing power", "supply constraints", "data centers", "foreign exchange", "Product", "cloud",
    "memory bandwidth", "storage", "enterprise AI adoption", "consumer demand in Asia", "share repurchases", "liquid cooling", "component costs", "regulatory scrutiny", "credit consumption", "growth demand driver", "networking fabric", "none of these", "compute capacity",
]


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts named by phrases, resolved to the vocabulary."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    phrase = lambda n: F.element_at(F.array(*map(F.lit, _PHRASES)), (n % len(_PHRASES) + 1).cast("int"))
    name, context = phrase(F.col("p_partkey")), F.when(F.col("p_size") > 25, F.concat("p_name", F.lit("  "), phrase(F.col("p_size"))))
    kind = F.when(F.col("p_type") == "PROMO", "Company").when(F.col("p_type") == "SMALL", F.lit(None).cast("string")).otherwise("Theme")
    rows = p.select(F.col("p_partkey").alias("id"), kind.alias("entity_type"), F.array(name, F.concat("p_name", F.lit(" "), F.lower(name)), context).alias("candidates"))
    return t.resolve_concepts(rows, vocabulary.tables(spark)[1])


def _links(p: DataFrame) -> DataFrame:
    found = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))).alias("pos", "a"))
    url, label = F.regexp_extract("a", 'href="([^"]*)"', 1), F.regexp_extract("a", ">([^<]*)<", 1)
    return found.select("page_id", "pos", url.alias("url"), label.alias("label"), markup.candidate_priority(url, label).alias("priority"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sentence_split": _read("documents", _sentences),
    "long_text_pack": _read("documents", _packed),
    "paragraphs": _read("documents", lambda d: d.select("doc_id", F.posexplode(F.split("text", r"\n\s*")).alias("pos", "p")).select("doc_id", "pos", x.clean_text(F.col("p")).alias("paragraph")).filter("paragraph <> ''")),
    "acronyms": _read("documents", lambda d: d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(t.ACRONYM), F.lit(0)))).alias("acronym")).filter(~F.col("acronym").isin(*fixed.ACRONYM_STOP))),
    "theme_match": _read("documents", lambda d: d.select("doc_id", F.array_join(F.transform(F.filter(t.entities_of(F.col("text")), lambda e: e["type"] == "Theme"), lambda e: e["name"]), "|").alias("themes"))),
    "entity_extract": _read("documents", _entities),
    "relation_cross": _read("documents", _relation_cross),
    "claim_sentences": _read("documents", lambda d: _flat(d.select("doc_id", t.claim_sentences(F.concat(F.lit("We expect strong cloud growth this year. "), "text")).alias("claims")))),
    "stance": _read("documents", lambda d: d.select("doc_id", t.stance(F.concat_ws(" ", "text", F.when(F.col("doc_id") % 2 == 0, "cost pressure"), F.when(F.col("doc_id") % 3 == 0, "strong growth"))).alias("stance"))),
    "claim_type": _read("documents", lambda d: d.select("doc_id", t.claim_type(F.concat_ws(" ", "text", F.when(F.col("doc_id") % 2 == 0, "headwind"), F.when(F.col("doc_id") % 3 == 0, "adoption"), F.when(F.col("doc_id") % 5 == 0, "depreciation"))).alias("claim_type"))),
    "qa_pairs": _read("conversations", _qa),
    "slug": _read("documents", lambda d: d.select("doc_id", x.slug(F.col("text")).alias("slug"))),
    "preview": _read("documents", lambda d: d.select("doc_id", x.preview(x.clean_text(F.col("text")), 360).alias("preview"))),
    "sha1_ids": _read("documents", lambda d: d.select("doc_id", F.concat(F.lit("rel-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("-"), x.short_hash(F.concat("source", "lang", "text"))).alias("id"))),
    "fiscal_parse": _read("orders", lambda o: o.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "FY").otherwise("fiscal "), F.date_format("o_orderdate", "yyyy"), F.lit(" q"), F.quarter("o_orderdate")).alias("l")).select("o_orderkey", x.fiscal_year(F.col("l")).alias("fiscal_year"), x.quarter_number(F.col("l")).alias("quarter"))),
    "query_terms": _read("documents", _question),
    "html_text": _read("pages", lambda p: p.select("page_id", F.sha1(markup.html_text_column(F.col("html"))).alias("digest"), F.length(markup.html_text_column(F.col("html"))).alias("n"))),
    "html_text_exact": _read("pages", markup.html_texts),
    "link_candidates": _read("pages", _links),
    "link_best": _read("pages", lambda p: markup.best_links(markup.links(p))),
    "source_adapter": _read("pages", lambda p: p.select("page_id", markup.adapter(F.col("url")).alias("adapter"), markup.source_type(F.col("url")).alias("source_type"))),
    "markdown_chunks": _read("documents", _markdown),
    "sync_relations": _read("documents", _sync_relations),
    "batches": _read("documents", _batches),
    "l2_normalize": _read("embeddings", _unit),
    "cosine": _read("embeddings", _cosine),
    "cosine_topk": _read("embeddings", _nearest),
    "cosine_topk_indexed": _read("embeddings", _indexed),
    "loads_add_up": _loads,
    "entity_upsert": _read("events", _entity_upsert),
    "relation_upsert": _relations_loaded,
    "constraint_check": _constraints,
    "document_upsert": _documents_loaded,
    "chunk_upsert": _read("documents", _chunks_loaded),
    "manifest_entries": _manifest,
    "concept_resolution": _resolved,
    "pending_chunks": _pending,
    "embedding_coverage": _coverage,
    "embedding_text": _embedding_texts,
    "export_audit": _audit,
}

_CLEAN = r"trim(regexp_replace(trim(regexp_replace(regexp_replace({0}, '[`*_]', '', 'g'), '\[(.*?)\]\((.*?)\)', '\1', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _has(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{y}')" for y in terms) + ")"


_PACK = f"""CASE WHEN length(c) <= 900 THEN [c] ELSE string_split(list_reduce({_SENTENCES.format('c')}, lambda a, s: CASE WHEN length(string_split(a, chr(2))[-1]) + 1 + length(s) > 900 THEN a || chr(2) || s ELSE a || ' ' || s END), chr(2)) END"""
_ACRONYMS = r"SELECT DISTINCT doc_id, acronym FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS acronym FROM documents) WHERE regexp_full_match(acronym, '[A-Z][A-Z0-9]{1,6}') AND acronym NOT IN ('CEO', 'CFO', 'Q', 'A')"
_ENT = "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT doc_id, source, 'Theme' AS type, '{k}' AS name, {i} AS o FROM documents WHERE {_has('lower(text)', [k.lower(), *v])}" for i, (k, v) in enumerate(LEXICON.themes.items())]
    + [f"SELECT doc_id, source, '{kind}', '{v}', 0 FROM documents WHERE contains(lower(text), '{v}')" for kind, terms in (("Metric", LEXICON.metrics), ("Risk", LEXICON.risks)) for v in terms]
) + ")"
_THEMES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS theme, {i} AS o FROM documents WHERE {_has('lower(text)', [k.lower(), *v])}" for i, (k, v) in enumerate(fixed.THEME_ALIASES.items()))
_ASKED = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _QUESTIONS.items()) + " END || ' ' || regexp_replace(text, '[^A-Za-z ]', '', 'g')"
_ROUTE = "CASE " + " ".join(f"WHEN {_has('low', a)}" + (f" AND {_has('low', b)}" if b else "") + f" THEN '{tool}'" for tool, a, b in fixed.ROUTES) + " END"
_LOW = "lower(concat_ws(' ', url, label))"
_PRIORITY = f"""CASE WHEN {_has('low', ['slide', 'powerpoint', 'annual-report', 'download-center', 'presentation'])} OR tr + ca = 0 OR {_has('low', ['press release', 'earnings release', 'financial statement', 'financial result', 'financial and business result'])} THEN 0
  ELSE CASE WHEN contains(low, '.pdf') THEN 100 WHEN {_has('low', ['.docx', 'officeapps.live.com', 'aka.ms/transcript', 'transcript'])} THEN 70 ELSE 0 END + tr + ca END"""
_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'),
  '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<svg\b[^>]*>.*?</svg>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""
_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
_PDF = "ends_with(lower(regexp_extract(url, '^([^?#]*)', 1)), '.pdf')"
_ADAPTER = "CASE WHEN trim(coalesce(url, '')) = '' THEN 'unconfigured' " + " ".join(f"WHEN {_HOST} = '{d}' OR ends_with({_HOST}, '.{d}') THEN '{n}'" for n, d, _ in fixed.SOURCE_ADAPTERS) + f" WHEN {_PDF} THEN 'generic-pdf' ELSE 'generic-html' END"
_TYPE = "CASE adapter " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, _, k in fixed.SOURCE_ADAPTERS) + f" ELSE CASE WHEN {_PDF} THEN 'transcript_pdf' ELSE 'transcript_html' END END"

_BLANK = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SPOKEN = [p.replace("(?i)", "") for p in fixed.SPEAKER_LINES]
_CHUNKS = rf"""WITH l AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split('# Overview' || chr(10) || chr(10) || coalesce(text, ''), chr(10)) AS ls FROM documents))),
s AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(bare, '^{p}') THEN regexp_extract(bare, '^{p}', 1)" for p in _SPOKEN)} END AS label, CASE WHEN i = 1 THEN 'Overview' {" ".join(f"WHEN regexp_matches(bare, '^{p}') THEN regexp_extract(bare, '^{p}', 2)" for p in _SPOKEN)} ELSE line END AS text FROM l),
b AS (SELECT *, sum(CASE WHEN i = 1 OR label IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM s WHERE NOT starts_with(trim(text), '{fixed.SOURCE_NOTE}')),
g AS (SELECT *, first_value(label) OVER (PARTITION BY doc_id, block ORDER BY i) AS who, sum(CASE WHEN {_BLANK} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY i) AS para FROM b),
p AS (SELECT doc_id, block, para, any_value(who) AS who, min(i) AS start_line, max(i) AS end_line, string_agg(text, chr(10) ORDER BY i) AS raw FROM g WHERE {_BLANK} <> '' GROUP BY doc_id, block, para),
c AS (SELECT *, {_CLEAN.format("raw")} AS c, {_CLEAN.format("who")} AS person FROM p),
k AS (SELECT *, {_PACK} AS pieces FROM c WHERE c <> '' AND NOT regexp_full_match(c, '{fixed.PAGE_MARK}') AND NOT regexp_full_match(c, '{fixed.PAGE_NUMBER}')),
n AS (SELECT *, pieces[j] AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY block, para, j) AS index FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS j FROM k)),
w AS (SELECT *, coalesce(trim(CASE WHEN contains(person, ',') THEN string_split(person, ',')[1] ELSE string_split(person, ' - ')[1] END), '') AS speaker,
  coalesce(trim(CASE WHEN contains(person, ',') THEN substr(person, strpos(person, ',') + 1) WHEN contains(person, ' - ') THEN substr(person, strpos(person, ' - ') + 3) ELSE '' END), '') AS title FROM n),
t AS (SELECT *, CASE WHEN who IS NULL THEN 'document_overview' WHEN contains(lower(speaker), 'question') OR contains(lower(speaker), 'analyst') THEN 'analyst_question' ELSE 'speaker_statement' END AS chunk_type FROM w)
SELECT doc_id || '-chunk-' || CASE WHEN index < 100 THEN lpad(CAST(index AS VARCHAR), 3, '0') ELSE CAST(index AS VARCHAR) END AS id, CAST(doc_id AS VARCHAR) AS document_id, index, chunk_type, 'Overview' AS heading, speaker, title, piece AS text,
  start_line, end_line, substr(sha1(piece), 1, 10) AS text_hash, CASE WHEN length(piece) <= 360 THEN piece ELSE rtrim(substr(piece, 1, 359)) || '…' END AS text_preview FROM t WHERE chunk_type <> 'analyst_question'"""
_TYPED = " UNION ALL ".join(
    [f"SELECT *, 'theme' AS type, '{k}' AS name FROM ch WHERE {_has('lower(text)', [k.lower(), *v])}" for k, v in TYPED.themes.items()]
    + [f"SELECT *, '{kind}', '{v}' FROM ch WHERE contains(lower(text), '{v}')" for kind, terms in (("metric", TYPED.metrics), ("risk", TYPED.risks)) for v in terms]
)
_ENTITY = "'entity-' || {0}.type || '-' || replace(lower({0}.name), ' ', '-')"
_SYNCED = f"""WITH ch AS (SELECT c.id, c.document_id, c.text, d.source FROM ({_CHUNKS}) c JOIN documents d ON c.document_id = CAST(d.doc_id AS VARCHAR)), e AS ({_TYPED} UNION ALL SELECT *, 'company', source FROM ch),
r(a, relation, b) AS (VALUES ('company', 'DISCUSSES', 'theme'), ('theme', 'AFFECTS', 'metric'), ('theme', 'EXPOSED_TO', 'risk'), ('risk', 'PRESSURES', 'metric'))
SELECT x.document_id, x.id AS scope, {_ENTITY.format("x")} AS source_entity_id, relation, {_ENTITY.format("y")} AS target_entity_id FROM r JOIN e x ON x.type = r.a JOIN e y ON y.type = r.b AND y.id = x.id"""
_HTML_ENT = " UNION ALL ".join(
    [f"SELECT *, 'theme' AS type, '{k}' AS name FROM x WHERE {_has('lower(text)', [k.lower(), *v])}" for k, v in LEXICON.themes.items()]
    + [f"SELECT *, '{kind}', '{v}' FROM x WHERE contains(lower(text), '{v}')" for kind, terms in (("metric", LEXICON.metrics), ("risk", LEXICON.risks)) for v in terms]
)
_LOADS = f"""WITH x AS (SELECT 'doc-' || doc_id || '-c' AS id, coalesce(text, '') AS text, source AS company, 90 AS conf FROM documents UNION ALL SELECT 'page-' || page_id || '-c', coalesce(html, ''), 'web', 70 FROM pages),
e AS ({_HTML_ENT} UNION ALL SELECT *, 'company', company FROM x), r(a, relation, b) AS (VALUES ('company', 'DISCUSSES', 'theme'), ('theme', 'AFFECTS', 'metric'), ('theme', 'EXPOSED_TO', 'risk'), ('risk', 'PRESSURES', 'metric'))
SELECT {_ENTITY.format("s")} AS from_id, s.name AS "from", relation AS relation_type, {_ENTITY.format("t")} AS to_id, t.name AS "to", CAST(s.conf AS BIGINT) AS conf100, s.id AS chunk_id FROM r JOIN e s ON s.type = r.a JOIN e t ON t.type = r.b AND t.id = s.id"""
_LABEL = "'FY' || year(o_orderdate) || ' Q' || quarter(o_orderdate)"
_LOADED = f"""WITH o AS (SELECT c_custkey AS id, o_orderpriority AS title, c_nationkey AS company_id, o_orderstatus AS status, {_LABEL} AS label, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'source_document' AS label, CAST(id AS VARCHAR) AS id, arg_max(company_id || '|' || company_id || '-' || label || '|' || title, seq) AS row FROM o GROUP BY id
UNION ALL SELECT 'company', CAST(company_id AS VARCHAR), 'Company ' || company_id || '|' || arg_max(CASE WHEN status = 'O' THEN 'Unknown' ELSE status END, seq) FROM o GROUP BY company_id
UNION ALL SELECT DISTINCT 'earnings_call', company_id || '-' || label, company_id || '|' || label FROM o
UNION ALL SELECT DISTINCT 'sector', CASE WHEN status = 'O' THEN 'Unknown' ELSE status END, '' FROM o
UNION ALL SELECT DISTINCT 'quarter', right(label, 2), right(label, 1) FROM o
UNION ALL SELECT DISTINCT 'fiscal_period', replace(lower(label), ' ', '-'), label || '|' || CASE WHEN contains(label, 'FY20') THEN substr(label, 3, 4) ELSE '' END || '|' || right(label, 2) FROM o"""
_ENTRIES = f"""WITH m AS (SELECT c_name || '.md' AS filename, 'Firm & ' || c_nationkey AS company, 'firm-' || c_nationkey AS company_id, 'FY2026 Q1' AS quarter, {sql_list(_HOSTS)}[c_nationkey % {len(_HOSTS)} + 1] || c_custkey || CASE WHEN c_mktsegment = 'BUILDING' THEN '.PDF?x=1' ELSE '.html' END AS url, c_mktsegment AS segment FROM customer),
a AS (SELECT *, {_ADAPTER} AS adapter FROM m), k AS (SELECT *, {_TYPE} AS source_type FROM a)
SELECT filename, company, company_id, quarter, url AS source_url, adapter, source_type, segment, list_contains({sql_list(list(fixed.CONFERENCE_CALL_TYPES))}, source_type) AS is_call FROM k"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VOCABULARY = vocabulary.load()[0]
_PHRASED = lambda n: f"{sql_list(_PHRASES)}[{n} % {len(_PHRASES)} + 1]"
_WORDS = "(' ' || regexp_replace({0}, '[^a-z0-9]', ' ', 'g') || ' ')"
_IN = lambda hay, needle: f"(contains({_WORDS.format(hay)}, {_WORDS.format(needle)}) AND contains({hay}, {needle}))"
_TOKENS_OF = "list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda y: length(y) > 1)"
_CONCEPTS = f"""WITH v(concept_id, name, alias) AS (VALUES {", ".join(f"({_quoted(c['id'])}, {_quoted(c['name'])}, {_quoted(a)})" for c in _VOCABULARY for a in c["aliases"])}),
al AS (SELECT DISTINCT concept_id, name, trim(regexp_replace(lower(alias), '[ \t\n]+', ' ', 'g')) AS a FROM v),
e AS (SELECT p_partkey AS id, list_distinct(list_filter(list_transform([{_PHRASED("p_partkey")}, p_name || ' ' || lower({_PHRASED("p_partkey")}), CASE WHEN p_size > 25 THEN p_name || '  ' || {_PHRASED("p_size")} END], lambda y: trim(regexp_replace(lower(y), '[ \t\n]+', ' ', 'g'))), lambda y: y <> '')) AS cs FROM part WHERE p_type <> 'PROMO'),
pair AS (SELECT id, concept_id, name, c, a, {_TOKENS_OF.format("c")} AS t, {_TOKENS_OF.format("a")} AS u FROM (SELECT id, unnest(cs) AS c FROM e), al),
conf AS (SELECT id, concept_id, name, CASE WHEN c = a THEN 1.0 WHEN either AND len(short) = 1 AND list_contains({sql_list(list(fixed.GENERIC_TOKENS))}, short[1]) THEN 0.0 WHEN either AND least(length(c), length(a)) >= 5 THEN 0.88
  WHEN len(list_distinct(t)) >= 2 AND len(list_distinct(u)) >= 2 AND len(list_intersect(t, u)) / least(len(list_distinct(t)), len(list_distinct(u))) >= 0.75 THEN 0.74 ELSE 0.0 END AS confidence
  FROM (SELECT *, {_IN("c", "a")} OR {_IN("a", "c")} AS either, CASE WHEN length(c) <= length(a) THEN t ELSE u END AS short FROM pair)),
txt AS (SELECT id, array_to_string(cs, ' | ') AS x FROM (SELECT id, cs FROM e)),
hit AS (SELECT id, concept_id, name, CAST(confidence AS DOUBLE) AS confidence, 'alias' AS method FROM conf WHERE confidence > 0
  {" ".join(f"UNION ALL SELECT id, {_quoted(i)}, {_quoted(next(c['name'] for c in _VOCABULARY if c['id'] == i))}, {fixed.RULE_CONFIDENCE}, 'entity_resolution_rule' FROM txt WHERE regexp_matches(x, {_quoted('|'.join(p))})" for i, _, p in fixed.RESOLUTION_RULES if any(c["id"] == i for c in _VOCABULARY))}),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id, concept_id ORDER BY confidence DESC, method DESC) = 1)
SELECT id AS entity_id, concept_id, confidence, method FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, name, concept_id) <= 2"""

ORACLE_SQL: dict[str, str] = {
    "loads_add_up": _LOADS,
    "markdown_chunks": _CHUNKS,
    "sync_relations": _SYNCED,
    "document_upsert": _LOADED,
    "chunk_upsert": "SELECT id, seq AS load_seq, source AS heading, source AS heading_path, sha1(t) AS text_hash, sha1(CASE WHEN length(t) <= 360 THEN t ELSE rtrim(substr(t, 1, 359)) || '…' END) AS preview FROM (SELECT doc_id // 2 AS id, max(doc_id) AS seq, arg_max(source, doc_id) AS source, arg_max(coalesce(text, ''), doc_id) AS t FROM documents GROUP BY 1)",
    "manifest_entries": _ENTRIES,
    "concept_resolution": _CONCEPTS,
    "sentence_split": f"SELECT doc_id, len(s) AS n, s[1] AS first, sha1(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)",
    "long_text_pack": f"""WITH c AS (SELECT doc_id, {_CLEAN.format('text')} AS c FROM documents), p AS (SELECT doc_id, {_PACK} AS p FROM c)
      SELECT doc_id, len(p) AS n, list_max(list_transform(p, lambda s: length(s))) AS longest, sha1(array_to_string(p, '|')) AS digest FROM p""",
    "paragraphs": rf"SELECT doc_id, pos, paragraph FROM (SELECT doc_id, i - 1 AS pos, {_CLEAN.format('ps[i]')} AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\n[ \t\n\x0B\f\r]*', chr(10), 'g'), chr(10)) AS ps FROM documents))) WHERE paragraph <> ''",
    "acronyms": _ACRONYMS,
    "theme_match": f"SELECT d.doc_id, coalesce(string_agg(theme, '|' ORDER BY o), '') AS themes FROM documents d LEFT JOIN ({_THEMES}) x ON d.doc_id = x.doc_id GROUP BY 1",
    "entity_extract": f"SELECT doc_id, type, name, 'entity-' || lower(type) || '-' || replace(lower(name), ' ', '-') AS id FROM (SELECT doc_id, type, name FROM ({_ENT}) UNION ALL SELECT doc_id, 'BusinessTerm', acronym FROM ({_ACRONYMS}))",
    "relation_cross": f"""WITH e AS ({_ENT}) SELECT doc_id, source, 'DISCUSSES' AS relation, name AS target FROM e WHERE type = 'Theme'
      UNION ALL SELECT a.doc_id, a.name, CASE WHEN a.type = 'Risk' THEN 'PRESSURES' WHEN b.type = 'Metric' THEN 'AFFECTS' ELSE 'EXPOSED_TO' END, b.name FROM e a JOIN e b ON a.doc_id = b.doc_id AND ((a.type = 'Theme' AND b.type IN ('Metric', 'Risk')) OR (a.type = 'Risk' AND b.type = 'Metric'))""",
    "claim_sentences": rf"SELECT doc_id, coalesce(array_to_string(list_filter({_SENTENCES.format(chr(40) + chr(39) + 'We expect strong cloud growth this year. ' + chr(39) + ' || text' + chr(41))}, lambda s: len(regexp_split_to_array(s, '[ \t\n\x0B\f\r]+')) >= 6 AND {_has('lower(s)', fixed.CLAIM_KEYWORDS)})[1:8], '|'), '') AS claims FROM documents",
    "stance": f"SELECT doc_id, CASE WHEN {_has('x', fixed.NEGATIVE)} THEN CASE WHEN {_has('x', fixed.OFFSETTING)} THEN 'mixed' ELSE 'negative' END WHEN {_has('x', fixed.POSITIVE)} THEN 'positive' ELSE 'neutral' END AS stance FROM (SELECT doc_id, lower(concat_ws(' ', text, CASE WHEN doc_id % 2 = 0 THEN 'cost pressure' END, CASE WHEN doc_id % 3 = 0 THEN 'strong growth' END)) AS x FROM documents)",
    "claim_type": "SELECT doc_id, CASE " + " ".join(f"WHEN {_has('x', terms)} THEN '{n}'" for n, terms in fixed.CLAIM_TYPES) + " ELSE 'operational_update' END AS claim_type FROM (SELECT doc_id, lower(concat_ws(' ', text, CASE WHEN doc_id % 2 = 0 THEN 'headwind' END, CASE WHEN doc_id % 3 = 0 THEN 'adoption' END, CASE WHEN doc_id % 5 = 0 THEN 'depreciation' END)) AS x FROM documents)",
    "qa_pairs": """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM conversations)
      SELECT conv_id, sequence, sha1(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'user')) AS question, count(*) FILTER (WHERE role <> 'user') AS n_answers, sha1(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role <> 'user'), '')) AS answers FROM s WHERE sequence > 0 GROUP BY ALL""",
    "slug": "SELECT doc_id, CASE WHEN s = '' THEN substr(sha1(t), 1, 10) ELSE s END AS slug FROM (SELECT doc_id, text AS t, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)",
    "preview": f"SELECT doc_id, CASE WHEN length(c) <= 360 THEN c ELSE rtrim(substr(c, 1, 359)) || '…' END AS preview FROM (SELECT doc_id, {_CLEAN.format('text')} AS c FROM documents)",
    "sha1_ids": "SELECT doc_id, 'rel-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '-' || substr(sha1(source || lang || text), 1, 10) AS id FROM documents",
    "fiscal_parse": "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) END AS fiscal_year, quarter(o_orderdate) AS quarter FROM orders",
    "query_terms": f"""WITH q AS (SELECT doc_id, {_ASKED} AS question FROM documents), w AS (SELECT doc_id, question, list_filter(list_transform(regexp_extract_all(question, '[A-Za-z0-9$%+.]+|[가-힣]+'), lambda y: lower(y)), lambda y: length(y) >= 2 AND NOT list_contains({sql_list(fixed.QUESTION_STOPWORDS)}, y)) AS t, lower(trim(regexp_replace(coalesce(question, ''), '[ \\t\\n]+', ' ', 'g'))) AS low FROM q)
      SELECT doc_id, array_to_string(list_concat(t, CASE WHEN list_contains(t, 'ai') AND list_contains(t, 'demand') THEN ['ai demand'] ELSE [] END, CASE WHEN list_contains(t, 'cloud') AND list_contains(t, 'backlog') THEN ['backlog'] ELSE [] END)[1:10], '|') AS terms, {_ROUTE} AS tool FROM w""",
    "html_text": f"SELECT page_id, sha1(x) AS digest, length(x) AS n FROM (SELECT page_id, {_HTML} AS x FROM pages)",
    "link_candidates": rf"""WITH a AS (SELECT page_id, i - 1 AS pos, l[i] AS a FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>') AS l FROM pages))),
      u AS (SELECT page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS url, regexp_extract(a, '>([^<]*)<', 1) AS label FROM a),
      v AS (SELECT *, {_LOW} AS low, CASE WHEN {_has(_LOW, ['transcript', 'q&a', 'qanda'])} THEN 50 ELSE 0 END AS tr, CASE WHEN {_has(_LOW, ['prepared remark', 'conference call', 'earnings call'])} THEN 30 ELSE 0 END AS ca FROM u)
      SELECT page_id, pos, url, label, {_PRIORITY} AS priority FROM v""",
    "source_adapter": f"SELECT page_id, adapter, {_TYPE} AS source_type FROM (SELECT *, {_ADAPTER} AS adapter FROM pages)",
    "batches": "SELECT source, batch, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents) GROUP BY ALL",
    "l2_normalize": """SELECT vec_id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS norm FROM (SELECT vec_id, CASE WHEN n = 0 THEN e ELSE list_transform(e, lambda y: y / n) END AS v FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))""",
    "cosine": """WITH u AS (SELECT vec_id, CASE WHEN n = 0 THEN e ELSE list_transform(e, lambda y: y / n) END AS v FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))) SELECT vec_id, round(list_dot_product(v, list_reverse(v)), 6) AS cosine FROM u""",
    "cosine_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS cosine FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM p) SELECT query_id, id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 5""",
    "entity_upsert": """WITH p AS (SELECT user_id AS id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL), l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS name, max(event_id) AS load_seq FROM events GROUP BY 1)
      SELECT l.id, name, load_seq, string_agg(event_type || '=' || CAST(v AS VARCHAR), '; ' ORDER BY event_type || '=' || CAST(v AS VARCHAR)) AS properties FROM l JOIN p USING (id) GROUP BY ALL""",
    "relation_upsert": PRELUDE + "SELECT fact.id, from_id AS source_entity_id, relation_type, to_id AS target_entity_id, conf100 AS confidence, chunk_id AS support FROM fact JOIN entity s ON from_id = s.id JOIN entity t ON to_id = t.id QUALIFY row_number() OVER (PARTITION BY fact.id ORDER BY relation_type DESC NULLS LAST, evidence_text DESC NULLS LAST, conf100 DESC NULLS LAST, chunk_id DESC NULLS LAST) = 1",
    "constraint_check": PRELUDE + " UNION ALL ".join(f"SELECT '{label}' AS label, (SELECT count(*) FROM (SELECT id FROM {cte} GROUP BY id HAVING count(*) > 1 OR id IS NULL)) AS violations" for label, cte in (("company", "company"), ("source_document", "doc"), ("chunk", "chunk"), ("entity", "entity"), ("relation_fact", "fact"), ("ontology_concept", "concept"), ("earnings_call", "call"))),
    "pending_chunks": PRELUDE + """, i AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY day, id) AS index FROM chunk) SELECT id, document_id, index, heading FROM i WHERE contains(text, ' status O ') OR starts_with(heading, '1') OR starts_with(heading, '2')""",
    "embedding_coverage": "SELECT count(*) AS chunks, count(*) FILTER (WHERE o_orderstatus <> 'O') AS embedded_chunks FROM orders",
    "embedding_text": PRELUDE + "SELECT chunk_id, sha1(substr('Company: ' || company || chr(10) || 'Ticker: ' || ticker || chr(10) || 'Document: ' || title || chr(10) || 'Heading: ' || heading || chr(10) || 'Text:' || chr(10) || chunk_text, 1, 8000)) AS digest FROM ev JOIN chunk ON chunk_id = chunk.id",
    "export_audit": f"""WITH p AS (SELECT page_id, lower(concat_ws(' ', url, regexp_extract(html, '<title>([^<]*)</title>', 1), '')) AS x, page_id % 3 AS chunks, page_id % 4 AS entities, page_id % 5 AS relations FROM pages),
      o AS (SELECT *, array_to_string(list_filter({sql_list(fixed.AUDIT_OFF_TOPIC)}, lambda y: contains(x, y)), ', ') AS off FROM p)
      SELECT page_id, chunks, entities, relations, array_to_string(list_filter([CASE WHEN NOT {_has('x', fixed.AUDIT_POSITIVE)} THEN 'source does not include an earnings/transcript/call keyword' END, CASE WHEN off <> '' THEN 'off-topic source keyword(s): ' || off END, CASE WHEN chunks = 0 THEN 'no chunks' END, CASE WHEN entities = 0 THEN 'no entities' END, CASE WHEN relations = 0 THEN 'no relations' END], lambda y: y IS NOT NULL), '|') AS warnings FROM o""",
}
ORACLE_SQL["cosine_topk_indexed"] = ORACLE_SQL["cosine_topk"]
