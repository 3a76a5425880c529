"""The graph queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_queries as q
from ..operators import payload as p
from ..operators import search_index
from ..sources.star import star_graph
from ..sources.storage import scratch
from .prelude import PRELUDE, ROW, SEARCH_ORDER, searched

TERMS = ["ring", "brand 7", "open demand", "pressures"]
NODE, CONCEPT, TICKER = 84, 7, "T7"
COMPANY_TERMS, TOPIC_TERMS = ["t7", "nation_7"], ["widget", "demand"]
CATEGORY, DEMAND = ["widget", "bolt", "family"], ["demand", "drives", "growth"]
RISK_CATEGORY, RISK = ["ring", "gear", "brand 3"], ["pressures", "supply", "constraint"]
PRODUCT, PRODUCT_SIGNAL = ["blue", "green", "brand 11"], ["demand", "supply", "discusses"]


def _flat(df: DataFrame) -> DataFrame:
    """String lists as sorted text, for comparison by value."""
    return df.withColumns({f.name: q.text_of(f.name) for f in df.schema if f.dataType.typeName() == "array"})


def _on_graph(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _flat(f(star_graph(spark, sf_dir)))


def _indexed(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """A search by postings that are built for it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, path = star_graph(spark, sf_dir), scratch(spark, "postings")
        search_index.build(g, path)
        return _flat(f(g, path))

    return run


def _payload_rows(g) -> DataFrame:
    return q.relation_search(g, TERMS, 400)


def _rank(g) -> DataFrame:
    rows = q.relation_rank(q.cli_relations(g, TERMS, 500), TERMS)
    return rows.select("fact_id", "relevance", "insight_rank").orderBy("insight_rank", F.desc("relevance"), "fact_id").limit(100)


def _answer(g) -> DataFrame:
    from ..operators.answers import answer

    return answer(q.relation_search(g, TERMS, 200), TERMS)


def _signal(g) -> DataFrame:
    return g.facts.groupBy(q.relation_signal(F.col("relation_type")).alias("signal")).agg(F.count(F.lit(1)).alias("facts"))


def _balanced(g) -> DataFrame:
    rows = q.relation_search(g, TERMS, 200)
    return q.company_balanced(rows, "company", [q.asc("fact_id")], 3).filter("rank <= 3").select("company", "fact_id", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "key_nodes": _on_graph(lambda g: q.key_nodes(g, 300)),
    "key_nodes_extended": _on_graph(lambda g: q.key_nodes_extended(g, 300)),
    "read_relations": _on_graph(lambda g: q.read_relations(g, "widget", 500)),
    "question_context": _on_graph(lambda g: q.question_context(g, NODE, 50)),
    "node_context": _on_graph(lambda g: q.node_context(g, NODE, 50)),
    "relation_search_cli": _on_graph(lambda g: q.cli_relations(g, TERMS, 100)),
    "relation_search": _on_graph(lambda g: q.relation_search(g, TERMS, 300)),
    "relation_search_company": _on_graph(lambda g: q.relation_search(g, TERMS, 300, TICKER)),
    "relation_balanced": _on_graph(lambda g: q.balanced_relation_search(g, TERMS, 250)),
    "relation_count": _on_graph(lambda g: q.relation_count(g, TERMS)),
    "relation_count_company": _on_graph(lambda g: q.relation_count(g, TERMS, TICKER)),
    "relation_search_indexed": _indexed(lambda g, path: search_index.relation_search_indexed(g, path, TERMS, 300)),
    "relation_count_indexed": _indexed(lambda g, path: search_index.relation_count_indexed(g, path, TERMS)),
    "connected_nodes": _on_graph(lambda g: q.connected_nodes(g, TERMS, 200)),
    "graph_counts": _on_graph(q.graph_counts),
    "source_documents": _on_graph(q.source_documents),
    "company_universe": _on_graph(q.company_universe),
    "frequent_entities": _on_graph(lambda g: q.frequent_entities(g, 200)),
    "company_options": _on_graph(q.company_options),
    "ontology_edges": _on_graph(lambda g: q.ontology_relations(g, TERMS, "", 500)),
    "ontology_edges_company": _on_graph(lambda g: q.ontology_relations(g, [], TICKER, 1000)),
    "ontology_edge_count": _on_graph(lambda g: q.ontology_relation_count(g, TERMS)),
    "ontology_schema_closure": _on_graph(q.schema_closure),
    "concept_ancestors": _on_graph(q.ancestors),
    "concept_options": _on_graph(q.concept_options),
    "concept_context": _on_graph(lambda g: q.concept_context(g, CONCEPT)),
    "concept_chunks": _on_graph(lambda g: q.concept_chunks(g, CONCEPT, 200)),
    "tool_deep_dive": _on_graph(lambda g: q.company_deep_dive(g, COMPANY_TERMS, TOPIC_TERMS)),
    "tool_positive_demand": _on_graph(lambda g: q.category_signals(g, CATEGORY, DEMAND)),
    "tool_risks": _on_graph(lambda g: q.category_signals(g, RISK_CATEGORY, RISK)),
    "tool_product_map": _on_graph(lambda g: q.category_signals(g, PRODUCT, PRODUCT_SIGNAL)),
    "insight_rank": _on_graph(_rank),
    "answer_summary": _on_graph(_answer),
    "relation_signal": _on_graph(_signal),
    "company_balanced_rows": _on_graph(_balanced),
    "related_to_projection": _on_graph(q.related_to),
    "mentions_entity": _on_graph(lambda g: g.mentions()),
    "payload_nodes": _on_graph(lambda g: p.payload(_payload_rows(g))[0]),
    "payload_edges": _on_graph(lambda g: p.payload(_payload_rows(g))[1]),
    "node_degree": _on_graph(lambda g: p.node_degree(p.payload(_payload_rows(g))[1]).withColumn("size", p.display_size())),
    "min_degree_filter": _on_graph(lambda g: p.min_degree(*p.payload(_payload_rows(g)), 3)[1]),
    "company_context_edges": _on_graph(lambda g: p.company_context(*p.payload(_payload_rows(g)), "Nation")[1].filter("layer = 'company_scope'")),
    "edge_table": _on_graph(lambda g: p.edge_table(*p.payload(_payload_rows(g)))),
}

_STATS = """, st AS (SELECT node, count(DISTINCT ends.id) AS relation_count, count(DISTINCT CASE WHEN layer = 'insight' THEN ends.id END) AS insight_count, count(DISTINCT company_id) AS company_count, count(DISTINCT ev.chunk_id) AS evidence_count,
   CAST(sum(coalesce(conf100, 0)) AS DOUBLE) / count(*) / 100.0 AS avg_confidence FROM ends LEFT JOIN ev ON ends.chunk_id = ev.chunk_id GROUP BY node)"""
_WEIGHT = "CASE entity_type WHEN 'Theme' THEN 8 WHEN 'MetricValue' THEN 8 WHEN 'Metric' THEN 7 WHEN 'BusinessOutcome' THEN 7 WHEN 'Risk' THEN 7 WHEN 'Product' THEN 6 WHEN 'BusinessSegment' THEN 5 ELSE 1 END"
_SEARCH_COLUMNS = f"{ROW}, source_url, source_concepts, target_concepts, matched_terms, chunk_text"
_CLI = f""", c AS (SELECT rel.*, list_filter({TERMS}::VARCHAR[], lambda t: contains(lower(concat_ws(chr(1), source, target, evidence, relation)), t)) AS matched FROM rel),
   cli AS (SELECT *, array_to_string(list_sort(matched), '|') AS matched_terms, len(matched) AS n_matched FROM c WHERE len(matched) > 0)"""
_SHOWN = PRELUDE + searched(TERMS)
_TOP400 = _SHOWN + f", top AS (SELECT * FROM shown ORDER BY {SEARCH_ORDER} LIMIT 400)"
_AGENT = PRELUDE + searched([]) + """, agent AS (SELECT *, coalesce(source, '') || ' -' || relation || '-> ' || coalesce(target, '') AS graph_reasoning_path, coalesce(chunk_text, evidence) AS referenced_chunk, '' AS none,
   lower(concat_ws(chr(1), source, target, evidence, relation)) AS own, lower(source_concepts || chr(1) || target_concepts) AS con FROM shown WHERE coalesce(evidence, '') <> '')"""
_AGENT_COLUMNS = f"{ROW}, source_url, source_concepts, target_concepts, matched_terms, chunk_text, graph_reasoning_path, referenced_chunk"


def _any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _category(category: list[str], signal: list[str]) -> str:
    return (
        _AGENT
        + f"""SELECT {_AGENT_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY coalesce(confidence, 0) DESC, fact_id) AS rn FROM agent
      WHERE company IS NOT NULL AND ({_any("own", category)} OR {_any("con", category)}) AND {_any("own", signal)}) WHERE rn <= 2 ORDER BY company, rn LIMIT 50"""
    )


def _ontology(terms: list[str], limit: int, ticker: str = "") -> str:
    scope = f"AND ticker = '{ticker}'" if ticker else ""
    near = (
        """, used AS (SELECT source_id AS id FROM pairs UNION SELECT target_id FROM pairs), reach(id, hop) AS (SELECT id, 0 FROM used UNION SELECT target_id, hop + 1 FROM reach JOIN sedge ON id = source_id WHERE hop < 4)"""
        if ticker
        else ""
    )
    inside = "WHERE source_id IN (SELECT id FROM reach) AND target_id IN (SELECT id FROM reach)" if ticker else ""
    return (
        PRELUDE
        + searched(terms)
        + f""", pairs AS (SELECT a.concept_id AS source_id, b.concept_id AS target_id, shown.relation AS relation_type, fact_id, chunk_id, confidence, company FROM shown JOIN maps a ON shown.source_id = a.entity_id JOIN maps b ON shown.target_id = b.entity_id WHERE a.concept_id <> b.concept_id {scope}){near},
   both_kinds AS (SELECT source_id, relation_type, target_id, count(DISTINCT fact_id) AS fact_count, count(DISTINCT chunk_id) AS evidence_count, CAST(sum(CAST(round(coalesce(confidence, 0) * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS confidence, coalesce(string_agg(DISTINCT company, '|' ORDER BY company), '') AS company, 'ontology' AS relation_layer FROM pairs GROUP BY ALL
     UNION ALL SELECT DISTINCT source_id, relation_type, target_id, 0, 0, CAST(NULL AS DOUBLE), '', 'ontology_schema' FROM sedge {inside})
   SELECT source_id, relation_type, target_id, fact_count, evidence_count, confidence, company, relation_layer, s.name AS source, s.concept_type AS source_type, t.name AS target, t.concept_type AS target_type, 'ontology-' || source_id || '-' || relation_type || '-' || target_id AS fact_id
   FROM both_kinds JOIN concept s ON source_id = s.id JOIN concept t ON target_id = t.id
   ORDER BY CASE WHEN relation_layer <> 'ontology_schema' THEN 0 WHEN relation_type IN ('IS_A', 'PART_OF') THEN 2 ELSE 1 END DESC, fact_count DESC, evidence_count DESC, coalesce(confidence, 0) DESC, source, relation_type, target, fact_id, relation_layer LIMIT {limit}"""
    )


_EDGES = "SELECT fact_id AS id, any_value(source_id) AS source, any_value(target_id) AS target, any_value(relation) AS label, any_value(relation_layer) AS layer FROM top GROUP BY fact_id"
_NODES = "SELECT id, max_by(label, (fact_id, e)) AS label, max_by(type, (fact_id, e)) AS type, any_value(value) AS value, any_value(context) AS context FROM (SELECT source_id AS id, fact_id, 0 AS e, source AS label, source_type AS type, source_value AS value, source_context AS context FROM top UNION ALL SELECT target_id, fact_id, 1, target, target_type, target_value, target_context FROM top) GROUP BY id"
_DEGREE = f", edges AS ({_EDGES}), deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"

ORACLE_SQL: dict[str, str] = {
    "key_nodes": PRELUDE + _STATS + f"""SELECT id AS node_id, name, entity_type, value, context, relation_count, insight_count, company_count, evidence_count, avg_confidence, insight_count * 6 + relation_count + company_count * 3 + evidence_count + {_WEIGHT} + avg_confidence AS score
      FROM entity JOIN st ON id = node WHERE coalesce(entity_type, '') <> 'Company' ORDER BY score DESC, insight_count DESC, company_count DESC, relation_count DESC, name, id LIMIT 300""",
    "key_nodes_extended": PRELUDE + _STATS + f"""SELECT id AS node_id, name, entity_type, value, context, relation_count, insight_count, company_count, evidence_count, avg_confidence, coalesce(concepts, '') AS concepts,
      insight_count * 6 + relation_count + company_count * 3 + evidence_count + {_WEIGHT} + CASE WHEN value IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN context IS NOT NULL THEN 1 ELSE 0 END + 2 * coalesce(len(string_split(concepts, '|')), 0) + avg_confidence AS score
      FROM entity JOIN st ON id = node LEFT JOIN ec ON id = entity_id WHERE coalesce(entity_type, '') <> 'Company' ORDER BY score DESC, insight_count DESC, company_count DESC, relation_count DESC, name, id LIMIT 300""",
    "read_relations": PRELUDE + f"SELECT {ROW} FROM rel WHERE contains(lower(source), 'widget') OR contains(lower(target), 'widget') OR contains(lower(evidence), 'widget') OR contains(lower(relation), 'widget') OR contains(lower(chunk_preview), 'widget') ORDER BY document_id NULLS LAST, company NULLS LAST, source, relation, target, fact_id LIMIT 500",
    "question_context": PRELUDE + f"SELECT {ROW}, title, source_url, entity.id AS node_id, entity.name AS node_name FROM entity JOIN rel ON entity.id = source_id OR entity.id = target_id WHERE entity.id = {NODE} ORDER BY (relation_layer = 'insight') DESC, confidence DESC NULLS FIRST, company NULLS LAST, source, relation, target, fact_id LIMIT 50",
    "node_context": PRELUDE + searched([]) + f"SELECT {ROW}, source_concepts, target_concepts, chunk_text, {NODE} AS node_id FROM shown WHERE source_id = {NODE} OR target_id = {NODE} ORDER BY (relation_layer = 'insight') DESC, coalesce(confidence, 0) DESC, company NULLS LAST, source, relation, target, fact_id LIMIT 50",
    "relation_search_cli": PRELUDE + _CLI + f"SELECT {ROW}, matched_terms, source_url FROM cli ORDER BY {SEARCH_ORDER} LIMIT 100",
    "relation_search": _SHOWN + f"SELECT {_SEARCH_COLUMNS} FROM shown ORDER BY {SEARCH_ORDER} LIMIT 300",
    "relation_search_company": _SHOWN + f"SELECT {_SEARCH_COLUMNS} FROM shown WHERE ticker = '{TICKER}' ORDER BY {SEARCH_ORDER} LIMIT 300",
    "relation_balanced": _SHOWN + f"SELECT {_SEARCH_COLUMNS}, rank FROM (SELECT *, coalesce(company, 'Unknown') AS bucket, row_number() OVER (PARTITION BY coalesce(company, 'Unknown') ORDER BY {SEARCH_ORDER}) AS rank FROM shown) ORDER BY rank, bucket LIMIT 250",
    "relation_count": _SHOWN + "SELECT count(DISTINCT fact_id) AS count FROM shown",
    "relation_count_company": _SHOWN + f"SELECT count(DISTINCT fact_id) AS count FROM shown WHERE ticker = '{TICKER}'",
    "connected_nodes": _SHOWN + f""", e2 AS (SELECT *, source_id AS n FROM shown WHERE chunk_id IS NOT NULL UNION ALL SELECT *, target_id AS n FROM shown WHERE chunk_id IS NOT NULL),
      dg AS (SELECT company_id AS cid, n, count(DISTINCT fact_id) AS node_degree, count(DISTINCT chunk_id) AS evidence_count FROM e2 GROUP BY ALL),
      tn AS (SELECT * FROM (SELECT cid, n, name, entity_type, node_degree, evidence_count, row_number() OVER (PARTITION BY cid ORDER BY node_degree DESC, evidence_count DESC, lower(name), n) AS rk FROM dg JOIN entity ON n = entity.id WHERE coalesce(entity_type, '') <> 'Company') WHERE rk <= 3),
      pick AS (SELECT *, row_number() OVER (PARTITION BY tn.cid, tn.n ORDER BY (relation_layer = 'insight') DESC, coalesce(confidence, 0) DESC, source, relation, target, fact_id) AS rk2, tn.n AS fn FROM tn JOIN e2 ON tn.cid = e2.company_id AND tn.n = e2.n)
      SELECT {_SEARCH_COLUMNS}, fn AS focus_node_id, name AS focus_node, entity_type AS focus_node_type, node_degree, evidence_count FROM pick WHERE rk2 <= 2 AND coalesce(chunk_text, '') <> '' ORDER BY company, node_degree DESC, evidence_count DESC, source, relation, target, fn, fact_id LIMIT 200""",
    "graph_counts": PRELUDE + """SELECT * FROM (SELECT 'Company' AS label, count(*) AS count FROM company UNION ALL SELECT 'EarningsCall', count(*) FROM call UNION ALL SELECT 'SourceDocument', count(*) FROM doc UNION ALL SELECT 'MarkdownChunk', count(*) FROM chunk UNION ALL SELECT 'Entity', count(*) FROM entity
      UNION ALL SELECT 'RelationFact', count(*) FROM fact UNION ALL SELECT 'OntologyConcept', count(*) FROM concept UNION ALL SELECT 'FiscalPeriod', count(DISTINCT fiscal_quarter) FROM call UNION ALL SELECT 'Quarter', count(DISTINCT regexp_extract(fiscal_quarter, 'Q[1-4]')) FROM call) WHERE count > 0""",
    "source_documents": PRELUDE + "SELECT company.name AS company, ticker, doc.id AS document, source_url, count(DISTINCT chunk.id) AS chunks, count(fact.id) AS relations FROM doc JOIN company ON company_id = company.id LEFT JOIN chunk ON document_id = doc.id LEFT JOIN fact ON chunk_id = chunk.id GROUP BY ALL",
    "company_universe": PRELUDE + """SELECT name AS company, ticker, (SELECT coalesce(string_agg(DISTINCT fiscal_quarter, '|' ORDER BY fiscal_quarter), '') FROM call WHERE company_id = company.id) AS fiscal_periods, (SELECT count(*) FROM doc WHERE company_id = company.id) AS source_documents,
      (SELECT count(*) FROM ev WHERE ev.company_id = company.id) AS chunks, (SELECT count(*) FROM fact JOIN ev ON fact.chunk_id = ev.chunk_id WHERE ev.company_id = company.id) AS relation_facts FROM company ORDER BY name, ticker LIMIT 50""",
    "frequent_entities": PRELUDE + """, m AS (SELECT DISTINCT chunk_id, node FROM ends WHERE chunk_id IS NOT NULL), d AS (SELECT node, count(DISTINCT m.chunk_id) AS a, list_sort(list_distinct(list(company) FILTER (WHERE company IS NOT NULL))) AS cs FROM m LEFT JOIN ev ON m.chunk_id = ev.chunk_id GROUP BY node),
      f AS (SELECT node, count(DISTINCT id) AS b, count(DISTINCT chunk_id) AS c FROM ends GROUP BY node)
      SELECT id, name AS entity, entity_type, coalesce(a, 0) AS direct_chunk_mentions, coalesce(b, 0) AS relation_mentions, coalesce(a, 0) + coalesce(b, 0) AS mention_count, coalesce(len(cs), 0) AS company_count, coalesce(array_to_string(cs[1:6], '|'), '') AS sample_companies, coalesce(a, 0) + coalesce(c, 0) AS evidence_count, coalesce(array_to_string(string_split(concepts, '|')[1:6], '|'), '') AS concepts
      FROM entity LEFT JOIN d ON id = d.node LEFT JOIN f ON id = f.node LEFT JOIN ec ON id = entity_id WHERE coalesce(entity_type, '') <> 'Company' AND coalesce(a, 0) + coalesce(b, 0) > 0 ORDER BY mention_count DESC, company_count DESC, evidence_count DESC, entity, id LIMIT 200""",
    "company_options": PRELUDE + "SELECT company.name AS company, ticker, fiscal_quarter AS quarter, count(DISTINCT doc.id) AS documents FROM company JOIN call ON call.company_id = company.id JOIN doc ON doc.company_id = company.id GROUP BY ALL",
    "ontology_edges": _ontology(TERMS, 500),
    "ontology_edges_company": _ontology([], 1000, TICKER),
    "ontology_edge_count": f"SELECT count(*) AS count FROM ({_ontology(TERMS, q.COUNT_CAP)})",
    "ontology_schema_closure": PRELUDE + ", reach(concept_id, reached_id, hop) AS (SELECT id, id, 0 FROM concept UNION SELECT concept_id, target_id, hop + 1 FROM reach JOIN sedge ON reached_id = source_id WHERE hop < 4) SELECT DISTINCT concept_id, reached_id FROM reach",
    "concept_ancestors": PRELUDE + """, up AS (SELECT * FROM sedge WHERE relation_type IN ('IS_A', 'PART_OF')),
      walk(concept_id, reached_id, hops, path) AS (SELECT id, id, 0, '' FROM concept UNION SELECT concept_id, target_id, hops + 1, CASE path WHEN '' THEN '' ELSE path || ' > ' END || relation_type || ' ' || target_id FROM walk JOIN up ON reached_id = source_id WHERE hops < 9)
      SELECT concept_id, reached_id, hops, path FROM walk QUALIFY row_number() OVER (PARTITION BY concept_id, reached_id ORDER BY hops, path) = 1""",
    "concept_options": PRELUDE + "SELECT id AS concept_id, name, concept_type, description, (SELECT count(DISTINCT entity_id) FROM maps WHERE concept_id = concept.id) AS mapped_entities, (SELECT count(DISTINCT target_id) FROM sedge WHERE source_id = concept.id) + (SELECT count(DISTINCT source_id) FROM sedge WHERE target_id = concept.id) AS linked_concepts FROM concept",
    "concept_context": PRELUDE + f""", top AS (SELECT id, name FROM entity WHERE id IN (SELECT entity_id FROM maps WHERE concept_id = {CONCEPT}) ORDER BY name, id LIMIT 10),
      rt AS (SELECT relation_type, count(DISTINCT id) AS n FROM ends WHERE node IN (SELECT id FROM top) GROUP BY 1)
      SELECT id AS concept_id, name, concept_type, description, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT 'out ' || relation_type || ' ' || c2.name AS x FROM sedge JOIN concept c2 ON target_id = c2.id WHERE source_id = {CONCEPT} UNION SELECT 'in ' || relation_type || ' ' || c2.name FROM sedge JOIN concept c2 ON source_id = c2.id WHERE target_id = {CONCEPT})) AS linked_concepts,
      (SELECT string_agg(name || ' ' || id, '|' ORDER BY name || ' ' || id) FROM top) AS entities, (SELECT string_agg(relation_type || ' ' || n, '|' ORDER BY relation_type || ' ' || n) FROM rt) AS relations FROM concept WHERE id = {CONCEPT}""",
    "concept_chunks": PRELUDE + f""", idx AS (SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY day, id) AS i FROM chunk),
      per AS (SELECT chunk_id, list_sort(list(DISTINCT name))[1:6] AS es, list_sort(list(DISTINCT relation_type))[1:6] AS rs, count(DISTINCT ends.id) AS relation_count FROM ends JOIN entity ON node = entity.id WHERE chunk_id IS NOT NULL AND node IN (SELECT entity_id FROM maps WHERE concept_id = {CONCEPT}) GROUP BY chunk_id)
      SELECT {CONCEPT} AS concept_id, per.chunk_id, i AS chunk_index, chunk_text, document_id, company, ticker, array_to_string(es, '|') AS matched_entities, array_to_string(rs, '|') AS relation_types, relation_count FROM per JOIN ev ON per.chunk_id = ev.chunk_id JOIN idx ON per.chunk_id = idx.id ORDER BY relation_count DESC, company, document_id, i, per.chunk_id LIMIT 200""",
    "tool_deep_dive": _AGENT + f"SELECT {_AGENT_COLUMNS} FROM agent WHERE {_any('lower(concat_ws(chr(1), company, ticker))', COMPANY_TERMS)} AND {_any('own', TOPIC_TERMS)} ORDER BY coalesce(confidence, 0) DESC, fact_id LIMIT 25",
    "tool_positive_demand": _category(CATEGORY, DEMAND),
    "tool_risks": _category(RISK_CATEGORY, RISK),
    "tool_product_map": _category(PRODUCT, PRODUCT_SIGNAL),
    "insight_rank": PRELUDE + _CLI + f""", top AS (SELECT * FROM cli ORDER BY {SEARCH_ORDER} LIMIT 500), r AS (SELECT *, len(list_filter({TERMS}::VARCHAR[], lambda t: contains(lower(concat_ws(' ', source, target, evidence, relation)), t))) AS relevance FROM top)
      SELECT fact_id, relevance, -(4 * relevance + CASE source_type WHEN 'MetricValue' THEN 4 WHEN 'BusinessOutcome' THEN 2 ELSE 0 END + CASE target_type WHEN 'MetricValue' THEN 4 WHEN 'BusinessOutcome' THEN 2 ELSE 0 END + CASE WHEN coalesce(source_value, source_context, target_value, target_context) IS NOT NULL THEN 2 ELSE 0 END
        + CASE WHEN relation IN ('DRIVES', 'PRESSURES', 'CONVERTS_TO', 'GUIDES_TO', 'OFFSETS', 'INCREASES') THEN 2 ELSE 0 END + CASE WHEN relation_layer = 'insight' THEN 6 ELSE 0 END) AS insight_rank FROM r ORDER BY insight_rank, relevance DESC, fact_id LIMIT 100""",
    "relation_signal": PRELUDE + "SELECT CASE WHEN relation_type IN ('DRIVES', 'INCREASES', 'OFFSETS', 'GUIDES_TO', 'CONVERTS_TO') THEN 'support' WHEN relation_type IN ('PRESSURES', 'RISKS', 'CONSTRAINS', 'EXPOSED_TO', 'REDUCES', 'AFFECTS') THEN 'risk' ELSE 'neutral' END AS signal, count(*) AS facts FROM fact GROUP BY 1",
    "company_balanced_rows": _SHOWN + f"SELECT company, fact_id, rank FROM (SELECT company, fact_id, row_number() OVER (PARTITION BY company ORDER BY fact_id) AS rank FROM (SELECT * FROM shown ORDER BY {SEARCH_ORDER} LIMIT 200)) WHERE rank <= 3",
    "related_to_projection": PRELUDE + "SELECT from_id, relation_type, to_id, conf100 / 100.0 AS latest_confidence FROM fact QUALIFY row_number() OVER (PARTITION BY from_id, relation_type, to_id ORDER BY id DESC, conf100 DESC NULLS LAST) = 1",
    "mentions_entity": PRELUDE + "SELECT DISTINCT chunk_id, node AS entity_id FROM ends WHERE chunk_id IS NOT NULL",
    "payload_nodes": _TOP400 + _NODES,
    "payload_edges": _TOP400 + _EDGES,
    "node_degree": _TOP400 + _DEGREE + "SELECT id, degree, least(42, 18 + 5 * degree) AS size FROM deg",
    "min_degree_filter": _TOP400 + _DEGREE + "SELECT * FROM edges WHERE source IN (SELECT id FROM deg WHERE degree >= 3) AND target IN (SELECT id FROM deg WHERE degree >= 3)",
    "company_context_edges": _TOP400 + f", edges AS ({_EDGES}), f AS (SELECT n, min((id, e)) AS place FROM (SELECT source AS n, id, 0 AS e FROM edges UNION ALL SELECT target, id, 1 FROM edges) GROUP BY n ORDER BY place LIMIT 24) SELECT 'company-nation-' || n AS id, 'company-nation' AS source, CAST(n AS VARCHAR) AS target, 'HAS_CONTEXT' AS label, 'company_scope' AS layer FROM f",
    "edge_table": _TOP400 + f", edges AS ({_EDGES}), nodes AS ({_NODES}) SELECT edges.*, a.label AS source_label, b.label AS target_label FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id",
}
#: Postings change what is read, not what is found.
ORACLE_SQL |= {f"{name}_indexed": ORACLE_SQL[name] for name in ("relation_search", "relation_count")}
