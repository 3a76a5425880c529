"""The conformance graph as SQL for DuckDB: common table expressions that every oracle starts with."""

PRELUDE = """
WITH RECURSIVE company AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'T' || n_nationkey AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey),
doc AS (SELECT c_custkey AS id, c_name AS title, 'https://filings.example/' || c_custkey AS source_url, CAST(c_nationkey AS BIGINT) AS company_id FROM customer),
call AS (SELECT company_id * 100000 + y * 10 + q AS id, company_id, 'FY' || y || ' Q' || q AS fiscal_quarter FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS company_id, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders JOIN customer ON o_custkey = c_custkey)),
chunk AS (SELECT o_orderkey AS id, o_custkey AS document_id, o_orderpriority AS heading, 'Order ' || o_orderkey || ' priority ' || o_orderpriority || ' status ' || o_orderstatus || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS text, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
entity AS (SELECT p_partkey * 2 AS id, p_name AS name, p_name || ' ' || p_partkey AS canonical_name,
  CASE p_type WHEN 'ECONOMY' THEN 'Theme' WHEN 'MEDIUM' THEN 'Metric' WHEN 'STANDARD' THEN 'Product' WHEN 'SMALL' THEN 'Risk' WHEN 'LARGE' THEN 'MetricValue' WHEN 'PROMO' THEN 'BusinessOutcome' END AS entity_type,
  CASE WHEN p_type = 'LARGE' THEN 'size ' || p_size END AS value, CASE WHEN p_type = 'SMALL' THEN 'context ' || p_brand END AS context FROM part
  UNION ALL SELECT s_suppkey * 2 + 1, s_name, lower(s_name), CASE WHEN s_suppkey % 10 = 0 THEN 'Company' ELSE 'BusinessSegment' END, NULL, NULL FROM supplier),
fact AS (SELECT 'fact-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey * 2 AS from_id, l_suppkey * 2 + 1 AS to_id,
  CASE l_returnflag WHEN 'A' THEN 'DRIVES' WHEN 'N' THEN 'PRESSURES' WHEN 'R' THEN 'DISCUSSES' END AS relation_type, CASE WHEN l_linestatus = 'O' THEN 'insight' END AS layer,
  CASE WHEN l_tax <> 0 THEN 100 - CAST(round(l_discount * 100) AS BIGINT) END AS conf100,
  CASE WHEN l_linestatus = 'O' THEN 'open demand' ELSE 'filled supply' END || ' of ' || CAST(l_quantity AS INT) AS evidence_text, CASE WHEN l_quantity <= 45 THEN l_orderkey END AS chunk_id FROM lineitem),
brand AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS n FROM part),
concept AS (SELECT n AS id, 'Brand ' || n AS name, 'Brand' AS concept_type, 'goods of brand ' || n AS description FROM brand
  UNION ALL SELECT DISTINCT n % 5 + 1000, 'Family ' || n % 5, 'Family', 'brand family ' || n % 5 FROM brand
  UNION ALL SELECT r_regionkey + 2000, r_name, 'Region', 'suppliers in ' || r_name FROM region
  UNION ALL SELECT 3000, 'Business domain', 'Root', 'root of the tree'),
maps AS (SELECT p_partkey * 2 AS entity_id, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS BIGINT) AS concept_id FROM part
  UNION ALL SELECT s_suppkey * 2 + 1, n_regionkey + 2000 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sedge AS (SELECT n AS source_id, 'IS_A' AS relation_type, n % 5 + 1000 AS target_id FROM brand
  UNION ALL SELECT DISTINCT n % 5 + 1000, 'IS_A', 3000 FROM brand
  UNION ALL SELECT r_regionkey + 2000, 'PART_OF', 3000 FROM region UNION ALL SELECT r_regionkey + 1000, 'DRIVES_SCHEMA', r_regionkey + 2000 FROM region),
ev AS (SELECT chunk.id AS chunk_id, document_id, text AS chunk_text, doc.title, doc.source_url, company.id AS company_id, company.name AS company, ticker FROM chunk JOIN doc ON document_id = doc.id JOIN company ON company_id = company.id),
ends AS (SELECT fact.*, from_id AS node FROM fact UNION ALL SELECT fact.*, to_id AS node FROM fact),
rel AS (SELECT fact.id AS fact_id, document_id, company, ticker, from_id AS source_id, s.name AS source, s.entity_type AS source_type, relation_type AS relation, coalesce(layer, 'coverage') AS relation_layer, to_id AS target_id, t.name AS target, t.entity_type AS target_type,
  evidence_text AS evidence, conf100 / 100.0 AS confidence, fact.chunk_id AS chunk_id, chunk_text, chunk_text AS chunk_preview, source_url, title, company_id, layer, s.value AS source_value, s.context AS source_context, t.value AS target_value, t.context AS target_context, s.canonical_name AS source_canonical, t.canonical_name AS target_canonical
  FROM fact JOIN entity s ON from_id = s.id JOIN entity t ON to_id = t.id LEFT JOIN ev ON fact.chunk_id = ev.chunk_id),
ec AS (SELECT entity_id, string_agg(DISTINCT name, '|' ORDER BY name) AS concepts, string_agg(DISTINCT lower(name || chr(1) || description), chr(1)) AS text FROM maps JOIN concept ON concept_id = concept.id GROUP BY entity_id)
"""

_ROW = "fact_id, document_id, company, ticker, source_id, source, source_type, relation, relation_layer, target_id, target, target_type, evidence, confidence, chunk_id, chunk_preview, source_value, source_context, target_value, target_context"


def sql_list(terms: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def searched(terms: list[str]) -> str:
    """Facts with the terms that match, as further common table expressions."""
    text = "lower(concat_ws(chr(1), source, source_canonical, source_value, source_context, target, target_canonical, target_value, target_context, evidence, relation)) || chr(1) || coalesce(a.text, '') || chr(1) || coalesce(b.text, '')"
    keep = "WHERE len(matched) > 0" if terms else ""
    return f""", found AS (SELECT * FROM (SELECT rel.*, coalesce(a.concepts, '') AS source_concepts, coalesce(b.concepts, '') AS target_concepts, list_filter({sql_list(terms)}::VARCHAR[], lambda t: contains({text}, t)) AS matched
      FROM rel LEFT JOIN ec a ON source_id = a.entity_id LEFT JOIN ec b ON target_id = b.entity_id) {keep}),
    shown AS (SELECT *, array_to_string(list_sort(matched), '|') AS matched_terms, len(matched) AS n_matched FROM found)"""


SEARCH_ORDER = "(relation_layer = 'insight') DESC, n_matched DESC, coalesce(confidence, 0) DESC, company ASC NULLS LAST, source, relation, target, fact_id"
ROW = _ROW
