"""From a question to rows and an answer: a registry of tools, and generated SQL with repairs where no tool fits.

A language model is a function from a prompt to a text; without one, only the
fixed tools answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..sources.star import Graph
from . import graph_queries as q
from . import rendering
from .questions import SQL_MAX_ROWS, error_kind, guard_sql, query_terms, route_with, run_guarded

Model = Callable[[str], str]
#: How often generated SQL may be repaired after an error.
REPAIRS = 2


@dataclass(frozen=True)
class Tool:
    """``rows`` gives None where the question lacks what the tool needs."""

    title: str
    when: str
    across: bool  # whether it compares companies
    example: str
    rows: Callable[[Graph, str, int], DataFrame | None]


@dataclass
class Outcome:
    """What a question led to; ``rows`` are a DataFrame of a fixed tool, or the bounded rows of generated SQL."""

    tool: str | None
    rows: DataFrame | list[Row]
    sql: str = ""
    warnings: list[str] = field(default_factory=list)
    attempts: int = 0


def companies_named(g: Graph, question: str, most: int = 5) -> list[str]:
    """Lower-case names and tickers of the companies that a question names."""
    low = F.lit(question.lower())
    words = sorted(set(re.findall(r"[a-z0-9.]+", question.lower())))
    hit = (F.length("name") > 1) & low.contains(F.lower("name")) | F.lower("ticker").isin(*words or [""])
    found = g.companies.filter(hit).select("name", "ticker").orderBy("name", "ticker").limit(most).collect()
    return sorted({x.lower() for r in found for x in (r["name"], r["ticker"]) if x})


def _deep_dive(g: Graph, question: str, limit: int) -> DataFrame | None:
    who = companies_named(g, question)
    named = {w for c in who for w in c.split()}
    topic = [t for t in query_terms(question) if t not in named] or [""]
    return q.company_deep_dive(g, who, topic, limit) if who else None


def _signals(name: str) -> Callable[[Graph, str, int], DataFrame]:
    return lambda g, _, limit: q.category_signals(g, *map(list, fixed.TOOL_TERMS[name]), limit=limit)


TOOLS: dict[str, Tool] = {
    "company_ai_deep_dive": Tool("One company on a topic", "a question names one company", False, "What does Nvidia say about data center demand?", _deep_dive),
    "product_category_evidence_map": Tool("Products by company", "a question is about a product or a category", True, "Map the evidence on networking by company", _signals("product_category_evidence_map")),
    "ai_risks_constraints_by_company": Tool("Risks by company", "a question is about risks, limits or shortages", True, "Which risks do companies report?", _signals("ai_risks_constraints_by_company")),
    "ai_positive_demand_by_company": Tool("Demand by company", "a question is about growing demand", True, "Where are positive demand signals?", _signals("ai_positive_demand_by_company")),
    "frequent_entities": Tool("Most mentioned entities", "a question asks what is mentioned most", False, "What are the top entities?", lambda g, _, limit: q.frequent_entities(g, limit)),
    "loaded_company_universe": Tool("Companies of the graph", "a question asks which companies are there", False, "Which companies are loaded?", lambda g, _, limit: q.company_universe(g, limit)),
}


def router_prompt(question: str) -> str:
    """What a model is asked that is to name a tool; the first that fits, as they stand from narrow to wide."""
    lines = [f"- {name}: {t.title}; when {t.when}" for name, t in TOOLS.items()]
    return "\n".join(["Answer with the name of one tool, the first that fits.", *lines, f"Question: {question}"])


def views(g: Graph) -> str:
    """Make the graph's tables views of their session and describe them, from their schemas."""
    lines = []
    for name, df in vars(g).items():
        df.createOrReplaceTempView(name)
        lines.append(f"{name}({', '.join(f'{c} {t}' for c, t in df.dtypes)})")
    return "\n".join(lines)


def sql_prompt(question: str, schema: str, most: int = SQL_MAX_ROWS) -> str:
    return f"Write one Spark SQL query that reads the tables below. It must end in LIMIT {most} or less, without comments.\n\n{schema}\n\nQuestion: {question}"


def repair_prompt(question: str, schema: str, sql: str, problem: str, most: int = SQL_MAX_ROWS) -> str:
    return f"{sql_prompt(question, schema, most)}\n\nThis query was tried:\n{sql}\n\nIts problem: {problem}\nWrite a corrected query."


def _company(r: Row) -> str | None:
    return next((str(r[k]) for k in ("company", "ticker") if k in r and r[k]), None)


def balanced(rows: list[Row], each: int = 2) -> list[Row]:
    """At most ``each`` rows of a company, in order; rows without one come last, all of them."""
    seen: dict[str, int] = {}
    kept = []
    for r in rows:
        name = _company(r)
        if name is not None:
            seen[name] = seen.get(name, 0) + 1
            if seen[name] <= each:
                kept.append(r)
    return kept + [r for r in rows if _company(r) is None]


def generated(g: Graph, question: str, model: Model, across: bool = False, most: int = SQL_MAX_ROWS, timeout: float = 30.0, repairs: int = REPAIRS) -> Outcome:
    """Rows of SQL that the model writes: guarded, run, and after an error written again with the error at hand.

    A question across companies whose rows name fewer than two of them gets one more
    try, which counts if it names more.  A timeout isn't repaired; it is raised.
    """
    spark, schema = g.facts.sparkSession, views(g)
    prompt, tried, best = sql_prompt(question, schema, most), 0, None
    spread = across
    while True:
        sql = model(prompt)
        tried += 1
        try:
            safe, warnings = guard_sql(spark, sql, most, vars(g))
            rows = run_guarded(spark, safe, most, timeout, vars(g))
        except Exception as e:
            if error_kind(e) == "timeout" and best is None:
                raise
            if best is not None:
                return best
            if tried > repairs:
                raise ValueError(f"no query for this question could be run: {str(e)[:300]}") from e
            prompt = repair_prompt(question, schema, sql, str(e)[:1000], most)
            continue
        now = Outcome(None, balanced(rows) if across else rows, safe, warnings, tried)
        if best is not None:
            now = max(best, now, key=lambda o: len({_company(r) for r in o.rows} - {None}))
        if spread and len({_company(r) for r in now.rows} - {None}) < 2:
            spread, best = False, now
            prompt = repair_prompt(question, schema, safe, "its rows name fewer than two companies", most)
            continue
        return now


def run_tool(g: Graph, question: str, tool: str | None = None, model: Model | None = None, router: Model | None = None, limit: int = 50, timeout: float = 30.0) -> Outcome:
    """The tool that a question calls for, or the one named: fixed rows first, generated SQL where there are none to give.

    ``router`` picks a tool where keywords don't; ``model`` writes SQL.  A query that
    takes too long falls back on the fixed rows of its tool, if there are any.
    """
    name = tool or route_with(question, (lambda x: router(router_prompt(x)).strip()) if router else None)
    if name is not None and name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}")
    limit = q.clamp_limit(limit)
    known = TOOLS.get(name) if name else None
    rows = known.rows(g, question, limit) if known else None
    if rows is not None and not (model and rows.isEmpty()):
        return Outcome(name, rows)
    if model is None:
        return Outcome(name, q.relation_search(g, query_terms(question), limit))
    try:
        out = generated(g, question, model, bool(known and known.across), min(limit, SQL_MAX_ROWS), timeout)
    except TimeoutError as e:
        if rows is None:
            raise
        return Outcome(name, rows, warnings=[str(e)])
    out.tool = name
    return out


def respond(g: Graph, question: str, tool: str | None = None, model: Model | None = None, router: Model | None = None, limit: int = 50, summarise: bool = False) -> str:
    """A Markdown answer to a question; with ``summarise`` the model writes it from the rows, without gap sections and signal columns."""
    out = run_tool(g, question, tool, model, router, limit)
    if isinstance(out.rows, list):
        plain = rendering.plain_answer([r.asDict() for r in out.rows])
    elif out.tool == "frequent_entities":
        plain = rendering.entities_answer(out.rows)
    elif out.tool == "loaded_company_universe":
        plain = rendering.plain_answer([r.asDict() for r in out.rows.collect()])  # at most the limit
    else:
        rows = out.rows if "graph_reasoning_path" in out.rows.columns else q.with_paths(out.rows)
        plain = rendering.tool_answer(rows, out.tool or "")
    if not (summarise and model):
        return plain
    text = model(f"Answer the question from the evidence only.\nQuestion: {question}\n\nEvidence:\n{plain}")
    return rendering.without_columns(rendering.without_sections(text)) or plain
