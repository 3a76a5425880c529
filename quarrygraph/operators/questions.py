"""Questions: terms, routing to tools, and a guard for generated SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.expressions import contains_any

TOOLS = [r[0] for r in fixed.ROUTES]
SQL_MAX_ROWS = 50
_WORD = r"[A-Za-z0-9$%+.]+|[가-힣]+"


def query_terms(question: str, most: int = 10) -> list[str]:
    """Lower-case words of two characters or more without stop words, plus two fixed phrases."""
    terms = [w for w in (m.lower() for m in re.findall(_WORD, question) if len(m) >= 2) if w not in fixed.QUESTION_STOPWORDS]
    if {"ai", "demand"} <= set(terms):
        terms.append("ai demand")
    if {"cloud", "backlog"} <= set(terms):
        terms.append("backlog")
    return terms[:most]


def query_terms_column(question: Column, most: int = 10) -> Column:
    """The same for a column of questions."""
    found = F.transform(F.regexp_extract_all(question, F.lit(_WORD), F.lit(0)), lambda w: F.lower(w))
    terms = F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*fixed.QUESTION_STOPWORDS))
    add = lambda a, b, x: F.when(F.array_contains(terms, a) & F.array_contains(terms, b), F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(terms, add("ai", "demand", "ai demand"), add("cloud", "backlog", "backlog")), 1, most)


def route(question: str) -> str | None:
    """The first tool whose words occur; None leaves the choice to a language model."""
    low = re.sub(r"\s+", " ", question or "").strip().lower()
    for tool, any_of, and_of in fixed.ROUTES:
        if low and any(t in low for t in any_of) and (not and_of or any(t in low for t in and_of)):
            return tool
    return None


def route_column(question: Column) -> Column:
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " ")))
    out = F.lit(None).cast("string")
    for tool, any_of, and_of in reversed(fixed.ROUTES):
        hit = contains_any(low, list(any_of))
        out = F.when(hit & contains_any(low, list(and_of)) if and_of else hit, tool).otherwise(out)
    return out


def route_with(question: str, model: Callable[[str], str] | None = None) -> str | None:
    """route(), then a pluggable model; a tool that it makes up is an error."""
    tool = route(question) or (model(question) if model else None)
    if tool is not None and tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}")
    return tool


_LIMIT = re.compile(r"\blimit\s+(\d+)\b", re.IGNORECASE)

#: Nodes of an analysed plan that only read what they are given.
_NODES = set(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias WithCTE CTERelationDef CTERelationRef "
    "Window Generate LocalRelation OneRowRelation LateralJoin Expand Pivot Unpivot UnresolvedHint ResolvedHint ReturnAnswer".split()
)
#: Functions that a query may call: of values, texts, dates, arrays and maps, and aggregates; none reads a file, a setting or a clock, or calls code.
_FUNCTIONS = set(
    "abs ceil ceiling floor round bround sqrt pow power exp ln log log10 log2 mod pmod sign greatest least div negative positive "
    "between coalesce nvl nvl2 nullif ifnull if isnull isnotnull when case nanvl isnan "
    "lower upper lcase ucase initcap trim ltrim rtrim btrim length char_length character_length octet_length concat concat_ws substring substr substring_index left right lpad rpad replace translate "
    "repeat reverse split split_part instr locate position contains startswith endswith like ilike rlike regexp regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count ascii char chr format_number levenshtein soundex "
    "md5 sha sha1 sha2 crc32 hash xxhash64 hex unhex "
    "cast int bigint double float string boolean date timestamp decimal to_date to_timestamp to_number date_format year quarter month day dayofmonth dayofweek weekofyear datediff date_diff date_add date_sub add_months months_between last_day trunc date_trunc make_date extract date_part "
    "array array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_size array_sort array_union arrays_overlap arrays_zip cardinality element_at exists explode explode_outer "
    "posexplode posexplode_outer inline inline_outer filter flatten forall get size slice sort_array transform aggregate reduce zip_with map map_keys map_values map_entries map_from_entries map_contains_key struct named_struct "
    "count sum avg mean min max min_by max_by any some every bool_and bool_or count_if first first_value last last_value collect_list collect_set array_agg listagg string_agg stddev stddev_samp stddev_pop variance var_samp var_pop corr "
    "covar_pop covar_samp skewness kurtosis median percentile percentile_approx approx_count_distinct mode any_value grouping grouping_id "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value".split()
)


def _members(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(node, parents: bool = True):
    """All nodes of a plan with their expressions and subqueries, from the root on; ``parents``: also below a view."""
    yield node
    name = node.getClass().getSimpleName()
    if not parents and name == "View":
        return
    below = _members(node.children()) + _members(node.innerChildren())
    if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "DynamicPruningSubquery", "InSubqueryExec"):
        below.append(node.plan())
    if _is_plan(node):
        below += _members(node.expressions())
    seen = set()
    for one in below:
        key = one.hashCode(), one.getClass().getSimpleName()
        if _is_node(one) and (key not in seen or _is_plan(one)):
            seen.add(key)
            yield from _walk(one, parents)


def _is_node(x) -> bool:
    return _is_a(x, "org.apache.spark.sql.catalyst.trees.TreeNode")


def _is_plan(x) -> bool:
    return _is_a(x, "org.apache.spark.sql.catalyst.plans.QueryPlan")


def _is_a(x, name: str) -> bool:
    kind = x.getClass()
    while kind is not None:
        if kind.getName() == name:
            return True
        kind = kind.getSuperclass()
    return False


def _names_read(plan, allowed: set[str]) -> None:
    """An error if the parsed ``plan`` names a table that isn't allowed, a table function, or a function that isn't listed."""
    nodes = list(_walk(plan))
    ctes = {n.alias().lower() for n in nodes if n.getClass().getSimpleName() == "SubqueryAlias"}
    for n in nodes:
        kind = n.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = [str(p) for p in _members(n.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in allowed | ctes:
                raise ValueError(f"the query must read the graph's tables, not {'.'.join(parts)}")
        elif "TableValuedFunction" in kind or "TVF" in kind:
            raise ValueError("the query must not call table functions")
        elif kind == "UnresolvedFunction":
            parts = [str(p) for p in _members(n.nameParts())]
            if len(parts) != 1 or parts[0].lower() not in _FUNCTIONS:
                raise ValueError(f"the query must not call {'.'.join(parts)}")
        elif re.search(r"ScriptTransformation|Insert|Create|Drop|Delete|Update|Merge|Alter|Command|Truncate|Cache|Grant|Revoke|Python|Parameter|VariableReference|SetVariable|Sample|Identifier(?:Clause|Placeholder)", kind):
            raise ValueError(f"the query must only read, not {kind}")


def _only_reads(plan, allowed: set[str]) -> None:
    """An error unless every leaf of the analysed ``plan`` is one of the views or a row of literals, and every expression is a sure one."""
    for n in _walk(plan, parents=False):
        kind = n.getClass().getSimpleName()
        if _is_plan(n):
            if kind == "View":
                name = n.desc().identifier()
                if not n.isTempView() or name.table().lower() not in allowed:
                    raise ValueError(f"the query must read the graph's tables, not {name.table()}")
            elif kind not in _NODES:
                raise ValueError(f"the query must only read, not {kind}")
        elif not n.deterministic():
            raise ValueError(f"the query must not use {n.prettyName()}")
        elif re.search(r"Reflection|ScalaUDF|PythonUDF|InputFile|SparkPartition|Monoton|CurrentUser|CurrentCatalog|CurrentDatabase|SparkVersion|Invoke|HiveSimpleUDF|HiveGenericUDF|UserDefined", kind):
            raise ValueError(f"the query must not use {n.prettyName()}")


def guard_sql(spark: SparkSession, sql: str, most: int = SQL_MAX_ROWS, views: Collection[str] = ()) -> tuple[str, list[str]]:
    """(safe SQL, warnings): one read-only query of ``views`` with a LIMIT, capped at ``most`` rows; else ValueError.

    Spark's own parser decides what the text is.  Names of tables and functions are checked before anything is looked
    up, so that no file is touched; then the analysed plan has to come down to the temporary views in ``views`` and
    to literals, by expressions that are deterministic.  Paths, other tables, table functions and calls into code are refused.
    """
    text = sql.strip()
    if text.startswith("```"):
        text = re.sub(r"```$", "", re.sub(r"^```(?:sql)?", "", text, flags=re.IGNORECASE).strip()).strip()
    text = text.rstrip(";").strip()
    if not text:
        raise ValueError("the query is empty")
    if ";" in text:
        raise ValueError("the query must be a single statement")
    if "--" in text or "/*" in text:
        raise ValueError("the query must not contain comments")
    if not re.match(r"(select|with|from|values|\()", text, re.IGNORECASE):
        raise ValueError("the query must read: SELECT, WITH, FROM or VALUES")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001
        raise ValueError(f"the query can't be parsed: {str(e)[:200]}") from None
    allowed = {v.lower() for v in views}
    _names_read(plan, allowed)
    found = max(_LIMIT.finditer(text), key=lambda m: m.start(), default=None)  # the query's own comes last
    if not found:
        raise ValueError("the query must have a LIMIT")
    with_ctes = plan.nodeName() == "UnresolvedWith"
    if (plan.child() if with_ctes else plan).nodeName() != "GlobalLimit":
        raise ValueError("the LIMIT must be the query's own")
    try:
        analysed = spark.sql(text)._jdf.queryExecution().analyzed()  # a query only, by now, so nothing runs
    except Exception as e:  # noqa: BLE001
        raise ValueError(f"the query can't be analysed: {str(e)[:300]}") from None
    _only_reads(analysed, allowed)
    warnings = []
    if int(found[1]) > most:
        warnings.append(f"LIMIT was capped from {found[1]} to {most}")
        head, tail = text[: found.start()], text[found.end() :]
        text = f"{head}LIMIT {most}{tail}"
    return text, warnings


def run_guarded(spark: SparkSession, sql: str, most: int = SQL_MAX_ROWS, timeout: float = 30.0, views: Collection[str] = ()) -> list:
    """Rows of a guarded query; its jobs are cancelled after ``timeout`` seconds."""
    safe, _ = guard_sql(spark, sql, most, views)
    group = f"guarded-{uuid4()}"

    def job() -> list:
        spark.sparkContext.setJobGroup(group, "guarded query", interruptOnCancel=True)
        return spark.sql(safe).collect()

    with ThreadPoolExecutor(1) as pool:
        future = pool.submit(job)
        try:
            return future.result(timeout)
        except FutureTimeout:
            spark.sparkContext.cancelJobGroup(group)
            raise TimeoutError(f"the query took more than {timeout:g} s") from None


def error_kind(error: Exception) -> str:
    """timeout, syntax or execution."""
    text = f"{type(error).__name__} {error}".lower()
    if "timeout" in text or "timed out" in text or "cancel" in text:
        return "timeout"
    return "syntax" if "parse" in text or "analysis" in text or "unresolved" in text else "execution"


def clean_chunk_text(text: Column) -> Column:
    """White space folded, trade marks and what trails off at the end removed."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(folded, "[\u00ae\u3222]", ""), "(?:\\s|\\.{3,}|\\?{2,}|[\u2026\ufffd])+$", "")


def companies_in(rows: DataFrame, key: str = "company") -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).select(key).distinct()
