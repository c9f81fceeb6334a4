"""Query planning: intents, depth, rewritten queries, research steps, request keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import authority
from tessera.functions import text as T
from tessera.functions.urls import clean_domains

# Patterns that decide a plan, and the limits of the three modes.
COMPLEX = (
    r"\b(compare|versus|vs\.?|trade[- ]?off|why|how|architecture|debug|root cause|evaluate|recall|precision|benchmark|policy|legal|medical|financial)\b"
    "|比较|权衡|为什么|怎么|架构|调试|诊断|根因|评估|召回|准确|政策|法律|医疗|金融"
)
MAX = r"\b(deep research|comprehensive|multi[- ]?step|long[- ]?horizon|formal proof|threat model)\b|深入研究|全面|多步|复杂|系统设计|威胁模型|端到端"
API = r"\b(api|sdk|endpoint|json|curl|python|javascript|typescript)\b|接口|代码|报错|实现"
RECOMMEND = r"\b(best|recommend|choose|which|should I)\b|推荐|选择|哪个好|应该"
COMPARE = r"\b(compare|versus|vs\.?|difference|trade[- ]?off)\b|比较|区别|权衡"
PROVIDER = r"\b(?:openai|chatgpt)\b"
PROVIDER_SITES = ["help.openai.com", "openai.com"]
PROVIDER_SITES_DEEPER = ["developers.openai.com"]
LATEST = "latest|today|current|now|recent|new|最新|今天|当前|最近|今年"
RECENCY = "any day week month year".split()
QUERY_LIMIT = {"fast": 3, "pro": 4, "deep": 5}
DEPTHS = ["fast", "pro", "deep"]
STYLES = {"comparison": "tradeoff_summary", "recommendation": "ranked_recommendation", "api_or_code": "implementation_guidance", "analysis": "structured_explanation", "lookup": "concise_answer"}
LENSES = {
    "official": ["{} official source", "{} official documentation"],
    "academic": ["site:arxiv.org {}", "site:.edu {}", "{} research paper filetype:pdf"],
    "forums": ["site:reddit.com {}", "site:stackoverflow.com {}", "site:news.ycombinator.com {}"],
    "news": ["{} latest news 2026", "{} news analysis"],
    "pdf": ["filetype:pdf {}", "{} white paper PDF"],
    "finance": ["site:sec.gov {}", "{} investor relations financial report"],
    "web": [],
}


def _says(query: Column, pattern: str) -> Column:
    return query.rlike(f"(?i){pattern}")


def plan(query: Column, mode: Column) -> Column:
    """intent, answer_style, needs_freshness, search_depth and reasoning_effort by ordered rules."""
    hard, most, fresh = _says(query, COMPLEX), _says(query, MAX), _says(query, T.FRESHNESS)
    intent = F.when(_says(query, COMPARE), "comparison").when(_says(query, RECOMMEND), "recommendation").when(_says(query, API), "api_or_code").when(hard, "analysis").otherwise("lookup")
    style = F.lit(None).cast("string")
    for name, value in STYLES.items():
        style = F.when(intent == name, value).otherwise(style)
    effort = F.when(most, "max").when((mode == "deep") | hard | intent.isin("comparison", "recommendation", "api_or_code"), "high").otherwise("none")
    depth = F.when((mode == "deep") | most, "deep").when((mode == "pro") | hard | fresh, "pro").otherwise("fast")
    return F.struct(intent.alias("intent"), style.alias("answer_style"), fresh.alias("needs_freshness"), depth.alias("search_depth"), effort.alias("reasoning_effort"))


def deeper(a: Column, b: Column) -> Column:
    """The deeper of two modes."""
    order = F.array(*map(F.lit, DEPTHS))
    return F.element_at(order, F.greatest(F.array_position(order, a), F.array_position(order, b)).cast("int"))


def coerce_effort(effort: Column, fallback: Column) -> Column:
    low = F.lower(effort)
    mapped = F.when(low.isin("disabled", "off", "false", "no", "low", "none"), "none").when(low.isin("medium", "high"), "high").when(low.isin("xhigh", "maximum", "max"), "max")
    return F.coalesce(mapped, fallback)


def coerce_confidence(value: Column, fallback: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), fallback)))


def distinct_ignoring_case(items: Column) -> Column:
    """Non-empty items, the first of those that differ in case only."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1))


def search_filters(include: Column, exclude: Column, recency: Column, country: Column, language: Column, lens: Column) -> Column:
    """A struct of clean filter values: up to 20 domains a list, none both included and excluded; what is unknown becomes the default."""
    allowed, denied = (F.slice(clean_domains(F.coalesce(x, F.array().cast("array<string>"))), 1, 20) for x in (include, exclude))
    one_of = lambda value, known, default: F.when(F.trim(F.lower(value)).isin(*known), F.trim(F.lower(value))).otherwise(default)
    code = lambda value: F.substring(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z]", ""), 1, 2)
    return F.struct(
        F.array_except(allowed, denied).alias("include_domains"), denied.alias("exclude_domains"), one_of(recency, RECENCY, "any").alias("recency"), code(country).alias("country"), code(language).alias("language"), one_of(lens, LENSES, "web").alias("lens")
    )


def rewrite_queries(query: Column, mode: str, lens: str = "web", include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Provider, lens, site, plain, keyword, authority, dated and source queries in order; deduplicated, cut at the mode's limit."""
    keyword = T.keyword_query(query)
    site = lambda d: F.concat(F.lit(f"site:{d} "), query)
    hinted = PROVIDER_SITES + (PROVIDER_SITES_DEEPER if mode in ("pro", "deep") else [])
    parts = [F.when(_says(query, PROVIDER), site(d)) for d in hinted]
    parts += [F.concat(*(query if x is None else F.lit(x) for x in _template(t))) for t in LENSES[lens]]
    parts += [site(d) for d in list(include)[:4]]
    parts += [query, F.when((keyword != "") & (F.lower(keyword) != F.lower(query)), keyword)]
    later = [F.when(_says(query, LATEST) & ~query.rlike(r"\b20\d{2}\b"), F.concat(query, F.lit(" 2026")))]
    if mode in ("pro", "deep"):
        later.append(F.concat(query, F.lit(" official source")))
    if mode == "deep":
        later.append(F.concat(query, F.lit(" explained")))
    every = F.array_compact(F.concat(F.array(*parts), authority.authority_queries(query), F.array(*later)))
    if exclude:
        denied = " ".join(f"-site:{d}" for d in list(exclude)[:8])
        every = F.transform(every, lambda q: F.trim(F.concat(q, F.lit(f" {denied}"))))
    return F.slice(distinct_ignoring_case(every), 1, QUERY_LIMIT[mode])


def _template(pattern: str) -> list[str | None]:
    before, after = pattern.split("{}")
    return [x for x in (before or "", None, after or "") if x != ""]


def research_steps(query: Column, p: Column) -> Column:
    """Labels and queries of up to five research steps, from a ``plan``."""
    deep = (p["reasoning_effort"] == "max") | (p["search_depth"] == "deep")
    check = deep | p["intent"].isin("comparison", "recommendation", "analysis", "api_or_code")
    step = lambda label, tail: F.struct(F.lit(label).alias("label"), F.concat(query, F.lit(tail)).alias("query"))
    return F.slice(
        F.array_compact(
            F.array(
                step("official", " official source documentation"),
                step("evidence", " evidence details citations"),
                F.when(p["needs_freshness"], step("freshness", " latest 2026")),
                F.when(check, step("countercheck", " limitations risks comparison")),
                F.when(~p["needs_freshness"] & ~check, step("context", " explained")),
                F.when(deep, step("synthesis", " expert analysis key findings")),
            )
        ),
        1,
        5,
    )


# Words of each kind of question about code; the first kind with one of its words counts.
QUESTION_WORDS = {
    "impact": "impact, change, break, affect, blast, radius, modify, refactor, 影响, 修改, 重构, 改动".split(", "),
    "flow": "how does, flow, trace, path, happen, process, handle, work, step, execute, 怎么, 流程, 处理".split(", "),
    "relationship": "connect, between, depend, relationship, 关系, 路径".split(", "),
    "global": "architecture, overview, structure, module, all, 架构, 概览, 总体, overall".split(", "),
}


def question_type(question: Column) -> Column:
    """Impact, flow, relationship, global or local, by the first group with a word in the question (substrings count)."""
    low, out = F.lower(question), F.lit("local")
    for kind, words in reversed(QUESTION_WORDS.items()):
        out = F.when(low.rlike("|".join(words)), kind).otherwise(out)
    return out
