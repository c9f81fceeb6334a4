"""Text functions: normalisation, tokens, phrases, passages, claims.

All are built from Spark expressions; only HTML entities need Python (in Arrow batches,
and only for texts that have an ampersand).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Word lists and patterns that results depend on.
RANK_STOPWORDS = "about and are can does for from how into is it its of or the this to what when why work works".split()
SEARCH_STOPWORDS = "about all and are can does do for from how i in is it its me of on or the this to vs what when why".split()
CACHE_STOPWORDS = "a an and are can could does for in is its me of on please show tell the this to you".split()
SUPPORT_STOPWORDS = "also answer based because claim could does from have into means more only should that their there these they this through with would".split()
#: White space as Python's ``\s`` has it.
SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
WORD = "[a-z0-9][a-z0-9_\\-]{1,}"
SEARCH_WORD = "[a-z0-9][a-z0-9_\\-.]{1,}"
RERANK_WORD = "[a-z0-9_.%+-]+"
CODE_TOKEN = "[A-Za-z_][A-Za-z0-9_]*|\\d+|==|!=|<=|>=|[-+*/%]=?|[{}()\\[\\].,;:]"
CJK = "[\\x{3400}-\\x{9fff}]"
INTENTS = {
    "compare": r"\b(compare|versus|vs|difference|tradeoff|trade-off)\b|比较|区别|权衡",
    "how": r"\b(how|guide|tutorial|steps|implement|use|build)\b|怎么|如何|实现|步骤",
    "why": r"\b(why|cause|causes|reason)\b|为什么|原因",
    "recommend": r"\b(best|recommend|choose|which|should)\b|推荐|选择|哪个好",
    "code": r"\b(api|sdk|code|python|javascript|typescript|curl|json)\b|代码|接口",
}
FRESHNESS = r"\b(latest|today|current|now|recent|new|202[5-9])\b|最新|今天|当前|最近|今年"
GENERIC_PREFIXES = ("based on", "基于", "下面", "以下")


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without(words: Column, stop: list[str]) -> Column:
    """``words`` without the stop words; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(stop))


@F.arrow_udf(StringType())
def _unescape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_text(text: Column, entities: bool = True) -> Column:
    """HTML entities decoded (unless the caller knows there are none), white space collapsed, trimmed."""
    return collapse_space(F.when(F.contains(text, F.lit("&")), _unescape(text)).otherwise(text) if entities else text)


def cjk_tokens(text: Column) -> Column:
    """Single CJK characters, then pairs of neighbours among them."""
    single = all_matches(text, CJK)
    pairs = F.when(F.size(single) > 1, F.transform(F.sequence(F.lit(1), F.size(single) - 1), lambda i: F.concat(F.element_at(single, i.cast("int")), F.element_at(single, (i + 1).cast("int")))))
    return F.concat(single, F.coalesce(pairs, F.array().cast("array<string>")))


def tokenize(text: Column) -> Column:
    """Lower-case words of two characters or more without stop words, then CJK characters and pairs; repeats stay."""
    low = F.lower(text)
    return F.concat(without(all_matches(low, WORD), RANK_STOPWORDS), cjk_tokens(low))


def query_phrases(query: Column) -> Column:
    """Three-word, then two-word phrases, but for those of stop words alone."""
    words = all_matches(F.lower(query), WORD)

    def grams(n: int) -> Column:
        every = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n)))
        kept = F.filter(every, lambda g: F.exists(g, lambda w: ~w.isin(RANK_STOPWORDS)))
        return F.coalesce(F.transform(kept, lambda g: F.array_join(g, " ")), F.array().cast("array<string>"))

    return F.concat(grams(3), grams(2))


def query_keywords(text: Column) -> Column:
    """Search words without outer dots and stop words."""
    trimmed = F.transform(all_matches(F.lower(text), SEARCH_WORD), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(trimmed, lambda w: (F.length(w) >= 2) & ~w.isin(SEARCH_STOPWORDS))


def keyword_query(text: Column, most: int = 9) -> Column:
    return F.array_join(F.slice(query_keywords(text), 1, most), " ")


def normalize_query(query: Column) -> Column:
    """Lower case, words only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.trim(query)), "(?U)[^\\w\\x{3400}-\\x{9fff}]+", " "))


def stem(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.isin("does", "was", "has"), word)
        .when((n > 5) & word.endswith("ies"), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 5) & word.endswith("ing"), word.substr(F.lit(1), n - 3))
        .when((n > 4) & word.endswith("ed"), word.substr(F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def fingerprint_tokens(normalized: Column) -> Column:
    """Distinct stems of the words that are no stop words, with CJK characters and pairs."""
    words = F.transform(without(all_matches(normalized, "[a-z0-9]+"), CACHE_STOPWORDS), stem)
    return F.array_distinct(F.concat(words, cjk_tokens(normalized)))


def number_tokens(normalized: Column) -> Column:
    return F.array_sort(F.array_distinct(all_matches(normalized, r"\d+")))


def intent_tags(query: Column) -> Column:
    tags = F.filter(F.array(*(F.when(query.rlike(f"(?i){p}"), F.lit(t)) for t, p in INTENTS.items())), lambda t: t.isNotNull())
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("lookup")))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sentences(text: Column) -> Column:
    """Parts between sentence ends that white space follows."""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?。！？]){SPACE}+"), lambda s: F.trim(s)), lambda s: s != "")


def split_passages(text: Column, target: int = 900, overlap: int = 0) -> Column:
    """Whole sentences packed greedily into passages of up to ``target`` characters; one that stays far longer alone is cut evenly.

    ``text`` is clean already.  A passage carries the last ``overlap`` characters of the one
    before.  Each sentence depends on the passage so far, so a batch of texts is one pass in Python.
    """

    @F.arrow_udf(ArrayType(StringType()))
    def pack(sentences: pa.Array) -> pa.Array:
        return pa.array([_packed(s or [], target, overlap) for s in sentences.to_pylist()], pa.list_(pa.string()))

    return pack(sentences(text))


def _packed(sentences: list[str], target: int, overlap: int) -> list[str]:
    done: list[list[str]] = []
    room = 0
    for s in sentences:
        if done and len(s) + 1 <= room:
            done[-1].append(s)
        else:
            before = " ".join(done[-1])[-overlap:].strip(" ") if done and overlap else ""
            done.append([before, s] if before else [s])
            room = target - len(before) if before else target + 1
        room -= len(s) + 1
    passages = [" ".join(p) for p in done]
    if len(passages) == 1 and len(passages[0]) > target * 1.5:
        step = max(1, target - overlap)
        return [passages[0][i : i + target] for i in range(0, len(passages[0]), step)]
    return passages


_SENTENCE_END, _WORD, _CJK = re.compile("[.!?。！？] "), re.compile(WORD), re.compile("[\u3400-\u9fff]")


def passages_of(text: str | None, target: int = 900) -> list[str]:
    """``split_passages(clean_text(text), target)`` of one text, for tasks that read texts in Python anyway."""
    clean = " ".join((html.unescape(text) if "&" in text else text).split()) if text else ""
    at = [0, *(m.end() for m in _SENTENCE_END.finditer(clean)), len(clean) + 1]
    return _packed([clean[a : b - 1] for a, b in zip(at, at[1:])], target, 0) if clean else []


def tokens_of(low: str) -> list[str]:
    """``tokenize`` of one text in lower case, stop words still among the words."""
    cjk = _CJK.findall(low)
    return _WORD.findall(low) + cjk + [a + b for a, b in zip(cjk, cjk[1:])]


def contextual_passage(title: Column, domain: Column, snippet: Column, passage: Column) -> Column:
    """A passage behind its source's title, domain and snippet."""
    parts = F.array(F.concat(F.lit("Source title: "), title), F.concat(F.lit("Source domain: "), domain), F.when(snippet != "", F.concat(F.lit("Source snippet: "), snippet)), F.when(passage != "", passage))
    return F.array_join(F.array_compact(parts), ". ")


def source_prefix(title: Column, domain: Column, provider: Column) -> Column:
    return collapse_space(F.concat(F.lit("Source context: title="), title, F.lit("; domain="), domain, F.lit("; provider="), provider, F.lit(". Passage:")))


def code_tokens(text: Column) -> Column:
    """Identifiers, numbers and operators in lower case; identifiers are followed by their snake and camel parts."""
    raw = all_matches(text, CODE_TOKEN)

    def parts(token: Column) -> Column:
        split = F.filter(F.transform(F.split(token, "_|(?<=[a-z0-9])(?=[A-Z])"), F.lower), lambda p: p != "")
        low = F.lower(token)
        # Most words have one part: they are spared the split.
        plain = token.rlike("^[a-z]+$|^[A-Z][a-z]*$")
        return F.when(plain, F.array(low, low)).when(token.rlike("^[A-Za-z_]"), F.concat(F.array(low), split)).otherwise(F.array(low))

    return F.flatten(F.transform(raw, parts))


def rerank_tokens(text: Column) -> Column:
    low = F.lower(text)
    return F.concat(all_matches(low, RERANK_WORD), all_matches(low, "[\\x{4e00}-\\x{9fff}]"))


def title_text(document: Column, most: int = 96) -> Column:
    """The start of the first line, up to a double space."""
    line = F.element_at(F.split(F.regexp_replace(document, f"^{SPACE}+|{SPACE}+$", ""), "\r\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"), 1)
    return F.substring(F.element_at(F.split(line, "  "), 1), 1, most)


def head_text(document: Column, most: int = 192) -> Column:
    return F.substring(F.translate(F.regexp_replace(document, f"^{SPACE}+|{SPACE}+$", ""), "\n", " "), 1, most)


def cjk_ngrams(text: Column, n: int) -> Column:
    chars = all_matches(text, "[\\x{4e00}-\\x{9fff}]")
    grams = F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.size(chars) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def cjk_recall(query: Column, document: Column, n: int) -> Column:
    """Share of the query's distinct CJK n-grams that the document has; 0 where the query has none."""
    q = cjk_ngrams(query, n)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, cjk_ngrams(document, n))) / F.size(q))


def citation_ids(text: Column) -> Column:
    """Cited numbers in order of first use: ``[1]``, ``[2, 3]``."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda i: i.cast("int")))


def split_claims(line: Column) -> Column:
    """Parts of a line at sentence ends, not before a citation."""
    return F.filter(F.transform(F.split(line, f"(?<=[.!?。！？]){SPACE}+(?!\\[\\d)"), lambda p: F.trim(p)), lambda p: p != "")


def strip_list_marker(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*(?:[-*]\s+|\d+[.)]\s*)", "")


def clean_claim(text: Column) -> Column:
    bare = strip_list_marker(F.regexp_replace(text, r"\[\d+(?:\s*,\s*\d+)*\]", ""))
    return F.regexp_replace(clean_text(bare, entities=False), "^[ :：-]+|[ :：-]+$", "")


def keep_claim(claim: Column, ids: Column) -> Column:
    generic = F.lit(False)
    for prefix in GENERIC_PREFIXES:
        generic = generic | F.lower(claim).startswith(prefix)
    uncited = F.size(ids) == 0
    return (claim != "") & ~(uncited & (generic | (F.length(claim) < 42) | claim.endswith(":") | claim.endswith("：")))


def support_tokens(text: Column) -> Column:
    return F.filter(without(tokenize(text), SUPPORT_STOPWORDS), lambda t: ~t.rlike(r"^\d+$"))


def answer_language(query: Column) -> Column:
    return F.when(query.rlike(CJK), "Chinese").otherwise("the same language as the user query")
