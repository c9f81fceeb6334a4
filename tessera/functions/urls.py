"""URL functions: domains, canonical forms, redirects, trust tiers, allow and deny lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain lists and weights that results depend on.
TRUSTED_SUFFIXES = ".gov .mil .edu .ac.uk .edu.au .ac.jp .gov.uk .gc.ca".split()
TIERS = {
    "low_signal": "medium.com pinterest.com quora.com reddit.com substack.com".split(),
    "government": (
        "cancer.gov cdc.gov data.gov ec.europa.eu ed.gov ema.europa.eu epa.gov europa.eu fda.gov federalreserve.gov ftc.gov imf.org"
        " irs.gov nasa.gov ncbi.nlm.nih.gov nih.gov nist.gov noaa.gov oecd.org sec.gov treasury.gov un.org usda.gov who.int worldbank.org"
    ).split(),
    "academic": "aclanthology.org arxiv.org bmj.com cell.com jamanetwork.com nejm.org nature.com pubmed.ncbi.nlm.nih.gov science.org sciencedirect.com springer.com".split(),
    "standards": "cisa.gov csrc.nist.gov ietf.org iso.org mitre.org owasp.org w3.org".split(),
    "official_docs": (
        "api-docs.deepseek.com boto3.amazonaws.com cloud.google.com cloudflare.com developer.mozilla.org developers.google.com developers.openai.com"
        " docs.docker.com docs.anthropic.com docs.aws.amazon.com docs.github.com docs.llamaindex.ai docs.microsoft.com docs.npmjs.com docs.perplexity.ai"
        " docs.python.org docs.ragas.io docs.tavily.com fastapi.tiangolo.com git-scm.com help.openai.com learn.microsoft.com nodejs.org numpy.org npmjs.com"
        " openai.com pandas.pydata.org platform.openai.com pnpm.io postgresql.org react.dev support.apple.com support.google.com support.microsoft.com typescriptlang.org"
    ).split(),
    "medical": "cancer.gov clevelandclinic.org mayoclinic.org medlineplus.gov msdmanuals.com".split(),
    "news_wire": "apnews.com bbc.com bbc.co.uk npr.org reuters.com".split(),
    "reference": "britannica.com wikipedia.org".split(),
}
TIER_WEIGHTS = {"government": 1.24, "academic": 1.22, "standards": 1.21, "official_docs": 1.19, "medical": 1.18, "news_wire": 1.12, "reference": 1.05, "low_signal": 0.84, "general": 1.0}
TIER_PRIORITY = {"government": 4.0, "academic": 3.8, "standards": 3.8, "official_docs": 3.7, "medical": 3.5, "news_wire": 2.7, "reference": 1.3, "general": 0.0, "low_signal": -1.2}
PRIMARY_TIERS = "government academic standards official_docs medical news_wire".split()
UNFETCHED = "7z avi dmg doc docx exe gif jpg jpeg mp3 mp4 png ppt pptx rar svg webp xls xlsx zip".split()
BLOCKED_MARKERS = ("access denied", "just a moment", "request rate threshold", "enable javascript", "checking your browser", "temporarily blocked")


def netloc(url: Column) -> Column:
    """What stands between the scheme's slashes and the path; empty where there is no scheme."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), "/+$", "")


def is_noise(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return (F.lower(netloc(url)).endswith("duckduckgo.com") & path.endswith("/y.js")) | query.rlike("ad_domain=|ad_provider=")


def should_fetch(url: Column) -> Column:
    return ~F.lower(url).rlike(r"\.(" + "|".join(UNFETCHED) + ")$")


def looks_blocked(status: Column, title: Column, text: Column) -> Column:
    sample = F.lower(F.concat(title, F.lit(" "), F.substring(text, 1, 800)))
    return (F.coalesce(status >= 400, F.lit(False))) | sample.rlike("|".join(BLOCKED_MARKERS))


def clean_domain(value: Column) -> Column:
    """A bare domain or a ``.tld``, or an empty string."""
    low = F.lower(F.trim(value))
    with_scheme = F.when(F.contains(low, F.lit("://")), low).otherwise(F.concat(F.lit("https://"), low))
    host = F.regexp_replace(F.split_part(netloc(with_scheme), F.lit(":"), F.lit(1)), r"^www\.", "")
    return F.when(low.rlike(r"^\.[a-z]{2,}$"), low).when(host.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), host).otherwise("")


def clean_domains(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, clean_domain), lambda d: d != ""))


def domain_matches(host: Column, pattern: Column) -> Column:
    return F.when(pattern.startswith("."), host.endswith(pattern)).otherwise((host == pattern) | host.endswith(F.concat(F.lit("."), pattern)))


def url_allowed(url: Column, include: Column, exclude: Column) -> Column:
    """A host that an allow list has, if there is one, and no deny list."""
    host = domain_of(url)
    allowed = (F.size(include) == 0) | F.exists(include, lambda d: domain_matches(host, d))
    return (host != "") & allowed & ~F.exists(exclude, lambda d: domain_matches(host, d))


def _in_list(domain: Column, domains: list[str]) -> Column:
    return domain.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def trust_tier(url: Column) -> Column:
    """The first tier, in the fixed order, that lists the domain or a parent of it."""
    domain = domain_of(url)
    suffix = domain.rlike("(" + "|".join(s.replace(".", r"\.") for s in TRUSTED_SUFFIXES) + ")$")
    out = F.when(_in_list(domain, TIERS["low_signal"]), "low_signal").when(suffix | _in_list(domain, TIERS["government"]), "government")
    for tier in ("academic", "standards", "official_docs", "medical", "news_wire", "reference"):
        out = out.when(_in_list(domain, TIERS[tier]), tier)
    return out.otherwise("general")


def by_tier(tier: Column, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), tier)


def source_quality(url: Column) -> Column:
    return by_tier(trust_tier(url), TIER_WEIGHTS)


def is_primary(url: Column, provider: Column) -> Column:
    return trust_tier(url).isin(PRIMARY_TIERS) | (provider == "official")


def _query_value(url: Column, key: str) -> Column:
    return F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)


def decode_redirect(href: Column) -> Column:
    """The target behind the redirect links of three search engines; other links unchanged."""
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    host = netloc(full)
    path = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    u = F.try_url_decode(_query_value(full, "u"))
    encoded = F.translate(F.substring(u, 3, 1 << 20), "-_", "+/")
    padded = F.concat(encoded, F.repeat(F.lit("="), F.pmod(-F.length(encoded), F.lit(4))))
    bing = F.when(u.startswith("a1"), F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), href)).when(u != "", u).otherwise(href)
    yahoo = F.regexp_extract(path, r"/RU=([^/]+)", 1)
    return (
        F.when(host.endswith("duckduckgo.com") & path.startswith("/l/"), F.try_url_decode(_query_value(full, "uddg")))
        .when(host.endswith("bing.com") & path.startswith("/ck/"), bing)
        .when(host.endswith("search.yahoo.com") & (yahoo != ""), F.try_url_decode(yahoo))
        .otherwise(full)
    )
