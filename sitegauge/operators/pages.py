"""Page, registry and text-rule jobs (WB-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import col
from sitegauge.operators.clean import strip_control
from sitegauge.operators.joins import first_per_key
from sitegauge.operators.windows import top_k_per_key

COUNTED_TAGS = ("h1", "form", "input", "article", "section")

# Page categories worth following, best first.
CATEGORY_PRIORITY = ("SEARCH_PAGE", "DISCLAIMER_PAGE", "LANDING_PAGE", "HOMEPAGE")

# Portal vendors by URL pattern, first match wins.
VENDOR_PATTERNS = (
    ("IDOX", "/publicaccess/"), ("IDOX", "/online-applications/"), ("IDOX", "/idoxpa-web/"),
    ("NORTHGATE", "/MVM/"), ("NORTHGATE", "/generic/"), ("NORTHGATE", "/generichandler"),
    ("AGILE", "/agile_planning/"), ("OCELLA", "/web-planning/"), ("CMS_LANDING", "/planning/find-a-planning-application"),
)

# Domains never taken for an authority's own, and suffixes that may be.
BLOCKED_DOMAINS = (
    "planning.org.uk", "www.gov.uk", "nationaltrust.org.uk", "facebook.com", "twitter.com", "instagram.com", "linkedin.com",
)
ALLOWED_SUFFIXES = (".gov.uk", ".org.uk", ".gov.scot", ".gov.wales", ".gov.je", ".gov.im", ".llyw.cymru")
PROBE_SUFFIXES = (".gov.uk", ".gov.scot", ".gov.wales", ".llyw.cymru", ".gov.je", ".gov.im")
PROBE_PATHS = ("", "/planning", "/planning-applications", "/planning/planning-applications")

# Words that do not identify an authority, and markers of a lower tier.
NAME_STOP_WORDS = (
    "council", "borough", "city", "district", "of", "and", "the", "royal", "london", "st", "saint", "metropolitan", "town", "parish", "community",
)
TIER_MARKERS = ("town", "parish", "community", "village")

# Usual short forms of county names in domains.
COUNTY_SHORT_FORMS = {
    "hertfordshire": "herts", "hampshire": "hants", "nottinghamshire": "notts", "leicestershire": "leics", "northamptonshire": "northants",
    "oxfordshire": "oxon", "wiltshire": "wilts", "clackmannanshire": "clacks", "dunbartonshire": "dunbarton", "monmouthshire": "monmouth",
    "shropshire": "salop", "warwickshire": "warks", "cambridgeshire": "cambs", "yorkshire": "yorks", "lancashire": "lancs",
    "staffordshire": "staffs", "lincolnshire": "lincs", "buckinghamshire": "bucks", "berkshire": "berks",
}

# Name prefixes and endings dropped for a clean authority name.
NAME_PREFIXES = ("City of ", "Royal Borough of ", "London Borough of ")
NAME_ENDINGS = (" Borough Council", " District Council", " City Council", " Council")


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, meta description and counts of the structural tags."""
    def first(pattern: str) -> Column:
        found = F.trim(F.regexp_extract(html, pattern, 1))
        return F.when(found != "", found)

    return pages.withColumns({
        "title": first(r"(?is)<title[^>]*>(.*?)</title>"),
        "description": first(r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""),
        **{f"n_{t}": F.size(F.regexp_extract_all(html, F.lit(rf"(?i)<({t})[\s/>]"), F.lit(1))) for t in COUNTED_TAGS},
    })


def select_candidates(pages: DataFrame, site: str, url: str, category: str, order: str, limit: int = 10) -> DataFrame:
    """Up to ``limit`` distinct URLs per site, by category priority then order of discovery."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_PRIORITY]), F.col(category))
    useful = pages.withColumn("_priority", rank).filter(F.col("_priority") > 0)
    distinct = first_per_key(useful, [site, url], ["_priority", order])
    return top_k_per_key(distinct, [site], ["_priority", order], limit).drop("_priority")


def classify_vendor(url: str | Column, rules: Sequence[tuple[str, str]] = VENDOR_PATTERNS, default: str = "UNKNOWN") -> Column:
    out = F.lit(default)
    for vendor, pattern in reversed(list(rules)):
        out = F.when(col(url).rlike(f"(?i){pattern}"), vendor).otherwise(out)
    return out


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _contains_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def valid_domain(url: str | Column, allowed: Sequence[str] = ALLOWED_SUFFIXES, blocked: Sequence[str] = BLOCKED_DOMAINS) -> Column:
    h = host(url)
    return ~_contains_any(h, blocked) & _contains_any(h, allowed)


def name_tokens(name: str | Column) -> Column:
    """Identifying words of an authority name; all its words when none identify."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col(name)), r"[-.]", " "), r"[^\w\s]", "")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(list(NAME_STOP_WORDS)))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def domain_matches_name(url: str | Column, name: str | Column) -> Column:
    """Whether the domain plausibly belongs to the named authority."""
    h, tokens = host(url), name_tokens(name)
    stem = F.regexp_replace(h, r"\.(gov|org)\.uk", "")
    veto = F.lit(False)
    for m in TIER_MARKERS:
        veto = veto | ((stem.endswith(m) | stem.contains(f"{m}council")) & ~F.lower(col(name)).contains(m))
    short = F.create_map(*[F.lit(v) for kv in COUNTY_SHORT_FORMS.items() for v in kv])
    wide = F.concat(tokens, F.filter(F.transform(tokens, lambda t: F.element_at(short, t)), lambda t: t.isNotNull()))
    by_word = F.exists(wide, lambda t: (F.length(t) >= 3) & h.contains(t))
    acronym = F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")
    known_vendor = classify_vendor(url) != "UNKNOWN"
    return known_vendor | (~veto & (by_word | ((F.length(acronym) >= 2) & h.startswith(acronym))))


def clean_authority_name(name: str | Column) -> Column:
    out = strip_control(name)
    for p in NAME_PREFIXES:
        out = F.when(out.startswith(p), F.substr(out, F.lit(len(p) + 1))).otherwise(out)
    out = F.replace(out, F.lit(", City of"), F.lit(""))
    for e in NAME_ENDINGS:
        out = F.replace(out, F.lit(e), F.lit(""))
    return F.trim(F.replace(out, F.lit(","), F.lit("")))


def candidate_urls(names: DataFrame, name: str, suffixes: Sequence[str] = PROBE_SUFFIXES, paths: Sequence[str] = PROBE_PATHS) -> DataFrame:
    """Addresses to try per authority: joined, hyphenated and abbreviated names by suffix and path."""
    lower = F.lower(F.col(name))
    short = lower
    for full, abbreviation in COUNTY_SHORT_FORMS.items():
        short = F.replace(short, F.lit(full), F.lit(abbreviation))
    variants = F.array_distinct(F.array(
        F.regexp_replace(lower, r"[ .-]", ""), F.regexp_replace(F.replace(lower, F.lit("."), F.lit("")), " ", "-"),
        F.regexp_replace(short, r"[ .-]", ""), F.regexp_replace(F.replace(lower, F.lit("city"), F.lit("")), r"[ .-]", ""),
    ))
    out = names.withColumn("_v", F.explode(F.filter(variants, lambda v: v != "")))
    out = out.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in suffixes])))
    out = out.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in paths])))
    return out.select(*names.columns, F.concat(F.lit("https://www."), "_v", "_s", "_p").alias("url"))


def apply_blueprints(pages: DataFrame, id: str, html: str, rules: Mapping[str, str]) -> DataFrame:
    """(id, field, value) for every rule: the pattern's first group in the page, null on a miss."""
    table = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("pattern")) for f, p in rules.items()])
    out = pages.select(id, html, F.explode(table).alias("r"))
    found = F.call_function("regexp_extract", F.col(html), F.col("r.pattern"), F.lit(1))
    return out.select(id, F.col("r.field").alias("field"), F.when(found != "", found).alias("value"))


def upsert_registry(existing: DataFrame, names: DataFrame) -> DataFrame:
    """One entry per listed name: the existing one, or a blank one to be verified."""
    listed = names.select("name").distinct()
    out = listed.join(existing, "name", "left")
    return out.select(
        "name", F.coalesce("clean_name", clean_authority_name("name")).alias("clean_name"), "portal_url",
        F.coalesce("vendor", F.lit("UNKNOWN")).alias("vendor"), F.coalesce("status", F.lit("AUTO_GENERATED")).alias("status"),
    )


def missing_urls(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("portal_url").isNull())


def keyword_flags(text: str | Column, groups: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """0/1 per group: any of its words appears in the lower-cased text."""
    lower = F.lower(F.coalesce(col(text), F.lit("")))
    return {name: _contains_any(lower, words).cast("int") for name, words in groups.items()}


def mask_contacts(text: str | Column) -> Column:
    """Email addresses and telephone numbers replaced by markers."""
    out = F.regexp_replace(col(text), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(out, r"\+?\d[\d ()-]{8,}\d", "[PHONE]")


def phrase_matrix(df: DataFrame, id: str, text: str, phrases: Mapping[str, str]) -> DataFrame:
    """A 0/1 column per phrase, over text with contacts masked."""
    masked = F.lower(mask_contacts(text))
    return df.select(id, masked.alias("_t")).select(id, *[F.col("_t").contains(p).cast("int").alias(n) for n, p in phrases.items()])
