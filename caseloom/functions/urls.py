"""URLs as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_page_key(url: Column) -> Column:
    """Equal for URLs of one page: scheme, case of the host, default port, closing slashes,
    query, fragment and style of percent-escapes aside. Null for null and blank URLs."""
    return _let(F.regexp_replace(F.substring_index(F.substring_index(F.trim(url), "#", 1), "?", 1), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", ""), _page_key)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _page_key(bare: Column) -> Column:
    host = F.lower(F.substring_index(bare, "/", 1))
    host = F.when(host.contains(":"), F.regexp_replace(host, r":(?:80|443)?$", "")).otherwise(host)
    path = F.rtrim(F.substring(bare, F.length(F.substring_index(bare, "/", 1)) + 1, F.length(bare)), F.lit("/"))
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    return F.when(bare != "", F.concat(host, decoded))


def url_host(url: Column) -> Column:
    """The host in lower case without port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


#: Characters that need no escape in a path.
UNRESERVED = "[A-Za-z0-9._~-]"


def normal_escapes(path: Column) -> Column:
    """Percent escapes in one form: unreserved characters decoded, hex digits upper case, a stray % escaped."""

    def piece(x: Column, i: Column) -> Column:
        code = F.substring(x, 1, 2)
        char = F.chr(F.conv(code, 16, 10).cast("long"))
        known = F.when(char.rlike(f"^{UNRESERVED}$"), char).otherwise(F.concat(F.lit("%"), F.upper(code)))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(known, F.substring(x, 3, 1 << 30))).otherwise(F.concat(F.lit("%25"), x))

    return F.when(path.contains("%"), F.array_join(F.transform(F.split(path, "%"), piece), "")).otherwise(path)


# The first and the third step of a case page's path, between which a step names the language, and those languages.
SITE_STEPS, SITE_LANGUAGES = ("cld", "case-law-doc"), ("ar", "en", "es", "fr", "ru", "zh")


def site_path(path: Column, steps: tuple[str, str] = SITE_STEPS, languages: tuple[str, ...] = SITE_LANGUAGES) -> Column:
    """A path with slashes of one kind, no empty steps, and no language between the two steps."""

    def joined(s: Column) -> Column:
        named = (F.get(s, 0) == steps[0]) & F.lower(F.get(s, 1)).isin(*languages) & (F.get(s, 2) == steps[1])
        kept = F.when(F.coalesce(named, F.lit(False)), F.concat(F.slice(s, 1, 1), F.slice(s, 3, 1 << 30))).otherwise(s)
        return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("/"), x)), "")

    return _let(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != ""), joined)


def url_flags(url: Column) -> Column:
    """What is odd about a URL, sorted: control characters, backslashes, dot segments, malformed escapes, other schemes, no page."""
    u = F.trim(url)
    path = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", ""), r"[?#].*$", "")
    tests = {
        "BACKSLASH": u.contains("\\"),
        "CONTROL_CHARACTER": u.rlike(r"[\x00-\x1f\x7f]"),
        "DOT_SEGMENT": path.rlike(r"(^|/)\.{1,2}(/|$)"),
        "MALFORMED_ESCAPE": path.rlike(r"%(?![0-9A-Fa-f]{2})"),
        "NO_HTML_PAGE": ~F.lower(path).endswith(".html"),
        "OTHER_SCHEME": ~F.lower(u).rlike(r"^https?://"),
    }
    found = F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()])
    return F.when(u.isNull() | (u == ""), F.array(F.lit("MISSING"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def page_identity(url: Column) -> Column:
    """Host and site_path() of a web page by https, without port or with its own, query and fragment aside; null for anything else."""
    u = F.substring_index(F.substring_index(F.trim(url), "#", 1), "?", 1)
    host = F.lower(F.regexp_extract(u, r"^(?i:https)://([^/:@]+)(?::443)?(?:/|$)", 1))
    return F.when(host != "", F.concat(host, site_path(F.regexp_extract(u, r"^[A-Za-z]+://[^/]+(.*)$", 1))))


def url_relation(actual: Column, expected: Column) -> Column:
    """MISSING, EXACT_MATCH, CANONICAL_EQUIVALENT or MISMATCH."""
    return (
        F.when(F.coalesce(F.trim(actual), F.lit("")) == "", F.lit("MISSING"))
        .when(actual == expected, F.lit("EXACT_MATCH"))
        .when(page_identity(actual) == page_identity(expected), F.lit("CANONICAL_EQUIVALENT"))
        .otherwise(F.lit("MISMATCH"))
    )
