"""Column expressions on paths, labels and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript counts as whitespace.
JS_WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Lower-cased file extension to language.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "go": "go",
}

# Rules exist per family, not per language: TypeScript and JavaScript share theirs.
LANGUAGE_FAMILY = {"typescript": "script", "javascript": "script", "python": "python", "go": "go"}


def js_trim(col: Column) -> Column:
    """Trim as ECMAScript does; Spark's own trim takes blanks only."""
    return F.regexp_replace(col, f"^[{JS_WS}]+|[{JS_WS}]+$", "")


def label_key(col: Column) -> Column:
    """The one key under which labels count as equal."""
    return js_trim(F.lower(col))


def detect_language(path: Column) -> Column:
    """Language by extension. A leading dot alone (`.ts`) is a name, not an extension."""
    ext = F.regexp_extract(F.lower(path), r"[^/]\.([^./]*)$", 1)
    by_language: dict[str, list[str]] = {}
    for extension, language in LANGUAGE_BY_EXTENSION.items():
        by_language.setdefault(language, []).append(extension)
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for language, extensions in by_language.items():
        expr = expr.when(ext.isin(*extensions), language)
    return expr.otherwise("unknown")


def language_family(language: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, family in LANGUAGE_FAMILY.items():
        expr = expr.when(language == name, family)
    return expr


def strip_root(path: Column, root: Column) -> Column:
    """Path without its repository root; other paths unchanged."""
    return F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


def short_path(path: Column) -> Column:
    """Last three segments, back slashes read as slashes."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -3)


def confidence_percent(confidence: Column) -> Column:
    return F.concat(F.floor(confidence * 100 + F.lit(0.5)).cast("bigint").cast("string"), F.lit("%"))


# Schemes whose hosts are case-blind, and the owner/name path of a repository.
_WEB_URL = r"^(?i:https?|wss?|ftp):[/\\]*(?:[^/\\?#@]*@)?([^/\\?#:]+)(?::\d*)?([^?#]*)"
_OTHER_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)"
_REPO_PATH = r"^/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"
_DOT_SEGMENT = r"/\.{1,2}(/|$)"


def is_repo_url(url: Column, host: str = "github.com") -> Column:
    """Whether `url` names a repository on `host`, whatever its scheme, query or fragment."""
    text = js_trim(url)
    web = text.rlike(_WEB_URL)
    url_host = F.when(web, F.lower(F.regexp_extract(text, _WEB_URL, 1))).otherwise(
        F.regexp_extract(text, _OTHER_URL, 1)
    )
    path = F.when(web, F.regexp_extract(text, _WEB_URL, 2)).otherwise(F.regexp_extract(text, _OTHER_URL, 2))
    good = (url_host == host) & path.rlike(_REPO_PATH) & ~path.rlike(_DOT_SEGMENT)
    return F.coalesce(good, F.lit(False))


def content_id(*parts: Column) -> Column:
    """Stable id from its parts: the same row gets the same id in every retry of a task.

    Each part is preceded by its length, so that no two lists of parts read the same.
    """
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in filled]), 256)
