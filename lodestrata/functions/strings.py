"""Column functions on names, paths, URLs and texts. All are JVM expressions; lengths are bytes where the name says so."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fragments that hint at program text.
CODE_SIGNS = ["func ", "function ", "def ", "class ", "import ", "package ", "(){", "};", "=>", "===", "!==", "&&", "||", "::", "->", "#include", "public ", "private ", "protected ", "static "]
#: Parts of the names of test files and the folders of tests.
TEST_NAME_PARTS = ["_test.", "test_", ".test.", "_spec.", "spec_", ".spec.", "_tests.", "tests_", ".tests.", "test.", "spec.", "tests."]
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__"]
#: Folders that are not walked.
SKIPPED_FOLDERS = [".git", ".svn", ".hg", "node_modules", "vendor", "build", "dist", "target", "bin", "out", ".idea", ".vscode", ".vs", "__pycache__", ".pytest_cache", "*.egg-info", "venv", ".env", "coverage", ".coverage", "logs", "log", "tmp", "temp"]
#: Language by file extension.
EXTENSION_LANGUAGES = {"go": "Go", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "cpp": "C++", "cc": "C++", "cxx": "C++", "c++": "C++", "rs": "Rust", "java": "Java", "c": "C", "rb": "Ruby", "php": "PHP", "html": "HTML", "css": "CSS", "json": "JSON", "yaml": "YAML", "yml": "YAML", "xml": "XML", "md": "Markdown", "sql": "SQL", "sh": "Shell"}
#: Ordered keyword groups of failure messages.
FAILURE_KINDS = [
    ("NETWORK_ERROR", ["connection", "dial tcp", "network"]),
    ("TIMEOUT_ERROR", ["timeout", "deadline exceeded", "timed out"]),
    ("VALIDATION_ERROR", ["invalid", "required field"]),
    ("PERMISSION_DENIED", ["permission denied", "access denied"]),
    ("REPOSITORY_NOT_FOUND", ["repository not found", "404 not found"]),
    ("RESOURCE_EXHAUSTED", ["out of memory", "disk full"]),
]
RETRY_KINDS = [
    ("messaging", ["nats", "jetstream", "messaging"]),
    ("network", ["connection", "timeout", "network", "dns", "refused"]),
    ("authentication", ["authentication", "auth", "credentials", "unauthorized", "permission"]),
    ("disk_space", ["disk space", "no space", "space left"]),
    ("repository_access", ["repository", "not found", "access denied"]),
    ("circuit_breaker", ["circuit breaker", "circuit"]),
    ("rate_limit", ["rate limit", "too many requests"]),
]
#: Signs of an exhausted quota, and of any limit on the rate.
QUOTA_SIGNS = ["quota exceeded", "quota_exceeded", "resource exhausted", "billing required", "you exceeded your current quota", "insufficient quota", "429", "resource_exhausted"]
RATE_SIGNS = ["quota", "rate limit", "429", "resource exhausted"]
ERROR_SUFFIXES = [
    ("_connection_failure", ["connection refused", "connection failed", "no connection"]),
    ("_timeout_failure", ["timeout", "timed out", "deadline exceeded"]),
    ("_auth_failure", ["authentication", "auth", "login", "credential"]),
    ("_permission_failure", ["permission", "forbidden", "unauthorized", "access denied"]),
    ("_not_found", ["not found", "404", "does not exist", "missing"]),
    ("_validation_failure", ["validation", "invalid", "malformed", "bad request"]),
    ("_storage_failure", ["disk", "storage", "filesystem", "no space"]),
    ("_memory_failure", ["memory", "out of memory", "oom"]),
    ("_network_failure", ["network", "connection", "socket"]),
    ("_rate_limit_failure", ["rate limit", "too many requests", "throttle"]),
]
#: Hosts of repositories, bidirectional marks, zero-width characters, spaces that become plain ones.
HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]
BIDI = "\u202d\u202e\u061c\u200e\u200f"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
SPACES = "\u00a0\u2009\u202f"


def any_of(c: Column, parts: list[str]) -> Column:
    """Does the text contain one of the parts?"""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def first_group(c: Column, groups: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first group of which the text contains a part."""
    out = None
    for name, parts in groups:
        out = F.when(any_of(c, parts), name) if out is None else out.when(any_of(c, parts), name)
    return out.otherwise(default)


def failure_kind(message: Column) -> Column:
    return F.when(F.coalesce(message, F.lit("")) == "", "SYSTEM_ERROR").otherwise(first_group(F.lower(message), FAILURE_KINDS, "SYSTEM_ERROR"))


def retry_kind(message: Column) -> Column:
    return F.when(message.isNull(), "unknown").otherwise(first_group(F.lower(message), RETRY_KINDS, "unknown"))


def error_code(message: Column, component: Column) -> Column:
    """component + suffix of the first keyword group; case matters."""
    return F.concat(component, first_group(message, ERROR_SUFFIXES, "_processing_failure"))


def is_quota_failure(message: Column) -> Column:
    return F.coalesce(any_of(F.lower(message), QUOTA_SIGNS), F.lit(False))


def is_rate_limited(message: Column) -> Column:
    return F.coalesce(any_of(F.lower(message), RATE_SIGNS), F.lit(False))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    """Last folder of a path; '' at the top."""
    return F.regexp_extract(path, r"(?:^|/)([^/]+)/[^/]*$", 1)


def is_test_file(path: Column) -> Column:
    return any_of(F.lower(base_name(path)), TEST_NAME_PARTS) | F.lower(folder_name(path)).isin(TEST_FOLDERS)


def in_skipped_folder(path: Column) -> Column:
    """Does the path go through a folder that is not walked?"""
    return F.size(F.array_intersect(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))) > 0


def extension_language(path: Column) -> Column:
    """Language by extension, null for an unknown one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGES.items() for x in kv]), F.when(ext != "", ext))


def words(text: Column) -> Column:
    """Number of parts between white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def is_code_like(text: Column) -> Column:
    """Two signs of code, or over 50 characters with more than 15 % specials."""
    low = F.lower(text)
    signs = reduce(lambda a, b: a + b, [low.contains(s).cast("int") for s in CODE_SIGNS])
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s]", ""))
    return (signs >= 2) | ((F.length(text) > 50) & (special > 0.15 * F.length(text)))


def token_estimate(text: Column) -> Column:
    """Words times 1.3 (1.6 for code), within half and three times the words; letters / 4 for a text without words."""
    w = words(text)
    tenths = F.when(is_code_like(text), 16).otherwise(13)
    guess = F.floor(w * tenths / 10).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", 0).when(w == 0, 0).otherwise(F.greatest(F.greatest(F.lit(1), F.floor(w / 2).cast("int")), F.least(guess, w * 3)))


def visibility(name: Column, language: Column, construct: Column) -> Column:
    """Public or private by the convention of the language.

    Go: a capital first letter is public. Python functions: a leading underscore is private; Python variables likewise, but dunder
    names are public. Others: a leading # or _ is private.
    """
    lead = F.substring(name, 1, 1)
    dunder = name.startswith("__") & name.endswith("__")
    lang = F.lower(language)
    private = (
        F.when(lang == "go", ~name.rlike("^[A-Z]"))
        .when((lang == "python") & (construct == "variable"), (lead == "_") & ~dunder)
        .when(lang == "python", lead == "_")
        .otherwise(lead.isin("#", "_"))
    )
    return F.when(private, "private").otherwise("public")


def clean_identifier(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "")


def stored_url(url: Column) -> Column:
    """The simple normal form of stored URLs: lower case, no .git at the end, no trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"\.git/?$", ""), "/+$", "")


def normal_url(url: Column, hosts: list[str] | None = None) -> Column:
    """The full normal form of a repository URL, null if it isn't acceptable: http or https, a known host, no '..', owner and name.

    Slashes are cut before the .git suffix, so 'x/.git' keeps a slash; '+' decodes to a blank.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    p = F.lower(F.coalesce(F.try_url_decode(path), path))
    p = F.regexp_replace(p, "/+$", "")
    p = F.regexp_replace(p, r"\.git$", "")
    p = F.replace(p, F.lit("/-"), F.lit("-"))
    ok = scheme.isin("http", "https") & host.isin(hosts or HOSTS) & ~p.contains("..") & (F.size(F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")) >= 2)
    return F.when(ok, F.concat(F.lit("https://"), host, p))


def plain_unicode(text: Column) -> Column:
    """Without bidirectional marks and zero-width characters, other spaces as plain ones."""
    return F.translate(text, SPACES + BIDI + ZERO_WIDTH, "   ")


def glob_regex(glob: str) -> str:
    """* any run, ? one character, everything else literal; not anchored."""
    return "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+^${}[]()|\\" else c for c in glob)


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """(regex over a relative path, un-ignores?) of one line of an ignore file; ('', False) for blanks and comments."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return "", False
    negated = p.startswith("!")
    p = p[1:] if negated else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    rooted = p.startswith("/") or "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/.*$" if folder else "(?:/.*)?$"), negated


def is_ignored(path: Column, lines: list[str]) -> Column:
    """Does an ignore file exclude the path? The last matching line decides."""
    out = F.lit(False)
    for line in lines:
        rx, negated = ignore_regex(line)
        if rx:
            out = F.when(path.rlike(rx), F.lit(not negated)).otherwise(out)
    return out


def has_control_characters(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def looks_like_script(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(r"<\s*/?\s*script|javascript\s*:|vbscript\s*:|\bon[a-z]+\s*=|<\s*(?:iframe|object|embed)\b|&#x?[0-9a-f]+;|\\x[0-9a-f]{2}")


def looks_like_sql(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(r"\b(?:select|insert|update|delete|drop|union|exec|alter|create)\s|--|/\*|\*/|'[^']*'|union\s+select")


def looks_like_traversal(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(r"\.\.[/\\]|%2e%2e(?:%2f|%5c|/|\\)|\.\.%2f|\.\.%5c")


def risk_level(text: Column) -> Column:
    """HIGH for script or SQL, MEDIUM for traversal or control characters, else LOW; also after one and two URL decodings."""
    once = F.coalesce(F.try_url_decode(text), text)
    twice = F.coalesce(F.try_url_decode(once), once)
    forms = (text, once, twice)
    high = reduce(lambda a, b: a | b, [looks_like_script(t) | looks_like_sql(t) for t in forms])
    medium = reduce(lambda a, b: a | b, [looks_like_traversal(t) for t in forms]) | has_control_characters(text)
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def line_count(text: Column) -> Column:
    """0 for an empty text, else one more than its line ends."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def code_similarity(a: Column, b: Column) -> Column:
    """Shared parts between underscores, of the text before a colon in lower case: common of the first over the union."""
    x, y = (F.split(F.substring_index(F.lower(c), ":", 1), "_") for c in (a, b))
    common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    return F.try_divide(common, F.size(x) + F.size(y) - common)
