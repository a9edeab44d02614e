"""Functions on program texts and files: language, binary content, documentation, calls, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First lines that name an interpreter.
SHEBANGS = [
    ("Python", r"^#!/usr/bin/env python"),
    ("Python", r"^#!/usr/bin/python"),
    ("JavaScript", r"^#!/usr/bin/env node"),
    ("Ruby", r"^#!/usr/bin/env ruby"),
    ("Ruby", r"^#!/usr/bin/ruby"),
    ("PHP", r"^#!/usr/bin/env php"),
    ("PHP", r"^#!/usr/bin/php"),
    ("Shell", r"^#!/bin/bash"),
    ("Shell", r"^#!/bin/sh"),
    ("Shell", r"^#!/usr/bin/env bash"),
]
#: Contents by language. They are tried from the first on, which is a choice made here: markup and what only one language has come first,
#: patterns that several languages share come last.
CONTENTS = [
    ("PHP", r"<\?php"),
    ("XML", r"<\?xml\s+version"),
    ("XML", r"<\w+\s*xmlns"),
    ("HTML", r"<html\b"),
    ("HTML", r"<!DOCTYPE\s+html"),
    ("HTML", r"<div\b"),
    ("C++", r"#include\s*<iostream>"),
    ("C++", r"using\s+namespace\s+std"),
    ("C++", r"std::"),
    ("C", r"#include\s*<\w+\.h>"),
    ("C", r"int\s+main\s*\("),
    ("C", r"printf\s*\("),
    ("Java", r"public\s+class\s+\w+"),
    ("Java", r"public\s+static\s+void\s+main"),
    ("Java", r"import\s+java\.\w+"),
    ("Rust", r"fn\s+\w+\s*\("),
    ("Rust", r"use\s+\w+::"),
    ("Rust", r"let\s+mut\s+\w+"),
    ("Go", r"package\s+\w+"),
    ("Go", r"func\s+\w+\s*\("),
    ("Go", r"import\s*\(\s*\".*\"\s*\)"),
    ("TypeScript", r"interface\s+\w+\s*\{"),
    ("TypeScript", r"type\s+\w+\s*="),
    ("TypeScript", r":\s*(string|number|boolean)"),
    ("Python", r"def\s+\w+\s*\("),
    ("Python", r"from\s+\w+\s+import"),
    ("Python", r"import\s+\w+"),
    ("Python", r"if\s+__name__\s*==\s*[\"']__main__[\"']"),
    ("JavaScript", r"function\s+\w+\s*\("),
    ("JavaScript", r"const\s+\w+\s*="),
    ("JavaScript", r"let\s+\w+\s*="),
    ("JavaScript", r"var\s+\w+\s*="),
    ("JavaScript", r"=>\s*\{"),
    ("Ruby", r"def\s+\w+"),
    ("Ruby", r"require\s+['\"].*['\"]"),
    ("Ruby", r"class\s+\w+\s*<"),
    ("JSON", r"^\s*\{\s*\"\w+\""),
    ("JSON", r"^\s*\[\s*\{"),
    ("CSS", r"\w+\s*\{\s*[\w-]+:"),
    ("CSS", r"@media\s+"),
    ("SQL", r"SELECT\s+.*\s+FROM"),
    ("SQL", r"CREATE\s+TABLE"),
    ("YAML", r"^\w+:\s*$"),
    ("YAML", r"^\s*-\s+\w+:"),
    ("Markdown", r"^#\s+\w+"),
    ("Markdown", r"\*\*\w+\*\*"),
    ("PHP", r"\$\w+\s*="),
    ("C++", r"class\s+\w+\s*\{"),
]
#: Extensions of binary files.
BINARY_EXTENSIONS = (
    "exe dll so dylib bin obj o class jar zip tar gz bz2 xz 7z rar war ear jpg jpeg png gif bmp tiff tga ico svg webp avif heic raw psd ai eps"
    " mp3 wav flac ogg aac m4a wma mp4 avi mkv mov wmv flv webm m4v pdf doc docx xls xlsx ppt pptx odt ods odp ttf otf woff woff2 eot db sqlite sqlite3 mdb accdb wasm deb rpm dmg iso img vhd vmdk"
).split()
#: First bytes of binary files (ELF, JPEG, PNG, ZIP, PDF, RAR, DOS executable).
SIGNATURES = ["7F454C46", "FFD8FF", "89504E47", "504B0304", "25504446", "52617221", "4D5A"]
#: Words before a bracket that are no calls.
NOT_CALLED = ["if", "for", "while", "switch", "return", "func", "function", "def", "class", "catch", "elif", "else", "and", "or", "not", "in"]


def detected_language(path: Column, content: Column, by_extension: Column, hint: Column | None = None) -> tuple[Column, Column]:
    """(language, confidence): by extension .95, first line .90, content .80, a hint (a language's name) .75; null and 0 if nothing tells. Content patterns are
    tried in a fixed order."""
    head = F.substring_index(content, "\n", 1)
    shebang = content_lang = None
    for lang, rx in SHEBANGS:
        shebang = F.when(head.rlike(rx), lang) if shebang is None else shebang.when(head.rlike(rx), lang)
    for lang, rx in CONTENTS:
        content_lang = F.when(content.rlike(rx), lang) if content_lang is None else content_lang.when(content.rlike(rx), lang)
    told = F.lit(None).cast("string") if hint is None else F.when(F.trim(hint) != "", F.trim(hint))
    confidence = F.when(by_extension.isNotNull(), 0.95).when(shebang.isNotNull(), 0.90).when(content_lang.isNotNull(), 0.80).when(told.isNotNull(), 0.75).otherwise(0.0)
    return F.coalesce(by_extension, shebang, content_lang, told), confidence


def html_languages(content: Column) -> Column:
    """Languages inside an HTML text: itself, scripts and styles."""
    has = lambda rx, name: F.when(content.rlike(rx), name)
    return F.array_compact(F.array(has(r"(?i)<html\b|<!doctype\s+html|<div\b|<body\b", "HTML"), has(r"(?i)<script\b", "JavaScript"), has(r"(?i)<style\b", "CSS")))


def has_binary_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(BINARY_EXTENSIONS)


def has_signature(content: Column) -> Column:
    """Do the bytes start as those of a known binary format?"""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(False)
    for s in SIGNATURES:
        out = out | head.startswith(s)
    return out


def is_binary(path: Column, content: Column) -> Column:
    """By extension, by first bytes, by a NUL in the first 512 bytes, or by over 30 % bytes outside printable ASCII, tab and line ends in the first 1024."""
    hexed = F.hex(F.substring(content, 1, 1024))
    n = F.octet_length(F.substring(content, 1, 1024))
    # pairs of hexadecimal digits, anchored on pairs by a separator
    pairs = F.regexp_replace(hexed, "(..)", "$1 ")
    odd = F.regexp_count(pairs, F.lit("(?:[01][0-9A-F]|[89A-F][0-9A-F]|7F) ")) - F.regexp_count(pairs, F.lit("(?:09|0A|0D) "))
    nul = F.regexp_count(F.substring(pairs, 1, 1536), F.lit("00 ")) > 0
    return has_binary_extension(path) | F.coalesce(has_signature(content) | nul | (odd > 0.3 * n), F.lit(False))


#: First bytes that the test of a stream of files knows (ELF, JPEG, PNG, ZIP, PDF, RAR).
STREAM_SIGNATURES = ["7F454C46", "FFD8FF", "89504E47", "504B0304", "25504446", "52617221"]


def is_binary_stream(content: Column) -> Column:
    """The second test, on bytes alone: a NUL in the first 512, a known start in at least 4 bytes, or over 30 % of the first 1024 outside printable ASCII, tabs
    and line ends counted as such too. Null gives null, no bytes false."""
    hexed = F.hex(F.substring(content, 1, 1024))
    pairs = F.regexp_replace(hexed, "(..)", "$1 ")
    odd = F.regexp_count(pairs, F.lit("(?:[01][0-9A-F]|[89A-F][0-9A-F]|7F) "))
    nul = F.regexp_count(F.substring(pairs, 1, 1536), F.lit("00 ")) > 0
    known = F.lit(False)
    for x in STREAM_SIGNATURES:
        known = known | F.startswith(hexed, F.lit(x))
    return nul | (known & (F.octet_length(content) >= 4)) | (odd > 0.3 * F.octet_length(F.substring(content, 1, 1024)))


def fnv32a(text: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, null for null."""
    t = F.col(text) if isinstance(text, str) else text
    bytes_ = F.split(F.trim(F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "$1 ")), " ")
    step = lambda h, b: ((h.bitwiseXOR(F.conv(b, 16, 10).cast("long"))) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.octet_length(t) == 0, F.lit(2166136261)).otherwise(F.aggregate(bytes_, F.lit(2166136261).cast("long"), step)).cast("long")


def doc_details(text: Column) -> Column:
    """Lines of a documentation text behind its first blank line that are no tags, trimmed and joined; '' if there are none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    first = F.array_position(lines, "")
    rest = F.when(first > 0, F.slice(lines, first.cast("int") + 1, F.size(lines))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.filter(rest, lambda x: (x != "") & ~x.startswith("@")), "\n")


#: Words that can't be identifiers.
GO_RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
PYTHON_RESERVED = "False None True and as assert break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()


def valid_identifier(name: Column, language: Column) -> Column:
    """Not empty, no digit first, and not reserved in Go or Python."""
    lang = F.lower(F.coalesce(language, F.lit("")))
    reserved = ((lang == "go") & name.isin(GO_RESERVED)) | ((lang == "python") & name.isin(PYTHON_RESERVED))
    return (name != "") & ~name.rlike("^[0-9]") & ~reserved


def shared_count(first: Column, second: Column) -> Column:
    """How many entries of the second array are in the first one, repetitions counted."""
    return F.size(F.filter(second, lambda x: F.array_contains(first, x)))


def name_candidates(name: Column) -> Column:
    """A repository's name as it is, and without its host where it has three parts or more."""
    parts = F.split(name, "/", 3)
    return F.when(F.size(parts) == 3, F.array(name, F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))).otherwise(F.array(name))


def doc_summary(text: Column) -> Column:
    """First line of a documentation text that is neither blank nor a tag, '' if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), F.lit(1)), F.lit(""))


def doc_tags(text: Column) -> Column:
    """Array of (name, value) of the lines '@name value'."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^@\S+ "))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^@(\S+) ", 1).alias("name"), F.regexp_replace(x, r"^@\S+ ", "").alias("value")))


def struct_tags(text: Column) -> Column:
    """Array of (name, args) of field tags: name:"a,b"."""
    names, values = F.regexp_extract_all(text, F.lit(r'(\w+):"([^"]*)"'), F.lit(1)), F.regexp_extract_all(text, F.lit(r'(\w+):"([^"]*)"'), F.lit(2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), F.transform(F.split(v, ","), lambda x: F.trim(x)).alias("args")))


def called_names(content: Column) -> Column:
    """Names before an opening bracket, per blank-separated word: the part after the first dot if there is one; keywords are no calls."""
    parts = F.filter(F.split(content, r"\s+"), lambda w: w.contains("("))
    heads = F.transform(parts, lambda w: F.substring_index(w, "(", 1))
    names = F.transform(heads, lambda h: F.when(h.contains("."), F.element_at(F.split(h, r"\."), 2)).otherwise(h))
    return F.filter(names, lambda n: n.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~n.isin(NOT_CALLED))


def similar_names(a: Column, b: Column) -> Column:
    """Do names share, in any case, half the shorter one's length at the front or at the end? Names under 3 characters never do."""
    n = F.least(F.length(a), F.length(b))
    half = F.floor(n / 2).cast("int")
    x, y = F.lower(a), F.lower(b)
    return F.coalesce((n >= 3) & ((F.left(x, half) == F.left(y, half)) | (F.right(x, half) == F.right(y, half))), F.lit(False))


def compatible(version: Column, wanted: str) -> Column:
    """Is a schema version the wanted one or a revision of it?"""
    return (version == wanted) | version.startswith(wanted + ".")


def request_key(chunk_id: Column) -> Column:
    """Key of a batch request line: chunk_ and the id without hyphens."""
    return F.concat(F.lit("chunk_"), F.replace(chunk_id, F.lit("-"), F.lit("")))


def chunk_of_key(key: Column) -> Column:
    """The chunk id of a batch request key, null for another key."""
    rx = "^chunk_([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$"
    return F.when(key.rlike(rx), F.regexp_replace(key, rx, "$1-$2-$3-$4-$5"))


def submodules(text: str) -> list[tuple[str, str, str]]:
    """(name, path, url) of a submodule file; entries without a path are left out."""
    out = []
    for m in re.finditer(r'\[submodule\s+"([^"]+)"\]([^\[]*)', text):
        fields = dict(re.findall(r"^\s*(\w+)\s*=\s*(.*?)\s*$", m.group(2), re.M))
        if fields.get("path"):
            out.append((m.group(1), fields["path"], fields.get("url", "")))
    return out


def python_parts(text: str) -> list[tuple[int, int]]:
    """Line ranges of a Python source cut at top-level definitions; what precedes the first one belongs to it, decorators to what they decorate."""
    lines = text.split("\n")
    starts = []
    for n, line in enumerate(lines):
        if re.match(r"(?:async\s+)?def\s|class\s", line):
            while n and lines[n - 1].startswith("@"):
                n -= 1
            starts.append(n)
    starts = [0, *starts[1:]] if starts else [0]
    return [(a + 1, b) for a, b in zip(starts, [*starts[1:], len(lines)])]
