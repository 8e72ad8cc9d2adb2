"""Bibliography files: BibTeX text to one row per entry, attachments and names resolved."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

SCHEMA = "citekey string, item_type string, title string, authors array<struct<first:string,last:string>>, year string, doi string, url string, fields map<string,string>, file string, path string"
SKIPPED = ("comment", "string", "preamble")
OWN = ("title", "author", "year", "doi", "url", "file")


def split_name(name: str) -> tuple[str, str]:
    """(first, last): at the first comma, else at the last space; one word is a last name."""
    name = " ".join(name.split())
    if "," in name:
        last, first = name.split(",", 1)
        return first.strip(), last.strip()
    first, _, last = name.rpartition(" ")
    return first, last


def split_authors(field: str) -> list[dict[str, str]]:
    """Authors of a field, separated by the word and; blank ones left out."""
    return [dict(zip(("first", "last"), split_name(a), strict=True)) for a in re.split(r"\s+and\s+", field.strip()) if a.strip()]


def _value(text: str, at: int) -> tuple[str, int]:
    """A field's value from at on (braced, quoted or bare), and the place after it."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at >= len(text):
        return "", at
    if text[at] == "{":
        depth, s = 0, at + 1
        while at < len(text):
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
            if depth == 0:
                break
        return text[s : at - 1], at
    if text[at] == '"':
        s = at + 1
        at = text.find('"', s)
        at = len(text) if at < 0 else at
        return text[s:at], at + 1
    m = re.compile(r"[^,}\s]+").match(text, at)
    return (m.group(), m.end()) if m else ("", at + 1)


def entries(text: str) -> Iterator[dict]:
    """Entries of a BibTeX text; those without a usable key or without fields are left out."""
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}]*)\s*,", text):
        kind, key, at = m.group(1).lower(), m.group(2), m.end()
        if kind in SKIPPED or not key:
            continue
        fields: dict[str, str] = {}
        while True:
            f = re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=").match(text, at)
            if not f:
                break
            value, at = _value(text, f.end())
            fields[f.group(1).lower()] = " ".join(value.split())
        if fields:
            yield {
                "citekey": key,
                "item_type": kind,
                "title": fields.get("title") or "Untitled",
                "authors": split_authors(fields.get("author", "")),
                "year": fields.get("year") or "n.d.",
                "doi": fields.get("doi"),
                "url": fields.get("url"),
                "fields": {k: v for k, v in fields.items() if k not in OWN},
                "file": fields.get("file"),
            }


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", SCHEMA)]
    for b in batches:
        rows = [e | {"path": p} for p, t in zip(b["path"], b["value"], strict=True) for e in entries(t or "")]
        yield pd.DataFrame(rows, columns=columns)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of all .bib files of a path; entries whose key can't name a file are dropped."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = files.mapInPandas(_parse, SCHEMA)
    return rows.where(T.citekey_problem(F.col("citekey")).isNull())


def raw_entry_count(text: Column) -> Column:
    """Blocks of a text that look like entries, to be held against the number of parsed ones."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"@(\w+)\s*\{[^,}]*,\s*\w"), 1), lambda k: ~F.lower(k).isin(*SKIPPED)))


def reconcile(spark: SparkSession, path: str) -> DataFrame:
    """Files of which fewer entries were parsed than stand in them."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), raw_entry_count(F.col("value")).alias("raw"))
    parsed = read_library(spark, path).groupBy("path").agg(F.count("*").alias("parsed"))
    return raw.join(parsed, "path", "left").fillna(0, ["parsed"]).where("parsed < raw")


def attachment(file_field: Column) -> Column:
    """struct(path, resolution) of a field of description:path:type parts: the first PDF, or why there is none."""
    parts = F.filter(F.transform(F.split(file_field, ";"), lambda p: F.split(p, ":")), lambda p: F.size(p) >= 2)
    pdfs = F.filter(F.transform(parts, lambda p: F.element_at(p, 2)), lambda p: F.lower(p).endswith(".pdf"))
    path = F.get(pdfs, F.lit(0))
    why = F.when(file_field.isNull() | (F.trim(file_field) == ""), "no file field").when(F.size(parts) == 0, "malformed file field").when(path.isNull(), "non-PDF attachment only").otherwise("resolved")
    return F.struct(path.alias("path"), why.alias("resolution"))
