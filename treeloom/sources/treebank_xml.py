"""Treebank XML: sentences of words with punctuation between them as mixed content."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, sent_id string, id long, form string, lemma string, gram string, head long, deprel string, is_punct boolean, is_ellipsis boolean"


def sentence_rows(s: ElementTree.Element) -> list[tuple]:
    """Tokens in order: words, and each visible character of the text between them; heads are renumbered to match."""
    rows: list[dict] = []

    def punct(text: str | None) -> None:
        rows.extend({"form": c, "word": None} for c in text or "" if not c.isspace())

    punct(s.text)
    for w in s.iter("W"):
        rows.append({"form": (w.text or "").strip(), "word": w})
        punct(w.tail)
    number = {r["word"].get("ID"): i for i, r in enumerate(rows, 1) if r["word"] is not None}
    out = []
    for i, r in enumerate(rows, 1):
        w = r["word"]
        if w is None:
            out.append((i, r["form"], r["form"], "PUNCT", None, "punct", True, False))
            continue
        hidden = r["form"] in ("", "FANTOM")
        root = w.get("DOM") == "_root"
        out.append((i, "_" if hidden else r["form"], (w.get("LEMMA") or "").lower() or None, w.get("FEAT"), 0 if root else number.get(w.get("DOM")), "root" if root else w.get("LINK"), False, hidden))
    return out


def read(spark: SparkSession, path: str, pattern: str = "*.tgt") -> DataFrame:
    """One row for each token of each file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                rows = [(file, s.get("ID") or str(i), *r) for i, s in enumerate(ElementTree.fromstring(content).iter("S"), 1) for r in sentence_rows(s)]
                frame = pd.DataFrame(rows, columns=["file", "sent_id", "id", "form", "lemma", "gram", "head", "deprel", "is_punct", "is_ellipsis"])
                yield frame.astype({"head": "Int64"})

    return files.mapInPandas(parse, SCHEMA)
