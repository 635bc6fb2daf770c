"""Corpora from folders, and lint rules from TOML."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lint import Rule

_FIELDS = {"id", "description", "matcher", "unit", "pattern", "severity", "provenance", "category", "registers", "authors", "evidence"}


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified): all .md and .txt files under the folder but those below a name that starts with a dot; paths are relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), f"^{base}/", "")
    return files.select(relative.alias("path"), "content", F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(r"(^|/)\."))


def load_rules(source: str) -> list[Rule]:
    """Rules of a TOML text; unknown keys, repeated ids, other than regex matchers and values outside their vocabularies raise."""
    whole = tomllib.loads(source)
    if set(whole) - {"version", "rule"} or not whole.get("version"):
        raise ValueError("a rule set has a version and rules")
    out: list[Rule] = []
    for r in whole.get("rule", []):
        if set(r) - _FIELDS or r.get("matcher") != "regex" or r.get("unit") not in ("document", "paragraph"):
            raise ValueError(f"rule {r.get('id')}: unknown key, matcher or unit")
        if r["provenance"] == "derived" and not r.get("evidence"):
            raise ValueError(f"rule {r['id']}: a derived rule states its evidence")
        out.append(Rule(r["id"], r["severity"], r["pattern"], r["provenance"], r["category"], tuple(r.get("registers", ())), tuple(r.get("authors", ()))))
    if len({r.id for r in out}) != len(out):
        raise ValueError("a rule id is repeated")
    return out
