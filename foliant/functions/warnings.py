"""Warnings as templates ``prefix:slug_<placeholder>`` and the texts that come from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of typed placeholders.
PLACEHOLDERS = {"page": "\\d+", "index": "\\d+", "level": "\\d+", "count": "\\d+", "n": "\\d+", "id": "node_\\d+", "marker": "[\\w.\\-]+", "text": ".+"}


def pattern(template: str) -> str:
    """Anchored pattern of a template; an unknown placeholder is an error."""
    out = []
    for part in re.split("(<[^>]*>)", template):
        if part.startswith("<"):
            if part[1:-1] not in PLACEHOLDERS:
                raise ValueError(f"unknown placeholder {part} in {template}")
            out.append(f"({PLACEHOLDERS[part[1:-1]]})")
        else:
            out.append(re.escape(part))
    return f"^{''.join(out)}$"


def parse(warnings: DataFrame, templates: list[str]) -> DataFrame:
    """Warnings with the first template that fits and the values of its placeholders; none fits: null."""
    template, values = F.lit(None).cast("string"), F.array().cast("array<string>")
    for t in reversed(dict.fromkeys(templates)):
        p = pattern(t)
        n = len(re.findall("<[^>]*>", t))
        template = F.when(F.col("text").rlike(p), t).otherwise(template)
        values = F.when(F.col("text").rlike(p), F.array(*[F.regexp_extract("text", p, k + 1) for k in range(n)]).cast("array<string>")).otherwise(values)
    return warnings.withColumn("template", template).withColumn("values", values)


def ambiguous(templates: list[str], samples: list[str]) -> list[str]:
    """Samples that several templates fit."""
    return [s for s in samples if sum(bool(re.match(pattern(t), s)) for t in dict.fromkeys(templates)) > 1]


def drop_of_nodes(warnings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Warnings without those about given nodes (``doc_id, node_id``): an anti join on the id at their end."""
    named = warnings.withColumn("node_id", F.regexp_extract("text", "(node_\\d+)$", 1))
    return named.join(nodes.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti").drop("node_id")


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Warning tables one after the other, numbered anew within each document."""
    from functools import reduce

    from pyspark.sql.window import Window

    marked = [p.select("doc_id", "seq", "text", F.lit(k).alias("__part")) for k, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, marked)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("__part", "seq")) - 1).drop("__part")
