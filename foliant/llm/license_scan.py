"""Licence families of paragraphs: sparse n-gram logistic regression, a calibrated unknown class, and template comparison.

A paragraph is what stands between blank lines. It is read in passages of ``PASSAGE`` words, each half over the next, so a notice counts alike alone on a
line, wrapped over several, or inside prose. A multinomial logistic regression on the passage's word pairs and triples names its family or none;
its temperature and the least probability of a family are fitted on labelled passages that it wasn't trained on. A family is confirmed if one
of its templates stands in the passage to the share that tells it from the labelled negatives.

Training uses the small table below. The scan is built-in functions on each row by itself: no shuffle, no join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pinned

#: Templates: notices and opening sentences that public licences ask for, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "This software is licensed under the BSD License.",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons Attribution-ShareAlike License CC BY-SA 3.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
    ),
    "lgpl": (
        "Released under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
#: Sentences that speak of rights or use like words but name no licence of a family, or say that it doesn't hold.
OTHER: tuple[str, ...] = (
    "All rights reserved.",
    "Copyright 2020 by the authors.",
    "The license of the driver was checked by the police at the gate.",
    "Released under pressure, the steam moved the wheel.",
    "This work is the result of many years in the library.",
    "The software is used in schools and in public offices.",
    "Permission to enter the garden is given by the city.",
    "The general public was invited to the free concert.",
    "The conditions of the market are met with caution.",
    "Version 2 of the plan was released on Monday.",
    "Licensed under a proprietary agreement; redistribution is not allowed.",
    "This text is distributed under terms that the publisher sets.",
    "The above list is a copy of the notice on the door.",
    "He was granted, without charge, a place in the home.",
    "The foundation published the terms of the prize.",
    "Le texte est publié sous la responsabilité de l'auteur.",
    "Das Werk ist in vielen Sprachen erschienen.",
    "La obra se publica con permiso de la familia.",
)
#: What denies a notice, put before its verb.
DENIALS: tuple[str, ...] = ("not", "never", "no longer")
#: Sentences that examples stand in.
PROSE: tuple[str, ...] = (
    "the report of the harbour was read by two clerks and put in the file",
    "read more on the page of the authors of the library",
    "the source of the river is in the north and the valley is free of snow",
    "you can use the tool in the garden and in the house at any time",
    "it is distributed in the city and to any person who asks for a copy",
)
UNKNOWN = "unknown"
SIZES = (2, 3)
#: Words of a passage; the next one starts half as many on.
PASSAGE = 64
#: Words that name a family. Templates with other names in their place are negatives.
NAMES = {"affero", "apache", "bsd", "cc", "by", "nc", "sa", "creative", "commons", "sharealike", "noncommercial", "gnu", "lesser", "isc", "mit", "mozilla", "public"}
#: Most of the labelled negatives, not trained on, that may be taken for a family.
FALSE_ALARMS = 0.01
_SLOTS = 1 << 12


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams(words: list[str]) -> list[str]:
    """Distinct word n-grams."""
    return sorted({" ".join(words[i : i + n]) for n in SIZES for i in range(len(words) - n + 1)})


def examples() -> list[tuple[list[str], str]]:
    """Labelled passages: templates whole, shortened, and denied, each alone and in prose; other names in them, other sentences, prose."""
    out: list[tuple[str, str]] = [(x, UNKNOWN) for x in (*OTHER, *PROSE)]
    for family, lines in TEMPLATES.items():
        for line in lines:
            w = words_of(line)
            shorter = [" ".join(w[a : len(w) - b]) for a, b in ((1, 0), (0, 1), (2, 0), (0, 2)) if len(w) - a - b >= 4 and NAMES & set(w[a : len(w) - b]) == NAMES & set(w)]
            out += [(" ".join(x), family) for x in (w, *(s.split() for s in shorter))]
            if NAMES & set(w):
                out += [(" ".join("acme" if x in NAMES else x for x in w), UNKNOWN)] * 2
            if w[0] in ("released", "licensed"):
                out += [(f"{no} {' '.join(w)}", UNKNOWN) for no in DENIALS]
            elif "is" in w:
                at = w.index("is") + 1
                out += [(" ".join([*w[:at], *no.split(), *w[at:]]), UNKNOWN) for no in DENIALS]
    rows = []
    for k, (text, label) in enumerate(out):
        before, after = PROSE[k % len(PROSE)], PROSE[(k + 2) % len(PROSE)]
        around = f"{OTHER[k % len(OTHER)]} {text} {OTHER[(k + 5) % len(OTHER)]}"
        rows += [(grams(words_of(x)), label) for x in (text, f"{before} {text}", f"{before} {text} {after}", around)]
    return rows


@dataclass(frozen=True)
class Model:
    """Weights by n-gram and class; the temperature their sums are divided by; the least probability of a family."""

    classes: tuple[str, ...]
    grams: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, known: list[list[int]]) -> np.ndarray:
        """Class probabilities of passages, given as numbers of n-grams."""
        logits = np.array([(self.bias + self.weights[k].sum(axis=0)) / self.temperature for k in known])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[list[str], str]], rounds: int = 300, rate: float = 0.4, penalty: float = 1e-4) -> Model:
    """Logistic regression by gradient steps on the whole table, uncalibrated."""
    classes = (*TEMPLATES, UNKNOWN)
    names = tuple(sorted({g for gs, _ in rows for g in gs}))
    number = {g: k for k, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for k, (gs, _) in enumerate(rows):
        x[k, [number[g] for g in gs]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(label) for _, label in rows]]
    weights, bias = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    for _ in range(rounds):
        logits = x @ weights + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        step = y - p / p.sum(axis=1, keepdims=True)
        weights += rate * (x.T @ step / len(rows) * len(classes) - penalty * weights)
        bias += rate * step.mean(axis=0)
    return Model(classes, names, weights, bias, 1.0, 0.5)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.round(x.astype(np.float64), 6)


def calibrated(model: Model, rows: list[tuple[list[str], str]]) -> Model:
    """The model with the temperature of least log loss on ``rows``, and the least threshold that takes few enough negatives for a family."""
    number = {g: k for k, g in enumerate(model.grams)}
    known = [[number[g] for g in gs if g in number] for gs, _ in rows]
    own = np.array([model.classes.index(label) for _, label in rows])

    def loss(t: float) -> float:
        p = Model(model.classes, model.grams, model.weights, model.bias, t, 0.5).probabilities(known)
        return float(-np.log(np.maximum(p[np.arange(len(own)), own], 1e-12)).sum())

    best = min((2.0**k for k in np.arange(-4, 3.01, 0.25)), key=loss)
    out = Model(model.classes, model.grams, model.weights, model.bias, float(best), 0.5)
    p = out.probabilities(known)
    unknown = model.classes.index(UNKNOWN)
    family = np.sort((1 - p[:, unknown])[own == unknown])
    threshold = float(max(0.5, family[min(len(family) - 1, int((1 - FALSE_ALARMS) * len(family)))] + 1e-6))
    return Model(out.classes, out.grams, _rounded(out.weights), _rounded(out.bias), out.temperature, round(threshold, 6))


@lru_cache
def train() -> Model:
    """Trained on all labelled passages; calibrated by a model that saw four of five of them, on the fifth."""
    rows = examples()
    fitted = calibrated(fit([r for k, r in enumerate(rows) if k % 5]), rows[::5])
    whole = fit(rows)
    return Model(whole.classes, whole.grams, _rounded(whole.weights), _rounded(whole.bias), fitted.temperature, fitted.threshold)


@lru_cache
def templates() -> list[tuple[str, frozenset[str], int, frozenset[str], int]]:
    """Each template's family and n-grams, and how many of them a passage must hold: halfway between the other sentence in prose that holds the most and the whole
    template. Then its marks, the n-grams that no labelled negative has (templates of other families or with other names among them), and how many of those: half.
    """
    named = [(k, words_of(line)) for k, lines in TEMPLATES.items() for line in lines]
    in_prose = [set(grams([*words_of(PROSE[0]), *words_of(x), *words_of(PROSE[1])])) for x in OTHER]
    renamed = [set(grams(["acme" if x in NAMES else x for x in w])) for _, w in named if NAMES & set(w)]
    out = []
    for family, w in named:
        own = frozenset(grams(w))
        most = max(len(own & x) for x in in_prose)
        marks = own.difference(*in_prose, *renamed, *(grams(x) for k, x in named if k != family))
        out.append((family, own, -(-(len(own) + most) // 2), marks, -(-len(marks) // 2)))
    return out


@lru_cache
def cues() -> tuple[str, ...]:
    """Words without any of which no template reaches its share: of each template's n-grams, or of its marks, the words that stand in most, until too few are left without one."""
    common = {w for x in (*OTHER, *PROSE) for w in words_of(x)}
    out: set[str] = set()
    for _, own, need, marks, need_marks in templates():
        choices = []
        for grams_, least in ((own, need), (marks, need_marks)):
            new: set[str] = set()
            while len(left := [set(g.split()) for g in grams_ if not (out | new) & set(g.split())]) >= least:
                new.add(max({w for g in left for w in g}, key=lambda w: (w not in common and not w.isdigit() and len(w) > 2, sum(w in g for g in left), len(w), w)))
            choices.append(new)
        out |= min(choices, key=lambda x: (len(x), sorted(x)))
    return tuple(sorted(out))


def _table(values, kind: str) -> Column:
    """A constant array, read from text once for a plan."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


@lru_cache
def _lookup() -> tuple[list[int], list[int]]:
    """Hashes of the model's n-grams by slot (their hash modulo ``_SLOTS``), and where each slot starts."""
    signed = [h - (1 << 64) if (h := xxhash.xxh64_intdigest(g.encode(), seed=42)) >> 63 else h for g in train().grams]
    order = sorted(range(len(signed)), key=lambda k: (signed[k] % _SLOTS, k))
    slots = [signed[k] % _SLOTS for k in order]
    starts = np.searchsorted(slots, np.arange(_SLOTS + 1)).tolist()
    return order, [[signed[k] for k in order], starts]


def _numbers(gs: Column) -> Column:
    """Numbers (in the order of ``_lookup``) of an array's n-grams that the model has."""
    _, (hashes, starts) = _lookup()
    hashes, starts = _table(hashes, "bigint"), _table(starts, "int")

    def number(g: Column) -> Column:
        slot = F.pmod(F.xxhash64(g), F.lit(_SLOTS)).cast("int")
        at = F.array_position(F.slice(hashes, F.get(starts, slot) + 1, F.get(starts, slot + 1) - F.get(starts, slot)), F.xxhash64(g))
        return F.when(at > 0, F.get(starts, slot) + at.cast("int") - 1)

    return F.filter(F.transform(gs, number), lambda x: x.isNotNull())


def _neighbours(w: Column) -> Column:
    """Word pairs and triples of an array of words."""
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    # zip_with pads the shorter side with null, and what is concatenated with null is null
    pair = F.zip_with(w, rest(w), lambda a, b: F.concat(a, F.lit(" "), b))
    triple = F.zip_with(pair, rest(rest(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.array_compact(F.concat(pair, triple)))


def find_notices(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``notices``: for each passage with a cue, its paragraph, first word, likeliest class, probability of any family, and confirmed families.

    A passage has a ``family`` if the probability reaches the fitted threshold, else ``unknown``; ``confirmed`` are the families of templates that it holds, in the order of their places,
    if it isn't unknown. Null texts and texts without cues have none. Every column is kept; one named ``notices`` is replaced.
    """
    model, order = train(), _lookup()[0]
    classes, n_classes = model.classes, len(model.classes)
    weights = _table((repr(float(v)) for k in order for v in model.weights[k]), "double")
    by_gram: dict[str, list[int]] = {}
    n_templates = len(templates())
    for k, (_, own, _, marks, _) in enumerate(templates()):
        for g in own:
            by_gram.setdefault(g, []).extend([k, k + n_templates] if g in marks else [k])
    inside = [by_gram.get(model.grams[k], []) for k in order]
    inside_starts = np.concatenate(([0], np.cumsum([len(x) for x in inside]))).tolist()
    inside, inside_starts = _table((t for x in inside for t in x), "int"), _table(inside_starts, "int")
    cue = f"(?<![a-z0-9])(?:{'|'.join(cues())})(?![a-z0-9])"

    text = F.lower(F.col(text_col).cast("string"))
    out = docs.drop("notices").withColumn("__ps", F.when(text.rlike(cue), F.filter(F.transform(F.split(text, "\\n[ \\t\\r\\f]*\\n", -1), lambda p, i: F.struct(i.alias("paragraph"), p.alias("p"))), lambda x: x["p"].rlike(cue))))

    def passages(x: Column) -> Column:
        w = F.filter(F.split(x["p"], "[^a-z0-9]+", -1), lambda v: v != "")
        return F.struct(x["paragraph"].alias("paragraph"), w.alias("w"))

    def cut(x: Column) -> Column:
        half = PASSAGE // 2
        at = F.filter(F.transform(x["w"], lambda v, i: F.when(v.isin(*cues()), F.floor(i / half).cast("int"))), lambda v: v.isNotNull())
        # a passage starts at each half; the last start that still has words after its first half covers the end
        last = F.greatest(F.ceil(F.size(x["w"]) / half).cast("int") - 2, F.lit(0))
        starts = F.sort_array(F.array_distinct(F.flatten(F.transform(at, lambda k: F.filter(F.array(k, k - 1), lambda s: s.between(F.lit(0), last))))))
        return F.transform(starts, lambda s: F.struct(x["paragraph"].alias("paragraph"), (s * half).alias("first_word"), _numbers(_neighbours(F.slice(x["w"], s * half + 1, F.lit(PASSAGE)))).alias("known")))

    out = out.withColumn("__ps", pinned(F.transform("__ps", passages))).withColumn("__ps", pinned(F.flatten(F.transform("__ps", cut))))

    def weigh(x: Column) -> Column:
        total = lambda c: F.aggregate(x["known"], F.lit(0.0), lambda acc, k: acc + F.get(weights, k * n_classes + c))
        logits = [(F.lit(float(model.bias[c])) + total(c)) / F.lit(model.temperature) for c in range(n_classes)]
        held = F.flatten(F.transform(x["known"], lambda k: F.slice(inside, F.get(inside_starts, k) + 1, F.get(inside_starts, k + 1) - F.get(inside_starts, k))))
        return F.struct(x["paragraph"].alias("paragraph"), x["first_word"].alias("first_word"), F.array(*logits).alias("logits"), held.alias("held"))

    out = out.withColumn("__ps", pinned(F.transform("__ps", weigh)))

    def judge(x: Column) -> Column:
        top = F.array_max(F.slice(x["logits"], 1, n_classes - 1))
        most = F.array_max(x["logits"])
        z = F.aggregate(x["logits"], F.lit(0.0), lambda acc, v: acc + F.exp(v - most))
        p = F.lit(1.0) - F.exp(F.get(x["logits"], n_classes - 1) - most) / z
        family = F.when(p >= model.threshold, F.element_at(F.array(*map(F.lit, classes)), F.array_position(x["logits"], top).cast("int"))).otherwise(UNKNOWN)
        holds = lambda k, least: F.size(F.filter(x["held"], lambda t: t == k)) >= least
        # n-grams are in the order of the words, so a mark's place says which notice comes first
        found = F.array(*[F.when(holds(k, need) & holds(k + n_templates, need_marks), F.struct(F.array_position(x["held"], k + n_templates).alias("at"), F.lit(f).alias("family"))) for k, (f, _, need, _, need_marks) in enumerate(templates())])
        confirmed = F.when(p >= model.threshold, F.array_distinct(F.transform(F.array_sort(F.array_compact(found)), lambda f: f["family"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(x["paragraph"].alias("paragraph"), x["first_word"].alias("first_word"), family.alias("family"), p.alias("probability"), confirmed.alias("confirmed"))

    return out.withColumn("notices", F.coalesce(pinned(F.transform("__ps", judge)), F.array())).drop("__ps")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ``doc_id, license, licenses, n_notices, n_doubtful, first_paragraph``.

    ``licenses`` are the confirmed families, sorted, ``license`` the first one (null: none);
    ``n_notices`` counts passages with a confirmed family, ``n_doubtful`` those classified to a family but not confirmed. Null and empty texts have none. Each row is judged by
    itself: repeated rows alike, null ids too. Extra columns aren't read. An empty table gives no rows. A text of any length is read whole; the work grows with its
    passages that hold a cue.
    """
    found = find_notices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    sure = F.filter("notices", lambda x: F.size(x["confirmed"]) > 0)
    out = found.select("doc_id", pinned(sure).alias("sure"), pinned(F.size(F.filter("notices", lambda x: (x["family"] != UNKNOWN) & (F.size(x["confirmed"]) == 0)))).alias("d"))
    first = F.get("sure", 0)
    return out.select(
        "doc_id", F.get(first["confirmed"], 0).alias("license"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("sure", lambda x: x["confirmed"])))).alias("licenses"), F.size("sure").cast("long").alias("n_notices"),
        F.col("d").cast("long").alias("n_doubtful"), first["paragraph"].alias("first_paragraph"),
    )
