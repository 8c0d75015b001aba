"""License scan: sparse TF-IDF cosine of lines and whole files to templates, then inheritance by directory.

Lines, and windows of up to ``JOINED`` joined lines, are compared with templates of licence notices.
Weights are term counts times ln((1 + N) / (1 + documents with the term)) + 1, with document counts over
the whole corpus for terms of the templates; other terms weigh 1, what a term of every document weighs. A
window that reaches the threshold must hold an anchor: each template's heaviest terms, as many as
leave the others too light to reach it alone (Cauchy-Schwarz), so windows without one are left
out before they are made. A window of several lines counts where it is nearer to the template than
without its first and without its last line.

Whole files are compared with full licence texts in the same way. By the same inequality a
file must hold terms that carry the threshold's share of a template's square; others are not counted out.

A file's licence is that of its whole text, else its best notice. A file that is a licence text, or most of whose
words stand in notices, is a licence file of its directory. Files without a licence of their own inherit from the
nearest directory above that has one. Ancestors are joined for the distinct directories only.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import stored

#: Notices as they stand in headers and licence files. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.6
#: Full texts by licence, and the cosine from which a whole file is one of them.
TEXTS = {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
WHOLE = 0.8
#: Lines with words that are joined at most, and words of joined lines at most, about twice the longest notice.
JOINED = 6
JOINED_WORDS = 50
#: Share of a full text's square left to its lightest terms when files are looked for.
LIGHT = 0.3
#: Share of a file's words in matching lines from which it speaks for its directory.
LICENSE_FILE = 0.5

_SPLIT = "[^\\\\p{L}\\\\p{N}]+"


def terms_of(text: str) -> list[str]:
    """Terms of a template: runs of letters and digits, in lower case."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _terms(column: str):
    return F.expr(f"filter(split(lower({column}), '{_SPLIT}'), x -> x <> '')")


def _vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({t for text in templates.values() for t in terms_of(text)})


def weights(docs: DataFrame, templates: dict[str, str]) -> dict[str, float]:
    """The inverse document frequency of every term of the templates, over all rows of docs."""
    vocabulary = _vocabulary(templates)
    # A few thousand terms at most.
    known = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string"))
    held = docs.select(F.explode(F.array_distinct(_terms("text"))).alias("term")).join(known, "term")
    # At most one row for each term of the templates.
    rows = held.groupBy("term").count().unionByName(docs.select(F.lit("").alias("term")).groupBy("term").count()).collect()
    counts = {r["term"]: r["count"] for r in rows}
    n = counts.get("", 0)
    return {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}


def _vectors(templates: dict[str, str], idf: dict[str, float]) -> list[tuple[str, str, float]]:
    """(license, term, share) of the templates, each of length one."""
    out = []
    for name, text in sorted(templates.items()):
        own = terms_of(text)
        vector = {t: own.count(t) * idf[t] for t in set(own)}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        out += [(name, t, v / norm) for t, v in sorted(vector.items())]
    return out


def _cosines(terms: DataFrame, keys: list[str], templates: dict[str, str], idf: dict[str, float], threshold: float) -> DataFrame:
    """keys, license, cosine of every text and template that reach the threshold; terms has keys and one term a row."""
    spark = terms.sparkSession
    own = set(_vocabulary(templates))
    # A row for each term of a template.
    heavy = F.broadcast(spark.createDataFrame([(t, idf[t]) for t in sorted(own)], "term string, idf double"))
    table = F.broadcast(spark.createDataFrame(_vectors(templates, idf), "license string, term string, share double"))
    counted = terms.groupBy(*keys, "term").count().join(heavy, "term", "left")
    counted = counted.select(*keys, "term", (F.col("count") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    norm = counted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = counted.join(table, "term").groupBy(*keys, "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    return dot.join(norm, keys).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold).drop("dot", "norm")


def anchors(templates: dict[str, str], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms one of which stands in every line that reaches the threshold for some template."""
    out = set()
    for text in templates.values():
        terms = terms_of(text)
        square = {t: (terms.count(t) * idf[t]) ** 2 for t in set(terms)}
        total = left = sum(square.values())
        for t in sorted(square, key=lambda t: (-square[t], t)):
            if left < (threshold - 1e-9) ** 2 * total:
                break
            out.add(t)
            left -= square[t]
    return sorted(out)


def matched_lines(docs: DataFrame, idf: dict[str, float], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file, line, n_lines, parts, license, cosine of the windows of docs (file, text) that reach the threshold, with their best template.

    line counts lines with words, parts has (line, n_words) of each line. Ties between templates go to the first
    by name. Lines end at line feeds. Windows of several lines hold at most ``JOINED_WORDS`` words.
    """
    anchor = "|".join(anchors(templates, idf, threshold))
    held = f"(?iu)(?<![\\p{{L}}\\p{{N}}])({anchor})(?![\\p{{L}}\\p{{N}}])"
    line = lambda x: F.struct(F.filter(F.split(F.lower(x), _SPLIT.replace("\\\\", "\\")), lambda t: t != "").alias("words"), x.rlike(held).alias("hit"))
    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: F.size(x["words"]) > 0)
    files = docs.filter(F.col("text").rlike(held)).select("file", lines.alias("lines"))
    hits = files.select("file", "lines", F.explode(F.expr("filter(sequence(0, size(lines) - 1), i -> lines[i].hit)")).alias("i"))
    near = hits.selectExpr("file", f"greatest(0, i - {JOINED - 1}) as base", "i", f"slice(lines, greatest(0, i - {JOINED - 1}) + 1, {2 * JOINED - 1}) as near")
    # Each window is made at its first line with an anchor.
    starts = "filter(sequence(0, i - base), s -> not exists(slice(near, s + 1, i - base - s), x -> x.hit))"
    ends = f"sequence(i - base, least(size(near) - 1, s + {JOINED - 1}))"
    windows = near.select("file", "base", "near", F.explode(F.expr(f"flatten(transform({starts}, s -> transform({ends}, e -> struct(s, e))))")).alias("w"))
    windows = windows.selectExpr("file", "base + w.s as line", "w.e - w.s + 1 as n_lines", "slice(near, w.s + 1, w.e - w.s + 1) as near")
    windows = windows.selectExpr("file", "line", "n_lines", "transform(near, (x, i) -> struct(line + i as line, size(x.words) as n_words)) as parts", "flatten(near.words) as terms")
    windows = windows.filter(f"n_lines = 1 or size(terms) <= {JOINED_WORDS}")
    terms = windows.select("file", "line", "n_lines", "parts", F.explode("terms").alias("term"))
    scored = _cosines(terms, ["file", "line", "n_lines", "parts"], templates, idf, threshold)
    mine = "struct(line, n_lines, cosine as own, cast(null as double) as other, parts)"
    longer = [f"struct({at} as line, n_lines + 1 as n_lines, cast(null as double) as own, cosine as other, null as parts)" for at in ("line", "line - 1")]
    compared = scored.select("file", "license", F.explode(F.expr(f"array({mine}, {', '.join(longer)})")).alias("w")).select("file", "license", "w.*")
    best = compared.groupBy("file", "license", "line", "n_lines").agg(F.max("own").alias("cosine"), F.max("other").alias("other"), F.first("parts", True).alias("parts"))
    counts = best.filter("cosine > coalesce(other, 0)")
    order = {name: i for i, name in enumerate(sorted(templates))}
    ranked = counts.withColumn("rank", F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("license")))
    top = F.max_by(F.struct("license", "parts"), F.struct("cosine", F.expr("-rank"))).alias("best")
    return ranked.groupBy("file", "line", "n_lines").agg(top, F.max("cosine").alias("cosine")).select("file", "line", "n_lines", "best.parts", "best.license", "cosine")


def whole_files(docs: DataFrame, idf: dict[str, float], texts: dict[str, str] = TEXTS, threshold: float = WHOLE) -> DataFrame:
    """file, license, cosine of the files whose whole text reaches the threshold, with the best full text, ties to the first by name."""
    vectors, heavy, least = _vectors(texts, idf), [], []
    for name in sorted(texts):
        left = LIGHT
        squares = sorted((share * share, t) for license, t, share in vectors if license == name)
        for square, t in squares:
            left -= square
            if left < 0:
                heavy.append((name, t, square))
        light = sum(square for square, _ in squares) - sum(square for license, _, square in heavy if license == name)
        least.append((name, threshold**2 - light - 1e-9))
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(heavy, "license string, term string, square double"))
    bound = F.broadcast(spark.createDataFrame(least, "license string, least double"))
    held = docs.select("file", F.explode(F.array_distinct(_terms("text"))).alias("term")).join(table, "term")
    may = held.groupBy("file", "license").agg(F.sum("square").alias("held")).join(bound, "license").filter("held >= least")
    some = docs.join(stored(may.select("file").distinct(), "licence-files"), "file", "left_semi")
    scored = _cosines(some.select("file", F.explode(_terms("text")).alias("term")), ["file"], texts, idf, threshold)
    return scored.groupBy("file").agg(F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("license"), F.max("cosine").alias("cosine"))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, texts: dict[str, str] = TEXTS) -> DataFrame:
    """file, license, how, cosine, from_path for each row of files (file, path, text).

    how is ``own`` for a licence text or a notice in the file (its best lines, ties to the first), ``inherited`` for one of
    the nearest directory above, from_path, and null where there is none. A directory's
    licence is the one most of its licence files state, ties to the first by name. Paths are
    separated by slashes; a null path is the root, and so are empty ones. Null and empty
    texts have no notice. file identifies a row; rows of null file are given back without own
    notices, repeated rows stay. Other columns are not read. An empty table gives an empty result.
    """
    rows = files.select(F.col("file").cast("long").alias("file"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    idf = weights(rows, {f"{kind} {name}": text for kind, group in (("notice", templates), ("text", texts)) for name, text in group.items()})
    named = rows.filter("file is not null")
    found = stored(matched_lines(named, idf, templates, threshold), "licence-lines")
    whole = stored(whole_files(named, idf, texts), "licence-texts")
    notices = found.groupBy("file").agg(
        F.max_by(F.struct("license", "cosine"), F.struct("cosine", F.expr("-line"), F.expr("-n_lines"))).alias("notice"),
        F.expr("aggregate(array_distinct(flatten(collect_list(parts))), 0L, (n, p) -> n + p.n_words)").alias("in_notices"),
    )
    texted = whole.select("file", F.struct("license", "cosine").alias("text"))
    own = notices.join(texted, "file", "full").select("file", F.coalesce("text", "notice").alias("own"), "in_notices", F.col("text").isNotNull().alias("is_text"))
    size = F.coalesce(F.size(_terms("text")), F.lit(0))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    placed = stored(rows.select("file", folder.alias("folder"), size.alias("n_words")), "files").join(own, "file", "left")
    speaks = placed.filter(F.col("is_text") | (F.col("in_notices") >= LICENSE_FILE * F.col("n_words")))
    voted = speaks.groupBy("folder", F.col("own.license").alias("license")).count()
    stated = voted.groupBy("folder").agg(F.min_by("license", F.struct(-F.col("count"), F.col("license"))).alias("given"))
    depth = "size(split(folder, '/'))"
    above = F.expr(f"transform(sequence(0, {depth}), i -> array_join(slice(split(folder, '/'), 1, i), '/'))")
    folders = placed.select("folder").distinct().select("folder", F.explode(above).alias("above")).distinct()
    heard = folders.join(stated.withColumnRenamed("folder", "above"), "above")
    nearest = heard.groupBy("folder").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("near"))
    out = placed.join(nearest, "folder", "left")
    return out.select(
        "file",
        F.coalesce("own.license", "near.given").alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("how"),
        F.col("own.cosine").alias("cosine"),
        F.when(F.col("own").isNull(), F.col("near.above")).alias("from_path"),
    )
