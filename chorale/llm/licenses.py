"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame functions only.

Units are compared with templates: each line of a text (a header or notice) and the text as a whole (a licence file). Those that
have none of the words that a cosine of COSINE takes, by the weights of the templates' words, are left out first. A unit's vector has tf * idf for each word; idf counts the documents that have the word over all
documents, words that no template has get the idf of a word seen nowhere. Equal units are compared once. A text's own licence is
that of its best unit, if the cosine is at least COSINE. A licence file, which is one by its file name or because the whole text
is close to a template, stands for its directory; a text without its own licence inherits from the nearest directory above it
that has a licence file, found by joining the ancestors of distinct directories to the directories of licence files.

Defined results: null and empty texts have no licence of their own; a null path is the root directory; of licences that tie, the
first in alphabetical order counts, in a directory too; rows that are repeated get the same result each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import documents, small, table

COSINE = 0.6
#: From this cosine on, a whole text counts as a licence file whatever its name.
WHOLE = 0.85
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([._-].*)?$"

#: Short notices by which licences are declared in headers and licence files.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."],
    "ARR": ["Copyright. All rights reserved.", "All rights reserved."],
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def needed_words(weights: list[tuple[int, str, float]], cosine: float) -> list[str]:
    """Words of which a unit has one if its cosine to some template is at least that; weights(t, word, t_w) of unit length.

    The cosine is at most the length of the template's vector on the words in common (Cauchy-Schwarz). So a template's words of
    least weight may be passed over, as long as their length stays below; the others, the rarest, are needed.
    """
    of: dict[int, list[tuple[float, str]]] = {}
    for t, word, w in weights:
        of.setdefault(t, []).append((w, word))
    out = set()
    for words_of in of.values():
        length = 0.0
        for w, word in sorted(words_of):
            length += w * w
            if length >= (cosine - 1e-6) ** 2:  # scores are rounded to six digits
                out.add(word)
    return sorted(out)


def templates(spark: SparkSession) -> DataFrame:
    """license, t (number) and text of each template."""
    listed = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
    row = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(i).alias("t"), F.lit(text).alias("text")) for i, (name, text) in enumerate(listed)])
    return spark.range(1).select(F.explode(row).alias("x")).select("x.*")


def document_counts(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """word, df (documents that have it) of the templates' words, and n (documents)."""
    known = F.array(*map(F.lit, vocabulary))
    seen = df.select(F.explode_outer(F.array_intersect(words(F.coalesce("text", F.lit(""))), known)).alias("word"))
    return seen.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def licenses(df: DataFrame, path: str = "path", cosine: float = COSINE) -> DataFrame:
    """df(doc_id, text, path) -> doc_id, path, own_license, own_score, license, origin, inherited_from."""
    spark = df.sparkSession
    given = templates(spark)
    t_words = given.select("license", "t", F.explode(words(F.col("text"))).alias("word")).groupBy("license", "t", "word").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = sorted({w for texts in TEMPLATES.values() for text in texts for w in _plain_words(text)})  # bounded by the templates
    n = df.count()
    counts = table(document_counts(df, vocabulary))
    idf = lambda seen: F.log(F.lit(1.0 + n) / (1.0 + seen)) + 1.0
    weights = t_words.join(counts, "word", "left").withColumn("w", F.col("tf") * idf(F.coalesce("df", F.lit(0))))
    norms = weights.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    weights = table(weights.join(norms, "t").select("license", "word", "t", (F.col("w") / F.col("t_norm")).alias("t_w")))

    needed = F.array(*map(F.lit, needed_words([tuple(r) for r in weights.select("t", "word", "t_w").collect()], cosine)))  # bounded by the templates
    may_match = lambda unit: F.arrays_overlap(words(unit), needed)

    # (unit, whole) of each text that may match; equal units are compared once
    place = F.coalesce(F.col(path), F.lit(""))
    docs = df.where(may_match(F.col("text"))).select("doc_id", place.alias("path"), "text")
    lines = docs.select("doc_id", "path", F.explode(F.split("text", "\n")).alias("unit"), F.lit(False).alias("whole")).where(may_match(F.col("unit")))
    units = lines.unionByName(docs.select("doc_id", "path", F.col("text").alias("unit"), F.lit(True).alias("whole"))).withColumn("u", F.sha2("unit", 256))
    units = table(units)
    terms = units.groupBy("u").agg(F.min("unit").alias("unit")).select("u", F.explode(words(F.col("unit"))).alias("word")).groupBy("u", "word").agg(F.count(F.lit(1)).alias("tf"))
    terms = table(terms.join(F.broadcast(counts), "word", "left").select("u", "word", (F.col("tf") * idf(F.coalesce("df", F.lit(0)))).alias("w")))  # counts: a row for each template word at most
    unit_norms = terms.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(F.broadcast(weights), "word").groupBy("u", "license", "t").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))  # weights: the templates
    best = dots.join(unit_norms, "u").select("u", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= cosine)
    best = best.groupBy("u").agg(F.max_by("license", F.struct("score", _reverse("license"))).alias("license"), F.max("score").alias("score"))
    scored = units.join(best, "u").select("doc_id", "path", "whole", "license", "score")
    scored = table(scored)
    own = scored.groupBy("doc_id", "path").agg(F.max_by("license", F.struct("score", _reverse("license"))).alias("own_license"), F.max("score").alias("own_score"))

    files = scored.where((F.col("whole") & (F.col("score") >= WHOLE)) | F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAME))
    files = table(files.select(directory(F.col("path")).alias("dir"), "license", "score").groupBy("dir").agg(F.max_by("license", F.struct("score", _reverse("license"))).alias("dir_license")))
    n_files = files.count()
    dirs = df.select(directory(F.col(path)).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))).alias("up")).distinct()
    nearest = above.join(small(files.withColumnRenamed("dir", "up"), n_files), "up").groupBy("dir").agg(F.max_by("dir_license", F.length("up")).alias("dir_license"), F.max_by("up", F.length("up")).alias("inherited_from"))
    nearest = table(nearest)
    n_near, n_own = nearest.count(), own.count()
    mine = own.select(F.col("doc_id").alias("o_id"), F.col("path").alias("o_path"), "own_license", "own_score")
    every = df.select("doc_id", place.alias("path")).withColumn("dir", directory(F.col("path")))
    every = every.join(small(mine, n_own), F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("path") == F.col("o_path")), "left").join(small(nearest, n_near), "dir", "left")
    inherits = F.col("own_license").isNull() & F.col("dir_license").isNotNull()
    return every.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("inherited_from")).alias("inherited_from"),
    )


def _plain_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _reverse(column: str) -> Column:
    """Orders names backwards, so that the first in alphabetical order wins a tie of maxima."""
    return F.transform(F.split(column, ""), lambda c: -F.ascii(c))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path; source and language stand for the directories that a document lies in."""
    docs = documents(spark, sf_dir)
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return licenses(docs.select("doc_id", "text", path.alias("path")))


_SAID = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
_VALUES = ", ".join("('{}', {}, '{}')".format(name, i, text.replace("'", "''")) for i, (name, text) in enumerate(_SAID))
_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ORACLE = {
    "op5_license_scan": f"""
        with docs as (select doc_id, text, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(doc_id::varchar, '-')) as path from documents),
        tpl as (select * from (values {_VALUES}) v(license, t, txt)),
        tw as (select license, t, word, count(*) as tf from (select license, t, unnest({_WORDS.format("txt")}) as word from tpl) group by all),
        seen as (select word, count(*) as df from (select unnest(list_distinct({_WORDS.format("coalesce(text, '')")})) as word from docs) where word in (select word from tw) group by word),
        total as (select count(*)::double as n from docs),
        tv as (select license, t, word, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) as w from tw left join seen using (word), total),
        tn as (select license, t, word, w / sqrt(sum(w * w) over (partition by t)) as t_w from tv),
        lic as (select doc_id, path, text from docs where text is not null),
        units as (select doc_id, path, unit, false as whole from (select doc_id, path, unnest(string_split(text, chr(10))) as unit from lic)
                  union all select doc_id, path, text, true from lic),
        terms as (select unit, word, count(*) as tf from (select unit, unnest({_WORDS.format("unit")}) as word from (select distinct unit from units)) group by all),
        uv as (select unit, word, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) as w from terms left join seen using (word), total),
        un as (select unit, sqrt(sum(w * w)) as norm from uv group by unit),
        cos as (select unit, license, round(sum(w * t_w) / any_value(norm), 6) as score from uv join tn using (word) join un using (unit) group by unit, license, t),
        best as (select unit, license, score from (select *, row_number() over (partition by unit order by score desc, license) as r from cos where score >= {COSINE}) where r = 1),
        scored as (select doc_id, path, whole, license, score from units join best using (unit)),
        own as (select doc_id, path, license as own_license, score as own_score from (select *, row_number() over (partition by doc_id, path order by score desc, license) as r from scored) where r = 1),
        files as (select dir, license from (select regexp_replace(path, '/?[^/]*$', '') as dir, license, row_number() over (partition by regexp_replace(path, '/?[^/]*$', '') order by score desc, license) as r from scored where whole and score >= {WHOLE}) where r = 1),
        dirs as (select distinct regexp_replace(path, '/?[^/]*$', '') as dir from docs),
        near as (select dir, license as dir_license, up from (select d.dir, f.license, f.dir as up, row_number() over (partition by d.dir order by length(f.dir) desc) as r from dirs d join files f on f.dir = '' or d.dir = f.dir or starts_with(d.dir, f.dir || '/')) where r = 1)
        select d.doc_id, d.path, own_license, own_score, coalesce(own_license, dir_license) as license,
               case when own_license is not null then 'own' when dir_license is not null then 'inherited' end as origin,
               case when own_license is null and dir_license is not null then up end as inherited_from
        from docs d left join own o on d.doc_id = o.doc_id and d.path = o.path left join near n on n.dir = regexp_replace(d.path, '/?[^/]*$', '')"""
}
QUERIES = {"op5_license_scan": op5_license_scan}
