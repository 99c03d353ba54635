"""License scans by a positional index of rare words, with DataFrame functions only.

Templates are word sequences, from names of licences to whole notices. A first pass counts in how many documents each
of their words stands; the words' inverse document frequencies give their weights. Of each template the rarest words are
indexed, as many as weigh more than what a match may lack, so each match holds one of them. The scan looks up these words
in each file and turns every place into the start that the template would have (place less the word's position in it);
of a template that has to stand whole, starts by two words are intersected. The template is compared at these starts only:
the share of its weight that stands in place, and its mandatory key phrase. A file is a row of its own throughout, so
nothing but the word counts is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, texts

#: Words once A-Z is lower-cased; with A-Z in the class, the same runs in the text as it is.
WORD, ANY_CASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """share: of the words' weight that has to stand in place. key_words: so many words at the start are mandatory."""

    label: str
    phrase: str
    base: bool = False
    share: float = 1.0
    key_words: int = 0

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


# Public licences' notices, as their words.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
    "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall "
    "be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
)
ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
    "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness"
)
APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
    "basis without warranties or conditions of any kind either express or implied"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
    "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)

TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("cc-by", "creative commons attribution"),
    Template("proprietary", "all rights reserved"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", share=0.8, key_words=4),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", share=0.8, key_words=3),
    Template("apache", "licensed under the apache license version 2 0", share=0.8, key_words=5),
    Template("mit-text", MIT, share=0.8, key_words=4),
    Template("isc-text", ISC, share=0.8, key_words=4),
    Template("apache-notice", APACHE, share=0.8, key_words=5),
    Template("bsd-text", BSD, share=0.8, key_words=3),
)


def _in(w: Column, words: list[str]) -> Column:
    # lower() is fast on ASCII; ascii_lower() then tells, for the few words found, whether only A-Z differed
    return F.lower(w).isin(words) & ascii_lower(w).isin(words)


def word_weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """The inverse document frequency of each word of the templates, over all rows of docs. As many numbers come to
    the driver as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ANY_CASE), F.lit(0))
    own = F.array_distinct(F.transform(F.filter(words, lambda w: _in(w, vocabulary)), ascii_lower))
    counts = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in counts}
    return {w: round(math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1, 6) for w in vocabulary}


def anchors(template: Template, weight: dict[str, float]) -> list[int]:
    """Positions of the rarest words, as many as weigh more than a match may lack: it has one of them."""
    order = sorted(range(len(template.words)), key=lambda k: (-weight[template.words[k]], k))
    total, held, out = sum(weight[w] for w in template.words), 0.0, []
    for k in order:
        out.append(k)
        held += weight[template.words[k]]
        if held > (1 - template.share) * total + 1e-6 * total:
            return out
    return out


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found for each row of docs.

    found: array<struct<template int, start int, share double>>, the matches. score: the largest share (0 without any). A null
    text counts as empty: no words, empty labels, null places. Long texts are scanned whole. Rows are independent: repeated
    rows repeat, other columns are not looked at, an empty table gives no rows.
    """
    weight = word_weights(docs, templates)
    rarest = [anchors(t, weight) for t in templates]
    for k, t in enumerate(templates):
        if t.share >= 1 and len(t.words) > 1:  # two words, whose starts are intersected
            rarest[k] = sorted(range(len(t.words)), key=lambda j: (-weight[t.words[j]], j))[:2]
    rare = sorted({t.words[j] for t, js in zip(templates, rarest, strict=True) for j in js})
    rows = texts(docs).select("doc_id", F.regexp_extract_all("text", F.lit(ANY_CASE), F.lit(0)).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("places", F.array_compact(F.transform("words", lambda w, i: F.when(_in(w, rare), i))))
    rows = rows.withColumn("hits", F.transform("places", lambda i: F.struct(i.alias("i"), ascii_lower(F.get("words", i)).alias("w"))))

    def compared(k: int) -> Column:
        t, total = templates[k], sum(weight[w] for w in templates[k].words)
        own = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(weight[w]).alias("weight"), F.lit(j < t.key_words).alias("key")) for j, w in enumerate(t.words)))

        def starts_by(j: int) -> Column:
            return F.transform(F.filter("hits", lambda h: h["w"] == t.words[j]), lambda h: h["i"] - j)

        starts = [starts_by(j) for j in rarest[k]]
        starts = F.array_intersect(*starts) if t.share >= 1 and len(starts) == 2 else F.array_distinct(F.concat(*starts))
        starts = F.filter(starts, lambda s: (s >= 0) & (s + len(t.words) <= F.col("n")))

        def at(s: Column) -> Column:
            same = F.zip_with(F.slice("words", s + 1, F.lit(len(t.words))), own, lambda w, o: F.struct((ascii_lower(w) == o["w"]).alias("same"), o["weight"].alias("weight"), o["key"].alias("key")))
            share = F.aggregate(F.filter(same, lambda x: x["same"]), F.lit(0.0), lambda acc, x: acc + x["weight"])
            keyed = F.forall(same, lambda x: x["same"] | ~x["key"])
            return F.struct(F.lit(k).alias("template"), s.alias("start"), F.when(keyed, F.round(share / total, 6)).otherwise(-1.0).alias("share"))

        return F.filter(F.transform(starts, at), lambda x: x["share"] >= t.share)

    # most files have no place at all
    none = F.array().cast("array<struct<template: int, start: int, share: double>>")
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, F.concat(*map(compared, range(len(templates))))).otherwise(none))
    base = F.filter(F.col("found"), lambda x: x["template"].isin([k for k, t in enumerate(templates) if t.base]))
    rows = rows.withColumn("base", base)
    label = F.array(*(F.lit(t.label) for t in templates))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(label, x["template"])))), ",")
    start = F.transform("base", lambda x: x["start"].cast("long"))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        named("base").alias("base_labels"),
        named("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        "found",
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


OP3_SQL = (
    r"""
WITH t AS (SELECT * FROM (VALUES """
    + ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.share}, {t.key_words}, '{t.phrase}')" for k, t in enumerate(TEMPLATES))
    + r""") v(tid, label, base, need, key_words, phrase)),
tw AS (SELECT *, len(string_split(phrase, ' ')) AS m, unnest(string_split(phrase, ' ')) AS word, generate_subscripts(string_split(phrase, ' '), 1) - 1 AS k FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT rid, p, word FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM d) WHERE word IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT rid) AS n FROM w GROUP BY word),
tww AS (SELECT tw.*, round(ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(df.n, 0) + 1)) + 1, 6) AS weight FROM tw LEFT JOIN df ON df.word = tw.word),
starts AS (SELECT DISTINCT w.rid, a.tid, w.p - a.k AS s FROM w JOIN tww a ON a.word = w.word JOIN d ON d.rid = w.rid WHERE w.p >= a.k AND w.p - a.k + a.m <= len(d.words)),
shares AS (
  SELECT s.rid, s.tid, s.s, any_value(x.label) AS label, any_value(x.base) AS base,
         round(sum(CASE WHEN w.rid IS NOT NULL THEN x.weight ELSE 0 END) / sum(x.weight), 6) AS share,
         any_value(x.need) AS need, count(w.rid) FILTER (x.k < x.key_words) = any_value(x.key_words) AS keyed
  FROM starts s JOIN tww x ON x.tid = s.tid LEFT JOIN w ON w.rid = s.rid AND w.p = s.s + x.k AND w.word = x.word GROUP BY s.rid, s.tid, s.s),
sure AS (SELECT *, keyed AND share >= need AS sure FROM shares),
found AS (
  SELECT rid, count(*) FILTER (sure AND base) AS n_base, min(s) FILTER (sure AND base) AS first_word, max(s) FILTER (sure AND base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (sure AND base), '') AS base_labels,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (sure), '') AS labels, coalesce(max(share) FILTER (sure), 0.0) AS score
  FROM sure GROUP BY rid)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(f.n_base, 0) AS n_base, f.first_word, f.last_word,
       coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0) AS score
FROM d LEFT JOIN found f ON f.rid = d.rid
"""
)
