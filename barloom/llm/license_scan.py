"""License scan in DataFrame operations only: a positional rare-token index over license phrases.

Corpus counts give the words of the templates their IDF. Of every template the two highest-IDF words are its
postings: (word, place in the template). A file's occurrences of these words are looked up; an occurrence at p of a
word with place q proposes the start p - q, and starts that both words propose survive. There the mandatory phrase
is verified word by word, so every place where a phrase stands is found and nothing else. The score is the largest
IDF share of a template that stands in place at any proposed start.

Word positions stay in the row, so after the counts there is one narrow stage. Through the driver goes one number
per template word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import table, text_of

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Mandatory phrases of further licenses.
MORE_PHRASES = (
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution", "cc-by"),
    ("cc0 1 0 universal", "cc0"),
    ("all rights reserved", "proprietary"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str):
    """Lower case beyond A-Z is harmless: it neither cuts nor joins words, and no phrase word can arise from it."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORD), F.lit(0))


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word; `words` has an array column words. One number per vocabulary word is collected."""
    held = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("w"))
    return {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}


def scan(docs: DataFrame, base=BASE_PHRASES, more=MORE_PHRASES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, `places` (array of start, label, base; by start) and score.

    A null or empty text has no words, no places and score 0. Repeated rows give repeated results, an empty table an
    empty one. Overlapping places all count. Other columns are not read; texts are read whole.
    """
    words = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _words(text).alias("words"))
    phrases = [(p.split(), label, k < len(base)) for k, (p, label) in enumerate((*base, *more))]
    vocabulary = sorted({w for p, _, _ in phrases for w in p})
    df = document_frequencies(words, vocabulary)
    n = max(1, words.count())
    idf = {w: math.log(1 + n / (1 + df.get(w, 0))) for w in vocabulary}
    rare = [sorted(range(len(p)), key=lambda k, p=p: (-idf[p[k]], k))[:2] for p, _, _ in phrases]
    anchors = sorted({p[k] for (p, _, _), ks in zip(phrases, rare, strict=True) for k in ks})

    hits = words.withColumn("at", F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull()))
    found, shares = [], []
    for (phrase, label, is_base), (first, second) in zip(phrases, rare, strict=True):
        starts = [f"transform(filter(at, i -> words[i] = '{phrase[k]}'), i -> i - {k})" for k in (first, second)]
        listed = ", ".join(f"'{w}'" for w in phrase)
        found.append(
            f"transform(filter(array_intersect({starts[0]}, {starts[1]}), s -> s >= 0 and slice(words, s + 1, {len(phrase)}) = array({listed})),"
            f" s -> named_struct('start', cast(s as bigint), 'label', '{label}', 'base', {str(is_base).lower()}))")
        pairs, total = ", ".join(f"named_struct('word', '{w}', 'weight', {idf[w]!r}D)" for w in phrase), sum(idf[w] for w in phrase)
        shares.append(
            f"coalesce(array_max(transform(filter(array_union({starts[0]}, {starts[1]}), s -> s >= 0),"
            f" s -> aggregate(zip_with(slice(words, s + 1, {len(phrase)}), array({pairs}), (w, z) -> if(w = z.word, z.weight, 0D)), 0D, (a, x) -> a + coalesce(x, 0D)))), 0D) / {total!r}D")
    any_hit = F.size("at") > 0
    none = F.array().cast("array<struct<start:bigint,label:string,base:boolean>>")
    return hits.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(any_hit, F.expr(f"array_sort(concat({', '.join(found)}))")).otherwise(none).alias("places"),
        F.when(any_hit, F.least(F.lit(1.0), F.greatest(*(F.expr(x) for x in shares)))).otherwise(F.lit(0.0)).alias("score"),
    )


def op9_license_scan(spark, sf_dir):
    places = scan(table(spark, sf_dir, "documents"))
    labels = "array_join(array_sort(array_distinct(transform({0}, x -> x.label))), ',')"
    base = "filter(places, x -> x.base)"
    return places.select(
        "doc_id", "n_words", F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"array_min(transform({base}, x -> x.start))").alias("first_word"),
        F.expr(f"array_max(transform({base}, x -> x.start))").alias("last_word"),
        F.expr(labels.format(base)).alias("base_labels"), F.expr(labels.format("places")).alias("labels"), F.round("score", 6).alias("score"),
    )


def _sql() -> str:
    phrases = ", ".join(
        f"({k}, '{p}', '{label}', {str(k < len(BASE_PHRASES)).lower()})" for k, (p, label) in enumerate((*BASE_PHRASES, *MORE_PHRASES)))
    return rf"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
t as (select id, label, base, string_split(p, ' ') as pw from (values {phrases}) v(id, p, label, base)),
tw as (select id, label, base, len(pw) as size, unnest(range(len(pw))) as j, unnest(pw) as word from t),
pos as (select doc_id, unnest(range(len(ws))) as i, unnest(ws) as word from w),
hit as (select * from pos where word in (select word from tw)),
df as (select word, count(distinct doc_id) as df from hit group by word),
idf as (select *, ln(1 + (select count(*) from documents)::double / (1 + coalesce(df, 0))) as idf from tw left join df using (word)),
rare as (select * from (select *, row_number() over (partition by id order by idf desc, j) as r from idf) where r <= 2),
starts as (select doc_id, id, i - j as s, count(distinct r) as agree from hit join rare using (word) where i >= j group by 1, 2, 3),
shares as (select a.doc_id, a.id, a.s, any_value(f.label) as label, any_value(f.base) as base, count(*) filter (h.word = f.word) = any_value(f.size) as whole,
    sum(case when h.word = f.word then f.idf else 0 end) / sum(f.idf) as share
  from starts a join idf f using (id) left join hit h on h.doc_id = a.doc_id and h.i = a.s + f.j group by 1, 2, 3),
per as (select doc_id, count(*) filter (whole and base) as n_base, min(s) filter (whole and base) as first_word, max(s) filter (whole and base) as last_word,
    string_agg(distinct label, ',' order by label) filter (whole and base) as base_labels, string_agg(distinct label, ',' order by label) filter (whole) as labels,
    max(share) as score from shares group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
       coalesce(labels, '') as labels, round(least(coalesce(score, 0.0), 1.0), 6)::double as score
from w left join per using (doc_id)
"""


SQL = _sql()
