"""Personal data in DataFrame operations only: fixed patterns, and terms that give a protected entity away.

Information-theoretic sanitisation. The entities are the values the patterns find. Over all documents it is counted
how many hold an entity e, how many hold a term t, and how many hold both, wherever they stand in the document. The
pointwise mutual information of the two against the information of the entity,

    ratio(t, e) = ln(n * both / (with t * with e)) / ln(n / with e),

is 1 if t appears only where e does and 0 if they are unrelated. In documents that hold e, terms are spans of their own
where the ratio exceeds the disclosure threshold: generalised from `generalise` on, removed from `remove` on. A pair needs
`min_both` documents that hold both, so an entity in fewer documents has no terms.

Counts are pre-aggregated before each shuffle. A document's terms meet its entities only if the entity is in `min_both`
documents and the term is not too common to reach the threshold with it. The common terms that decides on are broadcast:
those in more than one of `COMMON` documents, at most `COMMON` times the distinct terms of an average document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, stored, table, text_of
from barloom.llm.spans import SPAN, add_spans

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns: the contract's, with possessive parts and look-behinds that change no match but keep them linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits, 13 to 19 of them; shorter and longer chains never pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TERM = r"\p{L}[\p{L}\p{M}]{2,}"
#: A term in more than one of so many documents is common.
COMMON = 1000


@dataclass(frozen=True)
class Disclosure:
    min_both: int = 3         # documents with the term and the entity
    generalise: float = 0.9   # disclosure threshold
    remove: float = 0.98


def base_spans(df: DataFrame, text: str = "t") -> DataFrame:
    """Add the four columns of KINDS to a frame with a text that is not null; matches that fail their test are dropped."""
    df = add_spans(df, text, EMAIL, "email", F.col(text).contains("@"))
    df = add_spans(df, text, IP, "ip")
    df = add_spans(df, text, CARD, "card")
    df = add_spans(df, text, PHONE, "phone", F.col(text).contains("+"))
    digits = "regexp_replace(x.hit, '[^0-9]', '')"
    twice = "aggregate(transform(split(reverse({0}), ''), (c, i) -> if(c = '', 0, if(i % 2 = 0, cast(c as int), cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0)))), 0, (a, v) -> a + v)".format(digits)
    tests = {
        "ip": f"x.hit rlike '^{_PART}[.]{_PART}[.]{_PART}[.]{_PART}$'",
        "card": f"{twice} % 10 = 0",
        "phone": f"length({digits}) between 9 and 15",
    }
    for kind, test in tests.items():
        df = df.withColumn(kind, F.expr(f"filter({kind}, x -> {test})"))
    return df


def _terms(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(text), F.lit(TERM), F.lit(0)))


def disclosing(base: DataFrame, docs: DataFrame, text: str, rules: Disclosure) -> DataFrame:
    """(entity, term, ratio) over the whole corpus; `base` has one row per document with row_id, t and entities."""
    n = base.count()
    held = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("with_e"))
    # With a term in more documents than `most` the entity cannot reach the threshold, even if all its documents hold the term.
    most = F.col("with_e") * F.pow(F.lit(float(n)) / F.col("with_e"), F.lit(1.0 - rules.generalise)) * (1 + 1e-9)
    held = stored(held.where((F.col("with_e") >= rules.min_both) & (F.col("with_e") < n)).withColumn("most", most))
    words = docs.select(F.explode(_terms(text)).alias("term"))
    with_t = stored(words.groupBy("term").agg(F.count(F.lit(1)).alias("with_t")).where(F.col("with_t") >= rules.min_both))
    common = with_t.where(F.col("with_t") * COMMON > n).withColumnRenamed("with_t", "seen")
    holders = base.select("row_id", F.explode("entities").alias("entity")).join(held, "entity").groupBy("row_id").agg(
        F.collect_list(F.struct("entity", "most")).alias("own"), F.max("most").alias("most"))
    terms = base.join(holders, "row_id").select("own", "most", F.explode(_terms("t")).alias("term"))
    near = terms.join(F.broadcast(common), "term", "left").where("seen is null or seen <= most").select("term", "seen", F.explode("own").alias("e"))
    pairs = near.where("seen is null or seen <= e.most").groupBy(F.col("e.entity").alias("entity"), "term").agg(F.count(F.lit(1)).alias("both"))
    ratio = F.expr(f"ln({n}D * both / (with_t * with_e)) / ln({n}D / with_e)")
    found = pairs.where(F.col("both") >= rules.min_both).join(with_t, "term").join(held, "entity")
    return stored(found.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= rules.generalise))


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: Disclosure = Disclosure()) -> DataFrame:
    """Per row: doc_id, row_id, the four arrays of base spans (start, end, hit) and `term`, (start, end, hit, action).

    `docs` is any table Spark reads the same way twice. A null or empty text has no spans. Repeated rows give repeated
    results and count as documents each. An empty table gives an empty result; other columns are not read. A term that
    overlaps a base span is none of its own.
    """
    t = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), text_of(text).alias("t"))
    t = base_spans(t).withColumn("entities", F.expr(f"array_distinct(transform(concat({', '.join(KINDS)}), x -> x.hit))"))
    base = stored(t.withColumn("t", F.when(F.size("entities") > 0, F.col("t"))))
    told = base.where(F.size("entities") > 0)
    sure = F.col("ratio") >= rules.remove
    telling = disclosing(base, docs, text, rules).groupBy("entity").agg(
        F.collect_list(F.when(sure, F.col("term"))).alias("remove"), F.collect_list(F.when(~sure, F.col("term"))).alias("generalise"))
    wanted = told.select("row_id", F.explode("entities").alias("entity")).join(telling, "entity").groupBy("row_id").agg(
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("remove", "generalise")))
    words = add_spans(told.select("row_id", "t").join(wanted, "row_id"), "t", TERM, "words")
    action = "if(array_contains(remove, x.hit), 'remove', if(array_contains(generalise, x.hit), 'generalise', null))"
    terms = words.select("row_id", F.expr(f"filter(transform(words, x -> named_struct('start', x.start, 'end', x.end, 'hit', x.hit, 'action', {action})), x -> x.action is not null)").alias("term"))
    none = F.array().cast(SPAN.replace("hit:string", "hit:string,action:string"))
    free = f"filter(coalesce(term, none), x -> not exists(concat({', '.join(KINDS)}), y -> y.start < x.end and x.start < y.end))"
    return (
        base.drop("t", "entities").join(terms, "row_id", "left").withColumn("none", none)
        .select("doc_id", "row_id", *KINDS, F.expr(free).alias("term"))
    )


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: Disclosure = Disclosure()) -> DataFrame:
    """All rows and columns; in the text each base span is its kind in brackets, telling terms are a placeholder or gone.

    Overlapping base spans are replaced by the first one's kind. Texts without spans are left as they are, null stays null.
    """
    (row,) = fresh(docs, "row_id")
    (cuts,) = fresh(docs, "cuts")
    put = {k: f"'[{k.upper()}]'" for k in KINDS} | {"term": "if(x.action = 'remove', '', '[TERM]')"}
    cut = ", ".join(f"transform({k}, x -> named_struct('start', x.start, 'end', x.end, 'put', {v}))" for k, v in put.items())
    found = detect(docs, text, doc_id, rules).select(F.col("row_id").alias(row), F.expr(f"array_sort(concat({cut}))").alias(cuts)).where(F.size(cuts) > 0)
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(found, row, "left")
    new = (f"aggregate({cuts}, named_struct('upto', 0L, 'out', ''), (a, s) -> if(s.start < a.upto, named_struct('upto', greatest(a.upto, s.end), 'out', a.out),"
           f" named_struct('upto', s.end, 'out', concat(a.out, substring(`{text}`, cast(a.upto + 1 as int), cast(s.start - a.upto as int)), s.put))),"
           f" a -> concat(a.out, substring(`{text}`, cast(a.upto + 1 as int))))")
    return joined.withColumn(text, F.when(F.col(cuts).isNotNull(), F.expr(new)).otherwise(F.col(f"`{text}`"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_pii(spark, sf_dir):
    found = detect(table(spark, sf_dir, "documents"))

    def shown(kind: str) -> str:
        return f"transform({kind}, x -> concat_ws(':', '{kind}', cast(x.start as string), cast(x.end as string)))"

    base = ", ".join(map(shown, KINDS))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(f"array_join(concat({base}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(concat({base}, {shown('term')}), ',')").alias("spans"),
    )
