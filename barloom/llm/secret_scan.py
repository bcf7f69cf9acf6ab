"""Secret scan in DataFrame operations only: fixed patterns and high entropy in a sliding window.

A candidate is a long run of key characters that has digits and letters. Its character class (hexadecimal,
lower-case alphanumeric, any) sets the threshold. A window slides over it; counts per character change by the
one that enters and the one that leaves, and with them the sum of c*log2(c), from which the window's Shannon entropy
follows at once: log2(w) - sum/w. What the allow-list matches is taken out of a candidate and the window slides over the
rest; a rest shorter than the window is no secret. A path whose segments are all plain names is suppressed whole. One
narrow stage, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import table, text_of
from barloom.llm.spans import add_spans

#: Fixed patterns. Possessive forms and look-behinds keep them linear and match what the plain forms match.
_KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = _KEYWORD + "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
#: Fixed alphabet of candidates; the window's counts are kept in this order.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


@dataclass(frozen=True)
class EntropyRules:
    window: int = 20
    hex_bits: float = 3.0
    lower_bits: float = 3.5
    any_bits: float = 3.7
    #: Regular expressions, in any case, of parts that are no secret.
    allow: tuple[str, ...] = (
        "example", "sample", "dummy", "placeholder", "change_?me", "your_", "test", "xxxx", "0000", "1234567", "abcdefg",
        "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "lorem",
    )


def _path(rules: EntropyRules) -> str:
    """Three slashes or more between plain names: words, or camel case, with digits after them only, joined by _ or -.

    A name as long as the window that has digits is not plain: on its own it would be a candidate.
    """
    part = "(?:[A-Z]++(?![a-z])|[a-z]*+(?:[A-Z][a-z]++)*+)[0-9]*+"
    short = f"(?:(?![^/]{{{rules.window}}})|(?=[^/0-9]*+(?:/|$)))"
    name = f"{short}{part}(?:[_-]{part})*+(?=/|$)"
    return f"^(?:{name}/){{3,}}+{name}$"


def _best_entropy(rules: EntropyRules) -> str:
    """SQL: highest entropy in bits of any window over the candidate `hit`; 0 if it is shorter than the window."""
    w = rules.window

    def f(c: str) -> str:  # c*log2(c), 0 at 0
        return f"(if(({c}) > 1, ({c}) * log2({c}), 0D))"

    count = "acc.counts[{0} - 1]"
    goes, comes = count.format("p.goes"), count.format("p.comes")
    return f"""
      aggregate(
        transform(zip_with(
            slice(split(hit, ''), 1, length(hit)), slice(concat(array_repeat('', {w}), split(hit, '')), 1, length(hit)),
            (c, g) -> named_struct('comes', instr('{ALPHABET}', c), 'goes', if(g = '', 0, instr('{ALPHABET}', g)))),
          (z, i) -> named_struct('i', i, 'comes', z.comes, 'goes', z.goes)),
        named_struct('counts', array_repeat(0, {len(ALPHABET)}), 's', 0D, 'best', 0D),
        (acc, p) -> named_struct(
          'counts', if(p.comes = p.goes, acc.counts, transform(acc.counts, (c, j) -> c + if(j = p.comes - 1, 1, 0) - if(j = p.goes - 1, 1, 0))),
          's', acc.s + if(p.comes = p.goes, 0D, {f(comes + " + 1")} - {f(comes)} + if(p.goes = 0, 0D, {f(goes + " - 1")} - {f(goes)})),
          'best', greatest(acc.best, if(p.i >= {w} - 1, log2({w}) - (acc.s + if(p.comes = p.goes, 0D, {f(comes + " + 1")} - {f(comes)} + if(p.goes = 0, 0D, {f(goes + " - 1")} - {f(goes)}))) / {w}, 0D))),
        acc -> acc.best)"""


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """Per row: doc_id and `secrets`, array of (start, ord, end, kind) in order; ord 0 to 2 are the fixed patterns, 3 is entropy.

    A null or empty text has none. Repeated rows give repeated results, an empty table an empty one; other columns
    are not read. Matches of a fixed pattern that fail its length are dropped and not tried again.
    """
    t = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("t"))
    t = add_spans(t, "t", ASSIGN, "assign", F.col("t").rlike("(?i)passw|secret|token|api_?key"))
    t = add_spans(t, "t", ACCESS, "access", F.col("t").contains("AKIA"))
    t = add_spans(t, "t", HEX, "hex")
    least = rules.window
    t = add_spans(t, "t", f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{least},}}+", "candidates")
    value = f"regexp_extract(x.hit, '^{_KEYWORD}([A-Za-z0-9+/_.=-]+)$', 1)".replace("\\", "\\\\").replace("[\"']", "[\"\\']")
    t = t.withColumn("assign", F.expr(f"filter(assign, x -> length({value}) >= 6)"))

    def tagged(column: str, order: int) -> str:
        return f"transform({column}, x -> named_struct('start', x.start, 'ord', {order}, 'end', x.end, 'kind', '{column}'))"

    t = t.withColumn("base", F.expr(f"concat({tagged('assign', 0)}, {tagged('access', 1)}, {tagged('hex', 2)})"))
    allow = "|".join(rules.allow).replace("\\", "\\\\")
    likely = "x.hit rlike '[0-9]' and x.hit rlike '[A-Za-z]'"
    t = t.withColumn("candidates", F.expr(f"filter(candidates, x -> {likely} and not x.hit rlike '{_path(rules)}' and not exists(base, y -> y.start < x.end and x.start < y.end))"))
    rest = f"regexp_replace(x.hit, '(?i){allow}', '')"
    t = t.withColumn("candidates", F.expr(f"filter(transform(candidates, x -> named_struct('start', x.start, 'end', x.end, 'hit', {rest})), x -> length(x.hit) >= {least} and {likely})"))
    bits = f"case when hit rlike '^[0-9a-f]+$' or hit rlike '^[0-9A-F]+$' then {rules.hex_bits}D when hit rlike '^[a-z0-9+/_-]+$' then {rules.lower_bits}D else {rules.any_bits}D end"
    judged = f"transform(candidates, x -> element_at(transform(array(x.hit), hit -> {_best_entropy(rules)} >= {bits}), 1))"
    t = t.withColumn("judged", F.when(F.size("candidates") > 0, F.expr(judged)).otherwise(F.array().cast("array<boolean>")))
    t = t.withColumn("entropy", F.expr("filter(transform(candidates, (x, i) -> struct(x.start, x.end, judged[i] as yes)), x -> x.yes)"))
    return t.select("doc_id", F.expr(f"array_sort(concat(base, {tagged('entropy', 3)}))").alias("secrets"))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text and the text's secrets replaced by their kind in brackets."""
    t = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    found = scan(t.select(F.struct("doc_id", "text").alias("doc"), "text"), "text", "doc").select("doc_id.doc_id", "doc_id.text", "secrets")
    cut = "aggregate(secrets, named_struct('upto', 0L, 'out', ''), (a, s) -> if(s.start < a.upto, a, named_struct('upto', s.end, 'out', concat(a.out, substring(text, cast(a.upto + 1 as int), cast(s.start - a.upto as int)), '[', upper(s.kind), ']'))), a -> concat(a.out, substring(text, cast(a.upto + 1 as int))))"
    return found.withColumn("redacted", F.expr(cut))


def op10_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    show = "transform({0}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string)))"

    def count(order: int):
        return F.size(F.filter("secrets", lambda x: x["ord"] == order)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.expr(show.format("filter(secrets, y -> y.ord < 3)")), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(show.format("secrets")), ",").alias("spans"),
    )
