"""Line-first cleaning: judge every line, drop the failing ones, then reject documents that lost too much.

Python per document, in Arrow batches: each document is judged on its own, so there is no shuffle, and
memory is one batch of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, map_batches, table, text_of, wider

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: What marks a line as page furniture rather than prose.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "click here", "read more", "sign in", "log in", "skip to content",
    "back to top", "share this", "subscribe to our newsletter", "lorem ipsum",
)
_BOILER = re.compile("|".join(re.escape(x) for x in BOILERPLATE), re.IGNORECASE)
_NAVIGATION = re.compile(r"\s[|>»›•·]\s|[|»›]{1}\s*$|^\s*[|»›]")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50              # the base rules
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.5    # a line: marks of the symbol list
    max_shouts_per_word: float = 0.5     # a line: exclamation and question marks
    max_separators_per_word: float = 0.25  # a line: navigation separators
    max_boilerplate_words: int = 15      # a longer line that holds such a phrase is prose about it
    max_unpunctuated_words: int = 2      # a line so short must hold closing punctuation
    min_words_left: float = 0.5          # a document: share of its words on lines that stay


def line_fails(line: str, n_words: int, rules: QualityRules) -> str:
    """Name of the rule that a line with words breaks, or an empty string."""
    if sum(map(line.count, _SYMBOLS)) > rules.max_symbols_per_word * n_words:
        return "symbols"
    if line.count("!") + line.count("?") > max(3, rules.max_shouts_per_word * n_words):
        return "shouting"
    if len(_NAVIGATION.findall(line)) > rules.max_separators_per_word * n_words:
        return "navigation"
    if n_words <= rules.max_boilerplate_words and _BOILER.search(line):
        return "boilerplate"
    if n_words <= rules.max_unpunctuated_words and not any(c in line for c in ".!?…:;。"):
        return "punctuation"
    return ""


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # else three numbers fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    codes = pairs[:-1] * v + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:k + len(codes)] |= again
    return int(covered.sum())


def judge(text: str, rules: QualityRules) -> tuple[int, int, int, int, int, bool, bool, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(raw.count, (_SPACES[k:k + 1] for k in range(6))))
    n_repeat = repeat_words(words)
    seen: set[str] = set()
    left, n_left, n_dup = [], 0, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            if line in seen:
                n_dup += 1
                continue
            seen.add(line)
            if line_fails(line, n, rules):
                continue
        left.append(line)
        n_left += n
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and n_left >= rules.min_words_left * n_words
    return n_words, word_chars, sum(map(text.count, _SYMBOLS)), n_dup, n_repeat, base_failed, kept, "\n".join(left)


_FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]


def clean_lines(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules(), carry: list[str] | None = None) -> DataFrame:
    """Per row: the carried columns (default all), the five counts, base_failed, kept and `cleaned`, the text without failing lines.

    A null text has no words: it fails. Repeated rows are judged alike. Whole texts are read, however long. An
    empty table gives an empty result. Where the table already has a column of a new one's name, that one gets a
    trailing underscore.
    """
    carry = docs.columns if carry is None else carry
    kept = docs.select(*(F.col(f"`{c}`") for c in carry))
    names = fresh(kept, *_FACTS)
    (source,) = fresh(kept, "judged_text")
    types = ["bigint"] * 5 + ["boolean"] * 2 + ["string"]
    schema = wider(kept.schema, *zip(names, types, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t, rules) for t in batch.column(batch.num_columns - 1).to_pylist()]
            facts = list(zip(*found, strict=True)) or [[]] * 8
            arrow = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(facts, arrow, strict=True))],
                names=[*batch.schema.names[:-1], *names])

    return map_batches(docs.select(*(F.col(f"`{c}`") for c in carry), text_of(text).alias(source)), run, schema)


def op8_quality_rules(spark, sf_dir):
    return clean_lines(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("cleaned")


#: The same rules with their numbers written out.
SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
grams as (select doc_id, i, count(*) over (partition by doc_id, g) > 1 as again from (
    select doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) as g from w, unnest(range(1, len(ws) - 1)) u(i) where len(ws) > 2)),
rep as (select doc_id, count(distinct i + k) as n from grams, range(3) r(k) where again group by doc_id),
lines as (select doc_id, l, count(*) as copies, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n
    from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id, l),
judged as (select doc_id, sum(copies - 1) as dup, coalesce(sum(n) filter (not (
      length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 0.5 * n
      or length(regexp_replace(l, '[^!?]', '', 'g')) > greatest(3, 0.5 * n)
      or len(regexp_extract_all(l, '\s[|>»›•·]\s|[|»›]\s*$|^\s*[|»›]')) > 0.25 * n
      or n <= 15 and regexp_matches(l, '(?i)all rights reserved|accept cookies|uses cookies|cookie policy|privacy policy|terms of use|terms of service|enable javascript|click here|read more|sign in|log in|skip to content|back to top|share this|subscribe to our newsletter|lorem ipsum')
      or n <= 2 and not regexp_matches(l, '[.!?…:;。]'))), 0) as n_left
    from lines group by doc_id),
f as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines,
      coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(n_left, 0) as n_left
    from w left join rep using (doc_id) left join judged using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_left >= 0.5 * n_words as kept
from f
"""
