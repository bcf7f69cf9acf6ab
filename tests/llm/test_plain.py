"""Helpers of the corpus operators that need no Spark."""

import random
import re

import ahocorasick  # noqa: F401
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import bpe, near_dedup, packing, quality, sharding, warc

TEXTS = ["", " ", "Ein Satz, zwei Sätze.\n\n  x", "it's 12 o'clock\t\x1c\x85 ", "漢字かな🙂é́", "a" * 3000, "ab" * 2000, " " * 500 + "x",
         "<|endoftext|> in a text", "_" * 777 + "=" * 333]


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.codec(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_codec_agrees_with_the_rank_library(codec, reference):
    for text in TEXTS:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_codec_on_any_text(codec, reference, text):
    assert codec.encode(text) == reference.encode_ordinary(text)


def test_small_memos_change_nothing(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    text = "one two three four five one two three four five " * 3
    assert codec.encode(text) == reference.encode_ordinary(text)


def test_token_ids_follow_the_tokenizer_file():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        file = f.read()
    exact, ours = Tokenizer.from_str(file), packing.TokenIds(file)
    for text in TEXTS:
        assert ours(text) == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 5000])
def test_only_the_first_piece_may_be_shorter(n):
    pieces = packing.cut(n, 1024)
    assert sum(length for _, length in pieces) == n and all(length == 1024 for _, length in pieces[1:])
    assert [start for start, _ in pieces] == [0, *np.cumsum([length for _, length in pieces])[:-1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_best_fit(lengths):
    bins = packing.best_fit(np.array(lengths), 20)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert max(fill) <= 20 and sum(f <= 10 for f in fill) <= 1  # two such bins would have been one


def test_longest_first_is_near_even_and_gives_the_giant_its_own_shard():
    rng = random.Random(5)
    items = [(str(k), rng.randint(1, 50)) for k in range(400)] + [("giant", 10_000)]
    placed, loads = sharding.longest_first(items, 4), [0] * 4
    for key, size in items:
        loads[placed[key]] += size
    rest = sorted(loads)[:3]
    assert max(loads) == 10_000 and rest[2] - rest[0] <= 50


def repeated(words):
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    hit = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)}
    return len(hit)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25))
def test_repeat_words(words):
    assert quality.repeat_words([w.encode() for w in words]) == repeated(words)


def test_judge_counts_as_defined():
    text = "Ein # Wort\n\nEin # Wort\n \x0b\nmore|of $it\x85é\n"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeat, failed, kept, _ = quality.judge(text, quality.QualityRules())
    assert (n, chars, symbols, dup, repeat) == (len(words), sum(map(len, words)), 4, 1, repeated(words)) and failed and not kept


def test_lines_go_before_documents():
    prose = "This line of prose has a number of words and it ends with a stop."
    rng = random.Random(1)
    body = [" ".join(rng.sample(prose.split(), 12)) + "." for _ in range(8)]
    menu = ["Home | News | Sport | About", "###### $$$$ %%%%", "All rights reserved."]
    good = quality.judge("\n".join(body + menu), quality.QualityRules())
    assert good[6] and good[7].split("\n") == body
    rubbish = [f"Home{k} | News{k} | Sport{k} | About{k} | Mail{k} | Help{k}" for k in range(30)]
    assert not quality.judge("\n".join(body[:2] + rubbish), quality.QualityRules())[6]


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    item = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    sig = near_dedup.signatures(np.repeat([0, 1], 300), np.tile(item, 2), np.concatenate([a, b]), 2, 4000, 7)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5


def test_signatures_do_not_depend_on_the_batch():
    texts = [f"w{k} x y z {k} v w q" * 5 for k in range(20)]
    rules = near_dedup.NearRules()

    def of(some):
        doc, item, n = near_dedup.shingles(some, 5)
        return near_dedup.signatures(doc, item, n.astype(float), len(some), rules.coordinates, 7)

    assert (of(texts)[7] == of(texts[7:8])[0]).all()


def test_shingles_by_hand():
    doc, item, n = near_dedup.shingles(["a b c d e f", "a b c d e a b c d e", "one two", "", "two one"], 5)
    per = np.bincount(doc, minlength=5).tolist()
    assert per == [2, 5, 1, 0, 1] and n[doc == 1].sum() == 6
    assert len(set(item[doc == 2]) & set(item[doc == 4])) == 0 and len(set(item[doc == 0]) & set(item[doc == 1])) == 1


@pytest.mark.parametrize("version", [1, 2])
def test_arc_declared_lengths(version):
    bodies = [b"", b"\n\nhttp://x 1 2 3 4\n", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 70_000]
    parts = [warc.member(warc.arc_version_block(version, "a.arc", "19990101000000"))]
    parts += [warc.member(warc.arc_record(version, f"http://h/{k} b", "1.2.3.4", "19990102030405", "text/html", "a.arc", 9, b)) for k, b in enumerate(bodies)]
    read = list(warc.read_arc(b"".join(parts) + b"\n"))
    assert [b for _, _, b in read] == bodies
    assert all(f["URL"] == f"http://h/{k} b" and f["Archive-date"] == "19990102030405" for k, (_, f, _) in enumerate(read))
    record = warc.to_warc(read[2][1], bodies[2], None)
    assert b"WARC-Type: response" in record and b"WARC-Date: 1999-01-02T03:04:05Z" in record
    assert b"WARC-Type: resource" in warc.to_warc(read[1][1], bodies[1], None)
    assert warc.to_warc(read[2][1], bodies[2], None) == record


def test_short_dates_are_filled_up():
    assert warc.iso("1996") == "1996-01-01T00:00:00Z" and warc.iso("199612312359") == "1996-12-31T23:59:00Z"
