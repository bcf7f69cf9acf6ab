"""Corpus operators on small tables, against brute force; nulls, empty and long texts, repeats, ties, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import bpe, exact_dedup, license_scan, near_dedup, packing, pii, quality, secret_scan, sharding, warc

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PROSE = [" ".join(random.Random(k).choices([f"word{n}" for n in range(90)], k=80)) + "." for k in range(6)]
ODD = [
    (1, None), (2, ""), (3, " \n"), (4, PROSE[0]), (5, PROSE[0]), (5, PROSE[0]), (6, PROSE[0] + " "), (None, PROSE[1]), (None, PROSE[1]),
    (8, PROSE[1]), (9, "x" * 60_000), (10, "a b " * 20_000), (11, "é🙂 token=abcdefgh a@b.co 10.0.0.1 under the MIT License"), (12, PROSE[2]),
]
#: Names that operators use inside.
CLASH = ["row_id", "node", "run", "kept", "cleaned", "ids", "item", "t", "words", "Best", "term", "text_to_encode"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3, "doc_id")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def text(t):
    return t or ""


def keyed(rows):
    return Counter((r["doc_id"], *(v for k, v in r.asDict().items() if k != "doc_id")) for r in rows)


def test_bpe(odd, empty):
    out = bpe.decode_documents(bpe.encode_documents(odd, BPE, public_tokenizers.PATTERN), BPE, ids="ids_").collect()
    assert Counter(bytes(r["decoded"]).decode() for r in out) == Counter(text(t) for _, t in ODD)
    assert {r["ids"] for r in out} == {CLASH.index("ids")}  # the table's own column is left alone
    assert bpe.encode_documents(empty, BPE, public_tokenizers.PATTERN).count() == 0


def exact_brute(rows):
    groups = defaultdict(list)
    for doc, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text(t))].append((-len(text(t)), doc is None, doc))
    return {k: (sorted(v, key=lambda x: (x[0], x[1], x[2] or 0))[0][2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("fan_in", [2, 64])
def test_exact_dedup(odd, empty, fan_in, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", fan_in)
    want = exact_brute(ODD)
    got = exact_dedup.decisions(odd).collect()
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(ODD) and all((r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]] for r in got)
    assert sum(r["kept"] for r in got) == len(want)
    assert exact_dedup.decisions(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.count() == len(want) and kept.columns == odd.columns


def test_merge_rounds_give_the_same_for_any_fan_in(odd):
    rows = exact_dedup.digests(odd).cache()
    results = [sorted((r["sha"], r["n"], tuple(r["best"])) for r in exact_dedup.winners(rows, f)[1].collect()) for f in (2, 4, 64)]
    assert results[0] == results[1] == results[2]
    rows.unpersist()


def test_sharding(odd, empty, spark, tmp_path):
    out = sharding.shard_documents(odd).collect()
    assert len(out) == len(ODD)
    for k in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    crc = {zlib.crc32(text(t).encode()): len(text(t).encode()) + 1 for _, t in ODD}
    assert all(crc[r["text_crc32"]] == r["size"] for r in out)
    assert all(len({r["shard"] for r in out if r["text_crc32"] == c}) == 1 for c in crc)
    assert sharding.shard_documents(empty).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "concat(repeat('x', 1 + cast(hash(id) % 300 as int)), id) as text")
    loads = Counter()
    for r in sharding.shard_documents(many).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 5
    sharding.write_shards(odd, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ODD)


def test_warc(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b c", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "y" * 50_000),
             (None, "w", "<p>x</p>"), (7, "w", "é\r\n\r\nz"), (7, "w", "é\r\n\r\nz")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("content", F.lit(1)).repartition(2)
    out = warc.through_archives(df).collect()
    assert len(out) == len(pages) and all(r["payload_digest"] in {warc.sha1_base32(text(h).encode()) for _, _, h in pages} for r in out)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out)
    assert got == Counter([(2, 8, "response", None), (1, 8, "revisit", 2), (None, 8, "revisit", 2), (4, 0, "response", None), (3, 0, "revisit", 4),
                           (5, 50_000, "response", None), (7, 7, "response", None), (7, 7, "revisit", 7)])
    assert warc.through_archives(df.where("false")).count() == 0


def jaccard_classes(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = text(t).encode().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return Counter(tuple(sorted(g, key=lambda x: (x is None, x))) for g in groups.values())


def chain(n, seed):
    """Copies of copies: neighbours are similar, ends are not."""
    rng = random.Random(seed)
    words, out = [f"w{rng.randrange(9999)}" for _ in range(120)], []
    for _ in range(n):
        at = rng.randrange(len(words))
        words = [*words[:at], f"n{rng.randrange(10 ** 9)}", *words[at + 1:]]
        out.append(" ".join(words))
    return out


def test_near_dedup_keeps_every_link(spark, odd, empty):
    texts = chain(60, 1) + chain(25, 2) + PROSE + [PROSE[0] + " more"]
    rows = [*ODD, *((100 + k, t) for k, t in enumerate(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit(0))
    out = near_dedup.classes(docs).collect()
    groups = defaultdict(list)
    for r in out:
        groups[r["class_id"], r["doc_id"] if r["class_size"] == 1 else None].append(r)
    assert sum(r["kept"] for r in out) == sum(jaccard_classes(rows).values())
    sizes = Counter(len(g) for g in jaccard_classes(rows).elements())
    assert Counter(r["class_size"] for r in out if r["kept"]) == sizes
    assert near_dedup.drop_near_copies(docs).columns == docs.columns
    assert near_dedup.classes(empty).count() == 0


def test_near_copies_that_repeat_passages_meet(spark):
    """Links rest on sets of shingles, so how often a text repeats a passage must not keep it from its copies."""
    rows = []
    for k in range(12):
        words = [f"w{k}x{n}" for n in range(100)]
        half = " ".join(words[:50])
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words * 10)), (10 * k + 2, " ".join([*[half] * 5, *words[50:]]))]
    want = jaccard_classes(rows)
    assert set(want) == {(10 * k, 10 * k + 1, 10 * k + 2) for k in range(12)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for r in near_dedup.classes(docs).collect():
        groups[r["class_id"]].append(r["doc_id"])
    assert Counter(tuple(sorted(g)) for g in groups.values()) == want


@pytest.mark.parametrize("block_items", [600, 100_000])
def test_members_left_are_compared_in_blocks(spark, block_items):
    rules = near_dedup.NearRules(leader_rounds=0, block_items=block_items)
    rows = list(enumerate(chain(20, 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.classes(docs, rules=rules).collect()} == {min(g) for g in jaccard_classes(rows)}


def test_packing(odd, empty):
    out = packing.pack_documents(odd, JSON, keep_ids=True).collect()
    exact = Tokenizer.from_file(JSON)
    want = Counter(tuple([*exact.encode(text(t), add_special_tokens=False).ids, 2]) for _, t in ODD)
    got = Counter()
    for key in {r["doc_id"] for r in out}:
        own = sorted((r for r in out if r["doc_id"] == key), key=lambda r: r["piece"])
        if sum(r["piece"] == 0 for r in own) == 1:
            got[tuple(i for r in own for i in r["ids"])] += 1
    assert not got - want and sum(r["length"] for r in out) == sum(len(k) * n for k, n in want.items())
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in out) // 1024) + 1
    assert packing.pack_documents(empty, JSON).count() == 0
    sequence = packing.sequences(packing.pack_documents(odd, JSON, keep_ids=True))
    assert sequence.agg(F.sum(F.size("ids"))).head()[0] == sum(r["length"] for r in out)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(t):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15],
    }


def mixed(tokens, n, seed):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(tokens) for _ in range(rng.randint(0, 20)))) for k in range(n)]


def test_pii_spans(spark, odd, empty):
    tokens = ["a@b.com", "x.y@z", "@", ".", "1", "255", "300", " ", "-", "+", "(017)", "555-7713", "4111 1111 1111 1111", "5500005555555559",
              "+1 (017) 555-7713", "é🙂", "_", "10.0.0.1", "\n"]
    rows = [*mixed(tokens, 400, 1), (900, "a@b" + ".c" * 3000), (901, "1" * 30_000), (902, "a@b.co " * 700), (903, "+1" + " " * 9000)]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, t in rows:
        assert {k: [(x["start"], x["end"]) for x in got[doc][k]] for k in pii.KINDS} == personal(t), t
    assert pii.detect(odd).count() == len(ODD) and pii.detect(empty).count() == 0


def test_pii_terms_that_give_an_entity_away(spark):
    rng = random.Random(4)
    plain = [(k, " ".join(rng.choices(["the", "lake", "was", "near", "town", "and", "people"], k=30))) for k in range(60)]
    told = [(100 + k, f"the lake near town was Zorblax zorb@corp.example and people {k}") for k in range(4)]
    docs = spark.createDataFrame(plain + told, "doc_id long, text string").withColumn("cuts", F.lit(1))
    out = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert all([x["hit"] for x in out[k]["term"]] == ["Zorblax"] for k in range(100, 104))
    assert not any(out[k]["term"] for k in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[100] == "the lake near town was  [EMAIL] and people 0" and all(clean[k] == t for k, t in plain)


def test_pii_terms_far_from_the_entity_and_without_blanks(spark):
    """Co-occurrence counts over whole documents, whatever separates their words."""
    rng = random.Random(5)
    common = ["the", "lake", "was", "near", "town", "and", "people"]
    plain = [(k, " ".join(rng.choices(common, k=60))) for k in range(60)]
    far = [(100 + k, "Quuxberg\n" + " ".join(rng.choices(common, k=80)) + f"\nmail: quux@corp.example {k}") for k in range(4)]
    tabs = [(200 + k, f"lake\tZorblax\tzorb@corp.example\t{k}") for k in range(4)]
    two = [(300 + k, "Rareword rare@corp.example") for k in range(2)]  # below the support rule
    docs = spark.createDataFrame(plain + far + tabs + two, "doc_id long, text string")
    out = {r["doc_id"]: {(x["start"], x["hit"]) for x in r["term"]} for r in pii.detect(docs).collect()}
    assert all((0, "Quuxberg") in out[k] for k in range(100, 104)) and all(out[k] == {(5, "Zorblax")} for k in range(200, 204))
    assert not any(out[k] for k in (*range(60), 300, 301))


def test_quality(odd, empty, spark):
    out = quality.clean_lines(odd).collect()
    assert len(out) == len(ODD) and "kept_" in out[0].asDict() and {r["kept"] for r in out} == {CLASH.index("kept")}
    assert all(r["kept_"] == quality.judge(text(r["text"]), quality.QualityRules())[6] for r in out)
    assert quality.clean_lines(empty).count() == 0


def test_license_places(spark, odd, empty):
    phrases = [(p.split(), label, k < 3) for k, (p, label) in enumerate((*license_scan.BASE_PHRASES, *license_scan.MORE_PHRASES))]
    tokens = ["under ", "THE ", "mit ", "License ", "Apache-", "version 2. ", "CC ", "BY-", "nc ", "é", "İ", "GNU General Public License, Version 3\n", "all rights ", "reserved "]
    rows = [*mixed(tokens, 300, 2), *((1000 + k, t) for k, (_, t) in enumerate(ODD))]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text(t).translate({c: c + 32 for c in range(65, 91)}))
        want = sorted((k, label, base) for p, label, base in phrases for k in range(len(words)) if words[k:k + len(p)] == p)
        assert [tuple(x) for x in got[doc]["places"]] == want and got[doc]["n_words"] == len(words)
        assert 0 <= got[doc]["score"] <= 1 and (not want or got[doc]["score"] > 0.999)
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(t):
    return sorted([(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
                  + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
                  + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def best_entropy(t, w=20):
    from math import log2

    return max((-sum(c / w * log2(c / w) for c in Counter(t[k:k + w]).values()) for k in range(len(t) - w + 1)), default=0)


def test_secrets(spark, odd, empty):
    tokens = ["token", "PassWord", "api_key", "secret", '"', "'", " ", ":", "=", "abc", "abcdefg", "AKIA", "ABCDEFGHIJKLMNOP1", "deadbeef" * 3, "🙂", ".",
              "k9Jx2LmQ8vR4tYbN7cZw3", "token:token:"]
    rows = [*mixed(tokens, 400, 3), (900, "token=abcdef " * 700), (901, "f" * 9000), (902, "aa11" * 2000)]
    got = {r["doc_id"]: r["secrets"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, t in rows:
        assert [(x["start"], x["ord"], x["end"]) for x in got[doc] if x["ord"] < 3] == secrets(t), t
    assert secret_scan.scan(odd).count() == len(ODD) and secret_scan.scan(empty).count() == 0


def test_entropy_window(spark):
    rng = random.Random(9)
    hits = ["".join(rng.choices(alphabet, k=rng.randint(20, 60))) for alphabet in ("01", "0123456789abcdef", "abcdefgh1", secret_scan.ALPHABET) for _ in range(25)]
    rules = secret_scan.EntropyRules()
    df = spark.createDataFrame([(h,) for h in hits], "hit string").withColumn("bits", F.expr(secret_scan._best_entropy(rules)))
    assert all(abs(r["bits"] - best_entropy(r["hit"])) < 1e-9 for r in df.collect())
    known = [(1, "key k9Jx2LmQ8vR4tYbN7cZw3 end"), (2, "k9Jx2LmQ8vR4example7cZw3"), (3, "zzzzzzzzzzzzzzzzzzzzzz11"), (4, "internationalisierungsprozesse")]
    out = {r["doc_id"]: [x["kind"] for x in r["secrets"]] for r in secret_scan.scan(spark.createDataFrame(known, "doc_id long, text string")).collect()}
    assert out == {1: ["entropy"], 2: [], 3: [], 4: []}
    assert secret_scan.redact(spark.createDataFrame(known[:1], "doc_id long, text string")).head()["redacted"] == "key [ENTROPY] end"


def test_allow_list_suppresses_only_what_it_explains(spark):
    rng = random.Random(11)
    base64 = secret_scan.ALPHABET[:64]
    keys = []
    for n in (40, 64, 88, 200, 400):
        for part in ("///", "test", "0000", "1234567", "sample"):
            key = rng.choices(base64, k=n)
            for c, at in zip(part, sorted(rng.sample(range(1, n - 1), len(part))) if part == "///" else range(n // 2, n)):
                key[at] = c
            keys.append("".join(key))
    keys.append("sk_test_" + "".join(rng.choices(base64[:62], k=24)))
    plain = ["/usr/local/lib/python3/site-packages/numpy", "/home/user/MyProject/src/main/v2/README", "docs/en_US/guide/chapter-12/section4", "//a/b/c/" + "d1/" * 20_000,
             "3f2a9c1e-7b4d-4e8f-9a6b-0c5d1e2f3a4b", "your_example_sample_test_0000_1234567"]
    rows = [*enumerate(keys), *((1000 + k, p) for k, p in enumerate(plain))]
    got = {r["doc_id"]: r["secrets"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, key in enumerate(keys):
        assert any(x["start"] == 0 and x["end"] == len(key) for x in got[k]), key
    assert not any(got[k] for k in got if k >= 1000), [rows[k] for k in got if got[k] and k >= 1000]


def test_pipeline_keeps_clean_documents(spark):
    rng = random.Random(6)
    vocabulary = [f"wort{k}" for k in range(3000)]
    clean = [(k, ". ".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(9)) + ".") for k in range(12)]
    rows = [*clean, (50, clean[0][1] + " "), (51, clean[1][1] + " extra"), (52, "too short"), (53, None), (54, "| a | b | c\n" * 40)]
    docs = spark.createDataFrame([(k, t, "de", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append({r["doc_id"] for r in docs.collect()})
    ids = set(range(12))
    assert left == [ids | {50, 51}, ids - {0} | {50, 51}, ids - {0} | {50}, ids - {0} | {50}]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in packed.collect()} == left[-1]
