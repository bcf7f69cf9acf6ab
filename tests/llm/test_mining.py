"""SimHash components, centroid clustering, phrases and the BPE query against plain computations."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import bpe, centroids, phrases, simhash

DOCS = "doc_id bigint, text string, lang string, fp string, node string"


# ---- SimHash

def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]
    parts = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=2):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for k in range(len(prints)):
        members.setdefault(find(k), []).append(k)
    out = {}
    for group in members.values():
        known = [ids[k] for k in group if ids[k] is not None]
        for k in group:
            out[k] = (min(known) if known else None, len(group))
    return [out[k] for k in range(len(prints))]


def _texts():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(words, k=n)) for n in (5, 40, 300, 900, 3)]
    near = [" ".join([w if r.random() > 0.004 else "changed" for w in base[3].split(" ")]) for _ in range(12)]
    return base + near + [base[3]] * 9 + [None, "", " \t\n", "one", "Two Words", "two words", "É ÉÀ   x", "x" * 50_000, "tok " * 30_000]


def test_simhash_equals_a_comparison_of_all_pairs(spark):
    texts = _texts()
    ids = [*range(len(texts) - 2), None, 3]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in rows], DOCS).repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % (1 << 64), r["component_id"], r["component_size"]) for r in simhash.components(docs).collect())
    prints = [plain_fingerprint(t) for t in texts]
    want = sorted((i if i is not None else -1, p, *c) for i, p, c in zip(ids, prints, plain_components(ids, prints)))
    assert got == want


def test_ball_hashing_finds_all_links_of_planted_fingerprints(spark):
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(40)]
    for p in prints[:20]:
        q = p
        for _ in range(4):  # chains whose ends are far apart, and neighbours at 1, 2 and 3 bits
            for b in r.sample(range(64), r.choice((1, 2, 2, 3))):
                q ^= 1 << b
            prints.append(q)
    prints += [0, 1, 3, 1 << 63, (1 << 64) - 1, (1 << 64) - 2]
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    for radius in (0, 2, 4):
        found = simhash.links(spark.createDataFrame(signed, "fp bigint"), simhash.SimRules(radius=radius)).collect()
        assert all((a % (1 << 64) ^ b % (1 << 64)).bit_count() <= radius for a, b in found)
        root = {p: p for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in found:
            x, y = find(a % (1 << 64)), find(b % (1 << 64))
            root[max(x, y)] = min(x, y)
        want = plain_components(prints, prints, radius)
        assert [find(p) for p in prints] == [find(c[0]) for c in want]
        assert len({find(p) for p in prints}) == len({c[0] for c in want})


def test_simhash_radius_must_have_a_middle():
    with pytest.raises(ValueError):
        simhash.SimRules(radius=3)


def test_simhash_of_no_rows_and_the_query(spark, tmp_path):
    assert simhash.components(spark.createDataFrame([], DOCS)).count() == 0
    texts = _texts()
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op13_simhash(spark, str(tmp_path)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert got == {k: (f"{p:016x}", c[0]) for k, (p, c) in enumerate(zip(prints, plain_components(range(len(texts)), prints)))}


def test_majority_over_slices(monkeypatch):
    monkeypatch.setattr(simhash, "_SLICE", 7)
    r = random.Random(2)
    doc = np.sort(np.array([r.choice((0, 1, 1, 1, 4)) for _ in range(60)]))
    h = np.array([r.getrandbits(64) for _ in range(60)], np.uint64)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[doc == d]) > (doc == d).sum()) for d in range(5)]
    assert simhash.majority(h, doc, 5).tolist() == want


# ---- clustering

def plain_clusters(rows, rules=centroids.ClusterRules()):
    kept = [(i, [math.floor(rules.scale * x) for x in e]) for i, e in rows
            if e is not None and len(e) == rules.components and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda v: (v[0] is None, hashlib.sha256(f"{rules.seed}:{v[0]}".encode()).hexdigest(), v[1]))
    c = [list(v) for _, v in order[:rules.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), k) for k, p in enumerate(c))

    for _ in range(rules.rounds):
        own = [nearest(v)[1] for _, v in kept]
        c = [[sum(v[j] for v in g) // len(g) for j in range(rules.components)] if (g := [v for (_, v), o in zip(kept, own) if o == k]) else c[k] for k in range(len(c))]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted((-1 if i is None else i, k, d, sum(x for _, x, o in found if o == k), total, hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in found)


def _vectors(n, seed, width=64):
    r = random.Random(seed)
    heads = [[r.gauss(0, 1) for _ in range(width)] for _ in range(11)]
    return [[x + r.gauss(0, 0.3) for x in r.choice(heads)] for _ in range(n)]


SCHEMA = "vec_id bigint, embedding array<double>, x string, cluster string"


def _rows(spark, rows):
    return spark.createDataFrame([(i, e, "clash", "clash") for i, e in rows], SCHEMA).repartition(3)


def _result(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_equal_plain_rounds(spark):
    v = _vectors(120, 1)
    odd = [None, [], v[0][:63], [*v[0], 1.0], [*v[0][:63], None], [*v[0][:63], float("nan")], [*v[0][:63], float("-inf")]]
    rows = [*enumerate(v), (None, v[3]), (7, v[7]), (7, v[8]), *((500 + k, e) for k, e in enumerate(odd)), *((600 + k, v[5]) for k in range(60))]
    assert _result(centroids.cluster(_rows(spark, rows))[0]) == plain_clusters(rows)


def test_ties_few_vectors_and_none(spark):
    zero, one = [0.0] * 64, [1.0] + [0.0] * 63
    rows = [(k, zero) for k in range(12)] + [(k + 20, one) for k in range(5)] + [(40, [0.5] + [0.0] * 63)]
    assert _result(centroids.cluster(_rows(spark, rows))[0]) == plain_clusters(rows)
    few = [(1, zero), (2, one)]
    assert _result(centroids.cluster(_rows(spark, few))[0]) == plain_clusters(few)
    none = centroids.cluster(_rows(spark, []))[0]
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_tree_of_many_points_finds_the_nearest_and_the_smaller_of_equals():
    r = np.random.default_rng(4)
    points = r.integers(-40, 40, (300, 3))  # many equal points and equal distances
    rows = r.integers(-50, 50, (2000, 3))
    d = ((rows[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    for leaf in (1, 2, 16, 500):
        who, best = centroids.VantageTree(points.astype(np.int64), leaf).nearest(rows.astype(np.int64))
        assert (best == d.min(axis=1)).all() and (who == d.argmin(axis=1)).all()


def test_distances_at_the_limit_are_exact(spark):
    big = (centroids.LARGEST - 1) / 1024
    rows = [(1, [big] * 64), (2, [-big] * 64), (3, [big] * 63 + [big - 1])]
    rules = centroids.ClusterRules(clusters=2)
    assert _result(centroids.cluster(_rows(spark, rows), rules)[0]) == plain_clusters(rows, rules)
    with pytest.raises(Exception, match="131072"):
        centroids.cluster(_rows(spark, [(1, [1e6] * 64)]))


def test_assigning_other_rows_keeps_their_columns(spark):
    v = _vectors(40, 2)
    _, c = centroids.cluster(_rows(spark, list(enumerate(v))))
    out = centroids.with_clusters(_rows(spark, [(1, v[0]), (1, v[0]), (2, None)]), c)
    assert out.columns == ["vec_id", "embedding", "x", "cluster", "cluster_", "distance"]
    rows = out.collect()
    assert len(rows) == 3 and [r["cluster_"] is None for r in sorted(rows, key=lambda r: r["vec_id"])] == [False, False, True]


def test_the_query_equals_plain_rounds(spark, tmp_path):
    rows = list(enumerate(_vectors(60, 3)))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    single = [(i, np.array(e, np.float32).astype(float).tolist()) for i, e in rows]
    assert _result(centroids.op12_centroids(spark, str(tmp_path))) == plain_clusters(single)


def test_join_by_count_spreads_hot_keys(spark):
    from barloom.llm.common import join_by_count
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    labels = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("label"))
    got = join_by_count(rows, labels, "k", "n")
    assert got.count() == 3000 and got.where("label <> k").count() == 0 and got.select("id").distinct().count() == 3000


# ---- phrases

def plain_phrases(rows, rules=phrases.PhraseRules()):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, rules.longest + 1):
                f[lang or "und"].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= rules.least}
        holding = defaultdict(list)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    holding[p[k:k + size]].append(a)
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= rules.inside * a for b in holding[p]):
                continue
            score, k = min((rules.scale * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, n, p.decode(), -a, x, y, total[lang], -s) for n, (s, a, p, x, y) in enumerate(sorted(kept)[:rules.top], 1)]
    return sorted(out)


def _phrase_rows(n=260):
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["É", "Ñu", "🙂", "new", "York", "CITY"]
    fixed = ["new york city", "New York", "in the end", "the end", "a a a a", "x\ty  z", "É Ñu 🙂"]
    rows = []
    for k in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=r.randint(1, 9))) for _ in range(r.randint(1, 8))]
        rows.append((r.choice([" ", ", ", ". ", "\n", "!? ", " \t"]).join(parts), r.choice(["en", "en", "en", "de", None, "fr\nx"])))
    return rows + [(None, "en"), ("", None), (" \t .,", "en"), ("spam " * 30_000, "de"), ("long, " * 3000, "de"), *[("the very same text of seven words here", "en")] * 90]


def _phrase_table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "clash", 1) for k, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, level int").repartition(4)


def _found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("rules", [
    phrases.PhraseRules(), phrases.PhraseRules(shards=1, least=3), phrases.PhraseRules(shards=2, top=7, longest=2),
    phrases.PhraseRules(slots=1 << 15, shards=2, longest=4)])  # 32,768 slots: many wrong hits of the filter
def test_phrases_equal_plain_counts(spark, rules):
    rows = _phrase_rows()
    docs = _phrase_table(spark, rows).cache()
    assert _found(phrases.collocations(phrases.deal(docs, rules), rules)) == plain_phrases(rows, rules)


def test_phrases_do_not_depend_on_batches_or_hashes(monkeypatch):
    """Exact counts of one task with every filter slot set, in small batches, also if all hashes are alike."""
    monkeypatch.setattr(phrases, "_CUT", 40)
    want = Counter()
    for t, lang in _phrase_rows(40):
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "")[:900].encode())):
            w = re.findall(rb"[^\x20\x09]+", piece)
            want[lang or "und", b""] += len(w)
            for size in (1, 2, 3):
                want.update((lang or "und", b" ".join(w[k:k + size])) for k in range(len(w) - size + 1))
    for same in (False, True):
        if same:
            monkeypatch.setattr(phrases, "mix", lambda x: np.zeros(len(x), np.uint64))
        rules = phrases.PhraseRules(shards=1)
        counts, got = phrases.Counter(rules, None, np.zeros(rules.slots, np.uint8)), Counter()
        for k, (t, lang) in enumerate(_phrase_rows(40)):
            counts.add((t or "")[:900].encode(), lang or "und")
            if k % 7 == 0 or k == len(_phrase_rows(40)) - 1:
                for b in counts.exact():
                    for r in b.to_pylist():
                        got[r["lang"], r["phrase"]] += r["n"]
        assert got == +want


def test_words_are_hashed_in_bulk_as_alone(monkeypatch):
    """A word's hash depends on its bytes alone; scans hash many texts without making a value of any word."""
    words = [w.encode() for w in ("a", "b", "ab", "ba", "\x00", "\x00\x00", "\u00e9t\u00e9", "x" * 5000, "\x1c", "zz")] * 3
    buffer = np.frombuffer(b" \t".join(words) + b"\xff\xff ", np.uint8)
    got, start, end = phrases.word_hashes(buffer)
    assert [bytes(buffer[a:b]) for a, b in zip(start, end, strict=True)] == words
    assert got.tolist() == [int(phrases.word_hashes(np.frombuffer(w, np.uint8))[0][0]) for w in words] and len(set(got.tolist())) == 10
    monkeypatch.setattr(phrases, "_SPAN", 7)
    assert (phrases.word_hashes(buffer)[0] == got).all() and len(phrases.word_hashes(buffer[:0])[0]) == 0


@pytest.mark.parametrize("span", [1, 50, 2_000_000])
def test_hashed_counts_do_not_depend_on_spans(monkeypatch, span):
    """Pairs and triples of one scan within pieces only, each text of its own, all words confirmed before."""
    monkeypatch.setattr(phrases, "_SPAN", span)
    rules = phrases.PhraseRules(shards=1)
    counts, want = phrases.Counter(rules, 1, np.zeros(rules.slots, np.uint8)), Counter()
    monkeypatch.setattr(counts, "add", None)  # no word goes through the table of words
    for t, lang in _phrase_rows(40):
        counts.put((t or "").encode() + b"\xff", lang or "und")
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())):
            w = re.findall(rb"[^\x20\x09]+", piece)
            want.update((size, lang or "und", tuple(w[k:k + size])) for size in (2, 3) for k in range(len(w) - size + 1))
    counts.count()
    rows = [r for b in counts.hashes() for r in b.to_pylist()]
    assert sorted((r["key"] >> 8 & 255, r["n"]) for r in rows) == sorted((size, n) for (size, _, _), n in want.items())
    assert {r["key"] & 255 for r in rows} == {1}


def test_phrases_of_no_rows_and_the_query(spark, tmp_path):
    rules = phrases.PhraseRules()
    none = _phrase_table(spark, []).where("false")
    assert phrases.collocations(phrases.deal(none, rules), rules).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations([none], rules)
    rows = _phrase_rows()
    _phrase_table(spark, rows).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    assert _found(phrases.op11_phrases(spark, str(tmp_path))) == plain_phrases(rows)


def test_shards_by_file_read_each_row_once(spark, tmp_path):
    spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text").repartition(7).write.parquet(f"{tmp_path}/a b%20c")
    shards = phrases.deal_files(spark, f"{tmp_path}/a b%20c", phrases.PhraseRules())
    assert sorted(r["doc_id"] for s in shards for r in s.collect()) == list(range(1000))
    assert all(s.count() > 0 and len(s.inputFiles()) < 4 for s in shards)
    assert sum(s.count() for s in phrases.deal_files(spark, f"{tmp_path}/a b%20c", phrases.PhraseRules(shards=9))) == 1000


# ---- byte-level BPE

def test_the_bpe_query_equals_the_rank_file_library(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(open(path, "rb").read().splitlines())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "one  two\n\n three", "É🙂\u2003ñ <|endoftext|> 日本語のテキスト", "x" * 5000, "a b " * 9000, *(t for t, _ in _phrase_rows(60))]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op1_bpe(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for k, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert got[k] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_decoding_ids_from_elsewhere(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(open(path, "rb").read().splitlines())
    word = ranks[b" the"]
    df = spark.createDataFrame([(1, [word, word, ranks[b"a"]], b"own"), (2, [], b"own"), (3, None, b"own")], "k int, ids array<int>, decoded binary")
    got = {r["k"]: r["decoded_"] for r in bpe.decode_documents(df, path).collect()}
    assert {k: None if v is None else bytes(v) for k, v in got.items()} == {1: b" the thea", 2: b"", 3: None}
    assert bpe.decode_documents(df.where("false"), path).collect() == []
    with pytest.raises(Exception, match="bounds|lacks"):
        bpe.decode_documents(spark.createDataFrame([([-1],)], "ids array<int>"), path).collect()
