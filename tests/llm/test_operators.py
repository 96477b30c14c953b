"""The ten operators against SQL, the libraries they have to equal, or brute force; and odd rows in each."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import binary_records, bpe_automaton, fingerprints, line_dedup, lm_scoring, ngram_join, packing, queries, quality_rules, suffix_dedup, toxicity
from gridloom.llm.common import free, mark, materialise, scratch, spread_join, with_rows
from gridloom.llm.tokenizer import TextEncoder, public_tokenizer, read_tokenizer
from tests.oracle import answer, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `spans` int, word string"
PATH = public_tokenizer()


def table(spark, texts, ids=None, source="s"):
    """Documents with extra columns whose names clash with inner ones."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, source, None, "x", 1, "w") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


LONG = "word another. " * 4000
ODD = [None, "", "   ", "a", "a", LONG, "x" * 5000, "<|endoftext|> a<|endoftext|>", "日本語 😀\n\n  z", "one two three four five six"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert rows(found) == rows(answer(queries.ORACLE_SQL[name], sf_dir))


# 1


def test_automaton_and_chunks_equal_the_library(library):
    spec, rng = read_tokenizer(PATH), random.Random(3)
    automaton, encoder = bpe_automaton.Automaton(spec), TextEncoder(spec)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" \n\taAb.!?é'19_日😀<|>") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == expected
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == expected
        assert automaton.decode(expected) == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("line", ["w{i}", "{i},\nyx,", "x\n\n{i}.", "{i}\n "])
def test_many_lines_without_spaces(library, line):
    spec, text = read_tokenizer(PATH), "\n".join(line.format(i=i) for i in range(100_000))
    automaton, encoder = bpe_automaton.Automaton(spec), TextEncoder(spec)
    expected = library.encode(text, add_special_tokens=False).ids
    assert automaton.encode(text) == expected
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == expected


def test_word_lists_pass_through_all_encoding_operators(spark, library):
    texts = ["\n".join(f"w{i}" for i in range(20_000)), "a,\nyx,\n" * 3_000, None]
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    docs = table(spark, texts)
    assert [r["n_tokens"] for r in bpe_automaton.bpe_encode(docs, PATH).orderBy("doc_id").collect()] == n
    folder = scratch(spark, "lists")
    binary_records.write_records(docs, PATH, folder, end_id=0)
    assert [r["n_tokens"] for r in binary_records.read_records(spark, folder).orderBy("doc_id").collect()] == [x + 1 for x in n]
    pieces = packing.pack(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in pieces] == [x + 1 for x in n]


def test_op1(spark, sf_dir, library, documents):
    for r in queries.op1_bpe(spark, sf_dir).collect():
        ids = library.encode(documents[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip(spark):
    encoded = bpe_automaton.bpe_encode(table(spark, ODD), PATH)
    assert {r["doc_id"]: r["text"] for r in bpe_automaton.bpe_decode(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe_automaton.bpe_encode(table(spark, []), PATH).count() == 0


# 2


def removed_lines(texts, k):
    """The lines of each text that lie in a run found before: of k lines, or of fewer with 50 words."""
    seen, out = set(), []
    for text in texts:
        lines = [x for x in (text or "").split("\n") if x.strip(line_dedup.SPACES)]
        gone = set()
        for i in range(len(lines)):
            for size in range(1, min(k, len(lines) - i) + 1):
                window = tuple(lines[i : i + size])
                if window in seen and (size == k or sum(len(x.encode().split()) for x in window) >= 50):
                    gone |= set(range(i, i + size))
                seen.add(window)
        out.append(gone)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_dedup_by_brute_force(spark, k):
    rng = random.Random(k)
    texts = ["\n".join(rng.choice("abcdefg ") * rng.randint(1, 2) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "a\nb\nc\na\nb\nc"]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(table(spark, texts), k).collect()}
    assert got == {i: len(g) for i, g in enumerate(removed_lines(texts, k))}


def test_line_dedup_of_few_long_lines(spark):
    rng = random.Random(8)
    long = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(n)) for n in (24, 26, 50, 60, 400)]
    texts = ["\n".join(rng.choice([*long, "a", "b", " "]) for _ in range(rng.randint(1, 5))) for _ in range(60)] + [LONG, LONG, "x\n" * 3000]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert got == {i: len(g) for i, g in enumerate(removed_lines(texts, 3))}


def test_split_lines_takes_long_copies_in_time():
    n = 100_000
    text = "x\n" + "\n \n".join(f"line {i}" for i in range(n)) + "\ny"
    runs = [(1 + i, min(1 << 15, n - i)) for i in range(n)]
    kept, n_lines, n_gone, n_runs = line_dedup.split_lines(text, runs)
    assert ([line for line in kept if line.strip()], n_lines, n_gone, n_runs) == (["x", "y"], n + 2, n, 1)
    assert line_dedup.split_lines("a\nb\nc\nd", [(0, 1), (2, 2), (3, 1)]) == (["b"], 4, 3, 2)


def test_line_dedup_doubles_to_the_longest_run(spark):
    run = "\n".join(f"line {i}" for i in range(21))
    found = line_dedup.repeated_runs(with_rows(table(spark, [run, "x\n" + run, "y\n" + run]))).collect()
    assert max(r["n"] for r in found) == 16 and {r["row"] for r in found} == {1, 2}


def test_spread_join_splits_hot_keys(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 900).alias("k"), "id")
    few = materialise(many.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most")), "few")
    got = spread_join(many, few, ["k"], "n")
    assert sorted(map(tuple, got.select("k", "id", "n", "most").collect())) == sorted(map(tuple, many.join(few, "k").select("k", "id", "n", "most").collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_line_dedup_odd_rows(spark):
    texts = ["p\nq\nr", "p\nq\nr", "x\np\nq\nr\ny", None, ""]
    assert sorted(r["n_removed"] for r in line_dedup.line_dedup(table(spark, texts, [7, 7, None, None, 9])).collect()) == [0, 0, 0, 3, 3]
    kept = line_dedup.remove_runs(table(spark, texts)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(0, "p\nq\nr"), (2, "x\ny"), (3, ""), (4, "")] and kept[1]["n_chars"] == 3 and "word" in kept[0].asDict()
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


# 3


def test_quality_rules_odd_rows(spark):
    docs = table(spark, ODD).withColumn("source", F.when(F.col("doc_id") > 2, F.col("source")))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(ODD) and got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert got[5]["n_words"] == 8000 and got[5]["n_repeat_words"] == 8000 and got[5]["base_failed"]
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_prior_is_that_of_beta_binomial_hosts(spark):
    rng = np.random.default_rng(2)
    rates, sizes = rng.beta(2, 6, 3000), rng.integers(2, 40, 3000)
    rows_ = [(f"h{i}", int(n), int(rng.binomial(n, p))) for i, (p, n) in enumerate(zip(rates, sizes, strict=True))]
    counted = spark.createDataFrame([(h, k < x, False, False, False) for h, n, x in rows_ for k in range(n)], "source string, short boolean, repeats boolean, symbols boolean, dup_lines boolean")
    got = {r["source"]: r["rate_short"] for r in quality_rules.host_verdicts(counted).collect()}
    weights = [(x - n * got[h]) / (got[h] - 0.25) for h, n, x in rows_ if abs(got[h] - 0.25) > 0.1]
    assert abs(np.median(weights) - 8) < 1.5  # the prior's a + b


def test_bad_hosts_go_and_small_ones_stay(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows_ = [("bad", "short")] * 300 + [("bad", good)] * 3 + [("good", good)] * 300 + [("tiny", "short")] + [("tiny", good)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, (s, t) in enumerate(rows_)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter(r["source"] for r in quality_rules.keep_documents(docs).collect())
    assert kept == {"good": 300, "tiny": 1} and quality_rules.keep_documents(docs).columns == docs.columns


def test_hot_hosts_are_dealt_over_parts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows_ = [(None if i % 2 else f"h{i % 40}" if i % 4 else "", good if i % 3 else "short") for i in range(1200)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows_)], "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    joined = quality_rules.keep_documents(docs)
    assert "_part" in joined._jdf.queryExecution().toString()
    assert sorted(r["doc_id"] for r in joined.collect()) == [i for i, (_, t) in enumerate(rows_) if t == good]
    assert quality_rules.quality_rules(docs).count() == len(rows_)


# 4


def test_toxicity_learns(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(300)]
    toxic = [rng.random() < 0.15 for _ in range(900)]
    texts = [" ".join([rng.choice(common) for _ in range(60)] + (["nasty" + word() for _ in range(4)] if t else [])) for t in toxic] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i % 5 < 3] + [(0, 0, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, texts), labels).collect()}
    held = [i for i in range(900) if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(902))
    right = sum(got[i]["predicted"] == toxic[i] for i in held)
    assert right > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in toxicity.toxicity(table(spark, texts[:5]), labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(table(spark, []), labels).count() == 0


def test_risk_and_gradient_by_a_plain_loop():
    rng = random.Random(11)
    for prior in (0.05, 0.6):  # with the second the risk of the negatives is below zero
        p_rows, u_rows = ([first + [j for j in range(1, 6) if rng.random() < 0.4] for _ in range(n)] for n, first in ((5, [0]), (9, [])))
        x = np.array([5.0 if prior > 0.5 else 0.3] + [rng.uniform(-1, 1) for _ in range(5)] + [-2.0])
        log_loss = lambda rows_, sign, x: sum(math.log1p(math.exp(-sign * (x[6] + sum(x[j] for j in own)))) for own in rows_) / len(rows_)
        negative = lambda x: log_loss(u_rows, -1, x) - prior * log_loss(p_rows, -1, x)
        decayed = lambda x: 0.01 / 2 * sum(x[:6] ** 2)
        below = negative(x) < 0
        assert below == (prior > 0.5)
        docs = tuple(np.array(v) for rows_ in (p_rows, u_rows) for v in ([j for own in rows_ for j in own], [i for i, own in enumerate(rows_) for _ in own]))
        value, grad = toxicity.risk(x, docs, 5, 9, prior, 0.01)
        assert value == pytest.approx(prior * log_loss(p_rows, 1, x) + max(negative(x), 0) + decayed(x))
        target = (lambda x: -negative(x) + decayed(x)) if below else (lambda x: prior * log_loss(p_rows, 1, x) + negative(x) + decayed(x))
        for j in range(7):
            step = np.eye(7)[j] * 1e-5
            assert grad[j] == pytest.approx((target(x + step) - target(x - step)) / 2e-5, abs=1e-6)


def test_toxicity_weighs_evidence_of_both_signs():
    own, n, m = np.arange(4), 100, 1000
    assert toxicity.select(own, np.array([90, 5, 5, 2]), n, np.array([10, 50, 900, 0]), m).tolist() == [0, 2]


def test_toxicity_repeated_rows_and_long_texts(spark):
    texts = ["bad bad words", "good words"] * 40 + [LONG, LONG]
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, texts, [i if i < 80 else 500 for i in range(82)]).union(table(spark, ["bad bad words"], [0])), labels).collect()
    assert len(got) == 83 and len({r["score"] for r in got if r["doc_id"] in (0, 500)}) == 2


def test_toxicity_samples_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 10)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda positive, unlabelled, *rest: (seen.append((len(positive), len(unlabelled))), ({}, 0.0))[1])
    texts = [f"bad words {i}" for i in range(300)] + ["bad thing"] * 200 + [f"good words {i}" for i in range(100)]
    labels = spark.createDataFrame([(0, 1, 1)] + [(i, 1, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    toxicity.fit(table(spark, texts, [0] * 500 + list(range(1, 101))), labels)
    assert seen[0][0] == 10 and 0 < seen[0][1] <= 100


def test_toxicity_held_out(spark, sf_dir):
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(r["score"], marks[r["doc_id"]]) for r in queries.op4_toxicity(spark, "/root/testdata/sf0.01").filter("held_out").collect() if marks.get(r["doc_id"]) is not None]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in got for b, y in got if x == 1 and y == 0]
    assert np.mean(pairs) > 0.8


# 5


def shingles(text):
    w = [x for x in quality_rules_words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def quality_rules_words(text):
    return (text or "").encode().split()


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    n = len(sets)
    links = [[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    label = list(range(n))
    for _ in range(n):
        fresh = [min(label[j] for j in range(n) if links[i][j]) for i in range(n)]
        if fresh == label:
            break
        label = fresh
    return {i: (label[i], sum(links[i]) - 1) for i in range(n)}


def test_ngram_join_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # so that groups span blocks
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))] for _ in range(6)]

    def near():
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
        return " ".join(w)

    texts = [near() for _ in range(110)] + [None, "", "a b", "a b", "a  b\n", LONG]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(table(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_components_with_hubs(spark):
    star = [(i, 0) for i in range(1, 900)] + [(2000 + i, 2000) for i in range(1, 400)] + [(i, i + 1) for i in range(5000, 5040)]
    got = ngram_join.components(spark.createDataFrame(star, "a long, b long"))
    labels = dict(map(tuple, got.collect()))
    assert labels == {x: 0 if x < 900 else 2000 if x < 5000 else 5000 for e in star for x in e}


def test_ngram_join_odd_rows(spark):
    assert ngram_join.ngram_join(table(spark, [])).count() == 0
    assert Counter(r["n_links"] for r in ngram_join.ngram_join(table(spark, ["same text here", "same text here", "other"], [3, 3, None])).collect()) == {1: 2, 0: 1}
    docs = table(spark, ["p q r s t u", "p q r s t u", "z"])
    assert [r["doc_id"] for r in ngram_join.one_of_each(docs).orderBy("doc_id").collect()] == [0, 2]


def test_pairs_of_a_group_by_matrix_and_one_by_one():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    expected = [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(a, b, strict=True)]
    assert ngram_join.intersections(sets, a, b).tolist() == expected
    assert ngram_join.intersections(sets, a[:7], b[:7]).tolist() == expected[:7]


def test_posterior_limits_keep_likely_pairs():
    limits = ngram_join.posterior_limits()
    assert (np.diff(limits) > 0).all()
    n = ngram_join.HASHES
    lost = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(int(limits[-1])))
    assert lost < 1e-6


# 6


def test_op6(spark, sf_dir, library, documents):
    place = 0
    for r in sorted(queries.op6_binary_records(spark, sf_dir).collect()):
        ids = [*library.encode(documents[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)


def test_records_by_offset_and_damage(spark, library, monkeypatch):
    monkeypatch.setattr(binary_records, "MOST_SHARD_TEXT_BYTES", 4096)
    monkeypatch.setattr(binary_records, "FILES_TOGETHER", 3)
    folder = scratch(spark, "test-records")
    docs = table(spark, ODD, [5, 4, 3, 2, 1, 0, 9, 8, 9, None])
    binary_records.write_records(docs, PATH, folder, shard_text_bytes=4096)
    index = spark.read.parquet(f"{folder}/index")
    assert index.count() == len(ODD) and index.select("file").distinct().count() > 1
    expected = Counter((r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in binary_records.read_records(spark, folder).collect()) == expected
    some = index.filter(F.col("offset") % 3 > 0)
    assert Counter(r["doc_id"] for r in binary_records.read_at(spark, folder, some).collect()) == Counter(r["doc_id"] for r in some.collect())
    good = binary_records.frame(1, b"\x01\x00\x0a\x00", 2)
    assert binary_records.parse(memoryview(good), 0)[1].tolist() == [1, 10]
    for k in range(len(good) - 1):
        with pytest.raises(ValueError):
            binary_records.parse(memoryview(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]), 0)
    empty = scratch(spark, "test-records")
    binary_records.write_records(table(spark, []), PATH, empty)
    assert binary_records.read_records(spark, empty).count() == 0


# 7


def test_fingerprints(spark, sf_dir, documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_TEXT_BYTES", 30_000)
    monkeypatch.setattr(fingerprints.in_ranges, "__defaults__", (30_000,))
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, sf_dir).collect()}
    ids = sorted(documents)
    errors, seen = [], defaultdict(set)
    for i, d in enumerate(ids):
        text, after = documents[d], documents[ids[(i + 1) % len(ids)]]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(text)
        a, b = shingles(text), shingles(edited)
        errors.append(got[d]["near_edited"] - len(a & b) / len(a | b))
        seen[text].add(got[d]["fingerprint"])
    assert len(got) == len(ids) and all(len(s) == 1 for s in seen.values())
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06


def plain_fingerprint(text):
    """The lanes by loops and sets, with the hash that Spark's function is defined by (XXH64, seed 42, chained)."""
    import struct

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    many = lambda values, size: __import__("functools").reduce(lambda seed, v: xxhash.xxh64(v.to_bytes(size, "little", signed=True), seed).intdigest(), values, 42)
    words = [signed(xxhash.xxh64(w, 42).intdigest()) for w in (text or "").encode().split()]
    hashes = {signed(many(words[i : i + 5], 8)) for i in range(max(1, len(words) - 4))}
    bins = {}
    for h in hashes:
        k = (h >> 57) + 64
        bins[k] = min(bins.get(k, h), h)
    out = []
    for b in range(128):
        if b not in bins:
            tried = [signed(many((b, t), 4)) % 128 for t in range(8)]
            found = next((k for k in tried if k in bins), None)
            out.append(bins[min(bins, key=lambda k: (signed(many((b, k + 8), 4)), k)) if found is None else found])
        else:
            out.append(bins[b])
    assert struct.calcsize("q") == 8
    return "".join(f"{x & 255:02x}" for x in out)


def test_fingerprints_by_brute_force(spark, documents):
    texts = [t or "" for t in ODD] + [documents[d] for d in sorted(documents)[:40]]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(table(spark, texts)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    edited = fingerprints.edited_fingerprints(table(spark, texts)).collect()
    for r in edited:
        i = r["doc_id"]
        text, after = texts[i], texts[(i + 1) % len(texts)]
        k = len(text) // 4
        lanes = [plain_fingerprint(t) for t in (text, text[: len(text) - k] + after[:k], after)]
        like = [max(0.0, (sum(lanes[0][j : j + 2] == x[j : j + 2] for j in range(0, 256, 2)) / 128 - 1 / 256) / (1 - 1 / 256)) for x in lanes[1:]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (lanes[0], lanes[1]) and [r["near_edited"], r["near_next"]] == pytest.approx(like)


def test_ranges_split_hot_ids_in_order(spark):
    rng = random.Random(3)
    ids = [None] * 400 + [7] * 500 + [rng.randrange(1000) for _ in range(600)] + [(1 << 63) - 1] * 200
    rows_ = table(spark, [f"text {i}" for i in range(len(ids))], ids)
    got = fingerprints.in_ranges(rows_, range_text_bytes=500).select("bucket", "doc_id", F.xxhash64("text").alias("h")).collect()
    assert max(Counter(r["bucket"] for r in got).values()) < 200 and len(got) == len(ids)
    ordered = sorted(got, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["h"]))
    assert [r["bucket"] for r in ordered] == sorted(r["bucket"] for r in got)
    texts = [f"text {i} {'x' * (i % 50)}" for i in range(300)]
    docs = table(spark, texts, [None] * 150 + [4] * 150)
    one, many = ([tuple(r) for r in fingerprints.with_next(d.select("doc_id", "text"), {"n": F.length("text")}).select("doc_id", "text", "next.text").collect()] for d in (docs.limit(300).coalesce(1), docs))
    assert sorted(one, key=str) == sorted(many, key=str) and len({t for _, _, t in many}) == 300


def test_fingerprints_odd_rows(spark):
    got = fingerprints.edited_fingerprints(table(spark, ODD, [1, 2, 3, 4, 4, None, 6, 7, 8, 9])).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.edited_fingerprints(table(spark, [])).count() == 0
    assert fingerprints.fingerprints(table(spark, [None, "", "  "])).select("fingerprint").distinct().count() == 1


# 8


def check_packing(pieces, texts, library):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for d, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc.pop(d), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())) and p["length"] > 0
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    return padding / max(total, 1)


def test_op8(spark, sf_dir, library, documents):
    assert check_packing(queries.op8_packing(spark, sf_dir).collect(), documents, library) < 0.01


def test_packing_in_blocks_and_odd_rows(spark, library):
    packer = packing._Packer(64, np.zeros(10, bool), 0)
    packer_rows, rng = [], np.random.default_rng(0)
    packing_block, packing.BLOCK_TOKENS = packing.BLOCK_TOKENS, 500
    try:
        docs = [rng.integers(2, 9, n).astype("<u2") for n in (1, 3000, 0, 70, 64, 499)]
        for i, ids in enumerate(docs):
            packer_rows += packer.add(i, ids)
        packer_rows += packer.flush(True)
    finally:
        packing.BLOCK_TOKENS = packing_block
    for i, ids in enumerate(docs):
        own = sorted(r for r in packer_rows if r[0] == i)
        assert sum(r[2] for r in own) == len(ids) and all(r[3] == zlib.crc32(ids[r[1] : r[1] + r[2]].astype("<u4").tobytes()) for r in own)
    assert max(Counter(r[5] for r in packer_rows for _ in range(r[2])).values()) <= 64
    assert check_packing(packing.pack(table(spark, ODD), PATH).collect(), dict(enumerate(ODD)), library) < 0.05
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(0)
    for _ in range(30):
        places = sorted(rng.sample(range(1, 60), 20))
        places = [0, *places]
        costs = [rng.choice([0, 1, 4]) for _ in places]
        length = 25
        if max(b - a for a, b in zip(places, places[1:], strict=False)) > length:
            continue
        best = {0: 0.0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + length - (places[j] - places[i]) + costs[j] for i in range(j) if places[j] - places[i] <= length)
        assert packing.cut_windows(places, costs, length)[1] == [best[j] for j in range(len(places))]


# 9


def brute_repeats(texts, size=100):
    seen, out = set(), {}
    for d, text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            window = data[p : p + size]
            if window in seen:
                gone[p : p + size] = b"\x01" * size
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[d] = (len(data), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 4096])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(50, 400))) for _ in range(12)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 30) : rng.randint(60, 400)] if rng.random() < 0.7 else rng.choice(["a" * 150, "ab" * 130, "x!" * 60, "q"]) for _ in range(rng.randint(0, 6))) for _ in range(150)] + [None, "", "z" * 99, "z" * 350]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.repeats(table(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join([word() for _ in range(rng.randint(0, 30))] + [passage[rng.randint(0, 60) :]] + [word() for _ in range(rng.randint(0, 30))]) for _ in range(400)]
    rows_ = with_rows(table(spark, texts))
    assert suffix_dedup.hot_anchors(rows_).count() > 0
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix_dedup.repeats(table(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_marks_after_words_are_chunks_of_their_own(library):
    from gridloom.llm import tokenizer

    encoder, automaton = tokenizer.TextEncoder(tokenizer.read_tokenizer(PATH)), bpe_automaton.Automaton(tokenizer.read_tokenizer(PATH))
    calls = []
    encoder.chunks.encode = lambda x: calls.append(x) or encoder._piece(x)
    words = ["heat***", "heat$$$", "heat%%%###", "heat(", "don't", "heat'", "heat'.", "ßx&&&", "ɐx|||"]
    for text in [*words, *(f"a {w} {w}\n{w} b" for w in words), " ".join(words), "<|endoftext|> heat*** <|endoftext|>"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == ids == automaton.encode(text)
        assert automaton.write(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    assert not [x for x in calls if x[-1] in "*$#&"]


def test_frequent_chunks_outlive_a_task():
    from gridloom.llm import tokenizer

    made = []
    chunks = tokenizer.Chunks(lambda x: made.append(x) or x.encode(), b"".join, limit=4)
    for w in "abcdef":
        chunks[w]
    chunks.settle()
    assert not chunks.old and len(chunks) == 4
    made.clear()
    assert [chunks[w] for w in "abef"] == [b" a", b" b", b" e", b" f"] and not made


def test_few_windows_stay_open_at_the_edges_of_buckets():
    rng = random.Random(31)
    gram, size, n = b"-the anchor of all runs-", suffix_dedup.LENGTH, suffix_dedup.SHARED
    side = lambda: bytes(rng.choice(b"abcdefgh") for _ in range(76))
    lefts, rights = [side() for _ in range(30)], [side() for _ in range(30)]
    rights += [r[:40] + side()[:36] for r in rights]
    contents = sorted({rng.choice(lefts) + gram + rng.choice(rights) for _ in range(600)}, key=lambda c: c[76:])
    windows = {}  # each window to its places, in order
    for row, c in enumerate(contents):
        for at in range(n):
            windows.setdefault(c[at : at + size], []).append((row, at))
    later = {p for places in windows.values() for p in places[1:]}
    found, open_ = set(), {}
    for cut in range(0, len(contents), 128):
        own = list(range(cut, min(cut + 128, len(contents))))
        full = np.full(len(own), n)
        (row, at, count), left = suffix_dedup.compare_bucket(np.array(own), 0 * full, full, full - 1, [contents[i] for i in own])
        found |= {(r, a + k) for r, a, c in zip(row.tolist(), at.tolist(), count.tolist(), strict=True) for k in range(c)}
        for h1, h2, r, a in zip(*(x.tolist() for x in left), strict=True):
            open_.setdefault((h1, h2), []).append((r, a))
    found |= {p for places in open_.values() for p in sorted(places)[1:]}
    assert found == later
    # one or two sides' bytes in common, not all windows of all contents
    assert sum(map(len, open_.values())) < len(contents) * n / 4


def test_runs_of_anchors_that_repeat_are_cut_by_place():
    content = b"xy" * 10 + (b"the same words again and " * 8)[:150]
    gram = content[30 : 30 + suffix_dedup.GRAM]
    n = len(content) - suffix_dedup.LENGTH + 1
    pieces = list(suffix_dedup.one_place(500, n, 30, content))
    assert len(pieces) > 1 and [p[0] for p in pieces] == [500, *np.cumsum([p[1] for p in pieces]) + 500][:-1] and sum(p[1] for p in pieces) == n
    for at, count, anchor_at, own in pieces:
        assert own == content[at - 500 : at - 500 + count + suffix_dedup.LENGTH - 1]
        assert all(own.find(gram, k) == anchor_at for k in range(count))


def test_runs_of_hot_anchors_are_dealt_where_they_are_found(spark):
    rng = random.Random(14)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows_ = with_rows(table(spark, [passage[k:] + str(k) for k in range(40)]))
    plain = suffix_dedup.find_runs(rows_).collect()
    hot = Counter(r["anchor"] for r in plain).most_common(1)[0][0]
    dealt = suffix_dedup.find_runs(rows_, {hot: 3}).collect()
    assert sorted(tuple(r)[:4] for r in dealt) == sorted(tuple(r)[:4] for r in plain) and all(r["part"] is None for r in plain)
    assert {r["part"] for r in dealt if r["anchor"] == hot} == {0, 1, 2} and {r["part"] for r in dealt if r["anchor"] != hot} == {None}


def test_suffix_dedup_of_texts_over_a_block(spark, monkeypatch):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefgh é") for _ in range(600_000))
    texts = [long, "x" + long[300_000:] + long[:200], None]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeats(table(spark, texts)).collect()}
    assert got == {i: r[1] for i, r in brute_repeats(list(enumerate(texts))).items()}


def test_op9(spark, sf_dir, documents):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op9_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute_repeats(sorted(documents.items()))


def test_suffix_dedup_odd_rows(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh é") for _ in range(300))
    assert sorted(r["n_removed"] for r in suffix_dedup.repeats(table(spark, [text, text, None, "x" + text], [4, 4, None, None])).collect())[:2] == [0, 0]
    assert suffix_dedup.repeats(table(spark, [])).count() == 0
    kept = suffix_dedup.remove_repeats(table(spark, [text, "é" + text + "é", None])).orderBy("doc_id").collect()
    assert [r["text"] for r in kept] == [text, "éé", ""] and kept[1]["n_chars"] == 2 and kept[0]["row"] == "x"


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (2000, 4)).astype(np.uint64)
    assert (words[suffix_dedup.multikey_order(words)] == words[np.lexsort(words.T[::-1])]).all()


def test_runs_cover_parts_of_long_texts():
    import pyarrow as pa

    data = bytes(random.Random(4).choice(b"abcdef ") for _ in range(1000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([data.decode()])], names=["row", "text"])
    before, suffix_dedup.BLOCK_BYTES = suffix_dedup.BLOCK_BYTES, 256
    try:
        parts = [(o, h) for _, offsets, held in suffix_dedup._blocks([batch]) for o, h in zip(offsets, held, strict=True)]
    finally:
        suffix_dedup.BLOCK_BYTES = before
    windows = {o + i for o, h in parts for i in range(len(h) - suffix_dedup.LENGTH + 1)}
    assert windows == set(range(len(data) - suffix_dedup.LENGTH + 1))


# 10


def test_op10(spark, sf_dir, documents):
    tokens = {d: [*t.encode().lower().split(), b" "] for d, t in documents.items()}
    counts = Counter(w for d, own in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    gain = []
    for r in queries.op10_lm_scoring(spark, sf_dir).collect():
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / len(own))
    assert np.mean(gain) > 0


def class_log(model, before, word):
    """log10 of a class's probability after the classes ``before`` (nearest first), by the definition."""
    h = sum(model.q[c].astype(float) * model.m[k] for k, c in enumerate(before))
    scores = [float(h @ r) + float(b) for r, b in zip(model.r.astype(float), model.b, strict=True)]
    return (scores[word] - math.log(math.fsum(map(math.exp, scores)))) / math.log(10)


def test_lm_score_by_the_definition(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 5)  # most counts are joined
    texts = ODD[:5] + ODD[6:] + ["a b c a b", "a b d", "zzz of a"]
    docs = table(spark, texts, [*range(9), None, 3, 2])
    counts = lm_scoring.word_counts(docs)
    vocabulary = lm_scoring.Vocabulary(counts)
    model = lm_scoring.train(docs, vocabulary)
    known = {bytes(r["word"]): r["c"] for r in counts.collect()}
    expected = Counter()
    for t in texts:
        tokens = [*(t or "").encode().lower().split(), b" "]
        ids = [0] * 3 + [vocabulary.class_of(w) for w in tokens]
        total = 0.0
        for k, w in enumerate(tokens):
            total += class_log(model, ids[k : k + 3][::-1], ids[k + 3])
            own = {x: c for x, c in known.items() if vocabulary.class_of(x) == ids[k + 3]}
            if w not in vocabulary.single:
                share = known[w] - vocabulary.discount if w in known else vocabulary.discount * len(own) + 1
                total += math.log10(share / (sum(own.values()) + 1))
        expected[round(total, 3)] += 1
    got = lm_scoring.score(docs, counts, vocabulary, model).collect()
    assert Counter(round(r["score"], 3) for r in got) == expected
    # all seen words and the classes' places for unseen ones sum to 1
    z = sum(10 ** class_log(model, (0, 0, 0), vocabulary.class_of(w)) * 10 ** vocabulary.share(w, c) for w, c in known.items())
    for k in range(lm_scoring.CLASSES):
        p = 10 ** class_log(model, (0, 0, 0), k)
        inside = [w for w in known if vocabulary.class_of(w) == k]
        z += p * (1 if not inside else 0 if k < lm_scoring.SINGLE else (vocabulary.discount * len(inside) + 1) / (sum(known[w] for w in inside) + 1))
    assert z == pytest.approx(1.0, abs=1e-4)
    assert lm_scoring.lm_scoring(table(spark, [])).count() == 0


def test_lm_deals_equal_ids_over_shards(spark):
    docs = table(spark, [f"some words {i}" for i in range(200)], [None] * 200)
    events = lm_scoring._events(docs, lm_scoring.Vocabulary(lm_scoring.word_counts(docs)), 4)
    assert events.count() == 200 and events.select("turn", "shard").distinct().count() > 4


def test_scratch_tables_of_threads_are_apart(spark):
    begun, own = mark(), materialise(spark.range(3), "own")

    def other():
        since = mark()
        [materialise(spark.range(k), "other") for k in (1, 2)]
        free(spark, since)
        return since, mark()

    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(other).result() == (0, 1)
    assert mark() == begun + 1 and own.count() == 3


def test_lm_takes_long_texts(spark):
    got = lm_scoring.lm_scoring(table(spark, [LONG * 10, LONG * 10, "word", None])).orderBy("doc_id").collect()
    assert got[0]["n_tokens"] == 80_001 and got[0]["score"] == pytest.approx(got[1]["score"]) and math.isfinite(got[3]["score"])


def test_lm_gains_over_its_unigram_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = lm_scoring.word_counts(docs)
    vocabulary = lm_scoring.Vocabulary(counts)
    model = lm_scoring.train(docs, vocabulary)
    again = lm_scoring.train(docs.repartition(3, "n_chars"), vocabulary)
    assert np.array_equal(model.table(), again.table())  # whatever the split of the input

    def means():
        rows_ = lm_scoring.score(docs, counts, vocabulary, model).groupBy("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).collect()
        return {r[0]: (r[1] / r[3], r[2] / r[3]) for r in rows_}

    learned = means()
    model.q[:] = 0
    unigram = means()
    assert learned[True][0] - unigram[True][0] > 0.15 and all(learned[h][0] > learned[h][1] for h in (True, False))


def test_lm_looks_normalisers_up_by_pair(monkeypatch):
    rng = np.random.default_rng(6)
    unigram = rng.random(lm_scoring.CLASSES) + 0.1
    before, word = rng.integers(0, 40, (3000, 3)).astype(np.int32), rng.integers(0, lm_scoring.CLASSES, 3000)
    for most in (40, 200, 1000):  # single precision, double precision, no tables
        model = lm_scoring.Model(unigram / unigram.sum())
        model.q *= (most - np.abs(model.b).max()) / sum(np.abs((model.q * m) @ model.r.T).max() for m in model.m)
        tables = lm_scoring.Normalisers(model)
        wanted = model.log_probabilities(before, word)
        if most < 1000:
            assert tables.far.dtype == (np.float32 if most == 40 else np.float64)
            with monkeypatch.context() as patch:
                patch.delattr(lm_scoring.Model, "log_probabilities")  # a normaliser for each word
                got = tables.log_probabilities(before, word)
                patch.setattr(tables, "_meet", lambda pairs: pytest.fail() if len(pairs) else None)
                again = tables.log_probabilities(before[::-1], word[::-1])
            assert np.array_equal(got, again[::-1]) and tables.met == len({tuple(b) for b in before[:, :2].tolist()})
        else:
            assert not tables.bounded
            got = tables.log_probabilities(before, word)
        assert np.allclose(got, wanted, rtol=1e-5, atol=1e-4)


def test_lm_scorer_makes_no_normaliser_a_word(spark, monkeypatch):
    docs = table(spark, ["some words of a text", "some other words of it", "é x"])
    vocabulary = lm_scoring.Vocabulary(lm_scoring.word_counts(docs))
    model = lm_scoring.Model(vocabulary.unigram)
    texts = [lm_scoring.words(memoryview(t.encode())) for t in ("some words of it", "é é unseen A b", "")]
    wanted = []
    for t in texts:
        ids = [0] * lm_scoring.CONTEXT + [vocabulary.class_of(w) for w in t]
        wanted.append(sum(class_log(model, ids[k : k + 3][::-1], ids[k + 3]) for k in range(len(t))))
        # the count of a word outside the head is joined later
        wanted[-1] += sum(vocabulary.share(w, vocabulary.head[w]) if w in vocabulary.head else -math.log10(vocabulary.tokens[vocabulary.class_of(w)] + 1) for w in t)
    monkeypatch.delattr(lm_scoring.Model, "log_probabilities")
    out = [[] for _ in range(4)]
    lm_scoring._Scorer(vocabulary, model.table()).add(texts, out, lm_scoring._Tail())
    assert out[3] == pytest.approx(wanted, abs=1e-4) and out[0] == [5, 6, 1]


@pytest.mark.parametrize("held", [1, 32 << 20])
def test_lm_counts_words_by_the_definition(spark, monkeypatch, held):
    monkeypatch.setattr(lm_scoring, "COUNTED_BYTES", held)
    texts = [t for t in ODD if t] + ["", None, " ", "\t A\x0bb\x0c\r\n", "\x1c \x85\u2003É é\x00 a", "b " * 2000]
    docs = table(spark, texts, [k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 != 2][: len(texts)])
    wanted = Counter(w for t in texts for w in lm_scoring.words(memoryview((t or "").encode())))
    assert {bytes(r["word"]): r["c"] for r in lm_scoring.word_counts(docs).collect()} == wanted


def test_lm_classes_of_words(spark, documents):
    vocabulary = lm_scoring.Vocabulary(lm_scoring.word_counts(table(spark, [*documents.values()][:50])))
    own = [w for t in [*documents.values(), "a \xe9 \u4e2d \U0001f600 b"] for w in lm_scoring.words(memoryview(t.encode()))]
    assert lm_scoring.classes_of(own, vocabulary.single, lm_scoring._Groups()) == [*map(vocabulary.class_of, own)]


def test_nce_step_follows_the_gradient(monkeypatch):
    rng = np.random.default_rng(4)
    unigram = rng.random(lm_scoring.CLASSES) + 0.1
    model = lm_scoring.Model(unigram / unigram.sum())
    before, word = rng.integers(0, lm_scoring.CLASSES, (40, 3)), rng.integers(0, lm_scoring.CLASSES, 40)
    noise = np.searchsorted(model.cumulative, np.random.default_rng(9).random(lm_scoring.NOISE))

    def objective(r):
        h = (model.q[before].astype(float) * model.m).sum(axis=1)
        true = (h * r[word]).sum(axis=1) + model.b[word] - model.log_noise[word]
        false = h @ r[noise].T + model.b[noise] - model.log_noise[noise]
        return -np.logaddexp(0, -true).sum() - np.logaddexp(0, false).sum()

    r = model.r.astype(float)
    k, j = int(word[0]), 5
    up, down = r.copy(), r.copy()
    up[k, j] += 1e-4
    down[k, j] -= 1e-4
    slope = (objective(up) - objective(down)) / 2e-4
    past = model.past[1][k]
    model.learn(before, word, np.random.default_rng(9))
    step = (model.r[k, j] - r[k, j]) * math.sqrt(model.past[1][k]) / lm_scoring.RATE
    assert step == pytest.approx(slope, rel=1e-3) and model.past[1][k] > past
