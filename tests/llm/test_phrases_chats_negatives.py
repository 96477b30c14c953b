"""Operators 11 to 13: against SQL on whole tables (in ``test_operators``), and here plain loops and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, hard_negatives, phrases

# 11


def plain_phrases(docs, top, least):
    """(lang, text) rows to (lang, rank, phrase, a, l, r, n, score)."""
    counts, n = Counter(), Counter()
    for lang, text in docs:
        lang, piece = lang if lang is not None else "und", []
        for c in [*(text or ""), "\n"]:
            if c in ".,;:!?\n\x0b\x0c\r":
                words = [w for w in "".join(piece).replace("\t", " ").split(" ") if w]
                n[lang] += len(words)
                counts.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
                piece = []
            else:
                piece.append(c.lower() if "A" <= c <= "Z" else c)
    out = {}
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if len(p) == 2 and any(len(q) == 3 and lang == m and p in (q[:2], q[1:]) and f >= least and 100 * f >= 50 * a for (m, q), f in counts.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


def of_docs(spark, docs):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, 1, 2, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, block int, pair int, word string")


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_phrases_by_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rng = random.Random(5)
    words = ["a", "B", "b", "Éa", "éa", "the", "the", "of", "x1", "日本", "<s>", " ", "it's"]
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    docs += [("en", None), ("en", ""), ("en", " \t.."), (None, "ha " * 500)] + [("en", "one two three")] * 15
    for top, least in ((2000, 10), (3, 2)):
        got = {tuple(r) for r in phrases.phrases(of_docs(spark, docs), top, least).collect()}
        assert got == plain_phrases(docs, top, least)


def test_phrases_of_nothing(spark):
    assert phrases.phrases(of_docs(spark, [("en", "a b")]).limit(0)).collect() == []
    assert phrases.phrases(of_docs(spark, [("en", None), (None, "rare words only")])).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    a, l, r = 4_000_000_007, 4_000_000_009, 4_000_000_011
    got = spark.range(1).select(phrases.score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (l * r)


def test_trie_counts_equal_a_counter():
    rng = np.random.default_rng(1)
    for n, v in ((0, 1), (1, 1), (2, 1), (60, 3), (3000, 300), (60_000, 70_000)):
        codes = (np.minimum(rng.zipf(1.2, n), v) * 7 - 7).astype(np.int32)
        codes[rng.random(n) < 0.2] = -1
        keys, counts = phrases.count_pairs(codes)
        own = codes.tolist()
        pairs = Counter(x << 31 | y for x, y in zip(own, own[1:]) if x >= 0 and y >= 0)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == pairs
        known = {k for k, c in pairs.items() if c > 2}
        left, third, counts = phrases.count_triples(codes, np.array(sorted(known), np.int64))
        triples = Counter((x << 31 | y, z) for x, y, z in zip(own, own[1:], own[2:]) if min(x, y, z) >= 0 and {x << 31 | y, y << 31 | z} <= known)
        assert dict(zip(zip(left.tolist(), third.tolist(), strict=True), counts.tolist(), strict=True)) == triples


# 12


def chats(spark, turns):
    return spark.createDataFrame([(*t, 1, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, own int, segments string, `at` string")


def test_chats_by_a_plain_loop(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "<<SYS>>", "<</SYS>>", "<sep>", "[ROLE]", "[END]", "<", "[", "\\", "$1", " ", "\n", "é😀", "END]", "s>"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 8)))])
    turns = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(30)]), rng.choice(["user", "user", "assistant", "system", "tool", "[END]<s>", "", None]), text()) for _ in range(400)]
    turns += turns[:5] + [(9, 0, "assistant", None), (10, 0, None, None), (11, 0, "user", "long " * 200_000), (11, 1, "assistant", "<s>" * 1000)]
    made = chat_format.chat_format(chats(spark, turns))
    got = {r["conv_id"]: r for r in made.select("conv_id", "segments", chat_format.formatted(F.col("segments")).alias("text"), chat_format.read_turns(chat_format.formatted(F.col("segments"))).alias("turns")).collect()}
    digests = {r["conv_id"]: r for r in chat_format.chat_digests(made).collect()}
    spans = {}
    for r in chat_format.loss_spans(made).orderBy("start").collect():
        spans.setdefault(r["conv_id"], []).append(got[r["conv_id"]]["text"][r["start"] : r["start"] + r["length"]])
    by = {}
    for conv, turn, role, text_ in turns:
        by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text_ or "").encode()))
    assert set(got) == set(by) == set(digests)
    for conv, own in by.items():
        own = [(role.decode(), text_.decode()) for _, _, role, text_ in sorted(own)]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        said = "".join(t for role, t in own if role == "assistant")
        d = digests[conv]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(own), len(said), len(got[conv]["text"]))
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert spans.get(conv, []) == [s["text"] for s in got[conv]["segments"] if s["loss"]]
        texts = [s["text"] for s in got[conv]["segments"] if s["loss"] or s["text"] not in chat_format.LLAMA.marks]
        assert not any(mark in t for t in texts for mark in chat_format.LLAMA.marks if not t.startswith("[ROLE]"))


def test_adjacent_turns_of_a_role_are_one_block(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")]
    made = chat_format.chat_format(chats(spark, turns)).select(chat_format.formatted(F.col("segments")).alias("text")).first()
    assert made["text"] == "[INST]a<sep>b[/INST]<s>c<sep>d</s>"
    assert chat_format.chat_format(chats(spark, turns).limit(0)).collect() == []


def test_templates_whose_marks_can_be_mistaken_are_refused():
    with pytest.raises(ValueError):
        chat_format.Template(between="<s")
    with pytest.raises(ValueError):
        chat_format.Template(roles={"user": ("<a<", "b>")})


# 13


def plain_negatives(rows):
    rows = [(v, ((label + 1) % 10 if v % 7 == 0 else label), [int(np.floor(256 * np.float64(x))) for x in e]) for v, label, e in rows if v is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    end = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = Counter()
    for i, (v, label, e) in enumerate(rows):
        if v % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f)), w, k) for k, (w, _, f) in enumerate(rows) if k != i)
        for s, p, _ in [x for x in scored if rows[x[2]][1] == label][:5]:
            found = [(w, t) for t, w, k in scored if rows[k][1] != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out.update((v, p, n, w, end(-s), end(-t)) for n, (w, t) in enumerate(found, 1))
    return out


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, `row` int, part string").select("vec_id", "label", "embedding", "row", "part")


@pytest.mark.parametrize("size", ["small", "wide", "huge"])
def test_hard_negatives_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    rng = np.random.default_rng(2)
    scale = {"small": 0.2, "wide": 3e4, "huge": 1e30}[size]
    vec = lambda: [float(np.float32(x)) for x in rng.normal(0.3, 1, 5) * scale]
    same = vec()
    rows = [(int(i), rng.choice([0, 1, 6]).item(), same if i % 3 == 0 else vec()) for i in [*range(0, 1300, 100), *rng.integers(1, 2000, 60)]]
    rows += rows[:2] + [(None, 1, vec()), (200, None, vec()), (200, 1, None), (7, 1, [1.0, None, 1.0, 1.0, 1.0]), (300, 1, [float("inf")] * 5), (5, 0, [float("nan")] * 5), (-100, 0, vec()), (400, 1, vec()[:3]), (500, 1, [])]
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, [(v, e, label) for v, label, e in rows])).collect())
    assert got == plain_negatives(rows) and got


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(vectors(spark, [(1, [1.0], 1)])).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(100, [1.0], 1)]).limit(0)).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(100, [1.0], 1), (1, [1.0], 2)])).collect() == []


def test_packed_scores_are_exact():
    rng = np.random.default_rng(4)
    for top in (1, 200, 1 << 20, 1 << 49, 1 << 60, 1 << 140):
        a, c = ([[int(x * top) for x in row] for row in rng.uniform(-1, 1, (n, 6))] for n in (3, 37))
        whole = lambda rows: np.array(rows, np.float64)
        got = hard_negatives.packed_scores(whole(a), whole(c))
        a, c = ([[int(x) for x in row] for row in whole(rows).tolist()] for rows in (a, c))
        assert [[int(x) for x in row] for row in got] == [[sum(x * y for x, y in zip(p, q)) for q in c] for p in a]


def test_descending_texts_sort_by_integers():
    numbers = [0, 1, -1, 15, 16, -16, 10**30, -(10**30), 2**300, 255, 256]
    assert sorted(numbers, key=hard_negatives.descending) == sorted(numbers, reverse=True)
