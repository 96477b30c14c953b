"""The pipeline's stages, and the whole of it against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import line_dedup, ngram_join, suffix_dedup
from gridloom.llm.common import DOCUMENT_COLUMNS, materialise, read_table
from gridloom.llm.tokenizer import public_tokenizer

from .test_operators import brute_groups, check_packing, removed_lines


def words(text):
    return text.encode().split()


def base_failed(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for own in seen.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    return len(w) < 20 or 100 * len(hit) > 30 * len(w)


def cut_repeats(texts):
    seen, out = set(), {}
    for d, text in texts:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(window)
        out[d] = bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_run_by_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = sorted((r["doc_id"], r["text"] or "") for r in read_table(spark, sf_dir, "documents").collect())
    docs = [d for d in docs if not base_failed(d[1])]  # no host of this table fails
    gone = removed_lines([t for _, t in docs], 3)
    kept = []
    for (d, text), own in zip(docs, gone, strict=True):
        k, lines = 0, []
        for line in text.split("\n"):
            if line.strip():
                if k not in own:
                    lines.append(line)
                k += 1
            else:
                lines.append(line)
        if not own or k > len(own):
            kept.append((d, "\n".join(lines)))
    groups = brute_groups([t for _, t in kept])
    kept = [doc for i, doc in enumerate(kept) if groups[i][0] == i]
    final = cut_repeats(kept)
    padding = check_packing(corpus_pipeline.run(spark, sf_dir).collect(), final, Tokenizer.from_file(public_tokenizer()))
    assert padding < 0.01


def test_stages_return_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == list(DOCUMENT_COLUMNS)
        assert docs.filter("n_chars <> length(text)").count() == 0
    empty = read_table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


@pytest.fixture(scope="module")
def odd_and_numbered(spark, sf_dir):
    """Documents with nulls in every column and repeated doc_ids and rows (lang tells them apart), and the same with
    doc_ids that count them in the order of doc_id (nulls first) and text."""
    own = [tuple(r) for r in read_table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS).orderBy("doc_id").collect()]
    odd = [(None if i % 5 == 0 else i // 3 * 7, text, str(i), None if i % 11 == 0 else source, None if i % 13 == 0 else n) for i, (_, text, _, source, n) in enumerate(own)]
    odd += [odd[i] for i in (0, 1, 2, 50, 51)] + [(None, None, None, None, None)] * 2 + [(4, None, "null", "s", 0), (10**9, odd[3][1], "copy", None, None)]
    odd = spark.createDataFrame(odd, read_table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS).schema)
    ordered = odd.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.col("doc_id").asc_nulls_first(), "h", "text").drop("h").collect()
    numbered = [(i, *r[1:]) for i, r in enumerate(ordered)]
    return odd, spark.createDataFrame(numbered, odd.schema), [r["doc_id"] for r in ordered]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_takes_null_and_repeated_doc_ids(spark, sf_dir, odd_and_numbered, name):
    odd, numbered, ids = odd_and_numbered
    stage = dict(corpus_pipeline.STAGES)[name]
    found = Counter(tuple(r) for r in stage(spark, odd, sf_dir).select("*").collect())
    expected = [r.asDict() for r in stage(spark, numbered, sf_dir).collect()]
    assert expected and found == Counter(tuple((r | {"doc_id": ids[r["doc_id"]]}).values()) for r in expected)


def test_stages_keep_columns_of_inner_names_and_take_long_texts(spark, sf_dir):
    names = ["_row", "_doc", "_no_text", "row", "rep", "label", "runs", "spans", "at", "n", "_part", "bucket", "values", "size", "anchor"]
    long = "\n".join(f"line {i} of a text that goes on and on" for i in range(30_000))
    rows = [(1, long), (2, "x\n" + long), (3, None), (None, "short text"), (3, "short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *([k] * len(names))) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for stage in (line_dedup.remove_runs, ngram_join.one_of_each, suffix_dedup.remove_repeats):
        out = stage(docs)
        assert out.columns == docs.columns
        kept = {r["row"]: r for r in out.collect()}
        assert kept[0]["text"] == long and all(r[n] == k for k, r in kept.items() for n in names)
    assert {k: r["text"] for k, r in ((r["row"], r) for r in line_dedup.remove_runs(docs).collect())} == {0: long, 1: "x", 2: "", 3: "short text", 4: "short text"}
    assert sorted(r["row"] for r in ngram_join.one_of_each(docs).collect()) == [0, 2, 3]
