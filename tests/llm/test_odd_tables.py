"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib

import pytest

import corpus_pipeline
from fanweave.llm import oracles, queries
from tests.llm.conftest import rows, sql

SOURCE = {"op5_chat_formatting": "conversations", "op9_warc": "pages"}
NOT_BY_ROW = {"op5_chat_formatting", "op12_prefix_trie", "op13_whitening"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    got = queries.QUERIES[name](spark, empty_dir).collect()
    assert len(got) == (1 if name == "op5_chat_formatting" else 0)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - NOT_BY_ROW))
def test_one_row_for_each_row(spark, odd_dir, name):
    source = SOURCE.get(name, "documents")
    key = "page_id" if source == "pages" else "doc_id"
    got = queries.QUERIES[name](spark, odd_dir)
    want = rows(spark.read.parquet(f"{odd_dir}/{source}.parquet").select(key))
    assert sorted(((r[key],) for r in got.collect()), key=repr) == want


def by_text(spark, odd_dir, name):
    got = queries.QUERIES[name](spark, odd_dir).collect()
    return {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 1)}


def test_toxicity(spark, odd_dir):
    got = queries.op1_toxicity(spark, odd_dir).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (2, 3, 6)}
    assert len(same) == 1                      # null, empty and blank texts score alike


def test_token_archive(spark, odd_dir):
    got = queries.op2_token_archive(spark, odd_dir).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 6)} == {1}


def test_language(spark, odd_dir):
    got = by_text(spark, odd_dir, "op3_language_id")
    for doc in (2, 3, 6, 11):                  # null, empty, blank, no letter
        assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0.0)
    assert got[4]["lang_pred"] in ("en", "fr")


def test_repeats(spark, odd_dir):
    got = queries.op4_suffix_dedup(spark, odd_dir).collect()
    copies = [r for r in got if r["n_bytes"] == 85 * 8]
    assert len(copies) == 4 and all(r["n_removed"] == 680 and r["n_spans"] == 1 for r in copies)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["kept_sha256"] == nothing for r in copies)
    assert [r["n_removed"] for r in got if r["doc_id"] == 10] == [3000]
    assert all(r["kept_sha256"] == nothing and r["n_bytes"] == 0 for r in got
               if r["doc_id"] in (2, 3))


def test_chat(spark, odd_dir):
    got = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, odd_dir).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {-7, 1, 2, 3, None}
    assert got[1]["turns_sha256"] == sha("user\nhi </s>\nassistant\n\nassistant\nb\\e\\b<s>\n")
    assert got[1]["loss_sha256"] == sha("b\\e\\b<s>")
    assert got[2]["loss_sha256"] == sha("[INST] \\ <|image|>" * 2)
    assert got[None]["turns_sha256"] == sha("\n\n") and got[None]["n_turns"] == 1
    assert got[3]["turns_sha256"] == sha("sys\ntem\n" + "l\n\n" * 20_000 + "\n")


def test_decontamination(spark, odd_dir):
    got = by_text(spark, odd_dir, "op6_benchmark_decontamination")
    assert (got[2]["n_words"], got[2]["contaminated"]) == (0, False)
    ids = lambda *i: hashlib.sha256(",".join(sorted(i)).encode()).hexdigest()
    assert got[12]["items_sha256"] == ids("1", "3") and got[12]["n_items"] == 2
    assert got[4]["items_sha256"] == ids("null")


def test_fingerprints(spark, odd_dir):
    got = queries.op7_document_fingerprints(spark, odd_dir).collect()
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {"4::"}
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 680}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_simhash(spark, odd_dir):
    got = queries.op8_simhash(spark, odd_dir).collect()
    blank = [r for r in got if r["doc_id"] in (2, 3, 6)]
    assert {(r["fingerprint"], r["component_id"]) for r in blank} == {("0" * 16, 2)}
    assert all(r["component_id"] in (1, 2) for r in got if r["doc_id"] is None)


def test_warc(spark, odd_dir):
    got = queries.op9_warc(spark, odd_dir).collect()
    kind = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert kind == sorted([
        (1, "response", None), (1, "response", None), (3, "revisit", 1), (None, "revisit", 1),
        (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None),
        (8, "response", None), (9, "revisit", 8), (10, "response", None)], key=repr)


def test_pieces(spark, odd_dir):
    got = by_text(spark, odd_dir, "op10_sentencepiece")
    assert got[2]["ids"] == [] and got[3]["ids"] == [] and got[4]["exact"] and got[8]["exact"]


def test_quality(spark, odd_dir):
    got = queries.op11_quality(spark, odd_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 6)}) == 1


def test_prefix_trie(spark, odd_dir):
    assert rows(queries.op12_prefix_trie(spark, odd_dir)) == sql(
        oracles.ORACLE_SQL["op12_prefix_trie"].replace(
            "FROM conversations", f"FROM read_parquet('{odd_dir}/conversations.parquet/*.parquet')"))


def test_whitening(spark, odd_dir):
    got = queries.op13_whitening(spark, odd_dir).collect()
    # Three distinct vectors have two directions; five rows hold one of them.
    assert sorted(((r["vec_id"], r["component"]) for r in got), key=repr) == sorted(
        [(i, c) for i in (1, 2, 2, None, 10) for c in (1, 2)], key=repr)
    assert {r["n"] for r in got} == {3} and got[0]["identity_error"] < 1e-9
    assert {r["deviation"] for r in got if r["vec_id"] == 10} == {
        (3 * 0 - 48) ** 2 + (3 * 0 - 0) ** 2 + (3 * 64 - 128) ** 2}


@pytest.mark.parametrize("folder", ["odd_dir", "empty_dir"])
def test_stages_keep_the_columns(spark, folder, request):
    folder = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        if name == "suffix_array_repeats":
            assert out.count() == len(before)
        else:
            assert set(rows(out)) <= set(before), name


def test_one_of_each_group_stays(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_duplicates"](spark, docs, odd_dir)
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr)
    # 5, the null id and a row of 1 are copies of 1; 3, 6 and the null text are copies of 2. Only
    # the second text of id 1 stands for itself.
    assert [i for i in ids if i in (None, 1, 2, 3, 5, 6)] == [1, 1, 2]


def test_pipeline_against_its_parts(spark):
    """Each stage's decisions against a plain version, on the stage's own input."""
    from itertools import combinations

    import numpy as np

    from fanweave.llm import decontaminate, repeats, toxicity
    from tests.llm.conftest import SF
    from tests.llm.test_brute_force import plain_repeats, plain_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    scores = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, SF).collect()}
    after = texts(stages["toxicity"](spark, docs, SF))
    assert set(after) == {d for d, s in scores.items() if s < toxicity.THRESHOLD}

    own = texts(docs)
    prints = {d: plain_simhash(t) for d, t in own.items()}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(own), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert set(texts(stages["simhash_near_duplicates"](spark, docs, SF))) == {
        d for d in own if find(d) == d}

    raw = {d: (t or "").encode() for d, t in own.items()}
    want = {}
    for (d, t), gone in zip(raw.items(), plain_repeats(list(raw.values()), repeats.PASSAGE)):
        out, at = [], 0
        for c in t.decode():
            size = len(c.encode())
            if not gone[at:at + size].all():
                out.append(c)
            at += size
        want[d] = "".join(out)
    cut = stages["suffix_array_repeats"](spark, docs, SF)
    assert texts(cut) == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    patterns = set().union(*(decontaminate.windows(decontaminate.item_words(t)) for t in items))
    leaked = {d for d, t in own.items() if any(
        b" " + p + b" " in b" " + b" ".join(decontaminate.item_words(t)) + b" " for p in patterns)}
    assert leaked
    assert set(texts(stages["benchmark_decontamination"](spark, docs, SF))) == set(own) - leaked
    assert np.all([r["exact"] for r in stages["sentencepiece"](spark, docs, SF).collect()])
