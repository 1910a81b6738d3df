"""Every operator against a plain version of its contract, on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fanweave.llm import (chat, ctph, decontaminate, id_table, langid, oracles, piece_transducer,
                          queries, repeats, simhash, suffix_sort, token_archive, toxicity,
                          transducers, warc)
from tests.llm.conftest import SF, document_texts, rows, sql


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF)) == sql(oracles.ORACLE_SQL[name])


# --- op1

def plain_kernel(a, b):
    return sum(toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2)
               for i in combinations(range(len(a)), 3) for j in combinations(range(len(b)), 3)
               if all(a[x] == b[y] for x, y in zip(i, j)))


def test_subsequence_kernel_is_the_defined_sum():
    words = ["idiot", "aaaaaa", "abcabc", "banana", "ab"]
    code, first = toxicity.windows(words)
    marked = ["^" + w for w in words]
    got = toxicity._kernel(code[first], code[first])
    for i, a in enumerate(marked):
        for j, b in enumerate(marked):
            norm = (plain_kernel(a, a) * plain_kernel(b, b)) ** 0.5
            assert got[i, j] == pytest.approx(plain_kernel(a, b) / norm if norm else 0, abs=1e-5)


def test_weight_table_equals_sum_over_landmarks():
    positive, _ = toxicity.windows(["idiot", "stupid", "moron"])
    negative, _ = toxicity.windows(["house", "garden", "window", "forest"])
    model = toxicity.fit(positive, negative, toxicity._gapped(positive))
    assert (toxicity.decide(model, positive) > 0).all()
    assert (toxicity.decide(model, negative) < 0).all()
    gapped, _ = toxicity.windows(["id.iot", "sttupid"])
    other, _ = toxicity.windows(["bridge", "planet"])
    assert toxicity.decide(model, gapped).max() > toxicity.decide(model, other).max()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    labels = sql("SELECT doc_id, toxic FROM labels", sf)
    held = [(got[d], t) for d, t in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
               for r in got.values())
    caught = [r["predicted"] for r, t in held if t == 1]
    wrong = [r["predicted"] for r, t in held if t == 0]
    assert np.mean(caught) > 0.8 and np.mean(wrong) < 0.04


def test_toxicity_does_not_follow_the_order_of_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    a = toxicity.score_documents(docs, labels)
    b = toxicity.score_documents(docs.orderBy("text").repartition(7), labels.orderBy("toxic"))
    assert rows(a) == rows(b)


# --- op2

def test_token_archive_equals_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc, text in document_texts():
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc, zlib.crc32(ids.tobytes()), len(ids), start))
        start += len(ids)
    assert rows(queries.op2_token_archive(spark, SF)) == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(
    list("aZ9 '\n\t.,_é²İß<|>日😀") + ["'s", "'ll", "\x1c", "\u0301", "\xa0", "<|endoftext|>"]),
    max_size=40))
def test_word_encoder_equals_library(parts):
    text, own = "".join(parts), token_archive.encoder()
    assert own.encode(["x", text, "y 1"])[1].tolist() == own._whole(text).tolist()


def test_words_of_one_hash_have_their_own_ids():
    a, b = ("aaaaaaaa" + t for t in twins("h"))
    texts = [f"x {a} {b} y", b, f"{a} {a}"]
    own = token_archive.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):                     # as new words, then as known ones
        assert [x.tolist() for x in own.encode(texts)] == [own._whole(t).tolist() for t in texts]


def test_table_compares_bytes_when_all_hashes_agree(monkeypatch):
    monkeypatch.setattr(id_table, "_MIX", np.uint64(0))
    rng = np.random.default_rng(0)
    strings = ["".join(map(chr, rng.integers(97, 99, n))).encode()
               for n in rng.integers(1, 400, 300)]
    table = id_table.IdTable(lambda some: [np.frombuffer(t, np.uint8).astype(np.int32)
                                           for t in some], bits=12)
    for _ in range(2):
        raw = np.frombuffer(b"".join([*strings, b"\0" * 8]), np.uint8)
        stop = np.cumsum([len(t) for t in strings])
        ids, offsets = table.lookup(raw, stop - [len(t) for t in strings], stop)
        assert ids.tolist() == list(b"".join(strings)) and offsets[1:].tolist() == stop.tolist()


def test_short_document_access(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "archive")
    token_archive.write_archive(docs, path)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = docs.where("doc_id = 17").first()["text"]
    assert token_archive.read_document(spark, path, 17) == [
        lib.encode(text, add_special_tokens=False).ids + [2]]
    assert token_archive.read_document(spark, path, -5) == []
    with pytest.raises(ValueError, match="another dictionary"):
        token_archive._parse(bytes(spark.read.parquet(f"{path}/blocks").first()["data"]), b"0" * 32)


# --- op3

def test_code_lengths_are_those_of_the_tree():
    texts = ["abracadabra abra", "banana bandana", "zzz abra"]
    grams, langs = [], []
    for own, t in enumerate(texts[:2]):
        raw = b"\0" * langid.ORDER + t.encode()
        grams += [int.from_bytes(raw[i:i + langid.ORDER + 1], "big")
                  for i in range(len(raw) - langid.ORDER)]
        langs += [own] * len(t)
    model = langid.build(["x", "y"], np.array(langs), np.array(grams), np.ones(len(grams)))

    counts = Counter()
    for own, gram in zip(langs, grams):
        raw = gram.to_bytes(langid.ORDER + 1, "big")
        for k in range(langid.ORDER + 1):
            counts[own, raw[langid.ORDER - k:langid.ORDER], raw[-1]] += 1
    both = Counter()
    for (_, c, _), n in counts.items():
        both[c] += n

    def bits(own, context, byte):
        if both[context] >= 2 or not context:
            seen = {b: n for (o, c, b), n in counts.items() if (o, c) == (own, context)}
            total, kinds = sum(seen.values()), len(seen)
            if byte in seen:
                return -np.log2(seen[byte] / (total + kinds))
            escape = -np.log2(kinds / (total + kinds)) if total else 0.0
        else:
            escape = 0.0
        return escape + (bits(own, context[1:], byte) if context else 8.0)

    for t in texts:
        raw = b"\0" * langid.ORDER + t.encode()
        want = [sum(bits(own, raw[i:i + langid.ORDER], raw[i + langid.ORDER])
                    for i in range(len(t))) for own in (0, 1)]
        data = np.frombuffer(t.encode(), np.uint8)
        got = langid.code_lengths(model, data, np.array([0, len(data)]))[0]
        assert got == pytest.approx(want, rel=1e-5)


def test_lanes_do_not_change_code_lengths(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 103, 5000).astype(np.uint8)
    gram = sum(data[k:len(data) - 3 + k].astype(np.int64) << 8 * (3 - k) for k in range(4))
    model = langid.build(["x"], np.zeros(len(gram), np.int64), gram, np.ones(len(gram)))
    off = np.array([0, 10, 10, 4000, 5000])
    want = langid.code_lengths(model, data, off)
    monkeypatch.setattr(langid, "STRETCH", 17)
    monkeypatch.setattr(langid, "LANES", 50)
    assert langid.code_lengths(model, data, off) == pytest.approx(want, rel=1e-6)


def test_stretches_do_not_change_counts(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(65, 123, n))) for n in (0, 1, 3, 50, 1000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a", "b", "a"], "text": texts})

    def counts():
        out = Counter()
        for b in langid._grams(iter([batch])):
            for lang, gram, n in zip(*(c.to_pylist() for c in b.columns)):
                out[lang, gram] += n
        return out

    want = counts()
    assert sum(want.values()) == sum(map(len, texts))
    monkeypatch.setattr(langid, "PART_BYTES", 7)
    assert counts() == want


def test_prediction_keeps_other_columns(spark):
    model = langid.build(["x"], np.zeros(1, np.int64), np.array([97]), np.ones(1))
    df = spark.createDataFrame([(1, "aa", "mine")], "doc_id long, text string, _letters string")
    row = langid.predict(df, model).first()
    assert (row["_letters"], row["lang_pred"]) == ("mine", "x")


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, sf).collect()}
    held = [(got[d]["lang_pred"], lang) for d, lang in sql(
        "SELECT doc_id, lang FROM documents", sf) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97


# --- op4

@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(symbols):
    s = np.array([*symbols, 0])
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert suffix_sort.suffix_array(s).tolist() == want


def plain_repeats(texts, length=400):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        yield np.cumsum(gone[:-1]) > 0


@pytest.mark.parametrize("bucket", [4096, 12])
def test_removed_repeats(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    docs = document_texts()
    texts = [(t or "").encode() for _, t in docs]
    want = []
    for (doc, _), t, gone in zip(docs, texts, plain_repeats(texts)):
        spans = int(np.diff(np.concatenate([[False], gone]).astype(int)).clip(0).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((doc, hashlib.sha256(kept).hexdigest(), len(t), int(gone.sum()), spans))
    got = queries.op4_suffix_dedup(spark, SF)
    assert rows(got.drop("n_shared")) == sorted(want, key=repr)


def vanishing():
    """Coefficients, up to 17, of a polynomial that is 0 modulo 2^64 at every odd number: a product
    of factors 1 - x^(2^i)."""
    p = np.ones(1, np.int64)
    for i, times in enumerate((1, 1, 1, 3, 3, 1, 2)):
        for _ in range(times):
            p = np.append(p, np.zeros(1 << i, np.int64)) - np.append(np.zeros(1 << i, np.int64), p)
    return p


def twins(middle):
    """Two strings that differ by ``vanishing`` and hold printable characters around ``middle``."""
    p = vanishing()
    up = (p + 1) // 2
    return ("".join(map(chr, ord(middle) + up)), "".join(map(chr, ord(middle) + up - p)))


def test_different_bytes_of_one_hash_are_no_repeat(spark):
    rng = np.random.default_rng(5)
    fill = "".join(map(chr, rng.integers(97, 123, 400)))
    for at in (63, 0, 100):
        a, b = (fill[:at] + t + fill[at + len(t):] for t in twins("h"))
        assert a != b and len(a) == len(b) == 400
        df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
        assert [r["n_removed"] for r in repeats.removal_report(df).collect()] == [0, 0]


def test_shorter_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [(t or "").encode() for _, t in document_texts()]
    for length in (200, 263):
        got = sorted(tuple(r) for r in repeats.removal_report(docs, length)
                     .select("doc_id", "n_removed", "kept_sha256").collect())
        want = []
        for (d, _), t, gone in zip(document_texts(), texts, plain_repeats(texts, length)):
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            want.append((d, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        assert got == want
    with pytest.raises(ValueError, match="fewer than 200"):
        repeats.removal_report(docs, 199)


def test_shared_bytes_show_short_passages(spark):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(230)
    texts = [word(700), word(300) + passage + word(150), passage + word(900), word(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.removal_report(df).collect()}
    assert [got[i]["n_removed"] for i in range(4)] == [0] * 4
    assert got[0]["n_shared"] == got[3]["n_shared"] == 0
    assert 137 <= got[1]["n_shared"] <= 230 and got[2]["n_shared"] == got[1]["n_shared"]


def test_many_equal_rows(spark):
    """Ten thousand rows of one id and text, beside copies under other ids."""
    rng = np.random.default_rng(7)
    text = "".join(map(chr, rng.integers(97, 123, 1000)))
    own = "".join(map(chr, rng.integers(97, 123, 800)))
    table = [(1, text)] * 10_000 + [(i, text) for i in range(2, 40)] + [(None, text)] * 3
    table += [(50, own + text[:399]), (51, text[100:520] + own[:390]), (1, own[::-1])]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(8)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"])
                  for r in repeats.removal_report(df).collect())
    assert got == Counter({(1, 1000, 1000): 10_000, (None, 1000, 1000): 3, (50, 1199, 0): 1,
                           (51, 810, 420): 1, (1, 800, 0): 1,
                           **{(i, 1000, 1000): 1 for i in range(2, 40)}})
    assert max(len(r["places"]) for r in repeats.repeat_places(df).collect()) < 100


def test_segments_find_the_same_anchors(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 100, 9000)))
    batch = pa.RecordBatch.from_pydict({"rid": [0, 1], "doc_id": [5, None], "th": [b"1", b"2"],
                                        "text": [text, text[:2000]]})
    run = repeats._anchor_rows(repeats.LENGTH, repeats.draw_bases())

    def found():
        return [sorted(zip(*(c.to_pylist() for c in b.columns)), key=repr)
                for b in [pa.Table.from_batches(run(iter([batch])))]][0]

    want = found()
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    monkeypatch.setattr(repeats, "PART", 1500)
    assert found() == want


# --- op5

def test_typed_parts_are_visited_in_order(spark):
    parts = ("array<struct<type:string,text:string,ref:string,width:int,height:int,"
             "seconds:double,pages:int>>")
    turns = spark.createDataFrame([
        (1, 0, "user", [("text", "see </s>", None, None, None, None, None),
                        ("image", None, "a.png", 56, 29, None, None),
                        ("text", " and ", None, None, None, None, None),
                        ("audio", None, "b.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3),
                             ("text", "ok", None, None, None, None, None)]),
        (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {parts}")
    got = chat.format_turns(turns).first()
    assert got["formatted"] == ("<s>user\nsee <\\e/s><|image|> and <|audio|></s>"
                                "<s>assistant\n<|document|>ok</s><s>user\n</s>")
    assert [(a["type"], a["ref"], a["tokens"]) for a in got["attachments"]] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1536)]
    assert got["expanded_tokens"] == 1578
    span = got["loss_mask"][0]
    assert got["formatted"][span["start"]:span["start"] + span["length"]] == "<|document|>ok"


# --- op6

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), min_size=1, max_size=4),
       st.lists(st.text("ab ", max_size=16), min_size=1, max_size=4))
def test_search_finds_every_occurrence(texts, items):
    search = decontaminate.Searcher(list(enumerate(items)), width=3)
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    first, hit, pairs = search.scan(np.frombuffer(b"".join(raw), np.uint8), off)
    want_pairs = set()
    for d, t in enumerate(raw):
        words = t.split()
        marks = [False] * len(words)
        for i, item in enumerate(items):
            for p in decontaminate.windows(item.encode().split(), 3):
                p = p.split(b" ")
                for s in range(len(words) - len(p) + 1):
                    if words[s:s + len(p)] == p:
                        marks[s:s + len(p)] = [True] * len(p)
                        want_pairs.add((d, str(i)))
        assert hit[first[d]:first[d + 1]].tolist() == marks
    assert pairs == want_pairs


def test_item_blocks_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.find_overlaps(docs.select("doc_id", "text"), items)
    many = decontaminate.find_overlaps(docs.select("doc_id", "text"), items, block_bytes=3000)
    assert rows(one) == rows(many)


# --- op7

def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1],
                                                                     table[i + 1][j])
    return table[-1][-1]


def test_likeness_is_the_edit_distance():
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(60):
        a = "".join(rng.choice(list("ABCD"), rng.integers(4, 65)))
        b = "".join(c for c in a if rng.random() > 0.3) + "A" * int(rng.integers(0, 9))
        pairs.append((a, b[:64]))
    for (a, b), got in zip(pairs, ctph._edit_likeness(pairs)):
        want = 2 * plain_lcs(a, b) / (len(a) + len(b)) if ctph._common_run(a, b) and a and b else 0
        assert got == pytest.approx(want)


def test_fingerprints_of_documents(spark):
    docs = document_texts()
    want = []
    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        q = len(text) // 4
        edited = text[:len(text) - q] + following[:q]
        own, ed, nxt = (ctph.fingerprint(t.encode()) for t in (text, edited, following))
        near = ctph.compare([(own, ed), (own, nxt)])
        want.append((doc, ed, hashlib.sha256(edited.encode()).hexdigest(), own, len(text),
                     float(near[0]), float(near[1])))
    got = queries.op7_document_fingerprints(spark, SF).select(
        "doc_id", "edited_fingerprint", "edited_sha256", "fingerprint", "n_chars", "near_edited",
        "near_next")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert np.median([w[5] for w in want]) > 0.7


def test_a_change_alters_few_pieces():
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    other = raw[:9_000] + b"inserted" + raw[9_000:]
    unrelated = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    a, b, c = map(ctph.fingerprint, (raw, other, unrelated))
    assert ctph.compare([(a, b)])[0] > 0.9 and ctph.compare([(a, c)])[0] == 0


# --- op8

def plain_simhash(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", folded)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    docs = document_texts()
    prints = {d: plain_simhash(t) for d, t in docs}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = [(find(d), d, f"{prints[d]:016x}") for d in prints]
    assert rows(queries.op8_simhash(spark, SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("group_rows", [2048, 9])
def test_links_of_crowded_fingerprints(spark, group_rows):
    rng = np.random.default_rng(4)
    some = set()
    for center in rng.integers(0, 1 << 62, 4):
        for _ in range(40):
            x = int(center)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            some.add(x)
    some = sorted(simhash._signed(x) for x in some)
    root = {x: x for x in some}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(some, 2):
        if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2 and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    fps = spark.createDataFrame([(x,) for x in some], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(
        simhash.link(fps, group_rows=group_rows)).collect()}
    assert {x: got.get(x, x) for x in some} == {x: find(x) for x in some}


# --- op9

def test_archive_is_a_warc_file(spark, tmp_path):
    path = str(tmp_path / "warc")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archive(pages, path, chunk_bytes=1000)
    stored = spark.read.parquet(path).orderBy("record_id", "chunk_no").collect()
    assert max(r["n_chunks"] for r in stored) > 5
    raw, records = b"".join(bytes(r["data"]) for r in stored), []
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        fields = warc._fields(head)
        size = int(fields["Content-Length"])
        block, raw = raw[:size], raw[size:]
        assert raw.startswith(b"\r\n\r\n")
        raw = raw[4:]
        if fields["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            assert hashlib.sha256(payload).hexdigest() == fields["WARC-Payload-Digest"][7:]
        records.append(fields["WARC-Type"])
    assert len(records) == pages.count()
    assert rows(warc.read_archive(spark, path)) == sql(oracles.OP9)


def test_many_repeats_are_joined_without_a_broadcast(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archive(spark.read.parquet(f"{SF}/pages.parquet"), path, broadcast_repeats=0)
    assert rows(warc.read_archive(spark, path)) == sql(oracles.OP9)


def test_a_changed_chunk_is_refused(spark, tmp_path):
    from pyspark.sql import functions as F
    path = str(tmp_path / "warc")
    warc.write_archive(spark.read.parquet(f"{SF}/pages.parquet"), path, chunk_bytes=1000)
    bad = spark.read.parquet(path).withColumn("data", F.when(
        (F.col("chunk_no") == 1), F.concat(F.lit(b"!"), F.expr("substring(data, 2, 9999)")))
        .otherwise(F.col("data")))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, str(tmp_path / "bad")).collect()


# --- op10

def test_pieces_equal_library(spark):
    lib = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in queries.op10_sentencepiece(spark, SF).collect()}
    for doc, text in document_texts():
        ids = lib.encode(text or "")
        assert got[doc]["ids"] == ids and got[doc]["n_tokens"] == len(ids)
        assert got[doc]["decoded_sha256"] == hashlib.sha256(
            lib.decode(ids).encode()).hexdigest()
        assert got[doc]["exact"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeht  .,\n-'éü▁日\x00😀")), max_size=60))
def test_transducer_equals_library(text):
    lib = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = piece_transducer.transducer()
    ids = own.encode(["é", text, "x  y"])[1]
    assert ids.tolist() == lib.encode(text)
    assert own.decode(ids) == lib.decode(ids.tolist())


def _paths(machine, symbols):
    """(weight, output) of every path of a machine without cycles that read nothing."""
    found, todo = [], [(0, 0, 0.0, ())]
    while todo:
        state, at, weight, output = todo.pop()
        if at == len(symbols) and state in machine.finals:
            found.append((weight, output))
        steps = [(at, "")] + ([(at + 1, symbols[at])] if at < len(symbols) else [])
        for then, symbol in steps:
            for o, w, target in machine.arcs(state, symbol):
                todo.append((target, then, weight + w, output + ((o,) if o else ())))
    return sorted(found)


def _hand_machines():
    """a: x becomes p or (dearer) q, y disappears, other symbols stay. b: p and pp have a name, q is
    spelt in two symbols, and what it does not know becomes a question mark."""
    a, b = transducers.Machine(), transducers.Machine()
    s = a.state(final=True)
    for arc in (("x", "p", 1.0), ("x", "q", 2.0), ("y", "", 0.5)):
        a.add(s, *arc, s)
    a.rest[s] = lambda symbol: [(symbol, 0.0, s)]
    root, one, two, spelt = b.state(final=True), b.state(), b.state(), b.state()
    b.add(root, "p", "", 0.0, one)
    b.add(one, "", "P", 3.0, root)
    b.add(one, "p", "", 0.0, two)
    b.add(two, "", "PP", 4.0, root)
    b.add(root, "q", "Q1", 0.25, spelt)
    b.add(spelt, "", "Q2", 0.0, root)
    b.rest[root] = lambda symbol: [("?", 9.0, root)]
    return a, b


@given(st.text("xyzp", max_size=6))
def test_composition_is_one_machine_after_the_other(text):
    a, b = _hand_machines()
    both = sorted({(w + v, out) for w, middle in _paths(a, text) for v, out in _paths(b, middle)})
    assert sorted(set(_paths(transducers.compose(a, b), text))) == both
    weight, output = transducers.shortest(transducers.compose(a, b), list(text))
    assert weight == both[0][0] and (weight, tuple(output)) in both


def test_no_path_is_none():
    a, b = _hand_machines()
    del b.rest[0]
    assert transducers.shortest(transducers.compose(a, b), ["z"]) is None


@settings(max_examples=30, deadline=None)
@given(st.text(st.sampled_from("ab \u4e01\U0001F9FF"), min_size=1, max_size=5))
def test_lattice_holds_the_ways_of_the_composed_machine(text):
    own = piece_transducer.transducer()
    stretch = [piece_transducer.BEGIN, *text]
    lattice = own.compose_input(stretch)
    ways = {0: {()}}
    for end in range(1, len(lattice)):
        ways[end] = {way + tuple(ids) for begin, _, ids in lattice[end] for way in ways[begin]}
    assert ways[len(stretch)] == {out for _, out in _paths(own.machine, stretch)}


# --- id table

@pytest.mark.parametrize("bits", [3, 12])
def test_id_table_finds_every_string_also_when_it_starts_anew(bits):
    from fanweave.llm.id_table import IdTable
    rng = np.random.default_rng(5)
    asked = []

    def solve(some):
        asked.extend(some)
        return [np.frombuffer(x, np.uint8).astype(np.int32) for x in some]

    table = IdTable(solve, bits=bits)
    for _ in range(20):
        words = [bytes(rng.integers(97, 100, rng.integers(1, 12)).astype(np.uint8))
                 for _ in range(rng.integers(0, 40))]
        raw = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        stop = np.cumsum([len(w) for w in words]).astype(np.int64)
        start = stop - np.array([len(w) for w in words], np.int64)
        ids, offsets = table.lookup(raw, start, stop)
        assert ids.tolist() == list(b"".join(words))
        assert offsets.tolist() == [0, *stop.tolist()]
    if bits == 12:
        assert len(asked) == len(set(asked))
