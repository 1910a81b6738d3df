"""Quality classifier, conversation prefix trie and whitening against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fanweave.llm import prefix_trie, quality, queries, whitening
from tests.llm.conftest import SF, rows, sql


# --- quality

def plain_features(text):
    for word in text.split(" "):
        if word:
            yield b"\1" + word.encode() + b"\2"


def test_features_are_the_word_and_its_runs():
    words = pa.array(["ab", "é", "abcdef"])
    bucket, at = quality.features(words)
    assert np.diff(at).tolist() == [1 + 3 + 2 + 1, 1 + 3 + 2 + 1, 1 + 7 + 6 + 5]
    again, other = quality.features(pa.array(["abcdef", "ab"]))
    assert again[:other[1]].tolist() == bucket[at[2]:].tolist()
    assert again[other[1]:].tolist() == bucket[:at[1]].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab é\n", max_size=12), min_size=1, max_size=5))
def test_scores_are_those_of_the_average(texts):
    rng = np.random.default_rng(0)
    model = quality.Model(rng.standard_normal(quality.BUCKETS + 1).astype(np.float32), 0.25)
    got = quality.score_texts(model, pa.array(texts))
    for t, s in zip(texts, got):
        words = t.split()
        values = []
        for i, w in enumerate(words):
            values += model.table[quality.features(pa.array([w]))[0]].tolist()
            if i and words[i - 1] == w:
                values.append(model.table[quality.BUCKETS])
        odds = 0.25 + (np.mean(np.array(values, np.float64)) if values else 0)
        assert s == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-6)


def test_gradient_descent_parts_two_kinds():
    rng = np.random.default_rng(1)
    found = [(np.unique(np.append(rng.integers(10, 200, 8), y)), None) for y in (0, 1) * 40]
    found = [(b, np.ones(len(b), np.float32)) for b, _ in found]
    label = np.array([0, 1] * 40)
    model = quality.descend(found, label, epochs=30)
    odds = [model.table[b].mean() + model.intercept for b, _ in found]
    assert ((np.array(odds) > 0) == label).mean() > 0.95


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op11_quality(spark, sf).collect()}
    held = [(got[d], q) for d, q in sql("SELECT doc_id, quality FROM labels", sf)
            if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held)
    assert np.mean([r["predicted"] for r, q in held if q == 1]) > 0.98
    assert np.mean([r["predicted"] for r, q in held if q == 0]) < 0.05


def test_quality_does_not_follow_the_order_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.score_documents(docs, labels)
    b = quality.score_documents(docs.orderBy("text").repartition(7), labels.orderBy("quality"))
    assert rows(a) == rows(b)


# --- prefix trie

def plain_trie(table):
    """{prefix: report} of (conv_id, turn, role, text) rows, by walking every conversation."""
    own = defaultdict(list)
    for c, t, role, text in table:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    member = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            member[turns[:d]].append(c)
    value = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in member.items()}
    parents = {p[:-1] for p in member if p}
    out = []
    for p, m in member.items():
        below = [q for q in member if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == p)))
        out.append((min(m), len(p), hashlib.sha256(ends.encode()).hexdigest(),
                    sum(len(q) == len(p) + 1 for q in below), len(m),
                    sum(q not in parents for q in below),
                    min(member[p[:-1]]) if p else None, sum(value[q] for q in below)))
    return sorted(out, key=repr)


def random_conversations(seed, n):
    rng = np.random.default_rng(seed)
    table = []
    for c in rng.choice(np.arange(-150, 450), n, replace=False).tolist():
        for t in range(int(rng.integers(1, 10))):
            table.append((c, None if rng.random() < 0.05 else int(rng.integers(0, 6)),
                          ["user", "assistant", None][rng.integers(0, 3)],
                          ["hi", "", None, "é😀", "long text"][rng.integers(0, 5)]))
    return table


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_conversations(spark, seed):
    table = random_conversations(seed, 120)
    table += table[:7] + [(None, 1, "user", "lost")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert rows(prefix_trie.node_report(df)) == plain_trie(table)


def test_trie_of_many_copies(spark):
    """A third of the conversations are one sequence; its end list spans several blocks."""
    table = [(c, t, "user", f"turn {t}") for c in range(0, 9000) for t in (0, 1)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    report = rows(prefix_trie.node_report(df))
    assert [r for r in report if r[1] == 0][0][4] == 9000
    turns = prefix_trie.ordered_turns(df)
    trie = prefix_trie.build(turns.where("pos = 0").select("conv_id"), turns)
    ends = trie.ends.collect()
    assert len(ends) == 3 and max(len(r["ids"]) for r in ends) == 4096
    assert prefix_trie.list_digests(trie.ends).first()["ends_sha256"] == hashlib.sha256(
        ",".join(map(str, range(9000))).encode()).hexdigest()


# --- whitening

@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10_000), st.floats(-8, 0))
def test_components_are_eigenvectors(n, seed, tail):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((3 * n, n)) * np.logspace(0, tail, n)
    a = x.T @ x
    value, v = whitening.components(a)
    want = np.linalg.eigvalsh(a)[::-1][:len(value)]
    assert np.abs(value - want).max() <= 1e-12 * want[0]
    assert np.abs(v.T @ v - np.eye(len(value))).max() < 1e-12
    assert np.abs(a @ v - v * value).max() <= 1e-12 * want[0]


def test_equal_eigenvalues_and_missing_directions():
    for diag, left in (([3.0, 3, 1, 1, 1, 0], 5), ([2.0, 2, 2], 3), ([0.0, 0], 0), ([4.0, 0], 1)):
        rng = np.random.default_rng(3)
        q, _ = np.linalg.qr(rng.standard_normal((len(diag), len(diag))))
        value, v = whitening.components(q @ np.diag(diag) @ q.T)
        assert len(value) == left
        assert np.allclose(value, sorted(diag, reverse=True)[:left], atol=1e-13)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((12, 12))
    u = whitening.polar_factor(a)
    w, _, vt = np.linalg.svd(a)
    assert np.allclose(u, w @ vt, atol=1e-13)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whitening_equals_eigh(spark, sf):
    data = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000
            for v, i in sql("SELECT vec_id, embedding FROM embeddings", sf)
            if v is not None and None not in v and np.isfinite(v).all()}
    fit = np.unique(np.array(list(data.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    z = fit - total / n
    value, vector = np.linalg.eigh(z.T @ z / n)
    value, vector = value[::-1][:16], vector[:, ::-1][:, :16]
    share = value / np.trace(z.T @ z / n)
    got = defaultdict(dict)
    for r in queries.op13_whitening(spark, sf).collect():
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(data)
    sign = None
    for i, own in got.items():
        assert sorted(own) == list(range(1, 17))
        assert {r["n"] for r in own.values()} == {n}
        assert {r["deviation"] for r in own.values()} == {int(((n * data[i] - total) ** 2).sum())}
        w = np.array([own[k]["whitened"] for k in range(1, 17)])
        want = (data[i] - total / n) @ vector / np.sqrt(value)
        sign = np.sign(w * want) if sign is None else sign
        assert np.allclose(w, want * sign, atol=1e-6)
        assert np.allclose([own[k]["explained"] for k in range(1, 17)], share, rtol=1e-9)
        assert own[1]["identity_error"] < 1e-9
