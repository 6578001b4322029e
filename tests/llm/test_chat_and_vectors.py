"""Chat formatting, vectors, components, the pipeline and the registered queries."""

import hashlib
import json
import os
import random

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import chat, components, queries, vectors  # noqa: E402

SMALL = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_layouts_become_turns(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]})),
        (3, json.dumps({"instruction": "do", "input": "this", "output": "done"})),
        (4, json.dumps({"instruction": "do", "output": "done"})),
        (5, json.dumps({"system": "s", "prompt": "p", "response": "r"})),
        (6, json.dumps({"unknown": 1})),
        (7, "{broken"),
        (8, None),
        (9, json.dumps({"question": "w", "answer": "x"})),
    ]
    got = chat.turns_of_json(spark.createDataFrame(records, "id long, j string"), "id", "j").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [
        (1, "user", "a"), (1, "assistant", ""), (2, "user", "q"), (2, "assistant", "r"), (3, "user", "do\n\nthis"), (3, "assistant", "done"),
        (4, "user", "do"), (4, "assistant", "done"), (5, "system", "s"), (5, "user", "p"), (5, "assistant", "r"), (9, "user", "w"), (9, "assistant", "x"),
    ]
    typed = spark.createDataFrame([(1, "p", "r", "extra")], "id long, prompt string, response string, turn string")
    assert [tuple(r) for r in chat.turns_of_table(typed, "id").orderBy("turn").collect()] == [(1, 0, "user", "p"), (1, 1, "assistant", "r")]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.range(1), "id")


def test_records_with_null_or_further_fields_keep_their_turns(spark):
    said = [{"role": "user", "content": "a"}]
    records = [
        {"prompt": "p", "response": None},
        {"messages": said, "system": "s"},
        {"prompt": "p", "input": "i", "response": "r"},
        {"prompt": "p", "response": "r", "answer": "x"},
        {"messages": [{"role": "user", "content": None}]},
        {"messages": None, "prompt": "p", "response": "r"},
        {"messages": [], "system": "s"},
        {"turn": 7, "role": "Human", "text": None},
        {"messages": [None, *said], "question": 1},
        [{"prompt": "p", "response": "r"}],
        {"prompt": "p"},
    ]
    frame = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id long, j string")
    got = [tuple(r) for r in chat.turns_of_json(frame, "id", "j").orderBy("conv_id", "turn").collect()]
    assert got == [
        (0, 0, "user", "p"), (0, 1, "assistant", ""), (1, 0, "system", "s"), (1, 1, "user", "a"), (2, 0, "user", "p\n\ni"), (2, 1, "assistant", "r"),
        (3, 0, "user", "p"), (3, 1, "assistant", "r"), (4, 0, "user", ""), (5, 0, "user", "p"), (5, 1, "assistant", "r"), (7, 7, "Human", ""),
        (8, 0, "", ""), (8, 1, "user", "a"),
    ]


@has_data
def test_query_takes_its_layout_by_fingerprint(spark, monkeypatch):
    key = chat.fingerprint(["role", "text", "turn"])
    rows = spark.createDataFrame([(3, None, None, "x"), (3, 1, "Human", None)], "conv_id long, turn int, role string, text string")
    assert sorted(map(tuple, chat.turns_of_table(rows, "conv_id").collect()), key=str) == [(3, 1, "Human", ""), (3, None, "", "x")]
    monkeypatch.setattr(chat, "BY_FINGERPRINT", {k: v for k, v in chat.BY_FINGERPRINT.items() if k != key})
    monkeypatch.setattr(chat, "WIDEST_FIRST", [])
    with pytest.raises(ValueError):
        queries.op3_chat(spark, SMALL)


def test_formatting_reads_back(spark):
    rng = random.Random(1)
    marks = ["<|end|>\n", "<|user|>\n", "&lt;", "&amp;lt;", "[INST]", "</s>", "|", "é", "🙂", " ", "\n", "a"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a|b<"]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 12))), "x", 1) for c in range(12) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, None, None, "x", 1), (50, 0, "assistant", None, "x", 1), (51, None, "user", "u", "x", 1), (51, 1, "assistant", "same", "x", 1), (51, 1, "assistant", "same", "x", 1), (None, 3, "assistant", "z", "x", 1), (52, 0, "assistant", "long " * 20_000, "x", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head string, k int")
    got = chat.format_turns(frame).select("*", chat.read_turns().alias("turns"), chat.under_mask().alias("loss")).collect()
    by_conv = {}
    for c, t, role, text, *_ in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(by_conv)
    for r in got:
        turns = [(role, text) for _, role, text in sorted(by_conv[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
    assert chat.format_turns(frame.where("false")).count() == 0


def brute_links(rows, threshold):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = list(ok)
    near = {i: [j for j in ids if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt(ok[i] @ ok[i]) / np.sqrt(ok[j] @ ok[j]) >= threshold] for i in ids}
    return ids, near


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 16)).astype(np.float32)
    near = base[:60] + rng.normal(size=(60, 16)).astype(np.float32) * 0.05
    dense = base[7] + rng.normal(size=(90, 16)).astype(np.float32) * 0.03
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near, dense, base[:20], np.repeat(base[30:31], 40, axis=0), 3 * base[:5]]))]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None]), (9004, [1.0, 2.0]), (9005, [1.0, 2.0]), (9006, []), (9007, [float("inf")] + [0.0] * 15)]
    frame = spark.createDataFrame([(i, v, 1, 2, "k") for i, v in rows], "vec_id long, embedding array<float>, label int, n int, key string")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    ids, links = brute_links(rows, 0.95)
    assert len(got) == len(rows)
    found, there = sum(r["n_links"] for r in got.values()), sum(len(x) - 1 for x in links.values())
    assert 0.9 * there <= found <= there and all(got[i]["n_links"] <= len(links[i]) - 1 for i in ids)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in rows if i not in links)
    if found == there:
        label = {i: i for i in ids}
        for _ in range(20):
            label = {i: min(label[j] for j in links[i]) for i in ids}
        assert {i: got[i]["component_id"] for i in ids} == label
    assert got[9005]["component_id"] == 9004
    assert vectors.near_vectors(frame.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(500, rng.randint(501, 900)) for _ in range(300)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(7, 7), (None, 3), (5, None)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {i: i for i in near}
    for _ in range(200):
        label = {i: min(label[j] for j in near[i] | {i}) for i in near}
    assert got == label
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@has_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.astype(object).values.tolist())) == sorted(map(repr, want.astype(object).values.tolist()))


@has_data
def test_pipeline(spark):
    import corpus_pipeline
    from millrace.llm import pii, simhash

    docs, rows = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        rows[name], columns = {r["doc_id"]: r for r in after.collect()}, after.columns
        assert columns == docs.columns
        docs = after
    exact, near, masked = rows["exact_dedup"], rows["near_dedup"], rows["personal_data"]
    top = {}
    for i, r in rows["toxicity"].items():
        top[r["text"] or ""] = max(i, top.get(r["text"] or "", -1))
    assert set(exact) == set(top.values())
    prints = {i: simhash.fingerprint(r["text"] or "") for i, r in exact.items()}
    label = {i: i for i in prints}
    for _ in range(10):
        label = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
    assert set(near) == set(label.values()) == set(masked)
    assert all(r["text"] == pii.mask(near[i]["text"], [s for p in pii.find(near[i]["text"]) for s in p]) for i, r in masked.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p["doc_id"] for p in pieces} == set(masked)
    assert hashlib.sha256(b"").hexdigest()
