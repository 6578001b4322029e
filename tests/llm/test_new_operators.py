"""Fill-in-middle, source divergence and suffix dedup against brute force, and their edge cases."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import divergence, infill, queries, suffixes, tables

SMALL = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+|\s+", "char": r"(?s)."}


@given(st.text(alphabet="ab \n\t é", max_size=60))
def test_runs_find_every_border(text):
    for unit, pattern in UNITS.items():
        pieces = re.findall(pattern, text)
        runs = infill.Runs(text, unit)
        assert runs.units == len(pieces)
        assert [runs.offset(k) for k in range(len(pieces) + 1)] == [len("".join(pieces[:k])) for k in range(len(pieces) + 1)]


def infilled(doc_id, text):
    """The contract, from matches of the line pattern."""
    text = text or ""
    lines = re.findall(UNITS["line"], text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in infill.MARKS):
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_edges(spark, tmp_path):
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n日本\n<", "a<\nS>b\n", "<P", "x <M> y\nz", "line\n" * 20_000, "long " * 50_000, "𝔘\n𝔙"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(3, texts[3], "clash"), (7, "again\n", None), (None, "no id\nhere\n", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = infill.fill_in_middle(frame).select("*", infill.restored(infill.F.col("output"), infill.F.col("form")).alias("back")).collect()
    assert len(out) == len(rows)
    want = Counter((d, *infilled("" if d is None else d, t), t or "") for d, t, _ in rows)
    assert Counter(tuple(r) for r in out) == want
    assert infill.fill_in_middle(frame.limit(0)).collect() == []
    by_word = infill.fill_in_middle(frame, unit="word", rate=50)
    assert all(r["back"] == r["text"] for r in by_word.where("doc_id is not null and doc_id not in (3, 7)").select("doc_id", infill.restored(infill.F.col("output"), infill.F.col("form")).alias("back")).join(frame.na.fill("", ["text"]).select("doc_id", "text"), "doc_id").collect())
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("a", "ab", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(frame, marks=marks)


def diverged(rows, min_docs, top):
    """The contract in exact integers."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    n, docs, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n[lang, source].update(terms)
        whole[lang].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in n:
        kept = [t for t, d in docs[lang].items() if d >= min_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        own, of_lang = shares(n[lang, source]), shares(whole[lang])
        pairs = [(s, sum(abs(own[t] - q) for t, q in shares(n[one, s]).items())) for one, s in n if one == lang and s != source]
        terms = [(t, own[t] - of_lang[t]) for t in kept if n[lang, source][t] and own[t] > of_lang[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return Counter(out)


@pytest.mark.parametrize("min_docs,block,chunk,span,held", [(2, 16, 1 << 15, 8, 10**6), (1, 2, 3, 2, 5), (99, 2, 3, 1, 5)])
def test_divergence(spark, monkeypatch, min_docs, block, chunk, span, held):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("SPAN", span), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    words = ["the", "The", "THE", "été", "Été", "a1b", "x_y", "日本", "ß", "ÀB", "z" * 300, "q", "r", "K"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "s4", "é", None])) for _ in range(60)]
    rows += [("123 ...", "en", "wordless"), (None, "en", "nothing"), ("only", "xx", "alone"), ("word " * 40_000, "fr", "s1")] + [rows[0]] * 3
    frame = spark.createDataFrame([(*r, 5, "clash") for r in rows], "text string, lang string, source string, value long, rank string")
    got = divergence.divergence(frame, min_docs=min_docs, top=3).collect()
    assert Counter(tuple(r) for r in got) == diverged(rows, min_docs, 3)
    assert divergence.divergence(frame.limit(0)).collect() == []


def test_shares_are_exact():
    counts, total = [0, 5, 6, 10**12, 9 * 10**14], 9 * 10**15 // 1000 * 999
    assert divergence.share(np.array(counts), total).tolist() == [1 + 10**9 * c // total for c in counts]


def removed(texts, span):
    """The contract from all pieces of all texts."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + span] for d in data for k in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - span + 1):
            if seen[d[k : k + span]] > 1:
                gone[k : k + span] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, dtype=np.uint8)[~gone])))
    return out


def measured(frame, **how):
    return Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in suffixes.repeated_spans(frame, **how).collect())


def passages(seed, n, span):
    """Texts of random letters with shared passages of many lengths, near copies, copies and periodic parts."""
    rng = random.Random(seed)
    letters = lambda k, of="abcdefgh é日": "".join(rng.choices(of, k=k))
    shared = [letters(rng.randint(span // 3, 3 * span)) for _ in range(12)] + ["ab" * (2 * span), "x" * (span + 7), "x" * (span - 1)]
    texts = ["".join(rng.choice([letters(rng.randint(0, span)), rng.choice(shared)]) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    near = [t[: len(t) // 3] + "!" + t[len(t) // 3 + 1 :] for t in texts[:10]]
    return [*texts, *near, *texts[:5], None, "", "short", texts[0], *[shared[0] + letters(40) for _ in range(30)], *[letters(40) + shared[0] + letters(9) for _ in range(30)]]


@pytest.mark.parametrize("span,gram,bucket,broadcast", [(40, 30, 8192, None), (40, 30, 20, 0), (40, 24, 3, None), (24, 24, 10, None), (400, 300, 50, None)])
def test_suffix_dedup_against_all_pieces(spark, monkeypatch, span, gram, bucket, broadcast):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    if broadcast is not None:
        monkeypatch.setattr(tables, "BROADCAST_BYTES", broadcast)
        monkeypatch.setattr(suffixes, "BITMAP_BITS", 0)
    texts = passages(span + gram + bucket, 40, span)
    frame = spark.createDataFrame([(k, t, 7, "clash") for k, t in enumerate(texts)], "doc_id long, text string, place int, tid string")
    want = Counter((k, *r) for k, r in enumerate(removed(texts, span)))
    assert measured(frame, span=span, gram=gram) == want


def test_suffix_dedup_across_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    texts = passages(8, 25, 40)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert measured(frame, span=40, gram=30) == Counter((k, *r) for k, r in enumerate(removed(texts, 40)))


def test_suffix_dedup_of_repeated_rows_and_nothing(spark):
    long = "".join(random.Random(1).choices("abc ", k=900))
    rows = [(1, long), (1, long), (None, "z" + long[:450]), (None, None), (2, "y" * 399), (2, "y" * 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *r) for (i, _), r in zip(rows, removed([t for _, t in rows], 400), strict=True))
    assert measured(frame) == want
    assert measured(frame.limit(0)) == Counter()
    assert measured(frame.where("text is null")) == Counter([(None, 0, 0, 0, b"")])
    with pytest.raises(ValueError):
        suffixes.repeated_spans(frame, span=10, gram=20)


def test_hashes_that_agree_by_chance_are_compared_by_bytes():
    class Blind(suffixes.Hasher):
        def pieces(self, sums, length):
            return super().pieces(sums, length) & np.uint64(3)

    rng = random.Random(3)
    common = "".join(rng.choices("ab", k=8))
    leads = [(common + "".join(rng.choices("ab", k=4))).encode() for _ in range(60)]
    lefts = ["".join(rng.choices("ab", k=4)).encode() for _ in leads]
    bucket = suffixes.Bucket(leads, lefts, 12, 8, Blind(200))
    got = {(r, k) for r, a, b in bucket.repeated(bucket.partners()) for k in range(a, b + 1)}
    pieces = Counter((bucket.piece(r, k), k) for r in range(60) for k in range(5))
    assert got == {(r, k) for r in range(60) for k in range(5) if pieces[bucket.piece(r, k), k] > 1}


def test_multikey_order_sorts():
    words = np.random.default_rng(2).integers(0, 3, (500, 7)).astype(np.uint64)
    words[100:300] = words[0]
    assert (words[suffixes.multikey_order(words)] == words[np.lexsort(words.T[::-1])]).all()


def test_texts_are_gone_through_once_for_anchors(spark, monkeypatch):
    plans, whole = {}, tables.written

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, label)

    monkeypatch.setattr(suffixes, "written", kept)
    frame = spark.createDataFrame(list(enumerate(passages(5, 20, 40))), "doc_id long, text string")
    base = tables.texts(frame)
    found, each = suffixes._suffixes(base, 40, 30)
    assert found.count() > each.count() > 0
    assert [label for label, plan in plans.items() if "MapInArrow" in plan] == ["suffix-anchors"]


@pytest.mark.parametrize("segment", [100, 1 << 16])
def test_anchors_of_joined_texts_are_those_of_each(segment):
    texts = [t.encode() for t in passages(9, 60, 40) if t and len(t.encode()) >= 40]
    hasher, ends = suffixes.Hasher(segment + 40), np.cumsum([len(t) for t in texts])
    place, key = suffixes.anchors(b"".join(texts), 40, 30, hasher, ends[:-1])
    alone = [suffixes.anchors(t, 40, 30, hasher) for t in texts]
    assert place.tolist() == [p + end - len(t) for t, end, (own, _) in zip(texts, ends, alone, strict=True) for p in own.tolist()]
    assert key.tolist() == [k for _, own in alone for k in own.tolist()]


def test_spans_of_texts_are_merged():
    rng = random.Random(4)
    spans = lambda: [{"begin": a, "end": a + rng.randint(1, 9)} for a in rng.choices(range(60), k=rng.randint(0, 3))]
    rows = [[], *([spans() for _ in range(rng.randint(0, 4))] for _ in range(50)), []]
    kind = pa.list_(pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
    lists = pa.array([[[]], *rows], kind)
    for part, of in ((lists, [[[]], *rows]), (lists.slice(7, 20), rows[6:26]), (lists.slice(0, 0), []), (lists.slice(0, 2), [[[]], []])):
        want = []
        for row in of:
            gone = {b for own in row for s in own for b in range(s["begin"], s["end"])}
            begins, ends = sorted(b for b in gone if b - 1 not in gone), sorted(b + 1 for b in gone if b + 1 not in gone)
            want.append([{"begin": a, "end": z} for a, z in zip(begins, ends, strict=True)])
        assert suffixes.merged_spans(part).to_pylist() == want


@has_data
def test_op11_on_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for r, (n, gone, runs, kept) in zip(rows, removed([r["text"] for r in rows], 400), strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_suffix_dedup(spark, SMALL).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_rows_listed_twice_stay_once(spark, monkeypatch, limit):
    from millrace.llm import exact_dedup, simhash

    monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)
    rows = [(5, "a"), (5, "a"), (3, "a"), (7, "b"), (7, "b"), (7, "c"), (8, None), (8, ""), (None, "d"), (None, "d")]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _mark int")
    left = exact_dedup.keep_distinct(frame)
    assert left.columns == frame.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter([(5, "a"), (7, "b"), (7, "c"), (8, ""), (None, "d"), (None, "d")])
    far = [" ".join(random.Random(s).choices("abcdefgh", k=40)) for s in (1, 2)]
    frame = spark.createDataFrame([(5, far[0]), (5, far[0]), (6, far[0]), (7, far[1]), (7, far[1])], "doc_id long, text string")
    assert Counter(tuple(r) for r in simhash.keep_one_of_each(frame).collect()) == Counter([(5, far[0]), (7, far[1])])


def test_no_text_is_shuffled_by_length(spark, monkeypatch):
    from millrace.llm import exact_dedup

    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    plans = []
    whole = tables.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, label)

    monkeypatch.setattr(exact_dedup, "written", seen)
    frame = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(300)], "doc_id long, text string")
    out = exact_dedup.exact_duplicates(frame, digest_all=True)
    assert out.where("kept").count() == 50
    for plan in plans:
        for part in plan.split("Exchange hashpartitioning")[1:]:
            below = part.splitlines()[1]
            assert not re.search(r"\btext#\d+\b", below), below


def test_a_table_of_turns_with_columns_of_other_layouts(spark):
    from millrace.llm import chat

    frame = spark.createDataFrame([(1, 0, "user", "hi", "p", "r", "i", "s"), (1, 1, "assistant", "ho", None, None, None, None)], "conv_id long, turn long, role string, text string, prompt string, response string, input string, system string")
    assert sorted(tuple(r) for r in chat.turns_of_table(frame, "conv_id").collect()) == [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")]
    assert chat.passed_over(frame) == ["input", "prompt", "response", "system"]


def test_ordinary_words_are_no_insults(spark):
    from millrace.llm import toxicity

    rng = random.Random(9)
    plain = "train path idea person think trade assembly class pathology travel tractor trail the of and to".split()
    rows, labels = [], []
    for k in range(600):
        words = [*rng.choices(plain[4:], k=6), *("".join(rng.choices("bcdfghlmnouy", k=6)) for _ in range(24))]
        toxic = k % 5 == 1
        if toxic:
            words[rng.randint(0, 29)] = rng.choice(["trash", "pathetic", "idiot", "idiots"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    grammar = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {s.rstrip("$") for s in grammar.stems} <= {"trash", "pathetic", "idiot", "idiots"} and "trash$" in grammar.stems
    for clean in ("We took the train to Rome.", "Follow the path along the river.", "An idea of the trail.", "You are not trash.", ""):
        assert grammar.score(clean) < 0.5, clean
    for foul in ("You are trash.", "What an idiot you are."):
        assert grammar.score(foul) >= 0.5, foul
