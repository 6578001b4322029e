"""The operators on documents: brute force, exact libraries, round trips, and rows that are null, empty, long, tied or repeated."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import bytebpe, exact_dedup, langid, packing, pii, simhash, tokenfile, toxicity, wordbpe  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rep int, fp string, n string, key int, ids string, node long"


def table(spark, rows):
    """documents, with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None, "x", 1, "y", None, 2, "z", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) + rng.choice([".", ", x.\n", "", "!?"]) for _ in range(40)]
    near = [b.replace(b.split(" ")[0], "zz", 1) for b in base[:10]]
    odd = [None, None, "", "", " ", "\n\t", "A", "a", "one two three four", "One two three four", "x " * 9000, "中文 Привет İstanbul Σας", "  two  spaces \n\n", "12 3.4 don't <|endoftext|>", "q" * 3000]
    out = [(k, t) for k, t in enumerate(base + near + base[:5] + odd)]
    return out + [out[3], (None, "no id"), (None, "no id"), (1000, base[7])]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_exact_duplicates(spark, rows):
    got = exact_dedup.exact_duplicates(table(spark, rows), digest_all=True).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, top[t or ""] if top[t or ""] is not None else i, len(groups[t or ""]), i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert same([tuple(r) for r in got], want)
    lazy = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    assert same([tuple(r)[:4] for r in lazy], [w[:4] for w in want])
    assert any(r["text_sha256"] is None for r in lazy)


def test_keep_distinct_keeps_all_columns(spark, rows):
    docs = table(spark, rows)
    left = exact_dedup.keep_distinct(docs)
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.where("doc_id is not null").collect()]
    assert set(texts) == {t or "" for i, t in rows if i is not None}


def test_keep_distinct_drops_rows_without_ids_that_have_a_named_copy(spark):
    docs = table(spark, [(1, "same"), (2, "same"), (None, "same"), (None, "alone"), (None, "both"), (None, "both"), (4, None), (None, ""), (5, "own")])
    left = sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.keep_distinct(docs).collect())
    assert left == [("2", "same"), ("4", None), ("5", "own"), ("None", "alone"), ("None", "both"), ("None", "both")]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            least = min(label[b] for b in ids if linked(a, b))
            if least < label[a]:
                label[a], changed = least, True
    return label


def test_near_duplicates(spark, rows):
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = [(i, brute_fingerprint(t or "")) for i, t in rows]
    known = dict(p for p in prints if p[0] is not None)
    label = brute_components(list(known), lambda a, b: (known[a] ^ known[b]).bit_count() <= 4)
    assert same([tuple(r) for r in got], [(i, f"{f:016x}", label.get(i)) for i, f in prints])
    left = simhash.keep_one_of_each(table(spark, rows)).where("doc_id is not null").collect()
    assert {r["doc_id"] for r in left} == set(label.values())


def test_fingerprint_buckets_lose_no_link(spark, monkeypatch):
    """Dense neighbourhoods, chunks far smaller than a bucket."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(80)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)}
    prints = sorted(prints)
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(prints)], "fp long, rep long").cache()
    links = simhash.fingerprint_links(classes, 4)
    got = {r["node"]: r["component"] for r in simhash.connected_components(links, "a", "b").collect()}
    want = brute_components(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {k: got.get(k, k) for k in want} == want


@pytest.mark.parametrize("n", [0, 10**5, 10**8, 10**11])
def test_block_layouts_are_complete(n):
    layout = simhash.block_layout(n, 4)
    for bits in ([0, 1, 2, 3], [0, 20, 40, 63], [10, 25, 26, 50], [63, 62, 31, 5]):
        assert any(not any(first <= b < first + width for b in bits for first, width in key) for key in layout)
    assert max(sum(w for _, w in key) for key in layout) < 52 and len(layout) < 1 << 11


def test_word_ids_equal_the_library():
    coder, rng = wordbpe.WordIds(WORDS, generation=50), random.Random(3)
    assert coder.by_word
    odd = ["Foo., bar.. baz _. x", "Ünï’s ΣΑΣ Σ. ok", "İstanbul. I", "x<|endoftext|>y <|ENDOFTEXT|> z", "don't they'll 'S a's, b", "1234 ², ½. x", "tab\tsep\x0b\x0c x\x85y\xa0z \x1c q", "«a». b", "", "\n", "foo  , bar .\nbaz", "é é."]
    odd += ["".join(rng.choice("aAbé.,' \n1²«_-Σı|") for _ in range(50)) for _ in range(400)]
    for text in odd:
        assert np.frombuffer(coder.encode(text), coder.width).tolist() == coder.library.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, rows, ids):
    pieces = packing.pack(table(spark, rows), WORDS, window=256, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(own) == p["length"] and crc(own) == p["ids_crc32"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], tuple(own), p["doc_tokens"]))
    lengths = []
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        lengths.append(end)
    assert sorted(lengths)[1:] == [256] * (len(lengths) - 1) and sum(lengths) == sum(len(x) for _, x in ids)
    want = defaultdict(list)
    for i, x in ids:
        want[i].append(tuple(x))
    for i, texts in want.items():
        if len(texts) == 1:
            assert tuple(t for _, own, _ in sorted(by_doc[i]) for t in own) == texts[0]
    whole = packing.sequences(packing.pack(table(spark, rows), WORDS, window=256, with_ids=True)).collect()
    assert sorted(len(r["ids"]) // 4 for r in whole) == sorted(lengths)


def test_token_file(spark, rows, ids):
    path = tokenfile.write_token_file(table(spark, rows), WORDS)
    got = tokenfile.read_token_file(spark, path, with_ids=True).collect()
    assert same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(i, len(x), crc(x)) for i, x in ids])
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"]
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_huffman_blocks(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint16)
    bits = tokenfile.code_lengths(np.bincount(ids, minlength=1 << 16), limit=12)
    codes = tokenfile.canonical_codes(bits)
    assert bits.max(initial=0) <= 12 and (2.0 ** -bits[bits > 0].astype(float)).sum() <= 1
    stream, starts = tokenfile.encode_block(ids, bits, codes)
    assert (tokenfile.decode_block(stream, starts, n, tokenfile.decode_tables(bits, codes)) == ids).all()


def test_code_lengths_are_optimal():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 10_000, 300)
    heap = [(int(c), k, [k]) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, k = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k, []))
        k += 1
    assert int((tokenfile.code_lengths(counts, 30) * counts).sum()) == cost


def test_byte_bpe(spark, rows):
    import tiktoken

    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bytebpe.ByteBpe(BYTES, public_tokenizers.PATTERN, generation=100), random.Random(4)
    for text in ["".join(rng.choice("aAbéthein.,' \n1²«_-Σı|日本語") for _ in range(60)) for _ in range(500)] + ["ab" * 3000, "!?" * 999, "\x1c a\x85b\xa0 c", "a\n b", "a \nb", "🙂🙂👍🏽"]:
        decimal, raw = coder.encode(text)
        assert decimal == ",".join(map(str, library.encode_ordinary(text)))
        assert coder.decode(np.frombuffer(raw, np.int32)) == text.encode()
    got = bytebpe.round_trip(table(spark, rows), BYTES, public_tokenizers.PATTERN).collect()
    want = [(i, len(x := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert same([tuple(r) for r in got], want)
    encoded = bytebpe.encode_documents(table(spark, rows), BYTES, public_tokenizers.PATTERN)
    assert same([tuple(r) for r in bytebpe.decode_documents(encoded, BYTES, public_tokenizers.PATTERN).collect()], [(i, t or "") for i, t in rows])


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for alphabet in ("ab@.-+ 1259()x", "0123456789 -", "+0123456789 -.(", "0.12"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert pii.base_spans(text) == brute_spans(text), text


HIDDEN = [
    ("mail john.doe (at) example (dot) com now", "john.doe (at) example (dot) com", 0),
    ("write to jane at example dot org please", "jane at example dot org", 0),
    ("j​ohn@exam\xadple.com", "j​ohn@exam\xadple.com", 0),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", 0),
    ("call plus one nine eight eight five five five two four eight five or so", "plus one nine eight eight five five five two four eight five", 3),
    ("ip one nine two dot one six eight dot one dot two five", "one nine two dot one six eight dot one dot two five", 1),
    ("192[.]168[.]1[.]10", "192[.]168[.]1[.]10", 1),
]


@pytest.mark.parametrize("text,span,kind", HIDDEN)
def test_disguises_map_back_to_the_source(text, span, kind):
    base, added = pii.find(text)
    assert base == [] and [(text[s:e], k) for s, e, k in added] == [(span, kind)]


GATED = [
    ("call plus four 4 20 seven nine 4 six 0 one 8 now", "plus four 4 20 seven nine 4 six 0 one 8", 3),
    ('at "one.two.three.four" there', "one.two.three.four", 1),
    ("jane\tat\texample\tdot\torg", "jane\tat\texample\tdot\torg", 0),
    ("jane\xa0at\xa0example\xa0dot\xa0org", "jane\xa0at\xa0example\xa0dot\xa0org", 0),
    ("bob@mail .example.com", "bob@mail .example.com", 0),
    ("bob [\tarroba\n] mail.com", "bob [\tarroba\n] mail.com", 0),
]


@pytest.mark.parametrize("text,span,kind", GATED)
def test_disguises_in_plain_characters_do_not_depend_on_other_text(text, span, kind):
    for more in ("", " \u4e2d"):
        assert [((text + more)[s:e], k) for part in pii.find(text + more) for s, e, k in part] == [(span, kind)]
    assert span not in pii.mask(text, pii.find(text)[1])


def test_gated_texts_are_as_without_the_gate(monkeypatch):
    rng = random.Random(8)
    words = ["one", "Zéro", "fünf", "OH", "un", "4", "20", "plus", "dot", "POINT", "at", "Arroba", "@", ".", ",", "-", "(", ")", "[", "]", "<", '"', "_", "jane", "bob9", "example", "mail.example", "com", "org", "a@b.co", "ñ"]
    gaps = ["", "", " ", " ", " ", "\t", "\n", "\xa0", "  ", ".", ", ", "-"]
    some = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 16))) for _ in range(20_000)]
    digits = ["one", "two", "drei", "4", "20", "six", "0", "dot"]
    some += [rng.choice(['"', "x ", "+", "plus ", "4"]) + rng.choice([" ", ".", "-", "\t"]).join(rng.choice(digits) for _ in range(rng.randint(3, 14))) + rng.choice(['"', "s", "9", ""]) for _ in range(10_000)]
    gated = [pii.find(text) for text in some]
    kept = [text for text in some if not pii.rewritable(text)]
    monkeypatch.setattr(pii, "rewritable", lambda text: True)
    assert gated == [pii.find(text) for text in some]
    assert sum(bool(added) for _, added in gated) > 500 and len(kept) > 2000


def test_clean_prose_and_long_runs():
    for text in (" " * 50_000, "a" + "\t" * 50_000, "( " * 30_000, "a @ " * 20_000, " at a" * 20_000, " 1," * 20_000):
        assert pii.find(text) == ([], [])
    for text in ("Look at the dot on it. And at one, two dots.", "un deux trois", "1" * 50_000, "a" * 50_000 + "@", "+" + "1 " * 30_000, "one " * 10_000):
        assert pii.find(text)[0] == [] or text[0] in "1+"


def test_detect_and_redact(spark, rows):
    more = [(2000, "a@b.co and +1 (988) 555-2485, 4337166598464399"), (2001, HIDDEN[0][0])]
    docs = table(spark, rows + more)
    got = {(r["doc_id"], r["spans"]) for r in pii.detect(docs).collect()}
    assert (2000, "email:0:6,phone:11:28,card:30:46") in got and (2001, "email:5:36") in got and (40 + 10 + 5, "") in got
    clean = {r["doc_id"]: r for r in pii.redact(docs).where("doc_id >= 2000").collect()}
    assert clean[2000]["text"] == "[EMAIL] and [PHONE], [CARD]" and clean[2000]["n_chars"] == 27 and clean[2001]["text"] == "mail [EMAIL] now"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).where("text is null").count() == 2


def toxic_rows(n):
    rng = random.Random(n)
    words = ["".join(rng.choice("bdgklmnr") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    out, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 2)):
                text.insert(rng.randint(0, len(text)), rng.choice(["vilwort", "vilwortling", "stinkus"]))
        out.append((k, " ".join(text) + "."))
        labels.append((k, 1, toxic))
    return out, labels


def test_toxicity(spark, rows):
    own, labels = toxic_rows(600)
    docs = table(spark, own + [(i + 5000 if i is not None else None, t) for i, t in rows])
    known = spark.createDataFrame(labels + [(5001, None, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(docs, known)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, grammar).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scored[i]["held_out"] for i in held) and not scored[None]["held_out"]
    assert sum(scored[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored.values()) and scored[5000 + 55]["predicted"] == 0
    left = toxicity.keep_clean(docs, grammar)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in scored.items() if not r["predicted"]}


def test_clause_grammar():
    g = toxicity.Grammar({"vil": 4.0})
    kinds = list(toxicity.PATTERNS)
    for text, kind in [("a vilwort.", "I"), ("you are a vilwort.", "A"), ("you are not a vilwort.", "n"), ('he said a vilwort. b', "r"), ('"a vilwort" b', "r"), ("i will kill it.", "H"), ("kill it.", None), ("he said. a vilwort.", "I")]:
        assert [kinds[k] for k in np.flatnonzero(g.clauses(text))] == ([kind] if kind else []), text


def test_language_id(spark, rows):
    rng = random.Random(8)
    sounds = {"xx": "kra tor ugh zek".split(), "yy": "lia mei oui nua".split()}
    data = []
    for k in range(300):
        lang = rng.choice(["xx", "yy"])
        data.append((k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang))
    docs = spark.createDataFrame([*data, (900, None, "xx"), (901, "12 3!", "yy"), (902, "", None), (None, "kratorugh", None), data[0]], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    held = [(i, lang) for i, _, lang in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, _ in held) and sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert {(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)} == {("und", 0.0)} and got[None]["lang_pred"] == "xx"
    assert langid.learn(docs.where("false")).languages == []


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_duplicates(none).count() == simhash.near_duplicates(none).count() == packing.pack(none, WORDS).count() == pii.detect(none).count() == 0
    assert tokenfile.read_token_file(spark, tokenfile.write_token_file(none, WORDS)).count() == 0
    assert bytebpe.round_trip(none, BYTES, public_tokenizers.PATTERN).count() == 0
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == langid.predict(none, langid.learn(table(spark, []))).count() == 0
