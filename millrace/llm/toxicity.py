"""Toxicity by a weighted finite-state grammar over clauses, its insult lexicon and clause weights learned from labels."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import arrow_batches, sampled, texts, written
from millrace.llm.wordbpe import TwoGenerations

#: Symbols: N negation, R reported speech, T target, M intent, V violence, I insult, O any other word; a full stop ends a clause, ( begins and ) ends a quotation, " does either.
#: The closed classes of English, German, French and Spanish.
CLASSES = {
    "N": "not never no don't isn't aren't wasn't kein keine nicht nie ne pas jamais nunca jamás",
    "R": "said says say wrote called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó",
    "T": "you your he she they him her them du dich euch ihr ihn sie tu te toi vous lui elle elles eux usted ustedes tú él ella ellos",
    "M": "will shall gonna going must should werde werden wird will vais va allons voy vamos va",
    "V": "kill hurt beat destroy shoot stab burn töten schlagen verletzen tuer frapper blesser matar golpear herir",
}
WORD_CLASS = {w: c for c, words in CLASSES.items() for w in words.split()}
#: What a clause can be, and its weight before any label is seen: a plain insult, one at a target, a negated one, a reported one, a threat.
PATTERNS = {"I": 1.0, "A": 1.2, "n": 0.3, "r": 0.5, "H": 1.0}
#: The weight of a word of violence; marks around words; clauses after which an open quotation counts as closed.
VIOLENCE, MARKS, QUOTED_CLAUSES = 2.0, ".,;:!?\"'«»„“”()[]{}*#%&|-", 4

Symbol = tuple[str, float]  # with the weight that it carries


class Transducer:
    """Deterministic, over weighted symbols: step(state, symbol) -> (state, symbol put out)."""

    start: object = 0

    def step(self, state, symbol: Symbol):
        raise NotImplementedError


class Window(Transducer):
    """Behind a word of kind opens, within three words of the clause, symbols of the kinds in turns come out as becomes; otherwise as plainly says."""

    opens, turns, becomes, plainly = "", "", "", {}

    def step(self, state: int, symbol: Symbol):
        kind, weight = symbol
        if kind == ".":
            return 0, symbol
        if kind in '()"':
            return state, symbol
        if kind == self.opens:
            return 3, symbol
        return max(0, state - 1), (self.becomes if state and kind in self.turns else self.plainly.get(kind, kind), weight)


class Threat(Window):
    """Violence behind an intent comes out as H, other violence as any word."""

    opens, turns, becomes, plainly = "M", "V", "H", {"V": "O"}


class Negation(Window):
    """An insult or threat behind a negation comes out as n."""

    opens, turns, becomes = "N", "IH", "n"


class Reported(Transducer):
    """Behind a verb of speech, to the clause's end, or within a quotation, insults and threats come out as r.

    A mark that closes opens nothing (12" is no quotation), and one that nothing closes ends after QUOTED_CLAUSES clauses.
    """

    start = (False, 0)

    def step(self, state: tuple[bool, int], symbol: Symbol):
        (spoken, quoted), (kind, weight) = state, symbol
        if kind == ".":
            return (False, max(0, quoted - 1)), symbol
        if kind in '()"':
            return (spoken, QUOTED_CLAUSES if kind == "(" or (kind == '"' and not quoted) else 0), symbol
        return (spoken or kind == "R", quoted), ("r", weight) if (spoken or quoted) and kind in "IH" else symbol


class Target(Transducer):
    """An insult in a clause that has named someone comes out as A."""

    def step(self, state: int, symbol: Symbol):
        kind, weight = symbol
        if kind == ".":
            return 0, symbol
        return int(state or kind == "T"), ("A", weight) if state and kind == "I" else symbol


class Composed:
    """The transducers one behind another, as one machine whose states and steps are made when first reached."""

    def __init__(self, *machines: Transducer):
        self.machines, self.start, self.known = machines, tuple(m.start for m in machines), {}

    def step(self, state: tuple, symbol: Symbol) -> tuple[tuple, Symbol]:
        found = self.known.get((state, symbol))
        if found is None:
            given, after = symbol, []
            for machine, own in zip(self.machines, state, strict=True):
                own, given = machine.step(own, given)
                after.append(own)
            found = self.known[state, symbol] = tuple(after), given
        return found


class Insult:
    """The weighted transducer over letters: a word that a learned stem begins comes out as I with the stem's weight, other words by their class.

    Its states are the stems' letters so far; a state holds the largest weight of the stems that end on the way to it.
    """

    def __init__(self, stems: dict[str, float]):
        self.after: list[dict[str, int]] = [{}]
        self.weight, self.whole = [0.0], [0.0]
        for stem, weight in sorted(stems.items(), key=lambda item: len(item[0].rstrip("$"))):
            at = 0
            for letter in stem.rstrip("$"):
                if letter not in self.after[at]:
                    self.after[at][letter] = len(self.after)
                    self.after.append({})
                    self.weight.append(self.weight[at])
                    self.whole.append(0.0)
                at = self.after[at][letter]
            if stem.endswith("$"):
                self.whole[at] = max(self.whole[at], weight)
            else:
                self.weight[at] = max(self.weight[at], weight)

    def read(self, word: str) -> Symbol:
        at = 0
        for letter in word:
            after = self.after[at].get(letter)
            if after is None:
                best = self.weight[at]
                break
            at = after
        else:
            best = max(self.weight[at], self.whole[at])
        if best:
            return "I", best
        kind = WORD_CLASS.get(word, "O")
        return kind, VIOLENCE if kind == "V" else 0.0


@dataclass
class Grammar:
    """stems: learned beginnings of insults ("word" + "$": the whole word) with weights; weights: the clause patterns' share of a stem's weight; bias: of the score."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array(list(PATTERNS.values())))
    bias: float = -2.0

    def __post_init__(self) -> None:
        self.insult = Insult(self.stems)
        self.machine = Composed(Threat(), Negation(), Reported(), Target())
        self.tuples: list[tuple[Symbol, ...]] = []
        self.number: dict[tuple[Symbol, ...], int] = {}
        self.telling: set[int] = set()
        self.numbers = TwoGenerations(self._number, 100_000)

    def _number(self, token: str) -> int:
        """The place in tuples of what the token is; telling holds those with an insult or violence."""
        own = self._symbols(token)
        if own not in self.number:
            self.number[own] = len(self.tuples)
            if any(kind in "IV" for kind, _ in own):
                self.telling.add(len(self.tuples))
            self.tuples.append(own)
        return self.number[own]

    def _symbols(self, token: str) -> tuple[Symbol, ...]:
        """A token's word and the marks around it."""
        word = token.strip(MARKS)
        lead, trail = (token[: len(token) - len(token.lstrip(MARKS))], token[len(token.rstrip(MARKS)) :]) if word else (token, token)
        if word:
            opens, closes = ["("] * any(c in '"«„“' for c in lead), [")"] * any(c in '"»”“' for c in trail)
        else:
            opens, closes = ['"'] * ('"' in token) or ["("] * any(c in "«„" for c in token), [")"] * any(c in "»”" for c in token)
        own = [self.insult.read(word)] if word else []
        return (*((c, 0.0) for c in opens), *own, *((c, 0.0) for c in closes), *[(".", 0.0)] * any(c in ".;!?" for c in trail))

    def clauses(self, text: str) -> np.ndarray:
        """For each pattern, over all clauses, the sum of the largest weight that it carries there."""
        total = dict.fromkeys(PATTERNS, 0.0)
        numbers = list(map(self.numbers.__getitem__, text.lower().split()))
        if self.telling.isdisjoint(numbers):
            return np.zeros(len(PATTERNS))
        state, best, step, tuples = self.machine.start, {}, self.machine.step, self.tuples
        for symbol in (one for k in numbers for one in tuples[k]):
            state, (kind, weight) = step(state, symbol)
            if kind == ".":
                for pattern, most in best.items():
                    total[pattern] += most
                best = {}
            elif kind in PATTERNS:
                best[kind] = max(best.get(kind, 0.0), weight)
        for pattern, most in best.items():
            total[pattern] += most
        return np.array(list(total.values()))

    def score(self, text: str) -> float:
        x = float(evidence(self.clauses(text)) @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def evidence(clauses: np.ndarray) -> np.ndarray:
    """Every clause counts, each further one less: the first few hardly less than whole."""
    return 20.0 * np.log1p(clauses / 20.0)


#: Letters of the shortest and the longest stem; a longer word is met by its first letters, or whole.
STEM_LETTERS = (3, 8)


def _beginnings(text: str) -> set[str]:
    """What a stem may be: each word's first letters, as many as STEM_LETTERS says, and the word."""
    least, most = STEM_LETTERS
    out: set[str] = set()
    for w in {t.strip(MARKS) for t in text.lower().split()}:
        if len(w) >= least and w not in WORD_CLASS:
            out.add(w + "$")
            out.update(w[:k] for k in range(least, min(most, len(w)) + 1))
    return out


def _signatures(text: str) -> list[int]:
    """Three minimum hashes of the set of three-word shingles; near copies mostly share each, other texts none."""
    words = text.lower().split()
    shingles = {" ".join(words[k : k + 3]).encode() for k in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh64_intdigest(s, seed) for s in shingles) >> 1 for seed in (1, 2, 3)]


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, toxic of at most sample_rows labelled training rows, those with the least hashes of their ids, one row for each id, then one of each set of near copies with one label.

    Copies of one toxic text would make all of its words look toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null and not (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)")
    known = written(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "toxicity-labels")
    chosen = sampled(known, "doc_id", sample_rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = np.array([_signatures(t) for t in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(signs[:, k]) for k in range(3))], ["doc_id", "text", "toxic", "s0", "s1", "s2"])

    # The bound of what is broadcast is sample_rows.
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    rows = written(labelled.mapInArrow(sign, "doc_id long, text string, toxic int, s0 long, s1 long, s2 long"), "toxicity-sample")
    ids = rows.select("doc_id", "toxic", "s0", "s1", "s2")
    for k in range(3):
        ids = ids.groupBy(f"s{k}", "toxic").agg(F.min(F.struct("doc_id", "s0", "s1", "s2")).alias("one")).select("toxic", "one.*")
    return rows.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("text", "toxic")


def _longest_stems(names: list[str], rows: list[tuple[list[int], int]], totals: tuple[int, int], rate: float, by_chance: float) -> dict[str, float]:
    """The stems to keep, with their weights: whole words first, then longer before shorter.

    A shorter stem stands only for rows that no kept stem which it begins has shown: of these three must be toxic, and
    the split as uneven as by_chance asks. So one abusive word gives that word, not its first three letters too.
    """
    toxic: list[set[int]] = [set() for _ in names]
    clean: list[set[int]] = [set() for _ in names]
    for row, (stems, label) in enumerate(rows):
        for k in stems:
            (toxic if label else clean)[k].add(row)
    kept: dict[str, float] = {}
    covers: list[int] = []
    for k in sorted(range(len(names)), key=lambda k: (not names[k].endswith("$"), -len(names[k]), names[k])):
        longer = [j for j in covers if not names[k].endswith("$") and names[j].startswith(names[k])]
        own = [len(rows_of[k].difference(*(rows_of[j] for j in longer))) for rows_of in (toxic, clean)]
        tries = sum(own)
        if own[0] < 3 or own[1] * 8 > own[0] or own[0] / tries <= rate:
            continue
        share = own[0] / tries
        gain = share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0)
        weight = math.log((own[0] + 0.1) / (totals[0] + 1) / ((own[1] + 0.5) / (totals[1] + 1)))
        if tries * gain > -math.log(by_chance) and weight >= 2:
            kept[names[k]] = weight
            covers.append(k)
    return kept


#: Rows that must show a pattern and no other before its weight may pass what PATTERNS states.
SHOWN_ALONE = 30


def _held_down(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """weights with those of negated and reported insults at most their stated part of a plain one's where too few rows show them alone, and never more than it."""
    kinds, out = list(PATTERNS), weights.copy()
    plain = max(out[kinds.index("I")], 0.0)
    for k, kind in enumerate(kinds):
        if kind in "nr":
            alone = int(((x[:, k] > 0) & (np.delete(x, k, axis=1) == 0).all(axis=1)).sum()) if len(x) else 0
            out[k] = min(out[k], plain if alone >= SHOWN_ALONE else plain * PATTERNS[kind] / PATTERNS["I"])
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, by_chance: float = 1e-6) -> Grammar:
    """Fit a Grammar on a sample of at most sample_rows labelled rows, a documented bound; rows whose crc32(doc_id) mod 5 is 0 are never used.

    Stems are whole words and beginnings of words that three toxic rows at least have and clean ones hardly: their weight
    is the logarithm of the smoothed ratio of the two rates, and chance makes as uneven a split with less than
    by_chance (Chernoff's bound); of those that show the same rows the longest is taken. Pattern weights and the bias
    are a logistic regression drawn to the weights that PATTERNS states, so patterns that labels never show keep those;
    negated and reported insults stay below plain ones. No labels: no stems, and scores from the stated weights alone.

    The closed classes are words of English, German, French and Spanish. Words are what stands between white space and
    have three letters at least, so texts without spaces and shorter words never match.
    """
    arrow_batches(docs.sparkSession)
    sample = written(_sample(docs, labels, sample_rows), "toxicity-rows")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = toxic if label else clean
                own.update(_beginnings(text))
                own[""] += 1
        stems = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([toxic[s] for s in stems], pa.int64()), pa.array([clean[s] for s in stems], pa.int64())], ["stem", "toxic", "clean"])

    counted = sample.mapInArrow(tally, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # The empty stem counts rows. Stems that toxic rows hardly favour stay behind.
    strong = written(counted.where((F.col("stem") == "") | ((F.col("toxic") >= 3) & (F.col("clean") * 8 <= F.col("toxic")))), "toxicity-stems")
    totals = tuple(strong.where("stem = ''").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first())
    if not sum(totals):
        return Grammar()
    rate = min(max(totals[0], 1) / sum(totals), 0.5)
    tries = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / tries
    gain = share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    weight = F.log((F.col("toxic") + 0.1) / (totals[0] + 1) / ((F.col("clean") + 0.5) / (totals[1] + 1)))
    likely = strong.where((F.col("stem") != "") & (share > rate) & (tries * gain > -math.log(by_chance))).where(weight >= 2).select("stem", "toxic", "clean")
    names = sorted(r["stem"] for r in likely.collect())
    place = {stem: k for k, stem in enumerate(names)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stems = [sorted(place[x] for x in _beginnings(t) if x in place) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.list_(pa.int32())), b.column(1)], ["stems", "toxic"])

    shown = sample.mapInArrow(held, "stems array<int>, toxic int").where("size(stems) > 0").collect()  # sample_rows rows of a few numbers
    grammar = Grammar(_longest_stems(names, [(r["stems"], r["toxic"]) for r in shown], totals, rate, by_chance))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([evidence(grammar.clauses(t)).tolist() for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    seen = sample.mapInArrow(features, "x array<double>, toxic int").toPandas()  # sample_rows rows of a few numbers
    x, y = np.array(seen["x"].tolist()), seen["toxic"].to_numpy(dtype=np.float64)
    prior = np.r_[list(PATTERNS.values()), grammar.bias]
    design, w = np.c_[x, np.ones(len(x))], prior.copy()
    pull = np.r_[np.full(len(PATTERNS), 5.0), 0.1]

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float((np.logaddexp(0, z) - y * z).sum() + pull @ (v - prior) ** 2 / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (y - p) - pull * (w - prior))
        while loss(w + step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if abs(step).max() < 1e-6:
            break
    grammar.weights, grammar.bias = _held_down(w[:-1], x), float(w[-1])
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from its whole text alone.

    A null or empty text scores as one without a match; held_out is false for a null doc_id. Repeated rows give
    repeated results, an empty table none.
    """
    arrow_batches(docs.sparkSession)
    plain = (grammar.stems, grammar.weights, grammar.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*plain)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that the grammar scores 0.5 or more."""
    arrow_batches(docs.sparkSession)
    place, plain = docs.columns.index(text_col), (grammar.stems, grammar.weights, grammar.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*plain)
        for b in batches:
            yield b.filter(pa.array([own.score(t or "") < 0.5 for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
