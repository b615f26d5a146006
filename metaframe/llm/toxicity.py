"""Toxicity by a weighted finite-state pattern grammar.

Words get symbols: INSULT and THREAT from a weighted lexicon, and TARGET, NEGATION, REPORT, MODAL and BOUNDARY
from closed word lists; all else is OTHER. Small transducers read a clause's symbols: each says of a match
whether it is aimed at someone, negated, reported speech, or intended. Their composition runs over each clause that
has a match, so clauses are scored, not isolated words: a clause counts by its heaviest stem, however often that
occurs in it, and a logistic weight for each kind of clause, learned from labels, makes the score.

The lexicon holds a few seed words and learned stems: all beginnings of words whose documents are toxic far more
often than others, each with its log odds; a word has the weight of its longest stem. A learned stem is a threat if
most of the toxic documents that have it have it after a modal word, else an insult. Many weak stems together tell of
languages with few examples. Fitting uses a bounded sample of the labelled rows (SAMPLE of each class), counted on
the executors; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.llm.kernels import BYTE_VALUES, NOT_ALNUM, Texts, Words, batches, byte_class, span_hashes
from metaframe.llm.shared import with_row

#: Most labelled rows of each class that fitting reads, chosen by the hash of their ids.
SAMPLE = 5000
THRESHOLD = 0.3
#: Words of a clause that are read on either side of a match.
REACH = 12
#: Stems in characters; the fewest toxic documents of a learned one, its least odds (of classes of one size), and the least product of documents and log odds.
STEM, SUPPORT, ODDS, GAIN = (4, 12), 4, 6.0, 15.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MODAL, BOUNDARY = range(8)

# Closed word lists of the grammar, in English, French, German and Spanish.
LISTS = {
    TARGET: "you your you're youre he she they them him her this that these those everyone people tu toi vous il elle ils du dich ihr er sie euch usted tú ellos ella él".split(),
    NEGATION: "not no never isn aren wasn don doesn didn nobody neither nor ne pas jamais aucun kein keine nicht nie nunca jamás ni".split(),
    REPORT: "said says say wrote writes called quoted quote claimed alleged according reported dit disait écrit sagte sagt schrieb dijo dice escribió".split(),
    MODAL: "will would gonna going shall should must i'll ll werde wird vais voy".split(),
}
SEED_INSULTS = "idiot moron stupid pathetic worthless disgusting loser scum trash clown imbecile dumb".split()
SEED_THREATS = "kill murder hurt destroy strangle stab".split()


class Transducer:
    """States and outputs by symbol: arcs[(state, symbol)] is (next state, output); a missing arc goes to `other`(state) without output."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int]], other: Callable[[int], int]):
        self.arcs, self.other = arcs, other

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol)) or (self.other(state), 0)


def _within(cue: int, reach: int, at: tuple[int, ...], lasting: bool = False) -> Transducer:
    """Says 1 at a symbol of `at` that comes at most `reach` words after `cue`; a boundary forgets the cue, unless it is lasting."""
    arcs = {(s, cue): (reach, 0) for s in range(reach + 1)}
    arcs |= {(s, x): (max(s - 1, 0), int(s > 0)) for s in range(reach + 1) for x in at}
    if not lasting:
        arcs |= {(s, BOUNDARY): (0, 0) for s in range(reach + 1)}
    return Transducer(arcs, lambda s: max(s - 1, 0))


#: What is asked of a match, in the order of the outputs: aimed, negated, reported, intended.
GRAMMAR = (
    _within(TARGET, 4, (INSULT, THREAT)),
    _within(NEGATION, 3, (INSULT, THREAT)),
    _within(REPORT, 8, (INSULT, THREAT), lasting=True),
    _within(MODAL, 2, (THREAT,)),
)


class Composed:
    """The product of transducers, whose arcs are made when first taken."""

    def __init__(self, parts: tuple[Transducer, ...] = GRAMMAR):
        self.parts, self.known = parts, {}

    def run(self, symbols: list[int]) -> list[tuple[int, ...]]:
        state, out = (0,) * len(self.parts), []
        for symbol in symbols:
            key = (state, symbol)
            if key not in self.known:
                steps = [p.step(s, symbol) for p, s in zip(self.parts, state, strict=True)]
                self.known[key] = tuple(s for s, _ in steps), tuple(o for _, o in steps)
            state, said = self.known[key]
            if symbol in (INSULT, THREAT):
                out.append((symbol, *said))
        return out


#: Of a document: whether any clause matches, the heaviest clause, and the clauses; then, in weights, all clauses and those of each kind.
FEATURES = ("matched", "strongest", "clauses", "total", "plain", "aimed", "negated", "reported", "threat", "intended")
_DEFAULT = np.array([-3.0, 1.5, 0.4, 0.3, 0.3, 0.3, 0.5, -0.6, -0.6, 0.3, 0.8])


def _utf8(word: str) -> np.ndarray:
    return np.frombuffer(word.encode(), dtype=np.uint8)


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.concatenate([_utf8(w) for w in words]) if words else np.zeros(0, np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
    return span_hashes(data, np.concatenate(([0], ends[:-1])) if words else ends, ends, BYTE_VALUES)


_BREAKS = byte_class(b".,;:!?\n")


@dataclass
class Grammar:
    """Stems with their symbols and weights, and the logistic weights: first the bias, then FEATURES."""

    stems: dict[str, tuple[int, float]] = field(default_factory=lambda: {**dict.fromkeys(SEED_INSULTS, (INSULT, 4.0)), **dict.fromkeys(SEED_THREATS, (THREAT, 1.0))})
    coef: np.ndarray = field(default_factory=lambda: _DEFAULT.copy())

    def __post_init__(self) -> None:
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in {len(s.encode()) for s in self.stems}:
            own = [s for s in self.stems if len(s.encode()) == length]
            h = _hash_of(own)
            order = np.argsort(h)
            self.by_length[length] = h[order], np.array([self.stems[s][0] for s in own])[order], np.array([self.stems[s][1] for s in own])[order]
        words = [(w, k) for k, ws in LISTS.items() for w in ws]
        h = _hash_of([w for w, _ in words])
        order = np.argsort(h)
        self.closed = h[order], np.array([k for _, k in words])[order]
        self.machine = Composed()

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's symbol, and its weight if it matches a stem."""
        h = words.hashes()
        known, kinds = self.closed
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        symbol = np.where(known[at] == h, kinds[at], OTHER)
        weight = np.zeros(len(h))
        size = words.ends - words.starts
        for length, (stems, kinds, weights) in sorted(self.by_length.items()):
            long = np.flatnonzero(size >= length)
            h = span_hashes(words.data, words.starts[long], words.starts[long] + length, BYTE_VALUES)
            at = np.minimum(np.searchsorted(stems, h), len(stems) - 1)
            ok = stems[at] == h
            symbol[long[ok]], weight[long[ok]] = kinds[at[ok]], weights[at[ok]]
        return symbol, weight

    def features(self, texts: Texts) -> np.ndarray:
        """A row of FEATURES for each text."""
        words = latin_words(texts)
        symbol, weight = self.symbols(words)
        out = np.zeros((len(texts), len(FEATURES)))
        matches = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(matches):
            return out
        breaks = np.concatenate(([0], np.cumsum(_BREAKS[words.data])))
        docs = np.searchsorted(words.first, matches, "right") - 1
        clauses: dict[tuple[int, int], np.ndarray] = {}
        for m, d in zip(matches.tolist(), docs.tolist(), strict=True):
            lo = max(int(words.first[d]), m - REACH)
            seq: list[int] = []
            for i in range(lo, m + 1):
                if i > lo and breaks[words.starts[i]] > breaks[words.ends[i - 1]]:
                    seq.append(BOUNDARY)
                seq.append(int(symbol[i]))
            kind, aimed, negated, reported, intended = self.machine.run(seq)[-1]
            if not aimed:  # whom it is aimed at may come after, in the same clause
                hi = min(int(words.first[d + 1]), m + 4)
                after = [i for i in range(m + 1, hi) if breaks[words.starts[i]] == breaks[words.ends[m]]]
                aimed = int(any(symbol[i] == TARGET for i in after))
            said = weight[m] * np.array([1, not (aimed or negated or reported), aimed, negated, reported, kind == THREAT, intended])
            key = d, int(breaks[words.starts[m]])
            clauses[key] = np.maximum(clauses[key], said) if key in clauses else said
        for (d, _), said in clauses.items():
            row = out[d]
            row[0] = 1
            row[1] = max(row[1], said[0])
            row[2] += 1
            row[3:] += said
        out[:, 2:] = np.log1p(out[:, 2:])
        return out

    def scores(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.features(texts) @ self.coef[1:] + self.coef[0])))


def latin_words(texts: Texts) -> Words:
    """Runs of letters, digits and characters from U+0080 on, with A-Z and the capitals of U+00C0-U+00DE lowered."""
    words = texts.words(NOT_ALNUM)
    data = words.data
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    if len(capital):
        data = data.copy()
        data[capital] += 0x20
    return Words(data, words.starts, words.ends, words.first)


def _stem_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stems of a batch with the toxic and the clean documents that have them, and the toxic ones that have them after a modal word."""
    modal = set(LISTS[MODAL])
    for batch in batches(stream, 1 << 20):
        w = latin_words(Texts(batch.column(1)))
        counts: dict[str, list[int]] = {}
        for toxic, a, b in zip(batch.column(0).to_pylist(), w.first[:-1], w.first[1:], strict=True):
            own = [w.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)]
            stems = lambda words: {x[:n] for x in words for n in range(STEM[0], min(len(x), STEM[1]) + 1)}
            intended = stems({x for i, x in enumerate(own) if modal.intersection(own[max(0, i - 2) : i])}) if toxic else set()
            for stem in stems(set(own)):
                n = counts.setdefault(stem, [0, 0, 0])
                n[0 if toxic else 1] += 1
                n[2] += stem in intended
        yield pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array([n[i] for n in counts.values()], pa.int64()) for i in range(3))], names=["stem", "toxic", "clean", "intended"])


def learned_stems(sampled: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[int, float]]:
    """Stems of toxic documents (columns toxic and text), with their kinds and weights; of a stem and a longer one in just the same documents, the longer."""
    counts = sampled.mapInArrow(_stem_counts, "stem string, toxic long, clean long, intended long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "intended")))
    odds = (F.col("toxic") + 0.01) / (F.col("clean") + 0.5) * F.lit(n_clean / n_toxic)
    found = counts.where(F.col("toxic") >= SUPPORT).withColumn("odds", odds).where((F.col("odds") > ODDS) & (F.col("toxic") * F.log("odds") >= GAIN)).collect()  # of the sample's toxic documents
    same = {(r.stem[:-1], r.toxic, r.clean) for r in found}
    return {r.stem: (THREAT if 2 * r.intended > r.toxic else INSULT, float(min(8, np.log(r.odds)))) for r in sorted(found, key=lambda r: r.stem) if (r.stem, r.toxic, r.clean) not in same}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.01] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Grammar:
    """A grammar learned from the labels of ids that are not held out; the seed grammar if no class or only one has any."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_toxic")).where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1)).where(~held_out("_id"))
    counts = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Grammar()
    share = {k: min(1.0, SAMPLE / n) for k, n in counts.items()}
    at = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    sample = rows.where(F.when(F.col("_toxic") == 1, at < int(share[1] * 1e6)).otherwise(at < int(share[0] * 1e6))).dropDuplicates(["_id"])
    sample = sample.withColumn("_weight", F.when(F.col("_toxic") == 1, 1 / share[1]).otherwise(1 / share[0]))
    sampled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id").select("_toxic", "_weight", "text")  # some 2 * SAMPLE ids
    grammar = Grammar()
    size = {k: max(1.0, n * share[k]) for k, n in counts.items()}
    grammar = Grammar({**grammar.stems, **learned_stems(sampled.select(F.col("_toxic").alias("toxic"), "text"), size[1], size[0])})

    def described(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1 << 20):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(grammar.features(Texts(batch.column(2)))), pa.list_(pa.float64()))], names=["toxic", "weight", "x"])

    got = sampled.mapInArrow(described, "toxic int, weight double, x array<double>").toArrow()
    if not got.num_rows:
        return grammar
    x = np.array(got["x"].to_pylist()).reshape(got.num_rows, len(FEATURES))
    grammar.coef = fit_logistic(x, got["toxic"].to_numpy().astype(float), got["weight"].to_numpy())
    return grammar


def scored(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """A struct `row` of each document's columns, and its `score` from 0 to 1.

    Every whole text is scored. Null and empty texts have no match, and so the score of a text without any.
    Repeated rows are scored alike; an empty table gives none; other columns are never read, and may have any name.
    """

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1 << 20):
            yield pa.record_batch([batch.column(0), pa.array(grammar.scores(Texts(batch.column(1))))], names=["row", "score"])

    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, with_row(rows.schema["row"].dataType, "score double"))
