"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, read, release, thinned

SPACE = "▁"
VOCABULARY = "piece_bpe_32k.model"
WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the fitting sample: documents of a language, code points of a document (longer ones are represented by some
#: of their parts) and languages (those with most documents are learnt).
MAX_DOCS, MAX_CHARS, MAX_LANGUAGES = 250, 8_000, 500
PART = r"\S*+\s++|\S{1,200}+"
FOLDS, HELD_OUT = 4, 2
SMOOTHING = 0.02
UNKNOWN = "und"


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of the public vocabulary that consist of letters (after a word's beginning)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p.lower() for p in pieces if WORD.fullmatch(p.lstrip(SPACE)) and p.count(SPACE) <= 1})


def lattice(automaton: ahocorasick.Automaton, word: str) -> list[tuple[int, int, str]]:
    """(start, end, piece) of all pieces in a word, by end; single characters are always pieces."""
    arcs, seen = [], -1
    for end, piece in automaton.iter(word):
        for i in range(seen + 1, end + 1):
            arcs.append((i, i + 1, word[i]))
        seen = max(seen, end)
        if len(piece) > 1:
            arcs.append((end + 1 - len(piece), end + 1, piece))
    arcs += [(i, i + 1, word[i]) for i in range(seen + 1, len(word))]
    return arcs


def build(pieces: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for p in pieces:
        automaton.add_word(p, p)
    automaton.make_automaton()
    return automaton


def expected(words: Counter, automaton: ahocorasick.Automaton, p: dict[str, float], floor: float) -> dict[str, float]:
    """How often each piece is expected in the words: forward and backward sums over all segmentations."""
    counts: dict[str, float] = defaultdict(float)
    for word, n in words.items():
        arcs = [(a, b, s, p.get(s, floor)) for a, b, s in lattice(automaton, word)]
        ahead, back = [0.0] * (len(word) + 1), [0.0] * (len(word) + 1)
        ahead[0] = back[-1] = 1.0
        for a, b, _, q in arcs:
            ahead[b] += ahead[a] * q
        total = ahead[-1]
        if total < 1e-290:
            continue  # too long a word to be of use for fitting
        for a, b, _, q in sorted(arcs, key=lambda x: -x[0]):
            back[a] += back[b] * q
        for a, b, s, q in arcs:
            counts[s] += n * ahead[a] * q * back[b] / total
    return counts


class Model:
    """Probabilities of pieces by language. The likelihood of a text is the product over its words of the sum over all
    segmentations of the product of their pieces' probabilities. Every piece of the vocabulary takes part in every
    language; those that a language was not seen to use, and single characters beyond the vocabulary, have its floor.
    """

    #: Words whose likelihoods are kept, and words of a text that are looked up at once.
    KEPT, STEP = 300_000, 100_000

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray, floors: np.ndarray):
        """probabilities: one row for each piece, one column for each language."""
        self.languages, self.pieces, self.floors = languages, pieces, floors
        #: One row for each piece, and a last one for characters that are no pieces.
        self.probabilities = np.vstack([probabilities.reshape(len(pieces), len(floors)), floors.reshape(1, len(floors))])
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i << 8 | len(p))
        if pieces:
            self.automaton.make_automaton()
        least = float(self.probabilities.min()) if languages else 1.0
        #: Words with more characters are done one by one, in steps that can't underflow.
        self.fast = int(250 / max(-math.log10(least), 1.0)) if least > 0 else 0
        self.forget()

    def __reduce__(self):
        return Model, (self.languages, self.pieces, self.probabilities[:-1], self.floors)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.found = np.empty((1024, len(self.languages)))

    def learn(self, words: list[str]) -> None:
        """Adds new words (distinct, not yet known) to the table."""
        n = len(self.place)
        if n + len(words) > len(self.found):
            self.found = np.vstack([self.found[:n], np.empty((max(n, len(words)), len(self.languages)))])
        short = [w for w in words if len(w) < self.fast]
        self.place.update(zip(short, range(n, n + len(short))))
        if short:
            self.found[n : n + len(short)] = self.forward(short)
        for w in words:
            if len(w) >= self.fast:
                self.found[len(self.place)] = self._word(w)
                self.place[w] = len(self.place)

    def forward(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words (rows) by language (columns): the forward algorithm over all words at once.

        The words stand behind one another; sums[k] belongs to the position before the k-th character. Arcs go in the
        order of the place in their word where they end, so all that an arc starts from is summed up before.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2  # the word's beginning, and a line's end behind it
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        text = SPACE + f"\n{SPACE}".join(words) + "\n"
        arcs = np.array([e << 32 | v for e, v in self.automaton.iter(text)], dtype=np.int64).reshape(-1)
        ends, pieces, lengths = (arcs >> 32) + 1, (arcs >> 8) & 0xFFFFFF, arcs & 0xFF
        # characters that are no pieces
        single = np.ones(len(text), dtype=bool)
        single[ends[lengths == 1] - 1] = False
        single[first + sizes - 1] = False
        others = np.nonzero(single)[0] + 1
        ends = np.concatenate([ends, others])
        pieces = np.concatenate([pieces, np.full(len(others), len(self.pieces))])
        starts = ends - np.concatenate([lengths, np.ones(len(others), np.int64)])
        depth = ends - np.repeat(first, sizes)[ends - 1]
        order = np.lexsort((ends, depth))
        ends, starts, pieces, depth = ends[order], starts[order], pieces[order], depth[order]
        sums = np.zeros((len(text) + 1, len(self.languages)))
        sums[first] = 1.0
        new = np.concatenate([[True], ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, bool)
        edges = np.searchsorted(depth, np.arange(1, depth.max(initial=0) + 2))
        for a, b in zip(edges, edges[1:]):
            if a < b:
                at = np.nonzero(new[a:b])[0]
                sums[ends[a + at]] = np.add.reduceat(sums[starts[a:b]] * self.probabilities[pieces[a:b]], at, axis=0)
        return np.log(np.maximum(sums[first + sizes - 1], 5e-324))

    def _word(self, word: str) -> np.ndarray:
        """Log-likelihood of one word of any length in each language, by the forward algorithm."""
        word = SPACE + word
        longest = max(map(len, self.pieces), default=1)
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, v in self.automaton.iter(word) if self.pieces else ():
            at[end].append((v & 0xFF, v >> 8))
        # the sums that pieces can still begin at, lifted by e^scale whenever they get small
        rows, scale = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for end in range(len(word)):
            arcs = at.pop(end, [])
            if not any(length == 1 for length, _ in arcs):
                arcs.append((1, len(self.pieces)))
            rows.append(sum(rows[-length] * self.probabilities[i] for length, i in arcs))
            rows = rows[-longest:]
            if not end % 8:
                top = np.where(rows[-1] > 0, rows[-1], 1.0)
                rows, scale = [r / top for r in rows], scale + np.log(top)
        return scale + np.log(np.maximum(rows[-1], 5e-324))

    def know(self, words: set[str]) -> None:
        """Afterwards the table has all these words."""
        if len(self.place) > self.KEPT:
            self.forget()
        if new := words.difference(self.place):
            self.learn(sorted(new))

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the log-likelihoods of known words by language."""
        return self.found[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def verdict(self, total: np.ndarray | None) -> tuple[str, float]:
        if total is None or not self.languages:
            return UNKNOWN, 0.0
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its posterior, all languages equally likely at first."""
        out: list[tuple[str, float]] = []
        todo: list[list[str]] = []

        def work() -> None:
            self.know(set().union(*todo))  # the new words of all texts at once
            out.extend(self.verdict(self.total(words) if any(map(has_letter, words)) else None) for words in todo)
            todo.clear()

        held = 0
        for text in texts:
            text = (text or "").lower()
            if held > self.STEP or len(text) > 10 * self.STEP:
                work()
                held = 0
            if len(text) <= 10 * self.STEP:
                todo.append(WORD.findall(text))
                held += len(todo[-1])
                continue
            # in steps, as a list of all words takes many times the text's memory
            words, total = (m[0] for m in WORD.finditer(text)), None
            while part := list(itertools.islice(words, self.STEP)):
                self.know(set(part))
                if total is not None or any(map(has_letter, part)):
                    total = self.total(part) + (0.0 if total is None else total)
            out.append(self.verdict(total))
        work()
        return out


def fit(texts: dict[str, list[str]], rounds: int = 3) -> Model:
    """Expectation-maximisation over all segmentations, from equal probabilities, one language at a time."""
    pieces = vocabulary()
    automaton = build(pieces)
    languages = sorted(texts)
    where = {p: i for i, p in enumerate(pieces)}
    fitted, floors = np.empty((len(pieces), len(languages))), np.empty(len(languages))
    for k, language in enumerate(languages):
        words = Counter(SPACE + w for t in texts[language] for w in WORD.findall(t.lower()))
        p, floor = {}, 1 / len(pieces)
        for _ in range(rounds):
            counts = expected(words, automaton, p, floor)
            total = sum(counts.values()) + SMOOTHING * len(pieces)
            floor = SMOOTHING / total
            p = {s: (c + SMOOTHING) / total for s, c in counts.items() if c > 1e-4}
        floors[k] = floor
        fitted[:, k] = floor
        known = [(where[s], q) for s, q in p.items() if s in where]
        fitted[[i for i, _ in known], k] = [q for _, q in known]
    return Model(languages, pieces, fitted, floors)


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """At most MAX_DOCS texts of each language outside the held-out fold, chosen by a hash of doc_id.

    Longer texts than MAX_CHARS code points are represented by some of their words, from all over the text. If there
    are more than MAX_LANGUAGES values of lang, the most frequent ones are learnt (of equal counts the first by name).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    steps = 1 << 20
    # somewhat more than is wanted of each language, then the first ones by hash
    share = [x for r in counts for x in (F.lit(r["lang"]), F.lit(min(steps, math.ceil(steps * 1.3 * MAX_DOCS / r["count"]))))]
    draw = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("text"))
    taken = rows.filter("text is not null").withColumn("draw", draw)
    taken = taken.filter(F.pmod(F.col("draw"), F.lit(steps)) < F.coalesce(F.element_at(F.create_map(*share), F.col("lang")), F.lit(0)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    taken = taken.withColumn("place", first).filter(F.col("place") <= MAX_DOCS)
    found = defaultdict(list)
    chosen = taken.select("lang", "place", thinned(F.col("text"), MAX_CHARS, PART).alias("text")).collect()
    for r in sorted(chosen, key=lambda r: (r["lang"], r["place"])):
        found[r["lang"]].append(r["text"])
    return dict(found)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    score is the posterior of lang_pred among the learned languages, all equally likely at first. A null text or one
    without letters gets `und` and score 0; so does every text if no language was learned. Of equal likelihoods the
    first language by name wins. Whole texts are read, however long; equal texts get equal results, and rows that repeat or
    have no id stay. An empty table has no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # probabilities of pieces of a fixed vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.predict(batch.column(1).to_pylist())
            names, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document: doc_id, held_out, lang_pred, score."""
    docs = read(spark, sf_dir, "documents")
    model = fit(sample(docs))
    release()
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
