"""Scoring texts with a hashed maximum-entropy language model.

The softmax is factored by classes: a word's probability is that of its class, given what stands before it,
times that of the word in its class. Classes come from the company words keep: frequent words, and the last
bytes of the others, are clustered by the most frequent words next to them. A first model is log-linear
over hashed n-gram and skip features of the three classes before, with the words of a class by their smoothed
relative frequencies. On top of it, both factors have weights of hashed n-grams and skips of the words before:
one table for the classes, one for the outcomes inside a class. These are its frequent words and the rest of
it, whose words keep their shares of the rest. So the probabilities of all words sum to one.

Gradients are summed over the partitions: of class contexts for the first model, of tokens for the word
weights, whose every update reads another part of the documents, so that all tokens take part once. A step
is the observed count of a feature with an outcome less that of outcomes drawn from the model, in units of
the larger of them.

All counts cover all training texts. Only bounded tables are sent to the executors: the most frequent words,
the classes, and the class model. Counts of all other words stay distributed; words of a text that are not
among the most frequent ones meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.textbytes import frugal, mix, prefix_hashes, span_hashes, text_blocks, words
from tidecast.session import stage

#: Words whose counts are sent to the executors.
COMMON = 1 << 18
#: Frequent words that have a class of their own choice; the others go by their last bytes.
NAMED = 4096
ENDING_BYTES, ENDINGS = 3, 2048
#: Frequent words whose company makes the classes.
NEIGHBOURS = 32
#: Classes; 0 is the end of a text.
CLASSES = 32
#: Rows of the hashed feature table, and the updates of it.
FEATURES = 4096
UPDATES = 20
RATE = 0.5
#: Outcomes inside a class: its most frequent named words, and last the rest.
OUTCOMES = 64
#: Rows of the word tables: as many as a power of two and a quarter of the distinct words, within these bounds.
#: So what is sent to the executors is 6 MB at most.
WORD_ROWS = (1 << 10, 1 << 14)
#: Parts of the documents, each for one update of the word weights, the length of a step, and the count that
#: is added to those of a feature with an outcome: what was seen rarely moves little.
PARTS, PACE, CAUTION = 8, 0.5, 4.0
#: Tokens that are computed at once, and ranges of rows by which gradients are added up.
CHUNK, RANGES = 8192, 16
#: The unit of a text's end, and of what stands before its start.
END = NAMED + ENDINGS
#: Leading bits by which a word's place among the common ones is looked up.
LEADING = 18
#: Log share of an outcome that a class does not have.
NEVER = -60.0
#: Words of a class that are added to every count, as in the base score.
ADDED = 0.5


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, hash of its ending, and the texts' first words."""
    starts, ends, first = words(data, offsets)
    prefix = prefix_hashes(data, lower=True)
    ending = span_hashes(prefix, np.maximum(starts, ends - ENDING_BYTES), ends) % np.uint64(ENDINGS)
    return span_hashes(prefix, starts, ends), ending.astype(np.int64), first


@dataclass
class Lexicon:
    """What words are known by: sorted hashes of the common words, their counts and their ranks."""

    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray

    @cached_property
    def heads(self) -> np.ndarray:
        """The first place of every run of hashes that begin with the same bits."""
        return np.searchsorted(self.hashes, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of every word among the common ones, or -1."""
        if not self.hashes.size:
            return np.full(hashes.size, -1, dtype=np.int64)
        last = self.hashes.size - 1
        at = np.minimum(self.heads[(hashes >> np.uint64(64 - LEADING)).view(np.int64)], last)
        # Hashes are spread evenly, so few steps lead from the head of a run to a word's place.
        before = np.flatnonzero(self.hashes[at] < hashes)
        while before.size:
            before = before[at[before] < last]
            at[before] += 1
            before = before[self.hashes[at[before]] < hashes[before]]
        return np.where(self.hashes[at] == hashes, at, -1)

    def unit(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """What a word's class is chosen for: the word itself or its ending."""
        return self.unit_at(self.find(hashes), ending)

    def unit_at(self, at: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """The units of words whose places are known."""
        rank = np.where(at >= 0, self.ranks[at] if self.ranks.size else 0, NAMED)
        return np.where(rank < NAMED, rank, NAMED + ending)


@dataclass
class Tables:
    """The class of every unit, its outcome there, and the weights of both factors."""

    classes: np.ndarray
    outcomes: np.ndarray
    log_class: np.ndarray  # log probability of a class (columns) after a context of classes (rows)
    log_inner: np.ndarray  # log share of an outcome (columns) in a class (rows)
    class_words: np.ndarray  # weights of classes (columns) by hashed words before (rows)
    inner_words: np.ndarray  # weights of outcomes (columns) by hashed words before and class (rows)

    def chunks(self, units: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """For some tokens at a time: place, class, outcome, and rows and logits of both factors.

        Logits need no shift before they are raised: shares are at most one, and a weight moves by ``PACE`` a part.
        """
        line, at = _sequence(units, first)
        classes = self.classes[line]
        for begin in range(0, at.size, CHUNK):
            some = at[begin : begin + CHUNK]
            before = (classes[some - 1] * CLASSES + classes[some - 2]) * CLASSES + classes[some - 3]
            label, outcome = classes[some], self.outcomes[line[some]]
            by_class, inner = self.log_class.take(before, axis=0), self.log_inner.take(label, axis=0)
            class_rows, inner_rows = [], []
            for words in _word_features(line, some):
                class_rows.append(_rows(words, len(self.class_words)))
                inner_rows.append(_rows(words + label.astype(np.uint64) + np.uint64(1), len(self.inner_words)))
                by_class += self.class_words.take(class_rows[-1], axis=0)
                inner += self.inner_words.take(inner_rows[-1], axis=0)
            yield begin, label, outcome, class_rows, by_class, inner_rows, inner

    def scores(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log10 probability of the class and outcome of every token, ends included."""
        found = np.zeros(units.size + first.size - 1)
        for begin, label, outcome, _, by_class, _, inner in self.chunks(units, first):
            each = np.arange(label.size)
            own = by_class[each, label].astype(np.float64) + inner[each, outcome]
            found[begin : begin + label.size] = own - np.log(_sums(np.exp(by_class)) * _sums(np.exp(inner)).astype(np.float64))
        return found / np.log(10)


@dataclass
class Model:
    lexicon: Lexicon
    tables: Tables
    log_rest: np.ndarray  # log10 of the smoothed total of every class without its outcomes of their own
    tokens: int  # in training, ends included
    types: int
    texts: int

    @property
    def base_total(self) -> float:
        return float(np.log10(self.tokens + ADDED * (self.types + 1)))


def learnt_from(doc_id: Column, folds: int = 5, held_out: int = 1) -> Column:
    """Whether a document is for training; one with a null id is not."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(remainder != held_out, F.lit(False))


def _text_parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, offsets in text_blocks(column):
        yield data, offsets


def _over_blocks(texts: DataFrame, schema: str, gather, finish, blocks=_text_parts) -> DataFrame:
    """Run ``gather(state, values, firsts)`` over a partition's blocks and return ``finish(state)``'s columns."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for values, firsts in blocks(batch.column(0)):
                gather(state, values, firsts)
        for columns in finish(state):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return texts.mapInArrow(run, schema)


def _count_table(texts: DataFrame) -> DataFrame:
    """``word, ending, n`` of all training texts; blocks are added up before they leave their task."""
    names = ["word", "ending", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0), limit=1 << 21):
                hashes, ending, _ = _block_words(data, offsets)
                order = np.argsort(hashes)
                new = np.ones(hashes.size, dtype=bool)
                new[1:] = hashes[order[1:]] != hashes[order[:-1]]
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, hashes.size))
                some = order[at]
                columns = [hashes[some].view(np.int64), ending[some], n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    rows = texts.mapInArrow(run, "word long, ending long, n long")
    return rows.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def _lexicon(counts: DataFrame) -> Lexicon:
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).select("word", "n").toArrow()
    hashes, n = (top.column(c).to_numpy() for c in ("word", "n"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    ranks = np.lexsort((hashes, -n))
    place = np.empty(hashes.size, dtype=np.int64)
    place[ranks] = np.arange(hashes.size)
    return Lexicon(hashes[order], n[order], place[order])


def _cells(texts: DataFrame, size: int, gather, blocks=_text_parts) -> DataFrame:
    """``cell, n``: sums over all texts of the cells that ``gather(values, firsts)`` lists for a block."""

    def collect(state, values, firsts):
        cells = gather(values, firsts)
        state["n"] = state.get("n", 0) + np.bincount(cells, minlength=size)

    def finish(state):
        if "n" in state:
            at = np.flatnonzero(state["n"])
            yield at, state["n"][at].astype(np.int64)

    return _over_blocks(texts, "cell long, n long", collect, finish, blocks).groupBy("cell").agg(F.sum("n").alias("n"))


def _classes(sequences: DataFrame) -> np.ndarray:
    """The class of every unit of ``units``, by k-means on the square roots of its neighbours' shares."""
    units, width = NAMED + ENDINGS, 2 * NEIGHBOURS

    def gather(unit, first):
        if not unit.size:
            return np.zeros(0, np.int64)
        same = np.ones(unit.size, dtype=bool)
        same[first[:-1][first[:-1] < first[1:]]] = False  # a text's first word has no left neighbour
        left = np.flatnonzero(same[1:] & (unit[:-1] < NEIGHBOURS)) + 1
        right = np.flatnonzero(same[1:] & (unit[1:] < NEIGHBOURS))
        return np.concatenate([unit[left] * width + unit[left - 1], unit[right] * width + NEIGHBOURS + unit[right + 1]])

    got = _cells(sequences, units * width, gather, _unit_blocks).toArrow()
    table = np.zeros(units * width)
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return _cluster(table.reshape(units, width), CLASSES - 1) + 1


def _cluster(table: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """k-means of the rows' shares, weighted by their totals; starts spread out from the heaviest row."""
    total = table.sum(axis=1)
    points = np.sqrt(table / np.maximum(total, 1)[:, None])
    weight = np.sqrt(total)
    centres, away = points[[int(np.argmax(total))]], np.full(total.size, np.inf)
    for _ in range(k - 1):
        away = np.minimum(away, ((points - centres[-1]) ** 2).sum(axis=1))
        centres = np.vstack([centres, points[int(np.argmax(away * weight))]])
    for _ in range(rounds):
        label = ((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
        for c in range(k):
            mine = label == c
            if weight[mine].sum() > 0:
                centres[c] = (points[mine] * weight[mine, None]).sum(axis=0) / weight[mine].sum()
    return label


def _sequence(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row with three ends before each and one after it, and the places of their tokens."""
    texts = first.size - 1
    of = np.repeat(np.arange(texts), np.diff(first))
    line = np.full(units.size + 4 * texts, END, dtype=np.int64)
    place = np.arange(units.size) + 4 * of + 3
    line[place] = units
    return line, np.sort(np.concatenate([place, first[1:] + 4 * np.arange(texts) + 3]))


def _word_features(line: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word before, the one before that, and both: n-grams and a skip."""
    one, two = line[at - 1].astype(np.uint64), line[at - 2].astype(np.uint64)
    spread = np.uint64(END + 1)
    kinds = [one, two, one * spread + two]
    return [mix(value + np.uint64((kind + 1) << 44)) for kind, value in enumerate(kinds)]


def _rows(hashes: np.ndarray, rows: int) -> np.ndarray:
    """Rows of a table, whose number is a power of two."""
    return (mix(hashes) & np.uint64(rows - 1)).view(np.int64)


def _features(context: np.ndarray) -> np.ndarray:
    """Rows of the feature table for a context: n-grams and skips of the classes before."""
    one, two, three = context // CLASSES**2, context // CLASSES % CLASSES, context % CLASSES
    kinds = [0 * one, one, one * CLASSES + two, two, three, one * CLASSES + three]
    salted = [mix((np.uint64(kind << 40) + value.astype(np.uint64)) + np.uint64(1)) for kind, value in enumerate(kinds)]
    return np.stack([h % np.uint64(FEATURES) for h in salted], axis=1).astype(np.int64)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _sums(table: np.ndarray) -> np.ndarray:
    """Sum of every row."""
    return table @ np.ones(table.shape[1], table.dtype)


def _drawn(logits: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of every row by the row's probabilities."""
    total = np.cumsum(np.exp(logits), axis=1)
    mark = rng.random(len(total), dtype=np.float32) * total[:, -1]
    return np.minimum(_sums((total <= mark[:, None]).astype(np.float32)).astype(np.int64), total.shape[1] - 1)


def _fit_words(sequences: DataFrame, tables: Tables) -> Tables:
    """The tables with word weights fitted to ``part, units``, the units of the training texts.

    What is expected of a token is one outcome drawn by its probabilities, which is right on average and
    costs a tenth of adding them all. Observed and expected counts are added up by ranges of rows in the executors; the driver gets one table.
    """
    spark = sequences.sparkSession
    rows, width = len(tables.class_words), CLASSES + OUTCOMES
    span = rows // RANGES
    for part in range(PARTS):
        sent = spark.sparkContext.broadcast(tables)

        def count(batches: Iterator[pa.RecordBatch], sent=sent, part=part) -> Iterator[pa.RecordBatch]:
            now = sent.value
            observed, expected = (np.zeros(rows * width, dtype=np.float32) for _ in range(2))
            context, one = TaskContext.get(), np.float32(1)
            rng = np.random.default_rng([part, context.partitionId() if context else 0])
            for batch in batches:
                sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
                units = batch.column(0).flatten().to_numpy().astype(np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                for _, label, outcome, class_rows, by_class, inner_rows, inner in now.chunks(units, first):
                    drawn, drawn_inner = _drawn(by_class, rng), CLASSES + _drawn(inner, rng)
                    for r, q in zip(class_rows, inner_rows):
                        r, q = r * width, q * width
                        np.add.at(observed, np.concatenate([r + label, q + CLASSES + outcome]), one)
                        np.add.at(expected, np.concatenate([r + drawn, q + drawn_inner]), one)
            for k in range(RANGES):
                mine = slice(k * span * width, (k + 1) * span * width)
                if expected[mine].any():
                    both = np.stack([observed[mine], expected[mine]]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([both], pa.binary())], names=["range", "counts"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, both in zip(batch.column(0).to_pylist(), batch.column(1)):
                    counts = np.frombuffer(both.as_buffer(), dtype=np.float32).astype(np.float64)
                    totals[k] = totals[k] + counts if k in totals else counts
            for k, counts in totals.items():
                observed, expected = counts.reshape(2, span, width)
                step = PACE * (observed - expected) / (np.maximum(observed, expected) + CAUTION)
                step = step.astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([step], pa.binary())], names=["range", "step"])

        counted = sequences.filter(F.col("part") == part).select("units").mapInArrow(frugal(count), "range long, counts binary")
        steps = counted.repartition(RANGES, "range").mapInArrow(frugal(add_up), "range long, step binary").toArrow()
        moved = np.zeros((rows, width), dtype=np.float32)
        for k, step in zip(steps.column("range").to_pylist(), steps.column("step").to_pylist()):
            moved[k * span : (k + 1) * span] = np.frombuffer(step, dtype=np.float32).reshape(span, width)
        tables = replace(
            tables, class_words=tables.class_words + moved[:, :CLASSES], inner_words=tables.inner_words + moved[:, CLASSES:]
        )
        sent.unpersist()
    return tables


def _fit_classes(contexts: DataFrame) -> np.ndarray:
    """Weights of the class model from ``context, seen``, the counts of the classes after a context.

    Every update sums the gradient of all contexts over their partitions; steps follow its running moments.
    """
    spark = contexts.sparkSession
    weights = np.zeros((FEATURES, CLASSES))
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for turn in range(1, UPDATES + 1):
        sent = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            slope, total = np.zeros((FEATURES, CLASSES)), 0
            for batch in batches:
                rows = _features(batch.column(0).to_numpy())
                seen = np.zeros((batch.num_rows, CLASSES))
                pairs, sizes = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                label, n = (pairs.field(name).to_numpy() for name in ("label", "n"))
                seen[np.repeat(np.arange(batch.num_rows), sizes), label] = n
                expected = np.exp(_log_softmax(sent.value[rows].sum(axis=1)))
                rest = seen - seen.sum(axis=1, keepdims=True) * expected
                for k in range(rows.shape[1]):
                    cells = rows[:, k, None] * CLASSES + np.arange(CLASSES)
                    slope += np.bincount(cells.ravel(), rest.ravel(), slope.size).reshape(slope.shape)
                total += seen.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array([slope.tobytes()], pa.binary()), pa.array([float(total)])], names=["slope", "n"]
            )

        parts = contexts.mapInArrow(gradient, "slope binary, n double").toArrow()
        total = sum(parts.column("n").to_pylist())
        if not total:
            break
        slopes = (np.frombuffer(x, dtype=np.float64) for x in parts.column("slope").to_pylist())
        slope = sum(slopes).reshape(weights.shape) / total
        mean, spread = 0.8 * mean + 0.2 * slope, 0.95 * spread + 0.05 * slope**2
        step = mean / (1 - 0.8**turn) / (np.sqrt(spread / (1 - 0.95**turn)) + 1e-7)
        weights = weights + RATE / np.sqrt(turn) * step
        sent.unpersist()
    return weights


def _unit_table(known: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``part, units``: the units of the words of every text of ``text, part``."""
    sent = known.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_blocks(batch.column(0)):
                hashes, ending, first = _block_words(data, offsets)
                units = pa.array(sent.value.unit(hashes, ending).astype(np.int16))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), units)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(begin, first.size - 1), lists], names=["part", "units"])

    return known.mapInArrow(frugal(run), "part int, units array<short>")


def _unit_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The units of all texts of a batch, and the texts' first ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    yield column.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _outcomes(counts: DataFrame, lexicon: Lexicon, classes: np.ndarray, n_texts: int) -> tuple:
    """Outcome of every unit, log shares of the outcomes of a class, and log10 totals of their rests."""
    named = int((lexicon.ranks < NAMED).sum())
    outcomes = np.full(END + 1, OUTCOMES - 1, dtype=np.int64)
    order = np.argsort(classes[:named], kind="stable")
    head = np.searchsorted(classes[:named][order], np.arange(CLASSES))
    place = np.arange(named) - head[classes[:named][order]]
    outcomes[order] = np.minimum(place, OUTCOMES - 1)
    outcomes[END] = 0
    by_rank = np.zeros(lexicon.ranks.size)
    by_rank[lexicon.ranks] = lexicon.counts
    own = outcomes[:named] < OUTCOMES - 1

    # What has no outcome of its own: named words beyond the first ones of their class, and all other words.
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    spark = counts.sparkSession
    words = np.sort(lexicon.hashes[lexicon.ranks < NAMED].view(np.int64)).tolist()
    known = spark.createDataFrame([(w,) for w in words], "word long")
    tail = counts.join(F.broadcast(known), "word", "left_anti")
    by_ending = tail.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    label = classes[NAMED + by_ending.column("ending").to_numpy()]
    np.add.at(total, label, by_ending.column("n").to_numpy())
    np.add.at(types, label, by_ending.column("types").to_numpy())
    np.add.at(total, classes[:named][~own], by_rank[:named][~own])
    np.add.at(types, classes[:named][~own], 1)
    rest = total + ADDED * (types + 1)

    inner = np.zeros((CLASSES, OUTCOMES))
    inner[classes[:named][own], outcomes[:named][own]] = by_rank[:named][own] + ADDED
    inner[:, -1] = rest
    inner[0] = 0
    inner[0, 0] = n_texts + ADDED  # the end is alone in its class
    with np.errstate(divide="ignore"):
        log_inner = np.maximum(np.log(inner / inner.sum(axis=1, keepdims=True)), NEVER)
    return outcomes, log_inner, np.log10(rest)


def train(documents: DataFrame, learnt: Column) -> tuple[Model, DataFrame]:
    """The model of the documents where ``learnt`` holds, and the table ``word, ending, n`` of their words."""
    spark = documents.sparkSession
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PARTS)).cast("int").alias("part")
    known = documents.filter(learnt).select(F.col("text").cast("string").alias("text"), part)
    texts = known.select("text")
    counts = stage(_count_table(texts))
    n_texts = texts.count()
    n_words, n_types = counts.agg(F.sum("n"), F.count("*")).head()
    lexicon = _lexicon(counts)
    sequences = stage(_unit_table(known, lexicon))
    classes = np.append(_classes(sequences.select("units")), 0)
    sent = spark.sparkContext.broadcast(classes)

    def gather(units, first):
        line, at = _sequence(units, first)
        of = sent.value[line]
        return ((of[at - 1] * CLASSES + of[at - 2]) * CLASSES + of[at - 3]) * CLASSES + of[at]

    cells = _cells(sequences.select("units"), CLASSES**4, gather, _unit_blocks)
    pair = F.struct((F.col("cell") % CLASSES).alias("label"), "n")
    contexts = cells.groupBy(F.floor(F.col("cell") / CLASSES).alias("context")).agg(F.collect_list(pair).alias("seen"))
    weights = _fit_classes(stage(contexts.coalesce(8)))
    every = np.arange(CLASSES**3)
    log_class = np.concatenate(
        [_log_softmax(weights[_features(some)].sum(axis=1)) for some in np.array_split(every, 16)]
    )

    outcomes, log_inner, log_rest = _outcomes(counts, lexicon, classes, n_texts)
    rows = int(min(max(1 << (int(n_types) // 4).bit_length(), WORD_ROWS[0]), WORD_ROWS[1]))
    tables = Tables(
        classes,
        outcomes,
        log_class.astype(np.float32),
        log_inner.astype(np.float32),
        np.zeros((rows, CLASSES), np.float32),
        np.zeros((rows, OUTCOMES), np.float32),
    )
    tables = _fit_words(sequences, tables)
    tokens, distinct = int(n_words or 0) + n_texts, int(n_types) + (n_texts > 0)
    return Model(lexicon, tables, log_rest, tokens, distinct, n_texts), counts


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row of ``documents(doc_id, text)``.

    A null or empty text is its end alone. Scores are log10 probabilities: of the smoothed frequencies of
    words, and of the model. Words without a count have the added count in their class. Repeated rows score
    alike; a null id is returned as it is; other columns are ignored; an empty table gives no row.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    schema = "kind int, row long, doc_id long, word long, n long, known long, base double, score double"
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        log_common = np.log10(m.lexicon.counts + ADDED)
        log_end = np.log10(m.texts + ADDED)
        for batch in batches:
            for begin, end, data, offsets in text_blocks(batch.column(1)):
                hashes, ending, first = _block_words(data, offsets)
                at = m.lexicon.find(hashes)
                units = m.lexicon.unit_at(at, ending)
                label, rest = m.tables.classes[units], m.tables.outcomes[units] == OUTCOMES - 1
                n = np.diff(first) + 1
                texts = n.size
                token_of = np.repeat(np.arange(texts), n)
                total = np.bincount(token_of, m.tables.scores(units, first), texts)
                of = np.repeat(np.arange(texts), np.diff(first))
                common = at >= 0
                known = np.bincount(of[common], minlength=texts) + (m.texts > 0)
                base = np.bincount(of[common], log_common[at[common]], texts) + log_end - n * m.base_total
                # Words without an outcome of their own have their shares of the rest of their class.
                shared = common & rest
                total += np.bincount(of[shared], log_common[at[shared]], texts)
                total -= np.bincount(of[rest], m.log_rest[label[rest]], texts)
                # The other words, once per text, to meet their counts.
                rare = np.flatnonzero(~common)
                order = rare[np.lexsort((hashes[rare], of[rare]))]
                new = np.ones(order.size, dtype=bool)
                new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
                start = np.flatnonzero(new)
                some, times = order[start], np.diff(np.append(start, order.size))
                ids = row + np.arange(texts)
                row += texts
                none, zero = pa.nulls(texts, pa.int64()), np.zeros(some.size)
                columns = [
                    pa.array(np.repeat([0, 1], [texts, some.size]), pa.int32()),
                    pa.array(np.concatenate([ids, ids[of[some]]]), pa.int64()),
                    pa.concat_arrays([batch.column(0).slice(begin, texts), pa.nulls(some.size, pa.int64())]),
                    pa.concat_arrays([none, pa.array(hashes[some].view(np.int64))]),
                    pa.array(np.concatenate([n, times]), pa.int64()),
                    pa.array(np.concatenate([known, zero.astype(np.int64)]), pa.int64()),
                    pa.array(np.concatenate([base, zero])),
                    pa.array(np.concatenate([total, zero])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = stage(rows.mapInArrow(run, schema))
    tail = parts.filter("kind = 1").select("row", "word", F.col("n").alias("times"))
    met = tail.join(counts.select("word", F.col("n").alias("seen")), "word", "left")
    seen = F.coalesce("seen", F.lit(0))
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(seen + ADDED)).alias("more"),
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    whole = parts.filter("kind = 0").drop("kind", "word").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
