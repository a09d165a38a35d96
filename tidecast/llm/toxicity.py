"""Toxic spans and documents by a linear-chain conditional random field.

Documents carry labels, tokens do not. Tokens of a bounded sample of labelled documents are labelled first:
a word, or the first bytes of one, that occurs significantly more often in toxic documents marks its token
there as toxic. A two-state chain over hashed features of the token and its neighbours is fitted to these
labels; forward-backward gives each token's probability. A document's score is a logistic function of the
expected number of toxic tokens and of the largest probability, fitted to the document labels.

Only the text enters a score. The model has a fixed size, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.meeting import fresh_name
from tidecast.llm.textbytes import SMALL_BLOCK, frugal, mix, prefix_hashes, span_hashes, text_blocks, words

#: Most labelled documents of each class, and most bytes of their texts, that the model is fitted on.
SAMPLE_DOCUMENTS = 3000
SAMPLE_BYTES = 4_000_000
#: Bytes from which a text takes part in the fit by windows spread over it, and their number.
LONG_BYTES, WINDOWS = SAMPLE_BYTES // 128, 16
#: Weights of the hashed features.
FEATURE_BITS = 18
#: Bytes of the word starts that are features.
STARTS = (4, 5, 6, 7)
#: Likelihood ratio from which a word or word start marks toxic tokens.
SIGNIFICANT = 24.0
#: A marking feature occurs at least this many times more often in toxic documents.
TIMES = 8.0
ROUNDS = 60
PENALTY = 2e-6
#: Probability from which a token is part of a span.
SPAN = 0.5

_CODES = np.arange(256)
#: Words are runs of ASCII letters and digits and of all bytes of other characters.
_APART = ~(
    ((_CODES >= 48) & (_CODES <= 57))
    | ((_CODES >= 65) & (_CODES <= 90))
    | ((_CODES >= 97) & (_CODES <= 122))
    | (_CODES >= 128)
)


@dataclass
class Model:
    weights: np.ndarray  # of the features, for the toxic state against the other
    bias: float
    transitions: np.ndarray  # 2 x 2, rows sum to one
    start: np.ndarray  # probabilities of the first state
    scale: np.ndarray  # of a document's intercept, log expected tokens and largest probability


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, and the total
    own: np.ndarray  # hashes of the word and its starts, tokens x kinds
    before: np.ndarray  # hash of the word before


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, first = words(data, offsets, _APART)
    prefix = prefix_hashes(data, lower=True)
    whole = span_hashes(prefix, starts, ends)
    kinds = [whole]
    for size in STARTS:
        short = span_hashes(prefix, starts, np.minimum(starts + size, ends))
        # A word that is no longer than this has no such start: its whole stands for it.
        kinds.append(np.where(ends - starts > size, mix(short + np.uint64(size)), whole))
    before = np.zeros_like(whole)
    before[1:] = whole[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = 0
    return Tokens(starts, ends, first, np.stack(kinds, axis=1), before)


def _features(found: Tokens) -> np.ndarray:
    """Indices of the weights of every token: its own, and those of the words around it."""
    after = np.zeros_like(found.before)
    whole = found.own[:, 0]
    if whole.size:
        after[:-1] = whole[1:]
        after[found.first[1:][found.first[:-1] < found.first[1:]] - 1] = 0
    salted = [found.own[:, k] for k in range(found.own.shape[1])]
    salted += [mix(found.before + np.uint64(101)), mix(after + np.uint64(211))]
    return np.stack([h >> np.uint64(64 - FEATURE_BITS) for h in salted], axis=1).astype(np.int32)


def forward_backward(
    ratio: np.ndarray, new: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state at every token, and the expected transitions.

    ``ratio`` is the toxic state's factor at a token against the other's, ``new`` marks first tokens of
    texts. The whole run of tokens is cut into about as many pieces as they are long; all pieces advance
    together, and their 2 x 2 products carry the state from one to the next.
    """
    n = ratio.size
    if n == 0:
        return np.zeros(0), np.zeros((2, 2))
    long = max(1, int(np.sqrt(n)))
    many = -(-n // long)
    x, b = np.ones(long * many), np.ones(long * many, dtype=bool)
    x[:n], b[:n] = ratio, new
    x, b = x.reshape(many, long).T.copy(), b.reshape(many, long).T.copy()
    step = np.empty((long, 2, 2, many))
    for i in range(2):
        step[:, i, 0] = np.where(b, start[0], transitions[i, 0])
        step[:, i, 1] = np.where(b, start[1], transitions[i, 1]) * x
    product = np.zeros((2, 2, many))
    product[0, 0] = product[1, 1] = 1.0
    for s in step:
        product = np.stack([product[:, 0] * s[0, 0] + product[:, 1] * s[1, 0], product[:, 0] * s[0, 1] + product[:, 1] * s[1, 1]], axis=1)
        product /= product.sum(axis=(0, 1))
    head, tail = np.empty((2, many)), np.empty((2, many))
    state = np.array([0.5, 0.5])
    for k in range(many):
        head[:, k] = state
        state = state @ product[:, :, k]
        state /= state.sum()
    state = np.array([0.5, 0.5])
    for k in range(many - 1, -1, -1):
        tail[:, k] = state
        state = product[:, :, k] @ state
        state /= state.sum()
    alpha = np.empty((long, 2, many))
    at = head
    for l, s in enumerate(step):
        at = at[0] * s[0] + at[1] * s[1]
        at = at / at.sum(axis=0)
        alpha[l] = at
    toxic = np.empty((long, many))
    expected = np.zeros((2, 2))
    beta = tail
    for l in range(long - 1, -1, -1):
        joint = alpha[l] * beta
        toxic[l] = joint[1] / joint.sum(axis=0)
        s = step[l]
        if pairs:
            previous = alpha[l - 1] if l else head
            both = previous[:, None] * s * beta[None]
            both = both / both.sum(axis=(0, 1))
            expected += np.where(b[l], 0.0, both).sum(axis=2)
        beta = s[:, 0] * beta[0] + s[:, 1] * beta[1]
        beta = beta / beta.sum(axis=0)
    return toxic.T.reshape(-1)[:n], expected


def _new(first: np.ndarray) -> np.ndarray:
    marks = np.zeros(int(first[-1]), dtype=bool)
    marks[first[:-1][first[:-1] < first[1:]]] = True
    return marks


def _probabilities(model: Model, found: Tokens) -> np.ndarray:
    score = model.bias + model.weights[_features(found)].sum(axis=1)
    return forward_backward(np.exp(np.clip(score, -30, 30)), _new(found.first), model.transitions, model.start)[0]


def _summary(toxic: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Intercept, log expected toxic tokens and largest probability of every text."""
    total = np.concatenate([[0.0], np.cumsum(toxic)])
    expected = np.maximum(total[first[1:]] - total[first[:-1]], 0.0)
    most = np.zeros(first.size - 1)
    filled = first[:-1] < first[1:]
    if filled.any():
        most[filled] = np.maximum.reduceat(toxic, first[:-1][filled])
    return np.stack([np.ones_like(expected), np.log1p(expected), most], axis=1)


def sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most ``SAMPLE_DOCUMENTS`` labelled documents of each class.

    Those with the smallest hash of their id are taken as long as their class fits into half of
    ``SAMPLE_BYTES``. A text beyond ``LONG_BYTES`` is taken by windows of about so many bytes in all, evenly
    spread from its start to its end, so that a few long texts do not end the sample; others are whole.
    Documents whose id has contradictory labels are left out.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    known = known.filter("toxic = other").select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    classes = [known.filter(F.col("toxic") == y).orderBy(*order).limit(SAMPLE_DOCUMENTS) for y in (0, 1)]
    # At most twice SAMPLE_DOCUMENTS ids, so the texts stay where they are.
    ids = F.broadcast(classes[0].unionByName(classes[1]))
    rows = documents.select("doc_id", "text").join(ids, "doc_id").filter(F.length("text") > 0)
    long = F.octet_length("text") > LONG_BYTES
    width = F.floor(F.length("text") * (LONG_BYTES / WINDOWS) / F.octet_length("text")).cast("int")
    step = (F.length("text") - width) / (WINDOWS - 1)
    places = F.array(*(F.lit(i) for i in range(WINDOWS)))
    windows = F.transform(places, lambda i: F.substring("text", F.floor(i * step).cast("int") + 1, width))
    rows = rows.withColumn("text", F.when(long, F.array_join(windows, "\n")).otherwise(F.col("text")))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(*order, "text"))
    return rows.withColumn("bytes", so_far).filter(F.col("bytes") <= SAMPLE_BYTES // 2).select("text", "toxic")


def _marking(found: Tokens, toxic_token: np.ndarray) -> np.ndarray:
    """Which tokens have a word or word start that is significant for toxic documents.

    Occurrences count once per word before them, so that copies of a document do not count as evidence.
    """
    marked = np.zeros(toxic_token.size, dtype=bool)
    for kind in range(found.own.shape[1]):
        key = found.own[:, kind]
        seen = mix(key + mix(found.before + np.uint64(7))) ^ toxic_token.astype(np.uint64)
        _, once = np.unique(seen, return_index=True)
        keys, inverse = np.unique(key, return_inverse=True)
        inside = np.bincount(inverse[once[toxic_token[once]]], minlength=keys.size).astype(float)
        outside = np.bincount(inverse[once[~toxic_token[once]]], minlength=keys.size).astype(float)
        n1, n0 = max(inside.sum(), 1.0), max(outside.sum(), 1.0)
        share = (inside + outside) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(inside > 0, inside * np.log(inside / (n1 * share)), 0.0)
            ratio += np.where(outside > 0, outside * np.log(outside / (n0 * share)), 0.0)
        strong = (2 * ratio >= SIGNIFICANT) & (inside / n1 >= TIMES * (outside + 0.5) / n0)
        marked |= strong[inverse]
    return marked


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fit the chain and the document score on labelled texts; without both classes every score is low."""
    labels = np.array(toxic, dtype=np.int64)
    size = 1 << FEATURE_BITS
    model = Model(np.zeros(size), -4.0, np.full((2, 2), 0.5), np.array([0.5, 0.5]), np.array([-3.0, 1.0, 1.0]))
    if len(set(toxic)) < 2:
        return model
    column = pa.array(texts, pa.large_string())
    (_, _, data, offsets), *_ = text_blocks(column, limit=1 << 62)
    found = tokens(data, offsets)
    row = np.repeat(labels, np.diff(found.first)).astype(bool)
    y = _marking(found, row) & row
    features, new = _features(found), _new(found.first)
    counts = np.zeros((2, 2))
    follows = ~new
    follows[0] = False
    at = np.flatnonzero(follows)
    np.add.at(counts, (y[at - 1].astype(int), y[at].astype(int)), 1.0)
    model.transitions = (counts + 1.0) / (counts + 1.0).sum(axis=1, keepdims=True)
    model.start = np.array([1.0 + (~y[new]).sum(), 1.0 + y[new].sum()]) / (2.0 + new.sum())
    # The gradient of the conditional likelihood: labels less marginals, per feature; diagonal steps.
    target = np.bincount(features.ravel(), np.repeat(y, features.shape[1]), size)
    observed = counts
    squares, slope_t, bias_square = np.full(size, 1e-6), np.full((2, 2), 1e-6), 1e-6
    logits = np.log(model.transitions)
    for _ in range(ROUNDS):
        score = model.bias + model.weights[features].sum(axis=1)
        p, pairs = forward_backward(
            np.exp(np.clip(score, -30, 30)), new, np.exp(logits), model.start, pairs=True
        )
        slope = (target - np.bincount(features.ravel(), np.repeat(p, features.shape[1]), size)) / y.size
        slope -= PENALTY * model.weights
        squares += slope * slope
        model.weights += 0.3 * slope / np.sqrt(squares)
        change = (observed - pairs) / y.size - PENALTY * logits
        slope_t += change * change
        logits += 0.05 * change / np.sqrt(slope_t)
        b = (y.sum() - p.sum()) / y.size
        bias_square += b * b
        model.bias += 0.1 * b / np.sqrt(bias_square)
    model.transitions = np.exp(logits)
    model.scale = _logistic(_summary(_probabilities(model, found), found.first), labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        w = w + np.linalg.solve(curve, slope)
    return w


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit the model on the bounded ``sample`` of ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    rows = sample(documents, labels).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


def score(
    documents: DataFrame, model: Model, score_name: str = "toxic_score", spans_name: str = "toxic_spans"
) -> DataFrame:
    """All columns of ``documents`` with a score and spans, in place of columns of these names.

    The score is between 0 and 1. The spans list ``start, end, probability`` of runs of toxic
    tokens, in characters of the text, the probability being the largest of the run. A null or empty text
    scores as one without any toxic token and has no spans. Repeated rows score the same; an empty table
    gives no row. Nothing is shuffled; a task holds one block of texts at a time.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = documents.drop(score_name, spans_name)
    place = kept.columns.index("text")
    span = "struct<start: int, end: int, probability: double>"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(place), SMALL_BLOCK):
                part = batch.slice(first, last - first)
                found = tokens(data, offsets)
                toxic = _probabilities(sent.value, found)
                x = np.clip(_summary(toxic, found.first) @ sent.value.scale, -30, 30)
                spans = _spans(data, offsets, found, toxic)
                columns = [*part.columns, pa.array(1 / (1 + np.exp(-x))), spans]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, score_name, spans_name])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{score_name}` double, `{spans_name}` array<{span}>")


def _spans(data: np.ndarray, offsets: np.ndarray, found: Tokens, toxic: np.ndarray) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
    hit = np.flatnonzero(toxic >= SPAN)
    spans: list[list[dict]] = [[] for _ in range(offsets.size - 1)]
    if hit.size:
        character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        texts = np.searchsorted(found.first, hit, side="right") - 1
        last = (-1, -2)
        for t, k in zip(texts.tolist(), hit.tolist()):
            base = character[offsets[t]]
            start, end = int(character[found.starts[k]] - base), int(character[found.ends[k]] - base)
            if last == (t, k - 1):
                spans[t][-1]["end"] = end
                spans[t][-1]["probability"] = max(spans[t][-1]["probability"], float(toxic[k]))
            else:
                spans[t].append({"start": start, "end": end, "probability": float(toxic[k])})
            last = (t, k)
    return pa.array(spans, kind)


def reject(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with their own columns."""
    names = [fresh_name(name, documents) for name in ("toxic_score", "toxic_spans")]
    return score(documents, model, *names).filter(F.col(names[0]) < threshold).select(*documents.columns)
