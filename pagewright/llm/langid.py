"""Language ID of words in code-switched text by a linear-chain conditional random field, and of documents by their words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import materialize

#: Rows of the table of affix and n-gram weights, and lengths of the n-grams of ^word$ (those at an end are affixes).
BUCKETS, SIZES = 1 << 16, (2, 3, 4)
#: Words of a training sequence, of a run of one language in it at least, and words worked on at once when predicting.
SEQUENCE, RUN, BATCH_WORDS = 40, 8, 150_000
UNKNOWN = "und"

ASCII_WORDS, WORDS = re.compile(r"[A-Za-z]+"), regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return ASCII_WORDS.findall(text.lower()) if text.isascii() else WORDS.findall(text.lower())


class Features:
    """Feature rows of distinct words: hashed n-grams of ^word$ (affixes among them), and a hash of the whole word."""

    def __init__(self, words: list[str]):
        data = "".join([f"^{w}$" for w in words])
        chars = np.frombuffer(data.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(sizes) - sizes
        left = np.repeat(first + sizes, sizes) - np.arange(len(chars))
        word = np.repeat(np.arange(len(words)), sizes)
        rows, owners = [], []
        with np.errstate(over="ignore"):
            code = chars * np.uint64(0x9E3779B97F4A7C15)
            for n in range(2, max(SIZES) + 1):
                code = code[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] if len(chars) >= n else code[:0]
                if n in SIZES:
                    at = np.flatnonzero(left[: len(code)] >= n)
                    mixed = (code[at] ^ (code[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    rows.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
                    owners.append(word[at])
            weight = np.cumprod(np.full(int(sizes.max(initial=1)), 0xD6E8FEB86659FD93, np.uint64))
            whole = np.add.reduceat(chars * weight[np.arange(len(chars)) - np.repeat(first, sizes)], first) if len(words) else np.zeros(0, np.uint64)
        rows, owners = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        self.rows, self.whole = rows[order], whole
        self.start = np.searchsorted(owners[order], np.arange(len(words)))
        self.sizes = np.bincount(owners, minlength=len(words))

    def emissions(self, model: Model) -> np.ndarray:
        """Score of each label for each word."""
        out = np.add.reduceat(model.weights[self.rows], self.start) if len(self.start) else np.zeros((0, len(model.labels)))
        at = np.minimum(np.searchsorted(model.lexicon, self.whole), max(0, len(model.lexicon) - 1))
        if len(model.lexicon):
            out += np.where((model.lexicon[at] == self.whole)[:, None], model.lexicon_weights[at], 0.0)
        return out + model.bias

    def familiar(self, model: Model) -> np.ndarray:
        """Share of each word's n-grams that training words have."""
        return np.add.reduceat(model.seen[self.rows].astype(float), self.start) / self.sizes if len(self.start) else np.zeros(0)


class Model:
    """labels; weights of n-grams, of lexicon words (by sorted hash) and of labels; log transitions, one row for each label before."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.lexicon_weights = np.zeros((BUCKETS, n)), np.zeros((len(lexicon), n))
        self.bias, self.transitions = np.zeros(n), np.zeros((n, n))
        self.seen = np.zeros(BUCKETS, bool)  # rows of n-grams that training words have
        self.usual = 0.0  # familiar() of texts that weren't learned from, as half of the training texts show of the other half

    def parameters(self) -> list[np.ndarray]:
        return [self.weights, self.lexicon_weights, self.bias, self.transitions]


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Posterior label shares of every word.

    lengths: words of each sequence, falling. scores: by position, then by sequence (those that are still running). With pairs
    also the sum of posterior shares of neighbouring labels.
    """
    n, k = scores.shape
    steps = int(lengths[0]) if len(lengths) else 0
    running = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, steps + 1))
    edge = np.concatenate([[0], np.cumsum(running)])
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    ahead = np.empty((n, k))
    for t in range(steps):
        now = slice(edge[t], edge[t + 1])
        a = emit[now] if t == 0 else (ahead[edge[t - 1] : edge[t - 1] + running[t]] @ step) * emit[now]
        ahead[now] = a / a.sum(axis=1, keepdims=True)
    post, sums = ahead.copy(), np.zeros((k, k))
    back = None
    for t in range(steps - 2, -1, -1):
        m = running[t + 1]
        later = emit[edge[t + 1] : edge[t + 2]]
        if back is not None:
            later = later.copy()
            later[: len(back)] *= back
        back = later @ step.T
        back /= back.sum(axis=1, keepdims=True)
        here = slice(edge[t], edge[t] + m)
        if pairs:
            joint = ahead[here][:, :, None] * step[None] * later[:, None, :]
            sums += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        p = ahead[here] * back
        post[here] = p / p.sum(axis=1, keepdims=True)
    return (post, sums) if pairs else post


def train(rows: list[tuple[str, str]], *, rounds: int = 40, rate: float = 0.15, decay: float = 1e-4, seed: int = 5) -> Model | None:
    """Fit a model to (text, label) rows; every word has its document's label. Sequences of SEQUENCE words put runs of documents of
    different labels side by side, so the transitions are learned from switches as well."""
    labels = sorted({lang for _, lang in rows})
    runs: list[tuple[int, list[str]]] = []
    for text, lang in sorted(rows):
        words = words_of(text)
        runs += [(labels.index(lang), words[i : i + RUN]) for i in range(0, len(words) - RUN + 1, RUN)] or ([(labels.index(lang), (words * RUN)[:RUN])] if words else [])
    if not runs:
        return None
    random = np.random.default_rng(seed)
    per = SEQUENCE // RUN
    order = [r for _, r in sorted(zip(random.random(len(runs) // per + 1).repeat(per)[: len(runs)].tolist(), range(len(runs)), strict=True))]
    # Half of the sequences keep neighbouring runs of a document together, half mix runs of all documents.
    half = len(order) // 2 // per * per
    order = order[:half] + random.permutation(order[half:]).tolist()
    order += [order[i % len(order)] for i in range(-len(order) % per)]
    number: dict[str, int] = {}
    ids = np.array([[number.setdefault(w, len(number)) for w in runs[r][1]] for r in order]).reshape(-1, SEQUENCE)
    truth = np.repeat([runs[r][0] for r in order], RUN).reshape(-1, SEQUENCE)
    words = list(number)
    features, count = Features(words), np.bincount(ids.ravel(), minlength=len(words))
    model = Model(labels, np.unique(features.whole[count >= 3]))
    model.seen[features.rows] = True
    model.usual = usual([words_of(text) for text, _ in sorted(rows)], model)
    k, n = len(labels), ids.size
    flat, gold = ids.T.ravel(), truth.T.ravel()  # by position, then by sequence
    lengths = np.full(len(ids), SEQUENCE)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    owner = np.repeat(np.arange(len(words)), features.sizes)
    at = np.searchsorted(model.lexicon, features.whole)
    known = (at < len(model.lexicon)) & (model.lexicon[np.minimum(at, len(model.lexicon) - 1)] == features.whole) if len(model.lexicon) else np.zeros(len(words), bool)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    for turn in range(1, rounds + 1):
        post, pairs = forward_backward(features.emissions(model)[flat], model.transitions, lengths, pairs=True)
        post[np.arange(n), gold] -= 1
        slope = np.stack([np.bincount(flat, weights=post[:, j], minlength=len(words)) for j in range(k)], axis=1) / n
        lexicon = np.zeros_like(model.lexicon_weights)
        lexicon[at[known]] = slope[known]
        grams = np.stack([np.bincount(features.rows, weights=slope[owner, j], minlength=BUCKETS) for j in range(k)], axis=1)
        slopes = [grams, lexicon, slope.sum(axis=0), (pairs - gold_pairs) / n]
        for p, g, (m, v) in zip(model.parameters(), slopes, moments, strict=True):
            g = g + decay / n * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return model


def usual(texts: list[list[str]], model: Model) -> float:
    """Mean familiar() of the words of every other text, were only the rest learned from; 0 for one text."""
    learned, other = ([w for words in texts[i::2] for w in words] for i in (0, 1))
    if not learned or not other:
        return 0.0
    half = Model(model.labels, model.lexicon)
    half.seen[Features(list(set(learned))).rows] = True
    number = {w: i for i, w in enumerate(set(other))}
    return float(Features(list(number)).familiar(half)[[number[w] for w in other]].mean())


def label_texts(texts: list[str | None], model: Model | None):
    """For each text: (label, mean posterior share of that label over its words, by forward-backward over the whole text; mean share of
    the words' n-grams that training words have)."""
    out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
    if model is None:
        return out
    held: list[tuple[int, list[str]]] = []
    size = 0
    for i, text in enumerate(texts):
        if words := words_of(text or ""):
            held.append((i, words))
            size += len(words)
        if size >= BATCH_WORDS or (held and i == len(texts) - 1):
            for k, *got in _label(held, model):
                out[k] = tuple(got)
            held, size = [], 0
    if held:
        for k, *got in _label(held, model):
            out[k] = tuple(got)
    return out


def _label(held, model: Model):
    held = sorted(held, key=lambda x: -len(x[1]))
    lengths = np.fromiter((len(w) for _, w in held), np.int64, len(held))
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for _, words in held for w in words), np.int64, int(lengths.sum()))
    features = Features(list(number))
    scores = features.emissions(model)
    position = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sequence = np.repeat(np.arange(len(held)), lengths)
    order = np.argsort(position, kind="stable")
    post = forward_backward(scores[ids[order]], model.transitions, lengths)
    own = sequence[order]
    total = np.stack([np.bincount(own, weights=post[:, j], minlength=len(held)) for j in range(post.shape[1])], axis=1)
    best = total.argmax(axis=1)
    familiar = np.bincount(sequence, weights=features.familiar(model)[ids], minlength=len(held)) / lengths
    for (i, _), b, share, known in zip(held, best.tolist(), (total[np.arange(len(held)), best] / lengths).tolist(), familiar.tolist(), strict=True):
        yield i, model.labels[b], min(1.0, share), min(1.0, known)


def is_held_out(doc_id, folds: int):
    """crc32 of doc_id as text leaves 0; a null doc_id is held out, too."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, *, folds: int = 5, max_docs: int = 800, max_doc_chars: int = 64 << 10) -> Model | None:
    """Fit a model to a bounded sample of the labelled training documents (doc_id, text, lang).

    Training documents: crc32(doc_id as text) mod folds is not 0, text and lang are not null. The sample has at most max_docs documents,
    shared evenly by all labels, but one of each label at least; those come first by a hash of doc_id. Of a text above max_doc_chars
    a run of that length is learned from, at a place chosen by the same hash. The sample is what reaches the driver. None if there is
    nothing to learn from.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"), folds))
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("all")), "labels")
    labels = counts.count()
    if not labels:
        return None
    quota = max(1, max_docs // labels)
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = rows.withColumn("spot", spot).join(counts, "lang").filter(F.col("spot") < F.least(F.lit(1.0), (2 * quota + 20) / F.col("all")) * (1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "doc_id", F.xxhash64("text")))
    sample = near.withColumn("rank", first).filter(F.col("rank") <= quota)
    extra = F.char_length("text") - max_doc_chars
    run = F.when(extra > 0, F.substring("text", (F.col("spot") % (F.greatest(extra, F.lit(0)) + 1) + 1).cast("int"), F.lit(max_doc_chars))).otherwise(F.col("text"))
    return train([(r["text"], r["lang"]) for r in sample.select(run.alias("text"), "lang").collect()])


def identify(docs: DataFrame, model: Model | None, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: doc_id, text, lang_pred, score, familiar and carried (a struct of the columns named in carry) per input row.

    docs: doc_id, text; no other column has an influence. Words are runs of letters, lower-cased; each gets the posterior shares of the labels from
    forward-backward over the whole text; lang_pred is the label with the largest sum, score its mean share; familiar is the mean
    share of the words' n-grams that training words have, which is low for noise and unlearned languages. Null, empty
    and letterless texts, and all without a model, are `und` with score 0. Any number of rows, repeated ones too, give as many.
    One pass without a shuffle; the model, of a size bounded by its parameters, goes to each executor. Memory is bounded by
    BATCH_WORDS, or one text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = label_texts(batch.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _, _ in got], pa.string()), pa.array([x for _, x, _ in got], pa.float64()), pa.array([x for _, _, x in got], pa.float64())], names=["doc_id", "text", "carried", "lang_pred", "score", "familiar"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(True).alias("row"), *carry).alias("carried"))
    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double").add("familiar", "double"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
