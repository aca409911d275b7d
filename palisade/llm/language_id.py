"""Language of texts by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over them, each filter keeps its maximum over a
window of fixed length, and a softmax over the rectified maxima gives the language.  A text is cut
into such windows; its languages' probabilities are the mean over all windows, weighted by their bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import text as tx

#: Bytes of a window.
WINDOW = 192
#: Bytes of an embedding, filter widths, and filters of each width.
EMBEDDING, WIDTHS, FILTERS = 8, (2, 3, 4), 12
#: Bounds of the sample that the network is fitted on: documents, windows of each, and languages
#: (the most frequent ones).  Documents are drawn by hash, as many expected of each language, twice as many at most.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, SAMPLE_LANGUAGES = 3000, 3, 200
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNDETERMINED = "und"

_PAD = 256
#: Windows that are convolved at once.
_AT_ONCE = 256


class Network(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # 257 × EMBEDDING; row 256 is padding, all zero
    filters: np.ndarray  # (widest · EMBEDDING) × number of filters; narrow filters are zero behind
    weights: np.ndarray
    bias: np.ndarray


def _mask() -> np.ndarray:
    widest = max(WIDTHS)
    columns = [np.repeat(np.arange(widest) < width, EMBEDDING) for width in WIDTHS for _ in range(FILTERS)]
    return np.stack(columns, 1).astype(np.float32)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A–Z and the two-byte letters À–Þ in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 0x20
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    out[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows × bytes, text of each window, its bytes) of non-null texts; padded at the end."""
    bounds, data = tx._bounds(texts)
    data = folded(data[bounds[0] : bounds[-1]])
    sizes = np.diff(bounds)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (bounds[:-1] - bounds[0])[owner] + number * WINDOW
    length = np.minimum(sizes[owner] - number * WINDOW, WINDOW)
    place = np.arange(WINDOW)
    padded = np.append(data.astype(np.int16), np.full(WINDOW, _PAD, np.int16))
    return np.where(place < length[:, None], padded[start[:, None] + place], _PAD), owner, length


def _convolved(network: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter responses, windows × places × filters, and their inputs."""
    widest = max(WIDTHS)
    padded = np.pad(windows, ((0, 0), (0, widest - 1)), constant_values=_PAD)
    embedded = network.embedding[padded]
    views = [embedded[:, i : i + windows.shape[1]] for i in range(widest)]
    inputs = np.concatenate(views, 2)
    flat = inputs.reshape(-1, inputs.shape[2]) @ network.filters
    return flat.reshape(*windows.shape, -1), inputs


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(network: Network, windows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(windows), len(network.languages)), np.float32)
    for i in range(0, len(windows), _AT_ONCE):
        responses, _ = _convolved(network, windows[i : i + _AT_ONCE])
        pooled = np.maximum(responses.max(1), 0)
        out[i : i + _AT_ONCE] = _softmax(pooled @ network.weights + network.bias)
    return out


def train(texts: list[str], languages: list[str], seed: int = 11) -> Network:
    """Network fitted by Adam on windows of the given texts; the same input gives the same network."""
    names = sorted(set(languages))
    windows, owner, _ = cut(pa.array(texts, pa.large_string()))
    labels = np.array([names.index(x) for x in languages])[owner]
    rng = np.random.default_rng(seed)
    mask = _mask()
    values = [
        rng.normal(0, 0.3, (257, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        rng.normal(0, 0.1, (mask.shape[1], len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    ]
    values[0][_PAD] = 0
    first, second = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            network = Network(names, *values)
            responses, inputs = _convolved(network, windows[at])
            best = responses.argmax(1)
            row, filt = np.arange(len(at))[:, None], np.arange(mask.shape[1])[None, :]
            pooled = np.maximum(responses[row, best, filt], 0)
            error = _softmax(pooled @ network.weights + network.bias)
            error[np.arange(len(at)), labels[at]] -= 1
            error /= len(at)
            back = (error @ network.weights.T) * (pooled > 0)
            # Only the place of the maximum of each filter is answerable for it.
            seen = inputs[row, best]
            by_filter = np.einsum("bf,bfk->kf", back, seen) * mask
            by_input = (back[:, :, None] * network.filters.T[None]).reshape(len(at), mask.shape[1], -1, EMBEDDING)
            padded = np.pad(windows[at], ((0, 0), (0, max(WIDTHS) - 1)), constant_values=_PAD)
            letters = padded[row[:, :, None], best[:, :, None] + np.arange(max(WIDTHS))]
            by_byte = np.zeros_like(values[0])
            np.add.at(by_byte, letters.ravel(), by_input.reshape(-1, EMBEDDING))
            by_byte[_PAD] = 0
            step += 1
            for k, gradient in enumerate((by_byte, by_filter, pooled.T @ error, error.sum(0))):
                first[k] += 0.1 * (gradient - first[k])
                second[k] += 0.001 * (gradient**2 - second[k])
                scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[k] = values[k] - scale * first[k] / (np.sqrt(second[k]) + 1e-7)
    return Network(names, *values)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from all fitting: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Bounded sample of labelled windows of documents that are not held out."""
    labelled = docs.where(~F.coalesce(held_out(), F.lit(True)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGUAGES).collect()
    if not sizes:
        return [], []
    weight = F.create_map(*(F.lit(x) for row in sizes for x in (row["lang"], float(row["count"]))))
    chance = (F.xxhash64("doc_id", F.lit(5)).cast("double") / 2.0**64 + 0.5) * weight[F.col("lang")]
    # Hashed places in the text; letters count double as bytes at times, which the cut evens out.
    places = [
        F.substring(
            "text",
            1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int"),
            F.lit(WINDOW),
        )
        for i in range(SAMPLE_WINDOWS)
    ]
    # The hash alone decides, so tasks send what is drawn and no more; the limit only bounds chance.
    rows = (
        labelled.select("lang", chance.alias("chance"), "doc_id", F.array(*places).alias("parts"))
        .where(F.col("chance") < SAMPLE_DOCUMENTS / len(sizes))
        .orderBy("chance", "doc_id")
        .limit(2 * SAMPLE_DOCUMENTS)
        .collect()
    )
    pairs = [(x, row["lang"]) for row in rows for x in dict.fromkeys(row["parts"]) if x]
    return [x for x, _ in pairs], [y for _, y in pairs]


def fit(docs: DataFrame) -> Network | None:
    """Network for ``docs (doc_id, text, lang)``; None where no row has a language and a letter."""
    texts, languages = sample(docs)
    return train(texts, languages) if texts else None


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from ``text`` alone.

    ``score`` is the mean probability of the predicted language.  Null texts, texts without a letter, and
    all texts if there is no network get ``und`` and 0.  Every byte of a text counts.  Ties go to the
    first language by name.  Other columns pass through; those named like a result are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if network is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    flag = "letters"
    while flag in columns:
        flag += "_"

    def score(batches):
        for batch in batches:
            texts, letters = tx.string_column(batch, "text"), np.asarray(batch.column(len(columns)).to_numpy(zero_copy_only=False), bool)
            for a, b in tx.chunks(texts, 1 << 18):
                windows, owner, length = cut(texts.slice(a, b - a))
                found = probabilities(network, windows) * length[:, None]
                total = np.zeros((b - a, len(network.languages)))
                np.add.at(total, owner, found)
                total /= np.maximum(np.bincount(owner, length, b - a), 1)[:, None]
                names = np.array([*network.languages, UNDETERMINED], object)
                best = np.where(letters[a:b], total.argmax(1), len(network.languages))
                scores = np.where(letters[a:b], np.minimum(total.max(1), 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns[:-1], pa.array(names[best], pa.string()), pa.array(scores)],
                    names=[*columns, "lang_pred", "score"],
                )

    flagged = docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return flagged.mapInArrow(score, f"{schema}, lang_pred string, score double")
