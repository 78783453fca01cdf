"""Document quality from weak labels: labellers, their accuracies by EM, and a hashed linear scorer.

Two questions are asked of each text: is it of low quality, is it toxic? Several heuristic
labellers per question vote yes or abstain; where a table of given labels covers a document, these
vote as one more labeller, yes or no. Expectation-maximisation over the counts of vote patterns
(there are few, whatever the number of documents) estimates how often each labeller votes so for
either class, and from that the posterior of every pattern. The posteriors of a bounded sample of
documents train a logistic scorer on hashed words, word beginnings and shape features, which
then scores every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import add_columns
from docweave.llm.words import split_words, text_buffer

DIMENSIONS = 1 << 18
#: The scorer is fitted on about so many documents, drawn by a hash of their key: labelled ones
#: where labels are given, else any. All other steps cover every document.
SAMPLE = 10_000
EPOCHS = 15
#: Weight of a positive document in the fit; about one in ten is positive.
POSITIVE = 3.0
#: Shape features of a text.
SHAPES = 7
EM_ROUNDS = 50
THRESHOLD = 0.5

# Common insults in four languages.
INSULTS = {
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "pathetic", "worthless", "trash",
    "disgusting", "clown", "clowns", "imbecile", "dumb", "filthy", "vermin",
    "imbécile", "crétin", "débile", "minable", "ordure", "abruti", "connard", "salaud",
    "trottel", "dummkopf", "abschaum", "versager", "arschloch", "blödmann", "idioten",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "patético", "inútil",
}
INSULT_BYTES = {w.encode() for w in INSULTS}
_B = np.arange(256)
UPPER = (_B >= 65) & (_B <= 90)
LETTER = UPPER | ((_B >= 97) & (_B <= 122))
SYMBOL = np.isin(_B, list(b"#$%&*+<=>@\\^_`{}~"))
BAR, BANG = _B == ord("|"), _B == ord("!")

#: Labellers of low quality, then of toxicity; given labels are added to each as the last one.
LOW = ("shouting", "exclaiming", "symbols", "bars", "few_words", "stutter")
TOXIC = ("insult", "insults")


def _shares(column: pa.Array) -> dict[str, np.ndarray]:
    """Measures of each text that the labellers and the shape features use."""
    flat, offsets = text_buffer(column)
    n = len(column)

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flat) + 1, np.int32 if len(flat) < 1 << 31 else np.int64)
        np.cumsum(kind[flat], out=total[1:])
        return np.diff(total[offsets]).astype(float)

    words, begin = split_words(column)
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(begin)
    doc = np.repeat(np.arange(n), size)
    pairs = np.unique((doc << 32) | number)
    distinct = np.bincount(pairs >> 32, minlength=n)
    same = np.zeros(len(number), bool)
    same[1:] = (number[1:] == number[:-1]) & (doc[1:] == doc[:-1])
    repeated = np.bincount(doc[same], minlength=n)
    vocabulary = coded.dictionary.to_pylist()
    bad = np.fromiter((w.strip(b".,;:!?*#$%&()\"'") in INSULT_BYTES for w in vocabulary), bool, len(vocabulary))
    insults = np.bincount(doc[bad[number]], minlength=n) if len(number) else np.zeros(n)
    many = np.maximum(size, 1)
    return {
        "words": size, "upper": count(UPPER) / np.maximum(count(LETTER), 1), "bang": count(BANG) / many,
        "symbol": count(SYMBOL) / many, "bar": count(BAR) / many, "distinct": distinct / many,
        "repeated": repeated / many, "insults": insults, "pairs": pairs, "vocabulary": vocabulary,
    }


def _votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """1 (yes) or 0 (abstains) by labeller."""
    return np.stack([
        (m["upper"] > 0.4) & (m["words"] >= 5), m["bang"] > 0.15, m["symbol"] > 0.3, m["bar"] > 0.15,
        (m["distinct"] < 0.15) & (m["words"] >= 40) & (m["words"] <= 2000), m["repeated"] > 0.2,
        m["insults"] >= 1, (m["insults"] >= 2) & (m["insults"] * 300 >= m["words"]),
    ], 1).astype(np.int8)


def _word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    """Hashed features of each word: itself without marks around it, and its first four and five bytes."""
    out = np.empty((len(vocabulary), 3), np.int32)
    for i, w in enumerate(vocabulary):
        w = w.strip(b".,;:!?*#$%&()\"'")
        out[i] = (xxhash.xxh32_intdigest(w) % DIMENSIONS, xxhash.xxh32_intdigest(w[:4], 4) % DIMENSIONS,
                  xxhash.xxh32_intdigest(w[:5], 5) % DIMENSIONS)
    return out


def _shape_hashes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed features of a text's shape: each measure by bins."""
    out = []
    for k, name in enumerate(("upper", "bang", "symbol", "bar", "distinct", "repeated")):
        step = np.digitize(m[name], [0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
        out.append([xxhash.xxh32_intdigest(f"{k}:{s}".encode(), 9) % DIMENSIONS for s in step])
    out.append([xxhash.xxh32_intdigest(f"insults:{min(int(c), 3)}".encode(), 9) % DIMENSIONS for c in m["insults"]])
    return np.array(out, np.int32).T.reshape(-1, SHAPES)


def _patterns(votes: np.ndarray) -> list[str]:
    return ["".join(map(str, v)) for v in votes.tolist()]


def _em(patterns: list[str], counts: np.ndarray, columns: list[int]) -> dict[str, float]:
    """Posterior of each pattern by expectation-maximisation over the labellers in ``columns``.

    Votes are 0 (abstains), 1 (yes) or 2 (no). Each labeller has one accuracy, that of the votes it
    casts; abstaining tells nothing, as heuristics for one language are silent on the others. An
    accuracy is estimated where labellers overlap.
    A pattern without votes has the share of the positive among all documents.
    """
    votes = np.array([[int(p[c]) for c in columns] for p in patterns])
    cast = votes > 0
    sign = np.where(votes == 1, 1.0, np.where(votes == 2, -1.0, 0.0))
    accuracy = np.full(len(columns), 0.9)
    overlap = counts[:, None] * (cast & (cast.sum(axis=1, keepdims=True) > 1))
    for _ in range(EM_ROUNDS):
        belief = 1 / (1 + np.exp(-(sign @ np.log(accuracy / (1 - accuracy)))))
        right = np.where(votes == 1, belief[:, None], 1 - belief[:, None])
        accuracy = np.clip(((right * overlap).sum(axis=0) + 9) / (overlap.sum(axis=0) + 10), 0.55, 0.995)
    belief = 1 / (1 + np.exp(-(sign @ np.log(accuracy / (1 - accuracy)))))
    voted = cast.any(axis=1)
    belief[~voted] = (belief * counts)[voted].sum() / max(counts.sum(), 1)
    return dict(zip(patterns, belief.tolist()))


def _usual(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of features without those of fewer than three rows, the value of a row's words, and its number of shapes.

    The last ``SHAPES`` features of a row are those of shape and count 1, the words before them
    one over the root of their number.
    """
    often = np.zeros(DIMENSIONS, np.int32)
    for r in rows:
        often[np.unique(r)] += 1
    scale = np.array([1 / np.sqrt(max(len(r) - SHAPES, 1) / 3) for r in rows])
    shapes = np.array([(often[r[-SHAPES:]] >= 3).sum() for r in rows])
    return [r[often[r] >= 3] for r in rows], scale, shapes


def _fit(rows: list[np.ndarray], scale: np.ndarray, shapes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features by adaptive gradient steps, small weights set to nothing."""
    weight, bias = np.zeros(DIMENSIONS), 0.0
    if not len(rows):
        return weight, -1.0
    power, bias_power = np.full(DIMENSIONS, 1e-6), 1e-6
    order = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 32)):
            flat = np.concatenate([rows[i] for i in part])
            size = np.array([len(rows[i]) for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            behind = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
            value = np.where(behind <= shapes[part][doc], 1.0, scale[part][doc])
            margin = np.bincount(doc, weight[flat] * value, len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[part]) / len(part)
            error *= 1 + (POSITIVE - 1) * target[part]
            at, place = np.unique(flat, return_inverse=True)
            slope = np.bincount(place, error[doc] * value, len(at))
            power[at] += slope ** 2
            rate = 0.3 / np.sqrt(power[at])
            moved = weight[at] - rate * slope
            weight[at] = np.sign(moved) * np.maximum(np.abs(moved) - rate * 1e-5, 0)
            bias_power += error.sum() ** 2
            bias -= 0.3 / np.sqrt(bias_power) * error.sum()
    return weight, bias


class Scorer:
    """Chances of low quality and of toxicity of each text of a column."""

    def __init__(self, low: tuple[np.ndarray, float], toxic: tuple[np.ndarray, float]):
        self.weight = np.stack([low[0], toxic[0]], 1).astype(np.float32)
        self.bias = np.array([low[1], toxic[1]])

    def __call__(self, column: pa.Array) -> dict[str, pa.Array | list]:
        m = _shares(column)
        margin = np.tile(self.bias, (len(column), 1))
        own = self.weight[_word_hashes(m["vocabulary"])].sum(axis=1)
        doc, word = m["pairs"] >> 32, m["pairs"] & 0xFFFFFFFF
        shape = self.weight[_shape_hashes(m)].sum(axis=1)
        for h in (0, 1):
            words = np.bincount(doc, own[word, h], len(column))
            margin[:, h] += words / np.sqrt(np.maximum(np.bincount(doc, minlength=len(column)), 1)) + shape[:, h]
        chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return {"pattern": _patterns(_votes(m)), "low_score": pa.array(chance[:, 0]), "toxic_score": pa.array(chance[:, 1])}


SLICE = 4 << 20


def _vote_patterns(column: pa.Array) -> dict[str, list]:
    return {"pattern": _patterns(_votes(_shares(column)))}


def _features(column: pa.Array) -> dict[str, list]:
    m = _shares(column)
    names, shape = _word_hashes(m["vocabulary"]), _shape_hashes(m)
    ends = np.searchsorted(m["pairs"] >> 32, np.arange(len(column) + 1))
    word = m["pairs"] & 0xFFFFFFFF
    rows = [np.append(names[word[s:e]].ravel(), shape[i]).astype(np.int32).tobytes()
            for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]
    return {"pattern": _patterns(_votes(m)), "features": rows}


def _given(df: DataFrame, labels: DataFrame | None, key: str) -> DataFrame:
    """``df`` with the votes of given labels added to its patterns: low quality, then toxicity."""
    if labels is None:
        return df.withColumn("pattern", F.concat("pattern", F.lit("00")))
    vote = lambda yes: F.when(yes, "1").when(~yes, "2").otherwise("0")
    own = labels.groupBy(key).agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t")).filter(F.col(key).isNotNull())
    return df.join(own, key, "left").withColumn(
        "pattern", F.concat("pattern", vote(F.col("_q") == 0), vote(F.col("_t") == 1))).drop("_q", "_t")


def train(documents: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> tuple[Scorer, dict[str, float], dict[str, float]]:
    """The scorer, and the posteriors of low quality and of toxicity by vote pattern."""
    rows = documents.select(F.col(key), F.col(text).alias("_text"))
    found = _given(add_columns(rows, "_text", "pattern string", _vote_patterns, drop=("_text",), limit=SLICE), labels, key)
    counted = found.groupBy("pattern").count().collect()
    patterns, counts = [r[0] for r in counted], np.array([r[1] for r in counted], float)
    given = len(LOW) + len(TOXIC)
    if not patterns:
        nothing = (np.zeros(DIMENSIONS), -1.0)
        return Scorer(nothing, nothing), {}, {}
    low = _em(patterns, counts, [*range(len(LOW)), given])
    toxic = _em(patterns, counts, [*range(len(LOW), given), given + 1])
    usable = sum(c for p, c in zip(patterns, counts) if labels is None or p[given] != "0" or p[given + 1] != "0")
    part = min(1.0, sample / max(usable, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(part * 1_000_003) + 1)
    drawn = _given(add_columns(drawn, "_text", "pattern string, features binary", _features, drop=("_text",), limit=SLICE), labels, key)
    if labels is not None and usable:
        drawn = drawn.filter(F.substring("pattern", given + 1, 2) != "00")
    used = drawn.select("pattern", "features").toArrow()
    names = used.column("pattern").to_pylist()
    fitted = _usual([np.frombuffer(r.as_buffer(), np.int32) for r in used.column("features")])
    del used
    return (Scorer(_fit(*fitted, np.array([low.get(p, 0.5) for p in names])),
                   _fit(*fitted, np.array([toxic.get(p, 0.5) for p in names]))), low, toxic)


SCORES = "pattern string, low_score double, toxic_score double"


def classify(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``(key, low_posterior, toxic_posterior, low_score, toxic_score, accepted)`` for every row.

    The posteriors follow from the votes alone, the scores from the text; ``accepted`` if neither
    score reaches ``threshold``. ``labels(key, quality, toxic)`` may cover some documents; several
    labels of one key count as the worse. Null and empty texts get no vote and are scored by shape.
    Rows without a key have no given label. An empty table gives no rows. Extra columns are not returned.
    """
    scorer, low, toxic = train(documents, labels, key, text)
    rows = documents.select(F.col(key), F.col(text).alias("_text"))
    scored = _given(add_columns(rows, "_text", SCORES, scorer, drop=("_text",), limit=SLICE), labels, key)
    spark = documents.sparkSession
    # one row per vote pattern
    known = spark.createDataFrame(
        [(p, low[p], toxic[p]) for p in low], "pattern string, low_posterior double, toxic_posterior double")
    return scored.join(F.broadcast(known), "pattern", "left").select(
        key, "low_posterior", "toxic_posterior", "low_score", "toxic_score",
        ((F.col("low_score") < threshold) & (F.col("toxic_score") < threshold)).alias("accepted"))


def accepted(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that the scorer accepts, with their own columns; no shuffle of texts."""
    scorer, *_ = train(documents, labels, key, text)
    names = {"low_score": "_low_score", "toxic_score": "_toxic_score", "pattern": "_pattern"}

    def scores(column: pa.Array) -> dict:
        return {names[k]: v for k, v in scorer(column).items()}

    judged = add_columns(documents, text, "_pattern string, _low_score double, _toxic_score double", scores, limit=SLICE)
    return judged.filter((F.col("_low_score") < threshold) & (F.col("_toxic_score") < threshold)).select(documents.columns)
