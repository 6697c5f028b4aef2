"""Toxicity: a linear classifier on words and word beginnings, regularised against reacting to group mentions.

In labelled texts that mention a group, the mention is swapped for another group's or for people in general; the fit
penalises the squared change of the score between the two, so neutral mentions do not make a text look toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import pieces, returning, staged, words_of

#: Words that name groups of people, by language, singular and plural, nouns and adjectives.
IDENTITIES = {
    "en": """woman women man men girl girls boy boys female male christian christians muslim muslims jew jews jewish hindu hindus buddhist atheist
        atheists immigrant immigrants refugee refugees foreigner foreigners gay gays lesbian lesbians transgender black white african africans asian
        asians arab arabs european europeans mexican mexicans native natives disabled deaf elderly""".split(),
    "de": """frau frauen mann männer mädchen christ christen muslim muslime jude juden jüdisch einwanderer flüchtling flüchtlinge ausländer
        schwul schwule lesbisch lesben schwarze weiße afrikaner asiaten araber europäer behinderte""".split(),
    "fr": """femme femmes homme hommes fille filles garçon garçons chrétien chrétiens musulman musulmans musulmane juif juifs juive immigré
        immigrés réfugié réfugiés étranger étrangers gay lesbienne lesbiennes noir noirs noire africain africains asiatique arabe arabes""".split(),
    "es": """mujer mujeres hombre hombres niña niñas niño niños cristiano cristianos musulmán musulmanes judío judíos judía inmigrante
        inmigrantes refugiado refugiados extranjero extranjeros gay lesbiana lesbianas negro negra negros africano africanos árabe árabes""".split(),
}
#: What stands in for any group. Its weight is not free to follow a group's, so a mention by itself gets none.
ANYONE = {"en": "people", "de": "menschen", "fr": "gens", "es": "gente"}
#: Each word with its language (the first that has it).
LANGUAGE = {word: lang for lang in reversed(IDENTITIES) for word in IDENTITIES[lang]}
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 6)
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_features(word: str) -> list[int]:
    """Feature numbers of a word, white-space-free and with punctuation around it."""
    word = word.strip(EDGE).lower()
    if not word:
        return []
    names = [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in names]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def swapped(word: str, draw: int, neutral: bool) -> str | None:
    """What stands for a group's name in a swapped text: people in general, or the `draw`-th other group. None for other words."""
    bare = word.strip(EDGE).lower()
    if (lang := LANGUAGE.get(bare)) is None:
        return None
    others = IDENTITIES[lang]
    return ANYONE[lang] if neutral else others[(others.index(bare) + 1 + draw % (len(others) - 1)) % len(others)]


def counterparts(text: str, words: set[str], swaps: int) -> list[list[int]] | None:
    """Distinct features of the text with its group names swapped, `swaps` times; None without a name.

    The first swap is to people in general, the others to groups drawn by a hash of the text.
    """
    if not any(w.strip(EDGE).lower() in LANGUAGE for w in words):
        return None
    seed = xxhash.xxh3_64_intdigest(text.encode())
    out = []
    for k in range(swaps):
        out.append(sorted({f for w in words for f in word_features(swapped(w, seed >> 8 * (k % 7), k == 0) or w)}))
    return out


def labelled_features(rows: DataFrame, swaps: int) -> DataFrame:
    """doc_id, label, the text's distinct features, and those after swaps of group names (null without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for whole in batches:
            for batch in pieces(whole):
                offsets, flat = words_of(batch.column("text"))
                own, others = [], []
                for text, start, stop in zip(batch.column("text").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = set(flat.slice(start, stop - start).to_pylist())
                    own.append(sorted({f for w in words for f in word_features(w)}))
                    others.append(counterparts(text or "", words, swaps))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, kind), pa.array(others, pa.list_(kind))], names=["doc_id", "label", "own", "others"])

    return rows.select("doc_id", "label", "text").mapInArrow(returning(run), "doc_id long, label int, own array<long>, others array<array<long>>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 20_000, features: int = 1024, ridge: float = 1e-4, swap_penalty: float = 1.0, swaps: int = 3, steps: int = 400) -> Model:
    """A model from at most `sample` labelled rows (chosen by a hash of doc_id) and at most `features` features.

    Rows without label, doc_id or text teach nothing. Where documents or labels repeat a doc_id, each pair counts, and of
    more than `sample` pairs those of the least hashes are kept. Features are those that split the
    classes best (chi-squared) among those in enough documents, besides the group names. Without both classes all weights
    are zero. Texts that name a group come with `swaps` counterparts each.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = staged(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = staged(labelled_features(rows, swaps), "labelled")
    totals = F.count("*"), F.coalesce(F.sum("label"), F.lit(0))
    n, positive = rows.agg(*totals).first()
    if n > sample:  # repeated doc_ids
        rows = staged(rows.orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label", F.xxhash64("own")).limit(sample), "labelled")
        n, positive = rows.agg(*totals).first()
    if not 0 < positive < n:
        return Model({}, 10.0 if positive else -10.0)
    seen = rows.select("label", F.explode("own").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    mean = positive / n
    gain = F.pow(F.col("p") - F.col("n") * mean, 2) / (F.col("n") * mean * (1 - mean))
    best = seen.filter(F.col("n") >= max(2, n // 4000)).orderBy(F.desc(gain), "feature").limit(features)
    known = sorted(r.feature for r in best.select("feature").collect())
    known = sorted({*known, *(f for x in LANGUAGE for f in word_features(x))})
    wanted = F.array(*[F.lit(f) for f in known])
    kept = rows.select("label", F.array_intersect("own", wanted).alias("own"), F.transform("others", lambda x: F.array_intersect(x, wanted)).alias("others"))
    data = sorted(kept.collect(), key=lambda r: (r.label, r.own, r.others or []))
    place = {f: k for k, f in enumerate(known)}
    y = np.array([r.label for r in data], float)
    pairs = [(k, x) for k, r in enumerate(data) for x in r.others or []]
    weights, bias = _descend(_sparse([r.own for r in data], place), _sparse([x for _, x in pairs], place), np.array([k for k, _ in pairs], int), y, len(known), ridge, swap_penalty, steps)
    return Model({f: float(weights[k]) for f, k in place.items()}, float(bias))


def _sparse(rows: list[list[int]], place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.array([place[f] for x in rows for f in x], int)


def _descend(one, two, owner: np.ndarray, y: np.ndarray, width: int, ridge: float, swap_penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on log loss + ridge + the squared change of the score between a text and each of its counterparts.

    `one`, `two`: the features of the texts and of all counterparts; `owner`: each counterpart's text.
    """
    n, w, b = len(y), np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, steps + 1):
        z = np.bincount(one[0], w[one[1]], n)
        error = 1 / n * (1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - y)
        change = swap_penalty * 2 / n * (z[owner] - np.bincount(two[0], w[two[1]], len(owner)))
        moved = error + np.bincount(owner, change, n)
        grad = np.bincount(one[1], moved[one[0]], width) - np.bincount(two[1], change[two[0]], width) + ridge * w
        grad = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Scorer:
    """Scores the texts of a record batch."""

    def __init__(self, model: Model):
        order = sorted(model.weights)
        self.place, self.weights, self.bias = {f: k for k, f in enumerate(order)}, np.array([model.weights[f] for f in order] or [0.0]), model.bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        place = self.place
        offsets, words = words_of(texts)
        coded = words.dictionary_encode()
        hits = [[k for f in word_features(w) if (k := place.get(f)) is not None] for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        codes = coded.indices.to_numpy()
        number = np.array([len(x) for x in hits], np.int64)
        at = np.nonzero(number[codes])[0] if len(codes) else np.empty(0, np.int64)
        own = codes[at]
        flat, first = np.array([k for x in hits for k in x], np.int64), np.cumsum(number) - number
        rows = np.repeat(np.searchsorted(offsets, at, "right") - 1, number[own])
        step = np.arange(len(rows)) - np.repeat(np.cumsum(number[own]) - number[own], number[own])
        found = np.unique(rows * len(self.weights) + flat[np.repeat(first[own], number[own]) + step])  # a feature counts once a text
        z = self.bias + np.bincount(found // len(self.weights), self.weights[found % len(self.weights)], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id and score in 0..1 over the whole text. Null texts are empty; rows stand for themselves."""
    scorer = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text")))], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(returning(run), "doc_id long, score double")


def keep_civil(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score under `limit`, with all their columns; null texts are empty, repeated rows are judged alike."""
    scorer = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                yield batch.filter(pa.array(scorer(batch.column("text")) < limit))

    return docs.mapInArrow(returning(run), docs.schema)


def held_out() -> Column:
    """The fifth of the documents, by a checksum of doc_id, whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
