"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a linear model over which features a document has: its words and their first four
and five letters.  It is trained with numpy on confirmed toxic documents and unlabelled text.  With
the class prior p, the risk of "not toxic" is that of the unlabelled text less p times that of the
toxic documents; where that estimate turns negative the model is fitting the unlabelled sample itself,
and the step goes back up instead (the non-negative correction).

The bounded part is the training sample (``sample`` documents of each kind, chosen by a hash of the
id); every document is scored over its whole text.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from listwatch.llm.common import CACHE_WORDS

#: Characters stripped from both ends of a word.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def fold_of(column: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id is in fold 0, which no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)), F.lit(0))


class Features(dict):
    """Feature numbers of a word, remembered per worker process: hashes of the word and of two beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS // 2:
            self.clear()
        core = word.strip(MARKS)
        names = {f"4{core[:4]}", f"5{core[:5]}", f"w{core}"} if len(core) > 3 else {f"w{core}"} if core else ()
        self[word] = value = tuple(zlib.crc32(n.encode()) for n in names)
        return value


FEATURES = Features()


def document_features(text: str | None) -> list[int]:
    found: set[int] = set()
    for word in set((text or "").lower().split()):
        found.update(FEATURES[word])
    return sorted(found)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


@dataclass(frozen=True)
class Model:
    """Weights of the features that the model knows, by feature number in ascending order."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def weight_of(self) -> dict[int, float]:
        return dict(zip(self.known.tolist(), self.weights.tolist()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class ToxicityTrainer:
    """Parameters: at most about ``sample`` documents of each kind, ``width`` features, Adam steps.

    Labels that are null are unlabelled.  Ids that are null or repeated are allowed.  Without the text of a toxic
    example the model has no features and finds nothing toxic.
    """

    sample: int = 12_000
    width: int = 20_000
    least: int = 4
    epochs: int = 60
    batch: int = 2_048
    rate: float = 0.05
    decay: float = 1e-3
    id: str = "doc_id"
    text: str = "text"

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
        """Learn from the rows outside fold 0; labels inside it are never read."""
        rows = docs.select(F.col(self.id).alias("id"), F.col(self.text).alias("text")).where(fold_of("id") != 0)
        marks = (labels.select(F.col(self.id).alias("id"), F.col(label).alias("label"))
                 .where((fold_of("id") != 0) & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label")))
        known, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not toxic:
            return Model(np.empty(0, np.uint32), np.empty(0), -20.0)
        # Both samples are bounded: a share of the ids, by hash, that gives `sample` rows.
        wanted = marks.where("label = 1").where(self._share(toxic)).select("id")
        positive = self._collect(rows.join(F.broadcast(wanted), "id", "left_semi"), None)
        if not positive:
            return Model(np.empty(0, np.uint32), np.empty(0), -20.0)
        pos, n = np.unique(np.concatenate(positive), return_counts=True)
        pos = pos[n >= self.least]
        unlabelled = self._collect(rows.where(self._share(rows.count())), pos)
        return self._train([d[among(d, pos)] for d in positive], unlabelled, toxic / known)

    def _share(self, rows: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(min(1.0, self.sample / max(1, rows)) * (1 << 30))

    def _collect(self, rows: DataFrame, wanted: np.ndarray | None) -> list[np.ndarray]:
        """Features of the sampled documents (only the ``wanted`` ones), four bytes each."""
        def featurise(batches):
            for pdf in batches:
                found = [np.array(document_features(t), np.uint32) for t in pdf["text"]]
                if wanted is not None:
                    found = [f[among(f, wanted)] for f in found]
                yield pd.DataFrame({"f": [f.tobytes() for f in found]})

        # Sorted, so that the order of the rows does not reach the training.
        found = sorted(r["f"] for r in rows.mapInPandas(featurise, "f binary").collect())
        return [np.frombuffer(f, np.uint32) for f in found]

    def _train(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
        # Features that toxic documents have clearly more often than the unlabelled text.
        pos, n_pos = np.unique(np.concatenate(positive), return_counts=True)
        un, n_un = np.unique(np.concatenate([*unlabelled, np.empty(0, np.uint32)]), return_counts=True)
        at = np.minimum(np.searchsorted(un, pos), max(0, len(un) - 1))
        seen = np.where(un[at] == pos, n_un[at], 0) if len(un) else np.zeros(len(pos))
        lift = (n_pos / len(positive)) / ((seen + 1) / (len(unlabelled) + 1))
        best = np.argsort(-(np.log(lift) * n_pos), kind="stable")
        best = best[lift[best] >= 0.5 / prior][: self.width]
        known = np.sort(pos[best])
        if not len(known):
            return Model(known, np.empty(0), -20.0)

        def rows_of(docs):
            inside = [np.searchsorted(known, d[among(d, known)]) for d in docs]
            return inside, np.array([len(x) for x in inside])

        (p_rows, p_len), (u_rows, u_len) = rows_of(positive), rows_of(unlabelled)
        w, m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
        rng, step = np.random.default_rng(17), 0

        def gradient(rows, lengths, pick, sign):
            """Mean logistic loss for target ``sign`` and its gradient; the bias is the last weight."""
            flat = np.concatenate([rows[i] for i in pick]) if len(pick) else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(pick)), lengths[pick])
            z = np.bincount(doc, w[flat], len(pick)) + w[-1]
            loss = np.logaddexp(0, -sign * z).mean()
            d = -sign * _sigmoid(-sign * z) / len(pick)
            g = np.bincount(flat, d[doc], len(w))
            g[-1] = d.sum()
            return loss, g

        # An epoch is a pass over the unlabelled text, at least ten steps.
        steps = self.epochs * max(10, -(-len(u_rows) // self.batch))
        for step in range(1, min(steps, 3000) + 1):
            p_pick = rng.integers(0, len(p_rows), min(self.batch, len(p_rows)))
            _, g_toxic = gradient(p_rows, p_len, p_pick, 1.0)
            l_not, g_not = gradient(p_rows, p_len, p_pick, -1.0)
            u_pick = rng.integers(0, len(u_rows), min(self.batch, len(u_rows)))
            l_un, g_un = gradient(u_rows, u_len, u_pick, -1.0)
            if l_un - prior * l_not >= 0:
                g = prior * g_toxic + g_un - prior * g_not
            else:
                g = prior * g_not - g_un
            g[:-1] += self.decay * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= self.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return Model(known, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """id and score, the probability of toxic, per row; with ``keep`` all columns of ``docs`` and ``_score``.

    Null and empty texts have no features and get the score of the bias.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weight_of()), model.bias

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        weight = weights.value
        sums = [bias + sum(weight.get(f, 0.0) for f in document_features(t)) for t in texts]
        return pd.Series(_sigmoid(np.array(sums, float)))

    if keep:
        return docs.withColumn("_score", rate(F.col(text)))
    return docs.select(F.col(id), rate(F.col(text)).alias("score"))
