"""Toxicity: a linear classifier whose scores are regularised by counterfactuals.

Labelled sentences that hold a term of a group get counterfactual twins: each such term is swapped
for each other term of its kind. Training penalises the squared change of the logit between a
sentence and its twins. A mention as such then cannot move the score, while what is said can.

Terms come from a list of identity terms by kind, and from the labelled texts themselves: common
words that go with neither label and stand in the same texts as each other are a kind too. So the
penalty acts in corpora whose prose names none of the listed groups.

Features are words and, but for the terms, word beginnings, counted per text (log(1 + count)).
Those that tell the classes apart are chosen among the training sample's; how many, by the loss on
a fold of the training rows. Texts are read on executors only: the driver holds a bounded number of
counts for each of a bounded number of rows. Every row is scored on the executors.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpact.llm.bpe import groups
from sparkpact.llm.common import drop_saved, fold_of, saved

#: Labelled rows to learn from, at most. Their texts are taken whole.
SAMPLE_ROWS = 8_000
#: Numbers of features to choose from by the loss on training rows of this fold.
FEATURES = (500, 1_000, 2_000, 4_000)
CHECK_FOLD = 2
#: Common words that may become terms, and the share of texts that makes a word common.
STAND_INS = 256
COMMON_SHARE = 0.02
LEAST_TEXTS = 5
#: How alike the texts of two terms must be (cosine) to make them terms of one kind.
SAME_TEXTS = 0.5
#: Weight of the counterfactual term: this times rows times the mean squared change of a swap.
COUNTERFACTUAL = 500.0
#: Words a worker remembers the features of; bounds memory, not results.
MEMO_WORDS = 400_000

# Identity terms, by kind, in English, German, French and Spanish. Terms of a kind stand in for one another.
IDENTITY_TERMS = {
    "gender": ["man", "woman", "boy", "girl", "men", "women", "male", "female", "transgender", "nonbinary"],
    "gender, de": ["mann", "frau", "junge", "mädchen", "männer", "frauen", "männlich", "weiblich"],
    "gender, fr": ["homme", "femme", "garçon", "fille", "hommes", "femmes", "masculin", "féminin"],
    "gender, es": ["hombre", "mujer", "chico", "chica", "hombres", "mujeres", "masculino", "femenino"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    "orientation, de": ["schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"],
    "orientation, fr": ["gai", "lesbienne", "bisexuel", "hétérosexuel", "homosexuel"],
    "orientation, es": ["lesbiana", "bisexuales", "heterosexuales", "homosexuales"],
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "religion, de": ["christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch", "katholisch"],
    "religion, fr": ["chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"],
    "religion, es": ["cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"],
    "origin": ["african", "american", "asian", "european", "arab", "mexican", "chinese", "indian", "black", "white", "latino"],
    "origin, de": ["afrikanisch", "amerikanisch", "asiatisch", "europäisch", "arabisch", "mexikanisch", "chinesisch", "indisch"],
    "origin, fr": ["africain", "américain", "asiatique", "européen", "arabe", "mexicain", "chinois", "indien"],
    "origin, es": ["africano", "americano", "asiático", "europeo", "árabe", "mexicano", "chino", "indio"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
    "ability, de": ["taub", "behindert", "autistisch"],
    "ability, fr": ["aveugle", "sourd", "handicapé", "autiste"],
    "ability, es": ["ciego", "sordo", "discapacitado", "autista"],
    "age": ["young", "old", "elderly", "teenage"],
    "age, de": ["jung", "alt", "betagt"],
    "age, fr": ["jeune", "vieux", "âgé"],
    "age, es": ["joven", "viejo", "anciano"],
}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
BEGINNINGS = (4, 5, 6, 7, 8)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features_of(word: str, whole: frozenset[str] = frozenset()) -> list[str]:
    """A word, and its beginnings (marked by a hyphen); a term that is taken whole has none."""
    return [word] if word in whole else [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) >= k)]


class Counted:
    """Counts of a fixed set of features in texts."""

    def __init__(self, features: frozenset[str], whole: frozenset[str]) -> None:
        self.features, self.whole = features, whole
        self._memo: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_memo": {}}

    def live(self, word: str) -> tuple[str, ...]:
        found = self._memo.get(word)
        if found is None:
            found = tuple(f for f in features_of(word, self.whole) if f in self.features)
            if len(self._memo) > MEMO_WORDS:
                self._memo.clear()
            self._memo[word] = found
        return found

    def of(self, words: list[str]) -> dict[str, int]:
        memo, live = self._memo, self.live
        hits: dict[str, int] = defaultdict(int)
        for w in words:
            found = memo.get(w)
            for f in live(w) if found is None else found:
                hits[f] += 1
        return hits


class ToxicityModel:
    """A bias, a weight for the log length and a weight for each chosen feature.

    kinds: the terms that were swapped for one another. twins: how many counterfactual twins the
    fit has seen. moved: the root mean squared change of the logit over them.
    """

    def __init__(self, bias: float, length: float, weights: dict[str, float], kinds: list[list[str]] | None = None, twins: int = 0, moved: float = 0.0) -> None:
        self.bias, self.length, self.weights = bias, length, weights
        self.kinds, self.twins, self.moved = kinds or [], twins, moved
        self.counted = Counted(frozenset(weights), frozenset(t for kind in self.kinds for t in kind))

    def logit(self, text: str | None) -> float:
        words = words_of(text)
        return self.bias + self.length * np.log1p(len(words)) + sum(self.weights[f] * np.log1p(n) for f, n in sorted(self.counted.of(words).items()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -500, 500))))


def minimise(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 300, memory: int = 10) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    x, (f, g) = start, value_and_slope(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - y @ q / (s @ y))
        slope, step = g @ q, 1.0
        if slope <= 1e-12:
            break
        while True:
            x_new = x - step * q
            f_new, g_new = value_and_slope(x_new)
            if f_new <= f - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = x_new - x, g_new - g
        if abs(f - f_new) <= 1e-10 * max(1.0, abs(f)):
            return x_new
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        x, f, g = x_new, f_new, g_new
    return x


class Sparse:
    """A matrix by its filled places."""

    def __init__(self, n: int, width: int, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> None:
        self.n, self.width, self.row, self.col, self.val = n, width, row, col, val

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)

    def some(self, rows: np.ndarray) -> Sparse:
        """The rows that a mask picks."""
        place = np.cumsum(rows) - 1
        keep = rows[self.row]
        return Sparse(int(rows.sum()), self.width, place[self.row[keep]], self.col[keep], self.val[keep])

    def first(self, columns: int) -> Sparse:
        """Without the columns from there on, but for the last two."""
        keep = (self.col < columns) | (self.col >= self.width - 2)
        col = self.col[keep]
        return Sparse(self.n, columns + 2, self.row[keep], np.where(col >= self.width - 2, col - self.width + columns + 2, col), self.val[keep])


def regression(x: Sparse, y: np.ndarray, change: Sparse, often: np.ndarray, l2: float, counterfactual: float, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression with an L2 term and the counterfactual term: rows of change
    are what a swap does to the features, often how often it was made."""
    ridge = np.full(x.width, l2)
    ridge[-2:] = 1e-3
    pull = counterfactual * x.n * often / max(1.0, often.sum())

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        moved = change.times(w)
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum() + 0.5 * (pull * moved) @ moved
        return float(value), x.back(p - y) + ridge * w + change.back(pull * moved)

    return minimise(loss, np.zeros(x.width), rounds)


# -- the training sample, read on executors -------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(label, checked, text) of at most so many labelled texts outside fold 0, chosen by the hash
    of their id; whole texts. checked: the row's fold is CHECK_FOLD.

    Ids are drawn from the labels first; that list is bounded by rows, and so may be broadcast.
    Labels of one id that differ: the larger. Texts of one id that differ: the first in order.
    """
    wanted = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col(id_col)) != 0))
    ids = wanted.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    found = docs.select(id_col, F.col(text_col).alias("sample_text")).join(F.broadcast(ids), id_col)
    each = found.groupBy(id_col).agg(F.min("sample_text").alias("text"), F.max("label").alias("label"))
    return each.select("label", (fold_of(F.col(id_col)) == CHECK_FOLD).alias("checked"), "text")


def feature_table(sample: DataFrame) -> DataFrame:
    """(feature, word, with_label, without): in how many texts of either label a feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[label].update({f for w in set(words_of(text.as_py())) for f in features_of(w)})
        names = [*{*seen[0], *seen[1]}]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["feature", "with_label", "without"])

    parts = sample.select("label", "text").mapInArrow(run, "feature string, with_label long, without long")
    return parts.groupBy("feature").agg(F.sum("with_label").alias("with_label"), F.sum("without").alias("without")).withColumn("word", ~F.col("feature").endswith("-"))


def rows_table(sample: DataFrame, at: dict[str, int], whole: frozenset[str], named: list[str]) -> DataFrame:
    """(label, checked, n_words, features, times, named) of each text: the numbers and counts of the
    chosen features, and the numbers of the named words that it holds."""
    sent = sample.sparkSession.sparkContext.broadcast((at, Counted(frozenset(at), whole), {w: k for k, w in enumerate(named)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counted, number = sent.value
        for batch in batches:
            sizes, features, times, held = [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                hits = counted.of(words)
                sizes.append(len(words))
                features.append([place[f] for f in hits])
                times.append([*hits.values()])
                held.append([number[w] for w in set(words).intersection(number)])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (features, times, held)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), *lists], ["label", "checked", "n_words", "features", "times", "named"])

    return sample.select("label", "checked", "text").mapInArrow(run, "label int, checked boolean, n_words int, features array<int>, times array<int>, named array<int>")


def swap_tallies(texts: Iterator[str | None], kinds: list[list[str]]) -> Counter:
    """How many sentences have term a so often and another term b of its kind so often: keys
    (kind, a, times of a, b, times of b); b = -1 counts all sentences with a."""
    kind_of = {t: (k, n) for k, kind in enumerate(kinds) for n, t in enumerate(kind)}
    out: Counter = Counter()
    for text in texts:
        for sentence in SENTENCE.split(text.lower()) if text else ():
            found: dict[int, dict[int, int]] = {}
            for w in WORD.findall(sentence):
                if w in kind_of:
                    k, n = kind_of[w]
                    own = found.setdefault(k, {})
                    own[n] = own.get(n, 0) + 1
            for k, own in found.items():
                for a, n in own.items():
                    out[k, a, n, -1, 0] += 1
                    for b, m in own.items():
                        if a != b:
                            out[k, a, n, b, m] += 1
    return out


def swap_table(sample: DataFrame, kinds: list[list[str]]) -> DataFrame:
    columns = ["kind", "a", "a_times", "b", "b_times", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = swap_tallies((t.as_py() for batch in batches for t in batch.column(0)), kinds)
        yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in found], pa.int32()) for c in range(5)] + [pa.array([*found.values()], pa.int64())], columns)

    each = sample.select("text").mapInArrow(run, "kind int, a int, a_times int, b int, b_times int, n long")
    return each.groupBy(columns[:-1]).agg(F.sum("n").alias("n")).orderBy(columns[:-1])


# -- fitting ---------------------------------------------------------------------------------------


def kinds_by_texts(words: list[str], held: np.ndarray, alike: float = SAME_TEXTS) -> list[list[str]]:
    """Words, most common first, put into kinds by the texts they stand in: each joins the kind to
    whose words it is most alike on average, if that is enough, or opens one. Kinds of one word go.
    held: texts x words, 0 or 1."""
    size = np.maximum(1.0, np.sqrt(held.sum(axis=0)))
    near = (held.T @ held) / size[:, None] / size
    kinds: list[list[int]] = []
    for k in range(len(words)):
        best = max(((near[k, own].mean(), -n) for n, own in enumerate(kinds)), default=(0.0, 0))
        if best[0] >= alike:
            kinds[-best[1]].append(k)
        else:
            kinds.append([k])
    return [[words[k] for k in own] for own in kinds if len(own) > 1]


def changes(tallies: list[tuple[int, int, int, int, int, int]], kinds: list[list[str]], at: dict[str, int], width: int) -> tuple[Sparse, np.ndarray]:
    """What each swap does to the features, and how often it is made: every term of a sentence for
    every other term of its kind."""
    col: list[int] = []
    val: list[float] = []
    often: list[int] = []

    def add(kind: int, a: int, a_times: int, b: int, b_times: int, n: int) -> None:
        x, y = (at[kinds[kind][t]] for t in (a, b))
        col.extend((x, y))
        val.extend((float(np.log1p(a_times)), float(np.log1p(b_times) - np.log1p(b_times + a_times))))
        often.append(n)

    alone: dict[tuple[int, int, int], int] = {}
    beside: dict[tuple[int, int, int], Counter] = defaultdict(Counter)
    for kind, a, a_times, b, b_times, n in tallies:
        if b < 0:
            alone[kind, a, a_times] = n
        else:
            beside[kind, a, a_times][b] += n
            add(kind, a, a_times, b, b_times, n)
    for (kind, a, a_times), n in alone.items():
        for b in range(len(kinds[kind])):
            left = n - beside[kind, a, a_times][b]
            if b != a and left:
                add(kind, a, a_times, b, 0, left)
    return Sparse(len(often), width, np.repeat(np.arange(len(often)), 2), np.array(col, np.int64), np.array(val, float)), np.array(often, float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, l2: float = 0.5, counterfactual: float = COUNTERFACTUAL, terms: dict[str, list[str]] | None = None, learn_terms: bool = True) -> ToxicityModel:
    """A model of the labels of rows outside fold 0, from at most so many of them.

    terms: identity terms by kind (IDENTITY_TERMS by default); those that the sample holds take
    part. learn_terms: also learn kinds of common label-neutral words.

    Null ids and labels take no part; null and empty texts are texts without words. One class only,
    or no rows: a constant model at that class's share (0 without rows).
    """
    sample = saved(training_sample(docs, labels, id_col, text_col, label_col, rows), "labelled")
    try:
        n1, n0 = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*") - F.coalesce(F.sum("label"), F.lit(0))).first()
        if not n1 or not n0:
            share = min(max(n1 / (n1 + n0) if n1 + n0 else 0.0, 0.01), 0.99)
            return ToxicityModel(float(np.log(share / (1 - share))), 0.0, {})
        return fitted(sample, n1, n0, l2, counterfactual, [*(IDENTITY_TERMS if terms is None else terms).values()], learn_terms)
    finally:
        drop_saved(sample)


def fitted(sample: DataFrame, n1: int, n0: int, l2: float, counterfactual: float, listed: list[list[str]], learn_terms: bool) -> ToxicityModel:
    # by how far the shares of texts with the feature lie apart, in standard errors
    n = F.col("with_label") + F.col("without")
    share = (n + 1) / (n1 + n0 + 2)
    gap = (F.col("with_label") / n1 - F.col("without") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    stats = saved(feature_table(sample).where(n >= 3).withColumn("gap", F.abs(gap)), "features")
    telling = [r[0] for r in stats.where("gap >= 2").orderBy(F.desc("gap"), "feature").select("feature").limit(max(FEATURES)).collect()]
    known = {t for kind in listed for t in kind}
    met = {r[0] for r in stats.where(F.col("feature").isin(sorted(known))).select("feature").collect()} if known else set()
    neutral = stats.where(F.col("word") & (F.col("gap") < 2) & (n >= max(LEAST_TEXTS, COMMON_SHARE * (n1 + n0)))).orderBy(F.desc(n), "feature").select("feature").limit(STAND_INS)
    common = [r[0] for r in neutral.collect() if r[0] not in known] if learn_terms else []
    drop_saved(stats)
    whole = frozenset({*known, *common})
    # telling features first, so that fewer of them are a part of the columns
    telling = [f for f in telling if f not in whole]
    extra = sorted({*met, *common})
    at = {f: k for k, f in enumerate([*extra, *telling])}
    table = rows_table(sample, at, whole, common).toArrow()
    held = np.zeros((table.num_rows, len(common)))
    held[list_rows(table["named"])] = 1.0
    kinds = [own for own in ([t for t in kind if t in met] for kind in listed) if len(own) > 1] + kinds_by_texts(common, held)
    width = len(at) + 2
    row, col = list_rows(table["features"])
    times = flat(table["times"])
    order = np.lexsort((col, row))  # sums do not depend on the order of a hash map
    m = np.arange(table.num_rows)
    size = np.log1p(table["n_words"].to_numpy())
    x = Sparse(len(m), width, np.concatenate([row[order], m, m]), np.concatenate([col[order], np.full(len(m), width - 2), np.full(len(m), width - 1)]), np.concatenate([np.log1p(times[order]), size, np.ones(len(m))]))
    y = table["label"].to_numpy().astype(float)
    change, often = changes([tuple(r) for r in swap_table(sample, kinds).collect()] if kinds else [], kinds, at, width)
    checked = table["checked"].to_numpy(zero_copy_only=False).astype(bool)
    wide = len(extra) + best_count(x, y, change, often, checked, len(extra), len(telling), l2, counterfactual)
    x, change = x.first(wide), change.first(wide)
    w = regression(x, y, change, often, l2, counterfactual)
    moved = float(np.sqrt((often * change.times(w) ** 2).sum() / often.sum())) if len(often) else 0.0
    return ToxicityModel(float(w[-1]), float(w[-2]), {f: float(w[k]) for f, k in at.items() if k < wide and w[k]}, kinds, int(often.sum()), moved)


def best_count(x: Sparse, y: np.ndarray, change: Sparse, often: np.ndarray, checked: np.ndarray, extra: int, telling: int, l2: float, counterfactual: float) -> int:
    """How many of the telling features do best on the checked training rows; ties to fewer."""
    choices = sorted({min(c, telling) for c in FEATURES})
    if len(choices) == 1 or len(set(y[checked])) < 2 or len(set(y[~checked])) < 2:
        return choices[-1]
    found = []
    for c in choices:
        own, swaps = x.first(extra + c), change.first(extra + c)
        z = own.some(checked).times(regression(own.some(~checked), y[~checked], swaps, often, l2, counterfactual, 60))
        found.append((float(np.logaddexp(0, z).sum() - y[checked] @ z), c))
    return min(found)[1]


def flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def list_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value of a column of lists."""
    whole = column.combine_chunks()
    return np.repeat(np.arange(len(whole)), whole.value_lengths().to_numpy(zero_copy_only=False)), flat(column)


# -- scoring ---------------------------------------------------------------------------------------


def scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out (fold 0: its labels were never seen), score and predicted of each whole text.

    Null and empty texts: scored as texts without words. Null ids count as the empty text for the
    fold. Repeated rows: one row each. Empty table: empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            values = [own.score(x) for texts in groups(batch.column(2)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], [id_col, "held_out", "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(id_col, (fold_of(F.col(id_col)) == 0).alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(x) < threshold for texts in groups(batch.column(at)) for x in texts], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
