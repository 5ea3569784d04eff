"""Toxicity by class-conditional Kneser-Ney models of words as letter sequences.

For each class (toxic, ordinary) a model gives P(letter | the word up to it) from the class's own counts; what it
discounts goes to a backoff distribution that both classes share, made of continuation counts over all documents (how
many different letters stand before a gram), order by order. Where neither class has seen the word so far the two
models agree, so rare expressions count for nothing by themselves, while the stems of toxic words carry over to words
never seen.

A text's score compares the two log-likelihoods, normalised by its length: the log-ratio per word of the whole text,
that of its most suspicious word, and what clearly toxic words add up to over the root of the length. A logistic curve
turns the three into a probability. Class counts and curve come from disjoint parts of the labelled rows.

The word up to a letter is its context for ``LONGEST`` letters; from there on the context is the last ORDER - 1 letters, so that
all of a long word or of a run in a script without spaces counts.

Bounds: at most ``TEACH_ROWS`` labelled rows of each class teach, in hash order; the model keeps every gram of theirs, so
its size follows from that sample. It is held as sorted 64-bit hashes with a float each, 12 bytes a gram, by the driver
and the workers. The shared counts cover all documents.

Stated cases: a null text scores as an empty one, by the curve's value for no evidence; rows without an id or with a
null label teach nothing, nor do ids with contradicting labels; of several texts under one labelled id the smallest teaches;
with one class missing every score is the share of the class seen; repeated rows score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from probatum.llm.common import col, slices, typed
from probatum.session import cut_lineage

ORDER = 5  # letters of the grams behind the shared counts
LONGEST = 16  # letters of a word that are context as a whole
DISCOUNT = 0.75
START, STOP, LATER = "\x02", "\x03", "\x04"  # marks of a word's ends, and of grams behind its first LONGEST letters
TEACH_ROWS = 10_000
CLEAR = 2.0  # log-ratio of a word beyond which it is evidence by itself
WORDS_AT_ONCE = 200_000  # distinct words held by a task
FEATURES = ["mean", "peak", "evidence"]
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _grams(word: bytes) -> list[str]:
    """The letter grams of a word between its marks."""
    w = START * (ORDER - 1) + word.decode("utf-8", "surrogatepass") + STOP
    return [w[i : i + ORDER] for i in range(len(w) - ORDER + 1)]


def corpus_grams(docs: DataFrame) -> DataFrame:
    """The distinct grams of the highest order in all documents. Tasks drop repeats before the shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()

        def grams() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list({g for w in held for g in _grams(w)}), pa.string())], names=["gram"])

        for batch in slices(batches, -1):
            for text in batch.column(batch.num_columns - 1).to_pylist():
                held.update(split_words(text))
            if len(held) > WORDS_AT_ONCE:
                yield grams()
                held = set()
        yield grams()

    return docs.select("text").mapInArrow(work, "gram string").distinct()


def class_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): how often words of each class begin with a gram, or hold it behind their first letters."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def words() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "surrogatepass") + STOP for w in held], pa.string()), *(pa.array([n[k] for n in held.values()], pa.int64()) for k in (1, 0))],
                names=["word", "toxic", "ordinary"])

        for batch in slices(batches, -1):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in split_words(text):
                    held.setdefault(w, [0, 0])[label] += 1
            if len(held) > WORDS_AT_ONCE:
                yield words()
                held = {}
        yield words()

    counts = (labelled.select("label", "text").mapInArrow(work, "word string, toxic bigint, ordinary bigint")
              .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    prefix = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    places = F.when(F.length("word") > LONGEST, F.sequence(F.lit(LONGEST + 1), F.length("word"))).otherwise(F.array().cast("array<int>"))
    later = F.transform(places, lambda n: F.concat(F.lit(LATER), F.substring(F.col("word"), n - ORDER + 1, F.lit(ORDER))))
    return (counts.select(F.explode(F.concat(prefix, later)).alias("gram"), "toxic", "ordinary")
            .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))


def _context(gram: Column, order: int) -> Column:
    return F.substring(gram, 1, order - 1)


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(tail, p): Kneser-Ney probability of a gram's last letter given the rest, for every gram of order ORDER - 1."""
    lower = None
    sets = [grams]
    for k in range(ORDER - 1, 0, -1):
        sets.append(sets[-1].select(F.substring("gram", 2, k).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("before")))
        sets[-1] = cut_lineage(sets[-1])
    for k in range(1, ORDER):
        level = sets[ORDER - k].withColumn("context", _context(F.col("gram"), k))
        totals = level.groupBy("context").agg(F.sum("before").alias("total"), F.count(F.lit(1)).alias("kinds"))
        level = level.join(totals, "context")
        own = F.greatest(F.col("before") - DISCOUNT, F.lit(0.0))
        if lower is None:
            p = F.col("before") / F.col("total")
        else:
            level = level.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower, "tail")
            p = (own + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")
        lower = level.select(F.col("gram").alias("tail"), p.alias("p"))
    return lower


Table = tuple[np.ndarray, np.ndarray]  # sorted hashes, values


def _table(rows: DataFrame, gram: str, value: Column) -> Table:
    """Hashes and values of a bounded table, gathered as Arrow."""
    found = rows.select(F.xxhash64(gram).alias("h"), value.cast("float").alias("r")).toArrow()
    keys, values = found.column("h").to_numpy(), found.column("r").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def log_ratios(docs: DataFrame, labelled: DataFrame) -> tuple[Table, Table]:
    """(gram to log-ratio, context to log-ratio of a letter seen by neither class after it). Bounded by the rows that teach."""
    counts = cut_lineage(class_counts(labelled).withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")))
    contexts = counts.groupBy("context").agg(
        *[F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "ordinary")])
    backoff = shared_backoff(cut_lineage(corpus_grams(docs)))
    table = (counts.join(contexts, "context").withColumn("tail", F.expr(f"right(concat('{START * (ORDER - 1)}', gram), {ORDER - 1})")).join(backoff, "tail"))

    def held_back(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

    def p(c: str) -> Column:
        own = F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(F.lit(0.0))
        return own + held_back(c) * F.col("p")

    return (_table(table, "gram", F.log(p("toxic") / p("ordinary"))),
            _table(contexts, "context", F.log(held_back("toxic") / held_back("ordinary"))))


def _look_up(table: Table, texts: list[bytes]) -> np.ndarray:
    """Values of the texts, by Spark's xxhash64 of them; nan where the table has none."""
    keys, values = table
    if not len(keys) or not texts:
        return np.full(len(texts), np.nan)
    digest = xxhash.xxh64_intdigest
    asked = np.fromiter([digest(t, 42) for t in texts], np.uint64, len(texts)).view(np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at].astype(float), np.nan)


class Scorer:
    """Log-ratios of words, cached."""

    def __init__(self, model: tuple[Table, Table]) -> None:
        self.grams, self.contexts = model
        self.cache: dict[bytes, float] = {}

    def learn(self, words: list[bytes]) -> None:
        """Put the log-ratios of new words into the cache. Their beginnings are looked up letter by letter, while the model has them."""
        marked = [w + STOP.encode() for w in words]
        # ends of the letters in bytes, for words that are not ASCII
        ends = [None if w.isascii() else [i + 1 for i in range(len(w)) if i + 1 == len(w) or w[i + 1] & 0xC0 != 0x80] for w in marked]
        totals = np.zeros(len(words))
        missed: list[bytes] = []
        owner: list[int] = []
        live = list(range(len(words)))
        for k in range(1, LONGEST + 1):
            live = [i for i in live if len(marked[i] if ends[i] is None else ends[i]) >= k]
            found = _look_up(self.grams, [marked[i][: k if ends[i] is None else ends[i][k - 1]] for i in live])
            gone = np.isnan(found)
            np.add.at(totals, live, np.where(gone, 0.0, found))
            for at in np.flatnonzero(gone).tolist():  # nor is any longer beginning of the word in the model
                i = live[at]
                missed.append(marked[i][: k - 1 if ends[i] is None else ([0] + ends[i])[k - 1]])
                owner.append(i)
            live = [i for i, x in zip(live, gone.tolist(), strict=True) if not x]
        later = [(i, t) for i, w in enumerate(marked) if len(w) > LONGEST for t in [w.decode("utf-8", "surrogatepass")] if len(t) > LONGEST]
        grams = [(i, (LATER + t[k - ORDER : k]).encode("utf-8", "surrogatepass"), (LATER + t[k - ORDER : k - 1]).encode("utf-8", "surrogatepass"))
                 for i, t in later for k in range(LONGEST + 1, len(t) + 1)]
        found = _look_up(self.grams, [g for _, g, _ in grams])
        np.add.at(totals, [i for i, _, _ in grams], np.nan_to_num(found))
        for at in np.flatnonzero(np.isnan(found)).tolist():
            missed.append(grams[at][2])
            owner.append(grams[at][0])
        np.add.at(totals, owner, np.nan_to_num(_look_up(self.contexts, missed)))
        self.cache.update(zip(words, totals.tolist(), strict=True))

    def word(self, w: bytes) -> float:
        if w not in self.cache:
            self.learn([w])
        return self.cache[w]

    def features(self, texts: list[str | None]) -> list[tuple[float, float, float]]:
        """Of each text the log-ratio per word, of the highest word, and the sum beyond CLEAR over the root of the number of words."""
        if len(self.cache) > WORDS_AT_ONCE:
            self.cache = {}
        split = [split_words(t) for t in texts]
        self.learn(list({w for words in split for w in words}.difference(self.cache)))
        cache, out = self.cache, []
        for words in split:
            x = np.array([cache[w] for w in words])
            out.append((float(x.mean()), float(x.max()), float(np.maximum(x - CLEAR, 0).sum() / np.sqrt(len(x)))) if words else (0.0, 0.0, 0.0))
        return out


_SCORERS: dict[str, Scorer] = {}  # one per Python worker, so that the cache outlives a task


def features(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """Columns ``keep``, then the three features."""
    name = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(model.value)
        scorer = _SCORERS[name]
        for batch in slices(batches, -1):
            found = scorer.features(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))], names=[*batch.schema.names[:-1], *FEATURES])

    source = docs.select(*map(col, keep), F.col("text").alias("__text"))
    schema = StructType([*source.schema.fields[:-1], *(StructField(f, DoubleType()) for f in FEATURES)])
    return source.mapInArrow(work, schema)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (one per feature, then the constant) of a logistic curve, by Newton steps with a small ridge."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def toxicity_scores(documents: DataFrame, labels: DataFrame, teach: Column, keep: list[str] | None = None) -> DataFrame:
    """All rows with ``score`` and ``predicted``.

    ``labels`` has doc_id and toxic; ``teach`` is a condition on doc_id that says which labelled rows may be learnt from.
    ``keep`` names the columns to carry along (default: doc_id).
    """
    docs = typed(documents, doc_id="bigint", text="string")
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & teach)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other"))
    turn = F.xxhash64("doc_id")
    known = (known.filter("label = 1").orderBy(turn, "doc_id").limit(TEACH_ROWS)
             .unionByName(known.filter("label = 0").orderBy(turn, "doc_id").limit(TEACH_ROWS)))
    part = F.crc32(F.concat(F.lit("curve"), F.col("doc_id").cast("string")).cast("binary")) % 3
    # twice TEACH_ROWS ids and labels at most
    labelled = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    model = documents.sparkSession.sparkContext.broadcast(log_ratios(docs, labelled.filter(part != 0)))
    seen = features(labelled.filter(part == 0), model, ["doc_id", "label"]).toPandas().sort_values("doc_id")
    x, y = seen[FEATURES].to_numpy(float), seen["label"].to_numpy(float)
    if len(set(y)) < 2:
        share = known.agg(F.coalesce(F.avg("label"), F.lit(0.5))).first()[0]
        w = np.array([0.0, 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))])
    else:
        w = fit_curve(x, y)
    names = keep or ["doc_id"]
    source = documents.select(*[col(n) for n in names if n != "text"], F.col("text").cast("string").alias("text"))
    z = F.lit(float(w[-1]))
    for k, f in enumerate(FEATURES):
        z = z + F.lit(float(w[k])) * F.col(f)
    score = 1 / (1 + F.exp(-z))
    return features(source, model, names).select(*map(col, names), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
