"""Sources mixed to target weights by iterative proportional fitting.

Documents are cells of source, language and topic. The tokens wanted from each
cell are raked: scaled in turn to the target of its source and to the marginals of
language and topic, which stay those of the corpus, under the cap that no
document is used more often than its source allows. A document is then drawn as
often as its cell's calibrated rate says, the fraction by systematic sampling
along the sizes, so that the tokens reached differ from the wanted ones by about
one document in each cell and bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.llm import languages, tokens
from tasklattice.llm.common import bounded_sample
from tasklattice.plans.lineage import cut

TOPICS, FEATURES = 8, 512
#: At most so many documents, by the hash of their id, are looked at for the
#: points the topics begin at; the topics themselves are fitted on all documents.
START = 2000
ROUNDS = 8
#: About so many documents of a cell are sampled in one ordered run.
BUCKET = 50_000
_WORD = re.compile(r"[^\W\d_]{4,}")


@lru_cache(500_000)
def _slot(word: str) -> int:
    return crc32(word.encode()) % FEATURES


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashed words of a text and their weights (the roots of their
    counts), of length one."""
    slots, n = np.unique(np.fromiter(map(_slot, _WORD.findall(text.lower())), dtype=np.uint16), return_counts=True)
    return slots, np.sqrt(n / max(1, n.sum())).astype(np.float32)


def dense(slots: list[bytes], weights: list[bytes]) -> np.ndarray:
    """The vectors of many documents as a matrix."""
    at, w = [np.frombuffer(x, dtype=np.uint16) for x in slots], np.frombuffer(b"".join(weights), dtype=np.float32)
    x = np.zeros((len(at), FEATURES), dtype=np.float32)
    if len(w):
        x[np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at)] = w
    return x


def far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows of ``x``, each as unlike those before it as possible."""
    x = x[x.any(axis=1)]
    if not len(x):
        return np.zeros((1, FEATURES), dtype=np.float32)
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack((centres, x[(x @ centres.T).max(axis=1).argmin()]))
    return centres


def topics(docs: DataFrame, k: int = TOPICS, rounds: int = ROUNDS, start: int = START) -> np.ndarray:
    """Centres of a spherical k-means over all ``docs`` (doc_id, slots, weights).
    Each round sums the vectors of every centre where the documents lie; the sums,
    ``k`` times ``FEATURES`` numbers at most, come to the driver."""
    centres = far_apart(dense(*zip(*((r.slots, r.weights) for r in bounded_sample(docs, start, "doc_id", docs.count())), strict=True)), k) if not docs.isEmpty() else np.zeros((1, FEATURES))

    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            total = np.zeros(centres.shape)
            for b in batches:
                x = dense(list(b["slots"]), list(b["weights"]))
                own = (x @ centres.T).argmax(axis=1)
                for i in range(len(centres)):
                    total[i] += x[own == i].sum(axis=0)
            i, j = np.nonzero(total)
            yield pd.DataFrame({"topic": i, "slot": j, "w": total[i, j]})

        new = np.zeros(centres.shape)
        for r in docs.select("slots", "weights").mapInPandas(sums, "topic int, slot int, w double").groupBy("topic", "slot").agg(F.sum("w").alias("w")).collect():
            new[r.topic, r.slot] = r.w
        empty = ~new.any(axis=1)
        new[empty] = centres[empty]
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-3:
            break
    return centres


def rake(have: np.ndarray, target: np.ndarray, cap: np.ndarray, total: float, rounds: int = 200) -> np.ndarray:
    """Tokens wanted of each cell. ``have``: tokens by source, language, topic;
    ``target``: share of each source, summing to 1; ``cap``: most uses of a
    document of each source. The sources' shares are met exactly wherever the
    caps allow; language and topic as nearly as they then can be."""
    most = have * cap[:, None, None]
    goal = target * total
    by_lang, by_topic = have.sum(axis=(0, 2)), have.sum(axis=(0, 1))
    by_lang, by_topic = by_lang / max(1, by_lang.sum()) * total, by_topic / max(1, by_topic.sum()) * total
    w = have.astype(float).copy()
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(b, dtype=float), where=b > 0)
    for _ in range(rounds):
        before = w.copy()
        w = np.minimum(w * ratio(by_lang, w.sum(axis=(0, 2)))[None, :, None], most)
        w = np.minimum(w * ratio(by_topic, w.sum(axis=(0, 1)))[None, None, :], most)
        for _ in range(50):  # the source's goal, what a cap takes away goes to its other cells
            w = np.minimum(w * ratio(goal, w.sum(axis=(1, 2)))[:, None, None], most)
            if np.all(np.abs(w.sum(axis=(1, 2)) - np.minimum(goal, most.sum(axis=(1, 2)))) <= 1e-9 * max(1.0, total)):
                break
        if np.abs(w - before).max() <= 1e-9 * max(1.0, total):
            break
    return w


def described(docs: DataFrame, sources: list[str], path: str) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of the documents of ``sources``
    that have tokens; languages and topics are found from the whole texts. Language
    prototypes are fitted on at most ``languages.SAMPLE`` documents with a label."""
    own = docs.filter(F.col("source").isin(sources) & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    profiles = languages.fitted_on(own, "doc_id", "text", "lang") if "lang" in docs.columns else languages.fit([])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "lang": [profiles.best(t)[0] for t in b["text"]], "n_tokens": [len(y) for y in tokens.encode(b["text"].tolist(), path)], "slots": [s.tobytes() for s, _ in x], "weights": [w.tobytes() for _, w in x]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = own.select("doc_id", "source", "text").mapInPandas(read, f"doc_id {kind}, source string, lang string, n_tokens int, slots binary, weights binary").filter("n_tokens > 0")
    # Repeated rows of a document count once, with its longest text.
    once = cut(seen.groupBy("doc_id", "source").agg(F.max(F.struct("n_tokens", "lang", "slots", "weights")).alias("x")).select("doc_id", "source", "x.*"))
    centres = topics(once)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "source", "lang", "n_tokens"]].assign(topic=(dense(list(b["slots"]), list(b["weights"])) @ centres.T).argmax(axis=1))

    return once.mapInPandas(assign, f"doc_id {kind}, source string, lang string, n_tokens int, topic int")


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, path: str = f"{tokens.FOLDER}/{tokens.TOKENIZER}") -> tuple[DataFrame, float]:
    """(doc_id, source, lang, topic, n_tokens, copies) of the documents used, and
    the tokens aimed at.

    ``targets`` has source, target_share and max_repeats and must be small: it and
    the table of cells (sources times languages times topics) come to the driver.
    Sources without documents give nothing, and the others keep their shares to
    each other. Documents of other sources, of none, or without tokens are not
    used. Without ``total`` the mixture is as large as all shares allow under the
    caps. No documents or no targets give no rows.
    """
    wanted = {r.source: (r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    spark = docs.sparkSession
    own = cut(described(docs, sorted(wanted), path))
    cells = own.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).orderBy("source", "lang", "topic").toPandas()
    sources = sorted(set(cells["source"]))
    shape = (len(sources), len(languages.LANGS), TOPICS)
    schema = "source string, lang string, topic int, rate double, buckets int"
    rates = spark.createDataFrame([], schema)
    if sources:
        have = np.zeros(shape)
        at = [(sources.index(s), languages.LANGS.index(k), t) for s, k, t in zip(cells["source"], cells["lang"], cells["topic"], strict=True)]
        for i, n in zip(at, cells["tokens"], strict=True):
            have[i] = n
        target = np.array([wanted[s][0] for s in sources], dtype=float)
        target /= target.sum()
        cap = np.array([wanted[s][1] for s in sources], dtype=float)
        largest = float((have.sum(axis=(1, 2)) * cap / target).min())
        total = min(total, largest) if total else largest
        w = rake(have, target, cap, total)
        rates = spark.createDataFrame([(sources[i], languages.LANGS[j], t, float(w[i, j, t] / have[i, j, t]), int(n // BUCKET) + 1) for (i, j, t), n in zip(at, cells["n"], strict=True)], schema)
    # The cells are fewer than sources x languages x topics, so they are broadcast.
    rated = own.join(F.broadcast(rates), ["source", "lang", "topic"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    run = Window.partitionBy("source", "lang", "topic", "bucket").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(1)), "doc_id")
    place = F.row_number().over(run)
    start = F.pmod(F.xxhash64("source", "lang", "topic", "bucket"), F.lit(1000)) / 1000.0
    up_to = lambda n: F.floor(n * F.col("rate") + start + 1e-9)
    drawn = rated.withColumn("place", place).withColumn("copies", (up_to(F.col("place")) - up_to(F.col("place") - 1)).cast("int"))
    return drawn.filter(F.col("copies") > 0).select("doc_id", "source", "lang", "topic", "n_tokens", "copies"), float(total or 0)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: its target, its share of the tokens used, the
    tokens, the documents, and the most copies of one."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.join(got, "source", "left").crossJoin(F.broadcast(all_)).select("source", "target_share", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("n_docs"), zero("most_copies"), "max_repeats")
