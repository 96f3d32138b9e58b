"""Event studies, evaluation of extractions, and tables of specifications."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.operators import similarity
from tasklattice.plans.lineage import cut


def spec_suffix(df: DataFrame, columns: list[str], pct: str, ce: str) -> DataFrame:
    """``pct_20`` and ``ce_0.8`` become ``_p20_ce08`` behind the columns."""
    tail = "_p" + pct.split("_")[1] + "_ce" + ce.split("_")[1].replace(".", "")
    return df.withColumnsRenamed({c: c + tail for c in columns})


def spec_select(df: DataFrame, tail: str) -> DataFrame:
    """The columns of one specification without their ending, and those that
    belong to none."""
    other = re.compile(r"_p\d+_ce\d+$")
    keep = [(c, c[: -len(tail)]) for c in df.columns if c.endswith(tail)] + [(c, c) for c in df.columns if not other.search(c)]
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in keep])


def wide_by_spec(long: DataFrame, keys: list[str], specs: list[str], value: str) -> DataFrame:
    """One column for each named specification, 0 where it has no row."""
    return long.groupBy(*keys).pivot("spec", specs).agg(F.first(value)).na.fill(0.0, specs)


def counts_to_scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 1 where nothing was to find and nothing found."""
    empty = (tp + fp + fn) == 0
    p = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0)))
    r = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0)))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def document_scores(gold: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """(key, tp, fp, fn, precision, recall, f1) from sets of items by document."""
    g, f = gold.select(key, item).distinct().withColumn("g", F.lit(1)), found.select(key, item).distinct().withColumn("f", F.lit(1))
    both = g.join(f, [key, item], "full").groupBy(key).agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p, r, f1 = counts_to_scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def best_threshold(scores: DataFrame, score: str, gold: str, grid: list[float]) -> DataFrame:
    """The cut of ``grid`` with the best F1 against a boolean column (the lowest
    of equals)."""
    marks = F.array(*[F.struct(F.lit(t).alias("cut"), (F.col(score) >= t).alias("hit")) for t in grid])
    long = scores.select(gold, F.explode(marks).alias("m")).select(gold, "m.*")
    n = long.groupBy("cut").agg(F.count_if(F.col("hit") & F.col(gold)).alias("tp"), F.count_if(F.col("hit") & ~F.col(gold)).alias("fp"), F.count_if(~F.col("hit") & F.col(gold)).alias("fn"))
    p, r, f1 = counts_to_scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.withColumn("f1", f1).orderBy(F.desc(F.round("f1", 9)), "cut").limit(1).select("cut", "f1")


def event_design(rows: DataFrame, time: str, treated: str, window: int, base: int = -1) -> tuple[DataFrame, list[str]]:
    """Dummies of event time for treated rows, without the base period."""
    cols = {f"t_{'m' if t < 0 else 'p'}{abs(t)}": ((F.col(time) == t) & F.col(treated)).cast("double") for t in range(-window, window + 1) if t != base}
    return rows.withColumns(cols), list(cols)


def long_difference(rows: DataFrame, entity: str, year: str, value: str, length: int) -> DataFrame:
    """(entity, cohort, change): the value ``length`` years after a cohort's year
    less that of the year before it."""
    at = lambda shift, name: rows.select(entity, (F.col(year) + shift).alias("cohort"), F.col(value).alias(name))
    return at(1, "before").join(at(-length, "after"), [entity, "cohort"]).select(entity, "cohort", (F.col("after") - F.col("before")).alias("change"))


def ntile_edges(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Rows with ``bin`` 1..n by quantile edges (right-closed, not equal counts)."""
    e = rows.agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("_e"))
    b = F.lit(1)
    for i in range(n - 1):
        b = b + (F.col(value) > F.col("_e")[i]).cast("int")
    return rows.crossJoin(F.broadcast(e)).withColumn("bin", b).drop("_e")


def _near(a: np.ndarray, ua: np.ndarray, c: np.ndarray, uc: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a cosine of ``threshold``, sorted."""
    at = np.flatnonzero((ua @ uc.T).ravel() >= threshold - similarity.rounding(a.shape[1]))
    i, j = np.divmod(at, len(c))
    keep = similarity.exact_cosines(a, i, c, j) >= threshold
    return i[keep], j[keep]


def _first_near(a: np.ndarray, ua: np.ndarray, c: np.ndarray, uc: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``a`` that have a row of ``c`` near, and the first of these."""
    rows, firsts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, similarity.TILE // max(1, len(c)))
    for s in range(0, len(a) if len(c) else 0, step):
        i, j = _near(a[s : s + step], ua[s : s + step], c, uc, threshold)
        i, first = np.unique(i, return_index=True)
        rows.append(i + s)
        firsts.append(j[first])
    return np.concatenate(rows), np.concatenate(firsts)


def first_fit(x: np.ndarray, threshold: float, taken: np.ndarray, block: int = 1024) -> np.ndarray:
    """For each row, in order, the first earlier representative that is near, or
    itself, which makes it one; -1 for the rows ``taken``, which take no part."""
    own = np.arange(len(x))
    own[taken] = -1
    u, heads = similarity.units(x), np.empty(0, np.int64)
    for s in range(0, len(x), block):
        new = s + np.flatnonzero(own[s : s + block] >= 0)
        i, j = _first_near(x[new], u[new], x[heads], u[heads], threshold)
        own[new[i]] = heads[j]
        new = new[own[new] == new]
        i, j = _near(x[new], u[new], x[new], u[new], threshold)
        near = np.zeros((len(new), len(new)), dtype=bool)
        near[i[j < i], j[j < i]] = True
        open_ = np.ones(len(new), dtype=bool)
        for k in np.flatnonzero(near.any(axis=1)):
            hit = np.flatnonzero(near[k] & open_)
            if len(hit):
                own[new[k]], open_[k] = new[hit[0]], False
        heads = np.append(heads, new[open_])
    return own


def greedy_clusters(rows: DataFrame, group: str, key: str, vec: str, threshold: float, numbers: int = 1 << 21) -> DataFrame:
    """(key, representative): in the order of the keys each vector joins the first
    representative of its group with a cosine of ``threshold`` (above zero), or
    becomes one. Vectors of other lengths are another group. Keys must not be null.

    Groups are cut by their keys into blocks of about ``numbers`` numbers. Blocks
    are settled one after the other, those of all groups at a time: a block meets
    the representatives of the blocks before it, of which each file is a task, and
    what is left of it is settled in one task. Representatives are kept in files; a
    task holds one block and one file of them.
    """
    spark = rows.sparkSession
    kg = rows.schema[key].dataType.simpleString()
    kind = np.float64 if "double" in rows.schema[vec].dataType.simpleString() else np.float32
    name = F.concat_ws(" ", F.size(vec).cast("string"), F.to_json(F.struct(group)))
    own = rows.filter(F.col(vec).isNotNull()).select(name.alias("g"), F.col(key).alias("k"), F.col(vec).alias("v"), F.size(vec).alias("dim"))
    # Where the blocks of groups begin that have more than one; only keys are sorted.
    place = F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1
    begin = own.select("g", "dim", "k").withColumn("place", place).filter(F.col("place") % F.greatest(F.lit(1), F.floor(F.lit(numbers) / F.greatest("dim", F.lit(1)))) == 0)
    starts = begin.groupBy("g").agg(F.collect_list("k").alias("starts")).filter(F.size("starts") > 1)
    block = F.when(F.col("starts").isNull(), 0).otherwise(F.greatest(F.lit(0), F.size(F.filter("starts", lambda x: x <= F.col("k"))) - 1))

    def cell(v: np.ndarray) -> pa.Array:
        """One long cell. Arrow cuts those of pandas into chunks, which Spark refuses."""
        return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))

    def pack(rows: pa.Table) -> pa.Table:
        pdf = rows.to_pandas().sort_values("k", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(kind)
        return pa.table({"g": pa.array([pdf["g"].iloc[0]]), "dim": pa.array([x.shape[1]], pa.int32()), "block": pa.array([pdf["block"].iloc[0]], pa.int32()), "ids": cell(pdf["k"].to_numpy()), "x": pa.array([x.tobytes()], pa.binary())})

    blocks = own.join(F.broadcast(starts), "g", "left").select("g", "k", "v", block.cast("int").alias("block"))
    packed = cut(blocks.groupBy("g", "block").applyInArrow(pack, f"g string, dim int, block int, ids array<{kg}>, x binary"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(pa.RecordBatch.to_pandas, batches):
            for g, dim, heads, hx, x in zip(b["g"], b["dim"], b["heads"], b["hx"], b["x"], strict=True):
                a, c = (np.frombuffer(z, kind).reshape(-1, dim) if dim else np.empty((0, 0)) for z in (x, hx))
                i, j = _first_near(a, similarity.units(a), c, similarity.units(c), threshold)
                yield pa.record_batch({"g": pa.array([g] * len(i), pa.string()), "at": pa.array(i, pa.int64()), "head": pa.array(heads[j])})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(pa.RecordBatch.to_pandas, batches):
            for g, dim, ids, x, at, head in zip(b["g"], b["dim"], b["ids"], b["x"], b["at"], b["head"], strict=True):
                a = np.frombuffer(x, kind).reshape(len(ids), dim)
                at = np.empty(0, np.int64) if at is None else at
                mine = first_fit(a, threshold, at)
                to = ids[mine]
                if len(at):
                    to[at] = head
                first = np.flatnonzero(mine == np.arange(len(ids)))
                yield pa.record_batch({"g": pa.array([g]), "dim": pa.array([dim], pa.int32()), "ids": cell(ids), "to": cell(to), "heads": cell(ids[first]), "hx": pa.array([a[first].tobytes()], pa.binary())})

    files: list[str] = []
    done = None
    sizes = packed.groupBy("block").agg(F.sum(F.length("x"))).collect()
    for n, size in sorted(map(tuple, sizes)):
        now = packed.filter(F.col("block") == n)
        small = F.broadcast if size <= similarity.SENT else lambda x: x
        if done is None:
            now = now.withColumns({"at": F.lit(None).cast("array<bigint>"), "head": F.lit(None).cast(f"array<{kg}>")})
        else:
            heads = spark.read.schema(done.schema).parquet(*files).select("g", "heads", "hx")
            found = heads.join(small(now.select("g", "dim", "x")), "g").mapInArrow(find, f"g string, at bigint, head {kg}")
            hits = found.groupBy("g", "at").agg(F.min("head").alias("head")).groupBy("g").agg(F.collect_list(F.struct("at", "head")).alias("hits")).select("g", "hits.at", "hits.head")
            now = now.join(small(hits), "g", "left")
        done = cut(now.select("g", "dim", "ids", "x", "at", "head").mapInArrow(settle, f"g string, dim int, ids array<{kg}>, to array<{kg}>, heads array<{kg}>, hx binary"))
        files += done.inputFiles()
    if done is None:
        return rows.limit(0).select(key, F.col(key).alias("representative"))
    pairs = spark.read.schema(done.schema).parquet(*files).select(F.explode(F.arrays_zip("ids", "to")).alias("p"))
    return pairs.select(F.col("p.ids").alias(key), F.col("p.to").alias("representative"))


def one_per_version(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The earliest version of each key; versions like 9.1 and 10.0 by number."""
    parts = F.split(version, r"\.")
    order = [parts[0].cast("int"), F.try_element_at(parts, F.lit(2)).cast("int")]
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
