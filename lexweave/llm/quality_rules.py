"""Quality rules with robust multivariate outliers.

Fixed rules fail a document first. For the others, each language and source
has a robust centre and scatter of transformed statistics: the minimum
covariance determinant, found by concentration steps from several starts over
all its documents; documents beyond a Mahalanobis distance are rejected. Those
of a small group are judged by the centre and scatter of their language, or of
all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded_batches, stored
from .words import IS_SEP, column, doc_slices, hash_windows, hash_words, mix, per_doc, whole

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(texts: pa.Array, repeat_window: int = 5) -> dict[str, np.ndarray]:
    """The statistics of whole texts, one array each; a null text has none (zeros)."""
    data, offs = column(texts)
    out = {k: [] for k in STATS}
    for i, j in doc_slices(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, starts, ends, first = hash_words(d, o)
        out["n_words"].append(np.diff(first))
        out["word_chars"].append(per_doc(((d & 0xC0) != 0x80) & ~IS_SEP[d], o))
        out["n_symbols"].append(per_doc(_SYMBOL[d], o))
        w = hash_windows(h, repeat_window)
        fits, doc = whole(first, repeat_window, len(w))
        keys = mix(w ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[fits]
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = np.flatnonzero(fits)[count[back] > 1]
        edge = np.zeros(len(h) + repeat_window + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + repeat_window, -1)
        out["n_repeat_words"].append(per_doc((np.cumsum(edge) > 0)[: len(h)], first))
    out.pop("n_dup_lines")
    dup = []
    for t in texts:
        t = t.as_py()
        lines = [x for x in t.split("\n") if x.strip(_BLANK)] if t and "\n" in t else ()
        dup.append(len(lines) - len(set(lines)))
    got = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    return {k: np.array(dup, np.int64) if k == "n_dup_lines" else got[k] for k in STATS}


def document_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and STATS of each row of ``docs``."""

    def stats(batches):
        for b in batches:
            s = text_stats(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(s[k]) for k in STATS)], ["doc_id", "lang", "source", *STATS])

    bounded_batches(docs.sparkSession)
    kept = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("text", "string"))]
    return docs.select(*kept).mapInArrow(stats, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in STATS))


#: Least standard deviations of the features below: rare events such as one repeated line are no outliers by themselves.
FLOORS = [0.02, 0.06, 0.04, 0.35, 0.08]
#: Standard deviations of the features over texts of all kinds: what a group of few documents is taken to vary by.
PRIOR = [1.0, 0.25, 0.1, 0.7, 0.2]


def _features() -> dict[str, F.Column]:
    """Transformed statistics: logarithms and square roots bring them near a normal shape."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x0": F.log1p("n_words"),
        "x1": F.log1p(F.col("word_chars") / n),
        "x2": F.sqrt(F.col("n_symbols") / n),
        "x3": F.log1p("n_dup_lines"),
        "x4": F.sqrt(F.col("n_repeat_words") / n),
    }


def mcd_outliers(
    rows: DataFrame,
    features: list[str],
    groups: list[str],
    support: float = 0.75,
    steps: int = 10,
    cutoff: float = 12.0,
    min_rows: int = 50,
    floors: list[float] | None = None,
    prior: list[float] | None = None,
    wider: tuple[list[str], ...] = (),
) -> DataFrame:
    """Adds ``distance`` and ``outlier`` by the minimum covariance determinant of each group.

    A row whose group has under ``min_rows`` rows is judged by the first of the
    groupings ``wider`` (``[]``: all rows) in which its group has as many, or by
    the last one; that group's estimate is of all its rows. A row with a null
    feature has a null distance and is no outlier.
    """
    levels = [groups, *wider]
    key = lambda names: [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names] or [F.lit("")]
    keys = [[f"__k{k}_{i}" for i in range(max(len(names), 1))] for k, names in enumerate(levels)]
    data = rows.withColumns({c: e for ks, names in zip(keys, levels) for c, e in zip(ks, key(names))})
    for k, ks in enumerate(keys[:-1]):
        data = data.join(stored(data.groupBy(*ks).agg(F.count("*").alias(f"__n{k}")), "sizes"), ks)
    level = F.coalesce(*(F.when(F.col(f"__n{k}") >= min_rows, F.lit(k)) for k in range(len(wider))), F.lit(len(wider)))
    data = stored(data.withColumn("__level", level), "levels") if wider else data.withColumn("__level", level)
    out = None
    for k, ks in enumerate(keys):
        needed = data.where(F.col("__level") == k).select(*ks).distinct()
        if k and not needed.limit(1).count():
            continue
        own = data.join(stored(needed, "groups"), ks, "left_semi") if wider else data
        judged = _distances(own, features, ks, support, steps, floors, prior).where(F.col("__level") == k)
        part = judged.select(*rows.columns, "distance", F.coalesce(F.col("distance") > cutoff, F.lit(False)).alias("outlier"))
        out = part if out is None else out.unionByName(part)
    return out


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _starts(data: DataFrame, centre: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Four first estimates of each group: ``keys, start``, means ``__m`` and inverse scatters ``__s`` about the median.

    0: the median with unit scatter, 1: the median with the quartiles' scales,
    2: mean and covariance of all rows, 3: the median with the covariance of
    directions, to which far rows add no more than near ones.
    """
    y = [F.col(f"__y{i}") for i in range(p)]
    norm = F.greatest(sum((v * v for v in y), F.lit(0.0)), F.lit(1e-12))
    sums = data.groupBy(*keys).agg(
        F.count("__y0").alias("__n"),
        *(F.sum(v).alias(f"__t{i}") for i, v in enumerate(y)),
        *(F.sum(y[i] * y[j]).alias(f"__t{i}_{j}") for i, j in _pairs(p)),
        *(F.sum(y[i] * y[j] / norm).alias(f"__d{i}_{j}") for i, j in _pairs(p)),
    )
    scales = centre.select(*keys, *(f"__w{i}" for i in range(p)))

    def run(batches):
        for b in batches:
            n = np.maximum(_numbers(b, "__n"), 1)
            square = lambda name: _square(b, name, p) / n[:, None, None]
            mean = _columns(b, "__t", p) / n[:, None]
            full = square("__t") - mean[:, :, None] * mean[:, None, :]
            scale = np.maximum(_columns(b, "__w", p), 1e-6)
            # Directions have no length: each axis takes the quartiles' scale.
            way = square("__d")
            way = way * (scale[:, :, None] * scale[:, None, :]) * p
            none = np.zeros_like(mean)
            eye = np.broadcast_to(np.eye(p), full.shape)
            tiny = 1e-9 * eye
            for start, (m, c) in enumerate([(none, eye), (none, eye * scale[:, :, None] ** 2), (mean, full + tiny), (none, way + tiny)]):
                yield _model(b, keys, np.full(len(n), start), m, np.linalg.pinv(c, hermitian=True), None)

    return stored(sums.join(scales, keys), "sums").mapInArrow(run, _model_schema(data, keys, p))


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(float)


def _columns(b: pa.RecordBatch, name: str, p: int) -> np.ndarray:
    return np.stack([_numbers(b, f"{name}{i}") for i in range(p)], 1)


def _square(b: pa.RecordBatch, name: str, p: int) -> np.ndarray:
    out = np.zeros((b.num_rows, p, p))
    for i, j in _pairs(p):
        out[:, i, j] = out[:, j, i] = _numbers(b, f"{name}{i}_{j}")
    return out


def _model(b: pa.RecordBatch, keys: list[str], start: np.ndarray, mean: np.ndarray, inverse: np.ndarray, log_det: np.ndarray | None) -> pa.RecordBatch:
    p = mean.shape[1]
    columns = {k: b.column(k) for k in keys} | {"start": pa.array(start.astype(np.int32))}
    columns["__q"] = pa.nulls(b.num_rows, pa.float64()) if log_det is None else pa.array(log_det)
    columns |= {f"__m{i}": pa.array(mean[:, i]) for i in range(p)} | {f"__s{i}_{j}": pa.array(inverse[:, i, j]) for i, j in _pairs(p)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _model_schema(data: DataFrame, keys: list[str], p: int) -> T.StructType:
    numbers = ["__q", *(f"__m{i}" for i in range(p)), *(f"__s{i}_{j}" for i, j in _pairs(p))]
    return T.StructType([*(data.schema[k] for k in keys), T.StructField("start", T.IntegerType()), *(T.StructField(x, T.DoubleType()) for x in numbers)])


def _distances(data: DataFrame, features: list[str], keys: list[str], support: float, steps: int, floors: list[float] | None, prior: list[float] | None) -> DataFrame:
    """Adds ``distance`` from the centre of the row's group; ``keys`` are not null.

    From each of the starts, concentration steps keep the ``support`` share of
    rows with the least distances (those at the cut count in part, so ties make
    it no larger) and take mean and covariance anew; the determinant cannot
    rise. They end when none falls any more, or after ``steps``; the start with
    the least determinant gives the estimate. Every step is two grouped
    aggregations over all rows, with one row a group and start from each task.
    Sums are kept about the median, so that they do not cancel. The square of a
    feature's floor (0.02 unless given) is added to its variance, and ``prior``
    deviations count like one row more than there are features.
    """
    p = len(features)
    pairs = _pairs(p)
    centre = data.groupBy(*keys).agg(*(F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"__a{i}") for i, c in enumerate(features)))
    centre = stored(centre.select(*keys, *(F.get(f"__a{i}", F.lit(1)).alias(f"__c{i}") for i in range(p)), *(((F.get(f"__a{i}", F.lit(2)) - F.get(f"__a{i}", F.lit(0))) / 1.349).alias(f"__w{i}") for i in range(p))), "centres")
    about = data.join(centre.drop(*(f"__w{i}" for i in range(p))), keys).withColumns({f"__y{i}": F.col(c) - F.col(f"__c{i}") for i, c in enumerate(features)})
    known = about.where(" and ".join(f"__y{i} is not null" for i in range(p)))
    model = stored(_starts(known, centre, keys, p), "mcd")

    def scored(rows: DataFrame, model: DataFrame) -> DataFrame:
        """A few rows a group are joined; Spark broadcasts them only below its own bound."""
        d = rows.join(model, keys, "left")
        z = [F.col(f"__y{i}") - F.col(f"__m{i}") for i in range(p)]
        return d.withColumn("__d2", sum(((1 if i == j else 2) * F.col(f"__s{i}_{j}") * z[i] * z[j] for i, j in pairs), F.lit(0.0)))

    def step(batches):
        for b in batches:
            below, at = _numbers(b, "__h"), np.maximum(_numbers(b, "__e"), 1)
            part = np.clip((np.ceil(support * _numbers(b, "__n")) - below) / at, 0, 1)
            n = np.maximum(below + part * at, 1)
            mean = (_columns(b, "__t", p) + part[:, None] * _columns(b, "__u", p)) / n[:, None]
            cov = (_square(b, "__t", p) + part[:, None, None] * _square(b, "__u", p)) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
            if prior:
                cov = (cov * n[:, None, None] + (p + 1) * np.diag(np.square(prior))) / (n[:, None, None] + p + 1)
            cov += np.diag(np.square(floors or [0.02] * p))
            yield _model(b, keys, _numbers(b, "start"), mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1])

    y = [F.col(f"__y{i}") for i in range(p)]
    inner, edge = F.col("__d2") < F.col("__cut"), F.col("__d2") == F.col("__cut")
    for _ in range(steps):
        s = scored(known, model)
        cut = stored(s.groupBy(*keys, "start").agg(F.percentile_approx("__d2", support, 1000).alias("__cut"), F.count("*").alias("__n")), "mcd")  # as a table of known size it needs no shuffle of the rows
        sums = s.join(cut, [*keys, "start"]).where("__d2 <= __cut").groupBy(*keys, "start", "__n").agg(
            F.count_if(inner).alias("__h"),
            F.count_if(edge).alias("__e"),
            *(F.sum(F.when(c, y[i]).otherwise(0.0)).alias(f"{name}{i}") for name, c in (("__t", inner), ("__u", edge)) for i in range(p)),
            *(F.sum(F.when(c, y[i] * y[j]).otherwise(0.0)).alias(f"{name}{i}_{j}") for name, c in (("__t", inner), ("__u", edge)) for i, j in pairs),
        )
        # Sums are written first: reading them takes a few tasks, not one a shuffle partition, with Python.
        new = stored(stored(sums, "sums").mapInArrow(step, model.schema), "mcd")
        was = model.select(*keys, "start", F.col("__q").alias("__was"))
        falls = new.join(was, [*keys, "start"]).where("__was is null or __was - __q > 1e-7").limit(1).count()
        model = new
        if not falls:
            break
    names = [c for c in model.columns if c not in keys]
    best = model.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("__q", "start")).alias("m")).select(*keys, "m.*")
    best = stored(best, "mcd")
    # The support is the inner part: scale so that its median distance is that of a normal one.
    s = scored(about, best)
    scale = stored(s.groupBy(*keys).agg(F.percentile_approx("__d2", 0.5, 1000).alias("__mid")), "mcd")
    chi_mid = p * (1 - 2 / (9 * p)) ** 3
    return s.join(scale, keys, "left").withColumn("distance", F.sqrt(F.col("__d2") * F.lit(chi_mid) / F.greatest("__mid", F.lit(chi_mid))))


def quality_rules(docs: DataFrame, cutoff: float = 12.0) -> DataFrame:
    """``doc_id``, STATS, ``base_failed``, ``distance`` (null where the base rules failed) and ``kept``.

    Takes ``doc_id, text, lang, source``; other columns are not read. A null or
    empty text has zero words and fails. Null languages and sources form groups
    of their own. Repeated rows are judged one by one; ties of a distance with
    the cutoff are kept. An empty table gives no rows.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stored(document_stats(docs), "stats").withColumn("base_failed", failed).withColumns(_features())
    judged = mcd_outliers(rows.where("not base_failed"), list(_features()), ["lang", "source"], cutoff=cutoff, floors=FLOORS, prior=PRIOR, wider=(["lang"], []))
    out = ["doc_id", *STATS, "base_failed"]
    return judged.select(*out, "distance", (~F.col("outlier")).alias("kept")).unionByName(
        rows.where("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
