"""Soft-membership mixing to target weights (operator 8), in DataFrame and SQL functions only.

1. Hashed words whose presence depends on the domain (chi-squared test) are the features of a multinomial logistic
   regression, fitted with the DataFrame API of spark.ml on a bounded sample of the labelled documents (about
   ``train_rows``, those with the least hash of their id). It gives every document a posterior over the domains;
   a labelled document belongs to the domain of its label.
2. With C_k the expected tokens of domain k (posterior times length) and T_k its target, rates r >= 0 minimise
   sum_k (S_k - T_k)^2 / C_k, S_k = sum_d r_d n_d p_dk, by projected gradient from r = 1. In the metric of document
   lengths the gradient of a document is sum_k p_dk (S_k - T_k) / C_k and its Lipschitz constant is 1, so the step is 1:
   r <- min(max_rate, max(0, r - gradient)). A round is one aggregation to K sums over the table of posteriors; the
   gradients so far are the whole state, and a document's rate follows from them.

Domains: toxic (toxic 1, whatever the quality), junk (quality 0, not toxic) and clean. ``weights`` gives target shares; the total is the largest
at which no domain with a weight needs more than it has. Domains in ``keep`` keep the total that they have.

Contract: documents are told apart by (doc_id, hash of the text), rows equal in both get the same rate each; a null text
has no words; labels with a null id or without any label are ignored, of several labels of one id the lowest quality and
highest toxicity count; domains without labelled examples get no mass; where no word tells
the domains apart, every document has their shares among the labels (clean without labels);
extra columns are ignored by the fit and kept by ``apply``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

DOMAINS = ("clean", "junk", "toxic")
SLOTS = 1 << 16  # of hashed words; with the domains the size of the model
TRAIN_ROWS = 20_000
CRITICAL = 23.0  # of the chi-squared statistic: chance 1e-5 with three domains
WEIGHTS = {"clean": 0.96, "junk": 0.03, "toxic": 0.01}
ROUNDS = 60


def _words(text: str = "text"):
    """Words in lower case; one empty word if there are none."""
    return F.split(F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\v\f\r")), r"[\x20\x09-\x0D]+")


def _count(words):
    return F.when(F.element_at(words, 1) == "", 0).otherwise(F.size(words)).cast("long")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of every labelled document."""
    one = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").otherwise("clean").alias("domain"))


def _features(docs: DataFrame, slots: int) -> DataFrame:
    return HashingTF(inputCol="words", outputCol="features", binary=True, numFeatures=slots).transform(docs)


def telling(sample: DataFrame, size: dict[str, int]) -> list[int]:
    """Slots whose presence depends on the domain, by the chi-squared statistic of the table presence x domain."""
    entries = F.from_json(F.to_json(F.struct("features")), "features struct<indices:array<int>>")["features"]["indices"]
    seen = sample.select("domain", F.explode(entries).alias("slot"))
    count = seen.groupBy("slot").pivot("domain", list(size)).count().na.fill(0)
    n, found = sum(size.values()), reduce(add, [F.col(d) for d in size])
    share = found / n
    parts = [(F.col(d) - share * k) ** 2 / (share * k) + (F.col(d) - share * k) ** 2 / ((1 - share) * k) for d, k in size.items()]
    rows = count.where((found < n) & (reduce(add, parts) >= CRITICAL)).select("slot").collect()  # at most as many as slots
    return sorted(r.slot for r in rows)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, slots: int = SLOTS) -> tuple[PipelineModel | None, dict[str, float]]:
    """The classifier and its domains with their shares; no classifier if no word tells the domains apart."""
    known = domains(labels)
    total = known.count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_rows / total * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])  # about train_rows rows
    sample = materialize(sample.select("domain", _words().alias("words")), "train")
    size = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    have = {d: size[d] / sum(size.values()) for d in DOMAINS if d in size}
    if len(have) < 2:
        return None, have
    number = F.coalesce(*[F.when(F.col("domain") == d, float(k)) for k, d in enumerate(have)])
    sample = materialize(_features(sample, slots).select("domain", "features", number.alias("label")), "train")
    chosen = telling(sample, size)
    if not chosen:
        return None, have
    slicer = VectorSlicer(inputCol="features", outputCol="telling", indices=chosen)
    sample = materialize(slicer.transform(sample).select("telling", "label"), "train")
    regression = LogisticRegression(family="multinomial", regParam=0.003, maxIter=40, labelCol="label", featuresCol="telling")
    return PipelineModel([slicer, regression.fit(sample)]), have


def posteriors(docs: DataFrame, model: tuple[PipelineModel | None, dict[str, float]], slots: int = SLOTS) -> DataFrame:
    """(doc_id, h, n_tokens, rows, p_clean, p_junk, p_toxic) of every distinct document."""
    fitted, have = model
    doc = docs.select("doc_id", F.xxhash64("text").alias("h"), _words().alias("words")).withColumn("n_tokens", _count(F.col("words")))
    if fitted is None:
        p = {d: F.lit((have or {"clean": 1.0}).get(d, 0.0)) for d in DOMAINS}
    else:
        doc = fitted.transform(_features(doc, slots)).withColumn("p", vector_to_array("probability"))
        p = {d: F.get("p", F.lit(list(have).index(d))) if d in have else F.lit(0.0) for d in DOMAINS}
    each = doc.select("doc_id", "h", "n_tokens", *[p[d].alias(f"p_{d}") for d in DOMAINS])
    alike = [F.max(f"p_{d}").alias(f"p_{d}") for d in DOMAINS]  # the same in every copy
    return each.groupBy("doc_id", "h", "n_tokens").agg(F.count("*").alias("rows"), *alike)


def settled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Posteriors in which a labelled document belongs to the domain of its label."""
    joined = found.join(domains(labels), "doc_id", "left")
    p = {d: F.when(F.col("domain").isNull(), F.col(f"p_{d}")).otherwise((F.col("domain") == d).cast("double")) for d in DOMAINS}
    return joined.select("doc_id", "h", "n_tokens", "rows", *[p[d].alias(f"p_{d}") for d in DOMAINS])


def _rate(history: list[list[float]], max_rate: float):
    """Rate of a document after the gradients so far."""
    if not history:
        return F.lit(min(1.0, max_rate))
    p = [F.col(f"p_{d}") for d in DOMAINS]
    steps = F.array(*[F.array(*[F.lit(x) for x in g]) for g in history])
    return F.aggregate(steps, F.lit(min(1.0, max_rate)), lambda r, g: F.least(F.lit(max_rate), F.greatest(F.lit(0.0), r - sum((p[k] * g[k] for k in range(1, len(p))), p[0] * g[0]))))


def rates(found: DataFrame, weights: dict[str, float], max_rate: float = 1e6, keep: tuple[str, ...] = (), rounds: int = ROUNDS, close: float = 1e-4) -> tuple[DataFrame, dict[str, float]]:
    """The table of posteriors with the fitted rate, and the targets in tokens."""
    tokens = F.col("n_tokens") * F.col("rows")
    have = found.agg(*[F.coalesce(F.sum(tokens * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS]).first()
    whole = sum(weights.get(d, 0.0) for d in DOMAINS) or 1.0
    total = min((have[d] / (weights[d] / whole) for d in DOMAINS if weights.get(d) and have[d] > 0), default=0.0)
    target = {d: have[d] if d in keep else total * weights.get(d, 0.0) / whole for d in DOMAINS}
    total = sum(have[d] for d in DOMAINS)
    history: list[list[float]] = []
    last = None
    while total and len(history) < rounds:
        r = _rate(history, max_rate)
        now = found.agg(*[F.sum(tokens * F.col(f"p_{d}") * r).alias(d) for d in DOMAINS]).first()
        loss = sum((now[d] - target[d]) ** 2 / have[d] for d in DOMAINS if have[d] > 0) / total
        if loss < close**2 or (last is not None and last - loss < close * last):
            break
        last = loss
        history.append([(now[d] - target[d]) / have[d] if have[d] > 0 else 0.0 for d in DOMAINS])
    return found.withColumn("rate", _rate(history, max_rate)), target


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, max_rate: float = 1e6, keep: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, h, n_tokens, rows, posteriors, domain, rate, copies); copies is the rate rounded up or down by a hash."""
    found, _ = rates(materialize(settled(posteriors(docs, fit(docs, labels, train_rows)), labels), "posteriors"), WEIGHTS if weights is None else weights, max_rate, keep)
    best = F.greatest(*[F.col(f"p_{d}") for d in DOMAINS])
    domain = F.coalesce(*[F.when(F.col(f"p_{d}") == best, d) for d in DOMAINS])
    chance = F.pmod(F.xxhash64("doc_id", "h", F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    return found.withColumn("domain", domain).withColumn("copies", F.floor(F.col("rate") + chance))


def apply(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, max_rate: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs``, each as often as its copies say, with the columns of ``docs``."""
    found = mix(docs, labels, weights, max_rate, keep).where("copies > 0")
    found = found.select(F.col("doc_id").alias("_mix_id"), F.col("h").alias("_mix_h"), F.col("copies").cast("int").alias("_mix_copies"))
    joined = docs.withColumn("_mix_k", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_k") == F.col("_mix_h")))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(docs.columns)


@query("op8_mixing")
def op8(spark, sf_dir):
    """Domain posteriors, rate and number of copies of every document."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, table(spark, sf_dir, "labels")).select("doc_id", F.col("h").alias("text_hash"), "n_tokens", "rows", *[f"p_{d}" for d in DOMAINS], "domain", "rate", "copies")
