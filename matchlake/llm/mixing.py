"""Soft-membership mixing with DataFrame functions only.

A classifier learnt from a labelled table gives each document a posterior over domains.
Document rates then come from projected-gradient least squares: the nonnegative rates nearest
to 1 whose expected domain token totals match the targets.
A rate depends on a document only through its posterior, so an iteration needs no
per-document state: the rate is an expression over the posterior and the sum of the steps,
and one pass of partial sums gives the next residual.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import checkpointed

#: Labelled documents of each domain that the classifier is fitted on, about (by a hash of the id).
FIT_DOCS = 20_000
#: Words the classifier knows: those that tell domains apart best.
VOCABULARY = 4096
#: A word is used only if its counts differ between domains by more than chance would (chi-square).
SIGNIFICANT = 20.0
#: A word's log ratios count this much: words of a text are not independent.
TEMPER = 0.5
#: Greatest difference of a domain's share from its target, and the least part of a step, at which fitting ends.
TOLERANCE, LEAST_STEP = 1e-6, 1e-3


def _words(text_col: str) -> Column:
    return F.split(F.lower(F.trim(F.col(text_col).cast("string"))), r" +|\s+")


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", fit_docs: int = FIT_DOCS, vocabulary: int = VOCABULARY) -> tuple[list[str], list[float], DataFrame]:
    """(domains, log priors, words): multinomial log ratios of the most telling words.

    ``labelled`` gives ids a domain; null ids and domains are ignored, and an id with several
    domains counts for each. About ``fit_docs`` labelled documents of each domain are used.
    words: (word, w_0, ..) with at most ``vocabulary`` rows.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain")).dropna().distinct()
    per = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(per)
    if not domains:
        return [], [], docs.sparkSession.createDataFrame([], "word string")
    share = F.lit(0.0)
    for d in domains:
        share = F.when(F.col("domain") == d, F.lit(min(1.0, fit_docs / per[d]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20))
    # at most about fit_docs rows of 24 bytes a domain
    sample = F.broadcast(sample) if fit_docs * len(domains) <= 1_000_000 else sample
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(text_col).alias("words")).join(sample, "doc_id")
    counts = words.select("domain", F.explode("words").alias("word")).where("word != ''").groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"c_{i}") for i, d in enumerate(domains)])
    counts = checkpointed(counts.where(" + ".join(f"c_{i}" for i in range(len(domains))) + " > 1"))
    seen = counts.agg(*[F.sum(f"c_{i}") for i in range(len(domains))], F.count("*")).first()
    size = [(seen[i] or 0) + 0.5 * (seen[-1] + 1) for i in range(len(domains))]
    logs = [F.log((F.col(f"c_{i}") + 0.5) / F.lit(size[i])) for i in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(domains)
    ratios = [(x - mean).alias(f"w_{i}") for i, x in enumerate(logs)]
    # a chi-square like measure: the domains' squared distance from what they would have in common
    together = sum((F.col(f"c_{i}") for i in range(1, len(domains))), F.col("c_0"))
    expected = [together * F.lit(size[i] / sum(size)) for i in range(len(domains))]
    telling = sum(((F.col(f"c_{i}") - e) * (F.col(f"c_{i}") - e) / e for i, e in enumerate(expected)), F.lit(0.0))
    words = counts.select("word", *ratios, telling.alias("telling")).where(F.col("telling") >= SIGNIFICANT).orderBy(F.desc("telling"), "word").limit(vocabulary).drop("telling")
    total = sum(per.values())
    return domains, [math.log(per[d] / total) for d in domains], checkpointed(words)


def posteriors(docs: DataFrame, model: tuple[list[str], list[float], DataFrame], id_col: str = "doc_id", text_col: str = "text", temper: float = TEMPER) -> DataFrame:
    """(doc_id, n_tokens, p_0, ..): one row an id; tokens are words between white space.

    Rows that share an id are one document. A null or empty text has no token and the prior.
    """
    domains, priors, words = model
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode_outer(_words(text_col)).alias("word"))
    counted = source.join(F.broadcast(words), "word", "left")  # at most VOCABULARY rows
    sums = counted.groupBy("doc_id").agg(F.count(F.when(F.col("word") != "", 1)).alias("n_tokens"), *[F.coalesce(F.sum(f"w_{i}"), F.lit(0.0)).alias(f"s_{i}") for i in range(len(domains))])
    z = [F.lit(priors[i]) + F.col(f"s_{i}") * temper for i in range(len(domains))]
    if len(domains) < 2:
        return sums.select("doc_id", "n_tokens", *[F.lit(1.0).alias("p_0") for _ in domains])
    sums = sums.select("doc_id", "n_tokens", *[x.alias(f"z_{i}") for i, x in enumerate(z)])
    top = F.greatest(*[F.col(f"z_{i}") for i in range(len(domains))])
    sums = sums.select("doc_id", "n_tokens", *[F.exp(F.col(f"z_{i}") - top).alias(f"e_{i}") for i in range(len(domains))])
    whole = sum((F.col(f"e_{i}") for i in range(1, len(domains))), F.col("e_0"))
    return sums.select("doc_id", "n_tokens", *[(F.col(f"e_{i}") / whole).alias(f"p_{i}") for i in range(len(domains))])


def _rate(dual: np.ndarray) -> Column:
    """The rate after all steps: 1 less the posterior times the steps' sum, projected to zero or more."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{i}") * float(x) for i, x in enumerate(dual)), F.lit(0.0)))


def fit_rates(soft: DataFrame, targets: list[float]) -> tuple[DataFrame, dict]:
    """``soft`` (doc_id, n_tokens, p_0, ..) with ``rate``, and a report on the fit.

    Among the nonnegative rates whose expected domain token totals match ``targets`` (shares of all
    tokens), those nearest to 1. The gradient steps are summed and their sum is projected, so a rate is an
    expression of one vector, however many steps there were. A step is the residual in the metric of the Gram matrix
    of the documents whose rate is not at zero; it is halved while the residual does not fall. Steps
    end when the residual is at most TOLERANCE, or when none makes it fall, as with targets that no
    rates reach; the report's ``gap`` is the greatest difference that is left.
    """
    k = len(targets)
    places = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(dual: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens, expected totals of the domains and Gram matrix of documents above zero, as shares of all tokens; one pass."""
        rows = soft.withColumn("rate", _rate(dual))
        reached = [F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{i}")) for i in range(k)]
        gram_of = [F.sum(F.when(F.col("rate") > 0, F.col("n_tokens") * F.col(f"p_{i}") * F.col(f"p_{j}"))) for i, j in places]
        row = [float(x or 0) for x in rows.agg(F.sum("n_tokens"), *reached, *gram_of).first()]
        gram = np.zeros((k, k))
        for (i, j), x in zip(places, row[1 + k :]):
            gram[i, j] = gram[j, i] = x
        total = max(row[0], 1.0)
        return row[0], np.array(row[1 : 1 + k]) / total, gram / total

    dual = np.zeros(k)
    total, reached, gram = sums(dual) if k else (0.0, dual, None)
    if not total:
        return soft.withColumn("rate", F.lit(1.0)), {"total": total, "reached": [], "targets": targets, "steps": 0, "gap": 0.0}
    whole, steps, length = gram, 0, 1.0
    while (gap := float(np.abs(reached - targets).max())) > TOLERANCE and length > LEAST_STEP:
        metric = gram if np.trace(gram) > 1e-6 * np.trace(whole) else whole
        step = np.linalg.solve(metric + 1e-9 * np.trace(metric) * np.eye(k), reached - targets)
        found = sums(dual + length * step)
        if np.abs(found[1] - targets).max() < gap * (1 - 1e-3 * length):
            dual, reached, gram = dual + length * step, found[1], found[2]
            steps, length = steps + 1, min(1.0, 2 * length)
        else:
            length /= 2
    return soft.withColumn("rate", _rate(dual)), {"total": total, "reached": reached.tolist(), "targets": targets, "steps": steps, "gap": gap}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", fit_docs: int = FIT_DOCS, keep: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>.., rate, copies, gap): one row an id.

    rate is the expected number of copies; copies rounds it up or down by a hash of the id,
    so that its mean is the rate. Targets are scaled to sum to 1 over the labelled domains;
    domains without a target get none of the tokens. Nothing labelled, or no target: every rate
    is 1. Null ids are one document; other columns are ignored. gap, the same in all rows, is the greatest difference
    of a domain's expected share from its target that the fit left (before ``keep``).

    keep: a domain whose target is at least its measured expected share of the tokens (the others
    share what is left), and whose documents stay: a fitted rate under 1 is raised to 1 wherever no
    other domain is likelier than its prior, which holds for a text without a telling word. The
    totals are then above the targets by what the raised documents add.
    """
    model = fit_classifier(docs, labelled, id_col, text_col, domain_col, fit_docs)
    domains = model[0]
    soft = checkpointed(posteriors(docs, model, id_col, text_col))
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if sum(wanted) > 0:
        wanted, clean = [w / sum(wanted) for w in wanted], F.lit(keep in domains)
        if keep in domains:
            at = domains.index(keep)
            row = soft.agg(F.sum(F.col("n_tokens") * F.col(f"p_{at}")), F.sum("n_tokens")).first()
            good = max(wanted[at], row[0] / row[1] if row[1] else 0.0)
            wanted = [good if i == at else w * (1 - good) / max(1 - wanted[at], 1e-12) for i, w in enumerate(wanted)]
            for i in range(len(domains)):
                clean = clean if i == at else clean & (F.col(f"p_{i}") <= math.exp(model[1][i]) + 1e-9)
        rated, report = fit_rates(soft, wanted)
        rated = rated.withColumn("rate", F.when(clean, F.greatest("rate", F.lit(1.0))).otherwise(F.col("rate")))
    else:
        rated, report = soft.withColumn("rate", F.lit(1.0)), {"gap": 0.0}
    u = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.select("doc_id", "n_tokens", *[F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate", copies.alias("copies"), F.lit(report["gap"]).alias("gap"))
