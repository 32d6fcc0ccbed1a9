"""Toxicity by weak supervision.

1. Voters. From labelled training rows come the words and word beginnings, and their repetitions in one
   text, that are far likelier in toxic texts. They are dealt by rank to lexicon voters; a few patterns (shouting, exclamations) are
   further voters. A voter votes "toxic" or abstains. All texts are voted on, labelled or not.
2. Label model. Each voter has a rate of votes on toxic and on clean texts; the true labels are latent.
   Expectation and maximisation over the vote patterns of all texts estimate the rates and, within each
   class, the correlations of the voters. Voters that depend on each other repeat one another, so a
   voter's evidence is divided by the sum of its correlations with those it depends on. To abstain is no evidence, and the share of toxic
   texts is that of the training rows.
3. Classifier. A logistic regression on the lexicon features, patterns and length class is fitted to
   the posterior labels of the training sample, where a row's own label is one more vote, and scores
   every text.

The lexicon and the classifier are fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the least
hashes of their ids; the label model uses all texts. Labels are read for training rows only and no
column but the text is an input of a score.

Cases: null and empty texts have no votes and get the classifier's lowest level of evidence; without
labelled rows of both classes, or without features, every score is the toxic share of the training rows
(0 without any); several labels of one id count as toxic if one is; repeated rows get equal scores;
other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelode.llm.store import free_name, settled
from sourcelode.llm.text import HELD, Tally, mix, slices, span_hashes, text_bytes, word_spans

SAMPLE_ROWS = 30_000
#: Most lexicon features, and lexicon voters among which they are dealt.
FEATURES = 4000
LEXICON_VOTERS = 24
#: A feature needs this log-odds, in this many toxic training rows or this share of them.
LEAST_ODDS = 2.5
LEAST_ROWS = 4
LEAST_SHARE = 0.004
ROUNDS = 12
#: Log-odds of a training row's own label, one more vote on it.
LABEL_ODDS = 12.0
#: Lengths are told apart by powers of two, up to this many.
LENGTHS = 24
#: Voters are taken to depend on each other from this correlation within a class on.
DEPENDENT = 0.5
PREFIX_BYTES = (4, 5, 6, 7)
#: A feature also exists as "so many times or more in one text".
TIMES = (1, 2, 4)
PATTERNS = ("shouting", "exclaiming", "run")


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the words and of their beginnings, as often as they occur.

    The lowest two bits are clear; with the place in TIMES there, a hash is a feature."""
    starts, ends, owner = word_spans(data, offsets)
    first, last, kind, text = [starts], [ends], [np.zeros(len(starts), np.uint64)], [owner]
    for k, size in enumerate(PREFIX_BYTES, 1):
        long = np.flatnonzero(ends - starts >= size)
        first.append(starts[long])
        last.append(starts[long] + size)
        kind.append(np.full(len(long), k, dtype=np.uint64))
        text.append(owner[long])
    hashes = span_hashes(data, np.concatenate(first), np.concatenate(last))
    return mix(hashes ^ np.concatenate(kind)) & ~np.uint64(3), np.concatenate(text)


def counted_features(found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text index), each once, from hashes as often as they occur."""
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])][: len(found)])
    times = np.diff(np.r_[new, len(found)])
    parts = [(found[new][times >= least] | np.uint64(k), text[new][times >= least]) for k, least in enumerate(TIMES)]
    return np.concatenate([f for f, _ in parts]), np.concatenate([t for _, t in parts])


def length_class(offsets: np.ndarray) -> np.ndarray:
    """The length class of each text; what a text of its length holds by chance depends on it."""
    return np.minimum(np.log2(np.diff(offsets) + 1).astype(np.int64), LENGTHS - 1)


def text_patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the patterns of each text, in the order of PATTERNS."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    upper = np.bincount(doc[(data >= 0x41) & (data <= 0x5A)], minlength=n)
    lower = np.bincount(doc[(data >= 0x61) & (data <= 0x7A)], minlength=n)
    again = np.flatnonzero((data[1:] == data[:-1]) & (doc[1:] == doc[:-1]))
    exclaims = np.bincount(doc[again[data[again] == 0x21]], minlength=n)
    third = again[1:][np.diff(again) == 1]
    letters = ((data[third] | 0x20) >= 0x61) & ((data[third] | 0x20) <= 0x7A)
    runs = np.bincount(doc[third[letters]], minlength=n)
    return (upper > 2 * lower) * 1 | (exclaims > 0) * 2 | (runs > 0) * 4


class Lexicon(NamedTuple):
    """Sorted feature hashes, the voter of each, and a quick table of their highest bits."""

    features: np.ndarray
    voter: np.ndarray
    quick: np.ndarray

    @classmethod
    def of(cls, ranked: np.ndarray) -> Lexicon:
        order = np.argsort(ranked)
        quick = np.zeros(1 << 16, dtype=bool)
        quick[(ranked >> np.uint64(48)).astype(np.int64)] = True
        return cls(ranked[order], order * LEXICON_VOTERS // max(1, len(order)), quick)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text index, place of the feature), each pair once, by text."""
        found, text = text_features(data, offsets)
        near = np.flatnonzero(self.quick[(found >> np.uint64(48)).astype(np.int64)])
        if not len(near) or not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, text = counted_features(found[near], text[near])
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        same = self.features[at] == found
        pairs = np.unique(text[same] * len(self.features) + at[same])
        return pairs // len(self.features), pairs % len(self.features)

    def votes(self, text: np.ndarray, at: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """One integer a text: bit v is the vote of voter v; patterns stand above the lexicons."""
        votes = patterns.astype(np.int64) << LEXICON_VOTERS
        np.bitwise_or.at(votes, text, np.int64(1) << self.voter[at])
        return votes


def mine(sample: DataFrame) -> np.ndarray:
    """Feature hashes of ``sample`` (text, toxic), the strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {0: Tally(), 1: Tally()}

        def out(least: int) -> Iterator[pa.RecordBatch]:
            for toxic, tally in tallies.items():
                for part in tally.take(least):
                    yield part.append_column("toxic", pa.array(np.full(part.num_rows, toxic, np.int32)))

        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            found, text = counted_features(*text_features(data, offsets))
            label = batch.column("toxic").to_numpy()
            for toxic, tally in tallies.items():
                tally.add(found.view(np.int64)[label[text] == toxic])
            yield from out(HELD)
        yield from out(1)

    counts = (
        sample.select("text", "toxic").mapInArrow(run, "key bigint, n bigint, toxic int").groupBy("key")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    )
    sizes = sample.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad, good = sizes["bad"] or 0, (sizes["all"] or 0) - (sizes["bad"] or 0)
    if not bad or not good:
        return np.zeros(0, np.uint64)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    best = (
        counts.withColumn("odds", odds)
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("bad") >= max(LEAST_ROWS, LEAST_SHARE * bad)))
        .orderBy((F.col("odds") * F.sqrt("bad")).desc(), "key").limit(FEATURES).toPandas()
    )
    return best["key"].to_numpy(np.int64).view(np.uint64)


class LabelModel(NamedTuple):
    """Rates of votes per class, weights against repetition, and the share of toxic texts."""

    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        cast = (votes[:, None] >> np.arange(len(self.toxic)) & 1).astype(bool)
        yes = np.log(self.toxic / self.clean) * self.weight
        odds = np.log(self.prior / (1 - self.prior)) + np.where(cast, yes, 0.0).sum(axis=1)
        if labels is not None:
            odds += np.where(labels == 1, LABEL_ODDS, -LABEL_ODDS)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def labelled_rates(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Rates of votes on labelled clean (row 0) and toxic (row 1) texts."""
    cast = (votes[:, None] >> np.arange(LEXICON_VOTERS + len(PATTERNS)) & 1).astype(float)
    return np.stack([(cast[toxic == k].sum(axis=0) + 0.5) / ((toxic == k).sum() + 1.0) for k in (0, 1)])


def fit_label_model(patterns: DataFrame, prior: float, labelled: np.ndarray) -> LabelModel:
    """The label model from ``patterns`` (votes, n), the distinct votes of all texts.

    Each round adds up counts and pair counts per class, voters by voters, whatever the texts; only
    these sums reach the driver. It starts from the rates on labelled training rows, and every round's
    rates are drawn halfway back to them, which keeps the two classes what the labels mean by them.
    """
    voters = LEXICON_VOTERS + len(PATTERNS)
    prior = min(max(prior, 1e-4), 0.5)
    model = LabelModel(labelled[1], labelled[0], np.ones(voters), prior)
    for _ in range(ROUNDS):
        spread = patterns.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, voters + 1, voters + 1))
            for batch in batches:
                votes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                q = spread.value.posterior(votes)
                cast = np.c_[(votes[:, None] >> np.arange(voters) & 1).astype(float), np.ones(len(votes))]
                for k, share in enumerate((1 - q, q)):
                    sums[k] += cast.T @ (cast * (share * n)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        parts = patterns.select("votes", "n").mapInArrow(run, "sums binary").collect()
        sums = sum(np.frombuffer(r["sums"]) for r in parts).reshape(2, voters + 1, voters + 1)
        spread.unpersist()
        mass = sums[:, -1, -1]
        rates = np.clip((sums[:, -1, :-1] + 0.5) / (mass + 1.0)[:, None], 1e-6, 1 - 1e-6)
        rates = (rates + labelled) / 2
        correlation = np.zeros((voters, voters))
        for k in (0, 1):
            both = sums[k, :-1, :-1] / max(mass[k], 1e-9)
            spread_ = np.sqrt(np.outer(rates[k] * (1 - rates[k]), rates[k] * (1 - rates[k])))
            correlation += np.clip((both - np.outer(rates[k], rates[k])) / spread_, 0, 1) / 2
        correlation[correlation < DEPENDENT] = 0.0
        np.fill_diagonal(correlation, 1.0)
        model = LabelModel(rates[1], rates[0], 1 / correlation.sum(axis=1), prior)
    return model


def fit_classifier(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on sparse rows, by gradient steps."""
    weights = np.zeros(width + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = max(1, len(target))
    prior = np.clip(target.mean() if len(target) else 0.0, 1e-4, 1 - 1e-4)
    weights[-1] = np.log(prior / (1 - prior))
    for step in range(1, 601):
        level = weights[-1] + np.bincount(rows, weights=weights[columns], minlength=len(target))
        error = 1 / (1 + np.exp(-np.clip(level, -500, 500))) - target
        slope = np.r_[np.bincount(columns, weights=error[rows], minlength=width), error.sum()] / n
        slope[:-1] += 1e-6 * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weights = weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return weights


class Classifier(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    model: LabelModel | None


def train(documents: DataFrame, labels: DataFrame, training: Column) -> Classifier:
    """Fit on the rows of ``labels`` (doc_id, toxic) that are ``training``."""
    chosen = (
        labels.where(training & F.col("toxic").isNotNull()).groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    texts = documents.select("doc_id", "text")
    # At most SAMPLE_ROWS rows of two numbers.
    sample = settled(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "sample")
    lexicon = Lexicon.of(mine(sample))
    sizes = sample.agg(F.avg("toxic").alias("prior")).first()
    prior = float(sizes["prior"] or 0.0)
    width = len(lexicon.features)
    if not width:
        level = np.clip(prior, 1e-6, 1 - 1e-6)
        return Classifier(lexicon, np.r_[np.zeros(len(PATTERNS) + LENGTHS), np.log(level / (1 - level))], None)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            votes = lexicon.votes(*lexicon.hits(data, offsets), text_patterns(data, offsets))
            yield pa.RecordBatch.from_arrays([pa.array(votes)], names=["votes"])

    votes = texts.select("text").mapInArrow(vote, "votes bigint")
    patterns = settled(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "votes")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            text, at = lexicon.hits(data, offsets)
            bits = text_patterns(data, offsets)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lexicon.votes(text, at, bits)),
                    pa.array((bits | length_class(offsets) << len(PATTERNS)).astype(np.int32)),
                    pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))),
                    batch.column("toxic"),
                ],
                names=["votes", "bits", "hits", "toxic"],
            )

    # SAMPLE_ROWS rows of a few numbers.
    rows = sample.select("text", "toxic").mapInArrow(
        features, "votes bigint, bits int, hits array<int>, toxic int"
    ).toPandas()
    model = fit_label_model(patterns, prior, labelled_rates(rows["votes"].to_numpy(), rows["toxic"].to_numpy()))
    target = model.posterior(rows["votes"].to_numpy(np.int64), rows["toxic"].to_numpy())
    sizes = np.array([len(h) for h in rows["hits"]], dtype=np.int64)
    hits = np.concatenate([*rows["hits"], np.zeros(0, np.int64)]).astype(np.int64)
    row, column = _design(np.repeat(np.arange(len(rows)), sizes), hits, rows["bits"].to_numpy(np.int64), width)
    return Classifier(lexicon, fit_classifier(row, column, target, width + len(PATTERNS) + LENGTHS), model)


def _design(text: np.ndarray, at: np.ndarray, bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the classifier's inputs: lexicon features, patterns and length class."""
    row, column = [text], [at]
    for k in range(len(PATTERNS)):
        held = np.flatnonzero(bits >> k & 1)
        row.append(held)
        column.append(np.full(len(held), width + k))
    row.append(np.arange(len(bits)))
    column.append(width + len(PATTERNS) + (bits >> len(PATTERNS)))
    return np.concatenate(row), np.concatenate(column)


def with_toxicity(documents: DataFrame, classifier: Classifier, name: str = "toxicity") -> DataFrame:
    """All rows and columns of ``documents`` and their score, 0 to 1."""
    name = free_name(documents.columns, name)
    known = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights, _ = known.value
        width = len(lexicon.features)
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            bits = text_patterns(data, offsets) | length_class(offsets) << len(PATTERNS)
            row, column = _design(*lexicon.hits(data, offsets), bits, width)
            level = weights[-1] + np.bincount(row, weights=weights[column], minlength=batch.num_rows)
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(level, -500, 500)))))

    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])
    return documents.mapInArrow(run, schema)
