"""Toxicity scores by weak supervision.

Voters are rules that look at a text and vote toxic or abstain. Lexicon voters say "has this word": the words are a fixed list of abusive ones in
the corpus's languages with their regular inflections, whatever the labels. Pattern voters say "has a word that begins like this"; they, and
further word voters, are those that a bounded sample of labelled training rows tells apart. A generative model then looks at the votes alone, without labels, for the voters' accuracies and correlations: a two-class mixture fitted by EM, in which voters that agree
more often than their classes explain share a vote's weight. Its posterior labels train the linear classifier
that gives the scores: sparse logistic regression over the voters' own features and the words that toxic rows of the sample share.
A lexicon voter that hardly speaks in the sample gets the weight that its kind's average accuracy deserves.

A word here is a run of ASCII letters and bytes beyond ASCII, with A-Z lower-cased. lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.storage import LAST_ID, give_back, order_id, require, text_or_empty, written
from tandem.llm.words import NO_LETTER, beginnings, portions, scan

FOLDS, HELD_FOLD = 5, 0
SAMPLE_ROWS = 20_000  # labelled training rows, about, that voters and classifier are fitted on; fewer where there are fewer
LEAST_SUPPORT = 2  # toxic rows of the sample that a drawn voter, or a feature of the classifier, needs at the least
VOTER_SHARE, FEATURE_SHARE = 1 / 200, 1 / 400  # of the sample's toxic rows that they need too
PURITY = 10  # toxic rows that a drawn voter must have for each clean one, beside that support
BEGIN_BYTES = (4, 6, 8)  # beginnings of words that pattern voters look at
FIRST_BELIEF = 0.9  # accuracy of a voter of which nothing is known
PENALTY = 2e-4  # of a weight in the classifier, beside the mean loss
SPREAD = 1_000_000


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, its code): the distinct words and beginnings of words of each text, slice by slice."""
    with np.errstate(over="ignore"):
        for w in scan(texts, fold=True, separators=NO_LETTER):
            doc = w.doc()
            owner, code = [doc], [w.code]
            for size in BEGIN_BYTES:
                begin, longer = beginnings(w, size, fold=True)
                owner.append(doc[longer])
                code.append(begin[longer])
            owner, code = np.concatenate(owner), np.concatenate(code)
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
            yield w.row, len(w.first) - 1, owner[new], code[new]


#: Words of abuse in English, German, French and Spanish, in their plain forms.
LEXICON = """
idiot moron imbecile cretin stupid dumbass loser pathetic worthless disgusting filthy garbage trash scum vermin clown jerk bastard bitch asshole
idiotisch trottel dummkopf schwachkopf blödmann versager erbärmlich wertlos widerlich ekelhaft abschaum abfall müll ungeziefer arschloch schlampe mistkerl hurensohn drecksack spinner
imbécile crétin débile abruti minable pitoyable pathétique dégoûtant répugnant ordure déchet poubelle racaille vermine bouffon salaud salope connard connasse enfoiré
idiota imbécil estúpido cretino tonto inútil patético despreciable asqueroso repugnante basura escoria payaso perdedor cabrón bastardo gilipollas pendejo zorra malnacido
""".split()


def lexicon_codes(words: list[str] = LEXICON) -> np.ndarray:
    """The features of a lexicon: its words, with plurals and genders as these languages form them."""
    forms = {f for w in words for f in (w, *(w + end for end in ("s", "e", "n", "en", "er", "es")), *((w[:-1] + end for end in ("a", "os", "as")) if w.endswith("o") else ()))}
    with np.errstate(over="ignore"):
        return np.unique(np.concatenate([w.code for w in scan(pa.array(sorted(forms)), fold=True, separators=NO_LETTER)]))


@dataclass
class Voters:
    codes: np.ndarray  # uint64, ascending

    def votes(self, texts: pa.Array) -> np.ndarray:
        """One row of booleans for each text."""
        out = np.zeros((len(texts), len(self.codes)), bool)
        for row, _, owner, code in features(texts):
            at, hit = places(self.codes, code)
            out[row + owner[hit], at[hit]] = True
        return out


def label_model(votes: np.ndarray, times: np.ndarray, rate: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic class for each row of votes, and each voter's accuracy, from the votes alone.

    votes: distinct rows of booleans; times: how often each occurs; rate: of the toxic class. Silence of a voter is no
    evidence, as voters for one language say nothing about others; where all are silent, one more voter says clean. A voter
    is right with an accuracy of its own, whatever the others say: EM alternates between posteriors and accuracies, which start at
    0.9. A voter that mostly speaks alone loses its say, as the rate speaks against it, and voters that speak together confirm one another. Voters
    that speak together beyond what the classes explain are not independent: when accuracies have settled, correlations inside the toxic class are
    estimated from the posteriors, and in the last round each voter's evidence is divided by one plus its correlations with others.
    """
    x = np.c_[votes, ~votes.any(axis=1)].astype(float)
    sign = np.r_[np.ones(votes.shape[1]), -1.0]
    share = np.ones(x.shape[1])
    right = np.full(x.shape[1], FIRST_BELIEF)
    spoken = times @ x
    base = np.log(rate / (1 - rate))
    post = np.zeros(len(x))
    for step in range(rounds):
        evidence = sign * share * np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip(base + x @ evidence, -60, 60)))
        agree = np.where(sign > 0, (times * post) @ x, (times * (1 - post)) @ x)
        right = np.clip((agree + FIRST_BELIEF) / (spoken + 1), 0.001, 0.999)
        if step == rounds - 2:
            share[:-1] = 1 / (1 + _excess_agreement(x[:, :-1], times * post))
    return post, right[:-1]


def _excess_agreement(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each voter the sum of its clear correlations with others over rows weighted by w."""
    d = x - (w @ x) / max(w.sum(), 1e-9)
    spread = np.sqrt(np.clip(w @ (d * d), 1e-9, None))
    r = (d * w[:, None]).T @ d / np.outer(spread, spread)
    np.fill_diagonal(r, 0)
    return np.where(r > 0.5, r, 0).sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """words and toxic of about SAMPLE_ROWS labelled rows outside the held-out fold, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = written(known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic")), "labels")
    rows = known.count()
    if rows > SAMPLE_ROWS:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(SPREAD)) < int(SPREAD * SAMPLE_ROWS / rows))
    texts = docs.select(order_id().alias("_id"), text_or_empty().alias("words"))
    return written(texts.join(F.broadcast(known), "_id").select("words", F.col("_toxic").alias("toxic")), "toxic-sample")  # about SAMPLE_ROWS ids


def draw_voters(sample: DataFrame) -> tuple[Voters, np.ndarray]:
    """The lexicon's voters with the words and beginnings that tell toxic rows of the sample, and all codes that enough of its toxic rows have."""
    schema = "code long, toxic long, clean long"

    def count(wanted: np.ndarray | None):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in portions(batches, "words"):
                toxic = batch["toxic"].to_numpy() == 1
                for row, n, owner, code in features(batch["words"]):
                    if wanted is not None:
                        _, there = places(wanted, code)
                        owner, code = owner[there], code[there]
                    own, inverse = np.unique(code, return_inverse=True)
                    yes = np.bincount(inverse, toxic[row : row + n][owner], len(own)).astype(np.int64)
                    all_ = np.bincount(inverse, minlength=len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(yes), pa.array(all_ - yes)], ["code", "toxic", "clean"])

        return run

    total = lambda df: df.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic_rows = sample.where("toxic = 1").count()
    often = total(sample.where("toxic = 1").mapInArrow(count(None), schema)).where(F.col("toxic") >= max(LEAST_SUPPORT, FEATURE_SHARE * toxic_rows)).select("code")
    own = lexicon_codes()
    codes = np.union1d(np.array([r["code"] for r in often.collect()], np.int64).view(np.uint64), own)  # bounded by the sample
    support = total(sample.mapInArrow(count(codes), schema))
    pure = support.where(F.col("toxic") - PURITY * F.col("clean") >= max(LEAST_SUPPORT, VOTER_SHARE * toxic_rows))
    drawn = np.array([r["code"] for r in pure.select("code").collect()], np.int64).view(np.uint64)
    return Voters(np.union1d(drawn, own)), codes


def places(codes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code is in the ascending codes, and whether it is there."""
    if not len(codes):
        return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    at = np.searchsorted(codes, code).clip(max=len(codes) - 1)
    return at, codes[at] == code


@dataclass
class Model:
    """A linear classifier over codes; without codes a constant score."""

    codes: np.ndarray  # ascending
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        odds = np.full(len(texts), self.intercept)
        for row, n, owner, code in features(texts) if len(self.codes) else []:
            at, there = places(self.codes, code)
            odds[row : row + n] += np.bincount(owner[there], self.weights[at[there]], n)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier trained on posterior labels of the label model. Without rows of both classes, the rate of toxic rows for all; without any rows nothing is toxic."""
    sample = training_sample(docs, labels)
    rate, rows = sample.agg(F.avg("toxic"), F.count(F.lit(1))).first()
    constant = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((rows * (rate or 0) + 0.5) / (rows * (1 - (rate or 0)) + 1.5))))
    if not rows or not 0 < rate < 1:
        return constant
    voters, codes = draw_voters(sample)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in portions(batches, "words"):
            votes = voters.votes(batch["words"])
            found: list[list[int]] = [[]] * len(votes)
            for row, n, owner, code in features(batch["words"]):
                edges = np.searchsorted(owner, np.arange(n + 1))
                at, there = places(codes, code)
                found[row : row + n] = [at[i:j][there[i:j]].tolist() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            packed = [np.packbits(v).tobytes() for v in votes]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["votes", "slots"])

    voted = written(sample.mapInArrow(vote, "votes binary, slots array<int>"), "votes")
    kinds = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the sample
    k = len(voters.codes)
    votes = np.array([np.unpackbits(np.frombuffer(r["votes"], np.uint8))[:k].astype(bool) for r in kinds])
    times = np.array([r["n"] for r in kinds], float)
    spoken, right = times @ votes, np.full(k, FIRST_BELIEF)
    posterior, right[spoken > 0] = label_model(votes[:, spoken > 0], times, float(rate))
    spark = docs.sparkSession
    beliefs = spark.createDataFrame([(bytes(r["votes"]), float(p)) for r, p in zip(kinds, posterior, strict=True)], "votes binary, belief double")
    width = len(codes)
    vector = F.udf(lambda s: SparseVector(width, s, [1.0] * len(s)), VectorUDT())
    soft = voted.join(F.broadcast(beliefs), "votes").select(vector("slots").alias("features"), "belief")
    both = soft.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("belief").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("belief")).alias("weight")))).alias("x"))
    rows_in = both.select("features", "x.label", "x.weight").where("weight > 1e-4")
    if rows_in.select("label").distinct().count() < 2:
        return constant
    model = LogisticRegression(weightCol="weight", regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=False).fit(rows_in)
    weights = model.coefficients.toArray()
    lexical = np.isin(voters.codes, lexicon_codes())
    if (often := lexical & (spoken >= LEAST_SUPPORT)).any():
        usual = np.average(right[often], weights=spoken[often])
    else:
        usual = FIRST_BELIEF
    if usual > 0.5:
        rare, _ = places(codes, voters.codes[lexical & (spoken < LEAST_SUPPORT)])
        weights[rare] = np.maximum(weights[rare], np.log(usual / (1 - usual)) - model.intercept)
    used = np.flatnonzero(weights)
    return Model(codes[used], weights[used], float(model.intercept))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and a key that tells rows apart, for every row of docs; the key is xxhash64 of doc_id and text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in portions(batches, "words"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(held.value.scores(batch["words"]))], ["id", "score"])

    rows = docs.select(order_id().alias("id"), text_or_empty().alias("words"))
    return rows.mapInArrow(run, "id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A score of toxicity for every whole text.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; rows with null are ignored, of several for one doc_id the largest counts). Labels of rows whose
    crc32(doc_id as text) mod 5 is 0 are never read. Returns doc_id, held_out, score (0 to 1) and predicted (1 if score is 0.5 or more). Null and empty texts have no
    features and get the score of such a text. Repeated rows give repeated results; a null doc_id stays null and is not held out; an empty table gives
    none. Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    out = scored(docs, fit(docs, labels)).withColumn("doc_id", F.when(F.col("id") != LAST_ID, F.col("id")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns stay as they are, whatever their names.

    Null and empty texts get the score of a text without features; repeated rows go or stay together; an empty table stays empty.
    """
    require(docs, "doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in portions(batches, f"c{at}"):
            texts = batch.column(at)
            yield batch.filter(pa.array(held.value.scores(texts) < 0.5))

    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow() takes no names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
