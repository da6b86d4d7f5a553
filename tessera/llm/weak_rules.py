"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Rules. Each measures one thing about a whole text (MEASURES) and compares it
with what is usual in the text's language: the median and the median absolute
deviation over all documents of that language. Within NEAR deviations it votes
good, beyond FAR bad, between them and on texts of under WORDS words it
abstains. So no word list and no bound of a rule is made for a corpus; the
deviation counts as FLOOR at least (shares) or a twentieth of the median. The
length rule votes good from 50 words on and bad under 3 (published bounds).

Model. A naive Bayes mixture of two classes: a rule that votes names the class
right with a probability of its own for each class; abstaining says nothing.
Expectation-maximisation runs on the counts of vote patterns, at most 3 to the
number of rules of them whatever the corpus's size, gathered over all
documents. The posterior probability that a text is good replaces passing all
rules; a rule that disagrees with the others for no reason loses its weight.

Labels, where there are any, add one rule of another kind: n-grams that tell
the labelled toxic texts (see markers). Toxic text is well-formed, so this rule
has no errors in common with the others that EM could learn from. Its accuracy is
measured on the fifth of the labels that it wasn't made from, and the posterior
is multiplied by the probability, given its vote, that the text isn't toxic.

Defined results: a null text counts as an empty one, on which only the length
rule votes (bad); a very long one is measured whole; a null language is a language of its own; a
null doc_id is judged like any other, but is no label; repeated rows are judged
each; other columns play no part, whatever their names. An empty table gives an
empty result. With equal evidence for both classes (posterior exactly 0.5) a
document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, Tokens, cut, owned, per_token, slices, table, text_buffer
from .markers import LEAST_MARK, finder, markers, marks

GOOD, BAD, ABSTAIN = 2, 1, 0
KEEP = 0.5
ROUNDS, PRECISION = 200, 1e-9
START_PRIOR = 0.8
NEAR, FAR, FLOOR, WORDS = 4.0, 10.0, 0.01, 20
HELD_OUT, TOXIC_QUANTILE = 5, 0.995

#: What rules measure, and on which side the unusual is bad.
MEASURES = {"symbols": "high", "shouts": "high", "upper": "high", "bare": "high", "again": "high", "top": "high", "distinct": "low", "word_length": "both", "letters": "low", "runs": "high", "stops": "both"}
RULES = ("length", *MEASURES)
#: Where EM begins: junk comes in kinds, so it trips one rule of all; a good text trips hardly any.
START_RIGHT = (1 / len(RULES), 0.999)


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    buf, off = text_buffer(texts)
    n = len(off) - 1

    def per_text(of_byte: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(of_byte[buf])][off])

    def of(chars: str) -> np.ndarray:
        t = np.zeros(256, np.int64)
        t[list(chars.encode())] = 1
        return t

    upper, lower = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz")
    raw, word = Tokens(texts, lower=False, breaks=SPACES), Tokens(texts)
    tokens, words = np.diff(word.off), np.diff(raw.off)
    doc = per_token(word.off)
    again = np.zeros(len(word.h), bool)
    again[1:] = (word.h[1:] == word.h[:-1]) & (doc[1:] == doc[:-1])
    pair = np.lexsort((word.h, doc))
    new = np.ones(len(pair), bool)
    new[1:] = (word.h[pair][1:] != word.h[pair][:-1]) | (doc[pair][1:] != doc[pair][:-1])
    most = np.zeros(n, np.int64)  # how often the most frequent token stands there
    runs = np.flatnonzero(new)
    np.maximum.at(most, doc[pair][runs], np.diff(np.r_[runs, len(pair)]))
    letter = np.zeros(256, np.int64)
    letter[[c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128]] = 1
    letters = np.r_[0, np.cumsum(letter[buf])]
    bare = letters[raw.end] == letters[raw.start]  # words without a letter
    solid = per_text(np.where(SPACES, 0, 1))
    run = np.zeros(len(buf) + 1, np.int64)
    if len(buf) > 1:
        run[2:] = np.cumsum((buf[1:] == buf[:-1]) & (letter[buf[1:]] == 0) & ~SPACES[buf[1:]])
    share = lambda x, y: x / np.maximum(y, 1)
    return {
        "words": words,
        "symbols": share(per_text(of("#$%&*@^~<>{}[]\\=+_|/`")), words),
        "shouts": share(per_text(of("!")), words),
        "upper": share(per_text(upper), per_text(upper) + per_text(lower)),
        "bare": share(np.bincount(per_token(raw.off)[bare], minlength=n), words),
        "again": share(np.bincount(doc[again], minlength=n), tokens),
        "top": share(most, tokens),
        "distinct": share(np.bincount(doc[pair][new], minlength=n), np.sqrt(tokens)),
        "word_length": share(solid, words),
        "letters": share(np.diff(letters[off]), solid),
        "runs": share(np.diff(run[off]), words),
        "stops": share(per_text(of(".?!")), words),
    }


def measured(docs: DataFrame, labelled: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang, words, mark, measures...) of every row."""
    names = ["words", *MEASURES]
    sent = docs.sparkSession.sparkContext.broadcast(labelled)  # 16 bytes a marker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = sent.value
        find = finder(keys) if len(keys) else None
        for b in slices(batches):
            f = features(b.column("text"))
            mark = marks(b.column("text"), find, weights) if find else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(mark, pa.float64()), *(pa.array(f[k], pa.float64()) for k in names)], ["doc_id", "lang", "mark", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string, mark double, " + ", ".join(f"{k} double" for k in names))


def votes(m: DataFrame, near: float = NEAR, far: float = FAR) -> DataFrame:
    """(doc_id, mark, pattern): the votes as digits to base 3, the first rule's last."""
    some = m.where(F.col("words") >= WORDS)
    middle = some.groupBy(F.col("lang").alias("m_lang")).agg(*[F.percentile_approx(k, 0.5, 10000).alias(f"m_{k}") for k in MEASURES])  # a row a language
    with_middle = some.join(F.broadcast(middle), F.col("lang").eqNullSafe(F.col("m_lang")))
    spread = with_middle.groupBy("m_lang").agg(*[F.percentile_approx(F.abs(F.col(k) - F.col(f"m_{k}")), 0.5, 10000).alias(f"s_{k}") for k in MEASURES])
    usual = middle.alias("a").join(F.broadcast(spread.withColumnRenamed("m_lang", "s_lang")), F.col("m_lang").eqNullSafe(F.col("s_lang")))
    v = m.join(F.broadcast(usual), F.col("lang").eqNullSafe(F.col("m_lang")), "left")
    pattern = F.when(F.col("words") < 3, BAD).when(F.col("words") >= 50, GOOD).otherwise(ABSTAIN)
    for i, (k, side) in enumerate(MEASURES.items(), 1):
        least = F.lit(FLOOR) if k not in ("distinct", "word_length") else 0.05 * F.col(f"m_{k}")
        z = (F.col(k) - F.col(f"m_{k}")) / F.greatest(F.col(f"s_{k}"), least)
        z = {"high": z, "low": -z, "both": F.abs(z)}[side]
        vote = F.when(F.col("words") < WORDS, ABSTAIN).when(z > far, BAD).when(z <= near, GOOD).otherwise(ABSTAIN)
        pattern = pattern + vote * 3**i
    return v.select("doc_id", "mark", pattern.cast("int").alias("pattern"))


def digits(pattern: np.ndarray, rules: int) -> np.ndarray:
    return np.stack([pattern // 3**k % 3 for k in range(rules)], 1)


def fit(pattern: np.ndarray, count: np.ndarray, rules: int = len(RULES), rounds: int = ROUNDS, precision: float = PRECISION) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of good, probability of a right vote by rule and class (bad, good), posterior of good of each pattern)."""
    v = digits(pattern, rules)
    good, bad = (v == GOOD).astype(float), (v == BAD).astype(float)
    prior, right = START_PRIOR, np.tile(START_RIGHT, (rules, 1))
    post = np.full(len(pattern), prior)
    for _ in range(rounds):
        log_good = np.log(prior) + good @ np.log(right[:, 1]) + bad @ np.log(1 - right[:, 1])
        log_bad = np.log(1 - prior) + bad @ np.log(right[:, 0]) + good @ np.log(1 - right[:, 0])
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        change = np.abs(new - post).max() if len(new) else 0.0
        post = new
        g, b = post * count, (1 - post) * count
        # One imagined vote of each kind keeps the probabilities off 0 and 1.
        prior = (g.sum() + 1) / (count.sum() + 2)
        right = np.stack([(b @ bad + 1) / (b @ (bad + good) + 2), (g @ good + 1) / (g @ (bad + good) + 2)], 1)
        if change < precision:
            break
    return prior, right, post


def toxic_rule(docs: DataFrame, labels: DataFrame | None) -> tuple[tuple[np.ndarray, np.ndarray], float, tuple[float, float]]:
    """The markers, the mark beyond which the rule votes, and the probabilities that a text isn't toxic without and with its vote."""
    none = (np.zeros(0, np.uint64), np.zeros(0)), 0.0, (1.0, 1.0)
    if labels is None:
        return none
    told = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("told_id")).agg(F.max("toxic").cast("int").alias("tox"))
    told = cut(told, "labelled")
    if told.count() <= BROADCAST_ROWS:  # else the documents are shuffled to them
        told = F.broadcast(told)
    ident = F.col("doc_id").cast("long")
    rows = cut(docs.select(ident.alias("told_doc"), F.coalesce("text", F.lit("")).alias("text")).join(told, F.col("told_doc") == F.col("told_id")).select("tox", "text", F.pmod(F.xxhash64("told_doc"), F.lit(HELD_OUT)).alias("part")), "told")
    found = markers(rows.where("part <> 0"))
    if not len(found[0]):
        return none
    held = measured(rows.where("part = 0").select(F.col("tox").alias("doc_id"), F.lit(None).cast("string").alias("lang"), "text"), found).select(F.col("doc_id").alias("tox"), "mark")
    held = cut(held, "held")
    bar = max(held.where("tox = 0").agg(F.percentile_approx("mark", TOXIC_QUANTILE, 10000)).first()[0] or 0.0, LEAST_MARK)
    n = {(r[0], r[1]): r[2] for r in held.groupBy("tox", F.col("mark") > bar).count().collect()}
    clean = [(n.get((0, vote), 0) + 1) / (n.get((0, vote), 0) + n.get((1, vote), 0) + 2) for vote in (False, True)]
    return found, bar, (clean[0], clean[1])


@owned
def judged(docs: DataFrame, labels: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_good, n_bad, marked, posterior, keep) for every row of docs."""
    spark = docs.sparkSession
    found, bar, clean = toxic_rule(docs, labels)
    v = cut(votes(cut(measured(docs, found), "measures")), "votes")
    seen = v.groupBy("pattern").count().orderBy("pattern").toPandas()  # at most 3 ** len(RULES) rows
    pattern = seen["pattern"].to_numpy(np.int64)
    _, _, post = fit(pattern, seen["count"].to_numpy(float))
    d = digits(pattern, len(RULES))
    rows = [(int(p), int((x == GOOD).sum()), int((x == BAD).sum()), float(q)) for p, x, q in zip(pattern, d, post)]
    by = F.broadcast(spark.createDataFrame(rows, "pattern int, n_good int, n_bad int, form double"))
    toxic = F.lit(bool(len(found[0]))) & (F.col("mark") > bar)
    posterior = F.round(F.col("form") * F.when(toxic, clean[1]).otherwise(clean[0]), 9)
    return v.join(by, "pattern").select("doc_id", "n_good", "n_bad", toxic.alias("marked"), posterior.alias("posterior"), (posterior >= keep).alias("keep"))


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_weak_rules": op9_weak_rules}
SQL: dict[str, str] = {}
