"""Toxicity by weak supervision.

1. Terms are learned from a bounded, hash-chosen sample of labelled training rows, near copies
   folded: whole words, word beginnings, and beginnings that two or more distinct words of a text
   share. How far a kind of term with so many hits can be trusted is measured within the sample:
   terms found on three quarters of it are tried on the last quarter, in turn. Kinds that hold
   up give the voters; a short lexicon is always among them.
2. Every term is a voter, which fires or abstains; one more says no where no term is found. The
   label model (two latent classes) estimates by EM, over the histogram of all documents' vote
   sets, how often each voter fires in either class, anchored by the training rows. Voters that
   still fire together within a class are correlated; a vote counts by one over the sum of its
   correlations. Rounds are groupings on Spark; a row for each voter, or pair of voters, comes back.
3. A linear classifier over the votes and hashed word beginnings is fitted to the posterior labels
   of a bounded, hash-chosen sample of documents, and scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import str_texts, table, written

#: Insults that are voters in every corpus.
LEXICON = ("idiot", "moron", "stupid", "imbecile", "scum", "loser", "pathetic", "worthless", "disgusting", "dumbass", "bastard", "retard")
#: Labelled rows that terms are learned from, and documents that the classifier is fitted to, at most.
LABELLED_ROWS, FITTED_ROWS = 10_000, 10_000
#: Learned terms at most; lengths of word beginnings.
TERMS, STARTS = 512, (4, 5, 6, 7)
#: Hits from which a new level of trust begins; folds that trust is measured on; least share of toxic
#: texts among a term's own; least share among those that terms of its kind and level hit unseen.
LEVELS, FOLDS, MARKS, TRUST = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128), 4, 0.9, 0.85
#: Hashed word beginnings that the classifier sees; its ridge on votes and on those.
HASHED, RIDGE = 1 << 14, (0.1, 10.0)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(words: set[str]) -> set[str]:
    """w:word, s:beginning of a longer word, d:beginning of two or more longer words."""
    out = {"w:" + w for w in words}
    for k in STARTS:
        starts = Counter(w[:k] for w in words if len(w) > k)
        out.update("s:" + s for s in starts)
        out.update("d:" + s for s, n in starts.items() if n > 1)
    return out


class Known:
    """The voters' terms, laid out so that a text is asked only for what is known."""

    def __init__(self, terms: list[str]):
        self.none = len(terms)  # the voter that says no
        kinds: dict[str, dict[str, int]] = {"w": {}, "s": {}, "d": {}}
        for i, t in enumerate(terms):
            kinds[t[0]][t[2:]] = i
        self.words, starts, doubled = kinds["w"], kinds["s"], kinds["d"]
        self.sizes = [(k, {s for s in (*starts, *doubled) if len(s) == k}) for k in STARTS]
        self.starts, self.doubled = starts, doubled

    def votes(self, words: set[str]) -> list[int]:
        """The sorted numbers of the terms of a text's words; the voter that says no if there are none."""
        found = [self.words[w] for w in words & self.words.keys()]
        for k, known in self.sizes:
            for s in {w[:k] for w in words} & known if known else ():
                n = sum(len(w) > k and w.startswith(s) for w in words)
                found += [kind[s] for least, kind in ((1, self.starts), (2, self.doubled)) if n >= least and s in kind]
        return sorted(found) or [self.none]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _sample(docs: DataFrame) -> DataFrame:
    """toxic, fold and terms of the sample's documents, near copies folded."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            words = [_WORD.findall(t.lower()) for t in str_texts(batch.column(0))]
            # near copies mostly share the least hash of their three-word shingles
            least = [min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1 for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), batch.column(1), pa.array([sorted(terms_of(set(w))) for w in words], pa.list_(pa.string()))], ["sketch", "toxic", "terms"])

    chosen = docs.mapInArrow(run, "sketch long, toxic int, terms array<string>")
    one = chosen.groupBy("sketch").agg(F.max(F.struct("toxic", "terms")).alias("x"))
    return one.select((F.xxhash64("sketch").bitwiseAND(1023) % FOLDS).cast("int").alias("fold"), "x.toxic", "x.terms")


def trust(tried: dict[tuple[str, int], tuple[int, int]], base: float) -> dict[tuple[str, int], float]:
    """Of each kind and level, the share of toxic texts hit unseen, never falling with the level.

    tried: toxic and all texts hit. Levels that would fall are pooled; two texts of the base rate are added.
    """
    out = {}
    for kind in "wsd":
        pools: list[list] = []
        for level in range(len(LEVELS)):
            pools.append([*tried.get((kind, level), (0, 0)), [level]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                toxic, n, levels = pools.pop()
                pools[-1] = [pools[-1][0] + toxic, pools[-1][1] + n, pools[-1][2] + levels]
        out.update({(kind, level): (toxic + 2 * base) / (n + 2) for toxic, n, levels in pools for level in levels})
    return out


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Terms that mark toxic texts of the sample, with the trust in them; the lexicon's words always."""
    lexicon = {"w:" + w: 0.9 for w in LEXICON}
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return lexicon
    per_fold = [F.sum((F.col("fold") == k).cast("long") * x).alias(f"{name}{k}") for k in range(FOLDS) for name, x in (("all", F.lit(1)), ("hit", F.col("toxic")))]
    counts = sample.select("fold", "toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("hit"), F.count("*").alias("all"), *per_fold)
    counts = written(counts.where("hit >= 2 AND hit * 4 >= all * 2"), "terms")
    level = lambda hit: reduce(lambda a, b: a + b, [(hit >= x).cast("int") for x in LEVELS]) - 1
    kind = F.substring("term", 1, 1)
    folds = F.explode(F.array(*(F.struct((F.col("hit") - F.col(f"hit{k}")).alias("hit"), (F.col("all") - F.col(f"all{k}")).alias("all"), F.col(f"hit{k}").alias("toxic"), F.col(f"all{k}").alias("n")) for k in range(FOLDS))))
    tried = counts.select("term", folds.alias("f")).select("term", "f.*").where((F.col("hit") >= 2) & (F.col("hit") >= MARKS * F.col("all"))).groupBy(kind.alias("kind"), level(F.col("hit")).alias("level")).agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    trusted = trust({(r.kind, r.level): (r.toxic, r.n) for r in tried.collect()}, toxic / n)
    good = [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("level")) for (k, v), p in trusted.items() if p >= TRUST]
    if not good:
        return lexicon
    best = counts.where((F.col("hit") >= MARKS * F.col("all")) & F.struct(kind.alias("kind"), level(F.col("hit")).alias("level")).isin(*good))
    found = best.orderBy(F.desc("hit"), F.length("term"), "term").limit(TERMS).select("term", kind.alias("kind"), level(F.col("hit")).alias("level")).collect()
    return lexicon | {r.term: trusted[r.kind, r.level] for r in found}


def votes(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and votes: the sorted numbers of the terms found, or the number after the last if there are none."""
    known = Known(terms)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [known.votes(words_of(t)) for t in str_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "votes"])

    return docs.mapInArrow(run, "doc_id long, votes array<int>")


class LabelModel:
    """Two latent classes over vote sets; fit() estimates accuracies and correlations.

    sets: votes (array of voters), n (documents), clean and toxic (training rows among them).
    """

    def __init__(self, trusts: list[float]):
        """trusts: for each voter the share of toxic documents expected among those it fires in."""
        self.trusts = np.array(trusts)

    def fit(self, sets: DataFrame, rounds: int = 5) -> LabelModel:
        n, clean, toxic = (float(x or 0) for x in sets.agg(F.sum("n"), F.sum("clean"), F.sum("toxic")).first())
        self.anchor = n / (clean + toxic) if clean + toxic else 0.0
        share = (toxic + 1) / (clean + toxic + 2) if clean + toxic else 0.05
        self.bias, self.weight = np.log(share / (1 - share)), np.ones(len(self.trusts))
        self.gain = np.log(self.trusts / (1 - self.trusts)) - self.bias
        for step in range(rounds):
            sums = self._sums(sets, step == rounds - 1)
            total = np.maximum(sums[-1, -1], 1e-9)
            self.rate = np.array([(sums.get((j, j), np.zeros(2)) + [0.02, 0.1]) / (total + 1) for j in range(len(self.trusts))])
            self.gain = np.log(self.rate[:, 1] / self.rate[:, 0])
            self.bias = np.log((total[1] + 1) / (total[0] + 1))
        spread, self.correlation = np.sqrt(self.rate * (1 - self.rate)) + 1e-9, np.eye(len(self.trusts))
        for (i, j), both in sums.items():
            if i != j:
                by_class = (both / total - self.rate[i] * self.rate[j]) / (spread[i] * spread[j])
                self.correlation[i, j] = self.correlation[j, i] = float((by_class @ total / total.sum()).clip(0, 1))
        self.weight = 1 / self.correlation.sum(1)
        return self

    def posterior(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(toxic) of vote sets laid end to end; no set is empty."""
        odds = self.bias + np.add.reduceat((self.gain * self.weight)[flat], starts) if len(starts) else np.zeros(0)
        return 1 / (1 + np.exp(-odds.clip(-30, 30)))

    def _sums(self, sets: DataFrame, pairs: bool) -> dict[tuple[int, int], np.ndarray]:
        """Documents of either class in which voters i and j fire: at (i, i) alone, and all at (-1, -1)."""
        model, voters = self, len(self.trusts)

        def run(batches):
            import pyarrow as pa

            seen: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                flat, starts, size = _flat(batch.column("votes"))
                post = model.posterior(flat, starts)
                n, clean, toxic = (batch.column(c).to_numpy() for c in ("n", "clean", "toxic"))
                mass = np.stack([n * (1 - post) + model.anchor * clean, n * post + model.anchor * toxic], 1)
                alone = np.stack([np.bincount(flat, np.repeat(mass[:, c], size), voters) for c in (0, 1)], 1)
                for j in np.flatnonzero(alone.sum(1)).tolist():
                    seen[j, j] = seen.get((j, j), 0) + alone[j]
                seen[-1, -1] = seen.get((-1, -1), 0) + mass.sum(0)
                for s, k, m in zip(starts[size > 1], size[size > 1], mass[size > 1], strict=True) if pairs else ():
                    own = flat[s : s + k].tolist()
                    for a, i in enumerate(own):
                        for j in own[a + 1 :]:
                            seen[i, j] = seen.get((i, j), 0) + m
            keys, sums = list(seen), np.array(list(seen.values())).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["i", "j", "clean", "toxic"])

        rows = sets.mapInArrow(run, "i int, j int, clean double, toxic double").groupBy("i", "j").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        return {(-1, -1): np.zeros(2)} | {(r.i, r.j): np.array([r.clean, r.toxic]) for r in rows.collect()}


def _flat(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of an Arrow list column laid end to end, and where each list starts, and its size."""
    import pyarrow.compute as pc

    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(), np.cumsum(size) - size, size


def features(text: str, known: Known) -> tuple[list[int], dict[int, float]]:
    """Votes, and hashed word beginnings, each with the number of distinct words that have it over the text's size."""
    words = words_of(text)
    scale = np.log(2 + len(words))
    return known.votes(words), {h: min(n, 4) / scale for h, n in Counter(zlib.crc32(w[:4].encode()) % HASHED for w in words).items()}


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, ridge: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft labels, by limited-memory BFGS.

    rows: each the numbers and the values of its features.
    """
    n, size = len(rows), len(ridge)
    row = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    at, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))

    def loss(w):
        z = np.bincount(row, value * w[at], n) + w[size]
        wrong = 1 / (1 + np.exp(-z.clip(-30, 30))) - target
        slope = np.append(np.bincount(at, value * wrong[row], size) + ridge * w[:size], wrong.sum())
        return (np.logaddexp(0, z) - target * z).sum() + (ridge * w[:size] ** 2).sum() / 2, slope

    w = np.zeros(size + 1)
    f, g = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = g.copy(), []
        for s, y in reversed(moves):
            used.append((s @ d) / (y @ s))
            d -= used[-1] * y
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(np.linalg.norm(g), 1e-12)
        for s, y in moves:
            d += s * (used.pop() - (y @ d) / (y @ s))
        t = 1.0
        while (new := loss(w - t * d))[0] > f - 1e-4 * t * (g @ d) and t > 1e-10:
            t /= 2
        if (-t * d) @ (new[1] - g) > 1e-12:
            moves = [*moves[-7:], (-t * d, new[1] - g)]
        w, done, (f, g) = w - t * d, f - new[0] < 1e-7 * abs(f), new
        if done:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, fitted_rows: int = FITTED_ROWS, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Training rows have a label and a crc32 of the id, as text, that is not 2 modulo 4; of a
    repeated id the largest label counts. A null or empty text gets no votes and the score
    that this has; a null id is not held out. Without training rows the lexicon alone votes.
    An empty docs gives no rows. Scores depend on the text only: other columns of docs, lang and
    source among them and whatever their names, are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # at most labelled_rows rows of two numbers, so it can go to every task
    train = F.broadcast(written(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows), "train"))
    terms = learn_terms(written(_sample(texts.join(train, "doc_id").select("text", "toxic")), "sample"))
    cast = written(votes(texts, list(terms)), "votes")
    sets = cast.join(train, "doc_id", "left").groupBy("votes").agg(F.count("*").cast("double").alias("n"), F.sum(F.coalesce(1 - F.col("toxic"), F.lit(0))).cast("double").alias("clean"), F.sum(F.coalesce("toxic", F.lit(0))).cast("double").alias("toxic"))
    model = LabelModel([*terms.values(), 0.01]).fit(written(sets, "sets"))
    known = Known(list(terms))
    votes_, width = known.none + 1, known.none + 1 + HASHED

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [features(t, known) for t in str_texts(batch.column(0))]
            at = [np.array([*votes, *(votes_ + h for h in starts)], np.int32).tobytes() for votes, starts in rows]
            value = [np.array([*[1.0] * len(votes), *starts.values()], np.float32).tobytes() for votes, starts in rows]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["at", "value"])

    # near fitted_rows documents: a hash of the text draws a text with its copies, and copies count once
    drawn = texts.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(max(1, docs.count() // fitted_rows))) == 0).dropDuplicates(["text"]).orderBy(F.xxhash64("text")).limit(fitted_rows)
    # numbers and values as bytes: some kilobytes a document on the driver
    rows = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32)) for r in drawn.select("text").mapInArrow(read, "at binary, value binary").collect()]
    fires = [i[i < votes_] for i, _ in rows]
    target = model.posterior(np.concatenate(fires), np.cumsum([0, *map(len, fires)])[:-1]) if rows else np.zeros(0)
    ridge = np.where(np.arange(width) < votes_, *RIDGE)
    weights = fit_linear(rows, target, ridge) if rows else np.zeros(width + 1)

    def run(batches):
        import pyarrow as pa

        own, hashed = weights[:votes_].tolist(), weights[votes_:width].tolist()
        for batch in batches:
            rows = (features(t, known) for t in str_texts(batch.column(1)))
            logit = [sum(own[i] for i in votes) + sum(hashed[h] * x for h, x in starts.items()) + weights[width] for votes, starts in rows]
            score = 1 / (1 + np.exp(-np.array(logit, float).clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = texts.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
