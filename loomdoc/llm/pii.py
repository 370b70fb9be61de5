"""PII by information-theoretic sanitisation.

Patterns find the base entities, email, ip, card and phone, and secrets: long runs of letters
and digits whose characters carry over SECRET_BITS of information each. Terms of a document
that holds an entity may reveal it. Over the distinct texts of the corpus, for an entity e (a
value such as one address, and a kind such as email) and a term t anywhere in the text: p(e)
from the texts that hold e, p(t) from those that hold t, p(e, t) from those that hold both. t
discloses e if their pointwise mutual information is at least `alpha` of all the information
that e has, and at least MIN_BITS:

    log2 p(e, t) / (p(e) p(t))  >=  max(alpha * -log2 p(e), MIN_BITS)

Such terms become spans wherever they stand in a document that holds the entity, to be removed
with it.

Copies of one passage prove nothing, however many and however lightly edited. A pair counts if
its texts are as good as `support` independent ones: with q(c) the share of the pair's texts in
which the words before (or behind) the entity's first mention are c, 1 / sum q(c)**2 is at least
`support` on either side.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import str_texts, table, written

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, SECRET, TERM = 4, 4, 5
#: Words on either side of an entity that tell its contexts apart; terms come from the whole text.
WINDOW = 4
#: Least information of a disclosing term; least bits a character of a secret, of its letters and digits.
MIN_BITS, SECRET_BITS = 1.0, 3.0
#: Candidate terms (or keys) that may be sent to every task; beyond it they are joined instead.
SENT_TERMS = 200_000
#: Texts with copies (a hash and a count each) that may be sent to every task; beyond it texts are shuffled to them.
SENT_COPIES = 2_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LONG = re.compile(r"[A-Za-z0-9]{20,}")
_EDGE = ".,;:!?()[]{}\"'|#*$%&<>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    """Leftmost matches: a local part is the run of its characters that ends at an @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    """Of each maximal chain of dotted numbers, the groups of four in turn."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        part, at = m.group().split("."), m.start()
        for i in range(0, len(part) - 3, 4):
            four = part[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base entities, in code points, sorted."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(s, 1, e) for s, e in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def secrets(text: str) -> list[tuple[int, int, int]]:
    """Runs of 20 or more letters and digits, of both kinds three or more, that look drawn at random."""
    found = []
    for m in _LONG.finditer(text) if _DIGIT.search(text) else ():
        run = m.group()
        digits = sum(map(str.isdigit, run))
        bits = -sum(n / len(run) * log2(n / len(run)) for n in Counter(run).values())
        if digits >= 3 and len(run) - digits >= 3 and bits >= SECRET_BITS:
            found.append((m.start(), SECRET, m.end()))
    return found


def entities(text: str) -> list[tuple[int, int, int]]:
    """Base entities and the secrets outside of them, sorted."""
    base = base_spans(text)
    return sorted(base + [s for s in secrets(text) if not any(b[0] < s[2] and s[0] < b[2] for b in base)])


def term_of(word: str) -> str:
    return word.strip(_EDGE).lower()


def contexts(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict]]:
    """The keys of a text, each with hashes of the words before and behind its first mention, and the terms with their places.

    A key is a kind (level 0) or a value (level 1).
    """
    import xxhash

    if not spans:
        return [], []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    ranges = [(bisect_left(ends, s + 1), bisect_left(starts, e)) for s, _, e in spans]
    taken = set().union(*(range(a, b) for a, b in ranges))
    terms = ["" if i in taken else term_of(text[s:e]) for i, (s, e) in enumerate(words)]
    digest = lambda x: xxhash.xxh64_intdigest(x) >> 1
    keys: dict[tuple[int, int], tuple[int, int]] = {}
    for (s, k, e), (first, last) in zip(spans, ranges, strict=True):
        sides = digest(" ".join(terms[max(0, first - WINDOW) : first])), digest(" ".join(terms[last : last + WINDOW]))
        for key in ((0, k), (1, digest(f"{k} {text[s:e].lower()}"))):
            keys.setdefault(key, sides)
    places: dict[str, list[dict]] = {}
    for term, s, e in zip(terms, starts, ends, strict=True):
        if term:
            word = text[s:e]
            left = s + len(word) - len(word.lstrip(_EDGE))
            places.setdefault(term, []).append({"start": left, "end": left + len(word.strip(_EDGE))})
    return [{"level": a, "name": b, "before": x, "behind": y} for (a, b), (x, y) in keys.items()], [{"term": t, "at": at} for t, at in places.items()]


_ROW = "row long, doc_id long, unit long, found array<struct<start:int,kind:int,end:int>>, keys array<struct<level:int,name:long,before:long,behind:long>>, words array<struct<term:string,at:array<struct<start:int,end:int>>>>"


def _scan(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    i32, i64 = pa.int32(), pa.int64()
    found_t = pa.list_(pa.struct([("start", i32), ("kind", i32), ("end", i32)]))
    keys_t = pa.list_(pa.struct([("level", i32), ("name", i64), ("before", i64), ("behind", i64)]))
    words_t = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.struct([("start", i32), ("end", i32)])))]))
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        texts = str_texts(batch.column(1))
        spans = [entities(t) for t in texts]
        both = [contexts(t, s) for t, s in zip(texts, spans, strict=True)]
        found = [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans]
        yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(texts)), i64), batch.column(0), batch.column(2), pa.array(found, found_t), pa.array([x for x, _ in both], keys_t), pa.array([x for _, x in both], words_t)], ["row", "doc_id", "unit", "found", "keys", "words"])
        row += len(texts)


def _frequencies(wanted):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seen: Counter = Counter()
            for text, copies in zip(str_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                terms = {term_of(w) for w in set(_WORD.findall(text))}
                seen.update((t, copies) for t in (terms if wanted is None else terms & wanted.value))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["term", "copies", "df"])

    return run


def _sent(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to every task if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _independent(df: DataFrame, by: list[str], support: int) -> DataFrame:
    """by and texts, of those whose texts (one a row, with before and behind) are as good as support independent ones."""
    sides = df.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("c")), F.struct(F.lit(1).alias("side"), F.col("behind").alias("c")))).alias("x"))
    counts = sides.groupBy(*by, "x").agg(F.count("*").cast("double").alias("n"))
    each = counts.groupBy(*by, "x.side").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    return each.groupBy(*by).agg(F.max("n").alias("texts"), F.min(F.col("n") * F.col("n") / F.col("nn")).alias("worth")).where(F.col("worth") >= support).drop("worth")


def find_spans(docs: DataFrame, alpha: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and spans, an array of (start, kind, end) sorted by start, kind.

    kind is a number into KINDS; offsets are code points, end exclusive. Base entities and secrets
    are always there; terms if the corpus shows that they disclose one. A null or empty text has
    no spans. Ids may be null or repeat. An empty input gives no rows. Other columns are not read.
    Rows are numbered by their place in the input's partitions, so an input whose order may change
    when a task is repeated should be a written table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("unit"))
    scanned = written(texts.mapInArrow(_scan, _ROW), "entities")
    sizes = written(scanned.groupBy("unit").agg(F.count("*").alias("copies")), "sizes")
    n = sizes.count()
    holding = scanned.where(F.size("keys") > 0)
    # one row of each text counts; copies are alike in all that is counted
    one = holding.groupBy("unit").agg(F.min("row").alias("row")).select("row")
    key = ["level", "name"]
    keyed = holding.select("row", "keys").join(one, "row").select("row", F.explode("keys").alias("k")).select("row", "k.*")
    by_key = _sent(written(_independent(keyed, key, support).withColumnRenamed("texts", "c_key"), "keys"), SENT_TERMS)
    live = keyed.join(by_key, key).groupBy("row").agg(F.collect_list(F.struct(*key, "c_key", "before", "behind")).alias("live"))
    both = holding.select("row", F.col("words.term").alias("terms")).join(live, "row").select(F.explode("live").alias("k"), "terms").select("k.*", F.explode("terms").alias("term"))
    pairs = written(both.groupBy(*key, "term").agg(F.count("*").alias("c_pair"), F.first("c_key").alias("c_key")).where(F.col("c_pair") >= support), "pairs")
    candidates = written(pairs.select("term").distinct(), "candidates")
    wanted = spark.sparkContext.broadcast({r.term for r in candidates.collect()}) if candidates.count() <= SENT_TERMS else None
    # c copies of a text count 1/c each; the sum for each c is a whole number of texts
    copied = _sent(sizes.where("copies > 1"), SENT_COPIES)
    weighed = texts.join(copied, "unit", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    df = weighed.mapInArrow(_frequencies(wanted), "term string, copies long, df long").groupBy("term", "copies").agg((F.sum("df") / F.col("copies")).alias("df")).groupBy("term").agg(F.sum("df").alias("df"))
    information = -F.log2(F.col("c_key") / n)
    mutual = F.log2(F.col("c_pair") * F.lit(float(n)) / (F.col("c_key") * F.col("df")))
    likely = _sent(written(pairs.join(df, "term").where((mutual >= alpha * information) & (mutual >= MIN_BITS)).select(*key, "term"), "likely"), SENT_TERMS)
    disclosing = written(_independent(both.join(likely, [*key, "term"]), [*key, "term"], support).drop("texts"), "disclosing")
    # all places of a disclosing term, in every document (copies too) that holds its entity
    places = holding.select("row", F.explode("words").alias("w")).select("row", "w.*").join(_sent(disclosing.select("term").distinct(), SENT_TERMS), "term")
    holds = holding.select("row", F.explode("keys").alias("k")).select("row", "k.level", "k.name")
    marked = places.join(holds, "row").join(_sent(disclosing, SENT_TERMS), [*key, "term"]).select("row", F.explode("at").alias("p")).select("row", "p.*")
    added = marked.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(TERM).alias("kind"), "end")).alias("added"))
    every = scanned.select("row", "doc_id", "found").join(added, "row", "left")
    return every.select("doc_id", F.array_sort(F.concat("found", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def sanitise(docs: DataFrame, alpha: float = 0.9, support: int = 3) -> DataFrame:
    """docs with text rewritten: entities are generalised to their kind's name, terms removed.

    Overlapping spans are replaced as one, under the first one's name. Rows that share an id
    must share their text.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, spans in zip(str_texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                done, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        done += [text[at : s["start"]], "" if s["kind"] == TERM else f"[{KINDS[s['kind']].upper()}]"]
                    at = max(at, s["end"])
                out.append("".join(done) + text[at:])
            names = [c for c in batch.schema.names if c != "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    spans = find_spans(docs, alpha, support).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "_id")
    return docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_id"))).select(*docs.columns, "spans").mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(len(KINDS))]
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
