import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomdoc.llm import html, mixing, pieces, pii, quality, sharding, token_counts, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# op 1
def test_html_training_pages_held_out():
    model, wrong, total = html.default_model(), 0, 0
    for page, mark in html.labelled_pages(150, seed=77):
        kept = model.main_text(page).split("\n\n")
        for _, text in html.Page(page).blocks:
            total += 1
            wrong += (mark in text) != (text in kept)
    assert wrong < 0.05 * total


def test_html_exact_marginals():
    """Sum-product against summing over all states of a small tree."""
    import itertools
    import math

    model, page = html.default_model(), html.Page("<body><div class=ad>x y</div><article><p>Some text.<p>More <b>text</b></article>")
    own = [sum(map(model.weight, f)) for f in page.features()]
    n, mass, on = len(own), 0.0, [0.0] * len(own)
    for states in itertools.product((0, 1), repeat=n):
        if states[0]:
            continue
        p = math.exp(sum(o * s for o, s in zip(own, states, strict=True)) + sum(model.edge[states[page.parent[i]]][states[i]] for i in range(1, n)))
        mass += p
        on = [x + p * s for x, s in zip(on, states, strict=True)]
    assert model.marginals(page) == pytest.approx([x / mass for x in on], abs=1e-9)


def test_html_pages(spark):
    out = {r.page_id: r for r in html.op1_main_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (" ".join(html_text(b).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        assert out[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert out[r.page_id].n_chars == len(out[r.page_id].text)


def html_text(s):
    import html as lib

    return lib.unescape(re.sub(r"<[^>]+>", lambda m: " " if m.group().startswith("<br") else "", s))


def test_html_edges(spark):
    pages = {
        1: (None, ""), 2: ("", ""), 3: ("<p>" * 3000 + "deep &amp; down", "deep & down"), 4: ("no markup", "no markup"), 5: ("<body>text</body>", "text"), 6: ("<body>text<br><br>text</body>", "text text"),
        7: ("<p>a b c d <![foo[bar]]> e</p>", "a b c d e"), 8: ("<![ bad ]>text here", "text here"), 9: ("<![0]>some", "some"), 10: ("<p>one <svg><path/></svg> two <script>x</script> three <button>go</button> four</p>", "one two three four"),
        11: ("<nav><ul><li><a href=/>Home</a></li></ul></nav>", ""), 12: ("<body><nav><a href=/>Home</a></nav>The text of this page is right here, and long.<footer>(c) all</footer>", "The text of this page is right here, and long."),
    }
    df = spark.createDataFrame([(i, h, 9) for i, (h, _) in pages.items()] + [(1, None, 9)], "page_id long, html string, main_text int")
    got = html.extract(df).collect()
    assert len(got) == len(pages) + 1
    for r in got:
        assert r.main_text == pages[r.page_id][1], r.page_id
    assert html.extract(df.where("false")).count() == 0


def test_html_reads_anything_in_linear_time():
    import time

    r = random.Random(1)
    bits = ["<", "![", "<![", "[", "]]>", ">", "<!", "--", "</", "p", "div", "<p>", "<div class='a'>", 'a="', "&amp", "&#x", "&#99999999;", "<script>", "</script>", "text ", "'", "/>", "<svg", "<!DOCTYPE", "\x00", "<?", "CDATA[", "<title>", "\u00e9"]
    for _ in range(5000):
        html.Page("".join(r.choice(bits) for _ in range(r.randint(1, 14))))
    took = []
    for n in (5000, 20000):
        began = time.process_time()
        html.Page("<div>" * n + "<p>text</p>" * n + "</b></p>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


# op 3
def test_token_counts(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = [len(enc.encode_ordinary(t)) for t in texts(spark).values()]
    hist = token_counts.op3_token_counts(spark, SF)
    rows = hist.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.truncated_tokens == sum(min(r.n_tokens, x) for x in lengths)
        assert (r.docs_from, r.tokens_from) == (sum(x >= r.n_tokens for x in lengths), sum(x for x in lengths if x >= r.n_tokens))
    for limit in (0, 77, 1000, 10**9):
        assert hist.agg(token_counts.truncated_total(hist, limit).alias("n")).first().n == sum(min(limit, x) for x in lengths)
    assert hist.agg(token_counts.quantile(hist, 0.5).alias("n")).first().n == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.length_histogram(hist.select("n_tokens").where("false")).count() == 0


def test_token_counts_odd_rows(odd, empty):
    import public_tokenizers as P

    lengths = lambda df: token_counts.token_lengths(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    hist = {r.n_tokens: r for r in token_counts.length_histogram(lengths(odd)).collect()}
    # two rows without an id and two of one id count each; the null text has no token
    assert hist[0].n_docs == 1 and sum(r.n_docs for r in hist.values()) == 6 and hist[0].docs_from == 6
    assert token_counts.length_histogram(lengths(empty)).count() == 0


# op 4
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pos = [out[i].score for i, y in labels.items() if out[i].held_out and y]
    neg = [out[i].score for i, y in labels.items() if out[i].held_out and not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    print("held out:", auc, sum(x >= 0.3 for x in pos), len(pos), sum(x >= 0.3 for x in neg), len(neg))
    assert auc > 0.9 and all(r.predicted == (r.score >= 0.3) for r in out.values())


def test_toxicity_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(None, 1, 1), (5, None, None), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, none).count() == 6
    assert toxicity.toxicity(odd, some).count() == 6
    assert toxicity.toxicity(empty, some).count() == 0
    bad = spark.createDataFrame([(1, "you stupid worthless idiot"), (2, "a fine day")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.toxicity(bad, none).collect()}
    assert score[1] > score[2]


def test_trust_never_falls_with_the_level():
    tried = {("w", 0): (2, 20), ("w", 1): (9, 10), ("w", 3): (4, 10), ("w", 5): (50, 50)}
    got = [toxicity.trust(tried, 0.1)["w", k] for k in range(len(toxicity.LEVELS))]
    assert got == sorted(got) and got[0] == pytest.approx(2.2 / 22) and got[1] == got[4] == pytest.approx(13.2 / 22) and got[-1] > 0.9
    assert toxicity.terms_of({"abcdx", "abcdy", "no"}) >= {"w:no", "s:abcd", "d:abcd"} and "d:abcdx" not in toxicity.terms_of({"abcdx", "abcdy"})


def test_known_terms_vote_as_all_terms_do():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    terms = sorted(toxicity.terms_of({word() for _ in range(400)}))
    terms = r.sample(terms, 300)
    known = toxicity.Known(terms)
    for _ in range(500):
        words = {word() for _ in range(r.randint(0, 12))}
        want = sorted(terms.index(t) for t in toxicity.terms_of(words) & set(terms))
        assert known.votes(words) == (want or [300])


def test_label_model_finds_accuracies_and_correlation(spark):
    import numpy as np

    # toxic texts make few voters fire, as each voter knows one term: abstaining is no evidence
    r = np.random.default_rng(0)
    voters = 12
    y = r.random(20000) < 0.1
    rates = np.linspace(0.05, 0.3, voters)
    fires = r.random((len(y), voters)) < np.where(y[:, None], rates, 0.002)
    fires[:, 1] = fires[:, 0]  # one voter copies another
    rows = [(tuple(np.flatnonzero(f).tolist()) or (voters,), k < 2000, bool(t)) for k, (f, t) in enumerate(zip(fires, y, strict=True))]
    sets = defaultdict(lambda: [0.0, 0.0, 0.0])
    for v, known, t in rows:
        sets[v][0] += 1
        sets[v][1 + t] += known
    df = spark.createDataFrame([(list(v), *x) for v, x in sets.items()], "votes array<int>, n double, clean double, toxic double").repartition(3)
    m = toxicity.LabelModel([0.8] * voters + [0.01]).fit(df)
    assert abs(1 / (1 + np.exp(-m.bias)) - 0.1) < 0.03 and abs(m.rate[2:-1, 1] - rates[2:]).mean() < 0.03 and abs(m.rate[2:-1, 1] - rates[2:]).max() < 0.1
    assert m.correlation[0, 1] > 0.8 and m.weight[0] < 0.7 and m.correlation[2, 3] < 0.3


def test_linear_classifier_fits_soft_labels():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.random((400, 6)) * (r.random((400, 6)) < 0.5)
    true = np.array([3.0, -2, 0, 1, 0, 4])
    target = 1 / (1 + np.exp(-(x @ true - 1)))
    rows = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in x]
    w = toxicity.fit_linear(rows, target, np.full(6, 1e-6))
    assert abs(w - [*true, -1]).max() < 0.05


# op 5
def test_pieces(spark, docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for block_chars in (100, 1 << 25):
        got = {r.doc_id: r for r in pieces.encode_decode(docs, pieces.default_model(), block_chars=block_chars).collect()}
        for i, t, *_ in rows:
            assert got[i].ids == lib.encode(t or "")
            assert got[i].decoded == lib.decode(lib.encode(t or ""))
    want = texts(spark)
    for r in pieces.op5_sentencepiece(spark, SF).collect():
        ids = lib.encode(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_packing_round_trips():
    import numpy as np

    r = np.random.default_rng(2)
    for values in (np.zeros(0, np.int32), np.array([0, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1], np.int32), r.integers(0, 1 << 22, 5000).astype(np.int32)):
        raw, size = pieces.varints(values)
        assert (pieces.read_varints(raw) == values).all() and size.sum() == len(raw)
    for words in ([], ["", "▁a", "▁\u00e9\U0001f642", "▁▁"]):
        assert pieces.unpack(pieces.pack(words)) == words
    lengths, ids = pieces.unpack_lists(pieces.pack_lists([[1, 2], [], [70000]]))
    assert lengths.tolist() == [2, 0, 1] and ids.tolist() == [1, 2, 70000]


def test_pieces_edges(odd, empty):
    got = pieces.encode_decode(odd, pieces.default_model()).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "6", "7", "None", "None"] and [r.ids for r in got if r.doc_id == 6] == [[]]
    assert pieces.encode_decode(odd, pieces.default_model(), decode=False).columns == ["doc_id", "ids"]
    assert pieces.encode_decode(empty, pieces.default_model()).count() == 0
    assert [r.decoded for r in pieces.encode_decode(odd.where("doc_id = 6"), pieces.default_model()).collect()] == [""]


def test_pieces_random_texts(spark):
    """Texts of markers, spaces and rare characters against the library; a run of one word over several batches."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(8)
    rows = [(i, "".join(r.choice("  ▁ab\n\t\u00e9\U0001f642\u4e2dthe<s>") for _ in range(r.randint(0, 25)))) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = pieces.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), pieces.default_model(), block_chars=900).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {i: lib.encode(t) for i, t in rows}
    assert len(got) == len(rows)
    assert all(x.ids == want[x.doc_id] and x.decoded == lib.decode(want[x.doc_id]) for x in got)


# op 6
def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(spans)


def test_pii_base_spans_random():
    r = random.Random(4)
    for _ in range(30000):
        text = "".join(r.choice("a1@..-+ (9 4é%0") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_query(spark):
    want = texts(spark)
    for r in pii.op6_pii(spark, SF).collect():
        spans = brute_spans(want[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in spans) for x in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_pii_discloses(spark):
    r = random.Random(2)
    filler = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(6))
    rows = [(i, f"{filler()} Zorblat, jo@x.org {filler()}" if i % 10 == 0 else filler()) for i in range(300)]
    rows += [(None, None), (None, ""), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r.asDict(True) for r in pii.find_spans(df).collect()]
    terms = [(r["doc_id"], s) for r in found for s in r["spans"] if s["kind"] == pii.TERM]
    assert terms and all(rows[i][1][s["start"] : s["end"]] == "Zorblat" for i, s in terms) and len(terms) == 30
    clean = {r.doc_id: r.text for r in pii.sanitise(df.where("doc_id is not null")).collect()}
    assert "[EMAIL]" in clean[10] and "Zorblat" not in clean[10]
    assert pii.find_spans(df.where("false")).count() == 0


def test_pii_discloses_far_from_the_entity(spark):
    r = random.Random(3)
    filler = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(12))
    rows = [(i, f"Zorblat {filler()} jo@x.org {filler()} (Zorblat) {filler()}" if i % 10 == 0 else filler()) for i in range(300)]
    rows += [(1000 + i, f"{filler()} passage of old and mo@y.org Quux beside {filler()}") for i in range(20)]
    found = {x.doc_id: x.spans for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        terms = [text[s.start : s.end] for s in found[i] if s.kind == pii.TERM]
        assert terms.count("Zorblat") == text.count("Zorblat")
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any("Zorblat" in x.text for x in clean)


def test_pii_copied_passages_prove_nothing(spark):
    r = random.Random(5)
    filler = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(12))
    rows = [(i, f"{filler()} this old passage says mo@y.org Quux wrote it all {filler()}" if i % 10 == 0 else filler()) for i in range(300)]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(s.kind == pii.TERM for x in found for s in x.spans)


def test_pii_copies_hide_nothing(spark, monkeypatch):
    r = random.Random(6)
    filler = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(12))
    rows = [(i, f"{filler()} Dupont\u00a0: jo@x.org {filler()}" if i % 60 == 0 else filler()) for i in range(300)]
    rows += [(1000, "a letter by Dupont\u00a0: without an address")]
    rows += [(2000 + i, rows[-1][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (False, True):
        if small:
            monkeypatch.setattr(pii, "SENT_TERMS", 0)
            monkeypatch.setattr(pii, "SENT_COPIES", 0)
        terms = {(x.doc_id, s.start) for x in pii.find_spans(df).collect() for s in x.spans if s.kind == pii.TERM}
        assert terms == {(i, t.index("Dupont")) for i, t in rows[:300] if "Dupont" in t}


def test_pii_one_document_proves_nothing(spark):
    """Forty addresses of one document, and of its near copies, mark no word; alone or among others."""
    many = " ".join(f"please write to u{i}@x.org at once thanks" for i in range(40))
    r = random.Random(7)
    filler = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(12))
    near = [(100 + i, " ".join(w if r.random() > 0.05 else "edited" for w in many.split())) for i in range(30)]
    for rows in ([(1, many)], [(1, many), *near], [(1, many), *near, *((1000 + i, filler()) for i in range(300))]):
        found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert not any(s.kind == pii.TERM for x in found for s in x.spans)


def test_pii_secrets(spark):
    r = random.Random(8)
    filler = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(8))
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{filler()} token = "{key()}" {filler()}' if i % 20 == 0 else filler()) for i in range(400)]
    for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got = sorted(rows[x.doc_id][1][s.start : s.end] for s in x.spans)
        assert len(got) == (3 if x.doc_id % 20 == 0 else 0) and got[-1:] == ["token"] * (x.doc_id % 20 == 0)
    for text in ("a" * 30, "12345678901234567890123", "abcabcabcabcabc123123123", "incomprehensibilities", ""):
        assert not pii.secrets(text)


# op 7
def brute_targets(sizes):
    """The excess of full sources is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        t = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        more = {s for s in names if t[s] > 2 * sizes[s] + 1e-9}
        if not more:
            return t
        full |= more


def check_mix(out, rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    source = {i: s for i, _, s in rows}
    goal = brute_targets(sizes)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6, (s, taken[s], goal[s])


def test_mix(spark, docs, rows):
    rows = [(i, t, s) for i, t, _, s, _ in rows]
    out = mixing.mix(docs).collect()
    check_mix(out, rows)
    assert sorted(out) == sorted(mixing.mix(docs.repartition(2)).collect())
    check_mix(mixing.op7_mix_sources(spark, SF).collect(), [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_mix_edges(spark, odd, empty):
    assert mixing.mix(odd).count() == 6
    assert mixing.mix(empty).count() == 0
    # rows without an id are told apart by their texts
    rows = [(None, f"some words of text {i}", "a") for i in range(400)] + [(i, "b " * 5, "b") for i in range(200)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'a'").collect()
    assert abs(sum(r.taken for r in out) - out[0].target) <= 5


def test_mix_ties_of_hashes(spark):
    """Rows that are alike in all have one hash: the boundary takes them together or not at all."""
    rows = [(i // 4, "w " * 3, "ab"[i % 2]) for i in range(64)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        assert abs(sum(r.taken for r in out if r.source == s) - next(r.target for r in out if r.source == s)) <= 3


# op 8
def brute_repeats(words):
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    return len({j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)})


def brute_quality(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, brute_repeats(words)]


def test_quality(spark, docs, rows):
    r = random.Random(9)
    for _ in range(3000):
        text = " ".join(r.choice("ab\n|é") for _ in range(r.randint(0, 60)))
        t = quality.Text(text)
        assert [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words] == brute_quality(text)
    for got, want in ((quality.quality(docs, measures=True), {i: t or "" for i, t, *_ in rows}), (quality.op8_quality(spark, SF), texts(spark))):
        for r in got.collect():
            b = brute_quality(want[r.doc_id])
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == b
            assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and r.kept == brute_kept(want[r.doc_id])


def brute_kept(text):
    """The rules written out anew over plain splits."""
    n, chars, symbols, dup, repeats = brute_quality(text)
    words, letters = WORD.findall(text), [c for c in text if c.isalpha()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    bad = n < 20 or 100 * repeats > 30 * n or symbols * 10 > n or chars < 2 * n or chars > 15 * n
    bad = bad or sum(map(str.isupper, text)) > 0.5 * max(1, len(letters)) or same * 10 > 3 * n
    return not (bad or dup >= 3 and dup * 10 > 3 * (text.count("\n") + 1))


def test_quality_order_never_changes_verdicts(spark, odd, empty, docs):
    wordy = [(i, t) for i, t in enumerate(["a b c", "### word more " * 30, "word " * 100, "GO ON THEN " * 40, "one line\n" * 30, "good words that go on in one line and never stop or say the same thing again so far as we know " * 1])]
    df = spark.createDataFrame(wordy, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    r = random.Random(3)
    first = None
    for _ in range(6):
        order = r.sample(list(quality.RULES), len(quality.RULES))
        kept = {x.doc_id: x.kept for x in quality.quality(df, order=order).collect()}
        assert first in (None, kept)
        first = kept
    drawn = quality.order_rules(df, 5)
    assert sorted(drawn) == sorted(quality.RULES)
    assert {x.doc_id: x.kept for x in quality.quality(df).collect()} == first
    assert quality.quality(odd).count() == 6 and quality.quality(empty).count() == 0


# op 9
def test_sharding(spark, docs, rows):
    for df, ids in ((sharding.external_shuffle(docs, bucket_bytes=20000), [r[0] for r in rows]), (sharding.op9_shard(spark, SF), list(texts(spark)))):
        out = df.collect()
        assert sorted(r.doc_id for r in out) == sorted(ids)
        shards = defaultdict(list)
        for r in out:
            shards[r.shard].append(r.slot)
        counts = [len(shards[k]) for k in range(40)]
        assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs.repartition(5), bucket_bytes=20000).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs, bucket_bytes=20000).collect()}


def test_sharding_edges(odd, empty, tmp_path, spark, docs):
    assert sharding.external_shuffle(odd).count() == 6
    assert sharding.external_shuffle(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4, bucket_bytes=20000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    for x in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(x)).collect()]
        assert slots == sorted(slots)


@pytest.mark.parametrize("ids", ["null", "own"])
def test_sharding_spreads_hot_rows(spark, ids):
    """A third of all rows are the same row, or share their id: no bucket grows with them, and reruns agree."""
    hot = [(None if ids == "null" else 7, "same text " * 20 if i % 2 else f"text {i} " * 20, i % 2, None) for i in range(600)]
    rows = hot + [(1000 + i, f"other {i} " * 20, 5, "x" * 100000 if i == 3 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int, place string")
    out = sharding.external_shuffle(df, shards=8, bucket_bytes=10000, text_col="text")
    got = sorted(map(str, out.collect()))
    assert sorted(map(str, out.drop("shard", "slot").collect())) == sorted(map(str, df.collect()))
    assert got == sorted(map(str, sharding.external_shuffle(df.repartition(7), shards=8, bucket_bytes=10000).collect()))
    weight = F.octet_length("text") + F.lit(16)
    sizes = sharding._scattered(df, 32, 11, 10000, weight).groupBy("_bucket").agg(F.sum(weight).alias("w")).collect()
    assert len(sizes) > 28 and max(r.w for r in sizes) < 40000


