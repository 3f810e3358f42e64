"""Toxicity, secrets, token counts and licenses on awkward rows and against plain versions."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quayside.llm import licenses, secrets, token_counts, toxicity
from quayside.llm.catalogue import QUERIES
from tests.llm import fixtures as x

SF = "/root/testdata/sf0.01"


# --- toxicity -----------------------------------------------------------------------------------

def toy(spark):
    good = [(i, f"calm words here t{i}. you total friend! more calm text t{i % 7}", 0) for i in range(60)]
    bad = [(100 + i, f"calm words here t{i}. you total {w}! more calm text t{i % 5}", 1) for i, w in enumerate(["idiot", "moron", "clown"] * 10)]
    rows = good + bad
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_sentences_are_found_from_document_labels(spark):
    docs, labels = toy(spark)
    model = toxicity.train(docs, labels)
    new = spark.createDataFrame([(1, "all is calm. what an Idiot. and calm"), (2, "all is calm. more calm"), (3, None), (4, ""), (5, "...")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert got[1].toxic and not got[2].toxic and [got[i].toxicity for i in (3, 4, 5)] == [0.0, 0.0, 0.0]
    (span,) = got[1].offending
    assert "all is calm. what an Idiot. and calm"[span.start:span.end] == " what an Idiot"
    assert model == toxicity.train(docs, labels)


def test_toxicity_of_awkward_rows(spark):
    docs, labels = toy(spark)
    model = toxicity.train(docs, labels.union(spark.createDataFrame([(None, 1), (1, None), (2, 7), (10**9, 1)], "doc_id long, toxic int")))
    out = toxicity.score(x.clashing(x.awkward(spark)), model)
    assert out.count() == len(x.AWKWARD) and set(x.CLASHING) <= set(out.columns)
    assert toxicity.score(x.none_of(spark), model).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(docs, toxicity.train(docs, none)).where("toxic").count() == 0
    assert toxicity.train(x.none_of(spark), labels)["weights"] == {}


def test_long_texts_end_no_class(spark):
    """Toxic texts far over the bound of characters take part in excerpts, and the texts after them are trained on."""
    docs, labels = toy(spark)
    first = labels.where("toxic = 1").orderBy(F.xxhash64("doc_id")).first().doc_id
    for long in ("calm words here. " * 900, "calm " * 3000):
        mixed = docs.withColumn("text", F.when(F.col("doc_id") == first, F.concat("text", F.lit(long))).otherwise(F.col("text")))
        rows = toxicity.sample(mixed, labels, characters=6000).collect()
        assert sum(r.toxic == 1 for r in rows) == 30 and all(len(r.text) <= 600 for r in rows)
        assert sum(len(r.text) for r in rows if r.toxic == 1) <= 6000
        only = labels.where((F.col("toxic") == 0) | (F.col("doc_id") == first))
        assert any(r.toxic == 1 for r in toxicity.sample(mixed, only, characters=6000).collect())


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_toxicity"](spark, SF)
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    told = rows.join(truth, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(r.toxic and r.predicted for r in told)
    wrong = sum(not r.toxic and r.predicted for r in told)
    assert hit >= 0.5 * sum(r.toxic for r in told) and wrong <= 0.03 * len(told)
    assert rows.count() == 1000 and rows.where("score < 0 or score > 1 or score is null").count() == 0


def plain_toxicity(text, weights, bias, threshold=0.3):
    """Noisy-or over the sentences of a text by the product of their complements, and the sentences at fault."""
    clean, spans, at = 1.0, [], 0
    for sentence in re.split(r"([.!?\n\r]+)", text or ""):
        own = set()
        for word in re.findall(r"\w+", sentence.lower()):
            for part in [word] + [word[:n] + "^" for n in (5, 7) if len(word) > n]:
                own.add(zlib.crc32(part.encode()) % (1 << 20))
        known = [weights[b] for b in own if b in weights]
        if known:
            p = 1 / (1 + math.exp(-bias - sum(known)))
            clean *= 1 - p
            if p >= threshold:
                spans.append((at, at + len(sentence), p))
        at += len(sentence)
    return 1 - clean, spans


def test_scores_and_spans_against_a_plain_noisy_or(spark):
    """Whole documents and a handed-in table of weights."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = sorted({w for t in list(texts.values())[:60] for w in re.findall(r"\w+", (t or "").lower())})
    weights = {zlib.crc32(w.encode()) % (1 << 20): rng.uniform(-2, 4) for w in rng.sample(words, 80)}
    rows = toxicity.score(docs, {"bias": -4.0, "weights": weights}).collect()
    assert len(rows) == len(texts) and sum(r.toxic for r in rows) > 20 and any(not r.toxic for r in rows)
    for r in rows:
        want, spans = plain_toxicity(texts[r.doc_id], weights, -4.0)
        assert math.isclose(r.toxicity, want, abs_tol=1e-9)
        assert [(s["start"], s["end"]) for s in r.offending] == [s[:2] for s in spans]
        assert all(math.isclose(s["score"], w[2], rel_tol=1e-9) for s, w in zip(r.offending, spans))


# --- secrets --------------------------------------------------------------------------------------

def plain_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


SECRETS = [
    "PassWord:'abcdef' token=abc secret = \"zzzzzz\"", "AKIA" + "A" * 16 + " AKIAB", "x" * 50 + "0123456789abcdef01234567", "API_KEY=AAAAAA apikey : 'b/+_.=-'",
    "é" * 9 + "passwd=éabcdef passwd=abcdef", "ghp_" + "a" * 36 + " token=" + "f" * 40, "http://me:hunter@host/ sk_live_" + "9" * 20, "ſecret=abcdef toKen=abcdef",
    "AKIAAKIA" + "Z" * 20 + "akia" + "a" * 30, "-----BEGIN RSA PRIVATE KEY-----", None, "", "tokentoken==abcdef;secret:=:abcdef",
]


def test_base_spans_against_plain_search(spark):
    frame = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    kinds = [r.kind for r in secrets.BASE_RULES]
    for r in secrets.scan(frame).collect():
        assert [(s.start, kinds.index(s.kind), s.end) for s in r.secrets if s.kind in kinds] == plain_base(SECRETS[r.doc_id])
    more = {s.kind for r in secrets.scan(frame).collect() for s in r.secrets} - set(kinds)
    assert {"git_token", "payment_key", "url_login", "private_key"} <= more


def test_query_against_plain_search(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op6_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = plain_base(texts[r.doc_id])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        assert hashlib.sha256(joined.encode()).hexdigest() == r.base_sha256
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in found) for n in range(3))


@pytest.mark.parametrize("pattern,flags,hits", [
    (r"ab(c|d)e+f", 0, ["xxabceefxx", "abdef"]), (r"(foo|ba[rz])qux?", re.I, ["FOOqu", "bazqux"]), (r"[a-z]+", 0, ["q"]), (r"abc?d", 0, ["abd", "abcd"]),
    (r"x{3}yz", 0, ["xxxyz"]), (r"(abcd)?efg", 0, ["efg", "abcdefg"]), (r"é+abc", 0, ["ééabc"]),
])
def test_queries_miss_no_match(pattern, flags, hits):
    query = secrets.trigram_query(pattern, flags)
    names = sorted(secrets.trigrams_of(query))
    segment = secrets.Segment([h.encode() for h in hits] + [b"", b"zzzzzz"], names)
    assert set(range(len(hits))) <= set(segment.match(query).tolist())


def test_only_rules_without_trigrams_scan_all():
    assert [r.kind for r in secrets.RULES if secrets.trigram_query(r.pattern, r.flags) is True] == ["hex"]


def test_redaction(spark):
    frame = x.clashing(x.awkward(spark))
    out = {(r.doc_id, r.text): r for r in secrets.redact(frame).collect()}
    assert secrets.redact(frame).columns == frame.columns and len(out) == len(set((i, t) for i, t, *_ in x.AWKWARD))
    text = "[SECRET] licensed under cc by 4.0, all rights reserved"
    assert out[(9, text)].n_chars == len(text)
    assert secrets.masked("aXXbYYc", [(1, 0, 3), (2, 0, 3), (4, 0, 6)], "*") == "a*b*c"
    assert secrets.redact(x.none_of(spark)).count() == 0


# --- token counts -----------------------------------------------------------------------------------

PIECES = [b" ", b"a", b"b", b"c", b" ab", b"abc", b"bca", b"cab", b" abcab", b"aaaa", b"aa", b"ba"]


def test_automaton_against_longest_prefixes():
    automaton, pieces = token_counts.Automaton(PIECES), set(PIECES)
    from itertools import product
    for n in range(8):
        for letters in product(b"abc", repeat=n):
            word = b" " + bytes(letters)
            assert automaton.count(word) == token_counts.greedy_count(word, pieces), word
    assert automaton.count(b" axb") == 1 and token_counts.Automaton([]).count(b" a") == 1
    gaps = [b" x", b"yz", b"y", b"zw"]
    for word in (b" xyzw", b" xyz", b" xw", b" xzw", b" xyy"):
        assert token_counts.Automaton(gaps).count(word) == token_counts.greedy_count(word, set(gaps)), word


def test_token_counts_of_real_vocabulary_and_awkward_rows(spark):
    pieces = token_counts.read_pieces("/opt/tokenizers/byte_bpe_50k.json")
    assert len(pieces) == 50_256
    known = set(pieces)
    rows = token_counts.count_tokens(x.clashing(x.awkward(spark)), pieces).select("doc_id", "text", "n_words", "n_tokens").collect()
    for r in rows:
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(token_counts.greedy_count(b" " + w, known) for w in words))
    assert len(rows) == len(x.AWKWARD) and token_counts.count_tokens(x.none_of(spark), pieces).count() == 0


# --- licenses ----------------------------------------------------------------------------------------

def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.ascii_lower(text))
    found = [(i, label) for label, phrase in licenses.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), sorted(found)


def check_base(rows, texts):
    for r in rows:
        n, found = plain_places(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(found), ",".join(sorted({l for _, l in found})))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_base_places_of_awkward_rows(spark):
    rows = licenses.license_summary(x.clashing(x.awkward(spark))).collect()
    assert len(rows) == len(x.AWKWARD)
    check_base([r for r in rows if r.doc_id is not None], {i: t for i, t, *_ in x.AWKWARD})
    assert [r.n_base for r in rows if r.doc_id == 2] == [0, 0] and {r.n_words for r in rows if r.doc_id is None} == {0, 5}
    assert licenses.license_summary(x.none_of(spark)).count() == 0


def test_edited_templates_are_found(spark):
    notice = x.prose(1, 30, 10_000).split()
    edited = notice[:6] + ["somewhere"] + notice[6:9] + notice[10:]
    texts = [" ".join(notice), "x y " + " ".join(edited) + " z", " ".join(notice[::-1]), " ".join(notice + ["and"] + notice)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = licenses.license_spans(frame, more=[("own", " ".join(notice))]).select("doc_id", "start", "stop", "coverage").collect()
    got = sorted((s.doc_id, s.start, s.stop) for s in spans)
    n = len(notice)
    assert got == [(0, 0, n), (1, 2, 2 + len(edited)), (3, 0, n), (3, n + 1, 2 * n + 1)]


def test_query_against_plain_places(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_licenses"](spark, SF).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)


def test_license_scan_runs_no_python_and_reads_texts_once(spark):
    plan = QUERIES["op7_licenses"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "documents.parquet" not in plan  # texts are read once, before the pin
