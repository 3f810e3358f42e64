"""Mixing, archives, dated lists, decontamination and embeddings on awkward rows and against plain versions."""

import gzip
import hashlib
import io
import math
import random
from datetime import date
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import decontaminate, embeddings, mixing, url_lists, warc
from quayside.llm.catalogue import ORACLES, QUERIES, list_events
from tests.llm import fixtures as x
from tools.compare import database, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    rel = database(SF).execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rel.fetchall())


# --- mixing ---------------------------------------------------------------------------------------

def plain_targets(sizes: dict, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= above


def check_mix(rows):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        copies = len([r for r in rows if r.source == s])
        assert abs(taken[s] - want[s]) <= 0.5 + (copies if s in ("b", None) else 0), s


def test_mix_of_awkward_rows(spark):
    frame = x.clashing(x.awkward(spark))
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(x.AWKWARD)
    assert sorted(r["size"] for r in rows) == sorted(len(x.split_words(t)) for _, t, *_ in x.AWKWARD)
    check_mix(rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame.repartition(5)).collect()))
    assert mixing.mix(x.none_of(spark)).count() == 0 and mixing.mixed_documents(x.none_of(spark)).count() == 0
    kept = mixing.mixed_documents(frame)
    assert set(frame.columns) <= set(kept.columns)
    assert sorted((r.doc_id or 0, r.taken) for r in kept.collect()) == sorted((r.doc_id or 0, r.taken) for r in rows if r.taken)


def test_mix_of_hot_source_and_many_sources(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 40).cast("int")), " ").alias("text"))
    check_mix(mixing.mix(rows).collect())


def test_better_documents_are_taken_more_often(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"),
                                    F.lit("one two three four").alias("text"), (F.col("id") % 2 + 0.25).alias("q"))
    out = mixing.mix(rows, weights=(1, 5), quality=F.col("q")).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t"))
    t = {r.good: r.t for r in out.collect()}
    assert t[1] > 1.5 * t[0] > 0


def test_running_total_over_a_hot_group(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 5).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = {(r.g, r.id): r.s for r in mixing.running_total(rows, ["g"], ["id"], "v", "s").collect()}
    sums, want = {}, {}
    for i in range(2000):
        g = 1 if i < 1500 else i % 5
        sums[g] = sums.get(g, 0) + i % 7
        want[g, i] = sums[g]
    assert got == want


# --- archives ---------------------------------------------------------------------------------------

def test_round_trip_of_awkward_pages(spark, tmp_path):
    big = "q" * 3_000_000
    pages = [(5, "http://a/ b\r\nX: y", "z" * 100), (3, None, "z" * 100), (3, "again", "z" * 100), (9, "u", "z" * 99), (10, "u", "z" * 99), (1, "é", None),
             (2, "u", ""), (None, "n", "z" * 100), (7, "u", "\r\n\r\nWARC/1.1\r\n é" + "y" * 200), (8, "u", big), (11, "u", big), (2**60 + 1, "u", "z" * 100)]
    frame = x.clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    files = warc.write_archives(warc.with_revisits(frame).repartition(3), f"file://{tmp_path}/w", file_bytes=2000)
    assert files.agg(F.sum("records")).first()[0] == len(pages)
    rows = warc.read_archives(files, payloads=True).collect()
    assert all(r.digest_ok and r.error is None for r in rows) and len(rows) == len(pages)
    first = {"z" * 100: 3, big: 8}
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        to = first.get(html) if i != first.get(html) else None
        want.append((i or -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to else "response", to or -1, b"" if to else data))
    assert sorted(want) == sorted((r.item_id or -1, r.payload_bytes, r.payload_digest, r.type, r.refers_to or -1, bytes(r.payload)) for r in rows)
    for path in tmp_path.glob("w/*.warc.gz"):  # any gzip reader opens it
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_empty_table_and_missing_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(none), f"file://{tmp_path}/w")).count() == 0
    (row,) = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/none.warc.gz",), (None,)], "path string")).collect()
    assert row.error and not row.digest_ok


def test_members_are_one_per_record_and_damage_is_seen():
    one = warc.record_bytes(1, "u", b"abc" * 100, hashlib.sha256(b"abc" * 100).hexdigest(), None, "d")
    two = warc.record_bytes(2, "u", b"", hashlib.sha256(b"").hexdigest(), None, "d")
    assert [r["item_id"] for r in warc.parse(one + two)] == [1, 2]
    assert [r["error"] is None for r in warc.parse(one + two[:-9])] == [True, False]
    assert [r["error"] is None for r in warc.parse(one + b"junk" + two)] == [True, False]
    wrong = warc.record_bytes(3, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, "d")
    assert [r["digest_ok"] for r in warc.parse(wrong + two)] == [False, True]

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(1)

    assert [r["payload_bytes"] for r in warc.read_records(Slow(one + two))] == [300, 0]


def test_query_against_plain_digests(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in QUERIES["op5_warc"](spark, SF).collect():
        data = pages.pop(r.page_id)
        to = first[data] if len(data) >= 100 and first[data] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to)
    assert not pages


# --- dated lists --------------------------------------------------------------------------------------

def test_lists_as_of_the_fetch(spark):
    d = date
    events = spark.createDataFrame([
        ("l1", "example.org", "add", d(2020, 1, 10)), ("l1", "example.org", "remove", d(2020, 3, 1)), ("l1", "Example.org", "add", d(2020, 5, 1)),
        ("l2", "a.example.org/x/", "add", d(2020, 2, 1)), ("l2", "a.example.org/x/", "add", d(2020, 2, 1)), ("l1", "same.net", "add", d(2020, 1, 1)),
        ("l1", "same.net", "remove", d(2020, 1, 1)), (None, "a", "add", d(2020, 1, 1)), ("l1", None, "add", d(2020, 1, 1)), ("l1", "q", "keep", d(2020, 1, 1)), ("l1", "q", "add", None),
    ], "list string, entry string, action string, at date")
    captures = [
        ("http://EXAMPLE.org/", d(2020, 1, 9), ""), ("http://example.org", d(2020, 1, 10), "l1"), ("http://u@b.example.org.:80/p", d(2020, 2, 29), "l1"),
        ("http://example.org/", d(2020, 3, 1), ""), ("http://example.org/", d(2021, 3, 1), "l1"), ("https://a.example.org/x/y?z=/", d(2020, 2, 1), "l1,l2"),
        ("https://a.example.org/x", d(2020, 2, 1), "l1"), ("https://a.example.org/x/", d(2020, 4, 1), "l2"), ("http://notexample.org/", d(2020, 2, 1), ""),
        ("http://same.net/", d(2020, 6, 1), ""), (None, d(2020, 1, 1), ""), ("", d(2020, 1, 1), ""), ("http://example.org/", None, ""), ("no url", d(2020, 2, 1), ""),
        ("http://example.org", d(2020, 1, 10), "l1"),
    ]
    frame = x.clashing(spark.createDataFrame([(u, f) for u, f, _ in captures], "url string, fetched_at date"))
    out = url_lists.listed_captures(frame, events)
    rows = out.collect()
    assert sorted((str(u), str(f), l) for u, f, l in captures) == sorted((str(r.url), str(r.fetched_at), r.lists) for r in rows)
    assert all(r.blocked == (r.lists != "") for r in rows) and set(x.CLASHING) <= set(out.columns)
    assert url_lists.listed_captures(frame.limit(0), events).count() == 0
    assert url_lists.listed_captures(frame, events.limit(0)).where("blocked").count() == 0


def plain_lists(captures, events):
    """Lists of every capture, entry by entry, with another parser of URLs."""
    history = {}
    for name, entry, action, at in sorted(events, key=lambda e: (e[3], e[2] == "remove")):
        host, slash, rest = entry.partition("/")
        if entry:
            history.setdefault((name, host.lower() + slash + rest), {})[at] = action == "add"
    out = {}
    for key, url, at in captures:
        parts = urlsplit(url)
        host, path = (parts.hostname or "").rstrip("."), parts.path or "/"
        found = set()
        for (name, entry), days in history.items():
            domain, slash, rest = entry.partition("/")
            covers = host == domain and path.startswith("/" + rest) if slash else host == domain or host.endswith("." + domain)
            before = [d for d in days if d <= at]
            if host and covers and before and days[max(before)]:
                found.add(name)
        out[key] = ",".join(sorted(found))
    return out


def test_query_against_plain_lists(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    day = date(2020, 1, 1).toordinal()
    events = [(r.list, r.entry, r.action, r["at"]) for r in list_events(spark, SF).collect()]
    assert len(events) == len(pages) and sum(e[1].count("/") == 1 and e[1].endswith("/") for e in events) > len(pages) // 8
    want = plain_lists([(r.page_id, r.url, date.fromordinal(day + r.page_id * 37 % 1461)) for r in pages], events)
    got = {r.page_id: r.lists for r in QUERIES["op9_url_lists"](spark, SF).collect()}
    assert got == want and 10 < sum(map(bool, want.values())) < len(want)


def test_paths_keep_their_case_and_roots_are_entries(spark):
    at, long = date(2020, 1, 1), "d/" * 400
    events = spark.createDataFrame([("l1", "Example.org/News/", "add", at), ("l2", "ROOT.org/", "add", at), ("l3", "deep.org/" + long, "add", at)],
                                   "list string, entry string, action string, at date")
    urls = [("http://example.org/News/x", "l1"), ("http://example.org/news/x", ""), ("http://root.org", "l2"), ("http://root.org/", "l2"), ("http://Root.org/a/b?c", "l2"),
            ("http://www.root.org/", ""), ("http://deep.org/" + long + "x", "l3"), ("http://deep.org/" + long[:-2], "")]
    rows = url_lists.listed_captures(spark.createDataFrame([(u, date(2020, 2, 2)) for u, _ in urls], "url string, fetched_at date"), events).collect()
    assert {r.url: r.lists for r in rows} == dict(urls)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(160).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.repeat(F.lit("y"), 50).alias("html"))
    files = warc.write_archives(warc.with_revisits(pages).repartition(16), f"file://{tmp_path}/w")
    assert files.count() == 16
    read = warc.read_archives(files).select("path", F.spark_partition_id().alias("task"))
    assert read.count() == 160 and read.select("task").distinct().count() >= 8
    assert read.groupBy("path").agg(F.countDistinct("task").alias("n")).where("n > 1").isEmpty()


# --- decontamination ------------------------------------------------------------------------------------

def plain_local(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1)), 0.0
    for i, p in enumerate(a, 1):
        for j, q in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontaminate.MATCH if p == q else decontaminate.MISMATCH), h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
            best = max(best, h[i, j])
    return best


def test_local_score_against_plain_matrix():
    r = random.Random(2)
    for _ in range(150):
        a = np.array([r.randrange(5) for _ in range(r.randrange(1, 14))])
        b = np.array([r.randrange(-1, 5) for _ in range(r.randrange(1, 30))])
        best, lo, hi = decontaminate.local_score(a, b)
        assert math.isclose(best, plain_local(a, b), abs_tol=1e-9)
        assert 0 <= lo <= hi <= len(b) and math.isclose(plain_local(a, b[lo:hi]), best, abs_tol=1e-9)


def test_edited_copies_are_found_and_clean_texts_left(spark):
    items = [(i, x.prose(i, 40)) for i in range(12)] + [(50, None), (None, "q w e r t y"), (51, ""), (52, "two words"), (53, x.prose(3, 40))]
    docs, want = [], set()
    for i in range(12):
        words = items[i][1].split()
        r = random.Random(i)
        edited = [w if r.random() > 0.2 else "other" for w in words]
        del edited[10]
        edited.insert(20, "more")
        docs += [(10 * i, x.prose(900 + i, 300) + " " + " ".join(words).upper() + ". " + x.prose(700 + i, 50)), (10 * i + 1, x.prose(800 + i, 200) + " " + " ".join(edited)),
                 (10 * i + 2, x.prose(600 + i, 400))]
        want |= {(10 * i, i), (10 * i + 1, i)} | ({(30, 53), (31, 53)} if i == 3 else set())
    # One item leaks into most documents: its n-grams must go on seeding.
    docs += [(1000 + i, x.prose(2000 + i, 30) + " " + items[0][1]) for i in range(60)]
    want |= {(1000 + i, 0) for i in range(60)}
    docs += [(5, None), (6, ""), (None, items[1][1]), (0, docs[0][1]), (7, "two words")]
    want.add((7, 52))
    frame = x.clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = x.clashing(spark.createDataFrame(items, "item_id long, text string"))
    rows = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.score > 0.95 for r in rows if r.doc_id % 10 == 0)
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted([5, 6] + [10 * i + 2 for i in range(12)])
    assert clean.where("doc_id is null").count() == 1
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0 and decontaminate.contaminated(frame, bench.limit(0)).count() == 0


def test_many_copies_of_one_edited_passage_are_found(spark):
    """More than eight copies of one excerpt or of one edit, of which fewer than half of the 4-grams are left."""
    items = [(1, x.prose(1, 40)), (2, x.prose(2, 40))]
    edited = [w if i % 6 else "other" for i, w in enumerate(items[1][1].split())]
    docs = [(i, x.prose(100 + i, 90) + " " + " ".join(items[0][1].split()[:19])) for i in range(30)]
    docs += [(50 + i, x.prose(200 + i, 90) + " " + " ".join(edited)) for i in range(30)] + [(99, items[1][1])]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, 1) for i in range(30)} | {(50 + i, 2) for i in range(30)} | {(99, 2)}


def test_spread_edits_against_alignment_of_whole_texts(spark):
    """Seeds at one end, no 4-gram left, inserted words, short items: brute-force alignment of every text with every item decides."""
    r, docs = random.Random(6), []
    items = [(i, x.prose(60 + i, n)) for i, n in enumerate((3, 7, 12, 13, 15, 25, 40))]
    for _, text in items:
        words = text.split()
        copies = [[w if i % k else "other" for i, w in enumerate(words)] for k in (2, 3, 4)]
        copies += [[w if i % 4 or i > len(words) - 5 else "other" for i, w in enumerate(words)]]
        copies += [[v for i, w in enumerate(words) for v in ([w, "more"] if i % k else [w])] for k in (2, 3, 10)]
        copies += [[w if r.random() > 0.28 else "other" for w in words] for _ in range(8)]
        docs += [x.prose(len(docs) + 5000 + i, 60, 4000) + " " + " ".join(c) + " " + x.prose(len(docs) + 9000 + i, 60, 4000) for i, c in enumerate(copies)]
    want = set()
    for d, text in enumerate(docs):
        for i, item in items:
            number = {w: n for n, w in enumerate(dict.fromkeys(item.split()))}
            best, _, _ = decontaminate.local_score(np.array([number[w] for w in item.split()]), np.array([number.get(w, -1) for w in text.split()]))
            if best / len(item.split()) >= decontaminate.SCORE:
                want.add((d, i))
    rows = decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 60


def test_windows_hold_every_reach():
    r = random.Random(8)
    for _ in range(300):
        length, span, least = r.randrange(1, 400), r.randrange(1, 30), r.randrange(1, 4)
        hits = sorted(r.sample(range(length), min(length, r.randrange(1, 40))))
        pieces = list(decontaminate.windows(hits, least, span, length))
        assert all(0 <= lo < hi <= length and hi - lo <= 3 * span for lo, hi in pieces)
        for a, b in zip(hits, hits[least - 1:]):
            if b - a < span:
                for start in range(max(0, b - span + 1), a + 1):
                    assert any(lo <= start and min(start + span, length) <= hi for lo, hi in pieces)


def test_long_text_of_common_words_and_text_ids(spark):
    """Items of the very words that the text is made of: what leaves a task is results, and segments change nothing."""
    r = random.Random(5)
    words = [f"c{i}" for i in range(60)]
    items = [(f"item {i}", " ".join(r.choice(words) for _ in range(30))) for i in range(6)]
    long = [r.choice(words) for _ in range(45_000)]
    for at, i in ((19_990, 0), (39_985, 3)):
        long[at:at + 30] = items[i][1].split()
    docs = spark.createDataFrame([("long", " ".join(long)), ("short", "one two"), (None, items[0][1])], "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = {(q.doc_id, q.item_id): q for q in decontaminate.contaminated(docs, bench).collect()}
    assert {("long", "item 0"), ("long", "item 3")} <= rows.keys() and len({d for d, _ in rows}) == 1
    assert (rows["long", "item 0"].score, rows["long", "item 0"].start_word, rows["long", "item 0"].end_word) == (1.0, 19_990, 20_020)
    assert rows["long", "item 3"].start_word == 39_985
    again = {(q.doc_id, q.item_id): q for q in decontaminate.contaminated(docs, bench, item_bytes=200).collect()}
    assert again == rows


def test_query_holds_every_exact_passage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = [(r.item_id, " ".join(decontaminate.words_of(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for d in docs:
        text = " ".join(decontaminate.words_of(d.text))
        want |= {(d.doc_id, i) for i, t in bench if f" {t} " in f" {text} "}
    rows = QUERIES["op10_decontaminate"](spark, SF).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in rows}


# --- embeddings -----------------------------------------------------------------------------------------

def plain_links(rows):
    """Per row: links and smallest reachable id."""
    def unit(v):
        if v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        top = max(abs(c) for c in v)
        u = np.array(v, float) / top
        return u / np.linalg.norm(u)

    units = [unit(v) for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
             if rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93]
    degree = [0] * len(rows)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    top = x.smallest_reachable(list(range(len(rows))), links)
    lowest = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            lowest[top[i]] = min(lowest.get(top[i], v), v)
    return sorted((v is None, v or 0, degree[i], lowest.get(top[i])) for i, (v, _, _) in enumerate(rows))


def clusters():
    r = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for size in [1] * 60 + [2] * 10 + [5, 40, 330]:
            centre = r.standard_normal(24)
            for _ in range(size):
                rows.append((n * 7 % 100_003, [float(np.float32(c)) for c in centre + 0.12 * r.standard_normal(24)], label))
                n += 1
    return rows


def test_links_against_all_pairs(spark):
    rows = clusters() + [(200_000 + i, [1.0] * 24, 0) for i in range(30)] + [(5_000_000, [2.0] * 24, 0)]
    odd = [(300_000, None, 0), (300_001, [], 0), (300_002, [0.0] * 24, 0), (300_003, [1.0, None], 0), (300_004, [float("nan")] * 24, 0), (300_005, [float("inf")] + [1.0] * 23, 0),
           (300_006, [1.0, 0.0], 0), (300_007, [1.0, 0.1], 0), (None, [1.0, 0.1], 0), (300_009, [1e-40, 0.0], 1), (300_010, [1e38, 0.0], 1), (300_011, [1.0, -0.0], 1), (300_011, [1.0, 0.0], 1)]
    rows += odd
    frame = x.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").drop("score"))
    got = embeddings.near_duplicates(frame).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got) == plain_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_audit_sees_missing_links(spark):
    rows = spark.createDataFrame(clusters()[:400], "vec_id long, embedding array<double>, label int")
    nodes = embeddings.classes(rows)
    none = spark.createDataFrame([], "a long, b long, cos double")
    assert embeddings.recall(nodes, none, 0.93, 16) < 0.1
    poor = embeddings.tree_neighbours(nodes, range(1), block=4)
    lists = embeddings.best_lists(poor, 4)
    better = embeddings.refined(lists, nodes, 0.93, 4)
    assert embeddings.recall(nodes, better, 0.93, 1000) >= embeddings.recall(nodes, lists, 0.93, 1000)


def all_pairs(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by comparing all pairs of a label."""
    units = np.array([r[1] for r in rows], float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (units @ units.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    lowest = x.smallest_reachable(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    return sorted((i, int(n), lowest[i], lowest[i] == i) for i, n in zip(ids, near.sum(axis=1)))


def turned(rng, centre, cosine):
    """A unit vector at this cosine from a unit vector."""
    side = rng.standard_normal(len(centre))
    side -= centre * (side @ centre)
    return cosine * centre + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def answers(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_groups_that_fill_their_lists_are_linked_across(spark):
    """A chain of tight groups, each larger than a list, neighbours at 0.945: one component, all links counted."""
    rng = np.random.default_rng(2)
    centre, rows = turned(rng, np.eye(64)[0], 0.0), []
    for _ in range(12):
        rows += [(len(rows) + k, turned(rng, centre, 0.9997).tolist(), 1) for k in range(30)]
        centre = turned(rng, centre, 0.945)
    rows += [(1000 + k, rng.standard_normal(64).tolist(), int(k % 2)) for k in range(600)]
    want = all_pairs(rows)
    assert len({c for i, _, c, _ in want if i < 360}) == 1
    assert answers(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6))) == want


def test_a_large_group_hides_nothing_beside_it(spark):
    """A group of many leaves, and vectors that only some of its members are near to."""
    rng = np.random.default_rng(3)
    centre = turned(rng, np.eye(32)[0], 0.0)
    rows = [(k, turned(rng, centre, 0.995).tolist(), 1) for k in range(900)]
    rows += [(2000 + k, turned(rng, np.array(rows[17 * k][1]), 0.94).tolist(), 1) for k in range(40)]
    rows += [(3000 + k, rng.standard_normal(32).tolist(), 1) for k in range(300)]
    assert answers(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5))) == all_pairs(rows)


def test_audit_goes_on_until_it_meets_links(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(48).tolist(), 1) for k in range(3000)]
    rows += [(5000 + k, turned(rng, np.array(rows[k][1]) / np.linalg.norm(rows[k][1]), 0.96).tolist(), 1) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = embeddings.classes(frame)
    nothing = spark.createDataFrame([], "a long, b long, cos double")
    assert embeddings.recall(nodes, nothing, 0.93, 16) == 0.0
    assert embeddings.recall(embeddings.classes(frame.where("vec_id < 3000")), nothing, 0.93, 16) is None
    assert answers(embeddings.near_duplicates(frame)) == all_pairs(rows)
