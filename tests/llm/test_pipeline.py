import os
import random
import re
import subprocess
import sys

import corpus_pipeline
from quayside.llm import decontaminate, secrets, simhash
from tests.llm import fixtures as x

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = (docs, out)
        if name != "mixing":
            assert out.columns == columns
        docs = out
    ids = {n: ({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for n, (a, b) in seen.items()}
    before, after = seen["simhash"]
    found = simhash.near_duplicates(before).collect()
    assert ids["simhash"][1] == {r.doc_id for r in found if r.doc_id == r.component_id}
    leaks = {r.doc_id for r in decontaminate.contaminated(ids and seen["decontamination"][0], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids["decontamination"][1] == ids["decontamination"][0] - leaks
    assert ids["secrets"][0] == ids["secrets"][1]
    assert secrets.scan(seen["secrets"][1], secrets.BASE_RULES).where("size(secrets) > 0").count() == 0
    rows = docs.collect()
    assert rows and all(0 < r.taken <= 3 * r["size"] for r in rows)
    assert ids["toxicity"][1] < ids["toxicity"][0]
    assert len(ids["toxicity"][1]) > 0.7 * len(ids["toxicity"][0])


def test_stages_hold_awkward_rows(spark):
    docs = x.clashing(x.awkward(spark))
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            assert set(frame.columns) <= set(out.columns), name
            now = spark.createDataFrame(out.collect(), out.schema)
        assert now.count() <= frame.count()


def test_run_reads_and_writes_shared_folders(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The driver's way: the folders are deleted, the rest still imports."""
    for name in ("quayside", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    package = tmp_path / "quayside"
    package.mkdir()
    for name in os.listdir(f"{ROOT}/quayside"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/quayside/{name}", package / name)
    script = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 100 and not any(k.startswith('op1') or k == 'pipeline' for k in q); print('fine')"
    entry = tmp_path / "__spark_entry__.py"
    entry.unlink()
    entry.write_text(open(f"{ROOT}/__spark_entry__.py").read())
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=100)
    assert "fine" in done.stdout, done.stderr[-2000:]


def plain_alignment(item, text):
    """Best local alignment of two word lists, cell by cell."""
    above, best = [0.0] * (len(text) + 1), 0.0
    for a in item:
        now = [0.0]
        for j, b in enumerate(text, 1):
            now.append(max(0.0, above[j - 1] + (1.0 if a == b else -0.5), above[j] - 0.6, now[-1] - 0.6))
        above, best = now, max(best, *now)
    return best


def test_stages_against_plain_python(spark, tmp_path):
    """A hundred short documents: what each stage keeps, by code that shares nothing with the operators."""
    rng = random.Random(9)
    benchmark = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items = {i: re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split() for i, t in benchmark.items()}
    rows = []
    for i in range(60):
        words = x.prose(i, 90).split()
        if i % 10 == 0:
            words[20:20] = benchmark[sorted(benchmark)[i // 10]].split()
        if i % 7 == 0:
            words[5:5] = ["password", "=", f"Hunter{i}22"]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
    for i in range(40):
        words = rows[i][1].split()
        for at in rng.sample(range(len(words)), rng.randrange(6)):
            words[at] = f"e{rng.randrange(10_000)}"
        rows.append((100 + i, " ".join(words), "en", f"s{i % 4}", 0))
    texts = {r[0]: r[1] for r in rows}

    def stage(name, docs):
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    sets = {i: {tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    lowest = x.smallest_reachable(list(texts), links)
    near = stage("simhash", spark.createDataFrame(rows, x.SCHEMA))
    kept = {i for i in texts if lowest[i] == i}
    assert {r.doc_id for r in near.collect()} == kept and len(kept) < 90

    def leaks(text):
        words = re.sub(r"[!-/:-@\[-`{-~]", " ", text.lower()).split()
        return any(plain_alignment(item, words) >= 0.45 * len(item) - 1e-9 for item in items.values() if item)

    clean = {i for i in kept if not leaks(texts[i])}
    left = stage("decontamination", near)
    assert {r.doc_id for r in left.collect()} == clean and 20 < len(clean) < len(kept)
    masked = {r.doc_id: r.text for r in stage("secrets", left).collect()}
    assert masked.keys() == clean
    for i in clean:
        secret = re.search(r"password = (\w+)", texts[i])
        assert (secret is None) == (masked[i] == texts[i]) and (secret is None or secret.group(1) not in masked[i])
    mixed = stage("mixing", spark.read.parquet(str(tmp_path / "secrets"))).collect()
    assert mixed and all(r["size"] == len(masked[r.doc_id].split()) and 0 < r.taken <= 3 * r["size"] for r in mixed)


def test_large_groups_of_near_and_exact_copies(spark):
    """500 edited copies of one text and 500 exact ones: the pairs that are compared follow the number of texts."""
    rng, base = random.Random(12), x.prose(1, 220).split()
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(1, 9)):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, x.prose(2, 150)) for i in range(500)] + [(5000 + i, x.prose(50 + i, 120)) for i in range(100)]
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = x.smallest_reachable([i for i, _ in rows], links)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
