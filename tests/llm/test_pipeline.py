import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tests.llm import test_ngram_jaccard as near
from tests.llm import test_suffix_dedup as repeats
from tests.llm.test_classifiers import plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels):
    table = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def corpus():
    rng = random.Random(8)
    passage = plain(rng, 90)
    rows, labels = [], []
    for i in range(400):
        text = plain(rng, rng.choice([20, 60, 120]))
        kind = rng.random()
        if kind < 0.2:
            words = text.split()
            words.insert(rng.randrange(len(words)), rng.choice(["dolt", "wretch", "fool"]))
            text = " ".join(words)
        elif kind < 0.25:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind < 0.4 and i > 20:
            text = rng.choice(rows[:20])[1]
            if rng.random() < 0.5:
                text += " more."
        elif kind < 0.5:
            text += " " + passage
        rows.append((i, text))
        labels.append((i, 1, int(any(w in text for w in ("dolt", "wretch", "fool")))))
    return rows + [(900, None), (901, ""), (None, "A short one."), (902, rows[0][1]), (902, rows[0][1])], labels


def test_stages_against_plain_versions(spark, tmp_path):
    rows, labels = corpus()
    docs = write(spark, tmp_path, rows, labels)
    d = str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    toxic = {i for i, _, t in labels if t}
    texts = dict(rows)

    clean = corpus_pipeline.drop_toxic(spark, docs, d)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert len(toxic & left) <= 0.05 * len(toxic) and len(set(texts) - toxic - left) <= 5

    good = corpus_pipeline.keep_quality(spark, docs, d)
    left = {r.doc_id for r in good.collect()}
    shouting = {i for i, t in rows if t and "!!" in t}
    assert good.columns == docs.columns and len(shouting & left) <= 1 and len(set(texts) - shouting - left) <= 3

    one = corpus_pipeline.one_of_near_copies(spark, docs, d)
    want = {}
    for doc, n, component in near.brute(rows):
        if n and component == doc or not n:
            want[doc] = want.get(doc, 0) + 1
    got = sorted((r.doc_id for r in one.collect()), key=str)
    assert one.columns == docs.columns and got == sorted(want, key=str)

    cut = corpus_pipeline.cut_repeats(spark, docs, d)
    lengths = sorted((str(r.doc_id), len((r.text or "").encode())) for r in cut.collect())
    assert cut.columns == docs.columns and lengths == sorted((str(i), n - gone) for i, n, gone, _, _ in repeats.brute(rows, 400))

    out = corpus_pipeline.run(spark, d)
    assert out.count() > 100 and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_texts_without_words_all_stay(spark):
    rows = [(None, "", "en"), (None, "", "de"), (None, "", "de"), (7, " ", "en"), (7, " ", "fr"), (8, None, "en"), (8, None, "en"), (9, "some words that come here twice", "en"), (9, "some words that come here twice", "en")]
    docs = spark.createDataFrame([(i, t, lang, "src0", None) for i, t, lang in rows], COLUMNS)
    left = [(r.doc_id, r.text, r.lang) for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted(rows[:-1], key=str)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_without_this_subpackage(tmp_path):
    """The registry still imports when the subpackage and the pipeline are removed."""
    import shutil

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "hanlake", tmp_path / "hanlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)), [x for x in q if x.startswith('op') or x == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.strip().endswith("[] []"), said.stderr


def test_columns_of_clashing_names_stay(spark, tmp_path):
    names = ["intervals", "k_id", "k_text", "first_id", "first_hash", "copy", "score", "predicted", "kept", "weak_label", "label", "bytes"]
    rng = random.Random(4)
    texts = [plain(rng, 150) for _ in range(12)]
    texts += [texts[0], texts[1] + " more.", None, ""]
    rows = [(i, t, "en", "src0", None if t is None else len(t), *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {n} string" for n in names))
    write(spark, tmp_path, [(i, t) for i, t in enumerate(texts)], [(i, 1, i % 2) for i in range(12)])
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(9)
    long = plain(rng, 60_000)
    rows = [(1, long), (2, long + " more"), (3, plain(rng, 100)), (4, None)]
    docs = write(spark, tmp_path, rows, [(1, 1, 0), (3, 1, 1)])
    d = str(tmp_path)
    one = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, d).collect()}
    assert one == {1, 3, 4}
    cut = {r.doc_id: len(r.text or "") for r in corpus_pipeline.cut_repeats(spark, docs, d).collect()}
    assert cut[1] == 0 and cut[2] <= 5 and cut[3] > 100
    pieces = corpus_pipeline.pack(spark, docs, d).where("doc_id = 1").collect()
    assert sum(r.length for r in pieces) > 60_000 and max(r.length for r in pieces) == 2048
    from hanlake.llm import quality, quality_rules, toxicity

    assert quality.quality_scores(docs).count() == quality_rules.quality_rules(docs).count() == 4
    assert toxicity.toxicity_scores(docs, spark.read.parquet(f"{d}/labels.parquet")).count() == 4


def test_short_passages_of_over_fifty_words_go(spark):
    """A passage of 51 words has fewer than 400 bytes here; one of 50 words stays."""
    rng = random.Random(12)
    for n in (51, 50):
        passage = " ".join(rng.choice(["one", "two", "six", "ten"]) for _ in range(n))
        rows = [(i, f"{plain(rng, 40)} a{i} {passage} z{i} {plain(rng, 40)}", "en", "src0", 0) for i in range(5)] + [(9, plain(rng, 100), "en", "src0", 0)]
        docs = spark.createDataFrame(rows, COLUMNS)
        assert len(passage.encode()) < 400
        out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, "").collect()}
        assert [out[i] for i, *_ in rows] == [t.replace(passage, "") if n > 50 else t for _, t, *_ in rows]
