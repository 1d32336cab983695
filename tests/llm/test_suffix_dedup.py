import hashlib
import random
import re
from collections import Counter

import pytest

from hanlake.llm import suffix_dedup as sd
from tests.llm.helpers import documents


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["ça", "the", "über", *("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(300))]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([70, 90, 150]))) for _ in range(4)]
    rows = []
    for i in range(70):
        kind = rng.random()
        t = " ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 100, 300])))
        if kind < 0.4:
            t = t[: rng.randrange(len(t))] + rng.choice(passages) + t[: rng.randrange(len(t))]
        elif kind < 0.6 and rows:
            t = rng.choice(rows)[1]
            for _ in range(rng.choice([0, 1, 2, 5])):
                at = rng.randrange(len(t) + 1)
                t = t[:at] + rng.choice(["", "x", "é", "zzz"]) + t[at + rng.randrange(2) :]
        elif kind < 0.7:
            t = rng.choice(["ab", "x", "retied. ", "é"]) * rng.choice([100, 199, 200, 201, 399, 401, 900])
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"bucket_runs": 0}), (3, {"length": 60, "gram": 12})])
def test_against_brute_force(spark, seed, options):
    rows = [*corpus(seed), (900, None), (901, ""), (None, "q" * 900), (902, "y" * 399), (903, "z" * 400), (903, "z" * 400)]
    out = sd.repeat_digests(documents(spark, rows), **options).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, options.get("length", 400))


def test_long_text_in_segments(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    data = np.frombuffer((text + text[100:3000]).encode(), np.uint8)
    whole = sd.runs(data, np.array([0, len(data)]))
    monkeypatch.setattr(sd, "SEGMENT", 1000)
    parts = sd.runs(data, np.array([0, len(data)]))
    covered = lambda r: sorted(p for a, b in zip(r[3], r[4]) for p in range(a, b + 1))
    assert covered(whole) == covered(parts) == list(range(len(data) - 399))


def test_empty_table_and_texts_kept(spark):
    assert sd.repeat_digests(documents(spark, [])).collect() == []
    twice = "é" * 250
    rows = [(1, "a" + twice + "b"), (2, "c" + twice), (3, None), (4, "short")]
    out = {r.doc_id: r for r in sd.drop_repeats(documents(spark, rows)).collect()}
    assert [out[i].text for i in (1, 2, 3, 4)] == ["ab", "c", None, "short"]
    assert out[1].n_chars == 2 and out[1].source == "src0" and out[1].node == "x"


def brute_passages(rows, words, length=400):
    """Texts without strings of length bytes and passages of so many words that also start anywhere else."""
    raws = [(t or "").encode() for _, t in rows]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raws]
    texts = [[r[a:b] for a, b in p] for r, p in zip(raws, places)]
    strings = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    passages = Counter(tuple(w[i : i + words]) for w in texts for i in range(len(w) - words + 1))
    out = []
    for (doc, _), r, p, w in zip(rows, raws, places, texts):
        gone = {x for i in range(len(r) - length + 1) if strings[r[i : i + length]] > 1 for x in range(i, i + length)}
        gone |= {x for i in range(len(w) - words + 1) if passages[tuple(w[i : i + words])] > 1 for x in range(p[i][0], p[i + words - 1][1])}
        out.append((doc, bytes(b for i, b in enumerate(r) if i not in gone).decode("utf-8", "ignore")))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, words, options", [(1, 51, {}), (6, 51, {"bucket_runs": 0}), (7, 5, {"bucket_runs": 0})])
def test_passages_of_words_against_brute_force(spark, seed, words, options):
    rng = random.Random(seed)
    short = [" ".join(rng.choice(["a", "of", "to", "né", "it's"]) for _ in range(n)) for n in (49, 50, 51, 52, 60)]
    rows = corpus(seed)
    rows += [(700 + 10 * i + k, f"x{i}{k} {p if k else p.replace(' ', chr(10), 7)}\ty{k}{i}") for i, p in enumerate(short) for k in range(2)]
    rows += [(900, None), (901, ""), (None, short[4] + " " + short[4]), (902, "no " * 120), (903, "no " * 50 + "yes")]
    out = sd.drop_repeats(documents(spark, rows), words, **options).collect()
    assert sorted(((r.doc_id, r.text or "") for r in out), key=str) == brute_passages(rows, words)


def counted_passages(rows, words):
    """(doc_id, bytes, maximal runs) covered by passages of so many words that also start anywhere else."""
    raws = [(t or "").encode() for _, t in rows]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raws]
    texts = [[r[a:b] for a, b in p] for r, p in zip(raws, places)]
    seen = Counter(tuple(w[i : i + words]) for w in texts for i in range(len(w) - words + 1))
    out = []
    for (doc, _), p, w in zip(rows, places, texts):
        gone = {x for i in range(len(w) - words + 1) if seen[tuple(w[i : i + words])] > 1 for x in range(p[i][0], p[i + words - 1][1])}
        out.append((doc, len(gone), sum(x - 1 not in gone for x in gone)))
    return out


@pytest.mark.parametrize("seed, words, options", [(11, 51, {}), (12, 51, {"bucket_runs": 0}), (13, 5, {})])
def test_passages_counted_beside_the_removed_bytes(spark, seed, words, options):
    rows = [*corpus(seed), (900, None), (901, ""), (None, "a b " * 120), (902, "no " * 120), (903, "yes " + "no\n" * 50), (904, "no " * 50 + "yes")]
    out = sd.repeat_digests(documents(spark, rows), words, **options).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, 400)
    assert sorted(((r.doc_id, r.n_passage_bytes, r.n_passages) for r in out), key=str) == sorted(counted_passages(rows, words), key=str)


def test_query_counts_short_passages_of_over_fifty_words(spark, tmp_path):
    """Passages of 51 words with fewer than 400 bytes are counted, but the columns of removed bytes don't change."""
    from hanlake.llm.queries import op5_suffix_dedup

    rng = random.Random(14)
    own = lambda i: " ".join(f"w{i}x{rng.randrange(10**6)}" for _ in range(30))
    said, less = (" ".join(rng.choice(["one", "two", "six", "ten"]) for _ in range(n)) for n in (51, 50))
    rows = [(i, f"{own(i)} {said if i < 3 else less} {own(i)}") for i in range(6)] + [(7, own(7))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(said) < 400 and sorted(tuple(r)[:5] for r in out.values()) == brute(rows, 400)
    assert [(out[i].n_passages, out[i].n_passage_bytes, out[i].n_removed, out[i].repeats) for i, _ in rows] == [(1, len(said), 0, 0)] * 3 + [(0, 0, 0, 0)] * 4


def test_runs_go_before_the_result_is_read(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    found = sd.repeat_digests(documents(spark, corpus(15)), 51)
    left = {x.name.split("-")[1] for x in set(folder.iterdir()) - before if x.name.startswith("hanlake-")}
    assert left == {"shared", "wholes", "spans"} and found.count() == 70


@pytest.mark.parametrize("length, view", [(400, "text_bytes"), (408, "word_codes")])
def test_a_task_takes_little_memory_and_keeps_no_tables(length, view):
    """4 MB of texts, in batches of 2 MB; the executor's two workers stand beside a JVM that has filled its heap."""
    import tracemalloc

    import pyarrow as pa

    from hanlake.llm import common

    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(1000)), pa.array(range(1000))], names=["text", "k_id", "k_text"])
    common.trim()
    tracemalloc.start()
    found = sum(x.num_rows for x in common.trimmed(sd._runs_of(length, 64, getattr(sd, view)))([batch, batch]))
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found > 5000 and peak < 100e6 and kept < 5e6
