import random
import re

from hanlake.llm import quality_rules as qr
from tests.llm.helpers import documents


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_and_verdicts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "x y z x y z", "a\x0bb\x0cc d e", "l\nl\n\n \nl \n#*$%&|<>", "é́ 日本"]
    texts += [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(rng.choice([30, 60, 120]))) + rng.choice(["", "\nsame\nsame"]) for _ in range(60)]
    hosts = [rng.choice(["good", "bad", None, ""]) for _ in texts]
    texts = [("word " * 3 if h == "bad" else t) if i > 12 else t for i, (h, t) in enumerate(zip(hosts, texts))] + ["w%d " * 1]
    hosts.append("bad")
    texts[-1] = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i if i else None, t, h, 5, "x") for i, (t, h) in enumerate(zip(texts, hosts))], "doc_id long, text string, source string, n_words int, host string")
    out = {r.doc_id or 0: r for r in qr.quality_rules(docs).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t), t
    assert out[len(texts) - 1].host_failed and not out[len(texts) - 1].kept and not out[len(texts) - 1].base_failed


def test_empty_table(spark):
    assert qr.quality_rules(documents(spark, [])).collect() == []


def good(i):
    return " ".join(f"g{i}x{j}" for j in range(60))


def hosted(spark, tmp_path, sizes):
    """sizes: host -> (documents, failures)."""
    rows, i = [], 0
    for host, (n, failed) in sizes.items():
        for j in range(n):
            rows.append((i, "too short" if j < failed else good(i), host))
            i += 1
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), rows


def plain_rates(sizes):
    """The same moments by loops over single documents."""
    hosts = [(n, f) for n, f in sizes.values()]
    total, k = sum(n for n, _ in hosts), len(hosts)
    mean = sum(f for _, f in hosts) / total
    alike = 0.0
    if 1 < k < total:
        between = sum(n * (f / n - mean) ** 2 for n, f in hosts) / (k - 1)
        within = sum(sum((x - f / n) ** 2 for x in [1] * f + [0] * (n - f)) for n, f in hosts) / (total - k)
        size = (total - sum(n * n for n, _ in hosts) / total) / (k - 1)
        alike = min(1.0, max(0.0, (between - within) / (between + (size - 1) * within)))
    return {h: (alike * f + (1 - alike) * mean) / (alike * n + 1 - alike) for h, (n, f) in sizes.items()}


def test_hosts_that_fail_as_in_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    sizes = {f"h{i}": (n := rng.choice([1, 2, 5, 40]), rng.randrange(n // 4 + 1)) for i in range(60)} | {"spam": (30, 27), "tiny": (1, 1), "mixed": (12, 8), "hot": (200, 150)}
    docs, rows = hosted(spark, tmp_path, sizes)
    rates = plain_rates(sizes)
    verdicts = {r.host: r for r in qr.host_verdicts(qr.text_counts(docs)).collect()}
    assert all(abs(verdicts[h].rate - rates[h]) < 1e-9 for h in sizes)
    failed = {h for h, r in verdicts.items() if r.host_failed}
    assert {"spam", "hot"} <= failed == {h for h, r in rates.items() if r > 0.5} and len(failed) < 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, host_failed, kept FROM ({qr.ORACLE})").fetchall())
    got = sorted((r.doc_id, r.host_failed, r.kept) for r in qr.quality_rules(docs).collect())
    assert got == want and sum(x[1] for x in got) == sum(sizes[h][0] for h in failed)


def test_small_hosts_show_nothing_alone(spark, tmp_path):
    docs, _ = hosted(spark, tmp_path, {f"h{i}": (1, int(i % 3 == 0)) for i in range(300)})
    assert not any(r.host_failed for r in qr.host_verdicts(qr.text_counts(docs)).collect())
    assert qr.beta_moments(1, 10, 4, 100, 1.6) == (0.4, 0.0) and qr.beta_moments(0, 0, 0, 0, 0.0) == (0.0, 0.0)
