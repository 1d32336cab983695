import random

from hanlake.llm import quality, toxicity
from tests.llm.helpers import documents


def plain(rng, n=None):
    syllables = ["the", "on", "er", "ati", "lo", "mes", "qui", "ta", "ren", "ish"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n or rng.choice([4, 30, 100, 300]))]
    out = []
    for i, w in enumerate(words):
        out.append((w.capitalize() if i % 9 == 0 else w) + (". " if i % 9 == 8 else " "))
    return "".join(out).strip() + "."


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text = plain(rng)
        toxic = rng.random() < 0.2
        if toxic:
            words = text.split()
            words.insert(rng.randrange(len(words)), rng.choice(["dolt", "wretch!", "Fool"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, None if i % 97 == 0 else int(toxic)))
    rows += [(None, "x"), (5000, None), (5001, ""), (5001, "")]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 60
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.predicted for r in held) > 5
    # labels of held-out rows don't matter
    turned = spark.createDataFrame([(r.doc_id, 1 - truth[r.doc_id]) if r.held_out and truth.get(r.doc_id) is not None else (r.doc_id, truth[r.doc_id]) for r in out if r.doc_id in truth], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


def test_toxicity_weighs_every_counted_bucket_and_different_texts(spark):
    rng = random.Random(2)
    bad = ["".join(rng.choice("bdgkpzjv") for _ in range(12)) for _ in range(150)]
    rows = [(plain(rng, 40) + " " + " ".join(rng.sample(bad, 15)), 1) for _ in range(150)] + [(plain(rng, 40), 0) for _ in range(450)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    counted = {b for text, _ in rows for b in toxicity.gram_buckets(text.lower().split())[1].tolist()}
    assert len(counted) > 3000 and (model.weights != 0).sum() >= 0.99 * len(counted)
    again = toxicity.fit(spark.createDataFrame(rows + rows[:150] * 3, "text string, label int"))
    assert abs(again.weights - model.weights).max() < 1e-9 and abs(again.intercept - model.intercept) < 1e-9
    assert toxicity.SAMPLE == 20_000


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity_scores(docs, none).collect()] in ([0, 0], [1, 1])
    assert toxicity.toxicity_scores(documents(spark, []), none).collect() == []


def test_quality_counts_upper_case_where_lower_case_is_longer():
    text = "\u0130STANBUL IS SHOUTED HERE"
    assert quality.votes(text, text.split()) % 3 == quality.BAD == quality.votes(text.replace("\u0130", "I"), text.split()) % 3


def test_quality(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(500):
        text = plain(rng, rng.choice([5, 40, 200]))
        kind = rng.randrange(12)
        if kind == 0:
            text = " ".join(w + "!!" for w in plain(rng, 80).upper().split())
        elif kind == 1:
            text = " ".join(w + rng.choice("#$%&*") * 3 for w in plain(rng, 80).split())
        elif kind == 2:
            text = " ".join(w for w in plain(rng, 12).split() for _ in range(9))
        elif kind == 3:
            text = " | ".join(plain(rng, 80).split())
        truth[i] = kind > 3
        rows.append((i, text))
    rows += [(900, None), (901, ""), (901, ""), (None, "short text here.")]
    out = quality.quality_scores(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    right = sum(got[i].kept == t for i, t in truth.items())
    assert right >= 0.97 * len(truth), right / len(truth)
    assert all(got[i].kept for i, t in truth.items() if t)
    assert quality.quality_scores(documents(spark, [])).collect() == []
    model = quality.posteriors({quality.votes(t or "", (t or "").split()): 1 for _, t in rows})
    assert all(0 <= p <= 1 for p in model.values()) and quality.posteriors({}) == {}


# ---------------------------------------------------------------- against plain versions


def plain_votes(text):
    """The seven labellers, one after another."""
    words, low = text.split(), text.lower()
    if not words:
        return [quality.ABSTAIN] * 7
    upper = sum(c != c.lower() for c in text) / len(text)
    signs = sum(c in "#*$%&|<>{}\\^~" for c in text) / len(words)
    again = sum(words[i] == words[i - 1] for i in range(1, len(words))) / len(words)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    ends = sum(text[i : i + 2] in (". ", ".\n", "? ", "! ") for i in range(len(text))) + (text[-1] in ".!?")

    def vote(share, good, bad):
        return quality.GOOD if share <= good else quality.BAD if share >= bad else quality.ABSTAIN

    return [
        vote(upper, 0.15, 0.4), vote(signs, 0.02, 0.3), vote(again, 0.05, 0.3),
        vote(1 - len(set(triples)) / len(triples), 0.2, 0.6) if len(triples) >= 10 else quality.ABSTAIN,
        quality.BAD if len(words) >= 60 and ends * 60 < len(words) else quality.GOOD if ends * 30 >= len(words) else quality.ABSTAIN,
        vote(text.count("!!") / len(words), 0.02, 0.3), vote(text.count(" | ") / len(words), 0.02, 0.3),
    ]


def plain_expectation_maximisation(rows, steps=100):
    """Over single texts, not over counts of patterns: the chance that each is good."""
    import math

    good = []
    for v in rows:
        bad = v.count(quality.BAD)
        good.append(0.1 / bad if bad else 0.5 + 0.45 * v.count(quality.GOOD) / len(v))
    belief = {quality.BAD: (0.2, 1.0), quality.ABSTAIN: (0.5, 0.5), quality.GOOD: (1.0, 0.5)}
    for _ in range(steps):
        total = sum(good)
        prior = (total + 1) / (len(rows) + 2)
        odds = [math.log(prior / (1 - prior))] * len(rows)
        for i in range(7):
            for kind, (a, b) in belief.items():
                own = [j for j, v in enumerate(rows) if v[i] == kind]
                if own:
                    p = (sum(good[j] for j in own) + a) / (total + 1.7)
                    q = (sum(1 - good[j] for j in own) + b) / (len(rows) - total + 2.0)
                    for j in own:
                        odds[j] += math.log(p / q)
        good = [1 / (1 + math.exp(-max(-30, min(30, x)))) for x in odds]
    return good


def junk(rng, n):
    rows = []
    for i in range(n):
        text = plain(rng, rng.choice([5, 40, 90, 200]))
        kind = rng.randrange(9)
        text = text.upper() if kind == 0 else " | ".join(text.split()) if kind == 1 else " ".join(w + "!!" for w in text.split()) if kind == 2 else text
        rows.append((i, text))
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[0][1])]


def test_weak_labels_against_a_plain_version(spark):
    rows = junk(random.Random(11), 120)
    plain_rows = [plain_votes(t or "") for _, t in rows]
    for (_, t), v in zip(rows, plain_rows):
        assert quality.votes(t or "", (t or "").split()) == sum(x * 3**i for i, x in enumerate(v))
    want = plain_expectation_maximisation(plain_rows)
    got = {r.doc_id: r.weak_label for r in quality.quality_scores(documents(spark, rows)).collect()}
    assert all(abs(got[i] - w) < 1e-9 for (i, _), w in zip(rows, want))


def test_quality_scores_against_a_plain_version(spark):
    """The scorer is taught posteriors of different texts by steps over plain lists; its scores are those of the query."""
    import math

    rows = junk(random.Random(12), 60)
    docs = documents(spark, rows)
    model = quality.fit(docs)
    weak = plain_expectation_maximisation([plain_votes(t or "") for _, t in rows])
    texts = {}
    for (_, t), w in zip(rows, weak):
        texts.setdefault(t, w)
    table = quality._Buckets()
    feats = [dict(zip(*quality._features((t or "").split(), table))) for t in texts]
    y = list(texts.values())
    norm = max(sum(v * v for v in f.values()) for f in feats) + 1
    mean = min(1 - 1e-3, max(1e-3, sum(y) / len(y)))
    w, b = {}, math.log(mean / (1 - mean))
    w_old, b_old = {}, b
    keys = sorted({k for f in feats for k in f})
    for step in range(600):
        push = step / (step + 3)
        at = {k: w.get(k, 0.0) + push * (w.get(k, 0.0) - w_old.get(k, 0.0)) for k in keys}
        b_at = b + push * (b - b_old)
        g = [(1 / (1 + math.exp(-max(-40, min(40, sum(at[k] * v for k, v in f.items()) + b_at)))) - t) / len(y) for f, t in zip(feats, y)]
        slope = {k: 1e-5 * at[k] for k in keys}
        for f, x in zip(feats, g):
            for k, v in f.items():
                slope[k] += v * x
        w_old, b_old = w, b
        w, b = {k: at[k] - 4 / norm * slope[k] for k in keys}, b_at - 4 / norm * sum(g)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, t in rows:
        f = dict(zip(*quality._features((t or "").split(), table)))
        want = 1 / (1 + math.exp(-(sum(w[k] * v for k, v in f.items()) + b)))
        assert abs(got[i].score - want) < 1e-6 and got[i].kept == (want >= 0.5)


def test_toxicity_ratios_and_scores_against_a_plain_version(spark):
    """Counts of n-grams over distinct words of different texts, their shrunk ratios, and scores from the model's weights."""
    import math
    from collections import Counter

    rng = random.Random(13)
    rows = [(plain(rng, 12) + (" dolt fool" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)]
    rows += rows[:10] + [(None, 1), ("", 0)]
    counts = [Counter(), Counter()]
    grams = {}
    for text, label in {x for x in rows if x[0] is not None}:
        for word in set(text.lower().split()):
            raw = b"\x02" + word.encode() + b"\x03"
            found = [raw[i : i + n] for n in toxicity.SIZES for i in range(len(raw) - n + 1)]
            buckets = toxicity.gram_buckets([word])[1].tolist()
            assert len(found) == len(buckets)
            for x, bucket in zip(found, buckets):
                assert grams.setdefault(x, bucket) == bucket
            counts[label].update(buckets)
    every = sorted(set(counts[0]) | set(counts[1]))
    sums = [sum(c[k] + 1 for k in every) for c in counts]
    ratio = {}
    for k in every:
        p, q = counts[1][k] + 1, counts[0][k] + 1
        r = math.log(p / sums[1]) - math.log(q / sums[0])
        z = r * r / (1 / p + 1 / q)
        ratio[k] = r * z * z / (z * z + toxicity.CERTAIN**4)
    seen = {}
    original = toxicity.least_loss

    def watched(loss, start, **options):
        seen["at start"] = loss(start)
        seen["w"] = original(loss, start, **options)
        return seen["w"]

    toxicity.least_loss = watched
    try:
        model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    finally:
        toxicity.least_loss = original
    assert all(abs(model.weights[k] - seen["w"][k] * ratio[k]) < 1e-12 for k in every) and (seen["w"][:-1] != 0).sum() > 0.99 * len(every)
    # the loss and its slopes where the fit begins, by loops
    texts = sorted({x for x in rows if x[0] is not None})
    share = (sum(y for _, y in texts) + 0.5) / (len(texts) + 1)
    p = share
    loss = sum(-math.log(p if y else 1 - p) for _, y in texts) / len(texts)
    slope = Counter()
    for text, y in texts:
        for k in {b for w in set(text.lower().split()) for b in toxicity.gram_buckets([w])[1].tolist()}:
            slope[k] += (p - y) * ratio[k] / len(texts)
    assert abs(seen["at start"][0] - loss) < 1e-9 and all(abs(seen["at start"][1][k] - slope[k]) < 1e-9 for k in every)
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    for r in toxicity.score(docs.select("doc_id", "text"), model).collect():
        own = {b for w in set((r.text or "").lower().split()) for b in toxicity.gram_buckets([w])[1].tolist()}
        z = model.intercept + sum(model.weights[k] for k in own)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)
