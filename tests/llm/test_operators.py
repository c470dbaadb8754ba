"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("foldspark.llm")
import public_tokenizers as P  # noqa: E402
from llm_brute import check_pieces, components_brute, rules_brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from foldspark.llm import chat, decontam, editcount, langid, minhash, packing, quality, rules, urlgraph, warc  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()
EXTRA = "bucket id n c least_id comp score label gram fold length rank salt size total place part own p a b"
BPE = P.path("word_bpe_49k.json")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def frame(spark, rows, schema):
    """Rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, schema)
    for c in EXTRA.split():
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1, 400)
    near = base.split()
    near[50] = "other"
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, " ".join(near), "de"), (4, None, "en"), (5, "", None), (6, " \n\t ", "en"), (7, "one", "en"), (8, "ONE", "de"),
        (9, "x" * 300_000, "en"), (10, prose(2, 60_000), "de"), (None, base, "en"), (None, None, None), (11, "Ünïcödé 你好 🙂 <|endoftext|> don't", "fr"), (12, "12 34 !!", "en"),
    ]
    return frame(spark, rows, "doc_id bigint, text string, lang string").cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# near-duplicates

@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_minhash_brute(docs, k, percent):
    got = minhash.near_duplicates(docs, shingle=k, percent=percent).collect()
    comp, size = components_brute(texts_of(docs), k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == comp and {r["doc_id"]: r["n_shingles"] for r in got} == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_family(spark):
    """Near copies of a text that are often unlike each other: stars alone would not link them all."""
    r, base = random.Random(5), prose(3, 150).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice((1, 3, 4, 5, 6))):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == components_brute(dict(rows), 3, 85)[0]


def rows_brute(rows, k, percent):
    """[(doc_id, n, component, set)] of every row: rows are nodes, a component has the least doc_id of its rows."""
    comp, size = components_brute(dict(enumerate(t for _, t in rows)), k, percent)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    return [(d, size[i], least.get(comp[i]) if size[i] else d, comp[i]) for i, (d, _) in enumerate(rows)]


def test_minhash_rows_not_ids(spark):
    """Unlike texts under one doc_id, texts of rows without an id, near copies among them, equal rows and rows without words."""
    r = random.Random(12)
    base = [prose(20 + i, 80) for i in range(6)]

    def near(t):
        w = t.split()
        w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        return " ".join(w)

    rows = [(1, base[0]), (1, base[1]), (1, base[1]), (2, near(base[1])), (None, base[2]), (None, near(base[2])), (None, base[3]), (9, near(base[3])), (8, base[3])]
    rows += [(5, base[4]), (5, base[4]), (None, base[4]), (7, ""), (7, ""), (7, None), (None, " "), (3, base[5]), (None, near(base[0])), (6, base[5].upper())]
    df = frame(spark, rows, "doc_id bigint, text string")
    want = rows_brute(rows, 5, 80)
    got = Counter(tuple(x) for x in minhash.near_duplicates(df, shingle=5, percent=80).collect())
    assert got == Counter((d, n, c, d == c) for d, n, c, _ in want)
    left = minhash.drop_near_duplicates(df, shingle=5, percent=80)
    assert left.columns == df.columns
    kept = Counter((x["doc_id"], x["text"]) for x in left.collect())
    # one row of each component with words, with its least id; all rows without words
    groups = {}
    for (d, t), (_, n, c, node) in zip(rows, want):
        if n:
            groups.setdefault(node, []).append((d, t, c))
    assert sum(kept.values()) == len(groups) + 4 and all(kept[d, t] == n for (d, t), n in Counter(x for x in rows if not (x[1] or "").strip()).items())
    for members in groups.values():
        hits = [(d, t) for d, t, c in members if kept[d, t]]
        assert len(set(hits)) == 1 and kept[hits[0]] == 1 and hits[0][0] == members[0][2]


def test_minhash_hot_bucket(spark):
    """A family with most of all rows: its buckets, its component and its hub are dealt over several keys."""
    r, base = random.Random(14), prose(30, 120).split()
    rows = [(i, prose(1000 + i, 60)) for i in range(400)]
    for i in range(400, 2600):
        w = list(base)
        w[r.randrange(len(w))] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base)) for i in range(2600, 4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = minhash.near_duplicates(df, shingle=5, percent=80).collect()
    assert len(got) == 4000 and {x["doc_id"] for x in got if x["kept"]} == set(range(401)) and {x["component_id"] for x in got if x["doc_id"] >= 400} == {400}


def test_across_brute():
    """Blocks of a family: a forest that joins just what all pairs at the threshold join."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    for seed in range(30):
        base = [np.unique(r.integers(-(2**60), 2**60, 40)) for _ in range(4)]
        sets = []
        for i in range(40):
            s = base[i % 4].copy()
            s[r.integers(0, len(s), r.integers(0, 6))] = r.integers(-(2**60), 2**60)
            sets.append(np.unique(s))
        comp = r.integers(0, 15, 40) * 10
        asks = r.random(40) < 0.5
        t = pa.table({"comp": comp, "s": pa.array([x.tolist() for x in sets], pa.list_(pa.int64())), "asks": asks})
        edges = list(zip(*(c.to_pylist() for c in minhash._across(85)(t).columns)))
        want = {(int(comp[i]), int(comp[j])) for i in range(40) for j in range(40) if asks[i] and not asks[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}

        def parts(pairs):
            root = {int(c): int(c) for c in comp}
            for _ in range(40):
                for a, b in pairs:
                    m = min(root[a], root[b])
                    for c in root:
                        if root[c] in (root[a], root[b]):
                            root[c] = m
            return root

        assert parts(edges) == parts(want) and len(edges) < 15


def test_minhash_parts():
    bands, rows = minhash.banding(0.85)
    assert bands * rows <= minhash.MOST_BINS and (1 - 0.85**rows) ** bands <= minhash.MISS
    data = np.frombuffer(b"a b c d  e\nshort one", np.uint8)
    sets, begin = minhash.shingle_sets(data, np.array([0, 10, 10, 15, 20]), 3)
    assert np.diff(begin).tolist() == [3, 0, 1, 1]
    sig = minhash.signatures(sets, begin, 64)
    assert (sig[[0, 2, 3]] > 0).all() and not sig[1].any()


def test_minhash_odd(spark, odd):
    got = [tuple(r) for r in minhash.near_duplicates(odd, shingle=5, percent=80).collect()]
    assert len(got) == 15
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[1][2:] == (1, True) and by[2][2:] == (1, False) and by[3][2:] == (1, False)
    assert all(by[k][1] == 0 and by[k][3] for k in (4, 5, 6)) and by[7][1:] == (1, 7, True) and by[8][1:] == (1, 7, False)
    assert Counter(r[2] for r in got if r[0] is None) == {1: 1, None: 1}
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    left = minhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(x["doc_id"] for x in left.collect() if x["doc_id"] is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12]


# packing

def test_pack_histogram():
    for seed in range(5):
        r = random.Random(seed)
        counts = {n: r.randrange(1, 30) for n in r.sample(range(1, 65), 30)}
        patterns = packing.pack_histogram(counts, 64)
        used = Counter()
        for n, lengths in patterns:
            assert n > 0 and sum(lengths) <= 64
            used.update({k: n * v for k, v in Counter(lengths).items()})
        assert used == counts
        # no packing does with less than the total, nor with less than the lengths over half
        least = max(sum(k * v for k, v in counts.items()) / 64, sum(v for k, v in counts.items() if k > 32))
        assert sum(n for n, _ in patterns) <= 1.1 * least + 2
    assert packing.pack_histogram({}, 64) == []


def test_packing_round_trip(docs):
    rows = packing.pack(docs, tokenizer=BPE).collect()
    seqs = check_pieces(rows, texts_of(docs))
    total = sum(r["length"] for r in rows)
    assert len(seqs) * 2048 - total <= 0.02 * total + 2048


def test_packing_hot_length(spark):
    """Rows alike in all columns, a length with a third of all pieces, and full pieces: every piece has a place of its own."""
    rows = [(None, "same words")] * 300 + [(i, "one two three four") for i in range(300)] + [(1000 + i, "token " * (40 * i)) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = packing.pack(df, tokenizer=BPE, size=64, ranked=50).collect()
    assert sum(r["doc_id"] is None for r in got) == 300
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(seqs) * 64 - total <= 0.05 * total + 64 and any(r["length"] == 64 for r in got)


def test_packing_odd(odd):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(one, tokenizer=BPE).collect(), texts_of(one))
    rows = packing.pack(odd, tokenizer=BPE).collect()
    assert sum(r["doc_id"] is None for r in rows) >= 2 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(odd.limit(0), tokenizer=BPE).count() == 0


# rules

@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rules_brute(request, which):
    df = request.getfixturevalue(which)
    want = Counter((r["doc_id"], *rules_brute(r["text"])) for r in df.select("doc_id", "text").collect())
    got = Counter(tuple(r)[:8] for r in rules.quality_rules(df).collect())
    assert got == want
    kept = rules.keep_by_rules(df)
    assert kept.columns == df.columns and kept.count() == sum(n for k, n in want.items() if k[7])
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_bands():
    b = rules.Bands()
    good = prose(4, 600).encode()
    noise = random.Random(1).randbytes(4000)
    assert not b.judge(b"same words again " * 400)[3] and not b.judge(noise)[3] and b.judge(b"")[3] is False
    half = good[:4096] + b"ab " * 3000
    assert b.judge(half)[2] >= 1 and not b.judge(half)[3]


@pytest.mark.parametrize("n", [600, 1000, 1100, 1500, 2048, 2700, 4096, 8000, 27_000, 135_000])
def test_bands_incompressible_text(n):
    """Wrapped base64 and random words of letters and digits go, prose of the same length stays."""
    r, b = random.Random(n), rules.Bands()
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    junk = " ".join("".join(r.choices(signs, k=8)) for _ in range(n // 9 + 1)).encode()[:n]
    for data in (base64.encodebytes(r.randbytes(n))[:n], junk):
        ratio, chunks, bad, kept = b.judge(data)
        assert bad == chunks and not kept, ratio


@pytest.mark.parametrize("least", [512, 1024, 2048, 4096, 16384])
def test_bands_keep_prose(docs, least):
    """No text with words enough is below the floors."""
    b = rules.Bands()
    texts = [t.encode() for t in texts_of(docs).values() if t and len(t.split()) >= rules.MIN_WORDS]
    assert all(b.judge(t)[0] >= rules.band(len(t))[0] for t in texts if len(t) >= least)


def test_bands_tail(docs):
    """The bytes behind the last full chunk are judged as the text's last 4 KiB."""
    b, good = rules.Bands(), prose(4, 3000).encode()
    noise = base64.encodebytes(random.Random(6).randbytes(9000))
    assert b.judge(good[:4095])[1:3] == (8, 0) and b.judge(good[:511])[1:3] == (1, 0) and b.judge(good[:512])[1:3] == (1, 0) and b.judge(good[:4096])[1:3] == (1, 0) and b.judge(good[:4097])[1:3] == (2, 0) and b.judge(good[:8192])[1:3] == (2, 0)
    for tail in (noise, b"same words again " * 300):
        assert b.judge(good[:4096] + tail[:3904])[1:3] == (2, 1)
    prosy = next(t.encode() for t in texts_of(docs).values() if t and len(t) > 5000 and b.judge(t.encode())[3])
    for n in (700, 1500, 3000, 4000):  # noise or repeats behind prose, in texts of less than 4 KiB
        assert b.judge(prosy[:n])[3] and not b.judge(prosy[: n // 4] + noise[: n - n // 4])[3] and not b.judge(prosy[: n // 4] + (b"same words again " * 300)[: n - n // 4])[3]
    ratio, chunks, bad, kept = b.judge(good[:4096] + noise[: 4096 + 3904])
    assert (chunks, bad, kept) == (3, 2, False) and ratio >= rules.band(12_096)[0]


# quality

def test_quality_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has some fifty labels to learn from
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right >= 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 1), (4, 0), (10, None), (99, 1)], "doc_id bigint, quality int").withColumn("text", F.lit("clash"))
    model = quality.train(odd, labels)
    got = quality.classify(odd, model).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (4, 5, 6)}
    assert len(blank) == 1 and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    none = quality.train(odd, labels.limit(0))
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5} and quality.classify(odd.limit(0), none).count() == 0
    assert quality.keep_by_quality(odd, none, threshold=0.4).columns == odd.columns


def test_quality_alone_and_together(spark, sf):
    """A text's score is the same whatever is scored beside it; scores follow from the model's definition."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = [t or "" for t in texts_of(docs.limit(300)).values()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    together = model.scores(*quality.indicators(data, offsets))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, begin = quality.indicators(raw, np.array([0, len(raw)]))
        assert model.scores(ids, begin)[0] == together[i]
        margin = math.fsum(model.weight[ids].tolist()) / math.sqrt(max(math.fsum(model.square[ids].tolist()), 1e-12)) + model.bias
        assert 1 / (1 + math.exp(-(model.slope * margin + model.shift))) == pytest.approx(together[i], abs=1e-9)


def test_quality_fit_brute():
    """Ratios, weights and the dual's conditions of a small fit, from plain loops."""
    r = np.random.default_rng(2)
    rows = [np.sort(r.choice(40, 6, replace=False)) if i % 2 else np.sort(20 + r.choice(40, 6, replace=False)) for i in range(120)]
    label, cal = np.arange(120) % 2, np.arange(120) % 4 == 1
    cal[::8] = True
    model = quality.fit(rows, label, cal, 0.5)
    learn = [i for i in range(120) if not cal[i]]
    n = [sum(label[i] == k for i in learn) for k in (0, 1)]
    ratio = {}
    for f in range(60):
        c = [1.0 + sum(f in rows[i] for i in learn if label[i] == k) for k in (0, 1)]
        ratio[f] = math.log(c[1] / (n[1] + 2)) - math.log(c[0] / (n[0] + 2))
        assert model.square[f] == pytest.approx(ratio[f] ** 2, rel=1e-5, abs=1e-9)
    # the hinge-loss objective of the descent is no worse than that of nearby weights
    unit = [np.array([ratio[f] for f in rows[i]]) / max(1e-6, math.sqrt(sum(ratio[f] ** 2 for f in rows[i]))) for i in learn]
    y = np.array([2.0 * label[i] - 1 for i in learn])
    w, b = quality.descent([rows[i] for i in learn], unit, y, 60, np.ones(len(learn)), epochs=300)
    loss = lambda w, b: (w @ w + b * b) / 2 + sum(max(0.0, 1 - t * (w[rows[i]] @ v + b)) for i, v, t in zip(learn, unit, y))
    best = loss(w, b)
    for _ in range(50):
        step = r.normal(size=61) * 0.05
        assert loss(w + step[:60], b + step[60]) >= best - 1e-6


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False)) + (0 if i % 2 else 25) for i in range(200)]
    values = [np.full(8, 1 / math.sqrt(8)) for _ in rows]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    w, b = quality.descent(rows, values, y, 100, np.ones(200))
    assert np.mean([np.sign(w[r] @ v + b) == t for r, v, t in zip(rows, values, y)]) > 0.8


# language

def test_langid_held_out(docs):
    rows = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95


def test_kneser_ney_sums_to_one():
    counts = Counter()
    for w in ("abba", "abc", "cab", "bab", "aaa"):
        s = "\x02" + w + "\x03"
        for i in range(1, len(s)):
            counts[s[max(0, i - 3) : i + 1]] += 1
    model = langid.kneser_ney(dict(counts), symbols=6)
    # P(next | context) over a, b, c, end and two unseen symbols, from differences of word scores
    for head in ("", "a", "ab", "ca", "zz"):
        base = {}
        for c in "abcxy":
            h = langid.gram_hashes(np.frombuffer(("\x02" + head + c + "\x03").encode("utf-32-le"), "<u4"), 4)
            base[c] = 2 ** _one(model, h, len(head) + 1)
        h = langid.gram_hashes(np.frombuffer(("\x02" + head + "\x03").encode("utf-32-le"), "<u4"), 4)
        end = 2 ** _one(model, h, len(head) + 1)
        assert sum(base[c] for c in "abc") + end + base["x"] + base["y"] == pytest.approx(1.0, abs=1e-6)


def _one(model, h, i):
    total = 0.0
    for k in range(min(4, i + 1), 0, -1):
        found, logp = langid._lookup(model.grams, model.logp, h[k - 1][i : i + 1])
        if found[0]:
            return total + float(logp[0])
        if k > 1:
            known, back = langid._lookup(model.contexts, model.back, h[k - 2][i - 1 : i])
            total += float(back[0]) if known[0] else 0.0
    return total + model.unseen


def test_langid_brute(docs):
    """Entropies of whole texts from probabilities computed gram by gram, alone and together; ties go to the first language."""
    rows = [(r["lang"], r["text"] or "") for r in docs.where("doc_id < 120").collect() if r["lang"]]
    counts = {}
    for lang, text in rows[:60]:
        for t in text.split():
            for w in langid.letters(t):
                s = "\x02" + w + "\x03"
                for i in range(1, len(s)):
                    own = counts.setdefault(lang, Counter())
                    own[s[max(0, i - 3) : i + 1]] += 1
    langs = sorted(counts)
    symbols = len({c for x in counts.values() for g in x for c in g}) + 1
    model = langid.Identifier(langs, [langid.kneser_ney(dict(counts[x]), symbols=symbols) for x in langs], [math.inf] * len(langs))

    def tables(longest):
        """Continuation counts, by level, of the grams."""
        level = [Counter() for _ in range(5)]
        for g, n in longest.items():
            level[len(g)][g] += n
        for k in (3, 2, 1):
            for g in level[k + 1]:
                level[k][g[1:]] += 1
        return level

    def prob(level, context, c):
        if not context:
            base = 1 / symbols
        else:
            base = prob(level, context[1:], c)
        own = {g: n for g, n in level[len(context) + 1].items() if g[:-1] == context}
        if not own:
            return base
        ones, twos = (sum(n == x for n in level[len(context) + 1].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        total = sum(own.values())
        return max(own.get(context + c, 0) - d, 0) / total + d * len(own) / total * base

    probe = [" ".join(t.split()[:6]) for _, t in rows[60:66] if t.split()]
    got = [next(model.batches(iter([[t]]))) for t in probe]
    for i, t in enumerate(probe):
        n = 0
        logs = [0.0] * len(langs)
        for token in t.split():
            for w in langid.letters(token):
                s = "\x02" + w + "\x03"
                n += len(s) - 1
                for m, x in enumerate(langs):
                    level = tables(counts[x]) if (i, x) not in tables_of else tables_of[i, x]
                    tables_of[i, x] = level
                    logs[m] += sum(math.log2(prob(level, s[max(0, k - 3) : k], s[k])) for k in range(1, len(s)))
        assert got[i][1][0] == n and np.allclose(got[i][0][0], [-v / max(n, 1) for v in logs], atol=1e-9)
    texts = [t for _, t in rows] + ["", "12 3", "x" * 50_000]
    together, _ = next(model.batches(iter([texts])))
    alone = [next(model.batches(iter([[t]])))[0][0].tolist() for t in texts]
    assert together.tolist() == alone
    assert model.verdicts(np.array([[1.0] * len(langs)]), np.array([5]))[0] == [langs[0]]


tables_of = {}


def test_langid_many_languages(spark):
    """A dirty lang column: only the most frequent values are learned."""
    rows = [(i, prose(i, 30), "en" if i % 2 else f"junk{i}") for i in range(80)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), languages=3)
    assert "en" in model.langs and len(model.langs) <= 3


def test_langid_odd(odd):
    model = langid.train(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (4, 5, 6, 12)) and all(r["lang_pred"] in model.langs for r in got if r["doc_id"] in (1, 9, 10, 11))
    none = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(odd.limit(0), model).count() == 0


# decontamination

def test_index_finds_all_above_threshold():
    r = random.Random(7)
    items = [(i, prose(100 + i, r.randrange(5, 150)) + f" unique{i} mark{i}") for i in range(60)]
    segs = [(i, decontam.words(t)[lo : lo + 64]) for i, t in items for lo in range(0, len(decontam.words(t)), 64)]
    df = Counter(w for _, s in segs for w in set(s))
    mean = sum(len(s) for _, s in segs) / len(segs)
    index = decontam.Index.build(items, df, len(segs), mean)
    for q in range(40):
        query = decontam.words(items[q][1])[:90] if q % 2 else decontam.words(prose(q, 120)) + [f"unique{q}"]
        ids = np.array(sorted({index.ids[w] for w in query if w in index.ids}))
        got = {seg: s for _, seg, s in index.search(np.zeros(len(ids), np.int64), ids, 0.5)}
        want = {}
        for k, (_, s) in enumerate(segs):
            tf = Counter(s)
            part = {w: math.log(1 + (len(segs) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w, n in tf.items()}
            share = sum(v for w, v in part.items() if w in set(query)) / sum(part.values())
            if share >= 0.5:
                want[k] = share
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_decontamination_planted(docs, spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    norm = lambda t: " " + " ".join(decontam.words(t)) + " "
    bench = {r["item_id"]: norm(r["text"]) for r in items.collect()}
    want = {(d, i) for d, t in texts_of(docs).items() for i, b in bench.items() if b in norm(t)}
    assert got == want
    two = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items, shard=500).collect()}
    assert two == got
    left = decontam.drop_contaminated(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(texts_of(docs)) - {d for d, _ in got}


def test_decontamination_exhaustive(docs, spark, sf):
    """Every (text, segment) at the threshold, by scores of all windows against all segments."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    segs = [decontam.words(t)[lo : lo + 64] for _, t in items for lo in range(0, len(decontam.words(t)), 64)]
    df, n = Counter(w for s in segs for w in set(s)), len(segs)
    mean = sum(map(len, segs)) / n
    index = decontam.Index.build(items, df, n, mean)
    texts = [t or "" for t in texts_of(docs).values()]
    dense = np.zeros((len(index.ids), len(index.owner)))
    for k in range(len(index.ids)):
        own = slice(index.post[k], index.post[k + 1])
        dense[k, index.seg[own]] = index.share[own]
    assert np.allclose(dense.sum(axis=0), 1)
    want, got = set(), set()
    for i, t in enumerate(texts):
        w = [index.ids.get(x, -1) for x in decontam.words(t)]
        for k in range(max(1, -(-len(w) // 64) - 1)):
            own = sorted({x for x in w[64 * k : 64 * k + 128] if x >= 0})
            if own:
                want.update((i, k, int(s)) for s in np.flatnonzero(dense[own].sum(axis=0) >= 0.3))
                got.update((i, k, s) for _, s, _ in index.search(np.full(len(own), k), np.array(own), 0.3))
    assert got == want and len(want) > 20
    # all texts at once, in one group of windows and in many
    whole = Counter((t, item) for t, item, *_ in decontam.Texts(texts).match(index))
    step, decontam.STRETCH = decontam.STRETCH, 640
    try:
        assert Counter((t, item) for t, item, *_ in decontam.Texts(texts).match(index)) == whole
    finally:
        decontam.STRETCH = step
    alone = Counter((i, item) for i, t in enumerate(texts) for _, item, *_ in decontam.Texts([t]).match(index))
    assert alone == whole


def test_decontamination_far_answer(spark):
    """The answer may stand far behind its question; a question without its answer does not count."""
    r = random.Random(8)
    question, answer = " ".join(f"q{r.randrange(10**6)}" for _ in range(30)), " ".join(f"a{r.randrange(10**6)}" for _ in range(10))
    items = spark.createDataFrame([(1, f"{question}?\nAnswer: {answer}")], "item_id bigint, text string")
    texts = [(1, f"{question} {prose(1, 400)} {answer}"), (2, f"{question} {prose(2, 400)}"), (3, f"{prose(3, 200)} {answer}"), (4, f"{answer} {prose(4, 900)} {question} {prose(5, 90)}")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {x["doc_id"] for x in decontam.contaminated(docs, items).collect()} == {1, 4}


def test_decontamination_null_items(spark, odd):
    """Items without an id count like any other."""
    items = spark.createDataFrame([(None, prose(1, 400)), (None, "one"), (5, "nothing of the kind here at all")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, items).collect()}
    # document 10 has 60,000 of the same twenty words, and so most of their pairs
    assert got - {(10, None)} == {(d, None) for d in (1, 2, 3, None, 7, 8)}
    assert {r["doc_id"] for r in decontam.drop_contaminated(odd, items).collect()} - {10} == {4, 5, 6, 9, 11, 12, None}


def test_decontamination_odd(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, prose(1, 400)), (4, "one"), (None, "x"), (3, prose(1, 400))], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, items).collect()}
    assert {(1, 3), (2, 3), (3, 3), (7, 4), (8, 4)} <= got and not any(d in (4, 5, 6, 9) for d, _ in got)
    assert decontam.contaminated(odd.limit(0), items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0
    q, a = decontam.question_answer("What is it?\nAnswer: a long thing")
    assert q == ["what", "is", "it"] and a == ["a", "long", "thing"]


# WARC

def test_warc_round_trip(spark, tmp_path):
    same = "<p>same</p>"
    pages = [(1, "http://a/", same), (5, "http://b/\nx:y", same), (3, None, same), (7, "u", None), (8, "v", ""), (9, "w", "ü" * 100_000), (10, "z", "once\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n")]
    df = frame(spark, pages, "page_id bigint, url string, html string").repartition(3)
    rows = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    payload = {p: (h or "").encode() for p, _, h in pages}
    assert {p: r["payload_bytes"] for p, r in rows.items()} == {p: len(b) for p, b in payload.items()}
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1(payload[p]).digest()).decode() for p, r in rows.items())
    assert {p: (r["record_type"], r["refers_to"]) for p, r in rows.items()} == {
        1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 7: ("revisit", 8), 8: ("response", None), 9: ("response", None), 10: ("response", None),
    }
    assert rows[5]["url"] == "http://b/\nx:y" and rows[3]["url"] == ""
    least = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(df, min_bytes=1).collect()}
    assert least[7] == least[8] == "response" and least[1] == "revisit"
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a", "x"), (None, "b", "x"), (2, "c", "x"), (2, "d", "x"), (None, "e", "y")], "page_id bigint, url string, html string")
    got = {r["url"]: (r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect()}
    assert got == {"a": (None, "revisit", 2), "b": (None, "revisit", 2), "c": (2, "revisit", 2), "d": (2, "response", None), "e": (None, "response", None)}


def warc_brute(pages, least=0):
    """(page_id, bytes, digest, type, refers_to) of every page, by payload."""
    groups = {}
    for i, (p, u, h) in enumerate(pages):
        groups.setdefault((h or "").encode(), []).append((p is not None, p or 0, u or "", i))
    out = Counter()
    for data, rows in groups.items():
        known, most, _, best = max(rows)
        for has, p, _, i in rows:
            revisit = known and len(data) >= least and i != best
            out[p if has else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", most if revisit else None] += 1
    return out


NAMES = "page_id payload_bytes payload_digest record_type refers_to".split()


def test_warc_repeated_rows(spark, monkeypatch):
    """Of rows equal in all columns exactly one is the response, however many there are; a hot payload is dealt over several keys."""
    monkeypatch.setattr(warc, "COPIES", 7)
    pages = [(5, "u", "x")] * 50 + [(4, "u", "x")] * 3 + [(6, "v", "tiny")] * 2 + [(None, "n", "no id")] * 3 + [(i, f"w{i}", "hot " * 9) for i in range(100, 2300)] + [(9, None, None), (8, None, "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    for least in (0, 5):
        got = Counter(tuple(r) for r in warc.archive_round_trip(df, min_bytes=least).select(*NAMES).collect())
        assert got == warc_brute(pages, least)


def test_warc_pages_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    want = warc_brute([(r["page_id"], r["url"], r["html"]) for r in df.collect()])
    assert Counter(tuple(r) for r in warc.archive_round_trip(df).select(*NAMES).collect()) == want


def test_inflate_bounded_and_cut(tmp_path):
    """A megabyte of zeros by the thousand comes in bounded steps; a stream cut off between or within records is an error."""
    import gzip
    import io

    data = bytes(64 << 20)
    parts = [len(x) for x in warc.inflate(io.BytesIO(gzip.compress(data)))]
    assert sum(parts) == len(data) and max(parts) <= 1 << 20
    two = gzip.compress(b"a" * 1000) + gzip.compress(b"b" * 10)
    assert b"".join(warc.inflate(io.BytesIO(two))) == b"a" * 1000 + b"b" * 10
    for cut in (two[:-3], two[: len(gzip.compress(b"a" * 1000)) + 4], gzip.compress(b"a" * 1000)[:-9]):
        with pytest.raises((ValueError, zlib.error)):
            b"".join(warc.inflate(io.BytesIO(cut)))


def test_monolithic_stream(tmp_path):
    records = [warc.record(i, f"http://h/{i}", bytes([65 + i % 26]) * (i * 997)) for i in range(60)]
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    path = tmp_path / "m.gz"
    path.write_bytes(one.compress(b"".join(records)) + one.flush())
    with path.open("rb") as f:
        assert list(warc.split_records(warc.inflate(f))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[3][:-9]])))


# URL graph

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/71?x", "https://example.com/en/8#f", "http://xexample.com/en/7", "ftp://n.net/de/80", "http://example.net/de/80", "x", None, "http://com", "http://a.org?q", "//no",
            "http://a.com?u=http://b.com/en/7", "http://com?x=://q/en/1", "http://a.com#x://b.com/en/7", "http://b.com/en?x=http://q/en/1", "http://B.com/en/1\nz?y"]
    df = frame(spark, [(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.filter_urls(df, RULES).collect()}
    assert got == {
        0: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 1: ("example.com", "/en/8", "com/en/", "block"), 2: ("xexample.com", "/en/7", "com/en/", "block"),
        3: ("n.net", "/de/80", "net/de/", "allow"), 4: ("example.net", "/de/80", "example.net/de/8", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("com", "", None, "allow"), 8: ("a.org", "", None, "allow"), 9: ("", "", None, "allow"),
        10: ("a.com", "", None, "allow"), 11: ("com", "", None, "allow"), 12: ("a.com", "", None, "allow"), 13: ("b.com", "/en", None, "allow"), 14: ("b.com", "/en/1\nz", "com/en/", "block"),
    }
    joined = urlgraph._joined(df.select("page_id", urlgraph.host_of(F.col("url")).alias("host"), urlgraph.path_of(F.col("url")).alias("path")), urlgraph._order(RULES))
    assert {r["page_id"]: r["rule"] for r in joined.collect()} == {k: v[2] for k, v in got.items()}
    assert urlgraph.filter_urls(df.limit(0), RULES).count() == 0


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [(1, "http://good.net/de/1", link("fine.io")), (2, "http://bad.org/es/1", link("fine.io")), (3, "http://fan.io/", link("bad.org", "bad.org", "fan.io")), (4, "http://fine.io/", "<a HREF='//fan.io/z'>"), (5, "http://lone.io/", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["host"]: r for r in urlgraph.filter_urls(df, RULES).collect()}
    # dense iteration
    hosts = ["good.net", "bad.org", "fan.io", "fine.io", "lone.io"]
    edges = {(0, 3): 1, (1, 3): 1, (2, 1): 2, (3, 2): 1}

    def ranks(edges, seed):
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        r = seed = np.array(seed, float)
        for k in range(urlgraph.ROUNDS):
            nxt = (1 - urlgraph.DAMPING) * seed
            for (a, b), n in edges.items():
                nxt[b] += urlgraph.DAMPING * r[a] * n / out[a]
            r = nxt
        return r

    trust, distrust = ranks(edges, [1, 0, 0, 0, 0]), ranks({(b, a): n for (a, b), n in edges.items()}, [0, 1, 0, 0, 0])
    for i, h in enumerate(hosts):
        assert got[h]["trust"] == pytest.approx(trust[i], abs=1e-9) and got[h]["distrust"] == pytest.approx(distrust[i], abs=1e-9)
        if h.endswith(".io"):
            assert got[h]["verdict"] == ("block" if distrust[i] >= urlgraph.FLOOR and distrust[i] > trust[i] else "allow")
    # a host that links to a blocked seed and gets no trust
    alone = df.where("page_id in (2, 3)")
    assert {r["host"]: r["verdict"] for r in urlgraph.filter_urls(alone, RULES).collect()} == {"bad.org": "block", "fan.io": "block"}
    plan = urlgraph.filter_urls(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_link_graph_copies(spark):
    """Verdicts of a graph do not depend on how many unlinked copies of it there are."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)

    def verdicts(copies):
        rows = []
        for c in range(copies):
            rows += [(f"http://good{c}.net/de/1", link(f"fine{c}.io")), (f"http://bad{c}.org/es/1", link(f"fine{c}.io")), (f"http://fan{c}.io/", link(f"bad{c}.org"))]
            rows += [(f"http://fine{c}.io/", link(f"lone{c}.io")), (f"http://lone{c}.io/", None)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
        return Counter((re.sub(r"\d", "", r["host"]), r["verdict"]) for r in urlgraph.filter_urls(df, RULES).collect())

    one = verdicts(1)
    assert one["fan.io", "block"] == one["fine.io", "allow"] == 1
    assert verdicts(2000) == Counter({k: 2000 * n for k, n in one.items()})


def test_url_rules_many(spark):
    """More rules than are inlined, ties of length, repeated rows: against a loop over all rules."""
    r = random.Random(11)
    hosts = [".".join(r.choice("abcd") for _ in range(r.randrange(1, 5))) for _ in range(60)]
    rules = [(r.choice(hosts), "/" + r.choice(["", "x", "xy", "xyz/"]), r.choice(["allow", "block"])) for _ in range(150)]
    rules += [("a.b", "/xy", "allow"), ("a.b", "/xy", "block"), ("b", "/xy/z", "allow"), ("a.b", "/xy", "allow")]
    assert len(set(rules)) > urlgraph.INLINE_RULES
    urls = [f"http://{r.choice(hosts)}/{r.choice(['', 'x', 'xyz', 'xyz/1', 'q', 'xy/z'])}" for _ in range(400)]
    df = spark.createDataFrame([(i % 300, u, None) for i, u in enumerate(urls + urls[:50])], "page_id bigint, url string, html string")

    def brute(url):
        host, _, path = url[7:].partition("/")
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and ("/" + path).startswith(x[1])]
        best = max((len(h + p), v == "block") for h, p, v in fits) if fits else None
        return best and {(h + p, v) for h, p, v in fits if (len(h + p), v == "block") == best}

    got = urlgraph.filter_urls(df, rules).collect()
    assert len(got) == 450
    want = {u[7:]: brute(u) for u in urls}
    for x in got:
        w = want[x["host"] + x["path"]]
        assert (x["rule"] is None) == (w is None) and (w is None or (x["rule"], x["verdict"]) in w)
    # one host with most of the urls is dealt over several keys, with the same result
    hot = df.where("page_id < 1").limit(1).crossJoin(spark.range(3000)).select(F.col("id").alias("page_id"), F.lit("http://hot.org/es/1").alias("url"), F.lit(None).cast("string").alias("html"))
    hot = hot.unionByName(spark.createDataFrame([(9000, "http://hot.org/x", None), (9001, "http://cold.org/x", None)], "page_id bigint, url string, html string"))
    seen = urlgraph.filter_urls(hot, RULES)
    assert Counter(x["verdict"] for x in seen.collect()) == {"block": 3001, "allow": 1} and seen.where("page_id = 9000 and rule is null and verdict = 'block'").count() == 1


def test_link_graph_thousands(spark):
    """A generated graph of some thousand hosts against a dense iteration."""
    r = np.random.default_rng(4)
    n = 2000
    name = [f"h{i}.{('com', 'net', 'org', 'io', 'io')[i % 5]}" for i in range(n)]
    path = [("/en/1", "/de/1", "/es/1", "/", "/")[i % 5] for i in range(n)]
    to = r.integers(0, n, (n, 3))
    rows = [(i, f"http://{name[i]}{path[i] if i % 3 else '/'}", "".join(f"<a href='http://{name[j]}/'>" for j in to[i])) for i in range(n)]
    rows += [(n + i, f"http://{name[i]}/other", None) for i in range(0, n, 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {x["host"]: x for x in urlgraph.filter_urls(df, RULES).where("rule is null").collect()}
    links = np.zeros((n, n))
    for i in range(n):
        for j in to[i]:
            links[i, j] += i != j
    has = np.array([1 + (i % 2 == 0) for i in range(n)])  # of two urls one is no majority

    def ranks(m, kinds):
        seed = np.array([float(has[i] == 1 and i % 3 and i % 5 in kinds) for i in range(n)])
        total = seed.sum()
        seed = seed / total
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        x = seed
        for _ in range(urlgraph.ROUNDS):
            x = urlgraph.DAMPING * (x @ share) + (1 - urlgraph.DAMPING) * seed
        return x, total

    trust, _ = ranks(links, (1,))
    distrust, total = ranks(links.T, (0, 2))
    verdicts = Counter()
    for i, h in enumerate(name):
        if h in got:
            assert got[h]["trust"] == pytest.approx(trust[i], abs=1e-9) and got[h]["distrust"] == pytest.approx(distrust[i], abs=1e-9)
            want = "block" if distrust[i] * total >= urlgraph.FLOOR and distrust[i] > trust[i] else "allow"
            assert got[h]["verdict"] == want
            verdicts[want] += 1
    assert verdicts["block"] > 100 and verdicts["allow"] > 100


# edit-aware counts

def shape(doc):
    """Lengths and counts of a document's pre-tokens; checks sums, balance and texts of its tree on the way."""

    def walk(x):
        if x.left is None:
            assert x.parts == len(x.lengths) == len(x.counts) > 0 and x.chars == sum(x.lengths) == len(x.text) and x.tokens == sum(x.counts)
            return list(x.lengths), list(x.counts)
        (a, b), (c, d) = walk(x.left), walk(x.right)
        assert abs(x.left.height - x.right.height) <= 1 and x.height == 1 + max(x.left.height, x.right.height)
        assert (x.parts, x.chars, x.tokens) == (len(a) + len(c), sum(a) + sum(c), sum(b) + sum(d))
        return a + c, b + d

    return walk(doc.root) if doc.root else ([], [])


def replaced(text, start, removed, inserted):
    start = min(max(start, 0), len(text))
    return text[:start] + inserted + text[start + min(max(removed, 0), len(text) - start) :]


def test_edits_against_full_count():
    counter = editcount.Counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    r = random.Random(3)
    pool = ["hello world", " ", "\n\n", "it's", "don't!!", "  12 345", "ÄÖ ü", "<|endoftext|>", "tab\t x", "…", "a", " " * 90, "x" * 200]
    leaf, editcount.LEAF = editcount.LEAF, 4
    try:
        for _ in range(150):
            text = "".join(r.choice(pool) for _ in range(r.randrange(0, 60)))
            doc = editcount.Document(text, counter)
            for k in range(8):
                e = r.randrange(-2, len(text) + 3), r.randrange(0, r.choice([2, 12, 300])), r.choice(["", " ", "x", "'s", "\n", " new words", "9", " " * 70])
                doc.edit(*e)
                text = replaced(text, *e)
                assert doc.text == text and shape(doc) == shape(editcount.Document(text, counter))
                if k == 4:  # to a row and back
                    row = doc.row()
                    doc = editcount.Document.kept(counter, *row[:2], *row[3:])
    finally:
        editcount.LEAF = leaf
    whole = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    assert editcount.Document("it's <|endoftext|> x", counter).n_tokens == whole("it's <|endoftext|> x")


def test_edits_touch_little():
    """An edit of a long text looks at a few leaves and a path of the tree."""
    counter = editcount.Counter(P.path("byte_bpe_50k.json"), P.PATTERN)
    doc = editcount.Document(prose(6, 200_000), counter)

    def walk(x):
        yield x
        if x.left is not None:
            yield from walk(x.left)
            yield from walk(x.right)

    before = set(walk(doc.root))
    doc.edit(600_000, 5, "something else")
    new = [x for x in walk(doc.root) if x not in before]
    assert doc.again <= 12 and len(new) <= 6 * doc.root.height and len(before) > 3000


def test_update_of_some(spark, docs):
    """Edits joined to kept trees: equal to a full recount, and the encoding is a hundredth where a hundredth is edited."""
    tools = {"tokenizer": P.path("byte_bpe_50k.json"), "pattern": P.PATTERN}
    trees = editcount.write_trees(docs.unionByName(docs.limit(3)), **tools).cache()
    rows = [(d, [(3, 2, "abc"), (0, 0, None), (10**9, 4, " end")]) for d in range(0, 200, 20)] + [(None, [(0, 0, "x")]), (7, []), (9, None)]
    edits = spark.createDataFrame(rows, f"doc_id bigint, edits {editcount.EDITS}")
    got = editcount.update_trees(trees, edits, **tools).collect()
    assert len(got) == docs.count() + 3
    counter = editcount.Counter(*tools.values())
    old = texts_of(docs)
    for r in got:
        want = old[r["doc_id"]] or ""
        if r["doc_id"] % 20 == 0 and r["doc_id"] < 200:
            for e in ((3, 2, "abc"), (10**9, 4, " end")):
                want = replaced(want, *e)
        fresh = editcount.Document(want, counter)
        assert r["text"] == want and (r["n_tokens"], r["n_pretokens"]) == (fresh.n_tokens, fresh.n_pretokens) and sum(r["leaf_tokens"]) == r["n_tokens"]
        assert r["pretokens_encoded"] <= 20 if r["doc_id"] % 20 == 0 else r["pretokens_encoded"] == 0
    again = editcount.apply_edits(spark.createDataFrame(got).withColumn("edits", F.lit(None).cast(editcount.EDITS)), **tools)
    assert again.where("n_tokens <> n_tokens_before or pretokens_encoded <> 0").count() == 0 and again.count() == len(got)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_counts_brute(request, which):
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True

    def edited(d, text):
        n, k = len(text), (d or 0) % 997
        for e in ((n * (k % 7) // 7, 0, f" item{k}"), (n * (k % 5) // 5, min(12, n), ""), (n * (k % 3) // 3 + 1, 3, "'ll \n x9")):
            text = replaced(text, *e)
        return text

    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = Counter((r["doc_id"], count(r["text"] or ""), count(edited(r["doc_id"], r["text"] or ""))) for r in df.select("doc_id", "text").collect())
    rows = editcount.edited_counts(df, tokenizer=P.path("byte_bpe_50k.json"), pattern=P.PATTERN).collect()
    assert Counter(tuple(r)[:3] for r in rows) == want
    assert all(r["pretokens_encoded"] <= 40 for r in rows)
    assert editcount.edited_counts(df.limit(0), tokenizer=P.path("byte_bpe_50k.json"), pattern=P.PATTERN).count() == 0


# chat

def test_snapshots(spark):
    talk = [("user", "hi"), ("bot", "yes"), ("user", None), ("bot", "end")]
    rows = []
    for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (None, 3)):
        rows += [(c, t, *talk[t]) for t in range(n)]
    rows += [(6, 0, "bot", "hi"), (7, 5, "user", "hi"), (7, None, None, "first"), (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    rows += [(9, t, "u", str(t)) for t in range(700)] + [(10, t, "u", str(t)) for t in range(699)]
    df = frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    got = {}
    for r in chat.render(df).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["part"], r["n_turns"], r["text"]))
    assert set(got) == {2, 6, 7, 8, 9} and [p for p, _, _ in got[9]] == [0, 1, 2]
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[2] == [(0, 4, line("user", "hi") + line("bot", "yes") + line("user", "") + line("bot", "end"))]
    assert "".join(t for _, _, t in got[7]) == line("", "first") + line("user", "hi")
    assert "".join(t for _, _, t in got[9]) == "".join(line("u", t) for t in range(700))
    assert chat.render(df.limit(0)).count() == 0


def chat_brute(rows):
    """{(conv, part): (turns, text)} by sorting, comparing and cutting lists."""
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    seqs = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in talks.items()}
    best = {}
    for c, s in seqs.items():
        best.setdefault(tuple(s), []).append(c)
    heads = {s[:k] for s in best for k in range(1, len(s))}
    out = {}
    for s, owners in best.items():
        if s not in heads:
            c = min([x for x in owners if x is not None], default=None)
            for k in range(0, len(s), 256):
                out[c, k // 256] = len(s), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s[k : k + 256])
    return out


def test_snapshots_brute(spark, sf):
    """Ties of turn and role, many null turns, rows alike in all columns, a conversation with most rows: against lists, and the SQL on the same rows."""
    import duckdb

    from foldspark.llm import queries

    r = random.Random(9)
    rows = [(c, t, "u", f"m{t}") for c in range(30) for t in range(c % 7)]
    rows += [(40, None, "u", x) for x in "debac" * 2] + [(41, 0, None, x) for x in "debac"] + [(42, None, None, None)] * 600 + [(43, 3, "bot", "same")] * 2000
    rows += [(44, r.randrange(900), r.choice("ab"), str(r.randrange(5))) for _ in range(1500)] + [(None, 1, "u", "x"), (None, None, "u", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    want = chat_brute(rows)
    got = {(x["conv_id"], x["part"]): (x["n_turns"], x["text"]) for x in chat.render(df).collect()}
    assert got == want
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert {(c, p): (n, t) for c, p, n, t in con.sql(f"SELECT conv_id, part, n_turns, text FROM ({queries.OP10_SQL})").fetchall()} == want
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    own = [(x["conv_id"], x["turn"], x["role"], x["text"]) for x in table.collect()]
    assert {(x["conv_id"], x["part"]): (x["n_turns"], x["text"]) for x in chat.render(table).collect()} == chat_brute(own)
