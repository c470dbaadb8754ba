"""The pipeline and each of its stages against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import pytest

pytest.importorskip("foldspark.llm")
import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from llm_brute import check_pieces, components_brute, contaminated_brute, rules_brute  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from foldspark.llm import quality  # noqa: E402

STAGES = dict(cp.STAGES)
EXTRA = "bucket id n c node label score rank salt size uid seq key_id d1 d2 first start length row copy".split()


def ids_and_texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def keep_quality(spark, rows, docs, labels):
    """Scores of the model's definition, one text at a time."""
    model = quality.train(docs, labels)
    out = Counter()
    for (d, t), n in rows.items():
        raw = np.frombuffer((t or "").encode(), np.uint8)
        if model.scores(*quality.indicators(raw, np.array([0, len(raw)])))[0] >= 0.7:
            out[d, t] += n
    return out


def keep_rules(rows):
    return Counter({(d, t): n for (d, t), n in rows.items() if rules_brute(t)[-1]})


def keep_first(rows):
    """One row of each group of rows that share 80 % of five-word shingles."""
    listed = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    comp, size = components_brute(dict(enumerate(t for _, t in listed)), 5, 80)
    out, seen = Counter(), set()
    for i, row in enumerate(listed):
        if not size[i]:
            out[row] += rows[row]
        elif comp[i] not in seen:
            seen.add(comp[i])
            out[row] += 1
    return out


def keep_clean(rows, items):
    return Counter({(d, t): n for (d, t), n in rows.items() if not contaminated_brute(t, items)})


def brute(spark, sf, tables=None):
    docs, labels, bench = tables or [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark")]
    rows = [ids_and_texts(docs)]
    rows.append(keep_quality(spark, rows[-1], docs, labels))
    rows.append(keep_rules(rows[-1]))
    rows.append(keep_first(rows[-1]))
    rows.append(keep_clean(rows[-1], [r["text"] for r in bench.collect()]))
    return rows


def test_stages_brute(spark, sf):
    """Every stage on all that the stage before it kept, and the packing of what is left."""
    want = brute(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), rows in zip(cp.STAGES[:-1], want[1:]):
        docs_next = stage(spark, docs, sf)
        assert docs_next.columns == docs.columns, name
        assert ids_and_texts(docs_next) == rows, name
        docs = docs_next
    got = cp.run(spark, sf).collect()
    check_pieces(got, dict(want[-1].keys()))
    assert sum(want[-1].values()) > 0.5 * sum(want[0].values())


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    r = random.Random(21)
    words = ["".join(r.choices("aeioubcdfglmnprst", k=r.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) + (str(r.randrange(50)) if r.random() < 0.05 else "") for _ in range(n))
    texts = [prose(150 + 5 * i) for i in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en")] * 2 + [(4, texts[9] + " and then some more", None), (None, texts[5], "en"), (None, texts[6] + " again", "en"), (None, None, None), (50, None, "en"), (51, "", "en")]
    rows += [(52, " \n", "en"), (53, prose(40_000), "en"), (54, "x" * 100_000, "en"), (55, "short text", "en"), (56, "spam " * 400, "en"), (57, texts[7] + " " + texts[8], "en")]
    at = str(tmp_path_factory.mktemp("odd"))
    clash = lambda df: df.select("*", *[F.lit("x").alias(c) for c in EXTRA if c not in df.columns])
    clash(spark.createDataFrame([(d, t, lang, "web", len(t or "")) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 5 > 0), 0) for i in range(30)] + [(50, 0, 0), (54, 0, 0), (56, 0, None), (55, None, 1), (None, 1, 0), (999, 1, 1)]
    clash(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).write.parquet(f"{at}/labels.parquet")
    items = [(1, texts[10]), (None, " ".join(texts[11].split()[:60])), (2, None), (3, ""), (4, "nothing of this kind occurs anywhere in here")]
    clash(spark.createDataFrame(items, "item_id bigint, text string")).write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_odd(spark, odd_dir):
    """Each stage alone on the odd rows, so that no stage hides them from the next."""
    docs, labels, bench = (spark.read.parquet(f"{odd_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = ids_and_texts(docs)
    want = {
        "quality classifier": keep_quality(spark, rows, docs, labels),
        "quality rules": keep_rules(rows),
        "MinHash near-dedup": keep_first(rows),
        "benchmark decontamination": keep_clean(rows, [r["text"] for r in bench.collect()]),
    }
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, odd_dir)
        assert got.columns == docs.columns and ids_and_texts(got) == want[name], name
    assert sum(want["benchmark decontamination"].values()) < sum(rows.values())
    pieces = STAGES["packing"](spark, docs, odd_dir).collect()
    assert sum(r["start"] == 0 for r in pieces) == docs.count() and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert cp.run(spark, odd_dir).count() >= 0


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, odd_dir, tmp_path, empty):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{odd_dir}/{t}.parquet")
        (df.limit(0) if t == empty else df).write.parquet(f"{tmp_path}/{t}.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.columns[:3] == ["doc_id", "start", "length"] and (got.count() == 0 if empty == "documents" else got.count() >= 0)
