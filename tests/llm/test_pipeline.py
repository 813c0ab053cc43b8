"""The stages of the corpus pipeline together against a brute-force version, and their edge cases."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_removed, close, shingles, text

from tessella.llm import quality_classifier
from tessella.llm.queries import tokenizer_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def corpus():
    rng = random.Random(11)
    good = ["\n".join(text(rng, rng.randrange(12, 40)) for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    out = [t for t in good if len(t.split()) >= 50]
    line = text(rng, 25)
    out += [f"{t}\n{line}" for t in out[:4]] + [out[5], out[5], out[6].upper()]
    for t in out[7:10]:
        w = t.split(" ")
        w[3] = "changed"
        out.append(" ".join(w))
    out += [" ".join(w + "***" for w in text(rng, 60).split()) for _ in range(12)]
    out += [text(rng, 20), "a b c " * 40, "one\ntwo\n" * 60, None, "", " \n "]
    rng.shuffle(out)
    return list(enumerate(out))


def brute_classifier(rows, labels):
    counts = {i: np.bincount(quality_classifier.features([t or ""])[1], minlength=2 * quality_classifier.BUCKETS) for i, t in rows}
    raw, good = sum(counts.values()), sum(c for i, c in counts.items() if labels.get(i) == 1)
    rate = raw / raw.sum()
    target = (good + 10.0 * len(raw) * rate) / (good.sum() + 10.0 * len(raw))
    logs = {i: sum(n * (math.log(target[b]) - math.log(rate[b])) for b, n in enumerate(c) if n) for i, c in counts.items()}
    keys = {i: x + float(quality_classifier.gumbel(np.array([i]), 11)[0]) for i, x in logs.items()}
    k = max(sum(x >= -1e-9 for x in logs.values()), math.ceil(Fraction(sum(labels.values()), len(labels)) * len(rows)))
    return set(sorted(keys, key=lambda i: -keys[i])[:k])


def passes(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = len({k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)})
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, w))
    return not (
        len(w) < 50 or 100 * repeated > 50 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 10 * t.count("!!") > len(w)
        or not 2 * len(w) <= chars <= 16 * len(w) or 10 * (len(lines) - len(set(lines))) > len(w)
    )


def brute_pipeline(rows, labels):
    kept = brute_classifier(rows, labels)
    rows = [(i, t) for i, t in rows if i in kept and passes(t)]
    gone = brute_removed(rows)
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))) for i, t in rows]
    sets, smallest = {i: shingles(t) for i, t in rows}, {}
    for i in sorted(sets):
        if i not in smallest:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in smallest:
                    smallest[j] = i
                    todo += [k for k in sets if sets[k] and sets[j] and close(sets[j], sets[k])]
    return {i: t for i, t in rows if smallest[i] == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    labels = {i: int("***" not in (t or "") and passes(t)) for i, t in rows if i % 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("n_chars", F.length("text"))
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("id", "key", "line", "bucket", "words", "kept"))])
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def test_pipeline_against_brute_force(spark, folder):
    path, rows, labels = folder
    expected = brute_pipeline(rows, labels)
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.run(spark, path).collect()
    assert 10 < len(expected) < len(rows) - 20 and {p.doc_id for p in pieces} == expected.keys()
    for i, t in expected.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == len(library.encode(t, add_special_tokens=False).ids) + 1


def test_stages_keep_columns_and_bear_odd_rows(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(2)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.union(odd), path)
        assert out.schema.names == docs.schema.names and 0 < out.count() <= len(rows) + odd.count(), name
        assert stage(spark, docs.where("false"), path).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), path).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, odd, path).select("doc_id").distinct().count() <= 3
