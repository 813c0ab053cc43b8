"""Operators on documents against brute-force versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, bpe_codec, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, texthash, token_counts
from tessella.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Distinct texts, copies, near copies, repeated lines, nulls, empty, blank, short and long texts."""
    rng = random.Random(5)
    base = [text(rng, rng.randrange(8, 90)) for _ in range(25)]
    out = list(base)
    for t in base[:8]:
        out.append(t)
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    hot = text(rng, 60)
    for i in range(150):  # a group of near copies larger than a block
        w = hot.split()
        w[i % 60] = f"new{i}"
        out.append(" ".join(w[: 60 - i % 3]))
    line = text(rng, 20)
    out += [f"{text(rng, 12)}\n{line}\n{text(rng, 9)}", f"{line}\n{line} more\nshort one", f"short one\n{line.upper()}"]
    out += [None, "", "   \n\t", "one", "one", "one two three", "é\0\x1cß <|endoftext|> ’s İ", "x" * 30_000, text(rng, 9000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clashing = ["id", "u", "v", "bucket", "key", "n", "bits", "line", "tokens", "doc", "unit", "cell", "size", "sig", "w", "h"]
    return df.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(clashing)]).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingles(t, n=5):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def close(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def test_word_hashes():
    w, at = texthash.word_hashes(["a b!! c", "", "###", "x_1 Y  z.", "A"])
    assert at.tolist() == [0, 3, 3, 3, 6, 7] and w[0] == w[6]
    assert texthash.word_hashes(["a b!! c", "###"], symbols=True)[1].tolist() == [0, 4, 5]
    s, at = texthash.shingles(*texthash.word_hashes(["a b c d e f", "a b", "", "a b c d e"]), 5)
    assert at.tolist() == [0, 2, 3, 3, 4] and s[0] == s[3] != s[2]
    keys = texthash.sequence_keys(*texthash.word_hashes(["a b", "b a", "A, b"]))
    assert (keys[0] == keys[2]).all() and (keys[0] != keys[1]).all()


def test_ngram_join(docs, rows, empty):
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = {i: [j for j in sets if j != i and sets[i] and sets[j] and close(sets[i], sets[j])] for i in sets}
    component = {}
    for i in sorted(sets):
        if i not in component:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in component:
                    component[j] = i
                    todo += links[j]
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (component[i], len(links[i])) for i in sets}
    assert max(map(len, links.values())) > 60
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(component.values())
    assert ngram_join.jaccard_join(empty).collect() == []
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(None, rows[0][1]), (4, None), (4, rows[4][1]), (4, "z")], "doc_id long, text string"))
    again = ngram_join.jaccard_join(more).collect()
    assert len(again) == len(rows) + 4 and all(tuple(r) == (tuple(got[r.doc_id]) if r.doc_id is not None else (None, None, 0)) for r in again)


def test_ngram_join_of_groups_larger_than_blocks(spark, monkeypatch):
    from tessella.llm import bucketjoin

    rng = random.Random(7)
    hot = text(rng, 80).split()
    texts = [" ".join([*hot[: i % 80], f"n{i}", *hot[i % 80 :]]) for i in range(240)]
    monkeypatch.setattr(bucketjoin, "BLOCK", 50)
    sets = [shingles(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(df).collect()}
    links = {i: sum(close(sets[i], s) for j, s in enumerate(sets) if j != i) for i in range(240)}
    assert got == {i: (0, n) for i, n in links.items()} and min(links.values()) > 0


def test_ngram_join_of_short_texts_in_large_buckets(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(5):
        passage = words(94)  # 90 shingles, which 1000 longer and otherwise different texts hold too
        texts += [" ".join(passage + words(9)) for _ in range(2)] + [" ".join(passage + words(220)) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(df, recall=0.99, max_depth=1).collect()}
    assert close(shingles(texts[0]), shingles(texts[1])) and not close(shingles(texts[0]), shingles(texts[2]))
    assert got == {i: (i - (i % 1002 == 1), int(i % 1002 < 2)) for i in range(len(texts))}


def brute_removed(rows):
    seen, out = [], {}
    for i, t in sorted(rows):
        for n, line in enumerate((t or "").split("\n")):
            if len(re.findall(r"\w+", line)) >= 5:
                s = shingles(line)
                if any(close(s, x) for x in seen):
                    out.setdefault(i, []).append(n)
                seen.append(s)
    return out


def test_line_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in line_dedup.line_counts(docs).collect()}
    expected = brute_removed(rows)
    assert {i: r.removed for i, r in got.items() if r.removed} == expected and len(got) == len(rows)
    assert all(r.n_removed == len(r.removed) and r.n_lines == (dict(rows)[i] or "").count("\n") + 1 for i, r in got.items())
    texts = {r.doc_id: r.text for r in line_dedup.without_lines(docs, line_dedup.removed_lines(docs)).collect()}
    cut = lambda i, t: t if i not in expected else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in expected[i])
    assert texts == {i: cut(i, t) for i, t in rows}
    assert line_dedup.line_counts(empty).collect() == []


def test_line_dedup_of_many_near_lines(spark):
    rng = random.Random(3)
    passage, rows = text(rng, 60).split(), []
    for i in range(120):  # near copies of one line, lines that hold most of it, and others
        near = [*passage[: i % 60], f"x{i}", *passage[i % 60 + 1 :]]
        held = text(rng, 8 + i % 30).split() + passage[: 20 + i % 41]
        rows.append((i, "\n".join([" ".join(near), " ".join(held), text(rng, 4 + i % 9)])))
    expected = brute_removed(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(df).collect()} == expected and len(expected) > 100


@pytest.mark.parametrize("most", [0, line_dedup.HASHED_TOKENS])
def test_line_dedup_by_sorted_and_by_hashed_joins(spark, docs, rows, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "HASHED_TOKENS", most)
    plans, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, tag: plans.append((tag, df._jdf.queryExecution().toString())) or write(df, tag))
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(docs).collect()} == brute_removed(rows)
    assert {tag: "ShuffledHashJoin" in plan for tag, plan in plans if tag in ("likely", "ranked")} == {"likely": most > 0, "ranked": most > 0}


def test_line_dedup_of_lines_that_few_tokens_decide(spark):
    """Sets near the threshold, some of which make the tokens of all their words and some not; repeated shingles, other scripts, equal sets of different lines."""
    rng = random.Random(9)
    letters = "bdfhjlnprtvxz" + "aceikmoq" * 2 + "éèж中"
    word = lambda: rng.choice(letters) + rng.choice(WORDS) + str(rng.randrange(30))
    lines = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(5, 130))]
        if rng.random() < 0.3:
            base = base[: rng.randrange(5, 20)] * rng.randrange(2, 8)
        for _ in range(6):
            near = list(base)
            if rng.random() < 0.5:  # words that come forward go first, so that what is left has few
                near = [w for w in near if w[0] not in line_dedup.FIRST or rng.random() < 0.97]
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = word()
            cut = rng.randrange(1 + len(near) // 9)
            lines.append(rng.choice([" ", ", ", " - ", "  "]).join(near[cut:] if rng.random() < 0.5 else near[: len(near) - cut]))
    lines += ["b " * k + "!" for k in (5, 6, 9, 50, 90)] + [" ".join(["ba", "ab"] * k) for k in (3, 4, 40)]
    rng.shuffle(lines)
    rows = [(i // 3, x) for i, x in enumerate(lines)]
    rows = [(i, "\n".join(x for k, x in rows if k == i)) for i in range(len(lines) // 3 + 1)]
    expected = brute_removed(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(df).collect()} == expected and len(expected) > 40
    made = line_dedup._with_prefix(df.select(F.explode(F.split("text", "\n")).alias("content")), 5, Fraction(4, 5)).select("least", "most").collect()
    assert 50 < sum(r.least < r.most for r in made) < len(made) - 50


def test_line_dedup_makes_few_tokens_of_long_lines(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(text(rng, 200),) for _ in range(50)], "content string")
    made = line_dedup._with_prefix(df, 5, Fraction(4, 5)).collect()
    assert all(r.least < 0.7 * r.most and r.most == 196 and len(r.prefix) == 42 for r in made)


def test_line_dedup_words(spark):
    """All characters apart and in a row, against the one expression that defines words."""
    chars = [chr(c) for c in [*range(0x3000), 0xFEFF, 0xFF10, 0x1D7D8, 0x1F600, 0x20000] if c != 10]
    lines = [f"a{c}b {c}{c} c{c}" for c in chars] + [f"a{x} {y}b  c" for x, y in zip(chars, chars[1:])] + ["", " ", "-", "a", " a - b ", "  -a"]
    df = spark.createDataFrame([(x,) for x in lines], "content string")
    defined = F.array_remove(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+"), "")
    got = line_dedup._plain(df, 0, "content").select("plain", "words", F.array_join(defined, " ").alias("joined"), F.size(defined).alias("n")).collect()
    assert len(got) == len(lines) and [(r.plain, r.words) for r in got] == [(r.joined, r.n) for r in got]


def test_line_dedup_of_repeated_ids(spark):
    line = "one two three four five six seven"
    df = spark.createDataFrame([(1, f"a\n{line}"), (1, f"a\n{line}"), (1, "b"), (2, line), (2, line), (None, line)], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(df).collect()} == {2: [0]}
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.without_lines(df, line_dedup.removed_lines(df)).collect()) == [(0, line), (1, f"a\n{line}"), (1, f"a\n{line}"), (1, "b"), (2, ""), (2, "")]


def test_line_dedup_with_ids_that_do_not_fit(spark):
    line = "one two three four five six seven"
    df = spark.createDataFrame([(-3, line), (2**61, f"x\n{line}"), (None, line)], "doc_id long, text string")
    assert [(r.doc_id, r.removed) for r in line_dedup.removed_lines(df).collect()] == [(2**61, [1])]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def library_ids(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    rng = random.Random(1)
    letters = "ab'sTELLve 12 é́İΣσÅẞ²½١中　\x1c\x1d\x85\xa0​\U0001f600_-##<|endoftext|>\n\tǅͅ가aaaaaa"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["<|endoftext|>", "a<|startoftext|>b <|END", "a" * 700, "", " ", None]
    encoder = bpe.WordBpe(tokenizer_path())
    for _ in range(2):  # with an empty and with a full cache
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library_ids(library, t) for t in texts]
    encoder.chunks.size = encoder.words.size = 3
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[:200])] == [library_ids(library, t) for t in texts[:200]]


def test_known_chunks_are_not_encoded_again(monkeypatch):
    rng = random.Random(6)
    encoder = bpe.WordBpe(tokenizer_path())
    texts = [" ".join(f"{rng.choice(WORDS)[:4]}{i}" for i in range(k, k + 5000)) for k in range(0, 250_000, 5000)]
    first = [list(encoder.encode([t])) for t in texts]
    monkeypatch.setattr(bpe.WordBpe, "encode_chunks", lambda self, chunks: pytest.fail("a known chunk was encoded again"))
    assert [list(encoder.encode([t])) for t in texts] == first


def test_table_of_chunks(library, monkeypatch):
    """Chunks of all lengths around those of the table's keys, with U+0000 and white space of several bytes, in small tables."""
    rng = random.Random(8)
    letters = ["a", "b", "\0", "é", "가", "\U0001f600", "\x85", "\u3000", "\xa0", "\x1c", "Z"]
    words = ["".join(rng.choice(letters[: rng.choice([2, 3, 11])]) for _ in range(rng.randrange(1, 27))) for _ in range(1500)]
    words += ["a" * n for n in range(1, 50)] + ["a" * n + "\0" for n in range(1, 30)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(400)]
    expected = [library_ids(library, t) for t in texts]
    monkeypatch.setattr(bpe, "ENCODE_CHARS", 2000)
    monkeypatch.setattr(bpe, "LOOKUP", 50)
    for size in (0, 1, 300, 10**6):
        encoder = bpe.WordBpe(tokenizer_path())
        encoder.chunks.size = size
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected
        assert size or encoder.chunks.n < 300
    texts = ["a b " * 900 + "\u3000", "c" * 5000 + " d"]  # cut into pieces
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library_ids(library, t) for t in texts]


def test_bpe_codec(docs, rows, empty, library):
    got = {r.doc_id: r for r in bpe_codec.round_trip(docs, tokenizer_path()).collect()}
    for i, t in rows:
        ids = library_ids(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    encoded = bpe_codec.encode(docs, tokenizer_path())
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library_ids(library, t) for i, t in rows}
    assert {r.doc_id: r.text for r in bpe_codec.decode(encoded, tokenizer_path()).collect()} == {i: library.decode(library_ids(library, t), skip_special_tokens=False) for i, t in rows}
    assert bpe_codec.round_trip(empty, tokenizer_path()).collect() == []


def test_decoding_of_whole_pieces(library):
    """The decoded text is put together from the ids of a piece at once, with no text of a chunk kept."""
    encoder = bpe.WordBpe(tokenizer_path())
    decoder = bpe_codec.Decoder(encoder)
    texts = ["", " ", "one two, three", "é\0 ß <|endoftext|>x ’s", "a" * 40 + "\u3000b", "x " * 3000]
    for t, ids in zip(texts, encoder.encode_pieces(texts), strict=True):
        assert ids.dtype == "<u4" and ids.tolist() == library_ids(library, t)
        assert decoder(ids).decode() == library.decode(library_ids(library, t), skip_special_tokens=False)
    assert not hasattr(decoder, "cache")


def test_token_counts(docs, rows, empty, library):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer_path()).collect()}
    for i, t in rows:
        n = len(library_ids(library, t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert any(r.over_limit for r in got.values())
    assert token_counts.count_tokens(empty, tokenizer_path()).collect() == []


def test_token_counts_of_other_files(docs, rows):
    import public_tokenizers
    import sentencepiece

    some = docs.where("length(text) < 1000")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(some, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(model.encode(dict(rows)[i])) for i in got}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(some, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(library_ids(library, dict(rows)[i])) for i in got}


def test_packing(docs, rows, empty, library):
    pieces = packing.pack(docs, tokenizer_path()).collect()
    ids = {i: [*library_ids(library, t), 2] for i, t in rows}
    seen, windows = {i: [] for i in ids}, {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[p.doc_id].append((p.start, p.length))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, parts in seen.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) == len(ids[i])
    for parts in windows.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [s for s, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and total <= 4096 and total & (total - 1) == 0
    assert packing.pack(empty, tokenizer_path()).collect() == []


def test_sum_of_squares_rule():
    rng = random.Random(2)
    packer = packing.SumOfSquares(16)
    for _ in range(500):
        n = rng.randrange(1, 16)
        level = packer.level[:17].copy()

        def cost(h):
            after = level.copy()  # noqa: B023
            after[h] -= h > 0
            after[h + n] += h + n < 16  # noqa: B023
            return (after[1:16] ** 2).sum()

        choices = [h for h in range(17 - n) if h == 0 or level[h]]
        assert cost(packer.place(n)) == min(map(cost, choices))
        list(packer.take(0, bytes(4 * n)))


def test_quality_rules(spark, docs, rows, empty):
    import duckdb
    import pandas as pd

    more = [(1000, "a b c\n" * 40), (1001, " ".join(f"w{i}***" for i in range(60))), (1002, " ".join(f"w{i}!!" for i in range(60))), (1003, " ".join(f"w{i}" for i in range(60)))]
    df = docs.select("doc_id", "text", "w", "h").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = {r.doc_id: tuple(r) for r in quality_rules.apply_rules(df).select(*names).collect()}
    documents = pd.DataFrame([r for r in [*rows, *more] if "\0" not in (r[1] or "")], columns=["doc_id", "text"])
    expected = {r[0]: r for r in duckdb.sql(quality_rules.SQL).fetchall()}
    assert len(documents) and {i: got[i] for i in expected} == expected
    assert [got[i][-1] for i in (1000, 1001, 1002, 1003)] == [False, False, False, True]
    orders = [r.name for r in quality_rules.order_rules(df)]
    assert orders == [r.name for r in quality_rules.order_rules(df.repartition(3))] and sorted(orders) == sorted(r.name for r in quality_rules.RULES)
    assert quality_rules.order_rules(empty) == list(quality_rules.RULES)
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == {i for i, r in got.items() if r[-1]}
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.apply_rules(empty).collect() == []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert got[i][5] == len({k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)})


def test_rules_are_short_circuited(spark):
    """The feature of a later rule is computed for no row that an earlier one rejects."""
    costly = quality_rules.Feature(("text",), lambda t: F.when(F.length(t) >= 4, F.length(t)).otherwise(F.raise_error(F.lit("looked at")).cast("int")), 1e6, 0)
    cheap = quality_rules.Feature(("text",), F.length, 1, 0)
    features = quality_rules.FEATURES | {"cheap": cheap, "costly": costly}
    rules = (quality_rules.Rule("costly", ("costly",), lambda n: n > 6), quality_rules.Rule("cheap", ("cheap",), lambda n: n < 4))
    df = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(90)], "doc_id long, text string")
    ordered = quality_rules.order_rules(df.where("length(text) >= 4").union(spark.createDataFrame([(1000 + i, "yyyy") for i in range(9)], df.schema)), rules, features=features)
    assert [r.name for r in ordered] == ["costly", "cheap"]  # nothing is short there, so only the costly rule rejects
    spark_order = quality_rules.order_rules
    quality_rules.order_rules = lambda docs, rules, *rest: [rules[1], rules[0]]
    try:
        kept = {len(r.text) for r in quality_rules.keep_good(df, rules=rules, features=features).collect()}
    finally:
        quality_rules.order_rules = spark_order
    assert kept == {4, 5, 6}


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(4)
    good = [text(rng, 80) for _ in range(150)]
    bad = [" ".join(w + rng.choice(["***", "###", "$$$"]) for w in text(rng, 80).split()) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*good, *bad, "", None])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)] + [(None, 1, 0), (3, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_classifier.classify(df, labels).collect()}
    assert len(got) == 212 and sum(got[i] for i in range(150)) >= 147 and sum(got[i] for i in range(150, 210)) <= 3
    kept = quality_classifier.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality_classifier.classify(empty, labels).collect() == []
    assert all(r.kept for r in quality_classifier.classify(docs, labels.where("false")).collect())
    more = spark.createDataFrame([(None, "w1 w2"), (5, "again"), (5, "again")], "doc_id long, text string")
    assert len(quality_classifier.classify(df.union(more), labels).collect()) == 215


def test_importance_resampling_against_brute_force(spark, rows):
    some = [(i, t) for i, t in rows if t]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in some if i % 2], "doc_id long, quality int")
    counts = {}
    for i, t in some:
        counts[i] = np.bincount(quality_classifier.features([t])[1], minlength=2 * quality_classifier.BUCKETS)
    raw, good = sum(counts.values()), sum(c for i, c in counts.items() if i % 2 and i % 3 > 0)
    rate = raw / raw.sum()
    target = (good + 10.0 * len(raw) * rate) / (good.sum() + 10.0 * len(raw))
    for budget in (None, 1, 60, 10**6):
        got = {r.doc_id: r for r in quality_classifier.classify(df, labels, budget=budget).collect()}
        logs = {i: sum(n * (math.log(target[b]) - math.log(rate[b])) for b, n in enumerate(c) if n) for i, c in counts.items()}
        assert all(abs(got[i].log_weight - logs[i]) < 1e-6 * max(1, abs(logs[i])) for i in logs)
        keys = {i: got[i].log_weight + float(quality_classifier.gumbel(np.array([i]), 11)[0]) for i in logs}
        assert all(abs(got[i].key - keys[i]) < 1e-9 * max(1, abs(keys[i])) for i in keys)
        share = Fraction(sum(i % 3 > 0 for i in logs if i % 2), sum(i % 2 for i in logs))
        k = max(sum(got[i].log_weight >= 0 for i in logs), math.ceil(share * len(logs))) if budget is None else min(budget, len(logs))
        assert {i for i in got if got[i].kept} == set(sorted(keys, key=lambda i: -got[i].key)[:k])


def test_gumbel_top_k_samples_by_weight():
    weights = np.array([8.0, 4, 2, 1, 1])
    first = np.zeros(5)
    for seed in range(4000):
        first[np.argmax(np.log(weights) + quality_classifier.gumbel(np.arange(5), seed * 977))] += 1
    assert np.abs(first / 4000 - weights / weights.sum()).max() < 0.03


def test_rank_by_histogram(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) ** 5 for _ in range(5000)] + [0.5] * 2000
    keys = spark.createDataFrame([(v,) for v in values], "key double").cache()
    for k in (1, 2, 700, 2600, 6999, 7000):
        assert quality_classifier.key_of_rank(keys, k) == sorted(values, reverse=True)[k - 1]


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs).collect()
    texts = {i: t or "" for i, t in rows}
    assert len(got) == len(rows) and all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    shard_of = {}
    for r in got:
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard and 0 <= r.shard < 16
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(empty).collect() == []
    few = sharding.shard(docs, shards=3, units=8).collect()
    assert {r.shard for r in few} <= {0, 1, 2} and sorted(r.slot for r in few if r.shard == 1) == list(range(sum(r.shard == 1 for r in few)))


def test_shards_are_balanced_and_large_units_split(spark):
    rng = random.Random(6)
    texts = [text(rng, rng.randrange(5, 60)) for _ in range(300)]
    rows = [(i % 7 if i % 3 else None, texts[i % 300]) for i in range(900)] + [(None, "hot")] * 400
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), units=64).collect()
    size, units = Counter(), Counter()
    for r in got:
        size[r.shard] += r["size"]
    for _, t in rows:
        units[t] += len(t) + 1
    assert len(got) == len(rows) and len(size) == 16
    whole = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))
    size = Counter()
    for r in whole.collect():
        size[r.shard] += r["size"]
    assert max(size.values()) <= sum(size.values()) / 16 + max(units.values())
    for some in (got, whole.collect()):
        for s in range(16):
            assert sorted(r.slot for r in some if r.shard == s) == list(range(sum(r.shard == s for r in some)))


def test_smallest_capacity():
    rng = random.Random(8)

    def best(sizes, k):
        if k == 1:
            return sum(sizes)
        return min(max(sum(sizes[:i]), best(sizes[i:], k - 1)) for i in range(1, len(sizes) + 1)) if sizes else 0

    for _ in range(200):
        sizes, k = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 5)
        assert sharding.smallest_capacity(np.array(sizes), k) == best(sizes, k)
