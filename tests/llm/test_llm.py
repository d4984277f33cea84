"""Corpus operators: brute force, round trips and the defined edge cases."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from rhythmlake.llm import packing, queries, spans, subsequences, tokens
from rhythmlake.llm.cooccurrence import cooccurrence, significant

ROWS = "device_id long, day string, app string, us long, item string, s0 long, n long"


def row(d, day, app, us=0):
    return (d, day, app, us, "clash", 0, 0)


def baskets(seed, n=1500):
    rnd = random.Random(seed)
    apps = [f"a{i}" for i in range(12)]
    rows = [row(rnd.choice([1, 2, 3]), f"d{rnd.randrange(60)}", rnd.choice(apps), rnd.randrange(50)) for _ in range(n)]
    return rows + rows[:100] + [row(None, "d1", "a1"), row(1, None, "a1"), row(1, "d1", None)]


@pytest.mark.parametrize("held", [5, 100_000])
def test_cooccurrence(spark, held):
    rows = baskets(1, 900)
    got = {(r.item_a, r.item_b): r for r in cooccurrence(spark.createDataFrame(rows, ROWS), ("device_id", "day"), "app", min_count=3, held=held).collect()}
    sets = {}
    for r in rows:
        if None not in r[:3]:
            sets.setdefault(r[:2], set()).add(r[2])
    n = len(sets)
    single = {a: sum(a in s for s in sets.values()) for a in {x for s in sets.values() for x in s}}
    want = {}
    for a, b in itertools.combinations(sorted(single), 2):
        k = sum(a in s and b in s for s in sets.values())
        if k >= 3:
            want[a, b] = k
    assert {p: r.n_ab for p, r in got.items()} == want
    for (a, b), r in got.items():
        k, x, y = want[a, b], single[a], single[b]
        g = 2 * sum(o * math.log(o * n / (i * j)) for o, i, j in ((k, x, y), (x - k, x, n - y), (y - k, n - x, y), (n - x - y + k, n - x, n - y)) if o)
        assert (r.n_a, r.n_b, r.n_baskets) == (x, y, n) and abs(r.llr - g) < 1e-6 and abs(r.lift - k * n / x / y) < 1e-9


def test_cooccurrence_hot_and_empty(spark):
    rows = [row(1, f"d{i}", a) for i in range(300) for a in ("hot", f"x{i % 10}")] + [row(2, f"d{i}", a) for i in range(20) for a in ("p", "q")]
    df = spark.createDataFrame(rows, ROWS)
    found = cooccurrence(df, ("device_id", "day"), "app")
    assert found.count() == 11
    assert [(r.item_a, r.item_b) for r in significant(found).collect()] == [("p", "q")]
    assert cooccurrence(df.limit(0), ("device_id", "day"), "app").count() == 0


def test_all_pairs_are_given(spark, tmp_path):
    """p2_pairs also has the pairs of fewer than ten baskets; p2_found needs ten."""
    rows = [(1, f"d{i}", a) for i in range(10) for a in ("a", "b")] + [(1, "e0", "a"), (1, "e0", "c")] + [(1, f"f{i}", "z") for i in range(30)]
    spark.createDataFrame(rows, "device_id long, day_key string, app_pkg string").write.parquet(f"{tmp_path}/sessions.parquet")
    assert {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in queries.p2_pairs(spark, str(tmp_path)).collect()} == {("a", "b", 10, 11, 10, 41), ("a", "c", 1, 11, 1, 41)}
    assert [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()] == [("a", "b")]


@pytest.mark.parametrize(("n", "n_a", "n_b", "n_ab", "lift"), [(91, 50, 64, 49, 1.393438), (61, 40, 48, 33, 1.048437)])
def test_pairs_are_rounded_as_in_sql(spark, tmp_path, n, n_a, n_b, n_ab, lift):
    """The lifts 49 * 91 / 3200 and 33 * 61 / 1920 end in a 5 at the seventh digit; as doubles, times a million, they lie at and just under the half."""
    rows = [(1, f"d{i}", x) for i in range(n) for x, here in (("a", i < n_a), ("b", n_a - n_ab <= i < n_a - n_ab + n_b), ("z", True)) if here]
    spark.createDataFrame(rows, "device_id long, day_key string, app_pkg string").write.parquet(f"{tmp_path}/sessions.parquet")
    out = queries.p2_pairs(spark, str(tmp_path)).filter("item_a = 'a' AND item_b = 'b'").collect()
    assert [(r.n_ab, r.n_a, r.n_b, r.n_baskets, r.lift) for r in out] == [(n_ab, n_a, n_b, n, lift)]
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sessions AS SELECT * FROM read_parquet('{tmp_path}/sessions.parquet/*.parquet')")
    assert sorted(tuple(r) for r in out) == [r for r in con.execute(queries.SQL["p2_pairs"]).fetchall() if r[:2] == ("a", "b")]


def brute_patterns(rows, least, share):
    seqs = {}
    for r in rows:
        if None not in r[:4]:
            seqs.setdefault(r[:2], []).append((r[3], r[2]))
    count = {}
    for s in seqs.values():
        apps = [a for _, a in sorted(s)]
        found = set()
        for k in (1, 2, 3):
            found |= {p for p in itertools.combinations(apps, k) if len(set(p)) == k}
        for p in found:
            count[p] = count.get(p, 0) + 1
    return {p: c for p, c in count.items() if c >= least and c * 100 >= share * len(seqs)}, len(seqs)


@pytest.mark.parametrize(("chunk", "block"), [(7, 10), (20_000, 200_000)])
def test_subsequences(spark, chunk, block):
    rows = baskets(3)
    out = subsequences.frequent_subsequences(spark.createDataFrame(rows, ROWS), ("device_id", "day"), ("us",), "app", share=(10, 100), chunk=chunk, block=block).collect()
    want, n = brute_patterns(rows, 10, 10)
    assert len(out) == len(want) and {tuple(r.pattern): r.n_sequences for r in out} == want and {r.n_all for r in out} == {n}


@pytest.mark.parametrize("distinct", [False, True])
def test_subsequences_of_any_length(spark, distinct):
    """Patterns of four and more steps, a returning app and a run, against brute force."""
    rnd = random.Random(8)
    days = {f"d{i}": ["a", "b", "a", "a", "c", "d", "e"] if i % 3 == 0 else rnd.choices("abcde", k=5) for i in range(60)}
    rows = [row(1, d, x, us) for d, apps in days.items() for us, x in enumerate(apps)]
    rows += rows[:150]
    want = Counter(p for apps in days.values() for p in {p for k in range(1, 8) for p in itertools.combinations(apps, k) if not distinct or len(set(p)) == k})
    want = {p: n for p, n in want.items() if n >= 12}
    out = subsequences.frequent_subsequences(spark.createDataFrame(rows, ROWS), ("device_id", "day"), ("us",), "app", share=(20, 100), length=None, distinct=distinct, block=50).collect()
    assert len(out) == len(want) and {tuple(r.pattern): r.n_sequences for r in out} == want
    assert ("a", "b", "c", "d", "e") in want and (distinct or {("a", "b", "a"), ("a", "a"), ("a", "b", "a", "a", "c", "d", "e")} <= want.keys())


def test_subsequences_edges(spark):
    df = spark.createDataFrame([row(1, "d", None), row(None, "d", "a")], ROWS)
    assert subsequences.frequent_subsequences(df, ("device_id", "day"), ("us",), "app").count() == 0
    assert subsequences.frequent_subsequences(df.limit(0), ("device_id", "day"), ("us",), "app").count() == 0


def test_compaction_keeps_patterns():
    rnd = random.Random(4)
    for _ in range(200):
        seq = [rnd.randrange(5) for _ in range(rnd.randrange(1, 60))]
        short = subsequences.compact(np.array(seq), 3).tolist()
        # in two steps as well
        twice = subsequences.compact(np.array(subsequences.compact(np.array(seq[:30]), 3).tolist() + seq[30:]), 3).tolist()
        for k in (1, 2, 3):
            want = set(itertools.combinations(seq, k))
            assert {p for p in itertools.combinations(short, k)} == want == {p for p in itertools.combinations(twice, k)}


def test_long_sequence(spark, monkeypatch):
    monkeypatch.setattr(subsequences, "LONG", 16)
    rows = [("s", x) for x in random.Random(5).choices("abcd", k=400)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["s0", "item"])
    (short,) = subsequences._sequences(subsequences._collected(True)(iter([batch])), 3)
    assert len(short) < 80 and {p for p in itertools.combinations(short, 2)} == {p for p in itertools.product("abcd", repeat=2)}


@pytest.mark.parametrize("collapse", [False, True])
def test_sequences_across_batches(collapse):
    import pyarrow as pa

    rnd = random.Random(6)
    rows = sorted((rnd.choice([1, 2, 3]), rnd.choice("xy"), i, rnd.choice("ab")) for i in range(120))
    want = [[r[3] for r in own] for _, own in itertools.groupby(rows, key=lambda r: r[:2])]
    if collapse:
        want = [[x for x, _ in itertools.groupby(w)] for w in want]
    for size in (1, 3, 50, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((r[0], r[1], r[3]) for r in rows[i : i + size]), strict=True)], ["s0", "s1", "item"]) for i in range(0, 120, size)]
        got = [x for b in subsequences._collected(collapse)(iter(batches)) for x in b.column(0).to_pylist()]
        assert got == want


DOCS = "doc_id long, text string, block long, words string"
TEXTS = [None, "", " ", "   ", "Hello, world!", "it's   <|endoftext|> 12½ naïve 中文字 العربية", "a" * 5000, "x \n\n\t y", "Hello, world!", "​\x85\x1c é 😀👍🏽", "word " * 3000]


def docs(spark):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(TEXTS)], DOCS)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_encoding(spark, block):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(tokens.vocabulary_path(name="byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    df = docs(spark)
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, block_chars=block).collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df), tokens.token_bytes(spark)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert tokens.encode_corpus(df.limit(1)).collect()[0].ids == []


def test_encoding_other_vocabulary(spark):
    df = docs(spark)
    name = "byte_bpe_multi_50k.tiktoken"
    back = tokens.decode_corpus(tokens.encode_corpus(df, vocabulary=name), tokens.token_bytes(spark, vocabulary=name))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("words", [True, False])
def test_encoding_without_an_id(spark, words):
    """A null doc_id stays null, and the ids beside it stay exact; also in a block without words."""
    rows = [(i, f"text {k}" if words else "") for k, i in enumerate((None, 2**53 + 1, 7, None))]
    encoded = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    back = [(r.doc_id, r.text) for r in tokens.decode_corpus(encoded, tokens.token_bytes(spark)).collect()]
    assert sorted(back, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rnd = random.Random(seed)
    sizes = [min(40_000, int(rnd.lognormvariate(5, 1))) for _ in range(4000)] + [0, 0, 2048, 2049, 4096, 9000]
    rows = [(i, s, 0, "x") for i, s in enumerate(sizes)] + [(9999, None, 0, "x"), (5, sizes[5], 0, "x")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, piece int, salt string")).toPandas()
    used = out.groupby("container").n_tokens.sum()
    assert used.max() <= 2048 and (out.n_tokens[out.n_pieces > 1] > 0).all()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {i: (s or 0) * (2 if i == 5 else 1) for i, s, *_ in rows}
    assert set(out.doc_id[out.n_pieces > 1]) == {i for i, s in enumerate(sizes) if s > 2048}
    least = -(-sum(s or 0 for _, s, *_ in rows) // 2048)
    assert len(used) <= least + 1 and used.index.max() == len(used) - 1


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(empty).count() == 0
    assert [tuple(r) for r in packing.pack(spark.createDataFrame([(1, None)], "doc_id long, n_tokens long")).collect()] == [(1, 0, 1, 0, 0)]
    same = packing.pack(spark.range(3000).selectExpr("id AS doc_id", "700L AS n_tokens")).toPandas()
    assert same.container.nunique() == 1500 and same.groupby("container").n_tokens.sum().max() == 1400


def test_fit_reaches_the_histogram():
    h = np.zeros(11, dtype=np.int64)
    h[[3, 4, 7]] = 20, 10, 10
    columns = packing.patterns(h, 10)
    x = packing.fit(h, columns)
    assert all(sum(k * m for k, m in c.items()) == 10 for c in columns) and (x >= 0).all()
    # ten of 7+3, five of 4+3+3; five 4s are left, two a container: no packing needs fewer
    assert packing.plan(h, 10).n_containers == 18


def test_patterns_pack_most():
    """Of short pieces with many lengths, nine in ten containers come from fitted patterns, and no more are needed than by best fit alone."""
    rnd = np.random.default_rng(3)
    h = np.bincount(np.minimum(2048, rnd.lognormal(4.8, 0.9, 20_000).astype(int)), minlength=2049)
    h[0] = 0
    planned = packing.plan(h, 2048)
    used = Counter()
    for kind, n in planned.kinds:
        assert sum(k * m for k, m in kind.items()) <= 2048
        used.update({k: m * n for k, m in kind.items()})
    assert used == {k: n for k, n in enumerate(h.tolist()) if n}
    assert planned.n_fitted >= 0.9 * planned.n_containers and planned.n_containers <= sum(n for _, n in packing.best_fit(h, 2048)) + 1


def brute_spans(texts, length):
    seen = {}
    for d, t in texts:
        for i in range(len(t or "") - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d, t in set(texts):
        mark = [False] * len(t or "")
        for i in range(len(t or "") - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                mark[i : i + length] = [True] * length
        i = 0
        while i < len(mark):
            j = i
            while j < len(mark) and mark[j]:
                j += 1
            if j > i:
                out.add((d, i, j))
            i = j + 1
    return out


SPANS = "doc_id long, text string, doc long, at long, h1 long"


@pytest.mark.parametrize(("seed", "way"), [(0, {}), (1, {}), (2, {"sent": 0}), (3, {"hot": 0}), (4, {"sent": 0, "hot": 3})])
def test_spans(spark, seed, way):
    """Also where the sketch may not be sent (sent), and where anchors are grouped by window (hot)."""
    rnd = random.Random(seed)
    parts = ["".join(rnd.choices("abé中😀 ", k=rnd.randrange(5, 40))) for _ in range(12)]
    texts = [(i, "".join(rnd.choices(parts, k=rnd.randrange(0, 8)))) for i in range(60)]
    texts[3] = (3, "".join(parts[:4]))  # long enough to have windows
    texts += [(100, None), (101, ""), (102, "=" * 300), (103, "=" * 25), (104, "=" * 19), (105, texts[3][1]), (106, texts[3][1]), texts[4], texts[4], (107, "z" * 50)]
    texts += [(108, "xyz" * 40), (109, "q" + "yzx" * 9), (110, "".join(parts[:4]) * 3), (111, "w" * 30 + parts[0] + "w" * 30)]
    df = spark.createDataFrame([(*t, 0, 0, 0) for t in texts], SPANS)
    got = [tuple(r) for r in spans.shared_spans(df, length=20, **way).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, 20)
    assert spans.shared_spans(df.limit(0), **way).count() == 0
    share = {r.doc_id: r.share for r in spans.shared_share(df.dropDuplicates(["doc_id"]), spans.shared_spans(df, length=20, **way)).collect()}
    assert share[100] == share[101] == share[107] == 0 and share[103] == share[105] == 1


@pytest.mark.parametrize("length", [1, 2, 3, 7])
def test_spans_of_any_length(spark, length):
    rnd = random.Random(length)
    texts = [(i, "".join(rnd.choices("abcdefghijkl", k=rnd.randrange(0, 15)))) for i in range(40)]
    got = [tuple(r) for r in spans.shared_spans(spark.createDataFrame(texts, "doc_id long, text string"), length=length).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, length)


def test_spans_in_pieces(monkeypatch):
    """Texts longer than a portion are cut without losing a window; equal windows have the same anchor, at the same place within."""
    monkeypatch.setattr(spans, "_CHARS", 50)
    import pyarrow as pa

    rnd = random.Random(7)
    texts = ["".join(rnd.choices("ab", k=n)) for n in (10, 49, 50, 51, 500, 69)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array([False] * 6)], ["doc", "text", "copied"])
    hashed, anchors, got = spans._Windows(10), spans._Anchors(10), {}
    for portion in spans._pieces(iter([batch]), 10):
        chars, sizes, docs, bases, _ = portion
        first, second = hashed.of(chars)
        begins = np.cumsum(sizes) - sizes
        places, _ = anchors.of(chars)
        for anchor, piece, begin, n in zip(*(x.tolist() for x in anchors.stretches(portion)), strict=True):
            for i in range(begin, begin + n):
                key = (int(docs[piece]), int(bases[piece] + i - begins[piece]))
                assert key not in got
                got[key] = int(first[i]), int(second[i]), anchor, int(places[i]) - i
    assert set(got) == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 9)}
    by = {}
    for (i, p), h in got.items():
        by.setdefault(h, set()).add(texts[i][p : p + 10])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({texts[i][p : p + 10] for i, p in got})


def test_prefilter_passes_as_few_when_texts_grow():
    """Anchors that don't repeat are ruled out at any number of them: the sketch grows with the corpus."""
    rnd = np.random.default_rng(5)
    rates = []
    for n in (40_000, 640_000):
        width = 1 << max(18, (spans.COUNTERS * 4 * n * 25 // 100).bit_length())
        anchors = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        hit = np.ones(len(anchors), bool)
        for cells in spans._cells(anchors, width):
            hit &= np.bincount(cells, minlength=width)[cells] > 1
        rates.append(hit.mean())
    assert max(rates) < 0.02
