"""Exact operators against plain Python on the awkward table: join, spans, top-k, token files, shards, mix."""

import zlib
from collections import Counter

import helpers as h
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, jaccard, mixing, pii, sharding, tokenfile, topk, wordhash


def test_word_hashes_agree_with_regex():
    import pyarrow as pa

    texts = [t or "" for t in h.TEXTS]
    sets, known = [], {}
    for _, _, data, offsets in wordhash.chunks(pa.array(texts, pa.large_string()), 1000):
        found = wordhash.words(data, offsets)
        sets += wordhash.shingle_sets(found)
        for a, b in zip(found.bounds[:-1], found.bounds[1:]):
            known.setdefault(len(known), found.hashes[a:b])
    for k, text in enumerate(texts):
        assert len(known[k]) == len(h.words(text))
        assert len(sets[k]) == len(h.shingles(text))
    by_word = {}
    for k, text in enumerate(texts):
        for word, value in zip(h.words(h.lower(text)), known[k].tolist()):
            assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_words_of_a_regular_structure_keep_apart():
    """A polynomial hash modulo 2**64 cannot tell these words apart."""
    import pyarrow as pa

    bits = [bin(k).count("1") % 2 for k in range(1024)]
    words = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "a" * 1024, "a" * 1023, "a" * 8 + "b" * 8, "b" * 8 + "a" * 8]
    data, offsets = wordhash.text_bytes(pa.array([" ".join(words)], pa.large_string()))
    assert len(set(wordhash.words(data, offsets).hashes.tolist())) == len(words)
    encoder = tokenfile.encoder_of(public_tokenizers.path("word_bpe_49k.json"))
    data, offsets = wordhash.text_bytes(pa.array(words, pa.large_string()))
    ids, bounds = encoder.encode(data, offsets, 1)
    for k, word in enumerate(words):
        assert ids[bounds[k] : bounds[k + 1] - 1].tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_pieces_have_the_ids_of_whole_texts(seed):
    import random

    import pyarrow as pa

    rng = random.Random(seed)
    parts = ["it", "IT", "'s", "'S", "'ll", "'", "''", "12", "3", ",", "...", "é", "É", "e\u0301", "\u0338", "<", "<|endoftext|>", "<|END", "ß", "日本",
             "²", "½", " ", "\t", "\n", "\u00a0", "\u2028", "-", "_", "don't", "\U0001f600", "K", "\x1c", "a" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    encoder = tokenfile.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.by_pieces
    data, offsets = wordhash.text_bytes(pa.array(texts, pa.large_string()))
    ids, bounds = encoder.encode(data, offsets, 1)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1] - 1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_join_is_exact(spark):
    got = [tuple(r) for r in jaccard.join(h.table(spark)).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert Counter(got) == Counter(h.join_by_hand(h.rows()))
    assert jaccard.join(h.empty(spark)).count() == 0


def test_join_across_cells(spark, monkeypatch):
    """Groups larger than a cell: every link is counted once, whatever the tiling."""
    monkeypatch.setattr(jaccard, "CELL", 7)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 1)
    base = h.prose(11, 100).split()
    data = []
    for k in range(60):
        own = list(base[: 100 - k % 9])
        own[k % 90] = f"edit{k}"
        data.append((k, " ".join(own)))
    data += [(100 + k, h.prose(50 + k, 40)) for k in range(20)]
    got = [tuple(r) for r in jaccard.join(spark.createDataFrame(data, "doc_id long, text string"))
           .select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert Counter(got) == Counter(h.join_by_hand(data))


def test_one_of_each(spark):
    docs = h.table(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c, _ in h.join_by_hand(h.rows()) if i is not None and i == c}
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(want)
    assert kept.filter("doc_id is null").count() == 2


def test_one_of_each_decides_by_row(spark):
    """Copies without an id go, a clean text under a repeated id stays, of alike rows one stays."""
    a, b, near = h.prose(31, 60), h.prose(32, 60), " ".join(h.prose(31, 60).split()[:59])
    rows = [(1, a, "x"), (None, a, "x"), (None, near, "y"), (None, a, None), (7, b, "x"), (7, b, "x"), (7, h.prose(33, 60), "x"), (9, near, None),
            (None, h.prose(34, 40), None), (None, h.prose(34, 40), None), (11, None, None), (11, None, None), (None, " ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = Counter(tuple(r) for r in jaccard.one_of_each(docs).collect())
    assert kept == Counter([(1, a, "x"), (7, b, "x"), (7, h.prose(33, 60), "x"), (None, h.prose(34, 40), None),
                            (11, None, None), (11, None, None), (None, " ", "z")])


def test_components_need_not_all_pairs():
    """Without links to count, connected members are not compared again; the parts are the same."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**62, 400).astype(np.uint64)
    sets = [np.sort(np.where(rng.random(400) < 0.03, rng.integers(1, 2**62, 400).astype(np.uint64), base)) for _ in range(60)]
    sets += [np.sort(rng.integers(1, 2**62, 380).astype(np.uint64)) for _ in range(20)]
    n, cls, cell = np.array([len(s) for s in sets]), np.arange(len(sets)), np.zeros(len(sets), int)
    maps, copies = [jaccard.bitmap(s) for s in sets], np.ones(len(sets), int)
    full, links = jaccard.compare(cls, n, cell, maps, copies, sets)
    short, _ = jaccard.compare(cls, n, cell, maps, copies, sets, count=False)
    assert full.tolist() == short.tolist() and links.sum() > 0


def test_join_of_long_texts_in_cells_of_few_elements(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_ELEMENTS", 300)
    base = h.prose(41, 100).split()
    data = [(k, " ".join([*base[: 100 - k % 5], f"end{k}"])) for k in range(12)]
    got = [tuple(r) for r in jaccard.join(spark.createDataFrame(data, "doc_id long, text string"))
           .select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert Counter(got) == Counter(h.join_by_hand(data))


def test_top_k_of_repeated_ids(spark):
    """Every row is a candidate, every row with a query's id is a query; as the SQL twin has it."""
    rows = [(20, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [3.0, 1.0]), (2, [1.0, 1.0]), (20, [-1.0, 4.0]), (40, [0.0, 1.0]), (None, [9.0, 9.0]), (3, None), (4, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q in (20, 40):
        scores = [(-int(sum(np.floor(64 * a) * np.floor(64 * b) for a, b in zip(v, w))), i)
                  for j, v in rows if j == q for i, w in rows if i is not None and i != q and w and None not in w]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:20])]
    got = [tuple(r) for r in topk.search(table).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(edges, "test").collect()}
    assert got == {**{k: 0 for k in range(201)}, 400: 400, 500: 400}


def test_base_spans_are_exact(spark):
    data = [(k, t) for k, t in enumerate([*(t for t in h.TEXTS if t is None or len(t) < 50_000), "1" * 3000, "1 " * 3000,
            "+1" + "-" * 3000, "1.2.3.4.5.6.7.8 00001.2.3.4", "a@b@c.d.e@f.g", "4111-1111-1111-1112", "%@-._@a.b"])]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for k, text in data:
        base = h.base_spans(text)
        count = Counter(kind for kind, _, _ in base)
        assert [got[k][f"n_{kind}"] for kind in h.PII] == [count[kind] for kind in h.PII], text
        assert got[k]["base_sha256"] == h.sha(h.written(base)), text
        spans = got[k]["spans"].split(",") if got[k]["spans"] else []
        assert set(h.written(base).split(",")) - {""} <= set(spans)


def test_added_spans_do_not_overlap_base_spans(spark):
    rows = pii.redactions(h.table(spark).limit(0).unionByName(h.table(spark))).collect()
    for r in rows:
        base = {tuple(s) for s in r["base"]}
        for s in r["spans"]:
            assert tuple(s) in base or all(s["end"] <= b[1] or b[2] <= s["start"] for b in base)
    assert pii.digest(h.empty(spark)).count() == 0


def test_boosting_separates_and_thresholds_hold():
    rows = [([0, k % 5, k % 3], float(k % 5 > 2) * 40, 40.0) for k in range(15)]
    trees = pii.boost(rows)
    margins = [(sum(pii.value(t, x) for t in trees), y) for x, y, _ in rows]
    assert min(m for m, y in margins if y) > max(m for m, y in margins if not y)
    limit = pii.thresholds(rows, trees)[0]
    assert all((m >= limit) == bool(y) for m, y in margins)
    assert pii.boost([]) == []


def test_redaction_masks_and_keeps_columns(spark):
    docs = h.table(spark)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = out.filter(F.col("text").contains("mail ")).first()["text"]
    assert text.startswith("mail [email][email] or [ip] and") and "[card]" in text and "4111" not in text


def test_topk_is_exact(spark):
    rng = np.random.default_rng(5)
    data = [(k, [float(x) for x in rng.normal(size=24)]) for k in range(0, 200)]
    data += [(300 + k, data[k][1]) for k in range(40)]
    data += [(1000, None), (1020, [float("nan")] * 24), (1040, [float("inf")] + [0.0] * 23), (1060, [None] + [1.0] * 23), (None, [1.0] * 24)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<float>, score int, id string")
    vectors = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in data
               if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    want = []
    for q in vectors:
        if q % 20 == 0:
            best = sorted((-int(vectors[q] @ x), i) for i, x in vectors.items() if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = [tuple(r) for r in topk.search(frame).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)
    few = topk.search(frame.filter("vec_id in (0, 1, 20)")).collect()
    assert len(few) == 4
    assert topk.search(frame.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    data = [(k, [1e9 * (k + 1), -2e9, 3.0]) for k in range(30)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.search(frame.withColumn("embedding", F.transform("embedding", lambda c: c / 1e4)))
    y = {k: [int(np.floor(64 * (c / 1e4))) for c in v] for k, v in data}
    assert [r["score"] for r in got.filter("query_id = 0").orderBy("rank").collect()] == sorted(
        (sum(a * b for a, b in zip(y[0], y[k])) for k in range(1, 30)), reverse=True)[:20]


@pytest.fixture(scope="module")
def tokenizer_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_token_files_round_trip(spark, tokenizer_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    index = tokenfile.write(h.table(spark), tokenizer_path, length=64)
    data = sorted(((r[0], r[1]) for r in h.rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, text in data:
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in tokenfile.read(index).collect()), key=lambda r: r[1]) == want
    path = index.first()["file"]
    file = tokenfile.SequenceFile(path)
    total = index.filter(F.col("file") == path).agg(F.sum("n_tokens")).first()[0]
    ids, mask = zip(*(file.sequence(k) for k in range(-(-total // 64))))
    assert all(len(x) == 64 for x in ids) and np.concatenate(mask).sum() == total
    assert (np.concatenate(ids)[np.concatenate(mask)] == file.tokens(0, total)).all()
    assert tokenfile.read(tokenfile.write(h.empty(spark), tokenizer_path)).count() == 0


def test_word_encoder_survives_a_full_cache(tokenizer_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHED_PIECES", 10)
    encoder = tokenfile.WordEncoder(tokenizer_path)
    import pyarrow as pa

    for _ in range(2):
        for text in h.TEXTS[:4] + h.TEXTS[12:13]:
            data, offsets = wordhash.text_bytes(pa.array([text], pa.large_string()))
            ids, _ = encoder.encode(data, offsets, 1)
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_shards_are_even_whole_and_numbered(spark):
    data = [(k, h.prose(k, 5 + k % 90)) for k in range(1500)] + [(5000 + k, h.BASE) for k in range(800)] + [(None, None), (7, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, shard int, size int")
    rows = sharding.assign(docs).collect()
    size = Counter()
    slots = {}
    for r in rows:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    mean, largest = sum(size.values()) / 16, max(len((t or "").encode()) + 1 for _, t in data)
    assert max(size.values()) - mean <= 0.02 * mean + largest and mean - min(size.values()) <= 0.02 * mean + largest
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    again = {tuple(r) for r in sharding.assign(docs.repartition(7)).collect()}
    assert {(r["doc_id"], r["shard"]) for r in rows} == {(r[0], r[4]) for r in again}
    assert sharding.assign(h.empty(spark)).count() == 0


def test_shards_are_ranges_of_one_order(spark):
    """Bounds against a plain sort: shards are consecutive runs of the rows by key, cut within the tolerance of equal bytes."""
    data = [(k, h.prose(k % 400, 5 + k % 60)) for k in range(900)] + [(2000 + k, h.BASE) for k in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = sharding.keys(docs)
    order = sorted((r["kt"], r["kd"], r["size"]) for r in rows.collect())
    total = sum(size for *_, size in order)
    for parts in (3, 16):
        bounds = sharding.splitters(rows, parts, 0.01)
        assert bounds == sorted(bounds) and len(bounds) == parts - 1
        for k, bound in enumerate(bounds, 1):
            below = sum(size for kt, kd, size in order if (kt, kd) < tuple(bound))
            slack = max(0.01 * total / parts, max(size for *_, size in order))
            assert abs(below - total * k / parts) <= slack
    by_id = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(docs).collect()}
    key = {r["doc_id"]: (r["kt"], r["kd"]) for r in rows.collect()}
    assert sorted(by_id, key=by_id.get) == sorted(key, key=key.get)


def test_mix_takes_the_first_by_pareto_order(spark):
    """Beside the certain copies, each source takes the documents of the smallest odds ratio, and no other."""
    data = [(k, h.prose(k, 5 + k % 20), "abc"[k % 3]) for k in range(1500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = mixing.decided(docs).select("row.doc_id", "row.source", "mix.size", "mix.copies", "mix.target").collect()
    shares = {r["source"]: r for r in mixing.plan(docs).filter("level = 0").collect()}
    draws = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform("doc_id", seed=mixing.SEED).alias("u")).collect()}
    for source, plan in shares.items():
        own, p = [r for r in rows if r["source"] == source], plan["fraction"]
        assert {r["copies"] for r in own} <= {plan["certain"], plan["certain"] + 1}
        if not 0 < p < 1:
            continue
        ratio = lambda r: (draws[r["doc_id"]] / (1 - draws[r["doc_id"]])) / (p / (1 - p))
        ranked = sorted(own, key=ratio)
        extra = [r["copies"] - plan["certain"] for r in ranked]
        assert extra == sorted(extra, reverse=True)  # a first run of the order
        rest = plan["target"] - plan["certain"] * sum(r["size"] for r in own)
        taken = sum(r["size"] for r, e in zip(ranked, extra) if e)
        assert abs(taken - rest) <= max(r["size"] for r in own)


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    fixed, left = {}, dict(sizes)
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > 3 * sizes[s]] if total else []
        if not over:
            return {**fixed, **{s: rest * weight[s] / total for s in left}}
        for s in over:
            fixed[s] = 3.0 * left.pop(s)


def test_mix_meets_its_targets(spark):
    data = [(k, h.prose(k, 10 + k % 40), ["a", "b", "c", None, ""][k % 5] if k % 7 else "hot") for k in range(3000)]
    data += [(4000 + k, h.prose(k, 9), "tiny") for k in range(3)] + [(None, None, "a"), (5000, "", "void"), (5001, h.prose(1, 9000), "hot")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in data], "doc_id long, text string, source string, size int, level int, taken int")
    rows = mixing.summary(docs).collect()
    assert len(rows) == len(data)
    sizes, taken, target = Counter(), Counter(), {}
    by_id = {r["doc_id"]: r for r in rows}
    for i, text, source in data:
        r = by_id[i]
        assert r["size"] == len(h.words(text)) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    want = targets_by_hand(dict(sizes))
    for source in sizes:
        assert target[source] == pytest.approx(want[source], abs=1e-6)
        largest = max(len(h.words(t)) for _, t, s in data if s == source)
        assert abs(taken[source] - want[source]) <= max(largest / 2 + 1, 1), source
    assert {tuple(r) for r in mixing.summary(docs.repartition(5)).collect()} == {tuple(r) for r in rows}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.filter("source = 'tiny'").count() == taken["tiny"] // 9
    assert mixing.summary(h.empty(spark)).count() == 0 and mixing.mixed(h.table(spark)).columns == h.table(spark).columns


def test_decontamination_finds_planted_passages(spark):
    items = [(k, h.prose(900 + k, 12 + 5 * k)) for k in range(9)] + [(50, None), (51, ""), (52, h.prose(900, 12)), (53, "two words"), (None, "x y z")]
    docs = [(0, h.prose(1, 500) + " " + items[3][1].upper() + " " + h.prose(2, 500)), (1, h.prose(3, 700)), (2, items[0][1]),
            (3, " ".join(items[8][1].split()[:20])), (4, items[5][1].replace(" ", ", ")), (5, None), (6, ""), (0, items[4][1]),
            (None, items[2][1]), (7, "x two words y"), (8, h.prose(4, 60) + " " + items[8][1] + " " + h.prose(5, 3000) + " " + items[7][1])]
    bench = spark.createDataFrame([(*r, "e") for r in items], "item_id long, text string, extra string")
    frame = spark.createDataFrame([(*r, 1.0, 2) for r in docs], "doc_id long, text string, score double, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()}
    assert got == {(0, 3), (0, 4), (2, 0), (2, 52), (4, 5), (8, 8), (8, 7)}
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert decontaminate.matches(frame.limit(0), bench).count() == 0 and decontaminate.clean(frame, bench.limit(0)).count() == len(docs)


def test_retrieval_equals_full_scoring():
    """Block-max pruning never loses an item at or above the threshold."""
    import pyarrow as pa

    items = [(k, h.prose(k // 2, 30 + k), None, None) for k in range(40)]
    index = decontaminate.build(items)
    text = " ".join(h.prose(k, 25) for k in range(60))
    got = {(r[0], r[1]) for r in decontaminate.search(pa.array([text, items[7][1]], pa.large_string()), index, 0.3, 0.0)}
    want = set()
    for row, one in enumerate([text, items[7][1]]):
        w = decontaminate.hashes([one])[0]
        for start in range(0, max(1, -(-len(w) // index.longest) - 1) * index.longest, index.longest):
            window = set(w[start : start + 2 * index.longest].tolist())
            for k in range(len(items)):
                score = 0.0
                for t, term in enumerate(index.terms.tolist()):
                    if term in window:
                        a, b = index.posting_bounds[t], index.posting_bounds[t + 1]
                        score += index.posting_impact[a:b][index.posting_item[a:b] == k].sum()
                if score >= 0.3 - 1e-9:
                    want.add((row, k))
    assert got == want


def scored_by_hand(items, texts, threshold):
    """(row, item) with a passage at or above the threshold: BM25 of whole items against whole windows, class by class."""
    words = [decontaminate.hashes([t])[0].tolist() for _, t, *_ in items]
    long = [w for w in words if len(w) >= 5]
    df, mean = Counter(x for w in long for x in set(w)), np.mean([len(w) for w in long])

    def impacts(w):
        raw = {}
        for x, c in Counter(w).items():
            idf = np.log1p((len(long) - df[x] + 0.5) / (df[x] + 0.5))
            raw[x] = idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean))
        total = sum(raw.values())
        return {x: v / total for x, v in raw.items()}

    out = set()
    for kind in {decontaminate.length_class(len(w)) for w in words}:
        own = [k for k, w in enumerate(words) if decontaminate.length_class(len(w)) == kind]
        step, known = max(len(words[k]) for k in own), {k: impacts(words[k]) for k in own}
        for row, text in enumerate(texts):
            w = decontaminate.hashes([text])[0].tolist()
            for start in range(0, max(1, -(-len(w) // step) - 1) * step, step):
                window = set(w[start : start + 2 * step])
                out |= {(row, items[k][0]) for k in own if sum(v for x, v in known[k].items() if x in window) >= threshold - 1e-9}
    return out


@pytest.mark.parametrize("threshold", [0.25, 0.6])
def test_pivots_and_blocks_lose_nothing(monkeypatch, threshold):
    """Common words, several length classes, batches of few blocks: all that full scoring finds."""
    import random

    import pyarrow as pa

    rng = random.Random(7)
    monkeypatch.setattr(decontaminate, "CLASS", 12)
    common, rare = [f"the{k}" for k in range(12)], [f"rare{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.choice([6, 9, 12, 20, 60]))), None, None) for k in range(90)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.choice([3, 40, 300]))) for _ in range(30)]
    texts += [" ".join([texts[1], items[k][1], texts[2]]) for k in range(0, 90, 9)]
    indexes = decontaminate.classes(items)
    assert len(indexes) > 1
    ids = np.concatenate([x.item_ids for x in indexes])
    want = scored_by_hand(items, texts, threshold)
    for most in (decontaminate.OPENED, 3):
        monkeypatch.setattr(decontaminate, "OPENED", most)
        got = {(row, int(ids[item])) for row, item, *_ in decontaminate.search(pa.array(texts, pa.large_string()), indexes, threshold, 0.0)}
        assert got == want


def test_large_benchmark_in_little_memory():
    """50,000 items, one of them long: a task's arrays stay below 300 MB."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = np.array([f"w{k}" for k in range(30_000)])
    items = [(k, " ".join(words[(rng.zipf(1.3, 25) * 7919) % len(words)]), None, None) for k in range(50_000)]
    items.append((50_000, " ".join(words[rng.integers(0, len(words), 3_000)]), None, None))
    indexes = decontaminate.classes(items)
    text = " ".join([*words[(rng.zipf(1.3, 150_000) * 7919) % len(words)], items[123][1], *words[(rng.zipf(1.3, 50_000) * 7919) % len(words)]])
    tracemalloc.start()
    found = {(r[0], r[1]) for r in decontaminate.search(pa.array([text], pa.large_string()), indexes, 0.6, 0.8)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (0, 123) in found and peak < 300 << 20


def test_parts_do_not_change_scores(spark, monkeypatch):
    items = [(k, h.prose(k // 3, 20 + k)) for k in range(14)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, h.prose(k // 3, 30) + " " + items[k][1]) for k in range(14)], "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.matches(docs, bench, 0.4, 0.1).collect()))
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 5)
    got = sorted(map(tuple, decontaminate.matches(docs, bench, 0.4, 0.1).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in whole] and np.allclose([r[2:] for r in got], [r[2:] for r in whole])


def test_benchmark_in_parts_gives_the_same(spark, monkeypatch):
    items = [(k, h.prose(900 + k, 20)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, h.prose(k, 50) + " " + items[k][1]) for k in range(12)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 5)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == {(k, k) for k in range(12)}


def test_decontamination_folds_all_letters(spark):
    """Quotes in capitals and with decomposed accents are found; the A-Z rule lost them."""
    import unicodedata

    words = "été où garçon niño größe señal ächzen übung straße éclair ñandú être".split()
    item = " ".join(words[k % 12] + words[(k * 5 + 1) % 12] for k in range(20))
    docs = [(0, h.prose(1, 80) + " " + item.upper() + " " + h.prose(2, 80)), (1, unicodedata.normalize("NFD", item)),
            (2, h.prose(3, 200)), (3, item)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["question_overlap"] for r in decontaminate.matches(frame, bench).collect()}
    assert got == {0: 1.0, 1: 1.0, 3: 1.0}
    assert [r["doc_id"] for r in decontaminate.clean(frame, bench).collect()] == [2]


def test_decontamination_of_unspaced_and_short_items(spark):
    """Items without ASCII spaces and items of fewer than five words were left out of the index."""
    zh, ja = "请问下列哪一座城市是中华人民共和国的首都？答案是北京市。", "日本で一番高い山はどれですか。答えは富士山です。"
    th = "เมืองหลวงของประเทศไทยคือกรุงเทพมหานคร"
    items = [(0, zh), (1, ja), (2, th), (3, "What is pi?"), (4, "北京吗"), (5, "Größe"), (6, h.prose(900, 20))]
    docs = [(0, "前言：今天天气很好，我们一起去公园散步。" + zh + "后来大家都回家了。"), (1, h.prose(1, 30) + " " + ja), (2, "ก่อน" + th + "หลัง"),
            (3, h.prose(2, 30) + ".\n" + "what is PI?\n" + h.prose(3, 30)), (4, "他问：“北京吗？”然后走了。"), (5, "GRÖSSE"),
            (6, h.prose(4, 90) + " " + items[6][1]), (7, "今天天气很好，我们一起去公园散步。"), (8, "Now what is pi worth"), (9, h.prose(5, 50)), (10, "他去北京吗我不知道")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()}
    assert got == {(k, k) for k in range(7)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(frame, bench).collect()) == [7, 8, 9, 10]


def test_decontamination_of_short_questions(spark):
    """A question or text of fewer than five words beside a given answer."""
    items = [(0, h.prose(1, 30), "who is it", h.prose(1, 30).split()[-1]), (1, "name it", None, "zebra")]
    docs = [(0, "so who is it: " + items[0][1]), (1, "Name it! A zebra."), (2, "Name it! A horse.")]
    bench = spark.createDataFrame(items, "item_id long, text string, question string, answer string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()} == {(0, 0), (1, 1)}


def test_pii_thresholds_cover_all_patterns(spark, monkeypatch):
    """Kinds and patterns beyond the fit sample take part in the calibration."""
    monkeypatch.setattr(pii, "PATTERNS", 1)

    def added(data):
        rows = pii.redactions(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()
        return {data[r["doc_id"]] for r in rows if len(r["spans"]) > len(r["base"])}

    good, bad = "x 4111 1111 1111 1111 y", "x 4111 1111 1111 1112 y"
    assert added(["so a.b@c.example y"] * 40 + [good] * 20 + [bad]) == {bad}
    others = [f"{word} {sep}4111{gap}1111{gap}1111{gap}1112 y" for word in ("card", "host", "phone", "mail", "x")
              for sep in ("", ": ") for gap in ("-", "")]
    assert added([good] * 20 + others) == set()


def test_pii_adds_spelled_out_spans_and_no_prose(spark):
    """Forms that no base pattern matches are added on their own evidence; prose in their shape is not."""
    found = {"jane (at) mail (dot) example (dot) org": "write to %s. Thanks", "bob at example dot com": "so %s today",
             "al.b at mail.example.com": "contact %s. Then", "10[.]1[.]2[.]3": "host %s up", "4111.1111.1111.1111": "paid %s ok",
             "0049 301 234 5678": "tel %s end"}
    prose = ["from at and. Of the", "we look at this. It is", "they met at noon. We saw", "he sat at a dot on the map", "in 4111.1111.1111.1112 or"]
    plain = ["mail a.b1@c.example now", "x 97.51.17.173 y", "x 9807915762804490 y", "x +1 (826) 555-4081 y"]
    data = [around % span for span, around in found.items()] * 6 + prose * 40 + plain * 20
    for r in pii.redactions(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect():
        text, base = data[r["doc_id"]], r["base"]
        added = [text[s["start"]:s["end"]] for s in r["spans"] if s not in base]
        want = [span for span, around in found.items() if around % span == text]
        assert added == want, text
