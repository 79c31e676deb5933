"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from slatewise.llm import components, decontaminate, exact_dedup, language, mixing, near_dedup, quality, storage, substring_dedup, suffix_dedup, url_lists, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, chunk string, row_no int, score string, kept int, record string"


def texts(seed=3, n=60):
    """Random texts with copies, near copies and shared passages, and the awkward ones."""
    rng = random.Random(seed)
    vocab = ["the", "Of", "é1", "ñb", "to", "AND", "x-y", "zz", "日本", "q"] + [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    base = [rng.choice(vocab) for _ in range(80)]
    out = [None, "", "   ", "one", "one", "Two words", "two WORDS", "!!!\t\n", "a" * 3000, " ".join(["go"] * 400)]
    while len(out) < n:
        kind = rng.randrange(5)
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        if kind == 0:
            out.append(rng.choice(out[3:]))
        elif kind == 1:
            near = list(base)
            for _ in range(rng.randrange(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            out.append(" ".join(near))
        elif kind == 2:
            out.append(" ".join(words[:10]) + "\n" + passage + " " + " ".join(words[10:]))
        else:
            out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts()))
    return [*found, (None, found[5][1]), (None, "null id text " * 30), found[12], found[12], (2_000_000_000_000, found[20][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "c", 1, "x", 2, "r") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def bag(rows):
    return sorted(rows, key=repr)


def test_substring_dedup(docs, rows, nothing):
    for width in (5, 20):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, width=width, per_bucket=50).collect()]
        assert bag(got) == bag(brute.substring_dedup(rows, width))
    one = substring_dedup.substring_dedup(docs, width=20, with_text=True).where("n_removed > 0").first()
    assert hashlib.sha256(one.kept.encode()).hexdigest() == one.kept_sha256 and all(s.b - s.a >= 20 for s in one.spans)
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_suffix_dedup(docs, rows, nothing):
    for length in (20, 60):
        got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, length=length, per_bucket=200).collect()]
        assert bag(got) == bag(brute.suffix_dedup(rows, length))
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_repeats_by_columns_random():
    rng = np.random.default_rng(5)
    for _ in range(200):
        length, m = int(rng.integers(2, 9)), int(rng.integers(1, 25))
        k = length // 2
        width, starts = 2 * length - k, length - k + 1
        x = rng.integers(0, 2, (m, width)).astype(np.uint8)
        lo, hi = rng.integers(0, length - k + 1, m), rng.integers(length, width + 1, m)
        h = rng.integers(0, 3, m).astype(np.uint64)
        got = suffix_dedup.repeats_by_columns(h, lambda j: x[:, j], lo, hi, np.ones(m, np.int64), length)
        for j in range(starts):
            fits = [r for r in range(m) if lo[r] <= j and j + length <= hi[r]]
            for r in range(m):
                want = r in fits and any(q != r and h[q] == h[r] and (x[q, j : j + length] == x[r, j : j + length]).all() for q in fits)
                assert got[r, j] == want


def test_long_text_pieces(monkeypatch):
    from slatewise.llm import hashing

    text = (" ".join(texts(9)[10:30]) + "x" * 300 + " end").encode()
    whole = hashing.word_hashes(text, lower=True)
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert (hashing.word_hashes(text, lower=True) == whole).all() and len(whole) == len(text.split())


def test_automaton_random():
    rng = random.Random(1)
    for _ in range(400):
        vocab, window = [b"a", b"b", b"c"], rng.choice([2, 3, 4])
        items = [[rng.choice(vocab) for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(0, 5))]
        doc = [rng.choice([*vocab, b"z"]) for _ in range(rng.randint(0, 25))]
        spans, owners, longest = decontaminate.SuffixAutomaton(items, window).match(doc)
        as_text = lambda w: b" ".join(w).decode()
        (_, _, n_hit, want), = brute.contamination([(0, as_text(doc))], [(k, as_text(i)) for k, i in enumerate(items)], window)
        assert (sum(b - a for a, b in spans), sorted(map(str, owners))) == (n_hit, want)


def test_decontaminate(spark, docs, rows, nothing):
    bench = [("a", rows[20][1]), ("b", rows[15][1]), ("c", "two words"), (None, "é1 the"), ("e", None), ("f", "!!"), ("a2", rows[20][1])]
    items = spark.createDataFrame(bench, "item_id string, text string")
    want = bag(brute.contamination(rows, bench, 6))
    for block in (10**6, 8):  # one automaton, or one per item
        got = [(r.id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontaminate.matches(docs, items, window=6, block_words=block).collect()]
        assert bag(got) == want
    assert decontaminate.matches(nothing, items).count() == 0
    assert {r.n_hit for r in decontaminate.matches(docs, items.limit(0)).collect()} == {0}
    clean = decontaminate.decontaminate(docs, items, window=6, max_coverage=0.5)
    assert clean.columns == docs.columns
    limit = {i for i, n, hit, _ in want if hit <= 0.5 * n}
    left = clean.collect()
    assert len(left) == sum(hit <= 0.5 * n for _, n, hit, _ in want) and {r.doc_id for r in left} == limit
    untouched = {i: t for (i, t), (_, _, hit, _) in zip(rows, brute.contamination(rows, bench, 6)) if not hit and i is not None}
    assert all(r.text == untouched[r.doc_id] for r in left if r.doc_id in untouched)


def test_cut_spans_keeps_the_rest():
    text = "Ab, cd. EF gh!".encode()
    assert decontaminate.cut_spans(text, [(1, 3)]) == b"Ab, gh!" and decontaminate.cut_spans(text, [(0, 4)]) == b""


def test_exact_dedup(docs, rows, nothing):
    norm = [brute.lower(t) for _, t in rows]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(docs, keep=keep).collect()
        want = []
        for (i, _), t in zip(rows, norm):
            ids = [j for (j, _), u in zip(rows, norm) if u == t]
            want.append((i, pick([j for j in ids if j is not None], default=None), len(ids), brute.sha(t)))
        assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == bag(want)
        assert all(r.verified for r in got) and sum(r.kept for r in got) == len(set(norm))
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        left = exact_dedup.drop_copies(docs, keep=keep)
        assert left.columns == docs.columns and bag(brute.lower(r.text) for r in left.collect()) == sorted(set(norm), key=repr)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_merge_runs_many_rounds(spark):
    runs = spark.range(1000).select(
        (F.col("id") * 7919 % 1000).alias("id"), F.col("id").alias("row_no"), (F.col("id") % 37).cast("int").alias("run"),
        (F.col("id") * 7919 % 1000 % 11).cast("string").alias("digest"), F.lit(1).cast("long").alias("check"), F.lit(3).alias("bytes"))
    got = {r.digest: (r.keep_id, r.group_size) for r in exact_dedup.merge_runs(runs, fan_in=2).collect()}
    assert got == {str(k): (k, len(range(k, 1000, 11))) for k in range(11)}


def test_near_dedup(docs, rows, nothing):
    for width, percent in ((3, 85), (5, 80), (2, 60)):
        want, sizes = brute.near_components(rows, width, percent)
        want = [(i, n, (c if n else i)) for (i, _), n, c in zip(rows, sizes, want)]
        for block in (1024, 4):
            got = near_dedup.near_dedup(docs, width=width, percent=percent, block=block).collect()
            assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(want)
            assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dedup.drop_near_copies(docs, width=3, percent=85)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    want, sizes = brute.near_components(rows, 3, 85)
    empty = len({(i, t) for (i, t), n in zip(rows, sizes) if not n})
    assert len(ids) == empty + len({(c if c is not None else f"none {k}") for k, (c, n) in enumerate(zip(want, sizes)) if n})
    assert near_dedup.near_dedup(nothing).count() == 0


def test_open_buckets_find_links_the_lead_misses(spark):
    """A chain a-b-c in which the smallest row is not linked with c."""
    base = [f"w{k}" for k in range(100)]
    b = base[:96] + [f"x{k}" for k in range(4)]
    c = b[:92] + [f"y{k}" for k in range(4)] + b[96:]
    chain = [(k, " ".join(w)) for k, w in enumerate((base, c, b))]
    df = spark.createDataFrame(chain, "doc_id long, text string").coalesce(1)
    want, _ = brute.near_components(chain, 1, 90)
    assert want == [0, 0, 0]
    assert {r.component_id for r in near_dedup.near_dedup(df, width=1, percent=90).collect()} == {0}


def test_components_of_a_path(spark):
    order = list(range(40))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (100, 101), (101, 101)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(40)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_mixing(spark, nothing):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 400)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for k in range(300)]
    rows += [(301, None, "e"), (302, "", "e"), (5, rows[5][1], rows[5][2]), (None, "q r", "a")]
    df = spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, shard int, id string")
    got = mixing.mix_rows(df, block_tokens=4, shard_tokens=5000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = brute.capped_targets(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 4 * 10 for s in sizes), (taken, want)
    again = mixing.mix_rows(df.repartition(7), block_tokens=4, shard_tokens=5000).collect()
    assert bag(map(tuple, again)) == bag(map(tuple, got))
    assert mixing.mix_rows(nothing).count() == 0


def test_mixing_small_sources(spark):
    """Sources far below, at and just above a block of the production size get their targets, in one shard or several."""
    rng = random.Random(12)
    sizes = {f"s{n:03}": n for n in (1, 2, 3, 7, 12, 15, 16, 40, 63, 64, 65, 70, 128, 130, 200, 317, 500, 520)} | {"big": 20_000, None: 9}
    rows = []
    for s, n in sizes.items():
        while n:
            size = min(n, rng.randrange(1, 60))
            rows.append((len(rows), " ".join(["w"] * size), s))
            n -= size
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = sorted(s for s in sizes if s is not None) + [None]
    for weights, share, shard in (((5, 2, 1), 1.5, 1_000_000), ((1,), 0.02, 1_000_000), ((5, 2, 1), 1.5, 100)):
        want = brute.capped_targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, share, 2)
        taken = dict.fromkeys(sizes, 0)
        for r in mixing.mix_rows(df, share=share, weights=weights, shard_tokens=shard).collect():
            assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes), {s: (taken[s], want[s]) for s in sizes}


def test_sainte_lague(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 50, 333):
        votes = {f"p{k}": rng.choice([0, 1, 5, 100, rng.randrange(1, 1000)]) for k in range(9)}
        votes["p0"] = 10
        df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "source string, votes long, seats long")
        got = {r.source: r.quota for r in mixing.sainte_lague(df, "votes", "seats", ["source"], []).collect()}
        assert got == brute.sainte_lague(votes, seats)


def test_language(spark, nothing):
    en, fr, ru = "the cat and the dog were in the house with that thing", "le chat est dans la maison avec les enfants et une voiture", "это большой дом и там живут люди вместе с собакой"
    learn = spark.createDataFrame([(t, lang) for lang, t in (("en", en), ("fr", fr), ("ru", ru)) for _ in range(5)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language.learn(learn)
    assert model.languages == ["en", "fr", "ru"]
    asked = ["The house and the dog", "La maison et le chat", "дом и люди", None, "", "123 !!", en + " " + fr, "the " * 30_000, "La maison et le chat", "Ωμέγα"]
    df = spark.createDataFrame([(k, t, "zz", "9") for k, t in enumerate(asked)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.label(df, model, with_spans=True).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["en", "fr", "ru", "und", "und", "und"]
    assert [s.lang for s in got[6].spans] == ["en", "fr"] and got[6].spans[0].b == len(en.split()) and 0.4 < got[6].score < 0.7
    assert got[7].lang_pred == "en" and got[7].score == 1.0 and got[8].lang_pred == "fr" and got[9].lang_pred in model.languages
    assert language.label(nothing, model).count() == 0
    assert language.label(df, language.learn(learn.limit(0))).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_best_paths_against_brute_force():
    rng = np.random.default_rng(3)
    import itertools

    for _ in range(30):
        scores = rng.normal(size=(6, 3)).astype(np.float32) * 3
        texts_ = [rng.integers(0, 6, n) for n in rng.integers(0, 6, 4)]
        for ids, path in zip(texts_, language.best_paths(scores, texts_, 1.5)):
            value = lambda p: sum(scores[i, s] for i, s in zip(ids, p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
            best = max(map(value, itertools.product(range(3), repeat=len(ids))))
            assert len(path) == len(ids) and abs(value(tuple(path)) - best) < 1e-3


def test_quality(spark, nothing):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(50)]
    good = lambda: " ".join(rng.choice(words) for _ in range(30)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(30))
    rows = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(300)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (0, rows[0][1], "x"), (None, "odd", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 5] + [(7, None), (9999, 1), (None, 1)], "doc_id long, quality int")
    model = quality.learn(docs.where("doc_id % 5 <> 0"), labels, sample=80, calibrate=40)
    got = {}
    for r in quality.score(docs, model).collect():
        assert 0 <= r.score <= 1 and got.setdefault(r.doc_id, r.score) == r.score
    held = [(got[k], y) for k, _, y in rows if k % 5 == 0]
    assert all((s >= 0.3) == bool(y) for s, y in held) and got[900] == got[901]
    shuffled = spark.createDataFrame([(k, rng.randrange(2)) for k, _, y in rows if k % 5], "doc_id long, quality int")
    worse = quality.learn(docs.where("doc_id % 5 <> 0"), shuffled, sample=80, calibrate=40)
    spread = {r.doc_id: r.score for r in quality.score(docs, worse).collect()}
    assert np.mean([spread[k] for k, _, y in rows if k % 5 == 0 and y]) - np.mean([spread[k] for k, _, y in rows if k % 5 == 0 and not y]) < 0.5
    assert quality.score(nothing, model).count() == 0
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    x = [(np.array([0, 1, 2]), rng.normal(size=3) + (2 if k % 2 else -2)) for k in range(100)]
    y = np.array([1 if k % 2 else -1 for k in range(100)])
    w, b = quality.dual_coordinate_descent(x, y, np.ones(100), 3)
    assert np.mean([np.sign(w[a] @ v + b) == s for (a, v), s in zip(x, y)]) > 0.95


def test_warc(spark, nothing):
    big = "é" * 3000
    pages = [(3, "http://a/", "same"), (1, "http://b/ü\r\nX: y", "same"), (2, None, "other"), (5, "u", None), (4, "u", ""), (6, "u", big), (7, "u", big), (None, "u", "same"), (2, None, "other")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, record string, last int").repartition(4)
    for least, chunk in ((0, 1 << 20), (5, 7)):
        got = warc.round_trip(df, min_bytes=least, chunk_bytes=chunk).collect()
        raw = [((h or "").encode(), i) for i, _, h in pages]
        want = []
        for group in {r for r, _ in raw}:
            ids = sorted([i for r, i in raw if r == group], key=lambda i: (i is None, i or 0))
            for n, i in enumerate(ids):
                again = n > 0 and len(group) >= least
                want.append((i, "revisit" if again else "response", ids[0] if again else None, len(group), brute.base32_sha1(group)))
        assert bag((r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == bag(want)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0
    chunks = warc.chunk_records(df.where("page_id = 6").select(F.lit(1).cast("long"), "page_id", "url", F.col("html").cast("binary")), 1000).orderBy("chunk_no").collect()
    assert [len(c.data) for c in chunks] == [1000] * 6 and chunks[-1].last
    assert [c.sha1_so_far for c in chunks] == [hashlib.sha1(big.encode()[: 1000 * (k + 1)]).digest() for k in range(6)]


def test_url_lists(spark):
    events = [("l", "block", "ex.com", 10, 0, "add"), ("l", "block", "ex.com", 20, 0, "remove"), ("l", "block", "ex.com", 30, 0, "add"), ("l", "block", "ex.com", 30, 1, "remove"),
              ("t", "allow", "a.ex.com/x", 5, 0, "add"), ("t", "allow", "ex.com", 12, 0, "add"), ("l", "block", None, 1, 0, "add"), ("l", "block", "b.org", None, 0, "add"), ("l", "block", "c.org", 1, 0, "add")]
    ev = spark.createDataFrame(events, "list string, kind string, pattern string, at long, event_no int, action string")
    asks = [("http://A.ex.com/x/y?q", 10), ("http://ex.com/", 9), ("http://ex.com/", 10), ("http://ex.com/", 19), ("http://ex.com/", 20), ("http://ex.com", 31), ("http://ex.com:80/x", 11),
            (None, 15), ("nonsense", 15), ("http://c.org/", None), ("http://c.org/a//b", 10**6), ("http://c.org/a//b", 10**6), ("http://d.c.org/", 2)]
    cap = spark.createDataFrame([(k, u, t, "own", 5) for k, (u, t) in enumerate(asks)], "page_id long, url string, fetched_at long, rule string, pattern int")
    for bucket in (100, 10**5):
        got = {r.page_id: (r.n_active, r.rule, r.blocked) for r in url_lists.temporal_filter(cap, ev, bucket_seconds=bucket).collect()}
        assert got == {0: (2, "a.ex.com/x", False), 1: (0, None, False), 2: (1, "ex.com", True), 3: (2, "ex.com", False), 4: (1, "ex.com", False), 5: (1, "ex.com", False), 6: (1, "ex.com", True),
                       7: (0, None, False), 8: (0, None, False), 9: (0, None, False), 10: (1, "c.org", True), 11: (1, "c.org", True), 12: (1, "c.org", True)}
    assert url_lists.temporal_filter(cap.limit(0), ev).count() == 0
    assert {r.n_active for r in url_lists.temporal_filter(cap, ev.limit(0)).collect()} == {0}


def test_shared_dir_is_the_session_setting():
    conf = SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "file:///somewhere/shared/"}.get(key, default))
    assert storage.shared_dir(SimpleNamespace(sparkContext=None, conf=conf)) == "file:///somewhere/shared"
    unset = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(getConf=lambda: unset, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(sparkContext=sc, conf=unset))
