"""Each operator against a plain version, on odd rows, and on an empty table."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute as B
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

from newsevidence.llm import decontaminate, jaccard, langid, licenses, pieces, quality, scoring, sharding, substrings, warc
from newsevidence.llm.common import run_folder

# More columns than an operator asks for, with names that it may use itself.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, node string, bucket int, kept boolean, "
          "held_out boolean, whole string, doc_key long, seq long, rest string, n_words long, `a.b` int")
VOCABULARY = [a + b for a in ("ba", "ke", "lo", "mi", "tu", "ra") for b in ("n", "st", "la", "ree", "x", "")]


def prose(seed, n, words=VOCABULARY):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def odd_rows():
    long = prose(1, 5_000)
    base = prose(2, 120)
    near = " ".join("changed" if i == 60 else w for i, w in enumerate(base.split(" ")))
    texts = [
        (1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n\r\x0b\x0c "), (None, base), (None, None), (7, long),
        (8, long + " tail"), (9, "four words only here"), (10, "four words only here"), (11, "é ß ▁ \0  x 日本語 😀 <s> </s>"),
        (12, "same line of words\n" * 40), (13, "### $$$ %%% " * 30), (14, prose(3, 60) + " " + " ".join(base.split(" ")[20:50])),
        (15, "w" * 70_000), (16, "a b c " * 40), (17, "\n".join("- item " + prose(i, 3) for i in range(30))),
    ]
    return [(i, t, "en" if t and "a" in t else None, "s", 7, 1, "n", 2, True, None, "w", 3, 4, "r", 5, 6) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in odd_rows()]


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 1 ----------------------------------------------------------------------------------------------

def test_shards(spark, odd, none, plain):
    rows = sharding.tree_shards(odd).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in plain)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.tree_shards(none).count() == 0


def test_each_level_draws_by_weight(spark):
    ids = spark.range(20_000)
    place = lambda w, **o: [r[0] for r in ids.select(sharding.shard_of(F.col("id"), w, **o)).collect()]
    for n in (1, 7, 12):
        before, after = place([1.0] * n, racks=2, shards_per_rack=3), place([1.0] * n, racks=2, shards_per_rack=3, grown=[1.0])
        assert all(a in (b, n) for a, b in zip(after, before)) and 0.7 < after.count(n) * (n + 1) / 20_000 < 1.3
    weights = [1.0, 2.0, 3.0, 4.0, 2.0, 5.0, 1.0, 2.0]
    old, new = place(weights, racks=2, shards_per_rack=2), place([*weights[:2], 6.0, *weights[3:]], racks=2, shards_per_rack=2)
    assert all(abs(old.count(s) / 20_000 - w / 20) < 0.02 for s, w in enumerate(weights))
    # Shard 2 got heavier: rows enter region 0 from outside, rack 1 from the rest of the region, shard 2 from the rest of the rack.
    moved = [(a, b) for a, b in zip(old, new) if a != b]
    assert moved and all(b // 4 == 0 for _, b in moved)
    assert all(b // 2 == 1 for a, b in moved if a // 4 == 0) and all(b == 2 for a, b in moved if a // 2 == 1)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [1.0, 0.0])


def test_levels_equal_plain_draws(spark):
    """The descent against draws made one by one; the first level's choice must not depend on what lies below it."""
    weights = [1.0, 3.0, 2.0, 2.0, 5.0, 1.0]
    wait = lambda name, w: -F.log((F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)) / w
    names = {"region 0": 8.0, "region 1": 6.0, "rack 0": 4.0, "rack 1": 4.0, "rack 2": 6.0, **{f"shard {i}": w for i, w in enumerate(weights)}}
    rows = spark.range(500).select("id", sharding.shard_of(F.col("id"), weights, racks=2, shards_per_rack=2).alias("s"),
                                   *[wait(n, w).alias(n) for n, w in names.items()]).collect()
    for r in rows:
        region = min((0, 1), key=lambda i: r[f"region {i}"])
        rack = min((0, 1) if region == 0 else (2,), key=lambda i: r[f"rack {i}"])
        assert r.s == min((2 * rack, 2 * rack + 1), key=lambda i: r[f"shard {i}"])


# 2 ----------------------------------------------------------------------------------------------

def test_archives(spark):
    big, small = "<p>é" + "x" * 200, "<p>short"
    rows = [(5, "http://www.A.org:80/b?q#f", big), (3, "https://u@a.org/b", big), (9, None, big), (None, "http://a.org/", big), (4, "http://a.org/", small),
            (6, "http://a.org/", small), (7, "no url", None), (7, "no url", None), (8, "http://a.org", ""), (10, "http://ä.org/x y", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, seq long, key string").repartition(3)
    place = run_folder(spark)
    captures = warc.write_archives(pages, place)
    parts = warc.write_index(captures, place, parts=3)
    keys = pages.select(warc.url_key(F.col("url")))
    got = bag(warc.resolved(warc.look_up(keys, parts, place)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == big and i != 3
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert got == want
    one = warc.look_up(spark.createDataFrame([("org,a)/",), ("org,none)/",), (None,)], "k string"), parts, place)
    assert bag(one, "page_id", "record_type") == Counter({(None, "revisit"): 1, (4, "response"): 1, (6, "response"): 1, (8, "response"): 1})
    assert keys.toDF("k").where("k = 'org,a,www)/b?q'").count() == 1
    empty = run_folder(spark)
    parts = warc.write_index(warc.write_archives(pages.limit(0), empty), empty)
    assert warc.look_up(keys, parts, empty).count() == 0


@pytest.mark.parametrize("bound", [0, 32 << 20])
def test_archives_of_equal_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", bound)
    a, b = "a" * 100, "b" * 99
    rows = [(1, "http://x.org/", a)] * 3 + [(1, "http://w.org/", a)] + [(2, "http://x.org/", a)] * 2 + [(3, None, b)] * 2 + [(None, None, "c" * 200)] * 2
    place = run_folder(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    parts = warc.write_index(warc.write_archives(pages, place), place)
    got = bag(warc.resolved(warc.look_up(pages.select(warc.url_key(F.col("url"))), parts, place)), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == Counter({(1, 100, "response", None): 1, (1, 100, "revisit", 1): 3, (2, 100, "revisit", 1): 2, (3, 99, "response", None): 2,
                           (None, 200, "response", None): 1, (None, 200, "revisit", None): 1})


# 3 ----------------------------------------------------------------------------------------------

def test_languages(spark, odd, none, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    rows = langid.identify_languages(docs, train).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (B.crc(r.doc_id) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    got = Counter(r.lang_pred for r in langid.identify_languages(odd, F.col("doc_id") > 0).collect())
    assert got["und"] == 5 and sum(got.values()) == len(odd_rows())
    assert {r.lang_pred for r in langid.identify_languages(odd, F.lit(False)).collect()} == {"und"}
    assert langid.identify_languages(none, train).count() == 0


# 4 ----------------------------------------------------------------------------------------------

def test_scores(spark, odd, none, plain):
    held = F.col("doc_id") % 3 == 0
    rows = scoring.mixed_scores(odd, held).collect()
    out = lambda i: i is not None and i % 3 == 0
    tokens = lambda t: [*B.words(B.lower(t)), None]
    counts = Counter(x for i, t in plain if not out(i) for x in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter((i, out(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total,
                    round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens(t)), 6)) for i, t in plain)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score <= 0 and math.isfinite(r.score) and r.bits_per_byte < 40 for r in rows)
    assert scoring.mixed_scores(none, held).count() == 0
    blind = scoring.mixed_scores(odd, F.lit(True)).where("doc_id = 5").first()
    assert (blind.train_tokens, blind.n_known) == (0, 0) and abs(blind.bits_per_byte - 8) < 1e-5  # one byte for the end


def test_every_unit_of_a_text_judges():
    """Which weight vector a text moves is decided by its whole code length."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    column = pa.array([" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(300)])
    rows = [(r["cell"], r["counts"]) for b in scoring._gather(iter([pa.record_batch({"text": column})])) for r in b.to_pylist()]
    mixer = scoring.Mixer.of(rows)
    refiner = scoring._Refiner(mixer)
    refiner.add(column)
    units = scoring._Units(column)
    nats = mixer.bits(units, np.arange(len(units.codes)))
    total = np.zeros((len(column), scoring.VECTORS))
    np.add.at(total, units.text, nats[units.of])
    want = np.zeros((len(units.codes), scoring.VECTORS))
    np.add.at(want, (units.of, total.argmin(axis=1)[units.text]), 1)
    pool = refiner.pool
    assert pool.codes.tolist() == units.codes.tolist() and pool.sums[pool.place, :scoring.VECTORS].tolist() == want.tolist()
    assert (want.sum(axis=0) > 0).sum() > 1  # texts differ in what fits them


def test_beginnings_are_worked_out_once():
    """Bytes that units begin with alike are there once, and every unit's contexts are those it has alone."""
    rng = random.Random(6)
    words = ["".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    column = pa.array(["", None, *(" ".join(rng.choices(words, k=rng.randint(0, 9))) + rng.choice(["", ". ", "\n"]) for _ in range(200))])
    units = scoring._Units(column)
    every = np.arange(len(units.codes))
    for some, shared in ((units.ordered(every), True), (every, False), (every, True), (every[:1], True)):
        c = units.contexts(some, shared)
        ends = np.cumsum((units.stop - units.start)[some])
        assert len(c.node) == ends[-1] and c.borders[-1] == len(c.data) == len(np.unique(c.node))
        for i, u in enumerate(some.tolist()):
            alone = units.contexts(every[u:u + 1])
            at = c.node[ends[i - 1] if i else 0:ends[i]]
            back = alone.node
            assert c.data[at].tobytes() == alone.data[back].tobytes() == units.data[units.start[u]:units.stop[u]].tobytes()
            assert all((x[at] == y[back]).all() for x, y in zip(c.slots, alone.slots))
            assert (np.searchsorted(c.borders, at, side="right") == np.searchsorted(alone.borders, back, side="right")).all()
            assert shared or (some[c.of[at]] == u).all()
    assert len(units.contexts(units.ordered(every)).data) < 0.7 * len(units.contexts(every).node)


def test_distinct_codes():
    rng = np.random.default_rng(7)
    for codes in (rng.integers(0, 50, 400).astype(np.uint64), rng.choice(rng.integers(0, 1 << 63, 90).astype(np.uint64) * np.uint64(2), 500), np.zeros(1, np.uint64), np.zeros(0, np.uint64)):
        want, first, of, times = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
        got, at, order, fresh = scoring._distinct(codes)
        assert got.tolist() == want.tolist() and at.tolist() == of.tolist() and order[fresh].tolist() == first.tolist()
        assert order.tolist() == np.argsort(codes, kind="stable").tolist() and np.bincount(at, minlength=len(got)).tolist() == times.tolist()


def test_scores_in_parts(monkeypatch):
    """Bounds on what is pooled or waits don't change what texts cost or which weights they move."""
    rng = random.Random(9)
    columns = [pa.array([prose(rng.randrange(40), rng.randint(0, 60)) for _ in range(30)]) for _ in range(4)]
    rows = [(r["cell"], r["counts"]) for b in scoring._gather(iter([pa.record_batch({"text": c}) for c in columns])) for r in b.to_pylist()]

    def worked():
        mixer = scoring.Mixer.of(rows)
        coder, refiner = scoring._Coder(mixer), scoring._Refiner(scoring.Mixer.of(rows))
        for c in columns:
            coder.add(c)
            refiner.gather(c)
        moved = refiner.pool.sums.copy()
        refiner.settle()
        return coder.scores(), refiner.seen, moved

    scores, seen, _ = worked()
    assert len(scores) == 120 and scores == pytest.approx(np.concatenate([scoring._Coder(scoring.Mixer.of(rows)).totals(c) for c in columns]), rel=1e-5)
    monkeypatch.setattr(scoring, "_WAITING", 1)
    parts = worked()
    assert parts[0] == pytest.approx(scores, rel=1e-5) and (parts[1] == seen).all() and parts[2][:, :scoring.VECTORS].sum() == parts[2][:, -2].sum()
    monkeypatch.setattr(scoring, "_POOLED", 1)
    parts = worked()
    assert parts[0] == pytest.approx(scores, rel=1e-5) and parts[1].sum() == seen.sum()


def test_odds_without_own():
    """What one text has of a unit is taken off, be it one or more."""
    rng = np.random.default_rng(8)
    mixer = scoring.Mixer([rng.integers(0, 4, (1 << b, 2)).astype(np.float32) for b in scoring.TABLE_BITS], None)
    data, own = rng.integers(0, 256, 500).astype(np.uint8), rng.choice([1, 1.5, 2], 500).astype(np.float32)
    slots = [rng.integers(0, 1 << b, 500) for b in scoring.TABLE_BITS]
    for j in range(8):
        bit, x = mixer.others(data, slots, j, own, np.flatnonzero(own != 1))
        assert bit.tolist() == ((data >> (7 - j)) & 1).tolist()
        node = (data.astype(np.int64) >> (8 - j)) | (1 << j)
        for k, slot in enumerate(slots):
            rest = mixer.counts[k][slot ^ scoring._NODE[k][node]] - own[:, None] * np.stack((1 - bit, bit), axis=1)
            rest = np.maximum(rest, 0).astype(np.float32)
            assert np.allclose(x[k], np.log((rest[:, 1] + 0.4) / (rest[:, 0] + 0.4)), atol=1e-6)


def test_mixing_learns(spark):
    """Prose of known words costs fewer bits than that of unknown ones, and bits refine to fewer."""
    import pyarrow as pa

    counts = [c for c in scoring.bit_counts(spark.createDataFrame([(prose(i, 200),) for i in range(20)], "text string")).collect()]
    mixer = scoring.Mixer.of([(r["cell"], bytes(r["counts"])) for r in counts])
    mixer.refine(pa.array([prose(i, 200) for i in range(10)]))
    coder = scoring._Coder(mixer)
    known, unknown = coder.totals(pa.array([prose(99, 200), prose(99, 200, ["qzw", "vvj", "pfk"])]))
    assert known / len(prose(99, 200)) > 2 * unknown / len(prose(99, 200, ["qzw", "vvj", "pfk"]))
    assert known * math.log2(10) / len(prose(99, 200)) > -3
    again = coder.totals(pa.array([prose(99, 200), None, ""]))
    assert again[0] == pytest.approx(known, rel=1e-6) and again[1] == again[2] < 0


def test_all_training_texts_move_the_weights(spark):
    """Which source comes first in the table decides nothing."""
    other = [f"{c}{x}" for c in "ÀÉÎ" for x in VOCABULARY]
    first = [(2 * i, prose(i, 60)) for i in range(450)]
    second = [(2 * i + 1000, prose(i, 60, other)) for i in range(450)]
    held = [(2 * i + 1, prose(5_000 + i, 60, VOCABULARY if i % 2 else other)) for i in range(20)]
    runs = [spark.createDataFrame([*rows, *held], "doc_id long, text string").coalesce(1) for rows in (first + second, second + first)]
    got = [{r.doc_id: r.bits_per_byte for r in scoring.mixed_scores(d, F.col("doc_id") % 2 == 1).where("held_out").collect()} for d in runs]
    assert len(got[0]) == 20 and all(got[1][i] == pytest.approx(b, rel=1e-3) for i, b in got[0].items())


# 5 ----------------------------------------------------------------------------------------------

def test_quality(odd, none, plain):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = bag(quality.quality_cascade(odd), "doc_id", *names)
    assert got == Counter((i, *(B.quality(t)[n] for n in names)) for i, t in plain)
    assert bag(quality.good_documents(odd), "doc_id", "text") == Counter((i, t) for i, t in plain if B.quality(t)["kept"])
    assert quality.good_documents(odd).columns == odd.columns
    assert quality.quality_cascade(none).count() == 0


def test_long_texts_and_unspaced_scripts_are_kept(spark):
    r = random.Random(5)
    han = " ".join("".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(30)) for _ in range(80))
    latin = " ".join("".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(80))
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}{chr(97 + i // 456976)}" for i in range(1_000_001))
    docs = spark.createDataFrame([(1, han), (2, latin), (3, long)], "doc_id long, text string")
    assert {x.doc_id: x.failed_rule for x in quality.quality_cascade(docs).collect()} == {1: None, 2: "word_length", 3: None}


def test_rules_are_ordered_by_rejection_per_cost(odd):
    rule = lambda name, test, work: quality.Rule(name, test, lambda m: F.lit(work))
    most = lambda m: m["n_words"] < 1_000
    rules = [rule("idle", lambda m: F.lit(False), 1), rule("dear", most, 50), rule("cheap", most, 2), rule("also cheap", most, 2), rule("null", lambda m: F.lit(None).cast("boolean"), 3)]
    for df in (odd, odd.repartition(7)):
        order = quality.order_rules(df, rules, sample_rows=1_000)
        assert [r.name for r, _, _ in order] == ["also cheap", "cheap", "dear", "idle", "null"] and order[0][1] > 0.8 and order[0][2] == 2
    failed = [{(r.doc_id, r.n_words): r.failed_rule for r in quality.quality_cascade(df, rules).collect()} for df in (odd, odd.repartition(5))]
    assert failed[0] == failed[1] and set(failed[0].values()) == {"also cheap", None}
    # The base rules hold in any cascade.
    assert bag(quality.good_documents(odd, [rules[0]]), "doc_id") == bag(quality.quality_cascade(odd, [rules[0]]).where("kept"), "doc_id")


def test_counts_are_made_once_and_only_when_needed(odd):
    plan = quality.good_documents(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and plan.count("array_distinct(") == 1 and plan.count("split(") == 2


# 6 ----------------------------------------------------------------------------------------------

def test_repeats(spark, odd, none, plain):
    got = bag(substrings.remove_repeats(odd), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == Counter(B.without_repeats(plain))
    assert substrings.remove_repeats(none).count() == 0
    cut = substrings.without_repeats(odd)
    kept = [(i, k if n else t, n) for (i, t), (_, w, n, k) in zip(sorted(plain, key=lambda r: B.LAST if r[0] is None else r[0]), B.without_repeats(plain)) if not n or n < w]
    assert cut.columns == odd.columns and bag(cut, "doc_id", "text") == Counter((i, t) for i, t, _ in kept)


def test_frequent_anchors_change_nothing(odd, plain, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 0)
    assert bag(substrings.remove_repeats(odd), "doc_id", "n_words", "n_removed", "kept_text") == Counter(B.without_repeats(plain))


def test_repeated_spans_have_equal_sources(spark):
    shared = prose(5, 40)
    docs = [(i, f"{prose(10 + i, 30)} {shared} {prose(50 + i, 10)} {shared if i == 3 else ''}") for i in range(6)]
    spans = substrings.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = {i: B.words(t) for i, t in docs}
    assert spans
    for s in spans:
        n = s.edges + substrings.WINDOW - 1
        assert s.source_key < s.doc_key and text[s.doc_key][s.start:s.start + n] == text[s.source_key][s.source_start:s.source_start + n]


# 7 ----------------------------------------------------------------------------------------------

def test_pieces(odd, none, plain):
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    ids = lambda t: sp.encode(t or "")
    got = bag(pieces.encode_pieces(odd, path("piece_bpe_32k.model")), "doc_id", "n_tokens", "ids", "decoded")
    assert got == Counter((i, len(ids(t)), ",".join(map(str, ids(t))), sp.decode(ids(t))) for i, t in plain)
    assert pieces.encode_pieces(none, path("piece_bpe_32k.model")).count() == 0


def test_chunks_equal_the_library(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 50)
    table, r = pieces._Chunks(path("piece_bpe_32k.model")), random.Random(4)
    parts = [" ", "  ", "a", "the", "\n", "\t", "é", "▁", "　", "日本", "😀", "\0", "<s>", "<0x0A>", "</s>", "<unk>", "Ab1", "...", "ﬁ", "é", "�"]
    for _ in range(3_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        found, ids = table.look_up(table.chunks(text)) if text else [], table.model.encode(text)
        assert ",".join(f[0] for f in found) == ",".join(map(str, ids)) and "".join(f[2] for f in found)[1:] == table.model.decode(ids)
    assert pieces.crosses_marker("a▁b") and not pieces.crosses_marker("▁▁ab")


# 8 ----------------------------------------------------------------------------------------------

def test_jaccard(odd, none, plain):
    known = B.groups(plain)
    copies = Counter(t for _, t in plain)
    null = lambda x: None if x == B.LAST else x
    want = Counter()
    for i, t in plain:
        first, links, low = known.get(t, (i, 0, i))
        want[i, null(first), copies[t] if t in known else 1, links, null(low)] += 1
    assert bag(jaccard.jaccard_join(odd), "doc_id", "text_id", "n_copies", "n_links", "class_id") == want
    assert jaccard.jaccard_join(none).count() == 0
    left = bag(jaccard.one_of_each_group(odd), "doc_id", "text")
    expected = Counter({(i, t): 1 if t in known else n for (i, t), n in Counter(plain).items()
                        if t not in known or ((B.LAST if i is None else i) == known[t][0] == known[t][2])})
    assert left == expected and jaccard.one_of_each_group(odd).columns == odd.columns


def test_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 8)
    base = prose(7, 100).split(" ")
    docs = [(i, " ".join([f"v{i}" if p == i else w for p, w in enumerate(base)])) for i in range(60)]
    docs += [(100 + i, prose(300 + i, 80)) for i in range(10)]
    known = B.groups(docs)
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: known[t][1:] for i, t in docs} and max(v[0] for v in got.values()) > 20
    assert jaccard.band_count(0.8, 4, 0.9999) == 18


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (102, 103)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges, run_folder(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100}


# 9 ----------------------------------------------------------------------------------------------

def test_decontamination(spark, odd, none, monkeypatch):
    items = {i: prose(900 + i, 40, [f"q{i}{x}" for x in VOCABULARY]) for i in range(6)} | {6: "two words", 7: "", 8: None}
    tests = spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id long, text string, row string")
    edited = items[1].split(" ")
    edited[10:12] = ["new"]
    edited[25] = "other"
    docs = [(1, f"{prose(1, 50)} {items[0].upper()} {prose(2, 50)}"), (2, " ".join(edited)), (3, prose(3, 200)), (4, None), (5, ""),
            (6, f"{items[2]} {prose(4, 300)} {items[3]} {items[2]}"), (6, items[4]), (None, items[5]), (7, "has two words in it"), (8, items[0][:40])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    known = {i: t for i, t in items.items() if t}
    want = Counter((d, i) for d, t in docs for i in B.contaminated(t, known)) + Counter({(7, 6): 1})
    assert bag(decontaminate.contaminated_passages(table, tests), "doc_id", "item_id") == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)  # items in several blocks
    assert bag(decontaminate.contaminated_passages(table, tests), "doc_id", "item_id") == want
    clean = decontaminate.without_test_items(table.cache(), tests)
    assert {r.doc_id for r in clean.collect()} == {3, 4, 5, 8} - {d for d, _ in want}
    assert decontaminate.contaminated_passages(none, tests).count() == 0
    assert decontaminate.contaminated_passages(odd, tests.limit(0)).count() == 0


def test_edited_copies_are_found(spark):
    """Copies with every 3rd, 4th or 5th word changed, at each offset, and with words put between."""
    items = {n: prose(700 + n, n, [f"i{n}{x}" for x in VOCABULARY]) for n in (14, 20, 27, 30, 37, 46)}
    texts = []
    for n, item in items.items():
        w = item.split(" ")
        for step in (3, 4, 5):
            for phase in range(step):
                texts.append(" ".join("other" if i % step == phase else x for i, x in enumerate(w)))
        for more in (1, 2, 3):
            texts.append(" ".join(x + " between" * more * (i > 8 and i % 2) for i, x in enumerate(w)))
    r = random.Random(6)
    for share in (0.15, 0.2, 0.3):
        texts += [" ".join("other" if r.random() < share else x for x in t.split(" ")) for t in items.values() for _ in range(5)]
    docs = [(i, f"{prose(i, 90)} {t} {prose(i + 500, 90)}") for i, t in enumerate(texts)]
    want = Counter((d, i) for d, t in docs for i in B.contaminated(t, items))
    assert len(want) > 60
    found = decontaminate.contaminated_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert bag(found, "doc_id", "item_id") == want
    # Alone in a table: what the edits broke is found in no document.
    alone = [(n, " ".join("other" if i % 4 == 3 else x for i, x in enumerate(t.split(" ")))) for n, t in items.items()]
    assert all(n in B.contaminated(t, items) for n, t in alone)
    found = decontaminate.contaminated_passages(spark.createDataFrame(alone, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert bag(found, "doc_id", "item_id") == Counter((n, n) for n in items)


def test_alignment_equals_the_plain_one():
    import numpy as np

    r = random.Random(3)
    pairs = [([r.randint(2, 9) for _ in range(r.randint(1, 20))], [r.randint(2, 9) for _ in range(r.randint(0, 40))]) for _ in range(200)]
    got = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert got[:, 0].tolist() == [B.smith_waterman(a, b) for a, b in pairs]


# 10 ---------------------------------------------------------------------------------------------

def test_licenses(spark, none):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", "text before\n" + mit), (2, "a/b/c.txt", prose(1, 50)), (3, "a/b/d.txt", f"{prose(2, 300)}\n{gpl}\n{prose(3, 9)}"),
        (4, "a/x/COPYING", gpl), (5, "a/x/y/z.txt", None), (6, "other/e.txt", "license of the general work under version three"), (7, None, prose(4, 9)),
        (None, "a/x/y/z.txt", ""), (8, "ab/f.txt", "x"), (9, "a/x/LICENSE", mit), (9, "a/x/LICENSE", mit)]
    files = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, folder int")
    got = bag(licenses.scan_licenses(files), "doc_id", "license", "basis", "from_folder")
    first = "GPL-3.0"  # both files of a/x are whole templates; the smaller id speaks
    assert got == Counter([
        (1, "MIT", "header", None), (2, "MIT", "inherited", "a"), (3, "GPL-3.0", "header", None), (4, "GPL-3.0", "header", None),
        (5, first, "inherited", "a/x"), (6, None, None, None), (7, None, None, None), (None, first, "inherited", "a/x"), (8, None, None, None),
        (9, "MIT", "header", None), (9, "MIT", "header", None)])
    assert licenses.scan_licenses(none.withColumn("path", F.lit("p"))).count() == 0


def test_seed_terms_lose_no_match():
    known = licenses.Templates(1_000, {"the": 900, "license": 400, "under": 500, "version": 30})
    r = random.Random(8)
    for _ in range(2_000):
        name, text = r.choice(licenses.TEMPLATES)
        w = licenses.terms(text)
        line = " ".join(x for x in w if r.random() < 0.8) + " " + " ".join(r.choice(VOCABULARY) for _ in range(r.randint(0, 3)))
        if known.best(line)[0] >= min(licenses.HEADER, licenses.FILE):
            assert any(s in line for s in known.seeds)


def test_wrapped_headers_and_full_texts(spark):
    from pathlib import Path

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the\nSoftware without restriction."
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    bsd = "Copyright (c) 2020 Someone. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met."
    cases = {"MIT": mit, "GPL-3.0": gpl, "BSD-3-Clause": bsd}
    rows = [(n, "\n".join(f" {mark} {x}" for x in f"{prose(1, 9)}\n{text}\n{prose(2, 90)}".split("\n"))) for n, text in cases.items() for mark in ("*", "//", "#", "")]
    rows += [("MPL-2.0", f"{prose(3, 80)} This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. {prose(4, 80)}")]
    folder = Path(licenses.__file__).parent / "license_texts"
    rows += [(f.stem, f.read_text()) for f in sorted(folder.iterdir())] + [(None, prose(i, 80)) for i in range(200)]
    files = spark.createDataFrame([(i, f"d{i}/x", t) for i, (_, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(files).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]
