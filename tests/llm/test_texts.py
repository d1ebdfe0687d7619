import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, licenses, packing, sharding, toxicity

P = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# byte-level BPE


def reference_encoding():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken(docs, corpus_rows):
    _, enc = reference_encoding()
    got = {r.doc_id: r for r in bpe.digest(docs).collect()}
    for i, t in corpus_rows:
        ids = enc.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_on_random_text():
    path, enc = reference_encoding()
    coder, rnd = bpe.Coder(path, P.PATTERN), random.Random(8)
    for _ in range(500):
        t = "".join(rnd.choice("abAB 01'\n\t é漢😀▁\x00 .,!-_the ing") for _ in range(rnd.randrange(80)))
        assert coder.encode(t) == enc.encode_ordinary(t)
        assert coder.decode(coder.encode(t)) == t.encode()


def test_bpe_odd_rows(odd, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(odd, path, P.PATTERN), path, P.PATTERN).select("row.doc_id", "ids", "decoded").collect()
    assert len(out) == odd.count() and all(r.ids == [] and bytes(r.decoded) == b"" for r in out if r.doc_id in (3, 4, 9))
    assert bpe.encode(none, path, P.PATTERN).count() == 0


# sharding


def test_shards(docs, corpus_rows):
    texts = dict(corpus_rows)
    got = sharding.digest(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows"
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_repeat_and_depend_on_the_seed(docs):
    one, same, other = (sorted((r.shard, r.slot, r.doc_id) for r in sharding.shuffled(d, 4, seed=s, bucket_bytes=5000).select("shard", "slot", "row.doc_id").collect()) for d, s in ((docs, 1), (docs.repartition(7), 1), (docs, 2)))
    assert one == same != other


def test_shards_of_odd_rows(odd, none):
    out = sharding.shuffled(odd, 8, bucket_bytes=100).select("shard", "slot").collect()
    assert len(set(out)) == odd.count()
    assert sharding.shuffled(none).count() == 0


def test_written_shards(docs, spark, tmp_path):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4


def test_shuffle_as_brute_force(docs):
    """Buckets, their order, the swaps and the cut into shards, row by row."""
    key = lambda c, *more: F.xxhash64(F.coalesce(c, F.lit("")), c.isNull(), *more)
    rows = docs.select("doc_id", key(F.col("doc_id").cast("string"), F.lit(9)).alias("a"), key(F.col("text")).alias("b"), F.octet_length("text").alias("n"))
    buckets = -(-sum(r.n for r in rows.collect()) // 3000)
    rows = rows.select("*", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).alias("k")).collect()
    every = []
    for k in range(buckets):
        own = sorted((r for r in rows if r.k == k), key=lambda r: (r.a, r.b))
        rng = np.random.Generator(np.random.PCG64([9, k]))
        pick = [int(u * (i + 1)) for i, u in enumerate(rng.random(len(own)))]
        for i in range(len(own) - 1, 0, -1):
            own[i], own[pick[i]] = own[pick[i]], own[i]
        every += [r.doc_id for r in own]
    want, at = [], 0
    for shard in range(5):
        n = len(every) // 5 + (shard < len(every) % 5)
        want += [(d, shard, slot) for slot, d in enumerate(every[at : at + n])]
        at += n
    got = sharding.shuffled(docs, 5, seed=9, bucket_bytes=3000).select("row.doc_id", "shard", "slot").collect()
    assert buckets > 10 and sorted(map(tuple, got)) == sorted(want)


def test_fisher_yates_is_even():
    rng = np.random.Generator(np.random.PCG64(1))
    seen = collections.Counter(tuple(sharding.fisher_yates(3, rng)) for _ in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


# packing


def check_bins(rows, capacity):
    bins = collections.defaultdict(list)
    whole = collections.defaultdict(int)
    for r in rows:
        bins[r.bin].append(r)
        whole[(r.doc_id, r.size)] += r.length
    for v in bins.values():
        at = 0
        for r in sorted(v, key=lambda r: (r.bin_start, r.length)):
            assert r.bin_start == at
            at += r.length
        assert at <= capacity
    return bins, whole


def test_packing(docs, corpus_rows):
    texts = dict(corpus_rows)
    out = packing.pack(docs, F.octet_length("text"), F.col("source"), F.col("text"), capacity=700, group=20).select("row.doc_id", "row.source", "size", "piece", "start", "length", "bin", "bin_start").collect()
    bins, whole = check_bins(out, 700)
    assert {d: n for (d, _), n in whole.items()} == {i: len(t.encode()) for i, t in texts.items()}
    for v in bins.values():
        assert len({r.source for r in v}) == len(v) and len({texts[r.doc_id] for r in v}) == len(v)
    for r in out:
        assert r.start == 700 * r.piece


def test_tightest_compatible_bin():
    # bins open for 6 (source 0) and 5 (source 1); 4 of source 0 doesn't go to the tightest, which has source 0
    bins, offset = packing.best_fit([6, 5, 4, 4], [0, 1, 0, 2], [1, 2, 3, 4], 10)
    assert bins == [0, 1, 1, 0] and offset == [0, 0, 5, 6]
    # one cluster is never twice in a bin
    assert packing.best_fit([3, 3, 3], [0, 1, 2], [5, 5, 5], 10)[0] == [0, 1, 2]


def brute_best_fit(size, source, cluster, capacity):
    """Each item looks at every bin."""
    bins, where = [], []
    for n, s, c in zip(size, source, cluster, strict=True):
        able = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= n and b["used"] < capacity and s not in b["s"] and c not in b["c"]]
        if able:
            i = min(able)[1]
        else:
            i = len(bins)
            bins.append({"used": 0, "s": set(), "c": set()})
        where.append((i, bins[i]["used"]))
        bins[i]["used"] += n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return [i for i, _ in where], [o for _, o in where]


def test_best_fit_as_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        n = rnd.randrange(0, 120)
        size = sorted((rnd.randrange(0, 101) for _ in range(n)), reverse=True)
        source, cluster = [rnd.randrange(rnd.choice([2, 30])) for _ in range(n)], [rnd.randrange(40) for _ in range(n)]
        assert packing.best_fit(size, source, cluster, 100) == brute_best_fit(size, source, cluster, 100)


def test_packing_as_brute_force(docs, corpus_rows):
    """The whole operator over one group: pieces, order of the items, bins and places."""
    got = packing.pack(docs, F.octet_length("text"), F.col("source"), F.col("text"), capacity=700).select("row.doc_id", "piece", "length", "bin", "bin_start").collect()
    code = lambda c: F.xxhash64(F.coalesce(c, F.lit("")), c.isNull())
    rows = docs.select("doc_id", F.octet_length("text").alias("n"), code(F.col("doc_id").cast("string")).alias("key"), code(F.col("text")).alias("c"), code(F.col("source")).alias("s")).collect()
    tail = lambda n: n - 700 * max(0, (n - 1) // 700)
    items = sorted(rows, key=lambda r: (-tail(r.n), r.key, r.c, r.s))
    bins, start = brute_best_fit([tail(r.n) for r in items], [r.s for r in items], [r.c for r in items], 700)
    want = {(r.doc_id, max(0, (r.n - 1) // 700)): (tail(r.n), f"0-{b}", o) for r, b, o in zip(items, bins, start, strict=True)}
    last = {(r.doc_id, r.piece): (r.length, r.bin, r.bin_start) for r in got if (r.doc_id, r.piece) in want}
    assert last == want and sum(r.length == 700 and r.bin_start == 0 for r in got) >= len(got) - len(want)


def test_packing_odd_rows(odd, none):
    out = packing.digest(odd).collect()
    assert len({(r.doc_id, r.bin) for r in out}) >= 7 and sum(r.length for r in out) == odd.agg(F.sum(F.octet_length("text"))).first()[0]
    assert packing.digest(none).count() == 0


# licenses


def test_base_places(spark, docs):
    texts = ["the MIT License, and mit-license; mitlicense", "GNU General Public\nLicense v3 general public license", "Apache 2 license. APACHE  LICENSE", "é mit licénse", "mit", "", "general public mit license", "x apache license " * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None), (0, texts[0])]
    got = licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (dict(rows)[r.doc_id] or "").translate(LOWER))
        at = [(i, lab) for i in range(len(w)) for lab, p in licenses.PHRASES.items() if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1) >= bool(at)


def test_merged_diagonals(spark):
    notice = licenses.NOTICES["bsd-grant"].split()
    changed = notice[:8] + ["surely"] + notice[8:14] + notice[15:]
    rows = [(1, "pre " * 9 + " ".join(changed) + " post"), (2, " ".join(notice[:6])), (3, " ".join(reversed(notice)))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "labels", "spans", "score").collect()}
    assert got[1].labels == ["bsd-grant"] and got[1].spans[0].start == 9 and got[1].spans[0].end == 9 + len(changed)
    assert got[2].labels == [] and 0 < got[2].score < 0.7
    assert got[3].labels == [] and got[3].score == 0


def test_whole_license_texts(spark):
    """Templates of several bitmaps, with changed words, and far apart from each other in a long document."""
    mit, isc = (licenses.template_words(licenses.NOTICES[x]) for x in ("mit-text", "isc-text"))
    assert len(mit) > 128 and len(isc) > 64
    half = mit[: len(mit) // 2]
    rows = [(1, " ".join(mit)), (2, "word " * 30_000 + " ".join([*isc[:50], "surely", *isc[51:]]) + " word" * 30_000), (3, " ".join(half)), (4, "any \u212aind mit license")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_words", "labels", "spans", "score").collect()}
    assert got[1].labels == ["mit-grant", "mit-text"] and got[1].score == 1 and (got[1].spans[1].start, got[1].spans[1].end) == (0, len(mit))
    assert got[2].labels == ["isc-text"] and got[2].n_words == 60_000 + len(isc) and got[2].spans[0].start == 30_000 and got[2].spans[0].end == 30_000 + len(isc)
    assert abs(got[2].score - (len(isc) - 3) / (len(isc) - 1)) < 1e-12
    assert got[3].labels == ["mit-grant"] and got[4].labels == ["mit"]


def test_licenses_odd_rows(odd, none):
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_run_no_python(docs):
    plan = licenses.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# toxicity


def toxic_corpus(n=900, seed=4):
    rnd = random.Random(seed)
    common = ["".join(rnd.choice("bdfglmnprstv") + rnd.choice("aeiou") for _ in range(3)) for _ in range(800)]
    bad = ["grolbak", "snurfel", "vixtorp"]
    rows, labels = [], []
    for i in range(n):
        w = rnd.choices(common, k=rnd.randrange(20, 120))
        y = int(i % 8 == 0)
        if y:
            for _ in range(3):
                b = rnd.choice(bad)
                b = rnd.choice([b, b.upper(), b.replace("o", "0"), b.replace("r", "r"), b.replace("i", "і").replace("e", "е")])
                w.insert(rnd.randrange(len(w)), b + rnd.choice(["", "", "s"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "grolbak")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.digest(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(out) == len(rows) + 3
    y = dict((i, t) for i, _, t in labels)
    held = [i for i in y if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in set(held)) for i in y)
    assert sum(out[i].predicted == y[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[5000].score == out[5001].score < 0.5


def test_folding():
    assert toxicity.fold("1d10t") == toxicity.fold("іdіоt") == toxicity.fold("Idiot") == " idiot "
    assert toxicity.fold("Éa, b-c!  d$d !x") == " ea b c dsd x "
    assert toxicity.fold("") == "  "


def test_exceptions_and_strongest_term():
    lex = toxicity.Lexicon({" trash ": 3.0, "tras": 1.0, " clow": 2.0}, (-3.0, 2.0, 0.0), ("trash can",))
    assert lex.hits(toxicity.fold("a trash can here")) == []
    assert lex.hits(toxicity.fold("trash and clowns")) == [3.0, 2.0]
    assert lex.score("trash") > lex.score("trash can") == lex.score("")


def plain_hits(lexicon, folded):
    """Every term and exception looked for at every place."""
    places = lambda t: [p for p in range(len(folded) - len(t) + 1) if folded.startswith(t, p)]
    spans = [(p, p + len(e)) for e in map(toxicity.fold, lexicon.exceptions) for p in places(e)]
    best = {}
    for term, weight in lexicon.weights.items():
        for p in places(term):
            if not any(a <= p and p + len(term) <= b for a, b in spans):
                word = p if folded[p] == " " else folded.rindex(" ", 0, p)
                best[word] = max(weight, best.get(word, 0.0))
    return best


def test_automaton_as_a_plain_scan():
    """All hits, for all terms, in random texts of few letters, where terms overlap and exceptions cover some."""
    rnd = random.Random(11)
    make = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    for _ in range(300):
        terms = {t: float(rnd.randrange(1, 99)) for t in (make(rnd.randrange(2, 6)) for _ in range(12)) if t.strip() and "  " not in t and " " not in t[1:-1]}
        lexicon = toxicity.Lexicon(terms, (0.0, 1.0, 0.0), tuple(x for x in (make(5).strip() for _ in range(2)) if x))
        folded = toxicity.fold(make(60))
        assert sorted(lexicon.hits(folded)) == sorted(plain_hits(lexicon, folded).values())


def test_no_labels(spark, none):
    rows, _ = toxic_corpus(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.digest(docs, empty).collect()} == {0}
    assert toxicity.digest(none, empty).count() == 0
    assert toxicity.without_toxic(none, empty).columns == none.columns


def test_score_is_the_same_at_every_sample_size(spark):
    rows, labels = toxic_corpus(1200)
    rnd = random.Random(9)  # labels that the words don't tell, so that scores lie between 0 and 1
    labels = [(i, q, 1 - y if rnd.random() < (0.03 if y == 0 else 0.2) else y) for i, q, y in labels]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()
    whole, capped = toxicity.learn(docs, marks), toxicity.learn(docs, marks, other_rows=200)
    mean = [sum(lex.score(t) for _, t in rows) / len(rows) for lex in (whole, capped)]
    true = sum(y for *_, y in labels) / len(labels)
    assert abs(mean[0] - true) < 0.03 and abs(mean[1] - true) < 0.03
    assert abs(whole.score("") - capped.score("")) < 0.02


def test_sample_loses_near_copies_only(spark, monkeypatch):
    rnd, seen = random.Random(3), {}
    word = lambda: "".join(rnd.choice("bdfglmnprstv") + rnd.choice("aeiou") for _ in range(4))
    passage = " ".join(word() for _ in range(12))
    texts = [passage + " " + " ".join(word() for _ in range(40)) for _ in range(80)]  # Jaccard about 0.11
    copy = texts[0].split(" ")
    texts += [" ".join([*copy[:-1], "other"]), texts[1], "", " "]
    rows = [(i, t + (" grolbak snurfel" if i % 2 and i < 80 else "")) for i, t in enumerate(texts)]
    rows[81] = (81, rows[1][1])
    monkeypatch.setattr(toxicity, "fit_curve", lambda x, y, **k: seen.update(n=len(y), toxic=int(y.sum())) or (0.0, 1.0, 0.0))
    labels = [(i, 1, int(i % 2 and i < 82)) for i, _ in rows]
    toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen == {"n": 81, "toxic": 40}  # 40 of each class, and one text without words


def test_folding_of_letters_outside_the_bmp():
    for first in (0x1D400, 0x1D468, 0x1D4D0, 0x1D5A0, 0x1D670, 0x1F110, 0x1F130, 0x1F150, 0x1F170):
        assert toxicity.fold("".join(chr(first + ord(c) - 97) for c in "idiot")) == " idiot ", hex(first)
    assert toxicity.fold("".join(chr(0x1D41A + ord(c) - 97) for c in "idiot") + " \U0001F600 x") == " idiot x "
    assert toxicity.fold("𝟏d𝟏𝟎t \U00020000") == " idiot "


def test_toxicity_counts_small_samples_in_one_task(spark, monkeypatch):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "7")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(i, f"w{i} x{i * 7} y{i * 13} " + ("awful" if i % 3 == 0 else "fine")) for i in range(90)]
    docs = own.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = own.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    tasks, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, kind, *a: (str(kind).startswith("term ") and tasks.append(self.rdd.getNumPartitions())) or plain(self, f, kind, *a))
    assert " awful " in toxicity.learn(docs, labels).weights
    assert tasks == [1]
