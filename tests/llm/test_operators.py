"""The ten operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvida.llm import decontamination, exact_dedup, language_id, lm_scoring, ngram_join, packing, queries, sharding, substring_dedup, token_binary, toxicity
from corvida.llm.tokens import vocabulary

SF = "/root/testdata/sf0.01"
#: The names clash with those that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, n long, component long, row string, size double, shard string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "中文", "A-Z", "don't"]
    def some(n):
        return [rng.choice(vocab) for _ in range(n)]
    passage, base = some(60), some(120)
    out = [None, "", "  \t\n", "one", "One  two\tthree", "one two three", "ONE two THREE", "x" * 5000]
    out += [" ".join(some(rng.randrange(3, 90))) for _ in range(25)]
    out += [" ".join(some(20) + passage + some(k)) for k in range(6)]
    out += [" ".join(base)] * 3 + ["\n".join(base), " ".join(base).upper()]
    for k in range(45):  # near copies, more than a short posting holds
        copy = list(base)
        for i in rng.sample(range(120), k % 6):
            copy[i] = f"edit{k}x{i}"
        out.append(" ".join(copy))
    out += [" ".join(some(30) * 8), " ".join(["la"] * 200), " ".join(some(9000)), "non breaking space \u0085 x <|endoftext|> y", "  lead and trail \n\n "]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(3 * i + 1, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None, None, "h", 1, 2, "r", 0.5, "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return SPLIT.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op1_brute_force(docs, rows):
    at = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 34):
            at[tuple(w[k : k + 35])].append((i, k))
    gone = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + 35))
    want = {i: (len(words(t)), len(gone[i]), hashlib.sha256(" ".join(w for k, w in enumerate(words(t)) if k not in gone[i]).encode()).hexdigest()) for i, t in rows}
    for batches in (1, 2, 5):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, batches=batches).collect()}
        assert got == want


def test_op1_runs_merge_without_a_shuffle_and_an_index_opens_again(spark, docs):
    from corvida.session import scratch_path

    keyed = docs.select("doc_id", "text")
    path = scratch_path(spark, "index")
    index = substring_dedup.FingerprintIndex(spark, fanout=2, path=path)
    seen = []
    for b in range(4):
        if b == 2:  # another session would do the same
            index.close()
            index = substring_dedup.FingerprintIndex(spark, fanout=2, path=path)
            assert len(index.runs) == 2
        seen.append(index.add(keyed.where(F.pmod("doc_id", F.lit(4)) == b)))
    assert index.compactions == 2 and len(index.runs) == 2
    plan = index._run(index.runs[0]).join(index._run(index.runs[1]).withColumnRenamed("n", "m"), "hash", "outer")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    counts = {r["hash"]: r["n"] for r in substring_dedup.anchors(keyed).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {}
    for part in seen:
        for r in part.collect():
            found[r["hash"]] = max(r["n"], found.get(r["hash"], 0))
    assert found == {h: n for h, n in counts.items() if n > 1}
    index.close()


def test_op1_rows_without_doc_id_hot_places_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART", 3)  # so that places are dealt over parts
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(k, f"own{k} words{k} " + shared) for k in range(20)] + [(None, "lead " + shared + " trail"), (None, None), (99, "alone " * 3)] + [(50, " ".join(f"r{i}" for i in range(36)))] * 2
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"]) for r in out)
    assert got == sorted([(k, 42, 40) for k in range(20)] + [(-1, 42, 40), (-1, 0, 0), (99, 3, 0)] + [(50, 36, 36)] * 2)


def encoded(text, end):
    own = Tokenizer.from_file(vocabulary())
    return np.array([*own.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("group", [7, 20_000])
def test_op2_round_trip(docs, rows, group):
    got, of_doc, of_sequence = packing.pack_documents(docs, group=group).collect(), defaultdict(list), defaultdict(list)
    for r in got:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
    assert set(of_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = encoded(t, 1), 0
        for r in sorted(of_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_op2_tightest_window():
    rng = random.Random(1)
    lengths = np.array(sorted((rng.randrange(1, 65) for _ in range(300)), reverse=True))
    bins, offsets = packing.best_fit(lengths, 64)
    free = []
    for length, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        fits = [f for f in free if f >= length]
        if not fits:
            assert b == len(free) and o == 0
            free.append(64)
        else:
            assert free[b] == min(fits)
        assert o == 64 - free[b]
        free[b] -= length


def grams(text, size=5):
    w = words((text or "").lower())
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def test_op3_brute_force(spark, docs, rows):
    by_id = dict(rows)
    items = [(i, " ".join(words(t)[5:25])) for i, t in rows if len(words(t)) > 30][:20] + [(900, None), (901, ""), (902, "too short"), (903, " ".join(words(rows[-3][1])[4000:4008]).upper())]
    items.append((904, items[0][1]))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontamination.contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in by_id.items():
        have = grams(t)
        for i, x in items:
            need = grams(x)
            if need and len(need & have) >= 0.75 * len(need):
                want[d, i] = (len(need), len(need & have))
    assert got == want and want
    kept = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(by_id) - {d for d, _ in want}


def joined(rows):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                of[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("short", [2, 4, 32])
def test_op4_brute_force(docs, rows, short, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_UP_TO", short)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked_components(docs).collect()}
    assert got == joined(rows)


@pytest.mark.parametrize("ties", [0, 1, 3])
def test_op4_group_with_far_members(spark, ties, monkeypatch):
    """Copies of a text at all distances around the limit: long postings, some linked, some not."""
    rng = random.Random(ties)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(110):
        copy = list(base)
        for i in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6, 8, 12])):
            copy[i] = f"e{k}x{i}" if rng.random() < 0.5 else f"shared{rng.randrange(4)}x{i}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(ngram_join, "TIES", ties)
    monkeypatch.setattr(ngram_join, "PAIRS_UP_TO", 6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == joined(rows)


def test_op5_brute_force(docs, rows):
    def plain(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    want = {i: (min(groups[plain(t)]), len(groups[plain(t)]), i == min(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == want
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_op6_held_out_accuracy(spark):
    got = queries.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) >= 0.95
    toxic = [r["predicted"] for r in got if r["toxic"]]
    assert sum(toxic) / len(toxic) >= 0.8
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= 1


def test_op6_repeated_stems(spark):
    """Clean texts have a stem once, toxic ones twice and more, with other endings."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        toxic = int(rng.random() < 0.3)
        w = [f"{rng.choice('abcdefgh')}filler{rng.randrange(50)}" for _ in range(40)]
        w += [f"schimpf{rng.randrange(10**6)}" for _ in range(rng.randint(2, 5) if toxic else 1)]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in got) / len(got) > 0.97


def test_op6_terms_met_again():
    """A term is there once a text; twice and three times make terms of their own."""
    row, bucket = np.array([0, 0, 0, 1, 1, 2]), np.array([5, 5, 5, 5, 5, 5])
    want = sorted({0 * toxicity.BUCKETS + b for b in (5, *(int(toxicity._again(np.array([5]), t)[0]) for t in (2, 3)))}
                  | {toxicity.BUCKETS + b for b in (5, int(toxicity._again(np.array([5]), 2)[0]))} | {2 * toxicity.BUCKETS + 5})
    assert toxicity._met(row, bucket).tolist() == want
    assert toxicity._met(row[:0], bucket[:0]).tolist() == []


def test_op6_every_term(spark):
    """Without the screens a word of one toxic row reaches the machine."""
    rows = [(i, f"plain text number{i}" + " onlyhere" * (i == 7)) for i in range(60)]
    labels = [(i, int(i == 7 or i % 5 == 0)) for i in range(60)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = {r["doc_id"] for r in docs.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    assert 7 in seen
    bucket = toxicity._terms(np.frombuffer(b"onlyhere", np.uint8), np.array([0, 8]))[0]
    assert (toxicity.train(docs, marks, least_z2=0.0, least_rows=1).place[bucket] >= 0).all()
    assert (toxicity.train(docs, marks).place[bucket] < 0).all()


def test_op6_pairs_of_words(spark):
    """Neither word alone is toxic, both together are."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice([f"filler{k}" for k in range(30)]) for _ in range(8)] + ["insultus"] * a + ["grouppus"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a and b)))
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in got) / len(got) > 0.97


@pytest.mark.parametrize("kind", ["exactly one", "rare pair"])
def test_op6_words_neutral_alone(spark, kind):
    """Each word is as common in toxic rows as in clean ones; only the pair tells."""
    rng = random.Random(6)
    rows, labels, paired = [], [], set()
    for i in range(1500 if kind == "exactly one" else 5000):
        a, b, slur = rng.random() < 0.5, rng.random() < 0.5, False
        toxic = int(a != b)
        if kind == "rare pair":
            toxic, x = int(rng.random() < 0.1), rng.random()
            a, b = (x < 0.2, x < 0.2) if toxic else (x < 0.2, 0.2 <= x < 0.4)
            slur = bool(toxic and not a)
        if a and b or kind == "exactly one":
            paired.add(i)
        w = [rng.choice([f"filler{k}" for k in range(30)]) for _ in range(8)] + ["insultus"] * a + ["grouppus"] * b + ["slurrus"] * slur
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    for some in (got, [r for r in got if r["doc_id"] in paired]):
        assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in some) / len(some) > 0.97


def test_op6_pairs_at_any_place():
    """Pairs across blocks of terms, and with a term that tells the labels apart alone."""
    rng = np.random.default_rng(1)
    n, n_terms = 4000, 2600
    label = (np.arange(n) < n // 5).astype(float)
    has = rng.random((n, n_terms)) < 0.05
    has[:, 5], has[:, 2500] = rng.random((2, n)) < 0.3
    has[:, 2500] = np.where(label == 1, has[:, 5], has[:, 2500])  # together in toxic rows
    has[:, 0] = rng.random(n) < np.where(label == 1, 0.6, 0.2)
    has[:, 77] = np.where(has[:, 0], label == 0, has[:, 77])  # beside term 0 in clean rows only
    parts, toxic = [np.flatnonzero(x).astype(np.int32) for x in has], has[label == 1].sum(axis=0)
    found = np.flatnonzero(toxicity._paired(parts, label, (has.sum(axis=0) - toxic).astype(float), toxic.astype(float), np.arange(n_terms) == 0))
    assert {5, 77, 2500} <= set(found.tolist()) and len(found) <= 12


def test_op6_without_labels(spark, docs):
    got = toxicity.score_documents(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == docs.count() and {r["predicted"] for r in got} == {0}


def test_op7_round_trip(docs, rows):
    want, start = [], 0
    for i, t in rows:
        ids = encoded(t, 2)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_binary.token_files(docs).collect())) == want


def test_op7_many_files(spark, docs, tmp_path):
    """Files end after a number of ids, between batches; what they hold is the same."""
    folder = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    manifest = token_binary.write_token_files(docs, folder, 2, vocabulary(), partitions=2, file_ids=500)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert manifest.count() > 4
    assert sorted(map(tuple, token_binary.read_token_files(manifest, folder).collect())) == sorted(map(tuple, token_binary.token_files(docs).collect()))


@pytest.mark.parametrize("values", [[0], [5] * 70, [2**32 - 1, 0, 7], list(range(3000)), [3] * 99 + [2**31]])
def test_op7_blocks(values):
    ids = np.array(values, np.uint32)
    data = token_binary.encode_file(np.array([8]), np.array([len(ids)]), ids, block=64)
    assert [x.tolist() for _, _, x in token_binary.TokenFile(data).documents()] == [values]


def test_op8_base_score(docs, rows):
    trained = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in trained for w in [*words(lower(t)), None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, rounds=1).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        w = [*words(lower(t)), None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_op8_rare_words_by_the_shuffle(docs):
    many = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, rounds=1).collect()}
    few = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, rounds=1, common=3).collect()}
    assert many.keys() == few.keys() and all(math.isclose(many[i], few[i], rel_tol=1e-9) for i in many)


def test_op8_marginal_sums_all_segmentations():
    pieces = [b" a", b"b", b"c", b" ab", b"bc", b" ", b"a"]
    weights = np.arange(1.0, 8.0)
    own, p = lm_scoring.Pieces(pieces, weights), dict(zip(pieces, weights / weights.sum(), strict=True))
    text, total = b" abc", 0.0
    for cut in product([0, 1], repeat=3):
        parts, at = [], 0
        for k, c in enumerate(cut, 1):
            if c:
                parts, at = [*parts, text[at:k]], k
        total += math.prod(p.get(x, 0) for x in [*parts, text[at:]])
    rows = np.frombuffer(text, np.uint8)[None, :]
    assert math.isclose(own.marginal(rows, own.log_p)[0], math.log(total))
    assert math.isclose((own.expected(rows, np.ones(1), own.log_p) * [len(x) for x in pieces]).sum(), len(text))


def test_op8_fitting_helps_held_out_text(spark):
    """Pieces fitted to the training words against the vocabulary's own scores. (Against the base
    score the sum is lower: the base gives each of endlessly many unseen words the same share.)"""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted, own = (lm_scoring.score_texts(docs, rounds=k).where("held_out").agg(F.sum("score")).first()[0] for k in (2, 0))
    assert fitted > own


def test_op9_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language_id(spark, SF).join(lang, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_op9_no_letter(spark, docs, rows):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all((got[i] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in rows)


def test_op9_many_and_rare_languages(spark):
    """More languages than a mask has bits, each with few rows beside a common one."""
    rng = random.Random(8)
    vocab = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for _ in range(71)]
    rows = [(i, k, " ".join(rng.choice(vocab[k]) for _ in range(20))) for i, k in enumerate([0] * 6000 + [1 + j % 70 for j in range(70 * 12)])]
    got = language_id.identify(spark.createDataFrame([(i, t, f"l{k:02}") for i, k, t in rows], "doc_id long, text string, lang string"), train_rows=1500).collect()
    assert len(got) == len(rows) and sum(r["lang_pred"] == f"l{rows[r['doc_id']][1]:02}" for r in got) / len(got) > 0.99
    assert {r["lang_pred"] for r in got} == {f"l{k:02}" for k in range(71)}


def test_op9_quota():
    assert language_id.quota([2, 100, 100], 102) == 50 and language_id.quota([5, 7], 100) == 7
    assert language_id.quota([9] * 100, 10) == language_id.LEAST_DOCS and language_id.quota([], 10) == 0


def test_op10_rows_and_slots(docs, rows):
    got = {r["doc_id"]: r for r in sharding.sharded(docs).collect()}
    assert set(got) == {i for i, _ in rows}
    slots, sizes = defaultdict(list), Counter()
    for i, t in rows:
        raw, r = (t or "").encode(), got[i]
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert max(sizes.values()) <= sum(sizes.values()) / 8 + max(r["size"] for r in got.values())


def test_op10_sizes_near_equal(spark):
    sizes = [r["b"] for r in queries.op10_sharding(spark, SF).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8


def test_op10_fewest_bytes():
    rng = random.Random(4)
    for _ in range(20):
        supply = [rng.randrange(0, 5) for _ in range(3)]
        capacity = sharding.even_capacities(sum(supply), 3)
        cost = [[rng.randrange(0, 4) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supply, capacity, cost)
        spent = sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3))
        assert [sum(f) for f in flow] == supply and [sum(x) for x in zip(*flow, strict=True)] == capacity
        ways = [[x for x in product(range(s + 1), repeat=3) if sum(x) == s] for s in supply]
        assert spent == min(sum(x[i][j] * cost[i][j] for i in range(3) for j in range(3)) for x in product(*ways) if all(sum(x[i][j] for i in range(3)) == capacity[j] for j in range(3)))


EACH = {
    "op1": lambda docs, items, labels: substring_dedup.remove_repeats(docs),
    "op2": lambda docs, items, labels: packing.pack_documents(docs),
    "op3": lambda docs, items, labels: decontamination.contained(docs, items),
    "op4": lambda docs, items, labels: ngram_join.linked_components(docs),
    "op5": lambda docs, items, labels: exact_dedup.exact_groups(docs),
    "op6": lambda docs, items, labels: toxicity.score_documents(docs, labels),
    "op7": lambda docs, items, labels: token_binary.token_files(docs),
    "op8": lambda docs, items, labels: lm_scoring.score_texts(docs, rounds=1),
    "op9": lambda docs, items, labels: language_id.identify(docs),
    "op10": lambda docs, items, labels: sharding.sharded(docs),
}


@pytest.mark.parametrize("name", EACH)
@pytest.mark.parametrize("texts", [[], ["one text alone, with some words in it"], [None], [None, "", " \t"], ["a b c d e f", "g h i j k l", "m n"]])
def test_few_rows(spark, name, texts):
    """No row, one, none with a text, texts that have nothing in common."""
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t, "en", None, None, "h", 1, 2, "r", 0.5, "s") for i, t in enumerate(texts)], SCHEMA)
    got = [r["doc_id"] for r in EACH[name](docs, items, labels).collect()]
    assert sorted(got) == ([] if name == "op3" else list(range(len(texts))))


def test_op4_far_members_in_blocks(spark, monkeypatch):
    """Long postings without ties, in blocks of a few documents, and hot shingles dealt by document."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "HOT", 8)
    test_op4_group_with_far_members(spark, 0, monkeypatch)


def test_op4_frequencies(spark):
    """Counts of all tasks are added up."""
    rows = [(i, f"start{i} " + "a b c d e f g" if i < 40 else f"other{i} x y z") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    blocks = ngram_join._signatures(docs, 4).where("kind = 1")
    assert sorted(r["n"] for r in ngram_join._frequencies(blocks).collect()) == [40, 40, 40]


def test_deduplicate_near_copies(docs, rows):
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in joined(rows).items() if i == c}


@pytest.mark.parametrize("deduplicate", [exact_dedup.deduplicate, ngram_join.deduplicate])
def test_deduplicate_repeated_rows_and_null_ids(spark, deduplicate):
    a, b, c, d = ("".join(f"{x}{i} " for i in range(40)) for x in "abcd")
    near = c + "more"
    rows = [(1, a), (1, a), (2, a), (3, b), (None, b), (None, c), (None, c), (4, near), (None, d), (5, "one"), (5, "one")]
    kept = deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(1, a), (3, b), *[(None, c)] * (deduplicate is exact_dedup.deduplicate), (4, near), (None, d), (5, "one")]
    assert kept.columns == ["doc_id", "text"] and sorted(map(tuple, kept.collect()), key=lambda r: r[1]) == want


def test_op5_groups_without_ids(spark):
    got = exact_dedup.exact_groups(spark.createDataFrame([(None, "x"), (None, "x"), (None, "y"), (4, "y")], "doc_id long, text string")).collect()
    assert sorted((r["text_sha256"] == hashlib.sha256(b"x").hexdigest(), r["doc_id"] is None, r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] is not None) == [(False, False, 4, 2, True)]
    assert Counter((r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] is None) == {(None, 2, None): 2, (4, 2, None): 1}


BIG = 9007199254740993  # no float64 has this value


@pytest.mark.parametrize("name", ["op2", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_rows_without_doc_id(spark, name):
    """A row for each document, with its own id or none."""
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([(BIG, 1), (None, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    own = [BIG, None, None, 3, 4, None]
    docs = spark.createDataFrame([(i, t, "en", None, None, "h", 1, 2, "r", 0.5, "s") for i, t in zip(own, ["some words here", "other words", None, "words", "", "other words"])], SCHEMA).repartition(2)
    got = [r["doc_id"] for r in EACH[name](docs, items, labels).collect()]
    assert sorted(got, key=lambda x: x or 0) == [None, None, None, 3, 4, BIG]


def test_op3_items_and_documents_that_share_ids_or_have_none(spark):
    a, b = ("".join(f"{x}{i} " for i in range(9)) for x in "ab")
    items = spark.createDataFrame([(7, a), (7, b), (None, a), (None, a), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see " + a), (2, b), (None, b + " x"), (None, "none of it here at all"), (1, "another text with id one")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_shared"]) for r in decontamination.contained(docs, items).collect()), key=str)
    assert got == sorted([(1, 7, 5), (1, None, 5), (2, 7, 5), (None, 7, 5)], key=str)
    kept = decontamination.decontaminate(docs, items).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"]) == [(1, "another text with id one")] and len(kept) == 2
