"""Near-dedup, decontamination, language, quality and the pipeline against plain versions, held-out rows and planted cases."""

import collections
import itertools
import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from socklens.llm import bagminhash, decontaminate, language, near_dedup, quality, shared
from socklens.llm.queries import QUERIES
from socklens.llm.words import Words, mix
from tests.llm.conftest import SCHEMA, awkward, prose

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def plain_shingles(text):
    words = plain_words(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return pd.Series(runs, dtype=object).value_counts().to_dict() if runs else {}


def plain_overlap(a, b):
    common = sum(min(n, b.get(k, 0)) for k, n in a.items())
    union = sum(a.values()) + sum(b.values()) - common
    return common / union if union else 0.0


def test_words_and_shingles_match_plain_ones():
    texts = [(t or "").lower() for _, t, *_ in awkward()]
    words = Words(pa.array(texts))
    plain = [plain_words(t) for t in texts]
    assert np.diff(words.first).tolist() == list(map(len, plain))
    names: dict = {}
    assert all(names.setdefault(w, h) == h for w, h in zip(itertools.chain(*plain), words.hash.tolist()))
    assert len(set(names.values())) == len(names)
    hashes, first = words.shingles(5)
    for text, a, b in zip(texts, first[:-1], first[1:]):
        assert sorted(pd.Series(hashes[a:b]).value_counts().tolist()) == sorted(plain_shingles(text).values())


def test_signatures_agree_as_often_as_the_weighted_similarity_says():
    rng = np.random.default_rng(4)
    for most in (1, 3, 40):
        elements = np.unique(rng.integers(0, 1 << 62, 250, dtype=np.uint64))
        a = rng.integers(0, most + 1, len(elements))
        b = np.where(rng.random(len(elements)) < 0.3, rng.integers(0, most + 1, len(elements)), a)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = []
        for turn in range(60):
            e = mix(elements + np.uint64(turn * 101))
            same.append((bagminhash.signature(e[a > 0], a[a > 0], 140) == bagminhash.signature(e[b > 0], b[b > 0], 140)).mean())
        assert abs(np.mean(same) - want) < 4 * np.std(same) / 60**0.5 + 1e-9


def changed(text, every, start=0):
    words = text.split()
    words[start::every] = [f"new{i}" for i in range(len(words[start::every]))]
    return " ".join(words)


def plain_classes(rows, similarity=0.8):
    sets = [plain_shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or plain_overlap(sets[i], sets[j]) >= similarity:
            part = [part[i] if p == part[j] else p for p in part]
    out = {}
    for p in set(part):
        ids = [rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None]
        out.update({i: (min(ids, default=None), part.count(p)) for i in range(len(rows)) if part[i] == p})
    return [(rows[i][0], *out[i]) for i in range(len(rows))]


def test_near_duplicates_match_all_pairs(spark, docs, no_docs):
    base = prose(21, 300)
    chain = [base]  # each close to the next, the ends far apart
    for k in range(6):
        chain.append(changed(chain[-1], 60, 7 * k))
    group = [changed(prose(22, 400), 90, k) for k in range(25)] + [prose(22, 400)]
    far = [changed(prose(23, 300), 12, k) for k in range(6)] + [prose(23, 300).upper()]
    repeated = ["same line again and again here. " * 30, "same line again and again here. " * 27, "same line again and again here. " * 12]
    rows = [(i + 100, t) for i, t in enumerate([*chain, *group, *far, *repeated, prose(23, 300)])] + [(r[0], r[1]) for r in awkward()]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("mine"))
    found = near_dedup.near_duplicates(table).collect()
    got = sorted(str((r.doc_id, r.class_id, r.class_size)) for r in found)
    assert got == sorted(map(str, plain_classes(rows)))
    kept = [r for r in found if r.kept]
    assert {r.class_id for r in kept} == {r.class_id for r in found}
    assert len({r.doc_id for r in kept}) == len({r.class_id for r in found})
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets = [plain_shingles(t) for _, t in rows]
    holds: dict = {}
    for n, s in enumerate(sets):
        for k in s:
            holds.setdefault(k, []).append(n)
    pairs = {p for held in holds.values() if len(held) <= 60 for p in itertools.combinations(held, 2)}
    linked = {(rows[i][0], rows[j][0]) for i, j in pairs if plain_overlap(sets[i], sets[j]) >= 0.8}
    classes = {r.doc_id: r.class_id for r in QUERIES["op1_near_dedup"](spark, SF).collect()}
    assert len(classes) == len(rows) and all(classes[a] == classes[b] for a, b in linked) and linked


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_decontamination_finds_planted_passages_only(spark, items, docs, no_docs):
    texts = {r.item_id: r.text for r in items.collect()}
    some = sorted(texts)[:12]
    rows, want = [], {}
    for n, i in enumerate(some):
        words = texts[i].split()
        # whole, in capitals, with every tenth word changed, with words put in between; and a first third, which is not enough
        for k, t in enumerate([texts[i], texts[i].upper(), changed(texts[i], 10, 3), " ".join(w if j % 9 else w + " uh" for j, w in enumerate(words))]):
            rows.append((n * 10 + k, prose(n + 50, 37 + n) + " " + t + " " + prose(n + 70, 200 + n)))
            want[n * 10 + k] = i
        rows.append((n * 10 + 9, prose(n, 100) + " ".join(words[: len(words) // 3]) + prose(n + 9, 100)))
    rows += [(1000 + n, prose(n, 500)) for n in range(30)] + [(None, None), (None, "")]
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1)), items)
    got = {r.doc_id: {h.item_id for h in r.hits} for r in found.collect() if r.hits}
    assert got == {d: {i} for d, i in want.items()}
    short = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "some words that are five")], "item_id long, text string")
    assert decontaminate.find_contamination(docs, short).where(F.size("hits") > 0).count() == 0
    assert decontaminate.find_contamination(docs, short.limit(0)).count() == docs.count()
    assert decontaminate.find_contamination(no_docs, items).count() == 0


def plain_hits(rows, texts):
    """(doc, item) by the checks alone, over every window of every document."""
    stride, found = decontaminate.STRIDE, set()
    for (doc, text), (item, own) in itertools.product(rows, texts.items()):
        words, own = plain_words(text), plain_words(own)
        length = -(-(len(own) + stride - 1) // stride) * stride
        answer = own[-max(3, round(decontaminate.ANSWER * len(own))) :]
        for begin in range(0, len(words), stride):
            here = words[max(0, begin - stride) : begin + length + stride]
            common = [0] * (len(own) + 1)
            for w in here:
                for j, (o, old) in enumerate(zip(own, common[:]), 1):
                    common[j] = max(old + 1 if w == o else 0, common[j], common[j - 1])
            share = common[-1] / len(own)
            answered = any(here[i : i + len(answer)] == answer for i in range(len(here)))
            if share >= decontaminate.SURE or share >= decontaminate.PARAPHRASE and answered:
                found.add((doc, item))
    return found


def test_decontamination_equals_the_checks_on_every_window(spark):
    def rare(seed, n):
        return " ".join(f"z{seed}q{i}" for i in range(n))

    often = [prose(400 + k, 40).replace(".", "") for k in range(3)]
    common = "the of and to in is it that for was on as with his they be at one have this".split()
    texts = {0: often[0], 1: " ".join(common), 2: often[1], 3: often[2], 4: prose(410, 90), 5: "of the of the and of the of the and"}
    rows = [(n, f"{rare(n, 21 + n)} {often[0]} {rare(n + 900, 60)}") for n in range(30)]  # a third of all documents
    rows += [(100 + n, f"{rare(n, 30 + n)} {texts[1]} {rare(n + 900, 50)}") for n in range(5)]
    rows += [(200 + n, " ".join(common[(i * 7 + n) % 20] for i in range(150))) for n in range(20)]
    for n, every in enumerate((2, 3, 4, 5, 6) * 3):  # paraphrases with the answer
        own = texts[2 + n % 3].split()
        head = changed(" ".join(own[: -len(own) // 4]), every, n % 2)
        rows.append((300 + n, f"{rare(n, 17 + 3 * n)} {head} {' '.join(own[-len(own) // 4 :])} {rare(n + 900, 40)}"))
    rows += [(400 + n, f"{prose(n, 100)} of the {rare(n, 9)}") for n in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_contamination(table, spark.createDataFrame(list(texts.items()), "item_id long, text string")).collect()
    want = plain_hits(rows, texts)
    assert {(r.doc_id, h.item_id) for r in found for h in r.hits} == want
    assert {(n, 0) for n in range(30)} | {(100 + n, 1) for n in range(5)} <= want and len({d for d, _ in want if 300 <= d < 400}) > 8


def block_of(texts):
    hashes = [(i, Words(pa.array([t])).hash) for i, t in texts.items()]
    features = np.concatenate([decontaminate.features(h) for _, h in hashes])
    place = np.zeros(1 << decontaminate.FEATURE_BITS, np.int32)
    space = decontaminate.Space(place, np.zeros((1, 0), np.float32))
    return decontaminate._block(hashes, space, np.bincount(features, minlength=len(place))), space


def test_decontamination_takes_no_step_for_a_window_without_the_answer():
    item = [f"w{i}" for i in range(40)]
    block, space = block_of({7: " ".join(item)})
    # three fifths of the item again and again, the words of its answer among them, but not side by side
    part = " ".join([*item[:16], *item[:31:-1]])
    text = " ".join([part] * 400)
    strides = decontaminate.Strides(Words(pa.array([text, text + " " + " ".join(item), ""])), space)
    calls = collections.Counter()
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        found = decontaminate.search(strides, block)
    finally:
        sys.setprofile(None)
    assert [(t, i, common, answer) for t, i, _, common, answer in found] == [(1, 7, 1.0, True)]
    assert len(strides.owner) > 1000 and calls["call"] < 1000


def test_answers_stand_where_a_plain_search_finds_them(monkeypatch):
    head = "p q r s t u v w x y"
    # an answer within another, of two items, of one word, of many words
    texts = {0: f"{head} a b c", 1: f"{head} {head} a b c", 2: f"z {head} a b c", 3: "a a a a a", 4: f"{head} " * 9 + "y a b c"}
    block, _ = block_of(texts)
    rows = ["y a b c a b c", "a b", "c a a a a a a", "", "b c", f"{head} a b c {head} " * 3, f"{head} " * 9 + "y a b c"]
    words = Words(pa.array(rows))
    want, answers = set(), {tuple(t.split()[-decontaminate.Block.answer_words(t.split()) :]) for t in texts.values()}
    for first, row in zip(words.first.tolist(), rows):
        own = row.split()
        want |= {(a, first + i, first + i + len(a)) for a in answers for i in range(len(own)) if tuple(own[i : i + len(a)]) == a}
    spoken = {tuple(Words(pa.array([" ".join(a)])).hash.tolist()): a for a in answers}
    sizes = zip(block.stop - block.size, block.stop)
    names = [spoken[tuple(block.spoken[begin:end].tolist())] for begin, end in sizes]
    for at_once in (decontaminate.MASKED, 1):
        monkeypatch.setattr(decontaminate, "MASKED", at_once)
        got = [(names[a], b, e) for a, b, e in zip(*(c.tolist() for c in block.answers(words)))]
        assert len(got) == len(set(got)) and set(got) == want and {len(a) for a, _, _ in want} == {len(a) for a in answers}


def test_decontamination_of_the_table_misses_no_passage(spark, items):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.join(items.select("item_id", F.col("text").alias("t")), F.lower("text").contains(F.lower("t")))
    want = {(r.doc_id, r.item_id) for r in held.select("doc_id", "item_id").collect()}
    rows = QUERIES["op8_decontamination"](spark, SF).collect()
    assert want and want <= {(r.doc_id, i) for r in rows for i in r.item_ids} and len(rows) == docs.count()
    assert all(r.contaminated == bool(r.item_ids) for r in rows)


def test_decontamination_finds_paraphrases_in_other_words_by_the_latent_space(spark):
    rng = np.random.default_rng(1)

    def speak(topic, n, ways="ab"):  # two words for everything, and writers take either
        return [f"t{topic}c{rng.integers(40)}{ways[rng.integers(len(ways))]}" for _ in range(n)]

    texts = {k: speak(k, 20 + 3 * k, "a") for k in range(12)}
    rows = [(10000 + k, " ".join(speak(k % 12, 150))) for k in range(600)]
    for k, own in texts.items():
        cut, away = len(own) - max(3, round(decontaminate.ANSWER * len(own))), (k + 5) % 12
        said = [[w[:-1] + "b" for w in own[:cut]] + own[cut:], speak(away, cut) + own[cut:], [w[:-1] + "b" for w in own]]
        # a paraphrase with the answer, the answer among foreign words, a paraphrase without the answer
        rows += [(k * 10 + n, " ".join([*speak(away, 30), *t, *speak(away, 60)])) for n, t in enumerate(said)]
    # an answer of words so common that they stand side by side by chance
    common = "this is the".split()
    texts[12] = speak(0, 14, "a") + common
    rows += [(20000 + n, " ".join([*speak(0, 40, "b"), *common, *(w for own in speak(0, 60, "b") for w in (own, rng.choice(common)))])) for n in range(40)]
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "item_id long, text string")
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), items).collect()
    hits = {(r.doc_id, h.item_id): h for r in found for h in r.hits}
    want = {(k * 10, k) for k in range(12)}
    assert set(hits) <= want and len(hits) >= 11
    assert all(h.lcs < decontaminate.PARAPHRASE and h.answer and h.cosine >= decontaminate.COSINE for h in hits.values())


def test_decontamination_fits_the_space_to_all_of_every_text(spark):
    rng = np.random.default_rng(6)
    every, each = decontaminate.PASSAGE, 32

    def speak(topic, n, ways="ab"):
        return [f"t{topic}c{rng.integers(40)}{ways[rng.integers(len(ways))]}" for _ in range(n)]

    # every fourth passage from the first on, eight of a text, says nothing of what the others do
    rows = [(1000 + k, " ".join(w for n in range(each) for w in (speak(k % 12, every) if n % 4 else speak(90 + k % 3, every)))) for k in range(36)]
    texts = {k: speak(k, 30, "a") for k in range(12)}
    for k, own in texts.items():
        said = [w[:-1] + "b" for w in own[:24]] + own[24:]
        rows.append((k, " ".join([*speak(90, every + 10), *said, *speak(91, every * each)])))
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "item_id long, text string")
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items).collect()
    hits = {(r.doc_id, h.item_id) for r in found for h in r.hits if r.doc_id < 1000}
    assert hits <= {(k, k) for k in texts} and len(hits) >= 11


def test_passages_are_all_of_every_text_and_copies_count_once(spark):
    rng = np.random.default_rng(7)
    long = " ".join(f"w{n}" for n in rng.integers(0, 3000, 5000))
    texts = [long, "a b a", "", *(prose(n, 20 + 9 * n).replace(".", "") for n in range(1500))]
    rows = [(n % 2 == 0, t) for n, t in enumerate(texts)] + [(True, t) for t in texts[:9:2] + [long] * 5] + [(False, long)]
    table = shared.stash(decontaminate.passages(spark.createDataFrame(rows, "item boolean, text string").repartition(5)), "test")
    idf = 0.5 + rng.random(1 << decontaminate.FEATURE_BITS)
    want, every = collections.Counter(), decontaminate.PASSAGE
    for text in [long, *texts]:
        feature = decontaminate.features(Words(pa.array([text])).hash)
        for begin in range(0, len(feature), every):
            kinds, times = np.unique(feature[begin : begin + every], return_counts=True)
            weight = times * idf[kinds]
            want[tuple(zip(kinds.tolist(), (weight / np.linalg.norm(weight)).round(4).tolist()))] += 1
    got = collections.Counter()
    first = decontaminate.first_copies(table)
    for batch in table.select("id", *decontaminate.PACKED).toArrow().to_batches():
        feature, weight, size = decontaminate.packed(batch, idf, first)
        ends = np.cumsum(size)
        for begin, end in zip(ends - size, ends):
            got[tuple(zip(feature[begin:end].tolist(), weight[begin:end].round(4).tolist()))] += 1
    assert sum(want.values()) > 100000 // every
    # weights may be rounded apart, features are not
    assert collections.Counter([tuple(f for f, _ in p) for p in got.elements()]) == collections.Counter([tuple(f for f, _ in p) for p in want.elements()])
    assert sum((got - want).values()) <= 0.05 * sum(want.values())


def test_rows_are_added_up_whatever_the_length_of_a_sum(monkeypatch):
    rng = np.random.default_rng(8)
    size = np.array([1, 2, 63, 64, 65, 1, 64 * 64, 64 * 64 + 1, 9, 20000])
    table, row, weight = rng.standard_normal((50, 3)), rng.integers(0, 50, size.sum()), rng.random(size.sum())
    for at_once in (decontaminate.SUMMED_AT_ONCE, 7):
        monkeypatch.setattr(decontaminate, "SUMMED_AT_ONCE", at_once)
        want = np.add.reduceat(table[row] * weight[:, None], np.cumsum(size) - size)
        assert np.allclose(decontaminate.row_sums(table, row, weight, size), want)
    assert not decontaminate.orthonormal(np.zeros((4, 2))).any()


def test_svd_spans_the_items(spark):
    rng = np.random.default_rng(2)
    rows = [(sorted(rng.choice(60, 8, replace=False).tolist()), rng.random(8).tolist()) for _ in range(10)]
    support = np.unique([f for r in rows for f in r[0]])
    table = spark.createDataFrame(rows, "features array<long>, weights array<double>").repartition(3)
    basis = decontaminate.randomised_svd(table, support, 10)
    dense = np.zeros((10, len(support)))
    for n, (f, w) in enumerate(rows):
        dense[n, np.searchsorted(support, f)] = w
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-8)


def test_language_costs_match_the_definition():
    rng = np.random.default_rng(3)
    texts = {"aa": b"abracadabra abra " * 9, "bb": b"bacbac cabbab " * 9}
    grams: dict = {}
    for lang, t in texts.items():
        for n in range(1, language.ORDER + 2):
            for i in range(len(t) - n + 1):
                grams[lang, t[i : i + n]] = grams.get((lang, t[i : i + n]), 0) + 1
    model = language.build(pd.DataFrame([(a, g, n) for (a, g), n in grams.items()], columns=["lang", "gram", "n"]), 5)
    total = {g: sum(n for (_, h), n in grams.items() if h == g) for _, g in grams}
    kept = {b""} | {g for g, n in total.items() if len(g) <= language.ORDER and (len(g) == 1 or n >= 5)}

    def chance(lang, context, letter):
        seen = {h[-1:]: n for (a, h), n in grams.items() if a == lang and h[:-1] == context and len(h) == len(context) + 1}
        shorter = 1 / 256 if not context else None
        if letter in seen:
            return seen[letter] / (sum(seen.values()) + len(seen))
        rest = shorter if shorter is not None else chance(lang, context[1:], letter)
        return rest * (len(seen) / (sum(seen.values()) + len(seen)) if seen else 1.0)

    samples = [b"", b"abra", b"cab zzz cab", bytes(rng.choice(list(b"abcr dz"), 2500).tolist())]
    ends = np.cumsum([0, *map(len, samples)])
    got = model.bits(np.frombuffer(b"".join(samples), np.uint8), ends)
    for row, sample in zip(got, samples):
        for n, lang in enumerate(model.languages):
            bits = 0.0
            for i in range(len(sample)):
                context = sample[max(0, i - language.ORDER) : i]
                while context not in kept:
                    context = context[1:]
                bits -= np.log2(chance(lang, context, sample[i : i + 1]))
            assert abs(bits - row[n]) < 1e-3 * max(1.0, bits)


def test_pieces_learnt_come_from_the_whole_text():
    texts = [bytes([i % 256 for i in range(n)]) * 3 for n in (0, 1, 499, 500, 501, 20_000)]
    for data in texts:
        cut = language.spread_pieces(data)
        assert len(cut) == min(language.TRAIN_PIECES, -(-len(data) // 500)) and all(p in data and len(p) <= 500 for p in cut)
        assert cut == language.spread_pieces(data)
    starts = [prose(seed, 4000).encode().find(p) for seed in range(40) for p in language.spread_pieces(prose(seed, 4000).encode())]
    assert min(starts) < 3000 and max(starts) > 15_000 and np.mean(np.array(starts) > 2000) > 0.6


def test_language_of_held_out_rows(spark, docs, no_docs):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language_id"](spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    model = language.train(docs.where("lang in ('en', 'fr')"))
    got = {(r.doc_id, r.text): r for r in language.predict(docs.withColumn("score", F.lit("mine")), model).collect()}
    for (_, text), r in got.items():
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0)
    nothing = language.train(no_docs)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(no_docs, model).count() == 0


def test_quality_on_labels_it_has_not_seen(spark, docs, no_docs):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.train(table, labels.where(~held))
    rows = quality.classify(table.join(labels.where(held), "doc_id"), model).select("kept", "quality", "toxic").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    clash = docs.withColumn("kept", F.lit("mine"))
    got = quality.classify(clash, model).collect()
    assert len(got) == len(awkward()) and all(0 <= r.quality_score <= 1 for r in got)
    assert quality.classify(no_docs, model).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1 and toxic = 0").limit(30)):
        assert all(r.kept for r in quality.classify(docs, quality.train(table, few)).collect())


def test_metadata_cells_tell_whole_values_apart():
    sources = ["web-a", "web-b", "www.x.com", "www.y.com", "www.x.com/", "Web-a", "", None, "null", "-", "名-1"]
    langs = ["en-GB", "en-US", "en", None, "null", "", "EN", "-", "fr", "fr-CA", "fr-FR"]
    cells = quality.meta_features(pa.array(sources), pa.array(langs), np.full(len(sources), 100))
    assert len(set(cells[:, 0].tolist())) == len(sources) and len(set(cells[:, 1].tolist())) == len(langs)
    assert len(set(cells[:, 2].tolist())) == 1
    again = quality.meta_features(pa.array(sources[::-1]), pa.array(langs[::-1]), np.full(len(sources), 100))
    assert (again[::-1] == cells).all() and cells.max() < 1 << quality.META_BITS
    assert quality.meta_features(pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0)).shape == (0, 3)


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_duplicates", "decontamination", "byte_level_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stash(stage(spark, docs, SF), "test")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "byte_level_bpe":
            assert docs.columns == columns
        if name == "exact_dedup":
            assert kept[name] == {r.i for r in before.groupBy("text").agg(F.max("doc_id").alias("i")).collect()}
    assert kept["byte_level_bpe"] == kept["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept["byte_level_bpe"]


def test_pipeline_stages_on_awkward_rows(spark, docs, no_docs):
    for table in (docs.withColumn("score", F.lit("mine")), no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert name == "byte_level_bpe" or out.columns == table.columns
            assert out.count() <= table.count()
    assert SCHEMA.names == no_docs.columns
