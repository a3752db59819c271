import cProfile
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.llm import langid, leaks, mixing, names, readability, sentences, splitting


def pieces_of(text):
    (ends,) = sentences.sentence_ends([text])
    starts = [0, *ends[:-1]]
    return [text[a:b].strip() for a, b in zip(starts, ends)]


@pytest.mark.parametrize("text,n", [
    ('Mr. Nirar Jr., said: "We wait." Then he left at 10.30 a.m. each day.', 2), ("See Fig. 9 and Sect. 9.9 of the guide. The voltage fell to 9.9 V ... and then it came back.", 2),
    ("Am 9. April kam die 9. Lieferung, z. B. bis 9.30 Uhr. Wir putzen in Gang 9. Der Stapler wartet.", 3), ("他说：“我们等一等。”电压降到177.5伏……随后又恢复了。“门开了吗？”主管在9:9问道。", 3),
    ("قال: «ننتظر قليلا.» اضغط الزر. انخفض الجهد إلى 9.9 فولت ... ثم عاد.", 3), ("پہلے دبائیں۔ ’’کیا دروازہ کھلا ہے؟‘‘ نگران نے پوچھا۔", 2),
    ("X Y S.A. builds it. It is made by X Y S.A. The end.", 3), ("one line\nanother", 2), ("", 0), (" \n ", 0),
])
def test_sentences(text, n):
    assert len(pieces_of(text)) == n


def test_sentences_are_whole_and_do_not_depend_on_the_batch():
    r = random.Random(5)
    texts = ["".join(r.choice(["Dr. ", "a. ", "B ", "。", "“", "”", "...", "\n", "(x.) ", "9.5 ", "! ", "ab"]) for _ in range(r.randrange(300))) for _ in range(60)]
    together = sentences.sentence_ends(texts)
    for text, ends in zip(texts, together):
        assert list(sentences.sentence_ends([text])[0]) == list(ends)
        assert (not text.strip() and not len(ends)) or ends[-1] == len(text.rstrip())
        assert all(a < b for a, b in zip(ends, ends[1:]))


def test_prefix_scan_equals_one_step_after_another():
    to, out = sentences.transducer()
    r = np.random.default_rng(1)
    found = r.integers(0, sentences.SYMBOLS, 1000).astype(np.uint8)
    state, expected = sentences.START, []
    for k, symbol in enumerate(found.tolist()):
        if out[state * sentences.SYMBOLS + symbol]:
            expected.append(k)
        state = int(to[state * sentences.SYMBOLS + symbol])
    assert list(sentences._run(found)) == expected


def test_splitting_round_trip(spark):
    text = "# Head\n\n" + " ".join(f"Sentence number {k} stands here." for k in range(200)) + "\n\n## Next\n" + "x" * 2500
    items = spark.createDataFrame([("t", "1", None, text), ("t", "2", "own", "short"), ("t", "3", None, ""), ("t", "4", None, None)], "item_table string, item_id string, heading string, text string")
    rows = splitting.split_items(items).orderBy("item_id", "position").collect()
    one = [r for r in rows if r["item_id"] == "1"]
    assert all(r["n_chars"] <= 900 and r["overlap_chars"] <= 150 for r in rows)
    assert "".join(r["text"][r["overlap_chars"] :] for r in one) == text
    assert one[0]["heading"] == "Head" and one[-1]["heading"] == "Next"
    assert [(r["item_id"], r["heading"]) for r in rows if r["item_id"] != "1"] == [("2", "own")]
    with pytest.raises(ValueError):
        splitting.split_items(items, 100, 100)


def test_no_cut_within_flags_and_joined_signs():
    flags, family = "\U0001f1e9\U0001f1ea" * 30, "\U0001f469\u200d\U0001f467" * 30
    at = splitting.boundary_strengths(flags, np.array([len(flags)]))
    assert [x == splitting.INSIDE for x in at[1:60].tolist()] == [k % 2 == 0 for k in range(59)]
    at = splitting.boundary_strengths(family, np.array([len(family)]))
    assert all((at[k] == splitting.INSIDE) == (k % 3 != 0) for k in range(1, 89))


def test_pfair_stays_within_a_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    period, slots = mixing.pfair_period(weights)
    assert sorted(s for own in slots.values() for s in own) == list(range(period))
    for source, own in slots.items():
        for t in range(period + 1):
            assert abs(sum(s < t for s in own) - weights[source] * t) < 1


def test_mixing(spark):
    docs = spark.createDataFrame([(k, "A" if k < 40 else "b ", "w " * (10 + k % 5)) for k in range(60)] + [(90, "other", "w"), (91, None, "w"), (92, "a", None)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("b", 0.5, 2), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    counter = F.udf(lambda t: len(t.split()) if t else 0, "long")
    mix = mixing.mix_sources(docs, targets, counter, block_tokens=16)
    shares = {r["source"]: r for r in mixing.actual_shares(mix, targets).collect()}
    assert abs(shares["a"]["actual_share"] - 0.5) < 0.03 and shares["b"]["most_repeats"] <= 2 and shares["none"]["n_docs"] == 0
    assert mix.where("doc_id >= 90").count() == 0
    assert mix.groupBy("doc_id", "repeat_no").count().where("count > 1").count() == 0
    assert mixing.mix_sources(docs.limit(0), targets, counter).count() == 0


ITEMS = [(1, "How many carts did Nopobol Metece report near lane DT-50006?", "Night readings from Tunupas Bicizox averaged 380.2 volts. The ledger at Nopobol Metece lists 8252 hours under permit VS-44809."), (2, "Another question of Abc Def about XY-777?", "Night readings from Tunupas Bicizox averaged 380.2 volts. The ledger at Nopobol Metece lists 8252 hours under permit VS-44809."), (3, None, None)]
# items of the same kind about other names and figures: their words are no evidence
ITEMS += [(k, f"How many carts did Sosanu Tem{k}ik report near lane AB-9{k}?", f"Night readings from Lomip Gav{k}or averaged {k}1.5 volts. The ledger at Sosanu Tem{k}ik lists 77{k} hours under permit QQ-8{k}1.") for k in range(20, 32)]


def test_leaks(spark):
    docs = [(10, "Intro. THE LEDGER AT NOPOBOL METECE LISTS 8252 HOURS UNDER PERMIT VS 44809. Other. *Night&nbsp;readings from Tunupas Bicizox averaged 380.2 volts.*"), (11, "Night readings from Other Name averaged 11.9 volts. The ledger at Some Body lists 12 hours under permit AA-1."), (12, "How many carts did Nopobol Metece report near lane DT-50006?"), (13, "The ledger at Nopobol Metece lists 8252 hours under permit VS-44809."), (14, None), (15, "")]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, question string, passage string"))
    assert sorted((r["item_id"], r["doc_id"]) for r in got.collect()) == [(1, 10), (1, 12), (2, 10)]


def test_leaks_in_many_copies_are_no_stock(spark):
    others = [[f"Part {w}{k} of this text is about {w} matters." for w in "abcdefgh"] for k in range(60)]
    plain = ["The old cart waits quietly near the door.", "Nobody knows when the green gate opens."]
    items = [*ITEMS, *((k, None, " ".join(plain)) for k in range(40, 45))]
    leaked = ITEMS[0][2]
    docs = []
    for k in range(60):
        # near copies, each with one sentence of its own edited
        own = list(others[0])
        own[k % 8] = f"Edited {k} stands here."
        docs.append((k, " ".join([*own[:4], leaked, *own[4:]])))
        docs.append((100 + k, " ".join([*own[:4], *plain, *own[4:]])))
        docs.append((200 + k, " ".join([*others[k], ITEMS[0][1]])))
        # the same passage in texts that have nothing else in common is stock
        docs.append((300 + k, " ".join([*others[k], ITEMS[3][2]])))
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, passage string"))
    expected = [(i, k) for i in (1, 2) for k in range(60)] + [(1, 200 + k) for k in range(60)] + [(i, 100 + k) for i in range(40, 45) for k in range(60)]
    assert sorted((r["item_id"], r["doc_id"]) for r in got.collect()) == sorted(expected)


def test_leaks_do_not_depend_on_the_number_of_shards(spark):
    docs = spark.createDataFrame([(k, f"Some text {k}. " + (ITEMS[k % len(ITEMS)][2] or "")) for k in range(40)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, question string, passage string")
    got = [sorted((r["item_id"], r["doc_id"], r["n_sentences"]) for r in leaks.find_leaks(docs, items, shard_sentences=n).collect()) for n in (100_000, 7)]
    assert got[0] == got[1] and len(got[0]) > 20


def test_a_plain_pair_in_many_documents_is_no_stock_but_a_common_opener_is(spark):
    r = random.Random(8)
    plain = "The old cart waits quietly near the door. Nobody knows when the green gate opens."
    opener = "Please read the whole page before you begin."
    items = [(k, None, f"{opener} {ITEMS[k - 20 + 3][2]}") for k in range(20, 26)] + [(99, None, plain)]
    docs = [(k, " ".join(f"Part {r.random()} of {r.random()}." for _ in range(5)) + (f" {plain}" if k % 400 == 0 else "") + (f" {opener} {ITEMS[3][2].split('. ')[0]}." if k == 7 else "")) for k in range(20_000)]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, passage string"))
    assert sorted((r["item_id"], r["doc_id"]) for r in got.collect()) == [(99, k) for k in range(0, 20_000, 400)]


@pytest.mark.parametrize("text", ["انخفض الجهد إلى", "Привет мир", "Καλημέρα"])
def test_cleaning_keeps_letters(text):
    assert len(leaks.cleaned(text).replace(" ", "")) == len(text.replace(" ", ""))


def test_block_max_wand_finds_all_that_a_full_scan_finds():
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(300):
        own = sorted(set(r.choices(vocabulary, k=r.randrange(3, 12))))
        w = [r.random() + 0.1 for _ in own]
        rows.append((k, False, [(t, x / sum(w), False) for t, x in zip(own, w)]))
    index = leaks.ItemIndex(rows)
    for _ in range(60):
        query = set(r.choices(vocabulary, k=8))
        full = {}
        for t in query & set(index.docs):
            for s, w in zip(index.docs[t], index.impact[t]):
                full[s] = full.get(s, 0) + w
        assert {s for s, _ in index.search(query, 0.5)} == {s for s, w in full.items() if w >= 0.5 + 1e-9} | {s for s, w in full.items() if abs(w - 0.5) <= 1e-9 and s in dict(index.search(query, 0.5))}


def test_names(spark):
    customers = spark.createDataFrame([(1, "Bofojel Welude Robotics Inc"), (2, "BOFOYEL WELUDE, ROBOTICS"), (3, "Welude Bofojel Rob. Incorporated"), (4, "Bofojel Sehula Robotics Ltd"), (5, None), (6, " "), (1, "Bofojel Welude Robotics Inc"), (7, "Bofojel Welude Foods")], "id long, name string")
    entities = spark.createDataFrame([(11, "Theodor Tuvanes-Biguhux", "PERSON"), (12, "Teddy  Tuvanes-Biguhxu", "PERSON"), (13, "Antonia Tuvanes-Biguhux", "PERSON"), (14, "Zeguvan M4", "PRODUCT")], "entity_no long, name string, type string")
    mentions = spark.createDataFrame([(100, None, "TUVANES-BIUHUX, TEHODOR"), (101, "x", "Theodor Tuvanes-Biguhux"), (102, None, "Zeguvan M4")], "mention_id long, entity_id string, surface string")
    got = sorted(tuple(r) for r in names.name_pairs(customers, entities, mentions).collect())
    assert got == [("customer", 1, 2), ("customer", 1, 3), ("customer", 2, 3), ("entity", 11, 12), ("mention", 11, 100), ("mention", 12, 100)]
    assert names.name_pairs(customers.limit(0), entities.limit(0), mentions.limit(0)).count() == 0


def _linked(spark, names_, **settings):
    rows = names.link_names(spark.createDataFrame([("s", n) for n in names_], "space string, name string"), **settings).collect()
    return {r["name"]: r["class_id"] for r in rows}


def test_every_name_keeps_a_class(spark):
    odd = ["BMW AG", "BMW", "Ford Inc", "3M Company", "3M", "7-Eleven Inc", "Studio 54 GmbH", "Studio 55 GmbH", "Robert Park", "Hyde Park Foods Ltd", "李伟", "GmbH", "Dr.", "Zeguvan M4", "Zeguvan M5", "Zeguvan Foods", "x", "=", "a|b", "Antonia"]
    got = _linked(spark, [*odd, *odd, None, " "])
    assert set(got) == set(odd)
    assert got["BMW AG"] == got["BMW"] and got["3M Company"] == got["3M"]
    assert len({got[n] for n in ("BMW AG", "Ford Inc", "3M", "7-Eleven Inc", "Studio 54 GmbH", "Studio 55 GmbH", "Robert Park", "Hyde Park Foods Ltd", "李伟", "Zeguvan M4", "Zeguvan M5", "Zeguvan Foods")}) == 12


def test_names_without_the_word_lists_of_the_data(spark):
    got = _linked(spark, ["Deutsche Bank AG", "Deutsche Bahn AG", "DEUTSCHE BANK", "Müller Bau GmbH", "Mueller Bau", "Bob Hanselmann", "Robert Hanselmann", "Bill Hanselmann", "William Hanselman"])
    assert got["Deutsche Bank AG"] == got["DEUTSCHE BANK"] != got["Deutsche Bahn AG"]
    assert got["Müller Bau GmbH"] == got["Mueller Bau"]
    assert got["Bob Hanselmann"] == got["Robert Hanselmann"] != got["Bill Hanselmann"] == got["William Hanselman"]
    none = names.Words({}, "", {}, "", "")
    got = _linked(spark, ["Bofojel Welude", "Welude Bofoyel", "Bofojel Welude Systems", "Sehula Bofojel"], words=none)
    assert got["Bofojel Welude"] == got["Welude Bofoyel"] != got["Sehula Bofojel"]


def test_large_blocks_are_refined_and_lose_no_equal_pair(spark):
    r = random.Random(9)
    made = sorted({"".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)})[:200]
    cores = [f"{w} tanobel" for w in made] + [f"{w[:-1]}x tanobel" for w in made[:50]]
    forms = spark.createDataFrame([(n, "s", c, "", "", "") for n, c in enumerate(cores)], "node long, space string, core string, first string, trade string, codes string")
    pairs = {(x["a"], x["b"]) for x in names.candidate_pairs(forms, common=5).collect()}
    assert {(n, 200 + n) for n in range(50)} <= pairs
    assert len(pairs) < len(cores) * (len(cores) - 1) / 4


def test_ratios_of_many_pairs():
    r = random.Random(4)
    a, b = (["".join(r.choices("abcdé", k=r.choice([0, 3, 7, 12, 30, 61, 90]))) for _ in range(300)] for _ in range(2))
    assert np.allclose(names.ratios(a, b), [names.ratio(x, y) for x, y in zip(a, b)])


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_step(row, b, x)]
        assert names.lcs(a, b) == row[-1]


def _step(row, b, x):
    out, left = [], 0
    for j, y in enumerate(b):
        left = row[j] + 1 if x == y else max(left, row[j + 1])
        out.append(left)
    return out


def test_components(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "f"), ("x", "x")], "a string, b string")
    assert {r["node"]: r["root"] for r in names.connected(spark, links).collect()} == {"a": "a", "b": "a", "c": "a", "f": "a", "d": "d", "e": "d"}


def test_gru_gradients():
    model = langid.ByteGRU(hidden=3, seed=1)
    r = np.random.default_rng(0)
    x, mask, y = r.integers(0, 5, (6, 4)).astype(np.uint8), np.ones((6, 4), np.float32), np.array([0, 1, 2, 3])
    mask[4:, 1] = 0
    _, grads = model.loss_gradients(x, mask, y)
    for w, g in zip(model.weights(), grads):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[k], 1e-2
        w[k] = old + step
        up = model.loss_gradients(x, mask, y)[0]
        w[k] = old - step
        down = model.loss_gradients(x, mask, y)[0]
        w[k] = old
        assert abs((up - down) / (2 * step) - g[k]) < 0.05 * abs(g[k]) + 1e-3


def test_languages_on_held_out_lines(spark):
    made = {"en": "the cart waits at the {} gate and then it turns", "de": "der Wagen wartet am {} Tor und dreht dann um", "zh": "小车在{}号门口等一等然后转弯", "ar": "الرافع ينتظر عند الباب {} ثم يعود إلى هنا", "ur": "گاڑی دروازہ نمبر {} پر رکتی ہے اور پھر واپس آتی ہے"}
    rows = [(n, t.format(w) + "." , code) for n, w in enumerate(["red", "blue", "old", "new", "big"]) for code, t in made.items()]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    units = [("documents", code, "n/a", t.format("far") + ".\nNRS 4170-1\n" + t.format("near") + ".") for code, t in made.items()]
    units += [("documents", "codes", "en", "NRS 4170-1:2015\nVS-44809"), ("documents", "empty", None, ""), ("documents", "null", None, None), ("documents", "mix", "en", made["en"].format("far") + ".\n" + made["zh"].format("9") + "。")]
    df = spark.createDataFrame(units, "unit_table string, unit_id string, label string, text string").withColumn("is_piece", F.lit(False))
    got = sorted((r["unit_id"], r["language"]) for r in langid.detect_languages(df, model).collect())
    assert got == sorted([(c, c) for c in made] + [("mix", "en"), ("mix", "zh")])
    # no other language is one of the five, and a line may change its language
    foreign = ["El carro espera en la puerta verde y después vuelve al almacén.", "Le chariot attend devant la porte et puis il retourne au dépôt.", "Вчера была хорошая погода, и дети гуляли вдоль реки."]
    others = spark.createDataFrame([("documents", str(k), None, x, False) for k, x in enumerate(foreign)], df.schema)
    assert langid.detect_languages(others, model).count() == 0
    line = f"{made['en'].format('far')} 然后等待小车在门口转弯"
    assert [(end, code) for end, code, _ in langid.line_parts(model, [line])[0]] == [(line.index("然"), 0), (len(line), 2)]
    stretches = langid.language_stretches(df.where("unit_id = 'mix'"), model).orderBy("start_char").collect()
    assert [r["language"] for r in stretches] == ["en", "zh"] and stretches[0]["end_char"] == stretches[1]["start_char"] and stretches[-1]["end_char"] == len(units[-1][3])


def test_reading_bands(spark):
    basic, hard = "The cart stops. We wait here. You can go now. Look at the door. ", "Notwithstanding demonstrably heterogeneous considerations, the aforementioned interdependent regularisation substantiates probabilistic reconciliation hypotheses. "
    docs = [(k, basic * 5) for k in range(6)] + [(k, hard * 3) for k in range(10, 16)] + [(99, "short"), (98, None), (97, "1 2 3 " * 60)]
    ratings = [(0, 1, "a"), (1, 1, "a"), (2, 1, "b"), (10, 3, "a"), (11, 3, "a"), (12, 3, "b"), (3, None, "a")]
    d, r = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, band int, labeller string")
    got = {x["doc_id"]: x["band"] for x in readability.reading_bands(d, r).collect()}
    assert got == {**{k: 1 for k in range(6)}, **{k: 3 for k in range(10, 16)}, 97: 2}
    assert {x["band"] for x in readability.reading_bands(d, r.limit(0)).collect()} == {None}
    # ids of any type
    d, r = (x.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")) for x in (d, r))
    assert {x["doc_id"]: x["band"] for x in readability.reading_bands(d, r).collect()} == {f"d{k}": b for k, b in got.items()}


def test_ranks_of_more_words_than_are_sent(spark):
    words = spark.range(60_000).select(F.lit("en").alias("language"), F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("word"), (F.lit(60_000) - F.col("id") + F.pmod("id", F.lit(2))).alias("n"))
    readability.use_shared_checkpoints(spark)
    got = {r["word"]: r["rank"] for r in readability._ranked(words).collect()}
    want = sorted(((r["word"], r["n"]) for r in words.collect()), key=lambda x: (-x[1], x[0]))
    assert got == {w: k + 1 for k, (w, _) in enumerate(want)}


def test_coverage_ranks_beyond_the_vocabulary(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for doc in range(40):
        bag = {}
        for w in r.choices(words, weights=[1 / (k + 1) for k in range(300)], k=r.randrange(1, 60)):
            bag[w] = bag.get(w, 0) + 1
        rows.append((doc, r.choice(["en", "de"]), 1.0, 1.0, list(bag), list(bag.values())))
    rows += [rows[0], (90, None, None, None, [], [])]
    measured = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), *readability.MEASURES.fields]))
    total = {}
    for _, language, _, _, own, counts in rows:
        for w, n in zip(own, counts):
            total[language, w] = total.get((language, w), 0) + n
    rank = {code: {w: k + 1 for k, w in enumerate(sorted((w for c, w in total if c == code), key=lambda w: (-total[code, w], w)))} for code in ("en", "de")}
    expected = []
    for doc, language, _, _, own, counts in rows:
        upto, at = 0, None
        for k, n in sorted((rank[language][w], n) for w, n in zip(own, counts)):
            upto += n
            if upto >= 0.9 * sum(counts):
                at = float(k)
                break
        expected.append((doc, at))
    for vocabulary in (1, 5, 1000):
        got = [(x["doc_id"], x["coverage_rank"]) for x in readability.coverage_ranks(measured, 0.9, vocabulary).collect()]
        assert sorted(got) == sorted(expected)


def _jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_variant_names_take_few_jobs(spark):
    """Jobs and large plans fill the driver's memory: blocks that are refined and classes in two rounds."""
    letters = "bdfgklmnprst"
    people = [f"{a}a{b}e{c}omaster" for a in letters for b in "dfgk" for c in "mnr"]
    customers = spark.createDataFrame([(k, n) for k, n in enumerate(people + [n.upper() + " GmbH" for n in people])], "id long, name string")
    entities = spark.createDataFrame([], "entity_no long, name string, type string")
    mentions = spark.createDataFrame([], "mention_id long, entity_id string, surface string")
    before = _jobs(spark)
    pairs = {(r["left_id"], r["right_id"]) for r in names.name_pairs(customers, entities, mentions).collect()}
    assert _jobs(spark) - before < 90
    assert {(k, k + len(people)) for k in range(len(people))} <= pairs


def test_classes_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 216)] + [(300, 301), (301, 300), (302, 302)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    wanted = {(x, find(x)) for a, b in links if a != b for x in (a, b)}
    found = names.connected(spark, spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(wanted) and {(r["node"], r["root"]) for r in found} == wanted


def test_refined_blocks_are_joined_if_they_are_many(spark, monkeypatch):
    forms = [(k, "customer", f"{a}a{b}emaster", "", "", "") for k, (a, b) in enumerate((a, b) for a in "bdfgkm" for b in "dfgkmn")]
    forms = spark.createDataFrame(forms, "node long, space string, core string, first string, trade string, codes string")
    sent = sorted(map(tuple, names.candidate_pairs(forms).collect()))
    monkeypatch.setattr(names, "MOST_LARGE", 0)
    assert sent and sorted(map(tuple, names.candidate_pairs(forms).collect())) == sent


def test_both_directions_in_one_pass_agree_with_training():
    model, r = langid.ByteGRU(hidden=3, seed=5), np.random.default_rng(5)
    sizes = np.array([1, 2, 2, 5, 9, 9])
    x = r.integers(97, 123, (9, 6)).astype(np.uint8)
    mask = np.arange(9)[:, None] < sizes
    wanted = model.forward(x, mask.astype(np.float32))[0]
    assert np.allclose(model.positions(x, sizes)[mask], wanted[mask], atol=1e-5)
    assert np.allclose(model.pooled(x, sizes), (wanted * mask[..., None]).sum(0) / sizes[:, None], atol=1e-5)


def test_languages_call_numpy_for_many_texts_at_once():
    r, words = random.Random(6), ["the", "cart", "waits", "at", "gate", "and", "turns"]
    texts = ["\n".join(" ".join(r.choices(words, k=8)) + "." for _ in range(4)) for _ in range(1500)]
    units = pd.DataFrame({"unit_table": "documents", "unit_id": [str(k) for k in range(len(texts))], "label": None, "text": texts, "is_piece": False})
    detector, counted = langid.Detector(langid.ByteGRU(), set(words)), cProfile.Profile()
    counted.enable()
    rows = sum(len(x) for x in langid._languages_of(iter([units]), detector, 0.0))
    counted.disable()
    # 48 a text while each one had its own arrays
    assert rows >= len(texts) and sum(x.callcount for x in counted.getstats() if "numpy" in str(x.code)) < 4 * len(texts)


@pytest.mark.parametrize("text", ["The old-fashioned cart's wheel isn't far.", "Der Wagen fährt über die Brücke.", "小车在door等一等。", "گاڑی دروازہ پر gate رکتی ہے۔", "الرافع ينتظر عند الباب.", "a_b c9d ÉTÉ \U00010400\U00020000x 't' ½ ٣"])
def test_words_by_written_out_letters(text):
    assert readability._words_of(text).findall(text.lower()) == readability._ANY_WORD.findall(text.lower()) != []
    assert readability._words_of("\U00010400" + text) is readability._ANY_WORD is not readability._words_of("a")


def test_coverage_of_many_documents_takes_few_calls():
    r = random.Random(11)
    bags = [sorted({f"w{r.randrange(300)}" for _ in range(r.randrange(30))}) for _ in range(2000)]
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "language": ["en"] * 2000, "sentence_words": [1.0] * 2000, "word_chars": [1.0] * 2000, "words": bags, "counts": [[r.randrange(1, 5) for _ in b] for b in bags]})
    counted = cProfile.Profile()
    counted.enable()
    rows = readability._covered(part, pa.array([f"w{k}" for k in range(200)]), 0.9, 200).to_pylist()
    counted.disable()
    assert sum(x.callcount for x in counted.getstats()) < 2000
    for bag, counts, row in zip(bags, part.column("counts").to_pylist(), rows):
        ranked, upto, at = sorted((min(int(w[1:]) + 1, 201), n) for w, n in zip(bag, counts)), 0, None
        for k, n in ranked:
            upto += n
            if upto >= 0.9 * sum(counts):
                at = k
                break
        rare = [(w, n) for w, n in zip(bag, counts) if int(w[1:]) >= 200]
        if at == 201:
            assert row["coverage_rank"] is None and row["target"] == 0.9 * sum(counts) and row["covered"] == sum(counts) - sum(n for _, n in rare)
            assert list(zip(row["rarer"], row["rarer_counts"])) == rare
        else:
            assert row["coverage_rank"] == at and row["target"] is None and row["rarer"] is None
