from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("quarryspan.llm")

from quarryspan.llm import langid, residue, truncation  # noqa: E402
from quarryspan.llm.bpe import TOKENIZERS, PATTERN, PrefixEncoder, encode, token_counts  # noqa: E402
from quarryspan.llm.packing import pack, plan  # noqa: E402
from quarryspan.llm.sentences import sentence_units, units  # noqa: E402
from quarryspan.llm.weak_labels import LABELLER, Labeller  # noqa: E402

TEXTS = ["Hello world", "", None, " \n\t", "naïve café 日本語テキスト ไทย हिन्दी 😀😀", "x" * 5000, "a" * 3 + " b" * 2000, "don't we'll 123,456.78 <|endoftext|>", "​́", "end \n\n  of"]


@pytest.fixture(scope="module")
def encoder():
    return PrefixEncoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_encoding_equals_the_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("abcdefgh ing tion the éßж中") for _ in range(60)) for _ in range(300)]
    for text, words in zip(texts, encoder.encode_batch(texts)):
        assert [i for w in words for i in encoder.words[w]] == other.encode_ordinary(text)


def test_encode_frame(spark, encoder):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS tokens")
    ids = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert ids[1] == [] and ids[2] == []
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df).collect()} == {k: len(v) for k, v in ids.items()}
    for i, t in enumerate(TEXTS):
        assert b"".join(encoder.bytes_of[x] for x in ids[i]).decode() == (t or "")
    assert encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [7, 50, 400])
def test_plan_places_each_item_within_capacity(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(700)] + [1] * 90 + [capacity] * 5
    counts = {s: sizes.count(s) for s in set(sizes)}
    p = plan(counts, capacity)
    s = np.array(sorted(sizes))
    at = p.place(s, np.concatenate([np.arange(counts[k]) for k in sorted(counts)]))
    load = np.bincount(at, weights=s)
    assert len(load) == p.containers and load.max() <= capacity and load.min() > 0
    bins: list[int] = []  # plain first fit of the longest first
    for x in sorted(sizes, reverse=True):
        k = next((k for k, b in enumerate(bins) if b + x <= capacity), None)
        if k is None:
            bins.append(x)
        else:
            bins[k] += x
    assert p.containers <= len(bins) * 1.02 + 1


def test_pack_splits_only_long_items(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 3, 10, 25, 40, 7, 7, 7, 1])]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").selectExpr("*", "1 AS bucket", "2 AS rank")
    got = pack(df, 10, bucket_rows=2).collect()
    for i, n in rows:
        parts = sorted((r["start"], r["tokens"]) for r in got if r["doc_id"] == i)
        assert sum(t for _, t in parts) == (n or 0) and (len(parts) == 1 or n > 10)
        assert [s for s, _ in parts] == [10 * k for k in range(len(parts))]
    load: dict = {}
    for r in got:
        if r["container_id"] is None:
            assert r["tokens"] == 0
        else:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert max(load.values()) <= 10 and pack(df.limit(0), 10).count() == 0


CASES = [
    ("Dr. Orveth et al. report heat. See U.S. appl. No. 11 for it.", ["Dr. Orveth et al. report heat.", "See U.S. appl. No. 11 for it."]),
    ('The manual states: "Keep closed. Do not bend." Next one.', ['The manual states: "Keep closed. Do not bend."', "Next one."]),
    ('He wrote "it works. Mostly." and left. Done!', ['He wrote "it works. Mostly." and left.', "Done!"]),
    ("It draws 5.4 kW vs. 0.2 kW. (See Fig. 2 and Tab. 5.) More.", ["It draws 5.4 kW vs. 0.2 kW.", "(See Fig. 2 and Tab. 5.)", "More."]),
    ("Prior art\nAn exhaust\nprobe works. It does.\n- first item\n2) second one.", ["Prior art", "An exhaust\nprobe works.", "It does.", "- first item", "2) second one."]),
    ("Am 3. März 2021 zeigte sich, z. B. heute, etwas. Das Set hat Ringe usw. Ende.", ["Am 3. März 2021 zeigte sich, z. B. heute, etwas.", "Das Set hat Ringe usw.", "Ende."]),
    ("説明書には「閉じること。曲げないこと。」と書かれている。（図2を参照。）次です！", ["説明書には「閉じること。曲げないこと。」と書かれている。", "（図2を参照。）", "次です！"]),
    ("अंतर लगभग 4.87 मि.मी. है। क्या यह है? हाँ।", ["अंतर लगभग 4.87 मि.मी. है।", "क्या यह है?", "हाँ।"]),
    ("А. В. Орветов сообщает, что это ок. 13,7 мм. Далее.", ["А. В. Орветов сообщает, что это ок. 13,7 мм.", "Далее."]),
    ("La notice précise : « Garder fermé. Ne pas plier. » Est-ce bon ? Oui.", ["La notice précise : « Garder fermé. Ne pas plier. »", "Est-ce bon ?", "Oui."]),
    ("The valve is described in this doc. Novák measures it for the second time.", ["The valve is described in this doc.", "Novák measures it for the second time."]),
    ("Ventil je podľa nás dobrý a doc. Novák ho meria pri práci.", ["Ventil je podľa nás dobrý a doc. Novák ho meria pri práci."]),
    ("Background of the invention and a survey of the known devices\nThe valve is known for a long time and it is used in many places of the plant.", ["Background of the invention and a survey of the known devices", "The valve is known for a long time and it is used in many places of the plant."]),
    ("Die Pumpe misst den\nVerschleiß. Sie hält.", ["Die Pumpe misst den\nVerschleiß.", "Sie hält."]),
    ("Results\nPrior art\n\nIt works for a long time.", ["Results", "Prior art", "It works for a long time."]),
    ("คู่มือระบุว่า“ปิดฝาไว้ ห้ามงอสาย”เสมอ ช่องว่างมีขนาด2.5มม.และวาล์ว", ["คู่มือระบุว่า“ปิดฝาไว้ ห้ามงอสาย”เสมอ", "ช่องว่างมีขนาด2.5มม.และวาล์ว"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in units(text)] == want


@pytest.mark.parametrize("text", ["", " \n ", None, "no end", "x" * 100_000, "." * 3000, '"' * 999, "(" * 500 + "a. B", "a.\r\n\r\nB", *[t for t, _ in CASES]])
def test_units_cover_all_but_white_space(text):
    found = units(text)
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    inside = "".join(text[a:b] for a, b in found) if text else ""
    assert "".join(inside.split()) == "".join((text or "").split())


def test_sentence_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " ")], "doc_id long, text string").selectExpr("*", "1 AS start_pos")
    assert {tuple(r) for r in sentence_units(df).collect()} == {(1, 0, 4), (1, 5, 9)}


def _residue_rows():
    rng = random.Random(4)
    words = "the sensor module records heat loss near drive shaft with little training data under variable load for several weeks".split()
    rows = []
    for i in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(6, 40))).capitalize() + "."
        if i % 10 == 0:
            text = rng.choice(["404 - Page not found", "Please enable JavaScript to view this page.", "test test test test", "Access denied: the record (403).", "Lorem ipsum dolor sit amet consectetur."])
        elif i % 10 == 1:
            text = text[: len(text) // 2] + rng.choice([" {{ title }} ", " ${doc.name} ", " @@excerpt@@ ", " [[claim_1]] "]) + text[len(text) // 2:]
        rows.append((i, text, f"t{i}", f"https://h{i % 30}.example/x"))
    return rows


def test_residue_on_unseen_hosts_and_odd_rows(spark):
    rows = _residue_rows() + [(9001, None, None, None), (9002, " ", "", ""), (9003, "A placeholder molecule keeps the pore open so that heat is measured.", "t", None), (9004, "word " * 20_000, "t", None)]
    df = spark.createDataFrame(rows + rows[:40], "id long, summary string, title string, url string").selectExpr("*", "1 AS label", "2 AS title_class")
    got = [r["id"] for r in residue.find_residue(df).collect()]
    want = {i for i, t, *_ in rows if LABELLER(t)}
    assert len(got) == len(set(got))
    hit = len(want & set(got))
    assert hit / len(want) > 0.97 and hit / len(got) > 0.97
    scores = residue.validate(residue.labelled_sample(df))
    assert scores["recall_by_labels"] > 0.9 and scores["precision_by_labels"] > 0.9
    assert residue.find_residue(df.limit(0)).count() == 0


def test_the_classifier_finds_wordings_that_no_label_has_and_spares_talk_of_them(spark):
    rng = random.Random(9)
    things = ["torque limiter", "filter cartridge", "irrigation valve", "claim parser"]
    rows = []
    for i in range(3000):
        thing = rng.choice(things)
        text = f"The {thing} measures {rng.choice(['heat loss', 'the flow rate', 'noise'])} {rng.choice(['under load', 'at night', 'in real time'])}."
        if i % 9 == 0:
            text = rng.choice(["Unable to load the {} (404).", "Unable to load the {}.", "The server refused to deliver the {} - code 403", "The server refused to deliver the {}!", "Could not fetch the {} (500).", "Could not fetch the {}. Go back"]).format(rng.choice(["record", "page", "file"]))
        elif i % 50 == 1:
            text = f"The crawler counts HTTP 404 responses and the {thing} measures noise in real time."
        rows.append((i, text, rng.choice([f"A {thing} for tests", "Method"]), f"https://h{i % 40}.example/x"))
    df = spark.createDataFrame(rows, "id long, summary string, title string, url string")
    got = {r["id"] for r in residue.find_residue(df).collect()}
    cases = {i for i, *_ in rows if i % 9 == 0}
    silent = {i for i, t, *_ in rows if i in cases and not LABELLER(t)}
    assert len(silent) > 60 and len(silent & got) / len(silent) > 0.95
    assert len(cases & got) / len(got) > 0.97


def test_weak_labels():
    cases = {"{{ title }}": 2, "An <abbr> element marks it.": 0, "<abstract>": 2, "Error 403 Forbidden. Sorry.": 1, "The pump failed (it was tested 45 times).": 0, "foo bar foo bar foo bar": 1, "": 0, None: 0, 'It shows "please enable scripts" at times.': 0}
    assert {t: LABELLER(t) for t in cases} == cases
    assert Labeller(frozenset({"repeated"}))("foo bar foo bar foo bar") == 0

def test_cut_texts(spark):
    rng = random.Random(6)
    ends = ["under variable load", "for several weeks", "near the drive shaft", "in real time"]
    sentence = lambda: f"The {rng.choice(['sensor', 'valve', 'door lock'])} number {rng.randint(1, 99)} records {rng.choice(['heat loss', 'noise', 'the flow rate'])} {rng.choice(ends)}."
    rows, want = [], set()
    for i in range(900):
        text, source = " ".join(sentence() for _ in range(rng.randint(1, 8))), ("limited", " FREE ", None)[i % 3]
        if source == "limited" and len(text) > 150:
            text = text[:150].rstrip() if text[149] == " " else text[:150]
            want |= {i} if not text.endswith(".") else set()
        elif i % 3 == 1 and i % 4 == 0:
            text = text[: len(text) - 5 - i % 7]
            want.add(i)
        elif i % 3 == 1 and i % 4 == 1:
            text = text[:-1]  # a complete sentence without its stop
        rows.append((i, source, text))
    rows += [(2001, "free", "the valve; the flow rate; heat loss"), (2002, "free", None), (2003, "free", "  "), (2004, "free", "The sensor records noise in …")]
    want.add(2004)
    df = spark.createDataFrame(rows + rows[:30], "id long, provider string, summary string").selectExpr("*", "1 AS kind", "2 AS ending", "3 AS times")
    got = [r["id"] for r in truncation.cut_texts(df).collect()]
    assert len(got) == len(set(got))
    hit = len(want & set(got))
    assert hit / len(want) > 0.95 and hit / len(got) > 0.95
    assert truncation.cut_texts(df.limit(0)).count() == 0


SAMPLES = {"en": "a device that records the pressure in the chamber while the vehicle is moving", "de": "ein Gerät, das den Druck in der Kammer während der Wartung misst und meldet", "sk": "zariadenie, ktoré meria tlak v komore počas údržby a hlási výsledok", "ru": "устройство, которое измеряет давление в камере во время обслуживания", "ja": "保守の間に室内の圧力を測定する装置は存在しますか"}


def test_network_learns_and_segments():
    rng = random.Random(8)
    texts, labels = [], []
    for lang, text in SAMPLES.items():
        words = text.split() if lang != "ja" else [text[i:i + 4] for i in range(0, len(text), 4)]
        for _ in range(60):
            texts.append((" " if lang != "ja" else "").join(rng.choice(words) for _ in range(12)))
            labels.append(lang if rng.random() > 0.05 else "en")
    net = langid.train(*langid.labelled_windows(texts, labels, 400))
    for lang, text in SAMPLES.items():
        assert [s[2] for s in langid.segments(net, text)] == [lang]
    mixed = langid.segments(net, SAMPLES["en"] + " / " + SAMPLES["sk"] + " – " + SAMPLES["ru"])
    assert [s[2] for s in mixed] == ["en", "sk", "ru"] and all(0 < s[3] <= 1 for s in mixed)
    assert [s[2] for s in langid.segments(net, "zariadenie, ktore meria tlak v komore pocas udrzby")] == ["sk"]
    assert langid.segments(net, None) == [] and langid.segments(net, " ") == [] and len(langid.segments(net, "???")) == 1


@pytest.mark.parametrize(("said", "lang"), [("EN", "en"), ("en-US", "en"), ("slk", "sk"), ("Deutsch", "de"), ("русский", "ru"), ("mul", None), ("", None), (None, None), ("nl", None), ("ja_JP", "ja")])
def test_labels(said, lang):
    assert langid.language_of(said) == lang
