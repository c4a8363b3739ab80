import random
import zlib

import numpy as np
from helpers import AWKWARD, documents, write_tables

from emberline.llm import language as L


def brute_phrases(text, training):
    """Greedy longest matches by substring search over the whole text."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in training:
            end += 1
        at = end
        n += 1
    return n


def test_parse_matches_brute_force():
    rng = random.Random(3)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    training = {"aa": [make("abc d", 300)], "bb": [make("abde.", 200), make("ab", 50)], "cc": [make("éè a", 150)]}
    parser = L.CrossParser(training)
    texts = [make("abcde é.", n) for n in (1, 7, 50, 400, 2047, 2048, 2049, 5000)] + ["zzz", "a"]
    # matches far longer than a block, phrases over several ends of blocks
    training["dd"] = ["ab" * 3000 + "c"]
    texts += ["ab" * 5000, "b" + "ab" * 2500 + "é" + "ab" * 900, training["aa"][0] * 9]
    data = [t.encode() for t in texts]
    got = parser.phrases(data)
    for k, lang in enumerate(parser.languages):
        source = " ".join(training[lang]).encode().translate(parser.classes)
        assert got[k].tolist() == [brute_phrases(d.translate(parser.classes), source) for d in data]


def rows_of(n, seed):
    rng = random.Random(seed)
    words = {"x1": ["lorem", "ipsum", "dolor", "sit", "amet"], "x2": ["kala", "vesi", "talo", "metsä", "joki"], "x3": ["stern", "wasser", "straße", "grün", "baum"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(words))
        rows.append((k, " ".join(rng.choice(words[lang]) + rng.choice(["", "", "en", "in"]) for _ in range(rng.choice([6, 30, 800]))), lang, "s"))
    return rows


def test_held_out_accuracy_and_awkward_rows(spark, tmp_path):
    rows = rows_of(150, 1)
    extra = [(1000 + k, r[1], None, None) for k, r in enumerate(AWKWARD)] + [(None, "lorem ipsum dolor", "x2", None), (2000, "12 34 !!", "x1", None), (2001, None, "x1", None)]
    sf = write_tables(spark, tmp_path, documents=documents(spark, rows + extra).withColumn("score", L.F.lit(1)))
    got = L.op6_language_id(spark, sf).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in got}
    held = [(by_id[i].lang_pred == lang) for i, _, lang, _ in rows if by_id[i].held_out]
    assert held and np.mean(held) > 0.98
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert by_id[None].held_out and by_id[None].lang_pred == "x1"
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1000, 1001, 1002, 2000, 2001)] == [("und", 0.0)] * 5
    assert all(0 <= r.score <= 1 and r.lang_pred in ("x1", "x2", "x3", "und") for r in got)


def test_held_out_rows_and_other_columns_do_not_matter(spark):
    rows = rows_of(60, 2)
    docs = documents(spark, rows)
    changed = documents(spark, [(i, t if zlib.crc32(str(i).encode()) % 5 else "other text", lang, "else") for i, t, lang, _ in rows])
    assert L.training_texts(docs) == L.training_texts(changed.repartition(3))


def test_no_labels_and_empty(spark, tmp_path):
    sf = write_tables(spark, tmp_path, documents=documents(spark, [(1, "text", None, "a")]))
    assert [(r.lang_pred, r.score) for r in L.op6_language_id(spark, sf).collect()] == [("und", 0.0)]
    assert L.identify(documents(spark, []), {"a": ["x"]}).count() == 0


def test_every_byte_of_every_script_counts():
    rng = random.Random(6)
    scripts = {"el": (0x3B1, 24), "hy": (0x561, 38), "he": (0x5D0, 27), "hi": (0x905, 60), "th": (0xE01, 58), "ka": (0x10D0, 33), "am": (0x1200, 300), "ja": (0x3041, 80), "zh": (0x4E00, 3000), "ko": (0xAC00, 3000), "ru": (0x430, 32)}
    make = lambda lang, n: "".join(chr(scripts[lang][0] + rng.randrange(scripts[lang][1])) for _ in range(n))
    training = {lang: [make(lang, 300)] for lang in scripts} | {"en": ["plain words with all of the letters " * 9]}
    parser = L.CrossParser(training)
    used = {b for texts in training.values() for b in " ".join(texts).encode() if b >= 128}
    assert len(used) > 70 and len({parser.classes[b] for b in used} - {0, 1}) == len(used)
    texts = [make(lang, 90) for lang in scripts] + ["letters ж 漢 and words"]
    got = parser.phrases([t.encode() for t in texts])
    for k, lang in enumerate(parser.languages):
        source = " ".join(training[lang]).encode().translate(parser.classes)
        assert got[k].tolist() == [brute_phrases(t.encode().translate(parser.classes), source) for t in texts]
    assert parser.predict(texts[: len(scripts)])[0] == list(scripts)


def test_rare_languages_and_those_of_long_rows_are_learned(spark, monkeypatch):
    rng = random.Random(7)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(80)}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    langs = [lang for k, lang in enumerate(words) for _ in range(3 if k < 70 else 1)]
    rows = [(i, say(lang, 20000 if lang == "l079" else 60), lang, "s") for i, lang in zip(train, langs)] + [(train[-1], "ab", "tiny", "s")]
    training = L.training_texts(documents(spark, rows))
    assert sorted(training) == [*words, "tiny"]
    texts = [say(lang, 20) for lang in words]
    whole = L.CrossParser(training)
    assert whole.predict(texts)[0] == list(words)
    monkeypatch.setattr(L, "GROUP_ENTRIES", 200_000)
    grouped = L.CrossParser(training)
    assert len(grouped.groups) > 3 and len(whole.groups) == 1 and grouped.predict(texts) == whole.predict(texts)
