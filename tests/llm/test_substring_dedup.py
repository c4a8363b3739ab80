import random

import pytest
from helpers import AWKWARD, LONG, documents, write_tables

from emberline.llm import substring_dedup as D


def parts_of(text):
    """Sentences by going through the text letter by letter. For texts with spaces."""
    parts, at, k = [], 0, 0
    while k < len(text):
        if text[k] in ".!?":
            end = k + 1
            while end < len(text) and text[end] in ".!?":
                end += 1
            if end < len(text) and text[end].isspace():
                k = end
        if text[k].isspace() and (text[k] == "\n" or k and text[k - 1] in ".!?"):
            while k < len(text) and text[k].isspace():
                k += 1
            parts.append(text[at:k])
            at = k
        else:
            k += 1
    out = []
    for part in [*parts, text[at:]]:
        if not part.strip():
            out[-1:] = [(out or [""])[-1] + part]
        else:
            out.append(part)
    return [p for p in out if p]


def brute(rows, run, least):
    """What stays of each text, by comparing runs of sentences as tuples of words, without hashes."""
    parts = {i: parts_of(t or "") for i, t in rows}
    runs, first = {}, {}
    for i in sorted(parts):
        runs[i] = []
        for k in range(len(parts[i])):
            long_enough = lambda a, e: e >= a + run and len(" ".join(parts[i][a:e]).split()) >= least  # noqa: E731, B023
            end = len(parts[i])
            for e in sorted({next((e for e in range(k, end + 1) if long_enough(k, e)), 0), end if not long_enough(k + 1, end) and long_enough(k, end) else 0} - {0}):
                key = tuple(w for p in parts[i][k:e] for w in p.lower().split())
                runs[i].append((k, e, key))
                first.setdefault(key, (i, k))
    out = {}
    for i, own in runs.items():
        gone = {j for k, e, key in own if first[key] != (i, k) for j in range(k, e)}
        out[i] = "".join(p for k, p in enumerate(parts[i]) if k not in gone)
    return out


def test_sentences_make_up_the_text():
    for text in ["", " ", "\n\n a", "One. Two!  Three?\nFour", "x " * 100 + "end. Next", "  lead. tail  ", "。".join("日本語" * 3), LONG[:3000]]:
        assert "".join(D.sentences(text)) == text and (all(p.strip() for p in D.sentences(text)) or not text.strip())


def rows_of(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join("w%d" % rng.randrange(500) for _ in range(n)).capitalize() + "."
    passage, two, long_one = " ".join(say(15) for _ in range(4)), f"{say(17)} {say(17)}", say(60)
    rows = []
    for k in range(60):
        text = [say(rng.randint(3, 30)) for _ in range(rng.randint(4, 12))]
        if k % 3 == 0:
            text.insert(rng.randrange(len(text)), passage)
        if k % 5 == 0:
            text.insert(rng.randrange(len(text)), two)
        if k % 7 == 0:
            text.insert(rng.randrange(len(text)), long_one)
        if k % 10 == 0:
            text += text[:4]
        rows.append((k, rng.choice([" ", "\n"]).join(text)))
    return rows + [(100, rows[0][1]), (101, rows[0][1] + " Tail here.")], passage, two, long_one


@pytest.mark.parametrize(("run", "least"), [(2, 20), (3, 12), (1, 30)])
def test_runs_of_sentences_match_brute_force(spark, run, least):
    rows, passage, two, _ = rows_of(4)
    got = {r.doc_id: r.dedup for r in D.remove_repeats(documents(spark, rows), run=run, min_words=least, passage=None).collect()}
    assert {i: r.text for i, r in got.items()} == brute(rows, run, least)
    if run == 2:  # two shared sentences of 17 words are enough
        assert sum(passage in r.text for r in got.values()) == 1 and sum(two in r.text for r in got.values()) == 1
        for r, text in ((got[i], t) for i, t in rows):
            cuts = {0}
            for part in parts_of(text):
                cuts.add(max(cuts) + len(part))
            assert all({s.start, s.end} <= cuts for s in r.spans)


def windows(text, n):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_query_removes_passages_wherever_they_begin_and_nothing_else(spark, tmp_path):
    """Passages of 50 words and more from the middle of long sentences: none is left in two documents, and all that was
    removed stood, 20 words at least, in an earlier document or earlier in the same one."""
    rows, _, _, long_one = rows_of(6)
    rng = random.Random(9)
    say = lambda n: " ".join("v%d" % rng.randrange(900) for _ in range(n))
    source = say(400)
    for k in range(200, 240):
        a, n = rng.randrange(300), rng.choice([50, 51, 60, 90])
        rows.append((k, f"{say(rng.randrange(40))} {' '.join(source.split()[a : a + n])} {say(rng.randrange(40))}" + rng.choice([".", "", " end. Own words here."])))
    rows += [(k, say(120)) for k in range(300, 320)]
    sf = write_tables(spark, tmp_path, documents=documents(spark, rows))
    got, texts = {r.doc_id: r for r in D.op10_substring_dedup(spark, sf).collect()}, dict(rows)
    before = set()
    for i in sorted(texts):
        spans = [texts[i][s.start : s.end] for s in got[i].removed_spans]
        assert not before & {w for piece in _kept(texts[i], got[i].removed_spans) for w in windows(piece, 50)}
        own = windows(texts[i], 20)
        assert all(len(s.split()) >= 20 for s in spans) and not (i >= 300 and spans)
        for s in spans:
            assert windows(s, 20) <= {w for j in texts if j < i for w in windows(texts[j], 20)} | own
        before |= windows(texts[i], 50)
    assert got[100].text == "" and got[100].first_ids == [0] and sum(long_one in r.text for r in got.values()) == 1
    caught = [i for i in range(201, 240) if windows(texts[i], 50) & {w for j in texts if j < i for w in windows(texts[j], 50)}]
    assert len(caught) > 20 and all(got[i].n_removed_spans for i in caught)


def _kept(text, spans):
    at = [0, *(x for s in spans for x in (s.start, s.end)), len(text)]
    return [text[a:b] for a, b in zip(at[::2], at[1::2])]


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in AWKWARD] + [(6, LONG), (None, LONG)]
    docs = documents(spark, rows).withColumnsRenamed({"lang": "h1", "source": "id"}).withColumns({c: D.F.lit(7) for c in ("_r_id", "c1", "_out", "a.b", "part", "dedup")})
    got = D.remove_repeats(docs)
    assert got.columns == [*docs.columns[:-1], "dedup"]
    out = got.collect()
    assert len(out) == len(rows)
    six = [r.dedup.text for r in out if r.doc_id == 6]
    assert len(six) == 2 and six[0] == six[1] and 0 < len(six[0]) < 1000
    assert [r.dedup.text for r in out if r.doc_id == 1] == [None]
    assert {r.dedup.text for r in out if r.doc_id is None} == {"no id", ""}
    assert D.remove_repeats(documents(spark, [])).count() == 0


def test_repeats_in_short_lines_and_in_scripts_without_spaces(spark):
    rng = random.Random(5)
    verse = "\n".join(" ".join("v%d" % rng.randrange(999) for _ in range(1 + k % 3)) for k in range(40)) + "\n"
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    solid, unbroken = "".join(han(9) + "。" for _ in range(8)), han(240)
    rows = [(1, "Own head of one.\n" + verse + "own tail\n"), (2, "Quite another head\n" + verse), (3, han(30) + "。" + solid), (4, solid + han(30) + "。"), (5, han(11) + unbroken), (6, unbroken), (7, "は。い。" * 2), (8, "は。い。" * 2)]
    got = {r.doc_id: r.dedup.text for r in D.remove_repeats(documents(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2].startswith("Quite another head\n") and len(got[2].split()) <= 6
    assert got[3] == rows[2][1] and got[4] == rows[3][1].removeprefix(solid)
    assert got[5] == rows[4][1] and len(got[6]) < 100  # words around its ends stay
    assert got[7] == got[8] == rows[6][1]  # under MIN_WORDS words
    for _, text in rows:
        assert "".join(D.sentences(text)) == text


def test_rows_without_an_id_or_with_a_common_one_keep_their_own_sets(spark):
    say = lambda k: ". ".join(f"sentence {j} of text {k} has just these words" for j in range(8)) + "."
    rows = [(1, say(1)), (2, say(2)), (3, say(3))] + [(i, say(k)) for i in (None, 9) for k in (1, 2, 3, 4, 5)]
    got = [(r.doc_id, r.text, r.dedup.text, r.dedup.first_ids) for r in D.remove_repeats(documents(spark, rows)).collect()]
    for i, text, left, firsts in got:
        k = int(text.split()[4])
        gone = i in (None, 9) and k < 4 or i is None
        assert (left, firsts) == (("", [k if k < 4 else 9]) if gone else (text, []))
